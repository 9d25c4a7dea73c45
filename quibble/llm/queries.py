"""The training-data queries by name, ``(spark, sf_dir) -> DataFrame``, and their SQL for DuckDB.

Each query applies an operator to its whole table and derives the columns of its
contract from what the operator returns. Queries without SQL (learned models,
seeded hashes, greedy maps) are tested against brute force or held-out labels.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quibble.llm import (
    byte_bpe,
    decontamination,
    hard_negatives,
    language_id,
    line_dedup,
    mixing,
    quality_model,
    quality_rules,
    sharding,
    simhash,
    token_alignment,
    toxicity,
    url_rules,
)
from quibble.llm.common import read, remainder

Query = Callable[[SparkSession, str], DataFrame]


def _held_out(modulus: int, rest: int) -> Column:
    """A null doc_id is not held out, and nothing is learned from it."""
    return F.coalesce(remainder("doc_id", modulus) == rest, F.lit(False)).alias("held_out")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", _held_out(3, 1), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_leaks(docs, read(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, (F.col("n_hit") > 0).alias("contaminated"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language_id.fit(docs)
    return language_id.identify(docs.select("doc_id", "text"), model).select("doc_id", _held_out(4, 2), "lang_pred", "score")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model.fit(docs, read(spark, sf_dir, "labels"))
    scored = quality_model.score(docs, model)
    return scored.select("doc_id", _held_out(5, 0), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(read(spark, sf_dir, "documents").select("doc_id", "text"), shards=16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )


def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.group(docs).select("doc_id", "fingerprint", "component_id")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge(pages).select("page_id", "host", "path", "rule", "verdict", "mined_rule", "mined_confidence")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return quality_rules.judge(docs).select("doc_id", *names, "base_failed", "kept")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "mix_slot")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = token_alignment.Tokenizers(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_alignment.count_links(docs, models, ["doc_id"], {"groups_sha256": digest})


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = byte_bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    encoded = byte_bpe.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256")
    decoded = byte_bpe.decode(encoded.select("doc_id", "n_tokens", ids, "ids"), vocabulary)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.withColumn("label", moved)
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0, vector="embedding")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_decontamination, op3_language_id, op4_quality_classifier, op5_sharding,
        op6_simhash_groups, op7_url_filter, op8_quality_rules, op9_mixing, op10_line_dedup,
        op11_token_alignment, op12_byte_bpe, op13_hard_negatives,
    )
}

ORACLES = {
    "op2_decontamination": r"""
WITH bw AS (SELECT cast(item_id AS varchar) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i + 1 : i + 10], ' ') AS win
        FROM (SELECT item, w, unnest(range(greatest(len(w) - 9, 1))) AS i FROM bw WHERE len(w) > 0)),
dw AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
lens AS (SELECT DISTINCT n FROM win),
dwin AS (SELECT k, n, i, array_to_string(w[i + 1 : i + n], ' ') AS win FROM (SELECT k, n, w, unnest(range(greatest(len(w) - n + 1, 0))) AS i FROM dw, lens)),
hits AS (SELECT k, i, n, item FROM dwin JOIN win USING (n, win)),
items AS (SELECT k, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY k),
words AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, i + unnest(range(n)) AS p FROM hits) GROUP BY k)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN items USING (k) LEFT JOIN words USING (k)""",
    "op8_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
n AS (SELECT k, unnest(range(greatest(len(w) - 7, 0))) AS i, w FROM d),
wins AS (SELECT k, i, array_to_string(w[i + 1 : i + 8], ' ') AS win FROM n),
reps AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, win) AS c FROM wins) WHERE c > 1),
cov AS (SELECT k, sum(least(8, i - coalesce(prev, -8))) AS n FROM (SELECT k, i, lag(i) OVER (PARTITION BY k ORDER BY i) AS prev FROM reps) GROUP BY k),
lines AS (SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM d)
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k),
c AS (SELECT d.k, doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
             coalesce(n_dup, 0) AS n_dup_lines, cast(coalesce(cov.n, 0) AS bigint) AS n_repeat_words
      FROM d LEFT JOIN cov USING (k) LEFT JOIN lines USING (k)),
v AS (SELECT k, lang, source, n_words, unnest([
        {'r': 1, 'm': 50, 'v': n_symbols * 1000 // greatest(word_chars, 1)}, {'r': 2, 'm': 100, 'v': word_chars * 100 // greatest(n_words, 1)},
        {'r': 3, 'm': 300, 'v': n_dup_lines * 1000 // greatest(n_lines, 1)}, {'r': 4, 'm': 300, 'v': n_repeat_words * 1000 // greatest(n_words, 1)}], recursive := true) FROM c),
b AS (SELECT lang, source, r, m, CASE WHEN v < 64 THEN v ELSE (v >> (length(bin(v)) - 6)) << (length(bin(v)) - 6) END AS b FROM v WHERE n_words > 0),
g AS (SELECT CASE WHEN grouping(lang) = 1 THEN 0 WHEN grouping(source) = 1 THEN 1 ELSE 2 END AS lv, lang, source, r, m, b, count(*) AS n
      FROM b GROUP BY GROUPING SETS ((lang, source, r, m, b), (lang, r, m, b), (r, m, b))),
q AS (SELECT *, sum(n) OVER (PARTITION BY lv, lang, source, r ORDER BY b) AS c, sum(n) OVER (PARTITION BY lv, lang, source, r) AS t FROM g),
f AS (SELECT lv, lang, source, r, max(t) AS t, min(b) FILTER (WHERE 4 * c >= t) AS q1, min(b) FILTER (WHERE 4 * c >= 3 * t) AS q3, max(m) AS m FROM q GROUP BY ALL),
p AS (SELECT v.k, v.r, v.v, f.*, row_number() OVER (PARTITION BY v.k, v.r ORDER BY f.lv DESC) AS pick
      FROM v JOIN f ON v.r = f.r AND (f.lv = 0 OR (v.lang IS NOT DISTINCT FROM f.lang AND (f.lv = 1 OR v.source IS NOT DISTINCT FROM f.source)))
      WHERE f.lv = 0 OR f.t >= 200),
bad AS (SELECT k, bool_or(v > q3 + 3 * (q3 - q1) + m OR (r = 2 AND v < q1 - 3 * (q3 - q1) - m)) AS bad FROM p WHERE pick = 1 GROUP BY k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR coalesce(bad, false)) AS kept
FROM c LEFT JOIN bad USING (k)""",
    "op9_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text,''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, cast(sum(size) AS bigint) AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, 1 + (rank - 1) % 3 AS weight, 3.0 * source_size / (1 + (rank - 1) % 3) AS ratio FROM s),
c AS (SELECT *, coalesce(sum(3.0 * source_size) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
      sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free, sum(source_size) OVER () AS total FROM w),
l AS (SELECT (SELECT cast(total - capped AS double) / free FROM c WHERE (total - capped) / free <= ratio ORDER BY ratio, rank LIMIT 1) AS level),
t AS (SELECT source, source_size, least(3.0 * source_size, coalesce(level, 0) * weight) AS target FROM w, l),
o AS (SELECT d.*, source_size, cast(target AS double) AS target, cast(floor(target + 0.5) AS bigint) AS goal,
      coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5('mix' || coalesce(cast(doc_id AS varchar), 'null')), doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT o.*, CASE WHEN source_size = 0 THEN 0 ELSE cast((goal // source_size) * size + greatest(0, least(a + size, goal % source_size) - a) AS bigint) END AS taken FROM o),
b AS (SELECT greatest(1, sum(source_size) // (count(*) * 1024)) AS block FROM t),
h AS (SELECT source, goal, cast(ceil(goal / block) AS bigint) AS quota, upto - target AS lower, upto FROM (
        SELECT t.*, cast(floor(target + 0.5) AS bigint) AS goal, sum(cast(target AS double)) OVER (ORDER BY encode(source) NULLS LAST ROWS UNBOUNDED PRECEDING) AS upto FROM t), b),
p AS (SELECT i, (i * 0.6180339887498949::double) % 1.0::double * (SELECT max(upto) FROM h) AS point FROM (SELECT unnest(range((SELECT cast(sum(quota) AS bigint) FROM h))) AS i)),
r AS (SELECT source, quota, i AS slot, row_number() OVER (PARTITION BY source ORDER BY i) - 1 AS rank FROM p JOIN h ON point >= lower AND point < upto),
m AS (SELECT source, slot, rank FROM r WHERE rank < quota UNION ALL
      SELECT source, (SELECT cast(sum(quota) AS bigint) FROM h) + rank, rank FROM (
        SELECT h.source, unnest(range(coalesce(had, 0), quota)) AS rank FROM h LEFT JOIN (SELECT source, count(*) AS had FROM r GROUP BY source) n ON h.source IS NOT DISTINCT FROM n.source))
SELECT doc_id, cast(size AS bigint) AS size, source_size, target, taken, slot AS mix_slot
FROM (SELECT k.*, CASE WHEN taken > 0 THEN a // block END AS rank FROM k, b) k LEFT JOIN m ON k.source IS NOT DISTINCT FROM m.source AND k.rank = m.rank""",
    "op10_line_dedup": r"""
WITH l AS (SELECT doc_id, n, line, lower_key, length(lower_key) AS chars FROM (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS n, translate(regexp_replace(regexp_replace(unnest(lines), '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
k AS (SELECT lower_key, max(doc_id) AS keeper FROM l WHERE chars >= 40 GROUP BY lower_key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT l.*, coalesce(l.doc_id <> keeper, false) AS dropped FROM l LEFT JOIN k ON l.chars >= 40 AND l.lower_key = k.lower_key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM j GROUP BY doc_id""",
    "op13_hard_negatives": r"""
WITH e AS (SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * cast(x AS double))) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.k AS a, a.vec_id AS anchor_id, r.k AS r, r.vec_id AS id, a.label = r.label AS same,
             cast(list_inner_product(a.v, r.v) AS bigint) AS score
      FROM (SELECT * FROM e WHERE vec_id % 100 = 0) a JOIN e r ON a.k <> r.k),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, id, r) AS n FROM s WHERE same) WHERE n <= 5),
q AS (SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, s.id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.a, p.n ORDER BY s.score DESC, s.id, s.r) AS rank
      FROM p JOIN s ON p.a = s.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, cast(rank AS integer) AS rank, negative_id, positive_score, negative_score FROM q WHERE rank <= 5""",
}
