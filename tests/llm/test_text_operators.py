"""Decontamination, near-duplicates, line dedup and quality rules against brute force."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quibble.llm import decontamination, graph, line_dedup, quality_rules, simhash
from quibble.llm.common import read
from quibble.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"
BLANKS = " \t\n\x0b\x0c\r"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, name):
    from compare import compare

    assert compare(QUERIES[name](spark, SF), con, ORACLES[name]) is None


# --- decontamination -----------------------------------------------------------------


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_leaks(docs, items):
    out = {}
    for doc, text in docs:
        words, hit, found = plain_words(text), set(), set()
        for item, item_text in items:
            w = plain_words(item_text)
            n = min(10, len(w))
            for i in range(max(1, len(w) - 9) if w else 0):
                for j in range(len(words) - n + 1):
                    if words[j : j + n] == w[i : i + n]:
                        hit |= set(range(j, j + n))
                        found.add(item)
        out[doc] = (len(words), len(hit), sorted(found))
    return out


LEAK_ITEMS = [("10", "One two THREE four five six seven eight nine ten eleven"), ("9", "short one"), ("8", ""), ("7", None), ("6", "Größe 5"), ("5", "short one")]
LEAK_DOCS = [
    (1, "x, One-two three four. five six seven eight nine ten eleven y"), (2, "a SHORT: one b short one"), (3, None), (4, ""), (5, "größe 5 GRÖSSE 5"),
    (6, "Größe 5"), (7, "short one short one"), (8, "one two three four five six seven eight nine"), (9, "shorter one"), (10, "z " * 50_000 + "short one"),
]


@pytest.mark.parametrize("limit", [1 << 20, 1])
def test_leaks_equal_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(decontamination.blocks, "__defaults__", (10, limit))  # one block, or one for each item
    docs = spark.createDataFrame([(i, t, "own", 5) for i, t in LEAK_DOCS], "doc_id long, text string, lang string, n_hit int")
    items = spark.createDataFrame(LEAK_ITEMS, "item_id string, text string")
    rows = decontamination.find_leaks(docs, items).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in rows}
    assert got == brute_leaks(LEAK_DOCS, LEAK_ITEMS) and {r.lang for r in rows} == {"own"}
    text = dict(LEAK_DOCS)
    spans = {r.doc_id: [text[r.doc_id][s.start : s.stop] for s in r.spans] for r in rows}
    assert spans[1] == ["One-two three four. five six seven eight nine ten eleven"]
    assert spans[2] == ["SHORT: one", "short one"] and spans[6] == ["Größe 5"] and spans[3] == []
    assert decontamination.find_leaks(docs, items.where("false")).where("n_hit > 0").isEmpty()
    assert decontamination.find_leaks(docs.where("false"), items).isEmpty()


# --- near-duplicates -----------------------------------------------------------------


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """doc -> smallest doc reachable over at most three differing bits."""
    docs = sorted(fps)
    parent = {d: d for d in docs}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for i, a in enumerate(docs):
        for b in docs[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in docs}


@pytest.mark.parametrize("text", ["", None, "one", "A b", "a b c", "Ä Ö ä ö ü\tx\x0by", "the cat sat on the mat " * 40, " \n "])
def test_fingerprint_by_hand(text):
    assert simhash.fingerprint(text.encode() if text is not None else None) == brute_fingerprint(text)


def test_fingerprint_hash_is_sparks(spark):
    assert spark.sql("SELECT xxhash64('a b c') AS h").first().h == np.uint64(simhash.fingerprint(b"a b c")).astype(np.int64)


@pytest.mark.parametrize("family", range(simhash.FAMILIES))
def test_masks_cover_every_three_bits(family):
    kept = simhash.masks(family)
    assert len(kept) == 15
    rng = np.random.default_rng(family)
    for _ in range(3000):
        diff = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        assert any(m & diff == 0 for m in kept)


def test_groups_equal_brute_force_on_the_documents(spark):
    rows = QUERIES["op6_simhash_groups"](spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in read(spark, "/root/testdata/sf0.001", "documents").collect()}
    fps = {d: brute_fingerprint(t) for d, t in texts.items()}
    assert {r.doc_id: int(r.fingerprint, 16) for r in rows} == fps
    assert {r.doc_id: r.component_id for r in rows} == brute_components(fps)


@pytest.mark.parametrize("split_over", [2048, 2])
def test_links_lose_no_component(spark, split_over):
    rng = np.random.default_rng(3)
    center = rng.integers(0, 1 << 63, dtype=np.uint64)
    fps = {0}
    for _ in range(150):  # a crowd around one fingerprint, pairs, and loners
        fps.add(int(center) ^ sum(1 << int(b) for b in rng.choice(12, rng.integers(0, 6))))
    for _ in range(40):
        x = int(rng.integers(0, 1 << 63, dtype=np.uint64))
        fps |= {x, x ^ sum(1 << int(b) for b in rng.choice(64, 3, replace=False))}
    ids = dict(enumerate(sorted(fps)))
    signed = [(simhash._signed(x),) for x in fps]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), split_over)
    rows = edges.collect()
    assert all(r.a != r.b for r in rows)
    nodes = graph.components(edges).collect()
    number = {simhash._signed(x): i for i, x in ids.items()}
    want = brute_components(ids)
    got = {}
    for r in nodes:
        got.setdefault(r.root, set()).add(number[r.node])
    groups = {}
    for i, root in want.items():
        groups.setdefault(root, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_components_of_a_long_chain_and_a_star(spark):
    rows = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5), (0, 1), (1, 0)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 1000 for i in range(1000, 1100)}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_near_duplicate_edges(spark):
    text = "some words that make up one document of the corpus and go on"
    rows = [(None, text), (7, text), (7, text), (3, text.upper()), (9, None), (8, " "), (2, "x" * 100_000), (None, "alone by itself")]
    docs = spark.createDataFrame([(i, t, "l", "own") for i, t in rows], "doc_id long, text string, lang string, fp string")
    got = simhash.group(docs.drop("fp")).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got} == {(None, 3), (7, 3), (3, 3), (9, 8), (8, 8), (2, 2), (None, None)}
    assert {r.fingerprint for r in got if r.doc_id in (8, 9)} == {"0" * 16}
    kept = simhash.keep_one(docs.drop("fp"))
    assert kept.columns == ["doc_id", "text", "lang"]
    assert sorted((r.doc_id or 0, (r.text or "")[:5]) for r in kept.collect()) == [(0, "alone"), (2, "xxxxx"), (3, "SOME "), (8, " ")]
    assert simhash.group(docs.where("false")).isEmpty()


# --- line dedup ----------------------------------------------------------------------


def brute_lines(docs):
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(BLANKS))

    holders = {}
    for doc, text in docs:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= 40:
                holders.setdefault(k, []).append(doc)
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), [])) >= 5 and max(holders[key(x)]) != doc)]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


LINE = "This line is repeated across a number of documents, word for word"
LINE_DOCS = [
    *[(i, f"own {i}\n  {LINE if i % 2 else LINE.upper()}\t\nend") for i in range(9)],
    *[(i, "é" * 39 + f"\n{'é' * 40}\n{'é' * 40}") for i in range(20, 26)],
    *[(i, "only four documents hold this line, so it has to stay here") for i in range(30, 34)],
    (40, None), (41, ""), (42, "\n\n"), (43, LINE), (44, "y" * 300_000), (44, "y" * 300_000),
]


@pytest.mark.parametrize("shard_keys,block_bytes", [(200_000, 64 << 20), (1, 1)])
def test_lines_equal_brute_force(spark, shard_keys, block_bytes):
    docs = spark.createDataFrame([(i, t, "own", 1) for i, t in LINE_DOCS], "doc_id long, text string, lang string, n_lines int")
    rows = line_dedup.drop_lines(docs, shard_keys=shard_keys, block_bytes=block_bytes)
    got = rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("h"), "lang").collect()
    assert sorted(tuple(r)[:4] for r in got) == brute_lines(LINE_DOCS) and {r.lang for r in got} == {"own"}
    assert line_dedup.drop_lines(docs.where("false")).isEmpty()


def test_lines_without_ids(spark):
    docs = spark.createDataFrame([(None, LINE)] * 5 + [(None, "x")], "doc_id long, text string")
    assert line_dedup.drop_lines(docs).agg(F.sum("n_dropped")).first()[0] == 0


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 513, 20_000])
def test_perfect_hash_numbers_its_keys(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
    h = line_dedup.PerfectHash(keys)
    assert sorted(h.index(keys).tolist()) == list(range(len(keys)))
    shard = line_dedup.Shard(keys, keys + np.uint64(1), np.full(len(keys), 6), np.arange(len(keys)))
    known, keepers = shard.probe(keys, keys + np.uint64(1), 5)
    assert known.all() and (keepers == np.arange(len(keys))).all()
    strange = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    assert not shard.probe(strange, strange, 5)[0].any()


# --- quality rules -------------------------------------------------------------------


def test_counts_by_hand(spark):
    window = "one two three four five six seven eight"
    rows = [
        (1, None), (2, ""), (3, f"{window} {window}"), (4, f"{window} nine {window} one two three four five six seven"), (5, "a#b $c\n\n \na#b $c\na#b $c "),
        (6, "x " * 9), (7, "größer\u00a0x\x1fy"), (8, "w " * 30_000),
    ]
    docs = spark.createDataFrame([(i, t, "l", "s") for i, t in rows], "doc_id long, text string, lang string, source string")

    def brute(text):
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        covered = set()
        count = {}
        for x in windows:
            count[x] = count.get(x, 0) + 1
        for i, x in enumerate(windows):
            if count[x] > 1:
                covered |= set(range(i, i + 8))
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = {r.doc_id: tuple(r[n] for n in names) for r in quality_rules.counts(docs).collect()}
    assert got == {i: brute(t) for i, t in rows}
    judged = quality_rules.judge(docs.withColumn("kept", F.lit("x")))
    assert judged.count() == len(rows) and not judged.where("base_failed and kept").count()
    assert quality_rules.judge(docs.where("false")).isEmpty()


def test_limits_adapt_to_the_source(spark):
    words = " ".join(f"word{i}" for i in range(40))
    plain = [(i, words, "en", "prose") for i in range(300)]
    code = [(i, words.replace(" ", " # "), "en", "code") for i in range(300, 600)]
    odd = [(1000, words.replace(" ", " # "), "en", "prose"), (1001, words, None, None)]
    docs = spark.createDataFrame(plain + code + odd, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: (r.kept, r.failed) for r in quality_rules.judge(docs).collect()}
    assert all(kept[i][0] for i in range(600)) and kept[1001][0]
    assert not kept[1000][0] and "symbols above limit" in kept[1000][1]


def test_no_python_on_the_native_paths(spark):
    for name in ("op7_url_filter", "op8_quality_rules"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan)
