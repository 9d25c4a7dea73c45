"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Counts per document are integer expressions on the JVM. Four ratios of them are
put into log-linear buckets (six significant bits, so a quantile is off by 1/32
of its value at most), and the bucket counts per language and source are the
sketch: merging sketches is adding counts. Sketches are merged to languages and
to the whole table, and each language and source takes its limits from the
finest sketch with at least ``MIN_DOCS`` documents: the upper quartile plus
``SPREAD`` quartile ranges plus a margin, and for the word length a lower limit too.
Limits are joined to the documents' counts; texts are read once and never move.

Defined results: null and empty texts have no words and fail the base rule; a
null language or source is a group of its own; repeated rows count each; an
empty table has no limits and no rows; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quibble.sources.staging import stage

MIN_DOCS = 200
SPREAD = 3
#: Ratio, as integer expression of the counts, and the margin above its upper limit.
RATIOS = {
    "symbols": ("n_symbols * 1000 div greatest(word_chars, 1)", 50),
    "word_length": ("word_chars * 100 div greatest(n_words, 1)", 100),
    "dup_lines": ("n_dup_lines * 1000 div greatest(n_lines, 1)", 300),
    "repeats": ("n_repeat_words * 1000 div greatest(n_words, 1)", 300),
}
_BLANK = r"[\x20\x09-\x0D]+"
_WINDOW = 8


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once; a lambda would compute an outer expression per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(words: Column) -> Column:
    """Words inside windows that the text has twice or more. Window texts are only built where hashes repeat."""
    last = F.size(words) - _WINDOW

    def windows(make):
        return F.transform(F.sequence(F.lit(0), last), make)

    def starts(z: Column) -> Column:
        def repeated(j: Column) -> Column:
            here = F.get(z, j)["k"]
            same = (F.get(z, j - 1)["k"] == here) | (F.get(z, j + 1)["k"] == here)
            return F.when(same, F.get(z, j)["i"])

        return F.array_sort(F.array_compact(F.transform(F.sequence(F.lit(0), F.size(z) - 1), repeated)))

    def total(p: Column) -> Column:
        begin = F.struct(F.lit(-_WINDOW).alias("last"), F.lit(0).alias("n"))
        add = lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(_WINDOW), x - a["last"])).alias("n"))
        return F.aggregate(p, begin, add)["n"]

    def exact(h: Column) -> Column:
        texts = windows(lambda i: F.struct(F.array_join(F.slice(words, i + 1, _WINDOW), " ").alias("k"), i.alias("i")))
        once = F.size(F.array_distinct(h)) == F.size(h)
        return F.when(once, F.lit(0)).otherwise(let(F.array_sort(texts), lambda z: total(starts(z))))

    return F.when(last < 0, F.lit(0)).otherwise(let(windows(lambda i: F.xxhash64(F.slice(words, i + 1, _WINDOW))), exact))


def counts(docs: DataFrame) -> DataFrame:
    """``docs`` without text, with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words."""
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    kept = [c for c in docs.columns if c not in (*names, "text")]
    text = F.coalesce("text", F.lit(""))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), _covered(w).alias("n_repeat_words")
        )

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))

    words = let(F.array_remove(F.split(text, _BLANK), ""), of_words)
    lines = let(F.filter(F.split(text, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")), of_lines)
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    counted = docs.select(*[f"`{c}`" for c in kept], words.alias("_w"), lines.alias("_l"), symbols.alias("n_symbols"))
    return counted.select(
        *[f"`{c}`" for c in kept],
        *[F.col(f"{'_l' if 'line' in c else '_w'}.{c}" if c != "n_symbols" else c).cast("long").alias(c) for c in names],
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def bucket(v: str) -> Column:
    """Lower bound of the bucket of a number from 0 on: its six leading bits."""
    return F.expr(f"CASE WHEN {v} < 64 THEN {v} ELSE shiftleft(shiftright({v}, length(bin({v})) - 6), length(bin({v})) - 6) END")


def sketch(counted: DataFrame) -> DataFrame:
    """(lang, source, ratio, bucket, n): the mergeable sketch of every language and source."""
    pairs = ", ".join(f"'{name}', cast({sql} AS bigint)" for name, (sql, _) in RATIOS.items())
    long = counted.where("n_words > 0").select("lang", "source", F.expr(f"stack({len(RATIOS)}, {pairs}) AS (ratio, v)"))
    return long.groupBy("lang", "source", "ratio", bucket("v").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def limits(sketches: DataFrame) -> DataFrame:
    """(lang, source) with the limits of each ratio, from the finest sketch that has enough documents."""

    def quartiles(keys: list[str], level: str) -> DataFrame:
        merged = sketches.groupBy(*keys, "ratio", "bucket").agg(F.sum("n").alias("n"))
        group = Window.partitionBy(*keys, "ratio")  # at most a few hundred buckets
        up_to = F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        ranked = merged.withColumns({"_c": up_to, "_n": F.sum("n").over(group)})
        found = ranked.groupBy(*keys, "ratio").agg(
            F.max("_n").alias("n"),
            F.min(F.when(F.expr("4 * _c >= _n"), F.col("bucket"))).alias("q1"),
            F.min(F.when(F.expr("4 * _c >= 3 * _n"), F.col("bucket"))).alias("q3"),
        )
        margin = F.create_map(*[x for name, (_, m) in RATIOS.items() for x in (F.lit(name), F.lit(m))])
        slack = SPREAD * (F.col("q3") - F.col("q1")) + F.element_at(margin, F.col("ratio"))
        wide = found.groupBy(*keys).agg(
            F.max("n").alias("_docs"),
            *[F.max(F.when(F.col("ratio") == r, F.col("q3") + slack)).alias(f"max_{r}") for r in RATIOS],
            F.max(F.when(F.col("ratio") == "word_length", F.col("q1") - slack)).alias("min_word_length"),
        )
        value = F.struct("_docs", *[f"max_{r}" for r in RATIOS], "min_word_length")
        return wide.select(*keys, value.alias(level))

    fine, lang, whole = quartiles(["lang", "source"], "_fine"), quartiles(["lang"], "_lang"), quartiles([], "_all")
    both = fine.alias("f").join(lang.alias("g"), F.col("f.lang").eqNullSafe(F.col("g.lang")), "left")
    both = both.select("f.lang", "f.source", "_fine", "_lang").join(F.broadcast(whole), how="left")  # one row
    enough = lambda c: F.when(F.col(f"{c}._docs") >= MIN_DOCS, F.col(c))
    chosen = F.coalesce(enough("_fine"), enough("_lang"), F.col("_all"))
    return both.select("lang", "source", chosen.alias("limit"))


def judge(docs: DataFrame) -> DataFrame:
    """``docs`` without text, with the counts, base_failed, kept and ``failed``, the names of the rules that failed."""
    taken = ("base_failed", "kept", "failed", "limit")
    counted = stage(counts(docs.select(*[f"`{c}`" for c in docs.columns if c not in taken])), "quality-counts")
    found = stage(limits(sketch(counted)), "quality-limits").alias("l")
    same = F.col("c.lang").eqNullSafe(F.col("l.lang")) & F.col("c.source").eqNullSafe(F.col("l.source"))
    joined = counted.alias("c").join(found, same, "left").select("c.*", "limit")
    tests = [
        F.when(F.expr(f"{sql} > limit.max_{name}"), F.lit(f"{name} above limit")) for name, (sql, _) in RATIOS.items()
    ]
    tests.append(F.when(F.expr(f"{RATIOS['word_length'][0]} < limit.min_word_length"), F.lit("word_length below limit")))
    tests.append(F.when(F.col("base_failed"), F.lit("base")))
    failed = F.array_compact(F.array(*tests))
    return joined.withColumn("base_failed", base_failed()).withColumn("failed", failed).withColumn(
        "kept", F.size("failed") == 0
    )
