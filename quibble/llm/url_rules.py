"""URL filters: listed rules first, then association rules mined with FP-growth.

Listed rules name a host and the start of a path; the longest that fits decides.
Urls they decide are the labels. Tokens of these urls (top-level domain, domain,
host labels, path segments with digits as ``#``, query names) and their verdict
are the transactions of FP-growth. Token sets whose share of one verdict is at
least ``CONFIDENCE`` and which ``SUPPORT`` of the labelled urls hold become rules,
unless a subset predicts the same at least as surely. A rule is posted in an
inverted index under its rarest token; urls look up their tokens, and a posted
rule fires if the url holds all of its tokens. Surest rule first, then the one
with more urls behind it, then more tokens, then block before allow.

Before mining, tokens below the support go, which are in no frequent set, and tokens that the same
transactions hold become one item, named by the first of them: each stands for all, so a rule
fires on any of an item's tokens, as the rules with either of them would.

Every distinct token set is judged once, however many pages share it.

Defined results: a null url, or one without ``://``, has an empty host and path
and no tokens; where no rule fires, and without labels, the verdict is ``allow``;
repeated rows are judged alike; other columns are kept.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quibble.llm.common import free_name
from quibble.sources.staging import stage

SUPPORT = 0.01
CONFIDENCE = 0.9
SAMPLE = 200_000  # labelled urls that FP-growth reads, about, chosen by hash of the row

#: Verdict, host, start of the path.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` (A-Z in lower case) and ``path``; both empty without ``://``."""
    rest = F.expr(f"CASE WHEN instr(`{url}`, '://') > 0 THEN substring(`{url}`, instr(`{url}`, '://') + 3) ELSE '' END")
    rest = F.coalesce(rest, F.lit(""))
    before_query = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    host = F.substring_index(before_query, "/", 1)
    path = F.substring(before_query, F.length(host) + 1, F.length(before_query))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    kept = [c for c in pages.columns if c not in ("host", "path")]
    return pages.select(*[f"`{c}`" for c in kept], F.translate(host, upper, lower).alias("host"), path.alias("path"))


def listed_rule(rules: list[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest listed rule that fits ``host`` and ``path``; null if none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, host, path in reversed(ordered):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        out = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: str = "url") -> Column:
    """Sorted distinct tokens of a url with ``host`` and ``path``."""
    labels = F.split("host", r"\.")
    named = lambda kind, c: F.concat(F.lit(kind + ":"), c)
    shape = lambda c: F.regexp_replace(F.lower(c), r"[0-9]+", "#")
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    query = F.when(F.instr(url, "?") > 0, F.substring_index(F.expr(f"substring(`{url}`, instr(`{url}`, '?') + 1)"), "#", 1))
    names = F.transform(F.split(F.coalesce(query, F.lit("")), "&"), lambda p: F.substring_index(p, "=", 1))
    parts = F.concat(
        F.array(named("tld", F.substring_index("host", ".", -1)), named("domain", F.substring_index("host", ".", -2))),
        F.transform(F.slice(labels, 1, F.greatest(F.size(labels) - 2, F.lit(0))), lambda x: named("host", x)),
        F.transform(segments, lambda s, i: F.concat(F.lit("path"), i.cast("string"), F.lit(":"), shape(s))),
        F.transform(F.filter(names, lambda n: n != ""), lambda n: named("query", shape(n))),
    )
    return F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(parts)))


def mine(
    labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, sample: int = SAMPLE
) -> tuple[DataFrame, DataFrame]:
    """Rules (tokens, verdict, confidence, support) over items, and (token, item), from ``labelled(id, tokens, verdict)``; both staged.

    About ``sample`` rows are read (a documented bound), whole; copies of a url are rows of their own.
    """
    spark = labelled.sparkSession
    none = "tokens array<string>, verdict string, confidence double, support long"
    worded = labelled.where(F.size("tokens") > 0)
    share = F.lit(min(1.0, sample / max(1, worded.count())) * (1 << 30))
    chosen = stage(worded.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) < share), "transactions")
    least = support * chosen.count()
    each = chosen.select("id", F.explode("tokens").alias("token"))
    held = lambda *salt: F.sum(F.xxhash64("id", *salt).cast("decimal(38,0)"))
    counted = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), held().alias("a"), held(F.lit(1)).alias("b"))
    usual = stage(counted.where(F.col("n") >= least), "usual-tokens")  # at most tokens per url / support of them
    named = usual.groupBy("n", "a", "b").agg(F.min("token").alias("item"))
    items = stage(usual.join(named, ["n", "a", "b"]).select("token", "item"), "items")
    if items.isEmpty():
        return spark.createDataFrame([], none), items
    of_row = each.join(items, "token").groupBy("id").agg(F.collect_set("item").alias("items"))
    verdict = F.array(F.concat(F.lit("="), F.col("verdict")))
    baskets = chosen.select("id", "verdict").join(of_row, "id", "left")
    baskets = stage(baskets.select(F.concat(verdict, F.coalesce("items", F.array().cast("array<string>"))).alias("items")), "baskets")
    sets = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets).freqItemsets
    sets = sets.select(
        F.filter("items", lambda x: x.startswith("=")).alias("_verdict"),
        F.array_sort(F.filter("items", lambda x: ~x.startswith("="))).alias("tokens"),
        "freq",
    ).where(F.size("tokens") > 0)
    sets = stage(sets, "itemsets")
    bodies = sets.where(F.size("_verdict") == 0).select("tokens", F.col("freq").alias("support"))
    heads = sets.where(F.size("_verdict") == 1).select("tokens", F.expr("substring(_verdict[0], 2)").alias("verdict"), "freq")
    rules = heads.join(bodies, "tokens").withColumn("confidence", F.col("freq") / F.col("support"))
    rules = stage(rules.where(F.col("confidence") >= confidence).select("tokens", "verdict", "confidence", "support"), "rules")
    # A longer rule is redundant if one token less predicts the same at least as surely.
    shorter = rules.select(
        F.col("tokens").alias("_all"), "verdict", F.col("confidence").alias("_own"),
        F.explode(F.transform("tokens", lambda t: F.array_remove("tokens", t))).alias("tokens"),
    ).join(rules, ["tokens", "verdict"]).where("confidence >= _own")
    redundant = shorter.select(F.col("_all").alias("tokens"), "verdict").distinct()
    return stage(rules.join(redundant, ["tokens", "verdict"], "left_anti"), "pruned-rules"), items


def inverted_index(rules: DataFrame) -> DataFrame:
    """(token, rule): each rule under the token that fewest rules hold."""
    exploded = rules.select("*", F.explode("tokens").alias("token"))
    usual = exploded.groupBy("token").agg(F.count(F.lit(1)).alias("_n"))
    rule = F.struct("confidence", "support", F.size("tokens").alias("length"), "verdict", "tokens")
    return (
        exploded.join(usual, "token")
        .groupBy("tokens", "verdict")
        .agg(F.min(F.struct("_n", "token")).alias("_rarest"), F.first(rule).alias("rule"))
        .select(F.col("_rarest.token").alias("token"), "rule")
    )


def fire(sets: DataFrame, index: DataFrame, items: DataFrame) -> DataFrame:
    """(tokens, best): the surest rule that each distinct token set satisfies, by its items."""
    own = sets.select("tokens", F.explode("tokens").alias("token")).join(items, "token")
    own = own.groupBy("tokens").agg(F.collect_set("item").alias("_items"))
    looked_up = own.select("tokens", "_items", F.explode("_items").alias("token")).join(index, "token")
    fires = looked_up.where(F.size(F.array_except("rule.tokens", "_items")) == 0)
    return fires.groupBy("tokens").agg(F.max("rule").alias("best"))


def judge(pages: DataFrame, url: str = "url", rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """``pages`` with host, path, rule, verdict, and the mined rule and its confidence where it decides."""
    added = ("rule", "verdict", "mined_rule", "mined_confidence")
    base = with_host_and_path(pages.select(*[f"`{c}`" for c in pages.columns if c not in added]), url)
    names = [f"`{c}`" for c in base.columns]
    listed_name, set_name, row = (free_name(base, n) for n in ("_listed", "_tokens", "_row"))
    base = stage(base.withColumn(listed_name, listed_rule(rules)).withColumn(set_name, tokens(url)), "urls", row)
    listed = F.col(f"{listed_name}.verdict")
    labelled = base.where(listed.isNotNull())
    mined, items = mine(labelled.select(F.col(row).alias("id"), F.col(set_name).alias("tokens"), listed.alias("verdict")))
    sets = base.where(listed.isNull()).select(F.col(set_name).alias("tokens")).distinct()
    best = stage(fire(sets, inverted_index(mined), items), "fired").withColumnRenamed("tokens", set_name)
    best = best.withColumnRenamed("best", "_best_" + row)  # a name that the pages do not have either
    joined, found = base.join(best, set_name, "left"), F.col("_best_" + row)
    return joined.select(
        *names,
        F.col(f"{listed_name}.rule").alias("rule"),
        F.coalesce(listed, found["verdict"], F.lit("allow")).alias("verdict"),
        F.when(listed.isNull(), found["tokens"]).alias("mined_rule"),
        F.when(listed.isNull(), found["confidence"]).alias("mined_confidence"),
    )
