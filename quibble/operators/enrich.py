"""Reviews joined with product records, and the daily product health table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quibble.functions.dates import month_start, week_start
from quibble.sources.staging import stage

# Product columns a review is enriched with.
PRODUCT_COLUMNS = [
    "title", "brand", "price", "main_cat", "sub_category", "root_category", "leaf_category",
    "category_depth", "category_path", "category_list",
]
ENRICHED_REVIEW_COLUMNS = [
    "asin", "reviewer_id", "reviewer_name", "category", "ingest_dt", "overall", "summary",
    "review_text", "review_text_clean", "review_length", "review_date", "week_bucket",
    "month_bucket", "verified_flag", "vote_count", "positive_flag", "neutral_flag",
    "negative_flag", "has_damage_defect", "has_missing_parts", "has_delivery_issue",
    "has_quality_issue", "has_wrong_item", "issue_hint_keywords", "complaint_type_candidate",
    "is_low_rating_review", "source_file", "load_ts",
]
ROWS_PER_TASK = 1_000_000
COUNTERS = 20_000


def _summaries(counters: int):
    """Frequent keys of a task (Misra and Gries): at most ``counters``, each undercounted by no more than ``lost``."""

    def cut(held: dict, keep: int) -> int:
        """Take the (keep + 1)-th largest count from all, so that no more than ``keep`` are left."""
        if len(held) <= keep:
            return 0
        off = sorted(held.values(), reverse=True)[keep]
        for key in [key for key, n in held.items() if n <= off]:
            del held[key]
        for key in held:
            held[key] -= off
        return off

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, lost, rows = {}, 0, 0
        for batch in batches:
            rows += batch.num_rows
            for key, n in zip(*(c.to_pylist() for c in pc.value_counts(batch.column(0)).flatten())):
                held[key] = held.get(key, 0) + n
            if len(held) > 2 * counters:
                lost += cut(held, counters)
        lost += cut(held, counters)
        keys, kind = list(held), batch.schema.field(0).type if rows else pa.string()
        columns = [pa.array([*keys, None], kind), pa.array([*held.values(), 0], pa.int64()), pa.array([0] * len(keys) + [lost], pa.int64())]
        if rows:
            yield pa.RecordBatch.from_arrays(columns, names=["key", "n", "lost"])

    return run


def heavy_hitters(df: DataFrame, key: str, more_than: int, counters: int = COUNTERS) -> DataFrame:
    """(key, n) of every key that more than ``more_than`` rows hold, with exact counts, staged; null is no key.

    A task sums its keys up in ``counters`` counters, and only those are shuffled. A key's merged count falls short of
    the truth by no more than the tasks' losses together, so what can't be excluded by that is counted once
    more, exactly. If rows / ``counters`` is above ``more_than``, losses exclude nothing, and all keys are counted.
    """
    keys = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"))
    kind = keys.schema["key"].dataType.simpleString()
    found = stage(keys.mapInArrow(_summaries(counters), f"key {kind}, n long, lost long"), "frequent-keys")
    lost = found.agg(F.sum("lost")).first()[0] or 0
    if lost >= more_than:
        counted = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        return stage(counted.where(F.col("n") > more_than), "heavy-hitters")
    merged = found.where("key IS NOT NULL").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") + lost > more_than)
    if not lost:
        return stage(merged, "heavy-hitters")
    suspects = stage(merged.select("key"), "suspects")  # each has more than more_than - lost rows: a bounded number
    counted = keys.join(F.broadcast(suspects), "key").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return stage(counted.where(F.col("n") > more_than), "heavy-hitters")


def hot_keys(df: DataFrame, key: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(key, salts) of every key with more rows than one task should hold, staged.

    One column is scanned; see :func:`heavy_hitters`. ``salts`` is the number of tasks the key's rows need. No more
    keys than rows / ``rows_per_task`` can qualify, so the result is as small as a list of the tasks. Count the rows
    that are joined, or a superset of them: then keys only get more salts than they need.
    """
    found = heavy_hitters(df, key, rows_per_task)
    return found.select(F.col("key").alias(key), F.ceil(F.col("n") / rows_per_task).cast("int").alias("salts"))


def salted_left_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Left join that spreads the rows of each hot key over as many partitions as they need.

    ``hot`` comes from :func:`hot_keys`: one row per key that fills a task of its own or more, a
    bounded size that may be broadcast. Rows are dealt out by position, which also splits full copies.
    """
    marks = F.broadcast(hot.select(key, F.col("salts").alias("_salts")))
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("_salts", F.lit(1))).cast("int")
    dealt = left.join(marks, key, "left").withColumn("_salt", place).drop("_salts")
    every = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    copied = right.join(marks, key, "left").withColumn("_salt", F.explode(every)).drop("_salts")
    return dealt.join(copied, [key, "_salt"], "left").drop("_salt")


def enrich_reviews(reviews: DataFrame, meta: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Every review with its product's columns; ``meta`` has one row per product.

    Spark broadcasts ``meta`` if its measured size allows; otherwise both sides
    shuffle on the product, and ``hot`` (see :func:`hot_keys`) keeps products
    with very many reviews from ending up in one task.
    """
    products = meta.select("asin", *PRODUCT_COLUMNS)
    kept = reviews.select(*ENRICHED_REVIEW_COLUMNS)
    if hot is None:
        joined = kept.join(products, "asin", "left")
    else:
        joined = salted_left_join(kept, products, "asin", hot)
    return joined.select(*ENRICHED_REVIEW_COLUMNS, *PRODUCT_COLUMNS)


def product_health_daily(reviews: DataFrame, meta: DataFrame) -> DataFrame:
    """Review counts and rates per day, product and complaint type.

    Brand depends on the product alone and the week and month on the day alone,
    so reviews are counted before the join: what meets the product table is one
    row per day, product and type, whatever the number of reviews of a product.
    """
    per_day = reviews.groupBy("review_date", "category", "asin", "complaint_type_candidate").agg(
        F.count(F.lit(1)).alias("review_count"),
        F.sum("negative_flag").alias("negative_reviews"),
        F.sum("neutral_flag").alias("neutral_reviews"),
        F.sum("positive_flag").alias("positive_reviews"),
        F.avg("overall").alias("avg_rating"),
    )
    rate = lambda n: F.round(F.col(n) / F.col("review_count"), 6)
    return per_day.join(meta.select("asin", "brand"), "asin", "left").select(
        "review_date",
        week_start(F.col("review_date")).alias("week_bucket"),
        month_start(F.col("review_date")).alias("month_bucket"),
        "category",
        "brand",
        "asin",
        "complaint_type_candidate",
        "review_count",
        "negative_reviews",
        "neutral_reviews",
        "positive_reviews",
        rate("negative_reviews").alias("negative_rate"),
        rate("positive_reviews").alias("positive_rate"),
        "avg_rating",
    )
