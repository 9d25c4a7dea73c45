"""Verification queries over raw, clean and published tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHORT_TEXT = 30
ROWS_PER_FILE = 200_000


def _n(name: str):
    return F.count(F.lit(1)).alias(name)


def partition_sanity(raw: DataFrame) -> DataFrame:
    counts = raw.groupBy("category", "ingest_dt").agg(_n("cnt"))
    return counts.orderBy(F.col("ingest_dt").desc_nulls_first(), F.col("category").asc_nulls_last())


def null_keys(raw: DataFrame, key: str = "asin") -> DataFrame:
    return raw.agg(F.count_if(F.col(key).isNull()).alias(f"null_{key}"), _n("total"))


def rating_distribution(raw: DataFrame) -> DataFrame:
    return raw.groupBy("overall").agg(_n("cnt")).orderBy(F.col("overall").asc_nulls_last())


def join_coverage(reviews: DataFrame, meta: DataFrame, distinct_meta: bool = False) -> DataFrame:
    """How many reviews find product records.

    As a plain left join this counts joined rows, so ``total_reviews`` grows
    with repeated product records; ``distinct_meta`` counts each review once.
    Both sides are counted per product first, so what is joined is one row per
    product and no product's rows meet all its records.
    """
    r = reviews.groupBy("asin").agg(_n("r"))
    m = meta.filter(F.col("asin").isNotNull()).groupBy("asin").agg(_n("m"))
    matched = F.col("m").isNotNull()
    times = F.lit(1) if distinct_meta else F.coalesce("m", F.lit(1))
    return r.join(m, "asin", "left").agg(
        F.coalesce(F.sum(F.col("r") * times), F.lit(0)).alias("total_reviews"),
        F.count("asin").alias("distinct_review_asins"),
        F.count_if(matched).alias("distinct_meta_asins"),
        F.count_if(matched).alias("matched_review_asins"),
    )


def length_profile(raw: DataFrame, text: str = "reviewText") -> DataFrame:
    return raw.agg(
        F.count_if(F.col(text).isNull()).alias("null_text"),
        F.count_if(F.length(text) <= SHORT_TEXT).alias("short_text"),
        _n("total"),
    )


def oversized_sources(raw: DataFrame, rows: int = ROWS_PER_FILE, limit: int = 20) -> DataFrame:
    """Source files with more rows than a file should have, largest first."""
    counts = raw.groupBy("source_file").agg(_n("rows_in_table")).filter(F.col("rows_in_table") > rows)
    return counts.orderBy(F.col("rows_in_table").desc(), "source_file").limit(limit)


def layer_counts(layers: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table: its name and row count."""
    out = None
    for name, df in layers.items():
        one = df.agg(_n("cnt")).select(F.lit(name).alias("table_name"), "cnt")
        out = one if out is None else out.unionByName(one)
    return out


def _coverage():
    with_title = F.count_if(F.col("title").isNotNull())
    total = F.nullif(F.count(F.lit(1)), F.lit(0))
    return with_title, F.round(with_title / total, 4).alias("pct_with_meta")


def metadata_coverage(enriched: DataFrame) -> DataFrame:
    with_title, share = _coverage()
    return enriched.agg(_n("total_reviews"), with_title.alias("reviews_with_title"), share)


def coverage_by_category(enriched: DataFrame) -> DataFrame:
    _, share = _coverage()
    per = enriched.groupBy("category").agg(_n("reviews"), share)
    return per.orderBy(F.col("reviews").desc(), "category")


def dedup_check(meta: DataFrame) -> DataFrame:
    return meta.agg(_n("meta_rows"), F.countDistinct("asin").alias("distinct_asins"))


def rate_range_check(health: DataFrame) -> DataFrame:
    outside = ~F.col("positive_rate").between(0, 1) | ~F.col("negative_rate").between(0, 1)
    return health.agg(F.count_if(outside).alias("bad_rows"))


def blank_documents(docs: DataFrame) -> DataFrame:
    text = F.col("retrieval_text")
    return docs.agg(
        F.count_if(text.isNull()).alias("null_retrieval_text"),
        F.count_if(F.trim(text) == "").alias("blank_retrieval_text"),
    )


def newest_rows(raw: DataFrame, limit: int = 10, *ties: str) -> DataFrame:
    return raw.orderBy(F.col("load_ts").desc_nulls_first(), *ties).limit(limit)
