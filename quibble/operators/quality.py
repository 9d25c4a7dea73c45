"""Data-quality rules, their result table, and the gate before publishing."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quibble.functions.rules import COMPLAINT_TYPES

# The rules of each table.
NOT_NULL: dict[str, list[str]] = {
    "clean_reviews": [
        "asin", "category", "ingest_dt", "review_text_clean", "review_length", "review_date",
        "positive_flag", "neutral_flag", "negative_flag", "complaint_type_candidate",
        "is_low_rating_review",
    ],
    "clean_meta": ["asin", "category", "ingest_dt"],
    "review_enriched": ["asin", "category", "review_text_clean", "review_date", "complaint_type_candidate"],
    "product_health_daily": ["asin", "review_date", "category", "complaint_type_candidate"],
    "review_enriched_complaints": [
        "asin", "category", "review_text_clean", "review_date", "complaint_type_candidate", "signal_score",
    ],
    "review_documents": [
        "doc_id", "asin", "category", "complaint_type", "review_date", "review_text", "retrieval_text",
        "signal_score",
    ],
}
UNIQUE: dict[str, list[str]] = {"clean_meta": ["asin"], "review_documents": ["doc_id"]}
ACCEPTED: dict[str, dict[str, list[str]]] = {"review_documents": {"complaint_type": COMPLAINT_TYPES}}


class QualityError(RuntimeError):
    """A quality rule failed; nothing was published."""


def _as_rows(counts: DataFrame, rule: str, columns: Iterable[str]) -> DataFrame:
    """One-row frame of failure counts to one row per column."""
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("failures")) for c in columns])
    return counts.select(F.lit(rule).alias("rule"), F.inline(rows))


def not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a null per column, all columns in one pass."""
    return _as_rows(df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]), "not_null", columns)


def accepted_values(df: DataFrame, allowed: Mapping[str, list]) -> DataFrame:
    """Rows with a value outside the list per column; null passes."""
    counts = df.agg(*[F.count_if(~F.col(c).isin(*v)).alias(c) for c, v in allowed.items()])
    return _as_rows(counts, "accepted_values", allowed)


def unique(df: DataFrame, columns: list[str]) -> DataFrame:
    """Values that occur more than once per column; null passes."""
    out = None
    for c in columns:
        repeated = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        one = _as_rows(repeated.agg(F.count(F.lit(1)).alias(c)), "unique", [c])
        out = one if out is None else out.unionByName(one)
    return out


def check_table(
    df: DataFrame,
    table: str,
    not_null_columns: list[str] = (),
    unique_columns: list[str] = (),
    accepted: Mapping[str, list] | None = None,
) -> DataFrame:
    """Result rows ``table_name, rule, column_name, failures`` of one table."""
    parts = []
    if not_null_columns:
        parts.append(not_null(df, list(not_null_columns)))
    if unique_columns:
        parts.append(unique(df, list(unique_columns)))
    if accepted:
        parts.append(accepted_values(df, accepted))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.lit(table).alias("table_name"), "rule", "column_name", "failures")


def check_layers(layers: Mapping[str, DataFrame]) -> DataFrame:
    """All rules of the given tables."""
    out = None
    for table, df in layers.items():
        one = check_table(df, table, NOT_NULL.get(table, []), UNIQUE.get(table, []), ACCEPTED.get(table))
        out = one if out is None else out.unionByName(one)
    return out


def require_quality(results: DataFrame) -> None:
    """Raises if any rule failed. The result table has one row per rule."""
    failed = results.filter(F.col("failures") > 0).orderBy("table_name", "rule", "column_name").collect()
    if failed:
        raise QualityError(
            "; ".join(f"{r.table_name}.{r.column_name} {r.rule}: {r.failures}" for r in failed)
        )
