"""The seven dashboard queries, one function each, over the document table.

``None`` or ``"Any"`` means no filter. Counts combine map-side; top-k reports
sort only their k rows per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quibble.functions.rules import COMPLAINT_TYPES
from quibble.functions.text import display_label, product_label, title_label, unescape_html

# Subtypes that say nothing.
EMPTY_SUBTYPES = ["", "other", "unknown"]


def _chosen(value: str | None) -> bool:
    return bool(value) and value != "Any"


def select_documents(docs: DataFrame, category: str | None = None, complaint_type: str | None = None) -> DataFrame:
    """Documents of a valid type, narrowed by the given choices."""
    out = docs.filter(F.col("complaint_type").isin(*COMPLAINT_TYPES))
    if _chosen(category):
        out = out.filter(F.lower("category") == category.lower())
    if _chosen(complaint_type):
        out = out.filter(F.lower("complaint_type") == complaint_type.lower())
    return out


def _count() -> Column:
    return F.count(F.lit(1)).alias("complaint_count")


def _top(df: DataFrame, limit: int | None, *ties: str) -> DataFrame:
    ordered = df.orderBy(F.col("complaint_count").desc(), *[F.col(t).asc_nulls_last() for t in ties])
    return ordered if limit is None else ordered.limit(limit)


def overview(docs: DataFrame, category: str | None = None, approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    return select_documents(docs, category).agg(
        F.count(F.lit(1)).alias("total_complaints"),
        distinct("brand").alias("total_brands"),
        distinct("asin").alias("total_products"),
        distinct(F.lower("category")).alias("total_categories"),
    )


def type_distribution(docs: DataFrame, category: str | None = None) -> DataFrame:
    return _top(select_documents(docs, category).groupBy("complaint_type").agg(_count()), None, "complaint_type")


def category_distribution(docs: DataFrame) -> DataFrame:
    return _top(select_documents(docs).groupBy("category").agg(_count()), None, "category")


def top_brands(docs: DataFrame, category: str | None = None, limit: int = 15) -> DataFrame:
    per_brand = select_documents(docs, category).groupBy("brand", "category").agg(
        _count(),
        F.countDistinct("asin").alias("products_affected"),
        F.round(F.avg("signal_score"), 2).alias("avg_signal_score"),
    )
    return _top(per_brand, limit, "brand", "category")


def subtype_distribution(
    docs: DataFrame, category: str | None = None, complaint_type: str | None = None, limit: int = 15
) -> DataFrame:
    telling = select_documents(docs, category, complaint_type).filter(
        F.col("complaint_subtype").isNotNull() & ~F.col("complaint_subtype").isin(*EMPTY_SUBTYPES)
    )
    return _top(telling.groupBy("complaint_subtype").agg(_count()), limit, "complaint_subtype")


def top_products(
    docs: DataFrame, category: str | None = None, complaint_type: str | None = None, limit: int = 10
) -> DataFrame:
    per_product = (
        select_documents(docs, category, complaint_type)
        .filter(F.col("title").isNotNull())
        .groupBy("title", "asin", "brand", "category")
        .agg(_count(), F.countDistinct("complaint_type").alias("complaint_types_count"))
    )
    return _top(per_product, limit, "asin", "title", "brand", "category").select(
        product_label(F.col("title")).alias("product"),
        "asin",
        "brand",
        "category",
        "complaint_count",
        "complaint_types_count",
    )


def _matches(name: str, text: str, literal: bool) -> Column:
    needle = text.strip().lower()
    column = F.lower(F.col(name))
    return column.contains(needle) if literal else column.like(f"%{needle}%")


def complaint_search(
    docs: DataFrame,
    category: str | None = None,
    brand: str = "",
    product: str = "",
    limit: int = 50,
    literal: bool = False,
) -> DataFrame:
    """Complaint groups whose brand and title contain the given texts, blind to case.
    ``%`` and ``_`` in them are wildcards unless ``literal``."""
    found = select_documents(docs, category).filter(F.col("title").isNotNull())
    if brand.strip():
        found = found.filter(_matches("brand", brand, literal))
    if product.strip():
        found = found.filter(_matches("title", product, literal))
    groups = found.groupBy("title", "asin", "brand", "complaint_type", "complaint_subtype").agg(
        _count(),
        F.round(F.avg("signal_score"), 2).alias("avg_signal_score"),
        F.min("review_date").alias("earliest_review"),
        F.max("review_date").alias("latest_review"),
    )
    return _top(groups, limit, "asin", "title", "brand", "complaint_type", "complaint_subtype").select(
        product_label(F.col("title")).alias("product"),
        "asin",
        "brand",
        "complaint_type",
        F.coalesce("complaint_subtype", F.lit("-")).alias("complaint_subtype"),
        "complaint_count",
        "avg_signal_score",
        "earliest_review",
        "latest_review",
    )


def search_breakdown(search: DataFrame) -> DataFrame:
    """Complaints per type over the rows a search returned."""
    per_type = search.groupBy("complaint_type").agg(F.sum("complaint_count").alias("complaint_count"))
    return _top(per_type, None, "complaint_type")


def monthly_trend(docs: DataFrame, category: str | None = None, complaint_type: str | None = None) -> DataFrame:
    chosen = select_documents(docs, category, complaint_type)
    return chosen.groupBy("month_bucket").agg(_count()).orderBy(F.col("month_bucket").asc_nulls_last())


def for_display(report: DataFrame) -> DataFrame:
    """Codes of a report as people read them: labels, title case, entities resolved."""
    shown = {
        "category": display_label,
        "complaint_type": display_label,
        "complaint_subtype": title_label,
        "product": unescape_html,
    }
    return report.withColumns({n: f(F.col(n)) for n, f in shown.items() if n in report.columns})
