"""Search results as evidence: previews, context texts, counts, summaries.

An evidence frame has ``query_id``, ``rank`` (from 1) and document columns.
Each query has at most its top-k rows, so per-query lists are bounded.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from types import MappingProxyType

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quibble.functions.answers import strip

# Preview columns, and the layouts of context texts as
# (block head, field format, separator of fields, separator of blocks, fields).
PREVIEW_COLUMNS = ["title", "category", "complaint_type", "complaint_subtype", "summary"]
_COMPLAINT_FIELDS = [
    ("Product", "title"),
    ("Brand", "brand"),
    ("Category", "category"),
    ("Complaint Type", "complaint_type"),
    ("Complaint Subtype", "complaint_subtype"),
    ("Summary", "summary"),
]
CONTEXT_LAYOUTS: dict[str, tuple[str, str, str, str, list[tuple[str, str]]]] = {
    "reasoning": ("Complaint %d:\n", "%s: %s\n", "", "\n", _COMPLAINT_FIELDS),
    "detailed": (
        "Complaint %d:\n", "%s: %s\n", "", "\n",
        _COMPLAINT_FIELDS + [("Signal Score", "signal_score"), ("Review Date", "review_date")],
    ),
    "sample": (
        "", "%s: %s", "\n", "\n\n",
        [
            ("doc_id", "doc_id"), ("title", "title"), ("brand", "brand"),
            ("complaint_type", "complaint_type"), ("subtype", "complaint_subtype"), ("summary", "summary"),
        ],
    ),
    "relevance": (
        "  Complaint %d: ", "%s=%s", ", ", "\n",
        [
            ("category", "category"), ("complaint_type", "complaint_type"), ("subtype", "complaint_subtype"),
            ("brand", "brand"), ("signal_score", "signal_score"), ("summary", "summary"),
        ],
    ),
    "faithfulness": (
        "  [%d] ", "%s=%s", " | ", "\n",
        [("complaint_type", "complaint_type"), ("subtype", "complaint_subtype"), ("summary", "summary")],
    ),
}
SUMMARY_CUT = 100
ANSWER_CUT = 800
SUMMARY_ITEMS = 10


def text_or_blank(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def evidence_preview(evidence: DataFrame) -> DataFrame:
    return evidence.select("query_id", "rank", *[text_or_blank(c).alias(c) for c in PREVIEW_COLUMNS])


def in_rank_order(value: Column, limit: int | None = None) -> Column:
    """Aggregate: the values of a query as a list ordered by rank."""
    ranked = F.array_sort(F.collect_list(F.struct(F.col("rank"), value.alias("v"))))
    if limit is not None:
        ranked = F.slice(ranked, 1, limit)
    return F.transform(ranked, lambda x: x["v"])


def _context(layout: str, limit: int | None, summary_cut: int | None) -> Column:
    head, field, between_fields, between_blocks, fields = CONTEXT_LAYOUTS[layout]
    values = {name: text_or_blank(name) for _, name in fields}
    if summary_cut is not None:
        values["summary"] = F.substring(values["summary"], 1, summary_cut)
    lines = [F.format_string(field, F.lit(label), values[name]) for label, name in fields]
    body = F.concat_ws(between_fields, *lines)
    block = F.concat(F.format_string(head, F.col("rank")), body) if head else body
    return F.array_join(in_rank_order(block, limit), between_blocks)


def evidence_context(
    evidence: DataFrame,
    layouts: Sequence[str] = ("reasoning",),
    limit: int | None = None,
    cuts: Mapping[str, int] = MappingProxyType({"faithfulness": SUMMARY_CUT}),
) -> DataFrame:
    """One row per query with a context text per layout: a labelled block per
    item in rank order. ``cuts`` shortens the summaries of a layout."""
    texts = [_context(layout, limit, cuts.get(layout)).alias(layout) for layout in layouts]
    return evidence.groupBy("query_id").agg(*texts)


def evidence_count(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("query_id").agg(F.count(F.lit(1)).alias("evidence_count"))


def dominant_type(evidence: DataFrame) -> DataFrame:
    """Most frequent complaint type per query, how often it occurs, and among how many."""
    per_type = evidence.groupBy("query_id", text_or_blank("complaint_type").alias("t")).agg(
        F.count(F.lit(1)).alias("n")
    )
    # Of equally frequent types the first by name.
    first = F.min(F.struct(-F.col("n"), F.col("t")))
    return per_type.groupBy("query_id").agg(first.alias("first"), F.sum("n").alias("evidence_count")).select(
        "query_id",
        F.col("first.t").alias("dominant_type"),
        (-F.col("first.col1")).alias("match_count"),
        "evidence_count",
    )


def evidence_summary(evidence: DataFrame, limit: int = SUMMARY_ITEMS) -> DataFrame:
    """``type(subtype)`` of the first items of each query, joined with ``; ``."""
    item = F.concat(text_or_blank("complaint_type"), F.lit("("), text_or_blank("complaint_subtype"), F.lit(")"))
    return evidence.groupBy("query_id").agg(F.array_join(in_rank_order(item, limit), "; ").alias("evidence_summary"))


def answer_excerpt(answer: Column, cut: int = ANSWER_CUT) -> Column:
    return F.substring(strip(answer), 1, cut)
