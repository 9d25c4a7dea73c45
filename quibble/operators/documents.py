"""One retrieval document per strong complaint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quibble.operators.numbering import number_rows

# Column order of the document table, labels of the retrieval text.
DOCUMENT_COLUMNS = [
    "doc_id", "asin", "reviewer_id", "category", "review_date", "week_bucket", "month_bucket",
    "brand", "title", "complaint_type", "complaint_subtype", "signal_score", "summary",
    "review_text", "retrieval_text",
]
RETRIEVAL_LABELS = [
    ("Product:", "title"),
    ("Brand:", "brand"),
    ("Category:", "category"),
    ("Complaint Type:", "complaint_type"),
    ("Complaint Subtype:", "complaint_subtype"),
    ("Summary:", "summary"),
    ("Review:", "review_text"),
]


def retrieval_text() -> Column:
    parts = []
    for label, name in RETRIEVAL_LABELS:
        parts += [F.lit(label), F.coalesce(F.col(name), F.lit(""))]
    return F.concat_ws(" ", *parts)


def _described(complaints: DataFrame, *extra: str) -> DataFrame:
    source = {"complaint_type": "complaint_type_candidate", "review_text": "review_text_clean"}
    kept = [n for n in DOCUMENT_COLUMNS if n not in ("doc_id", "retrieval_text")]
    return complaints.select(*[F.col(source[n]).alias(n) if n in source else n for n in kept], *extra)


def unnumbered_documents(complaints: DataFrame) -> DataFrame:
    """All document columns but the id. Dashboards need no ids, so they need no sort."""
    return _described(complaints).withColumn("retrieval_text", retrieval_text())


def review_documents(complaints: DataFrame, row_key: str | None = None) -> DataFrame:
    """Documents with ids 1..n by date, product and reviewer.

    ``row_key`` names a column that tells all rows apart (see ``stage``); it is
    the last sort key, so copies of one review spread over partitions. The
    retrieval text repeats other columns and is added after the sort.
    """
    extra = [row_key] if row_key else []
    order = [F.col(c).asc_nulls_last() for c in ("review_date", "asin", "reviewer_id")]
    order.append(F.xxhash64("summary", "review_text", "complaint_type", "title"))
    order += [F.col(c) for c in extra]
    numbered = number_rows(_described(complaints, *extra), order, "doc_id")
    return numbered.withColumn("retrieval_text", retrieval_text()).select(*DOCUMENT_COLUMNS)
