"""Schemas of the raw layer. Column names and types."""

from __future__ import annotations

REVIEW_JSON_FIELDS = [
    "asin", "reviewerID", "reviewerName", "overall", "summary", "reviewText", "unixReviewTime",
    "reviewTime", "verified", "vote",
]
META_JSON_FIELDS = ["asin", "title", "brand", "price", "main_cat", "category"]

REVIEWS_LANDING = (
    "asin string, reviewerID string, reviewerName string, overall double, summary string, "
    "reviewText string, unixReviewTime string, reviewTime string, verified string, vote string, "
    "category string, ingest_dt date"
)
META_LANDING = (
    "asin string, title string, brand string, price double, main_cat string, category_list string, "
    "category string, ingest_dt date"
)
LINEAGE = "source_file string, load_ts timestamp_ntz"
REVIEWS_RAW = f"{REVIEWS_LANDING}, {LINEAGE}"
META_RAW = f"{META_LANDING}, {LINEAGE}"
LOAD_AUDIT = (
    "run_ts timestamp_ntz, target_table string, files_loaded bigint, rows_loaded bigint, first_error string"
)
PARTITION_COLUMNS = ["category", "ingest_dt"]
