"""The layers chained: raw reviews and product records to published documents."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quibble.operators.clean import clean_meta, clean_reviews
from quibble.operators.complaints import (
    COMPLAINT_COLUMNS,
    category_medians,
    complaint_candidates,
    gate_candidates,
    high_confidence,
    score_complaints,
    strong_complaints,
)
from quibble.operators.documents import review_documents, unnumbered_documents
from quibble.operators.enrich import enrich_reviews, hot_keys, product_health_daily
from quibble.operators.quality import check_layers, require_quality
from quibble.sources.staging import stage
from quibble.sources.tables import save_model
from quibble.streaming.loader import refresh_index, with_document_key

ROW_KEY = "row_key"


def gated_candidates(
    reviews: DataFrame, meta: DataFrame, hot: DataFrame | None = None, narrative_match: str = "search"
) -> DataFrame:
    """Complaint candidates with product columns and gate flags. Candidates are
    picked before the join, so only they are shuffled."""
    return gate_candidates(enrich_reviews(complaint_candidates(reviews), meta, hot), narrative_match)


def confident_complaints(
    reviews: DataFrame, meta: DataFrame, hot: DataFrame | None = None, narrative_match: str = "search"
) -> DataFrame:
    """High-confidence complaints, staged with a row key: they are read twice
    (medians, scores) and are a small part of the reviews that cost most of the work."""
    return stage(high_confidence(gated_candidates(reviews, meta, hot, narrative_match)), "confident", ROW_KEY)


def scored_complaints(confident: DataFrame) -> DataFrame:
    return score_complaints(confident, category_medians(confident))


def complaint_layer(
    reviews: DataFrame, meta: DataFrame, hot: DataFrame | None = None, narrative_match: str = "search"
) -> DataFrame:
    """The complaint table's columns plus the row key."""
    scored = scored_complaints(confident_complaints(reviews, meta, hot, narrative_match))
    return strong_complaints(scored).select(*COMPLAINT_COLUMNS, ROW_KEY)


def document_layer(complaints: DataFrame) -> DataFrame:
    return review_documents(complaints, ROW_KEY)


def dashboard_layer(complaints: DataFrame) -> DataFrame:
    """Documents without ids, for reports that need none."""
    return unnumbered_documents(complaints)


def refresh_all(
    reviews_raw: DataFrame, meta_raw: DataFrame, index_table: str = "rag.document_index", narrative_match: str = "search"
) -> list[str]:
    """Full refresh: every layer saved and checked, then the index brought up to date.

    The layer tables are replaced first and checked then; the search index, which is what readers
    see, is left as it was unless all quality rules pass. It holds ``doc_key`` for ``doc_id``.
    ``narrative_match`` is passed on to the gates.
    """
    spark = reviews_raw.sparkSession
    saved: dict[str, DataFrame] = {}

    def save(model: str, df: DataFrame) -> DataFrame:
        saved[model] = spark.table(save_model(df, model))
        return saved[model]

    reviews = save("clean_reviews", clean_reviews(reviews_raw))
    meta = save("clean_meta", clean_meta(meta_raw))
    hot = hot_keys(reviews, "asin")
    save("review_enriched", enrich_reviews(reviews, meta, hot))
    save("product_health_daily", product_health_daily(reviews, meta))
    joined = hot_keys(complaint_candidates(reviews), "asin")  # a few percent of the reviews
    complaints = complaint_layer(reviews, meta, joined, narrative_match)
    save("review_documents", document_layer(complaints))
    save("review_enriched_complaints", complaints.drop(ROW_KEY))
    return refresh_index(
        with_document_key(saved["review_documents"]), index_table, lambda: require_quality(check_layers(saved))
    )
