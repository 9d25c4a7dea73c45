"""Reviews to scored complaints: candidates, gates, signals, cut."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quibble.functions import rules
from quibble.functions.text import flag
from quibble.operators.clean import with_lowered_text
from quibble.operators.enrich import ENRICHED_REVIEW_COLUMNS, PRODUCT_COLUMNS

MIN_SIGNAL_SCORE = 3

# Column order of the complaint table.
GATE_COLUMNS = [
    "operational_complaint_flag", "metadata_domain_match_flag", "narrative_content_noise_flag",
]
SIGNAL_COLUMNS = ["severity_signal", "verified_signal", "community_signal", "detail_signal"]
COMPLAINT_COLUMNS = (
    ENRICHED_REVIEW_COLUMNS[:25]
    + ["complaint_subtype", "is_low_rating_review"]
    + PRODUCT_COLUMNS
    + GATE_COLUMNS
    + SIGNAL_COLUMNS
    + ["signal_score", "source_file", "load_ts"]
)


def complaint_candidates(reviews: DataFrame) -> DataFrame:
    """Low-rated reviews of the two categories that name some complaint.

    Uses review columns only, so apply it before the product join: a few
    percent of the reviews are left to shuffle.
    """
    return reviews.filter(
        F.col("category").isin(*rules.COMPLAINT_CATEGORIES)
        & (F.col("overall") <= 3)
        & (F.col("complaint_type_candidate") != "other")
    )


def gate_candidates(enriched: DataFrame, narrative_match: str = "search") -> DataFrame:
    """Adds the three gate flags and the complaint subtype."""
    c = F.col
    lowered = with_lowered_text(enriched, "review_text_clean", "_lc")
    gates = {
        "operational_complaint_flag": rules.type_agrees_with_flag("complaint_type_candidate"),
        "metadata_domain_match_flag": rules.domain_match(
            "category", "root_category", "category_path", "main_cat", "sub_category"
        ),
        "narrative_content_noise_flag": rules.narrative_noise("_lc", narrative_match),
        "complaint_subtype": rules.subtype("complaint_type_candidate", "_lc"),
    }
    return lowered.withColumns(gates).drop("_lc")


def high_confidence(gated: DataFrame) -> DataFrame:
    return gated.filter(
        (F.col("metadata_domain_match_flag") == 1)
        & (F.col("operational_complaint_flag") == 1)
        & (F.col("narrative_content_noise_flag") == 0)
    )


def category_medians(confident: DataFrame) -> DataFrame:
    """Exact interpolated median review length per category.

    Lengths are counted first, which combines map-side; the median then runs
    over one row per distinct length instead of over all reviews.
    """
    counted = confident.groupBy("category", "review_length").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("category").agg(
        F.percentile("review_length", 0.5, F.col("n")).alias("median_review_length")
    )


def score_complaints(confident: DataFrame, medians: DataFrame) -> DataFrame:
    """Four 0/1 signals and their sum. ``medians`` has one row per accepted category,
    which is why it may be broadcast."""
    c = F.col
    few = F.broadcast(medians.filter(c("category").isin(*rules.COMPLAINT_CATEGORIES)))
    signals = {
        "severity_signal": flag(c("overall") <= 2),
        "verified_signal": flag(c("verified_flag") == 1),
        "community_signal": flag(c("vote_count") >= 1),
        "detail_signal": flag(c("review_length") >= c("median_review_length")),
    }
    total = sum((c(s) for s in SIGNAL_COLUMNS[1:]), c(SIGNAL_COLUMNS[0]))
    return confident.join(few, "category").withColumns(signals).withColumn("signal_score", total)


def strong_complaints(scored: DataFrame, cut: int = MIN_SIGNAL_SCORE) -> DataFrame:
    return scored.filter(F.col("signal_score") >= cut)
