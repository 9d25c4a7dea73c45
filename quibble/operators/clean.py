"""Raw reviews and product records to clean ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quibble.functions import rules
from quibble.functions.dates import month_start, review_date, week_start
from quibble.functions.text import (
    blank_to_null,
    brand_case,
    clean_text,
    flag,
    pin,
    price_digits,
    to_double,
    verified_flag,
    vote_count,
)
from quibble.operators.latest import latest_per_key

MIN_REVIEW_LENGTH = 30

# Column order of the clean tables.
CLEAN_REVIEW_COLUMNS = [
    "asin", "reviewer_id", "reviewer_name", "overall", "summary", "review_text",
    "review_text_clean", "unix_review_time_str", "review_time_str", "review_date",
    "week_bucket", "month_bucket", "verified_str", "verified_flag", "vote_count", "category",
    "ingest_dt", "review_length", "positive_flag", "neutral_flag", "negative_flag",
    "has_damage_defect", "has_missing_parts", "has_delivery_issue", "has_quality_issue",
    "has_wrong_item", "has_seller_fulfillment_noise", "issue_hint_keywords",
    "complaint_type_candidate", "is_low_rating_review", "source_file", "load_ts",
]
CLEAN_META_COLUMNS = [
    "asin", "title", "brand", "price", "main_cat", "root_category", "sub_category",
    "leaf_category", "category_depth", "category_path", "category_list", "category",
    "ingest_dt", "source_file", "load_ts",
]


def with_issue_flags(df: DataFrame, text_lc: str) -> DataFrame:
    """Type flags, hint list and complaint type from a lower-cased text column.

    The flags are pinned: a filter on the complaint type would otherwise be pushed below
    them and test every phrase a second time.
    """
    flags = rules.type_flags(text_lc)
    pinned = pin(df, "_flags", F.struct(*[test.alias(name) for name, test in flags.items()]))
    flagged = pinned.withColumns({name: F.col(f"_flags.{name}") for name in flags}).drop("_flags")
    return flagged.withColumns(
        {
            "issue_hint_keywords": rules.type_hints(),
            "complaint_type_candidate": rules.type_by_precedence(),
        }
    )


def with_lowered_text(df: DataFrame, text: str, lowered: str) -> DataFrame:
    return pin(df, lowered, F.lower(F.col(text)))


def clean_reviews(raw: DataFrame, month_first_text: bool = False) -> DataFrame:
    """Trim, type, date, flag and gate raw reviews.

    Cheap gates run first, then the text is cleaned once, short texts go, the
    text is lower-cased once, seller noise goes, and only what is left is
    tested for the complaint phrases. No shuffle.
    """
    c = F.col
    overall = c("overall") if dict(raw.dtypes)["overall"] == "double" else to_double(c("overall"))
    trimmed = raw.select(
        blank_to_null(c("asin")).alias("asin"),
        blank_to_null(c("reviewerID")).alias("reviewer_id"),
        blank_to_null(c("reviewerName")).alias("reviewer_name"),
        overall.alias("overall"),
        blank_to_null(c("summary")).alias("summary"),
        blank_to_null(c("reviewText")).alias("review_text"),
        blank_to_null(c("unixReviewTime")).alias("unix_review_time_str"),
        blank_to_null(c("reviewTime")).alias("review_time_str"),
        blank_to_null(c("verified")).alias("verified_str"),
        vote_count(blank_to_null(c("vote"))).alias("vote_count"),
        blank_to_null(c("category")).alias("category"),
        "ingest_dt",
        "source_file",
        "load_ts",
    )
    keyed = trimmed.dropna(subset=["asin", "category", "ingest_dt", "overall", "review_text"])
    cleaned = (
        pin(keyed, "review_text_clean", clean_text(c("review_text")))
        .withColumn("review_length", F.length("review_text_clean"))
        .filter(c("review_length") > MIN_REVIEW_LENGTH)
    )
    product_only = with_lowered_text(cleaned, "review_text_clean", "_lc").filter(~rules.seller_noise("_lc"))
    dated = product_only.withColumn(
        "review_date", review_date(c("review_time_str"), c("unix_review_time_str"), month_first_text)
    )
    derived = {
        "week_bucket": week_start(c("review_date")),
        "month_bucket": month_start(c("review_date")),
        "verified_flag": verified_flag(c("verified_str")),
        "positive_flag": flag(c("overall") >= 4),
        "neutral_flag": flag(c("overall") == 3),
        "negative_flag": flag(c("overall") <= 2),
        "is_low_rating_review": flag(c("overall") <= 3),
        # Rows with the noise flag set were dropped above.
        "has_seller_fulfillment_noise": F.lit(0),
    }
    return with_issue_flags(dated, "_lc").select(
        *[derived[n].alias(n) if n in derived else n for n in CLEAN_REVIEW_COLUMNS]
    )


def clean_meta(raw: DataFrame, brand_after_punctuation: bool = False) -> DataFrame:
    """Newest record per product with its category list taken apart.

    The newest record is picked first, so lists of stale records are never parsed.
    """
    c = F.col
    price_type = dict(raw.dtypes)["price"]
    newest = latest_per_key(
        raw.filter(c("asin").isNotNull()),
        ["asin"],
        [c("ingest_dt").desc_nulls_first(), c("load_ts").desc_nulls_first()],
    )
    parsed = newest.select(
        "asin",
        blank_to_null(c("title")).alias("title"),
        brand_case(blank_to_null(c("brand")), brand_after_punctuation).alias("brand"),
        price_digits(c("price"), price_type).alias("price"),
        blank_to_null(c("main_cat")).alias("main_cat"),
        blank_to_null(c("category_list")).alias("category_list"),
        blank_to_null(c("category")).alias("category"),
        "ingest_dt",
        "source_file",
        "load_ts",
    ).withColumn("_path", F.from_json("category_list", "array<string>"))
    path = c("_path")
    return parsed.withColumns(
        {
            "root_category": F.get(path, F.lit(0)),
            "sub_category": F.trim(F.get(path, F.lit(1))),
            "leaf_category": F.get(path, F.size(path) - 1),
            "category_depth": F.size(path),
            "category_path": F.array_join(path, " > ", ""),
        }
    ).select(*CLEAN_META_COLUMNS)
