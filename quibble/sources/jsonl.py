"""JSON lines to normalised landing rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quibble.functions.text import currency_amount, to_double
from quibble.sources.schemas import META_JSON_FIELDS, REVIEW_JSON_FIELDS


def read_json_lines(spark: SparkSession, path: str, fields: list[str], tasks: int | None = None) -> DataFrame:
    """All JSON lines below ``path`` (gzip or plain), every field as text.

    Blank and unparsable lines are skipped, bytes that are no UTF-8 ignored. A
    gzip file is read by one task: with ``tasks`` its lines are spread before
    they are parsed.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    if tasks is not None:
        lines = lines.repartition(tasks)
    line = F.col("value")
    text = F.when(F.is_valid_utf8(line), line).otherwise(
        F.replace(F.make_valid_utf8(line), F.lit("�"), F.lit(""))
    )
    schema = ", ".join(f"`{f}` string" for f in [*fields, "_corrupt"])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = lines.filter(F.trim("value") != "").select(F.from_json(text, schema, options).alias("r"))
    return parsed.filter(F.col("r").isNotNull() & F.col("r._corrupt").isNull()).select(
        *[F.col(f"r.{f}").alias(f) for f in fields]
    )


def _with_lineage(df: DataFrame, category: str, ingest_dt: str) -> DataFrame:
    return df.withColumns({"category": F.lit(category), "ingest_dt": F.lit(ingest_dt).cast("date")})


def normalize_reviews(records: DataFrame, category: str, ingest_dt: str) -> DataFrame:
    """Review records with a product id; only the rating changes type."""
    kept = records.filter(F.col("asin") != "").select(*REVIEW_JSON_FIELDS)
    return _with_lineage(kept.withColumn("overall", to_double(F.col("overall"))), category, ingest_dt)


def normalize_meta(records: DataFrame, category: str, ingest_dt: str) -> DataFrame:
    """Product records with an id; the price as amount, the category list as JSON text."""
    kept = records.filter(F.col("asin") != "").select(
        "asin",
        "title",
        "brand",
        currency_amount(F.col("price")).alias("price"),
        "main_cat",
        F.col("category").alias("category_list"),
    )
    return _with_lineage(kept, category, ingest_dt)


def read_reviews(spark: SparkSession, path: str, category: str, ingest_dt: str, tasks: int | None = None) -> DataFrame:
    return normalize_reviews(read_json_lines(spark, path, REVIEW_JSON_FIELDS, tasks), category, ingest_dt)


def read_meta(spark: SparkSession, path: str, category: str, ingest_dt: str, tasks: int | None = None) -> DataFrame:
    return normalize_meta(read_json_lines(spark, path, META_JSON_FIELDS, tasks), category, ingest_dt)
