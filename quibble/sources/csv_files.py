"""CSV with a header and quoted line breaks, as the evaluation files use it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true", "encoding": "UTF-8"}


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.options(**_OPTIONS).schema(schema).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    options = {k: v for k, v in _OPTIONS.items() if k != "multiLine"}
    df.write.mode(mode).options(**options).option("ignoreLeadingWhiteSpace", "false").option(
        "ignoreTrailingWhiteSpace", "false"
    ).csv(path)
