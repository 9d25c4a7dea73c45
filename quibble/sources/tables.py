"""Catalog tables of the raw and model layers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from quibble.sources.schemas import LOAD_AUDIT, META_RAW, PARTITION_COLUMNS, REVIEWS_RAW
from quibble.sources.staging import new_folder

# The layer each model table belongs to.
MODEL_LAYERS = {
    "clean_reviews": "clean",
    "clean_meta": "clean",
    "review_enriched": "curated",
    "product_health_daily": "curated",
    "review_enriched_complaints": "curated",
    "review_documents": "rag",
}


@contextmanager
def temporary_schema(spark: SparkSession, label: str) -> Iterator[str]:
    """A schema inside the run's folder that is dropped with its tables at the end."""
    name = f"{label}_{uuid.uuid4().hex}"
    spark.sql(f"CREATE SCHEMA {name} LOCATION '{new_folder(spark, name)}'")
    try:
        yield name
    finally:
        spark.sql(f"DROP SCHEMA {name} CASCADE")


def create_raw_tables(spark: SparkSession, schema: str = "raw", location: str | None = None) -> None:
    """Raw and audit tables, created once and never wiped."""
    at = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {schema}{at}")
    partitioned = f"PARTITIONED BY ({', '.join(PARTITION_COLUMNS)})"
    for name, columns, by in (
        ("reviews_raw", REVIEWS_RAW, partitioned),
        ("meta_raw", META_RAW, partitioned),
        ("load_audit", LOAD_AUDIT, ""),
    ):
        spark.sql(f"CREATE TABLE IF NOT EXISTS {schema}.{name} ({columns}) USING parquet {by}")


def append_rows(df: DataFrame, table: str) -> None:
    """Append by column name."""
    target = df.sparkSession.table(table)
    df.select(*target.columns).write.insertInto(table)


def _insert_overwrite(df: DataFrame, table: str, mode: str) -> None:
    """Catalog inserts take the overwrite mode from the session, not from the writer."""
    conf, key = df.sparkSession.conf, "spark.sql.sources.partitionOverwriteMode"
    before = conf.get(key)
    conf.set(key, mode)
    try:
        df.select(*df.sparkSession.table(table).columns).write.insertInto(table, overwrite=True)
    finally:
        conf.set(key, before)


def reload_table(df: DataFrame, table: str) -> None:
    """Forced full reload: the table then holds ``df`` and nothing else."""
    _insert_overwrite(df, table, "static")


def overwrite_partitions(df: DataFrame, table: str) -> None:
    """Replace the partitions ``df`` has rows for and leave all others."""
    _insert_overwrite(df, table, "dynamic")


def drop_category(spark: SparkSession, table: str, category: str) -> None:
    """Delete all rows of a category by dropping its partitions; no file is rewritten."""
    shown = spark.sql(f"SHOW PARTITIONS {table} PARTITION (category = '{category}')").collect()
    if shown:  # one partition per ingest date
        dates = [r.partition.rsplit("=", 1)[1] for r in shown]
        specs = ", ".join(f"PARTITION (category = '{category}', ingest_dt = '{d}')" for d in dates)
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {specs}")


def save_model(df: DataFrame, model: str, layer: str | None = None) -> str:
    """Full refresh of a model table in its layer; returns the table's name."""
    spark = df.sparkSession
    layer = layer or MODEL_LAYERS[model]
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {layer}")
    table = f"{layer}.{model}"
    df.write.mode("overwrite").saveAsTable(table)
    return table
