"""Loads of a folder that files are only added to, their audit, and the refresh of the published table.

The file source's checkpoint is the ledger of loaded files, by name and whatever their dates; for folders
whose files change or go see :mod:`quibble.streaming.ledger`. Each batch writes its own
``batch_id`` partition of the table and of the history, so a batch that is replayed after a failure
replaces its rows instead of adding them again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quibble.sources.landing import path_exists, read_files
from quibble.sources.schemas import LINEAGE, PARTITION_COLUMNS
from quibble.sources.staging import stage
from quibble.sources.tables import overwrite_partitions

AUDIT_WINDOW_MINUTES = 240
HISTORY = "target_table string, source_file string, row_count bigint, load_ts timestamp_ntz, first_error string"


def _write_batch(df: DataFrame, batch_id: int, path: str, partition_by: list[str]) -> None:
    writer = df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy("batch_id", *partition_by).parquet(path)


def load_new_files(
    spark: SparkSession,
    landing: str,
    schema: str,
    table_path: str,
    history_path: str,
    checkpoint: str,
    target_table: str,
    partition_by: list[str] | None = None,
    files_per_batch: int | None = None,
) -> None:
    """Load every file that was not loaded yet, then stop. Without new files nothing runs.

    A file that can't be read is recorded in the history with its error and stops nothing.
    """
    # The stream carries file names alone; contents are read per batch, each file with its own types.
    listed = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.format("binaryFile").schema(listed).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    reader = reader.option("maxFileAge", "36500d")  # the default leaves out files a week older than the newest
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    columns = PARTITION_COLUMNS if partition_by is None else partition_by

    def load(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        rows, errors = read_files(own, batch.select("path"), landing, schema)
        _write_batch(rows, batch_id, table_path, columns)
        # Counted from what was written: the source files are read once.
        written = f"{table_path}/batch_id={batch_id}"
        if path_exists(own, written):
            loaded = own.read.schema(LINEAGE).option("recursiveFileLookup", "true").parquet(written)
        else:  # no readable row in the batch
            loaded = own.createDataFrame([], LINEAGE)
        history = loaded.groupBy("source_file").agg(
            F.count(F.lit(1)).alias("row_count"), F.max("load_ts").alias("load_ts")
        )
        history = history.select(
            F.lit(target_table).alias("target_table"),
            "source_file",
            "row_count",
            "load_ts",
            F.lit(None).cast("string").alias("first_error"),
        )
        failed = errors.select(
            F.lit(target_table).alias("target_table"),
            F.col("path").alias("source_file"),
            F.lit(0).cast("bigint").alias("row_count"),
            F.current_timestamp().cast("timestamp_ntz").alias("load_ts"),
            F.col("error").alias("first_error"),
        )
        _write_batch(history.unionByName(failed), batch_id, history_path, [])

    query = (
        reader.load(landing)
        .select("path")
        .writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def load_audit(
    history: DataFrame, target_table: str, run_ts: Column, minutes: int = AUDIT_WINDOW_MINUTES
) -> DataFrame:
    """Files, rows and first error of the loads within ``minutes`` of the run."""
    stamp = run_ts.cast("timestamp_ntz")
    window = F.expr(f"INTERVAL {int(minutes)} MINUTE")
    near = history.filter(
        (F.col("target_table") == target_table) & F.col("load_ts").between(stamp - window, stamp + window)
    )
    return near.agg(
        F.countDistinct("source_file").alias("files_loaded"),
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("rows_loaded"),
        F.min("first_error").alias("first_error"),
    ).select(
        stamp.alias("run_ts"), F.lit(target_table).alias("target_table"), "files_loaded", "rows_loaded", "first_error"
    )


def _fingerprints(docs: DataFrame) -> DataFrame:
    """Row count and two order-free sums of row hashes of each index partition; equal copies add up."""
    values = [c for c in sorted(docs.columns) if c != "index_month"]
    total = lambda *salt: F.sum(F.xxhash64(*salt, *values).cast("decimal(38,0)"))
    sums = F.struct(total(), total(F.lit("second")))
    return docs.groupBy("index_month").agg(F.count(F.lit(1)).alias("n"), sums.alias("h"))


COPY_PARTS = 64


def with_document_key(docs: DataFrame) -> DataFrame:
    """``doc_key`` in place of the dense ``doc_id``: 128 bits of the document's hash and its number among equal copies.

    A dense id moves whenever an earlier document arrives; the key stays, so the months that
    did not change need no rewrite. Copies are numbered without their texts, and a group of very
    many is dealt over ``COPY_PARTS`` tasks whose counts give each its first number.
    """
    values = [c for c in docs.columns if c != "doc_id"]
    hashed = F.concat(F.hex(F.xxhash64(*values)), F.hex(F.xxhash64(F.lit("second"), *values)))
    rows = stage(docs.select(*values, hashed.alias("_hash")), "hashed-documents", "_row")
    small = rows.select("_row", "_hash", F.pmod(F.xxhash64("_row"), F.lit(COPY_PARTS)).alias("_part"))
    counts = small.groupBy("_hash", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_hash").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("_hash", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    own = F.row_number().over(Window.partitionBy("_hash", "_part").orderBy("_row"))
    numbered = small.withColumn("_own", own).join(first, ["_hash", "_part"]).withColumn("_copy", F.col("_first") + F.col("_own"))
    copies = stage(numbered.where("_copy > 1").select("_row", "_copy"), "document-copies")  # of most documents there is one
    key = F.concat_ws("-", "_hash", F.coalesce("_copy", F.lit(1)))
    return rows.join(copies, "_row", "left").select(key.alias("doc_key"), *values)


def refresh_index(docs: DataFrame, table: str, quality_gate: Callable[[], None]) -> list[str]:
    """Bring the published document table up to date, after the gate has passed.

    Only months whose documents changed are rewritten, months that vanished are
    dropped. Returns the months touched (a few hundred at most).
    """
    spark = docs.sparkSession
    quality_gate()
    fresh = docs.withColumn("index_month", F.coalesce(F.date_format("month_bucket", "yyyy-MM"), F.lit("undated")))
    if not spark.catalog.tableExists(table):
        fresh.write.partitionBy("index_month").saveAsTable(table)
        return [r.index_month for r in fresh.select("index_month").distinct().collect()]
    new, old = _fingerprints(fresh), _fingerprints(spark.table(table).select(*fresh.columns))
    differs = new.alias("a").join(old.alias("b"), "index_month", "full").filter(
        ~(F.col("a.n").eqNullSafe(F.col("b.n")) & F.col("a.h").eqNullSafe(F.col("b.h")))
    )
    changed = differs.select("index_month", F.col("a.n").isNull().alias("gone")).collect()
    rewritten = [r.index_month for r in changed if not r.gone]
    if rewritten:
        overwrite_partitions(fresh.filter(F.col("index_month").isin(rewritten)), table)
    for r in changed:
        if r.gone:
            spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (index_month = '{r.index_month}')")
    return [r.index_month for r in changed]
