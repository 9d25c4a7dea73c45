"""Incremental loads by content: a ledger of (file, bytes, MD5) decides what a load has to do.

A load sets the files that are there against the ledger. New files are loaded, whatever their
dates; a file whose content changed replaces the rows it gave before; the rows of a file that is gone
go. Without a difference nothing is written. A file that can't be read is entered with its error,
and tried again once its content changes.

Rows lie below ``rows/load_no=<n>``, the ledger's versions below ``ledger``. A ledger row says which
load holds a file's rows; a file that was replaced or removed leaves a row (file, load) that is dead.
Readers take one version of the ledger: they read the loads it names and leave out the dead files'
rows, so a load in progress, failed or replayed shows nothing until its ledger is published. Loads
with dead rows are rewritten by ``compact``.

Whether a file differs is seen by size and modification time, and then by MD5; ``verify`` reads
the MD5 of every file. Only names, sizes and errors of files pass the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quibble.sources.landing import list_files, read_files, with_checksums
from quibble.sources.schemas import LINEAGE, PARTITION_COLUMNS
from quibble.sources.staging import stage
from quibble.sources.versions import Versions, delete, folders
from quibble.streaming.loader import HISTORY

LEDGER = (
    "source_file string, path string, bytes bigint, modified timestamp, md5_hex string, load_no int, "
    "error string, live boolean"
)
#: A folder is replaced as a whole, whatever the session says.
WHOLE = ("partitionOverwriteMode", "static")


def file_key(path: Column) -> Column:
    """A file's name in the ledger and in the rows' lineage: URI-encoded, one form of the scheme."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def _ledger(spark: SparkSession, root: str) -> Versions:
    return Versions(spark, f"{root}/ledger")


def file_changes(now: DataFrame, known: DataFrame) -> DataFrame:
    """Full outer join of two manifests (source_file, bytes, modified, md5_hex): what happened to each file.

    ``change`` is ``added``, ``removed``, ``changed`` (other content), ``touched`` (same content, other date) or null.
    """
    a, b = now.alias("a"), known.alias("b")
    same = F.col("a.md5_hex").eqNullSafe(F.col("b.md5_hex")) & (F.col("a.bytes") == F.col("b.bytes"))
    change = (
        F.when(F.col("b.source_file").isNull(), "added").when(F.col("a.source_file").isNull(), "removed")
        .when(~same, "changed").when(F.col("a.modified") != F.col("b.modified"), "touched")
    )
    return a.join(b, "source_file", "full").select(
        "source_file", F.coalesce("a.path", "b.path").alias("path"), F.coalesce("a.bytes", "b.bytes").alias("bytes"),
        F.coalesce("a.modified", "b.modified").alias("modified"), F.coalesce("a.md5_hex", "b.md5_hex").alias("md5_hex"),
        F.col("b.load_no").alias("load_no"), F.col("b.error").alias("error"), change.alias("change"),
    )


def _manifest(spark: SparkSession, landing: str, known: DataFrame, verify: bool) -> DataFrame:
    """(source_file, path, bytes, modified, md5_hex) of the files there are; files that look as before keep their MD5."""
    files = list_files(spark, landing, "*.parquet").withColumn("source_file", file_key(F.col("uri"))).drop("uri")
    before = known.select("source_file", F.col("bytes").alias("_bytes"), F.col("modified").alias("_modified"), "md5_hex")
    seen = files.join(before, "source_file", "left")
    alike = (F.col("bytes") == F.col("_bytes")) & (F.col("modified") == F.col("_modified"))
    trusted = F.lit(False) if verify else F.coalesce(alike, F.lit(False))
    columns = ["source_file", "path", "bytes", "modified"]
    unread = seen.where(~trusted).select(*columns)
    return seen.where(trusted).select(*columns, "md5_hex").unionByName(with_checksums(unread))


def load_changes(
    spark: SparkSession,
    landing: str,
    schema: str,
    root: str,
    target_table: str,
    partition_by: list[str] | None = None,
    verify: bool = False,
) -> int:
    """Bring the table below ``root`` up to date with the files below ``landing``; returns the ledger's version."""
    ledger = _ledger(spark, root)
    version = ledger.current()
    known = ledger.read(version, LEDGER)
    live = known.where("live").drop("live")
    changes = stage(file_changes(_manifest(spark, landing, live, verify), live), "file-changes")
    if changes.where("change IS NOT NULL").isEmpty():
        return version
    number = version + 1
    fresh = changes.where("change IN ('added', 'changed')")
    rows, errors = read_files(spark, fresh.select("path"), landing, schema)
    rows = rows.withColumn("source_file", file_key(F.col("source_file")))
    at = f"{root}/rows/load_no={number}"
    writer = rows.write.mode("overwrite").option(*WHOLE)  # a load that failed before is written anew
    writer.partitionBy(*(PARTITION_COLUMNS if partition_by is None else partition_by)).parquet(at)
    _write_history(spark, changes, at, errors, root, number, target_table)
    loaded = fresh.drop("error").join(errors, "path", "left").withColumn("load_no", F.lit(number))
    kept = changes.where("change IS NULL OR change = 'touched'")
    gone = changes.where("change IN ('changed', 'removed')")
    names = [c.split()[0] for c in LEDGER.split(", ")][:-1]
    entries = [(known.where("NOT live"), False), (gone, False), (kept, True), (loaded, True)]
    new = [df.select(*names, F.lit(state).alias("live")) for df, state in entries]
    return ledger.publish(new[0].unionByName(new[1]).unionByName(new[2]).unionByName(new[3]))


def _read_load(spark: SparkSession, at: str, schema: str) -> DataFrame:
    inner = spark.read.schema(schema).option("recursiveFileLookup", "true")
    return inner.parquet(at)


def _write_history(spark, changes, at, errors, root, number, target_table) -> None:
    """What the load did to each file, counted from the rows that were written."""
    counted = _read_load(spark, at, LINEAGE).groupBy("source_file").agg(F.count(F.lit(1)).alias("row_count"))
    touched = changes.where("change IN ('added', 'changed', 'removed')").drop("error")
    known = touched.join(counted, "source_file", "left").join(errors, "path", "left")
    history = known.select(
        F.lit(target_table).alias("target_table"), "source_file", F.coalesce("row_count", F.lit(0)).alias("row_count"),
        F.current_timestamp().cast("timestamp_ntz").alias("load_ts"), F.col("error").alias("first_error"), "change",
    )
    history.coalesce(1).write.mode("overwrite").parquet(f"{root}/history/load_no={number}")


def history(spark: SparkSession, root: str) -> DataFrame:
    """(target_table, source_file, row_count, load_ts, first_error, change, load_no) of every published load."""
    version = _ledger(spark, root).current()
    schema = f"{HISTORY}, change string, load_no int"
    if not version:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/history").where(F.col("load_no") <= version)


def current_rows(spark: SparkSession, root: str, schema: str, version: int | None = None) -> DataFrame:
    """The table's rows with lineage, as of a version of the ledger (by default the newest)."""
    ledger = _ledger(spark, root)
    files = ledger.read(ledger.current() if version is None else version, LEDGER)
    loads = [r.load_no for r in files.where("live").select("load_no").distinct().collect()]  # one number per load
    columns = f"{schema}, {LINEAGE}"
    if not loads:
        return spark.createDataFrame([], columns)
    rows = spark.read.schema(f"{columns}, load_no int").parquet(f"{root}/rows").where(F.col("load_no").isin(loads))
    dead = files.where("NOT live").select("source_file", "load_no")
    names = [f.name for f in spark.createDataFrame([], columns).schema]
    return rows.join(dead, ["source_file", "load_no"], "left_anti").select(*[f"`{n}`" for n in names])


def compact(spark: SparkSession, root: str, schema: str, partition_by: list[str] | None = None) -> int:
    """Write the rows of all loads that hold dead rows as one load without them; returns the ledger's version."""
    ledger = _ledger(spark, root)
    version = ledger.current()
    files = ledger.read(version, LEDGER)
    mixed = files.where("NOT live").select("load_no").distinct()
    if mixed.isEmpty():
        return version
    number = version + 1
    moved = stage(files.where("live").join(mixed, "load_no", "left_semi"), "moved-files")
    rows = current_rows(spark, root, schema, version).join(moved.select("source_file"), "source_file", "left_semi")
    columns = PARTITION_COLUMNS if partition_by is None else partition_by
    rows.write.mode("overwrite").option(*WHOLE).partitionBy(*columns).parquet(f"{root}/rows/load_no={number}")
    rest = files.where("live").join(mixed, "load_no", "left_anti")
    return ledger.publish(rest.unionByName(moved.withColumn("load_no", F.lit(number)).select(*rest.columns)).select(*files.columns))


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> None:
    """Forget all but the newest versions, and delete the loads that none of the kept ones names."""
    ledger = _ledger(spark, root)
    ledger.forget(keep)
    named = set()
    for version in ledger.published():
        named |= {r.load_no for r in ledger.read(version, LEDGER).where("live").select("load_no").distinct().collect()}
    newest = ledger.current()
    for folder in folders(spark, f"{root}/rows"):
        number = int(folder.removeprefix("load_no="))
        if number not in named and number <= newest:
            delete(spark, f"{root}/rows/{folder}")


def insert_audit(audit: DataFrame, table: str) -> None:
    """Append the audit row of a load to the catalog table of audits."""
    audit.select(*audit.sparkSession.table(table).columns).write.insertInto(table)
