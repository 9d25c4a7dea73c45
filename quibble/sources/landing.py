"""Partitioned Parquet landing zone: writing, loading, ingest metrics, file manifest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fnmatch import fnmatch

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quibble.sources.schemas import LINEAGE, PARTITION_COLUMNS
from quibble.sources.staging import stage

ROWS_PER_FILE = 200_000
CHUNK_BYTES = 8 << 20


def write_landing(df: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE, mode: str = "append") -> None:
    """Snappy Parquet under ``category=/ingest_dt=``, at most ``rows_per_file`` rows per file.

    Rows of a partition are gathered before the write, ``rows_per_file`` to a task, so the files are
    about full instead of one per task and partition: the salt's range is the partition's share of
    files. In ``overwrite`` mode only the partitions ``df`` has rows for are replaced.
    """
    files = df.groupBy(*PARTITION_COLUMNS).agg(F.ceil(F.count(F.lit(1)) / rows_per_file).alias("_files"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in PARTITION_COLUMNS]
    salted = df.alias("a").join(F.broadcast(files).alias("b"), same)  # one row per landed partition
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_files")).alias("_salt")
    df = salted.select("a.*", salt).repartition(*PARTITION_COLUMNS, "_salt").drop("_salt")
    writer = df.write.mode(mode).option("maxRecordsPerFile", rows_per_file).option("compression", "snappy")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITION_COLUMNS).parquet(path)


def ingest_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Rows and distinct products per landed partition; reads one column."""
    landed = spark.read.parquet(path)
    return landed.groupBy(*PARTITION_COLUMNS).agg(
        F.count(F.lit(1)).alias("rows_written"), F.countDistinct("asin").alias("distinct_products")
    )


def with_lineage(df: DataFrame) -> DataFrame:
    """Source file and load time of rows read from files."""
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("source_file"),
        F.current_timestamp().cast("timestamp_ntz").alias("load_ts"),
    )


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, uri, bytes, modified) of every file below ``path`` whose name fits, empty files included.

    Only names and sizes pass the driver, as in any Spark scan. Hidden files and folders are left out.
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    walk = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(root, True)
    base, rows = root.toUri().getPath().rstrip("/"), []
    while walk.hasNext():
        f = walk.next()
        inner = f.getPath().toUri().getPath()[len(base) :].strip("/").split("/")
        if not any(p.startswith(("_", ".")) for p in inner) and fnmatch(inner[-1], pattern):
            rows.append((f.getPath().toString(), f.getPath().toUri().toString(), f.getLen(), f.getModificationTime()))
    found = spark.createDataFrame(rows, "path string, uri string, bytes long, _modified long")
    return found.select("path", "uri", "bytes", F.timestamp_millis("_modified").alias("modified"))


def path_exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _open(path: str):
    from pyarrow import fs

    where, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return where.open_input_file(inner)


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns of each Parquet file as text, or why it can't be read."""
    import pyarrow.parquet as pq

    for batch in batches:
        layouts, errors = [], []
        for path in batch.column(0).to_pylist():
            try:
                with _open(path) as f:
                    schema = pq.read_schema(f)
                layouts.append("; ".join(f"{c.name} {c.type}" for c in schema))
                errors.append(None)
            except Exception as e:  # recorded with the file
                layouts.append(None)
                errors.append(f"{type(e).__name__}: {e}"[:500])
        columns = [batch.column(0), pa.array(layouts, pa.string()), pa.array(errors, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["path", "layout", "error"])


def read_files(spark: SparkSession, files: DataFrame, root: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of Parquet ``files(path)`` with the columns of ``schema`` and lineage; (path, error) of files that can't be read.

    Part files are written with the types their data suggest. Files are grouped by their columns, each
    group is read with its own types, and every field is cast; what can't be cast is null. Columns are matched
    by name without regard to case, missing ones are null.
    """
    target = T.StructType.fromDDL(schema)
    looked = stage(files.select("path").mapInArrow(_footers, "path string, layout string, error string"), "layouts")
    rows = None
    for (layout,) in looked.filter("layout IS NOT NULL").select("layout").distinct().collect():  # few kinds of writer
        paths = [r.path for r in looked.filter(F.col("layout") == layout).select("path").collect()]
        found = with_lineage(spark.read.option("basePath", root).parquet(*paths))
        have = {f.name.lower(): f for f in found.schema}

        def field(f: T.StructField, have=have) -> Column:
            if f.name.lower() not in have:
                return F.lit(None).cast(f.dataType).alias(f.name)
            return F.col(f"`{have[f.name.lower()].name}`").try_cast(f.dataType).alias(f.name)

        part = found.select(*[field(f) for f in target], "source_file", "load_ts")
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        rows = spark.createDataFrame([], f"{schema}, {LINEAGE}")
    return rows, looked.filter("error IS NOT NULL").select("path", "error")


def load_landing(spark: SparkSession, path: str, schema: str, tolerate_errors: bool = False) -> DataFrame:
    """Landed rows with the raw layer's types and lineage.

    ``tolerate_errors`` leaves out unreadable files (see :func:`read_files` for their names); without it
    the first of them fails the load.
    """
    rows, errors = read_files(spark, list_files(spark, path, "*.parquet"), path, schema)
    bad = None if tolerate_errors else errors.orderBy("path").first()
    if bad is not None:
        raise ValueError(f"{bad.path}: {bad.error}")
    return rows


def with_checksums(files: DataFrame) -> DataFrame:
    """``files`` with the MD5 of each ``path``; one task reads a file."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema)
    return files.repartition("path").mapInArrow(_checksums, f"{schema}, md5_hex string")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """MD5 of each file, read in chunks: memory does not depend on the file's size."""
    for batch in batches:
        sums = []
        for path in batch.column(batch.schema.get_field_index("path")).to_pylist():
            digest = hashlib.md5()
            with _open(path) as f:
                while chunk := f.read(CHUNK_BYTES):
                    digest.update(chunk)
            sums.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.string())], names=[*batch.schema.names, "md5_hex"])


def source_manifest(spark: SparkSession, path: str, pattern: str = "*", checksums: bool = True) -> DataFrame:
    """One row per file: path, partition, size, modification time, MD5. Contents are read only for checksums."""
    part = {c: F.nullif(F.regexp_extract("path", f"/{c}=([^/]+)/", 1), F.lit("")) for c in PARTITION_COLUMNS}
    files = list_files(spark, path, pattern).select(
        "path", *[part[c].alias(c) for c in PARTITION_COLUMNS], "bytes", "modified"
    )
    if not checksums:
        return files.withColumn("md5_hex", F.lit(None).cast("string"))
    return with_checksums(files)


def has_new_data(spark: SparkSession, path: str, category: str, ingest_dt: str) -> bool:
    """Whether the partition has any row; stops at the first one found."""
    landed = spark.read.parquet(path)
    wanted = (F.col("category") == category) & (F.col("ingest_dt") == F.lit(ingest_dt).cast("date"))
    return not landed.filter(wanted).limit(1).isEmpty()
