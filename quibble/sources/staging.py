"""Intermediate tables in the cluster's shared folder.

A staged frame is written once as Parquet and read back, which cuts its
lineage, survives lost executors, and keeps column pruning and predicate
pushdown for whatever reads it next.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``, else one inside the warehouse.

    A warehouse on the driver's own disk is shared by nobody: on a cluster it is refused.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    local = warehouse.startswith(("file:", "/"))
    if local and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share; {warehouse} is local")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged"


def run_folder(spark: SparkSession) -> str:
    """All that this application stages lies below this folder."""
    return f"{shared_folder(spark)}/quibble/{spark.sparkContext.applicationId}"


_scope: ContextVar[str] = ContextVar("scope", default="")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{_scope.get() or run_folder(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def scope(spark: SparkSession, label: str) -> Iterator[str]:
    """What is staged inside lies below one folder, whose name this gives; see :func:`delete_unread`."""
    folder = new_folder(spark, label)
    token = _scope.set(folder)
    try:
        yield folder
    finally:
        _scope.reset(token)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def delete_unread(folder: str, *frames: DataFrame) -> bool:
    """Delete a scope's folder unless one of ``frames`` still reads from it; whether it was deleted.

    The driver's JVM is asked to collect garbage as well: Spark then deletes the shuffle files of frames
    that nobody holds any more.
    """
    inner = folder.split(":", 1)[-1].lstrip("/") + "/"
    if any(inner in name for frame in frames for name in frame.inputFiles()):
        return False
    spark = frames[0].sparkSession
    _delete(spark, folder)
    spark.sparkContext._jvm.System.gc()
    return True


def staged_alone(spark: SparkSession, label: str, make: Callable[[], DataFrame]) -> DataFrame:
    """Stage what ``make`` returns, and delete all that it staged on the way."""
    with scope(spark, f"for-{label}") as folder:
        out = make()
    kept = stage(out, label)
    del out
    delete_unread(folder, kept)
    return kept


def clear_run(spark: SparkSession) -> None:
    """Delete what this application staged. Call it when no staged frame is needed any more."""
    _delete(spark, run_folder(spark))


def stage(df: DataFrame, label: str, row_key: str | None = None) -> DataFrame:
    """Write ``df`` once and return a frame over the written table.

    ``row_key`` adds a column that tells all rows apart, full copies included.
    As it is written with the rows it never changes between reads, so it can
    serve as a last sort key or as a salt.
    """
    spark = df.sparkSession
    if row_key is not None:
        df = df.withColumn(row_key, F.monotonically_increasing_id())
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, by: str, tasks: int | None) -> DataFrame:
    """Deal rows over ``tasks`` tasks if the caller asks for it; ``None`` leaves the scan as it is.

    Meant for inputs in one row group or one gzip file, which one core would process alone.
    """
    return df if tasks is None else df.repartition(tasks, by)
