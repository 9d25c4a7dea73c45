"""Small tables published version by version.

A version is a Parquet folder ``v<n>``; it is published when its write has ended, which Spark
marks by ``_SUCCESS``. Readers take the newest published one and keep to it, so they never see
a version that is being written, or one whose writer failed. One writer at a time.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right below ``path``; none if there is no such path."""
    fs, at = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()] if fs.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)


class Versions:
    """The versions below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, version: int) -> str:
        return f"{self.root}/v{version}"

    def published(self) -> list[int]:
        """Numbers of all published versions, the newest last."""
        named = [int(m[1]) for f in folders(self.spark, self.root) if (m := re.fullmatch(r"v(\d+)", f))]
        done = []
        for n in sorted(named):
            fs, at = _fs(self.spark, f"{self.path(n)}/_SUCCESS")
            if fs.exists(at):
                done.append(n)
        return done

    def current(self) -> int:
        """The newest published version; 0 if there is none."""
        return max(self.published(), default=0)

    def read(self, version: int, schema: str) -> DataFrame:
        if not version:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path(version))

    def publish(self, table: DataFrame) -> int:
        """Write the next version in one file; what a failed writer left there is replaced."""
        version = self.current() + 1
        table.coalesce(1).write.mode("overwrite").parquet(self.path(version))
        return version

    def forget(self, keep: int) -> None:
        """Delete all but the newest ``keep`` versions."""
        for n in self.published()[:-keep]:
            delete(self.spark, self.path(n))
