"""Dense global row numbers without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quibble.sources.staging import stage

_POSITION_BITS = 33  # monotonically_increasing_id: partition above, position below


def number_rows(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds ``name``: 1..n in ``order``, as a global ``row_number`` would give.

    Rows are range-partitioned and sorted, then staged together with their
    position; partition sizes (one row per partition) give the offsets. The
    staged copy fixes partition borders, which a recomputation could move.
    End ``order`` with a column that tells all rows apart (see ``stage``), so
    that no group of equal rows has to fit one partition.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = stage(
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id()),
        "numbered",
    )
    located = placed.withColumns(
        {
            "_part": F.shiftright("_at", _POSITION_BITS),
            "_pos": F.col("_at").bitwiseAND((1 << _POSITION_BITS) - 1),
        }
    )
    sizes = located.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        located.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + F.col("_pos") + 1)
        .drop("_at", "_part", "_pos", "_before")
    )
