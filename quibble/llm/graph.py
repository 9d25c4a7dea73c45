"""Connected components of an edge table, by joins and shuffles only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quibble.sources.staging import stage

HELD_NODES = 1 << 20  # nodes that a task joins at once


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (node, smallest node of its tree) that join what the task's edges (a, b) join: fewer than it has nodes."""
    parent: dict = {}

    def root(x):
        top = x
        while top in parent:
            top = parent[top]
        while x != top:
            parent[x], x = top, parent[x]
        return top

    def flush() -> pa.RecordBatch:
        nodes = list(parent)
        return pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([root(x) for x in nodes], kind)], names=["a", "b"])

    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > HELD_NODES:
            yield flush()
            parent = {}
    if parent:
        yield flush()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; ``root`` is the smallest node reachable.

    Each round lets every node point its larger neighbours, and then its smaller ones, at the
    smallest neighbour (alternating large and small stars), which takes a logarithmic number of
    rounds in practice. Minima are combined before the shuffle, so a node with very many
    neighbours sends one row per task. Before the first round, the edges of the same larger node
    meet in a task, which sends a spanning forest of what it has: of a large group where many nodes are
    linked to the same few, one edge a node is left. Rounds are staged in the shared folder. Repeated edges and
    loops do no harm; without edges the result is empty.
    """
    kind = edges.schema["a"].dataType.simpleString()
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current = stage(ordered.repartition("a").mapInArrow(_forest, f"a {kind}, b {kind}").distinct(), "edges")
    state = None
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.select("a", F.col("m").alias("b"))
        )
        current = stage(small.where("a <> b").distinct(), "stars")
        after = current.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.crc32(F.concat_ws(" ", "a", "b").cast("binary")))
        ).first()
        if after == state:
            break
        state = after
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
