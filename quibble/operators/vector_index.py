"""A kept vector index: vectors by cell, probes joined by cell, exact scores.

Centres come from k-means over a bounded sample of unit vectors; every vector is stored with its
nearest centre's cell. A cell of more than ``ROWS_PER_PART`` vectors has several parts. A query looks
into the cells whose centres are nearest, and what it finds there is scored exactly.

Each cell knows the largest angle between its centre and a vector. No vector of it can be nearer to a
query than the angle to the centre less that one, so the exact search leaves out only cells that
can't reach the k-th score that a first look has given.

Queries stay distributed: what is broadcast are the centres, ``MOST_CELLS`` at most. Vectors that are null or
have no length have no cosine and are in no cell.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quibble.sources.staging import new_folder, stage

SAMPLE = 20_000
MOST_CELLS = 4096
ROWS_PER_PART = 50_000
QUERIES_PER_PART = 10_000
FIRST_PROBES = 4
SCORE_DIGITS = 6
ROUNDING = 1e-6


@dataclass(frozen=True)
class VectorIndex:
    """``vectors``: (doc_id, embedding, kept..., part, cell); ``centres``: (cell, centre, radius, vectors, parts), staged."""

    vectors: DataFrame
    centres: DataFrame

    @property
    def cells(self) -> int:
        return self.centres.count()


def _matrix(lists: pa.Array) -> np.ndarray:
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(lists), -1) if len(lists) else np.zeros((0, 1))


def _units(lists: pa.Array) -> np.ndarray:
    """Rows of length 1."""
    rows = _matrix(lists)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0))


def _centres(docs: DataFrame, cells: int | None, sample: int) -> np.ndarray:
    """Unit centres from about ``sample`` vectors, chosen by hash."""
    n = docs.count()
    cells = min(MOST_CELLS, max(2, round(n**0.5) if cells is None else cells))  # k-means wants two
    share = F.lit(min(1.0, sample / max(1, n)) * (1 << 30))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))
    units = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < share)
    units = stage(units.select(F.transform("embedding", lambda x: x.cast("double") / norm).alias("unit")), "vector-sample")
    some = units.distinct().limit(2).collect()
    if len(some) < 2:  # no vector, or copies of one
        return np.array([some[0]["unit"]]) if some else np.zeros((0, 1))
    features = units.select(array_to_vector("unit").alias("features"))
    found = np.array(KMeans(k=cells, seed=1, maxIter=10).fit(features).clusterCenters())
    lengths = np.linalg.norm(found, axis=1, keepdims=True)
    return found[lengths[:, 0] > 0] / lengths[lengths[:, 0] > 0]


def build_vector_index(
    docs: DataFrame, keep: Sequence[str] = (), path: str | None = None, cells: int | None = None, sample: int = SAMPLE
) -> VectorIndex:
    """Write the index of ``docs(doc_id, embedding, keep...)`` below ``path`` (a run folder by default)."""
    spark = docs.sparkSession
    path = path or new_folder(spark, "vector-index")
    docs = _with_length(docs).select("doc_id", "embedding", *keep)
    sent = spark.sparkContext.broadcast(_centres(docs, cells, sample))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = _units(batch.column(1)) @ sent.value.T
                cell = near.argmax(axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], names=[*batch.schema.names, "cell", "angle"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    placed = stage(docs.mapInArrow(assign, f"{schema}, cell long, angle double"), "placed-vectors")
    of_cell = placed.groupBy("cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("vectors"))
    of_cell = stage(of_cell.withColumn("parts", F.ceil(F.col("vectors") / ROWS_PER_PART).cast("int")), "cells")
    part = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part")
    dealt = placed.join(F.broadcast(of_cell.select("cell", "parts")), "cell").select("doc_id", "embedding", *keep, part, "cell")
    dealt.repartition("cell", "part").write.partitionBy("cell").parquet(f"{path}/vectors")
    centres = [(i, [float(x) for x in c]) for i, c in enumerate(sent.value)]
    centres = spark.createDataFrame(centres, "cell long, centre array<double>").join(of_cell, "cell")
    centres.write.parquet(f"{path}/centres")
    return open_vector_index(spark, path)


def open_vector_index(spark: SparkSession, path: str) -> VectorIndex:
    vectors = spark.read.parquet(f"{path}/vectors")
    return VectorIndex(vectors.withColumn("cell", F.col("cell").cast("long")), spark.read.parquet(f"{path}/centres"))


def _probes(index: VectorIndex, queries: DataFrame, kind: str) -> DataFrame:
    """(query_id, embedding, cell, parts, turn, bound): all cells of each query in the order of their centres; ``bound`` tops scores in it."""
    table = index.centres.select("cell", "centre", "radius", "parts").toArrow()  # MOST_CELLS at most
    sent = queries.sparkSession.sparkContext.broadcast(
        (_matrix(table["centre"].combine_chunks()), *(table[n].to_numpy() for n in ("radius", "cell", "parts")))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, radius, cell, parts = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                near = np.clip(_units(some.column(1)) @ centres.T, -1, 1)
                order = np.argsort(-near, axis=1, kind="stable")
                bound = np.cos(np.maximum(0, np.arccos(near) - radius))
                who = np.repeat(np.arange(some.num_rows), len(cell))
                columns = [c.take(pa.array(who)) for c in some.columns]
                columns += [pa.array(x[order].ravel()) for x in (np.broadcast_to(cell, order.shape)[0], parts)]
                columns += [pa.array(np.tile(np.arange(len(cell)), some.num_rows)), pa.array(np.take_along_axis(bound, order, 1).ravel())]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "embedding", "cell", "parts", "turn", "bound"])

    asked = _with_length(queries).select("query_id", F.col("embedding").cast("array<double>"))
    return asked.mapInArrow(run, f"query_id {kind}, embedding array<double>, cell long, parts int, turn long, bound double")


def _scored(index: VectorIndex, probes: DataFrame, k: int, kind: str) -> DataFrame:
    """Best ``k`` (query_id, doc_id, score) of each query in each part of its cells.

    A group is one part of a cell and about ``QUERIES_PER_PART`` of the queries that look into it.
    """
    asked = probes.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERIES_PER_PART).cast("int").alias("turns"))
    asked = F.broadcast(asked)  # one row per cell
    turn = F.pmod(F.xxhash64("query_id"), F.col("turns")).cast("int").alias("ask")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    left = probes.join(asked, "cell").select("query_id", "embedding", "cell", turn, every)
    right = index.vectors.join(asked, "cell").select("doc_id", "embedding", "cell", "part", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("ask"))
    ids = pa.schema([("query_id", _ARROW[kind]), ("doc_id", pa.int64()), ("score", pa.float64())])

    def best(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        if not queries.num_rows or not vectors.num_rows:
            return ids.empty_table()
        units = _units(vectors["embedding"].combine_chunks())
        doc = vectors["doc_id"].to_numpy()
        units, doc = units[order := np.argsort(doc, kind="stable")], doc[order]
        who, out, scores = queries["query_id"].combine_chunks(), [], []
        for at in range(0, queries.num_rows, 256):
            near = np.round(_units(queries["embedding"].slice(at, 256).combine_chunks()) @ units.T, SCORE_DIGITS)
            top = np.argsort(-near, axis=1, kind="stable")[:, :k]  # ties to the lower id
            out.append(doc[top].ravel())
            scores.append(np.take_along_axis(near, top, 1).ravel())
        each = min(k, len(doc))
        who = who.take(pa.array(np.repeat(np.arange(queries.num_rows), each)))
        return pa.Table.from_arrays([who, pa.array(np.concatenate(out), pa.int64()), pa.array(np.concatenate(scores))], schema=ids)

    by = ["cell", "part", "ask"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(best, f"query_id {kind}, doc_id bigint, score double")


_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}


def search_vectors(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """Nearest ``k`` of each query: ``query_id, doc_id, score, rank``, from ``probes`` cells a query, or exactly without a number.

    ``queries`` has ``query_id`` (int, bigint or string) and ``embedding``.
    """
    kind = queries.schema["query_id"].dataType.simpleString()
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    cells = stage(_probes(index, queries, kind), "probes")
    first = cells.where(F.col("turn") < (FIRST_PROBES if probes is None else probes))
    scored = _scored(index, first, k, kind)
    if probes is None:
        scored = stage(scored, "first-scores")
        kth = scored.withColumn("_n", F.row_number().over(ranked)).where(F.col("_n") == k)
        floor = kth.select("query_id", (F.col("score") - ROUNDING).alias("_floor"))
        rest = cells.where(F.col("turn") >= FIRST_PROBES).join(floor, "query_id", "left")
        rest = rest.where(F.col("_floor").isNull() | (F.col("bound") >= F.col("_floor"))).drop("_floor")
        scored = scored.unionByName(_scored(index, rest, k, kind))
    return scored.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, recall): the share of each query's exact results that was found."""
    hit = found.select("query_id", "doc_id", F.lit(1).alias("_hit"))
    return exact.join(hit, ["query_id", "doc_id"], "left").groupBy("query_id").agg((F.count("_hit") / F.count(F.lit(1))).alias("recall"))
