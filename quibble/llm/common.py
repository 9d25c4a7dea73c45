"""Helpers that several training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quibble.sources.staging import stage

#: Text bytes that a Python task works on at once; one longer document is a piece of its own.
PIECE_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def remainder(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; null for a null key."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(n))


def utf8(name: str = "text") -> Column:
    """The text as bytes, which Arrow hands to Python without decoding."""
    return F.col(name).cast("binary").alias(name)


def bytes_and_offsets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary array and the n + 1 offsets of its values (a null is empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_binary(texts.type)
    kind = np.int64 if wide else np.int32
    bounds = np.frombuffer(texts.buffers()[1], kind, len(texts) + 1, texts.offset * kind().itemsize)
    bounds = bounds.astype(np.int64)
    if texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), bounds - bounds[0]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts have about ``limit`` bytes."""
    if batch.num_rows == 0:
        return
    _, bounds = bytes_and_offsets(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(bounds, bounds[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def arrow_batch(columns: dict[str, pa.Array | np.ndarray | list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, per_class: int, seed: int
) -> DataFrame:
    """(doc_id, text, label) of at most ``per_class`` labelled documents of each class, staged.

    Only labels whose crc32 remainder is not ``held_out`` are looked at. The ids with the
    smallest seeded hash are taken, so the choice depends on neither order nor partitioning.
    At most ``2 * per_class`` ids are broadcast. Repeated ids count once.
    """
    usable = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (remainder("doc_id", modulus) != held_out))
        .groupBy("doc_id")
        .agg(F.max(label).alias("label"))
    )
    order = [F.xxhash64("doc_id", F.lit(seed)), F.col("doc_id")]
    chosen = [
        usable.where(F.col("label") > 0 if c else F.col("label") <= 0)
        .orderBy(*order)
        .limit(per_class)
        .select("doc_id", F.lit(c).alias("label"))
        for c in (0, 1)
    ]
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
    return stage(texts.dropDuplicates(["doc_id"]), "labelled")


def logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None, ridge: float = 1e-3) -> np.ndarray:
    """Coefficients (last: intercept) of a ridge logistic regression, by damped Newton steps."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.ones(len(y)) if weights is None else weights
    beta = np.zeros(a.shape[1])
    penalty = ridge * np.eye(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        gradient = a.T @ (w * (p - y)) + penalty @ beta
        hessian = (a * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + penalty
        step = np.linalg.solve(hessian, gradient)
        beta -= step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return beta
