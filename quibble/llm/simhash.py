"""Near-duplicates by SimHash and covering locality-sensitive hashing.

A fingerprint bit is 1 if it is set in over half of the hashes of a document's
3-word shingles. Documents link if their fingerprints differ in at most
``RADIUS`` bits. Every bit position gets a non-zero vector of RADIUS + 1 bits,
and for each non-zero vector v there is a table that keeps the positions whose
vector has an odd product with v. Any RADIUS positions have vectors orthogonal
to some v, so two fingerprints within the radius agree on all bits which that
table keeps: 15 tables find every pair, none is left to chance.

Work is done on distinct fingerprints. A bucket sends out no pairs but a tree
of links that joins what is linked within it. A bucket of more than ``BUCKET``
fingerprints is dealt again, by a second and a third family of masks over its
other bits (the same guarantee holds for each family), and what is left after
that is compared block by block, so no bucket is cut and none is all-pairs.

Defined results: null, empty and blank texts have fingerprint zero and link like
any other; a component is named by its smallest non-null doc_id (null if it has
none); repeated rows get equal results; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quibble.llm.common import pieces, utf8
from quibble.llm.graph import components
from quibble.sources.staging import stage

RADIUS = 3
SHINGLE = 3
BUCKET = 2048
FAMILIES = 3
_HASH_SEED = 42


def fingerprint(text: bytes | None) -> int:
    words = (text or b"").lower().split()  # both work on ASCII alone
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return h(b" ".join(words), _HASH_SEED)
    hashes = np.array(
        [h(b"%b %b %b" % t, _HASH_SEED) for t in zip(words, words[1:], words[2:])], dtype="<u8"
    )
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        bits = np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """``docs`` with the long ``fp``; its text too if ``keep_text``."""
    kept = [f for f in docs.schema if f.name != "fp" and (keep_text or f.name != "text")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["fp long"])

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "_utf8"):
                texts = piece.column(piece.num_columns - 1)
                fps = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts))
                columns = [piece.column(i) for i in range(len(kept))] + [pa.array(fps.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in kept] + ["fp"])

    return docs.select(*[f"`{f.name}`" for f in kept], utf8().alias("_utf8")).mapInArrow(run, schema)


def masks(family: int) -> list[int]:
    """The 2^(RADIUS + 1) - 1 covering masks of a family; families deal vectors to positions differently."""
    vectors = 2 ** (RADIUS + 1) - 1
    order = np.random.default_rng(family).permutation(64)
    given = {int(p): 1 + i % vectors for i, p in enumerate(order)}
    return [sum(1 << p for p, g in given.items() if (g & v).bit_count() % 2) for v in range(1, vectors + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _distance(a: np.ndarray, b) -> np.ndarray:
    """Differing bits; a signed number would be counted by its absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def _tree(fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that join what is connected within the radius, at most one per fingerprint."""
    left = fps
    while len(left) > 1:
        root, left = left[0], left[1:]
        front = np.array([root])
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for f in front:
                near |= _distance(left, f) <= RADIUS
            front = left[near]
            left = left[~near]
            if len(front):
                yield np.full(len(front), root), front


_OUT = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64())])


def _links(split_over: int | None):
    """Rows of sorted (key, fp) -> links; rows of larger groups come out as (fp, null, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def flush(keys, fps):
            a, b, again, kept = [], [], [], []
            edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
            sizes = np.diff(edges)
            two = edges[:-1][sizes == 2]
            x, y = fps[two], fps[two + 1]
            near = _distance(x, y) <= RADIUS
            a.append(x[near])
            b.append(y[near])
            for at in np.flatnonzero(sizes > 2):
                group = fps[edges[at] : edges[at + 1]]
                if split_over is not None and len(group) > split_over:
                    again.append(group)
                    kept.append(np.full(len(group), keys[edges[at]]))
                    continue
                for p, q in _tree(group):
                    a.append(p)
                    b.append(q)
            a, b = np.concatenate(a), np.concatenate(b)
            more = np.concatenate(again) if again else np.zeros(0, np.int64)
            null = pa.nulls(len(more), pa.int64())
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([a, more])),
                    pa.concat_arrays([pa.array(b), null]),
                    pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(np.concatenate(kept) if kept else more)]),
                ],
                schema=_OUT,
            )

        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
            fps = np.concatenate([fps, batch.column(1).to_numpy(zero_copy_only=False)])
            if not len(keys):
                continue
            whole = int(np.searchsorted(keys, keys[-1]))  # the last group may go on
            if whole:
                yield flush(keys[:whole], fps[:whole])
                keys, fps = keys[whole:], fps[whole:]
        if len(keys):
            yield flush(keys, fps)

    return run


def links(fps: DataFrame, split_over: int = BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that join all within the radius."""
    found, rows = [], fps.select("fp", F.lit(0).cast("long").alias("key"))
    for family in range(FAMILIES):
        tables = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(_signed(m)).alias("m")) for i, m in enumerate(masks(family))])
        dealt = rows.select("fp", "key", F.explode(tables).alias("t")).select(
            F.xxhash64("key", "t.i", F.col("fp").bitwiseAND(F.col("t.m"))).alias("key"), "fp"
        )
        last = family == FAMILIES - 1
        out = (
            dealt.repartition("key")
            .sortWithinPartitions("key")
            .mapInArrow(_links(None if last else split_over), "a long, b long, key long")
        )
        out = stage(out, f"links-{family}")
        found.append(out.where("b is not null").select("a", "b"))
        rows = out.where("b is null").select(F.col("a").alias("fp"), "key")
        if last or rows.isEmpty():
            break
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    return edges


def classes(with_fp: DataFrame) -> DataFrame:
    """(fp, root, component_id) of each distinct fingerprint of rows with ``fp`` and ``doc_id``, staged."""
    distinct = stage(with_fp.groupBy("fp").agg(F.min("doc_id").alias("_least")), "distinct-fingerprints")
    roots = components(links(distinct.select("fp"))).select(F.col("node").alias("fp"), "root")
    joined = distinct.join(roots, "fp", "left").select("fp", "_least", F.coalesce("root", "fp").alias("root"))
    named = joined.groupBy("root").agg(F.min("_least").alias("component_id"))
    return stage(joined.join(named, "root").select("fp", "root", "component_id"), "components")


def group(docs: DataFrame) -> DataFrame:
    """``docs`` without text, with fp, ``fingerprint`` (16 hex digits) and ``component_id``."""
    taken = ("fp", "fingerprint", "component_id", "root")
    with_fp = stage(fingerprints(docs.select(*[f"`{c}`" for c in docs.columns if c not in taken])), "fingerprints")
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return with_fp.join(classes(with_fp).drop("root"), "fp").withColumn("fingerprint", text)


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component: the smallest doc_id, rows without one last; of equal ids any one row."""
    names = [f"`{c}`" for c in docs.columns]
    rows = stage(fingerprints(docs.withColumn("_row", F.monotonically_increasing_id()), keep_text=True), "documents")
    small = rows.select("_row", "doc_id", "fp")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))
    chosen = small.join(classes(small), "fp").groupBy("root").agg(first.alias("_first")).select("_first._row")
    return rows.join(chosen, "_row", "left_semi").select(*names)
