"""Hard negatives by bounds from segment summaries.

A vector's components become integers, floor(256 x). Each vector is stored with summaries of its
segments, at 1, 4 and 16 segments: the mean and the deviation of a segment's components, both times
the root of its length. In a segment the product of two vectors is the product of the means, plus
or minus at most the product of the deviations (Cauchy and Schwarz), so summed products of
summaries bound the score of a pair. Pairs whose bound can't reach what their anchor still needs
go; the others are looked at in finer segments, and what is left is scored exactly. Bounds are
widened by more than rounding can amount to, so no pair is lost and the result is exact.

Rows lie in blocks of bounded size. Anchors, a stated set, are broadcast in blocks of about
``ANCHORS``, one after the other; each task runs through its rows and keeps, per anchor, the rows that
can be among the first, so that what is shuffled is a few rows per anchor and task. The first
run finds each anchor's positives. The second takes from their scores which scores are asked for.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no
part; shorter vectors count as filled up with zeros; components beyond the size that sums below
2^53 allow (2^23 at 64 components, i.e. x = 32,768) count as that size; repeated rows each take part,
a row is only not its own positive; ties go by id, null ids last; an anchor without positives or
without negatives in range has no rows; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quibble.sources.staging import stage

SCALE = 256
SEGMENTS = (1, 4, 16)
BLOCK_ROWS = 4096
BLOCK_BYTES = 4 << 20
ANCHORS = 1 << 14
TILE = 128  # anchors compared with a block at once
FEW = 16  # pairs are scored one by one if less than one of these is left
HELD = 1 << 20  # rows that a task adds before it cuts its lists again
SLACK = 1e-5
_LAST = np.iinfo(np.int64).max  # stands for a null id

_CANDIDATE = pa.schema([("anchor", pa.int64()), ("score", pa.int64()), ("id", pa.int64()), ("row", pa.int64())])


def quantise(values: np.ndarray) -> np.ndarray:
    """floor(256 x), cut to what keeps all sums of products exact in doubles."""
    most = np.floor(np.sqrt(2.0**53 / values.shape[1]))
    return np.clip(np.floor(SCALE * values.astype(np.float64)), -most, most)


def summaries(vectors: np.ndarray) -> list[np.ndarray]:
    """Per level the scaled means, then the scaled deviations, of each vector's segments."""
    out = []
    for n in SEGMENTS:
        parts = vectors.reshape(len(vectors), n, -1).astype(np.float64)
        mean = parts.mean(axis=2)
        deviation = np.sqrt(((parts - mean[:, :, None]) ** 2).sum(axis=2))
        out.append(np.concatenate([mean * np.sqrt(parts.shape[2]), deviation], axis=1).astype(np.float32))
    return out


class Block:
    """Vectors sorted by label, with ids, row numbers and summaries."""

    def __init__(self, rows, ids, labels, vectors, levels=None):
        self.rows, self.ids, self.labels, self.vectors = rows, ids, labels, vectors
        self.levels = summaries(vectors) if levels is None else levels
        self.norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))

    @classmethod
    def sorted(cls, rows, ids, labels, vectors) -> Block:
        order = np.argsort(labels, kind="stable")
        return cls(rows[order], ids[order], labels[order], vectors[order])

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, some) -> Block:
        part = object.__new__(Block)
        part.rows, part.ids, part.labels, part.vectors = (x[some] for x in (self.rows, self.ids, self.labels, self.vectors))
        part.levels, part.norms = [x[some] for x in self.levels], self.norms[some]
        return part

    def labelled(self, label: int) -> slice:
        return slice(*np.searchsorted(self.labels, [label, label + 1]).tolist())

    def packed(self) -> dict[str, bytes]:
        out = {n: np.ascontiguousarray(getattr(self, n)).tobytes() for n in ("rows", "ids", "labels", "vectors")}
        return out | {"levels": np.concatenate(self.levels, axis=1).tobytes()}

    @classmethod
    def unpacked(cls, rows: bytes, ids: bytes, labels: bytes, vectors: bytes, levels: bytes) -> Block:
        rows, ids, labels = (np.frombuffer(x, np.int64) for x in (rows, ids, labels))
        wide = np.frombuffer(levels, np.float32).reshape(len(rows), -1)
        cuts = np.cumsum([2 * n for n in SEGMENTS])[:-1]
        return cls(rows, ids, labels, np.frombuffer(vectors, np.float64).reshape(len(rows), -1), np.split(wide, cuts, axis=1))


def _exact(a: np.ndarray, b: np.ndarray, norms: float) -> np.ndarray:
    """All scores; single floats hold integers exactly while the norms' product, which bounds every sum, is below 2^24."""
    kind = np.float32 if norms < 1 << 24 else np.float64
    return a.astype(kind) @ b.astype(kind).T


def pairs_between(
    anchors: Block, rows: Block, low: np.ndarray, high: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score) of all pairs of an anchor i and a row j with low[i] <= score, and score <= high[i]."""
    i, j = np.arange(len(anchors)), np.arange(len(rows))
    none = (np.zeros(0, np.int64),) * 3
    if not len(i) or not len(j):
        return none
    top = float(rows.norms.max())
    slack = SLACK * anchors.norms * top + 1e-3
    left = None
    for a, b, n in zip(anchors.levels, rows.levels, SEGMENTS):
        mean, deviation = a[i, :n] @ b[j, :n].T, a[i, n:] @ b[j, n:].T
        can = mean + deviation >= (low - slack)[i, None]
        if high is not None:
            can &= mean - deviation <= (high + slack)[i, None]
        left = can if left is None else left & can
        ok_i, ok_j = left.any(axis=1), left.any(axis=0)
        i, j, left = i[ok_i], j[ok_j], left[np.ix_(ok_i, ok_j)]
        if not left.size:
            return none
        if np.count_nonzero(left) * FEW < left.size:
            break
    if np.count_nonzero(left) * FEW < left.size:
        x, y = np.nonzero(left)
        score = np.empty(len(x), np.int64)
        for at in range(0, len(x), 1 << 14):
            own = slice(at, at + (1 << 14))
            score[own] = np.einsum("ij,ij->i", anchors.vectors[i[x[own]]], rows.vectors[j[y[own]]])
    else:
        scores = _exact(anchors.vectors[i], rows.vectors[j], float(anchors.norms[i].max()) * top)
        left &= scores >= low[i, None]
        if high is not None:
            left &= scores <= high[i, None]
        x, y = np.nonzero(left)
        score = scores[x, y].astype(np.int64)
    i, j = i[x], j[y]
    ok = score >= low[i]
    if high is not None:
        ok &= score <= high[i]
    return i[ok], j[ok], score[ok]


class _List:
    """Candidates of all anchors, cut to those that can still be wanted."""

    def __init__(self, anchors: int, cut: Callable):
        self.low = np.full(anchors, -np.inf)
        self.parts, self.added, self.cut = [], 0, cut

    def add(self, anchor, score, rows: Block, j) -> None:
        self.parts.append(np.stack([anchor, score, rows.ids[j], rows.rows[j]]))
        self.added += len(j)
        if self.added > HELD:
            self.settle()

    def settle(self) -> np.ndarray:
        held = np.concatenate([np.zeros((4, 0), np.int64), *self.parts], axis=1)
        held = held[:, np.lexsort((held[3], held[2], -held[1], held[0]))]
        held = self.cut(held, self.low)
        self.parts, self.added = [held], 0
        return held


def _place(anchor: np.ndarray) -> np.ndarray:
    """Place of each row among the rows of its anchor, from 0; rows are sorted by anchor."""
    starts = np.flatnonzero(np.diff(anchor, prepend=-1))
    return np.arange(len(anchor)) - np.repeat(starts, np.diff(np.append(starts, len(anchor))))


def _first(n: int) -> Callable:
    def cut(held: np.ndarray, low: np.ndarray) -> np.ndarray:
        place = _place(held[0])
        last = place == n - 1
        low[held[0][last]] = held[1][last]
        return held[:, place < n]

    return cut


def _below(positive: np.ndarray, n: int, share: tuple[int, int]) -> Callable:
    """Keeps the first ``n`` of each positive's range; ``positive``: scores per anchor and rank, -1 for none."""

    def cut(held: np.ndarray, low: np.ndarray) -> np.ndarray:
        anchor, score = held[0], held[1]
        place = _place(anchor)
        kept = np.zeros(len(anchor), bool)
        floor = np.full(len(low), np.inf)
        for p in positive.T:
            own = p[anchor]
            ok = (score <= own) & (share[0] * own <= share[1] * score)
            before = np.cumsum(ok) - ok
            first = before - before[np.arange(len(ok)) - place] if len(ok) else before
            kept |= ok & (first < n)
            last = ok & (first == n - 1)
            own_floor = np.where(p >= 0, np.ceil(share[0] * p / share[1]) - 1, np.inf)
            own_floor[anchor[last]] = np.maximum(own_floor[anchor[last]], score[last])
            floor = np.minimum(floor, own_floor)
        low[:] = floor
        return held[:, kept]

    return cut


def _send(held: np.ndarray, numbers: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(numbers[held[0]]), *(pa.array(x) for x in held[1:])], schema=_CANDIDATE)


def _tiles(own: slice) -> Iterator[slice]:
    for at in range(own.start, own.stop, TILE):
        yield slice(at, min(at + TILE, own.stop))


def _run(blocks: DataFrame, anchors: Block, visit: Callable, cut: Callable) -> DataFrame:
    """Every block is visited with the anchors, and the list that is left of each task is sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        found = _List(len(own), cut)
        found.settle()
        for batch in batches:
            for columns in zip(*(c.to_pylist() for c in batch.columns)):
                visit(own, Block.unpacked(*columns), found)
                found.settle()
        yield _send(found.settle(), own.rows)

    sent = blocks.sparkSession.sparkContext.broadcast(anchors)
    staged = stage(blocks.mapInArrow(run, "anchor long, score long, id long, row long"), "candidates")
    sent.unpersist()
    return staged


def _visit_same(anchors: Block, rows: Block, found: _List) -> None:
    for label in np.intersect1d(anchors.labels, rows.labels):
        same = rows[rows.labelled(label)]
        for tile in _tiles(anchors.labelled(label)):
            i, j, score = pairs_between(anchors[tile], same, found.low[tile])
            other = anchors.rows[tile][i] != same.rows[j]
            found.add(i[other] + tile.start, score[other], same, j[other])


def _visit_others(high: np.ndarray) -> Callable:
    def visit(anchors: Block, rows: Block, found: _List) -> None:
        for label in np.unique(anchors.labels):
            same = rows.labelled(label)
            for part in (rows[: same.start], rows[same.stop :]):
                for tile in _tiles(anchors.labelled(label)):
                    i, j, score = pairs_between(anchors[tile], part, found.low[tile], high[tile])
                    found.add(i + tile.start, score, part, j)

    return visit


def pack(rows: DataFrame, vector: str, id: str, label: str, is_anchor: Column) -> tuple[DataFrame, DataFrame]:
    """Staged blocks of all usable rows, and staged anchors (row, id, label, values)."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    used = rows.where(F.col(label).isNotNull() & x.isNotNull() & finite).select(
        F.monotonically_increasing_id().alias("row"), F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
        x.cast("array<double>").alias("values"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
    )
    length = used.agg(F.max(F.size("values"))).first()[0] or 1
    width = -(-max(1, length) // max(SEGMENTS)) * max(SEGMENTS)
    at_most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * width)))

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, at_most):
                part = batch.slice(start, at_most)
                lists = part.column(3)
                sizes = np.diff(lists.offsets.to_numpy())
                values = np.zeros((len(sizes), width))
                values[np.arange(width)[None, :] < sizes[:, None]] = lists.flatten().to_numpy()
                ids = part.column(1).fill_null(_LAST).to_numpy()
                made = Block.sorted(part.column(0).to_numpy(), ids, part.column(2).to_numpy(), quantise(values))
                marked = part.column(0).filter(part.column(4)).to_numpy()
                packed = made.packed() | {"anchors": made[np.isin(made.rows, marked)].packed()}
                yield pa.RecordBatch.from_pylist([packed], schema=packed_schema)

    parts = ("rows", "ids", "labels", "vectors", "levels")
    binary = [pa.field(n, pa.binary()) for n in parts]
    packed_schema = pa.schema([*binary, pa.field("anchors", pa.struct(binary))])
    schema = ", ".join(f"{n} binary" for n in parts)
    blocks = stage(used.mapInArrow(block, f"{schema}, anchors struct<{schema}>"), "vector-blocks")

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in batch.column(0).to_pylist():
                if not own["rows"]:
                    continue
                b = Block.unpacked(*(own[n] for n in parts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b.rows), pa.array(b.ids), pa.array(b.labels), pa.array([v.tobytes() for v in b.vectors], pa.binary())],
                    names=["row", "id", "label", "vector"],
                )

    anchors = blocks.select("anchors").mapInArrow(single, "row long, id long, label long, vector binary")
    return blocks.select(*parts), stage(anchors, "anchors")


def _first_rows(candidates: DataFrame, by: list[str], n: int, name: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "id", "row")
    return candidates.withColumn(name, F.row_number().over(order)).where(F.col(name) <= n)


def mine(
    rows: DataFrame,
    is_anchor: Column,
    vector: str = "vector",
    id: str = "vec_id",
    label: str = "label",
    positives: int = 5,
    negatives: int = 5,
    share: tuple[int, int] = (80, 100),
    anchors_at_once: int = ANCHORS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    An anchor's positives are the first other rows of its label; their negatives the first rows of another
    label whose score is at most the positive's and at least ``share`` of it. Labels and ids are integers.
    """
    spark = rows.sparkSession
    blocks, anchors = pack(rows, vector, id, label, is_anchor)
    times = max(1, -(-anchors.count() // anchors_at_once))
    found = []
    for k in range(times):
        own = anchors.where(F.pmod(F.xxhash64("row"), F.lit(times)) == k).toArrow()
        if not own.num_rows:
            continue
        values = np.stack([np.frombuffer(v.as_py(), np.float64) for v in own["vector"]])
        block = Block.sorted(own["row"].to_numpy(), own["id"].to_numpy(), own["label"].to_numpy(), values)
        same = _run(blocks, block, _visit_same, _first(positives))
        same = stage(_first_rows(same, ["anchor"], positives, "place"), "positives")
        table = same.toArrow()
        score = np.full((len(block), positives), -1, np.int64)
        order = np.argsort(block.rows)
        at = order[np.searchsorted(block.rows, table["anchor"].to_numpy(), sorter=order)]
        score[at, table["place"].to_numpy() - 1] = table["score"].to_numpy()
        others = _run(blocks, block, _visit_others(score.max(axis=1).astype(float)), _below(score, negatives, share))
        asked = same.select("anchor", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        own_score = F.col("positive_score")
        pairs = others.join(asked, "anchor").where(
            (F.col("score") <= own_score) & (own_score * share[0] <= F.col("score") * share[1])
        )
        found.append(_first_rows(pairs, ["anchor", "place"], negatives, "rank"))
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not found:
        return spark.createDataFrame([], result)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    names = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    known = lambda c: F.when(F.col(c) != int(_LAST), F.col(c)).alias(c)
    return out.join(names, "anchor").select(
        known("anchor_id"), known("positive_id"), "rank", known("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
