"""Line dedup with a sharded minimal perfect hash.

A line's key is the line stripped of ASCII white space and with A-Z in lower
case. Keys of at least ``MIN_CHARS`` characters are hashed to 128 bits and
counted with Spark; those of ``MIN_DOCS`` documents or more lose all their lines
but those of the largest doc_id that holds them. The frequent hashes are split
into shards; a task builds a minimal perfect hash for each shard, which indexes
three compact arrays: 64-bit fingerprints, document counts and keepers.
Documents probe these arrays in one scan; no line is joined and no text moves.

A shard holds about ``SHARD_KEYS`` keys whatever the corpus, and shards are sent to
the tasks in blocks of at most ``BLOCK_BYTES``, one of which a task holds at a time.

Defined results: null and empty texts are one empty line; rows are documents, so
repeated rows count each; where the largest doc_id is held by several rows all
of them keep the line; a null doc_id is below all others, and where no row of a key
has a doc_id every row keeps it. If every line goes, the text is empty. Other
columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quibble.llm.common import pieces, utf8
from quibble.sources.staging import stage

MIN_CHARS = 40
MIN_DOCS = 5
SHARD_KEYS = 200_000
BLOCK_BYTES = 64 << 20
_GAMMA = 2.0  # places per key on each level of the perfect hash
_LEVELS = 48
_BLANKS = b" \t\n\x0b\f\r"
_NO_DOC = -(1 << 63)


def key_hash(line: bytes) -> bytes | None:
    """128-bit hash of the line's key; null for a key that is too short."""
    key = line.strip(_BLANKS)
    if len(key) < MIN_CHARS:
        return None
    if len(key) < 4 * MIN_CHARS and not key.isascii() and len(key.decode("utf-8", "replace")) < MIN_CHARS:
        return None
    return xxhash.xxh3_128_digest(key.lower())


def _mixed(h: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


class PerfectHash:
    """Numbers n distinct 64-bit keys 0..n-1 with about 4 bits each: one bitmap per level.

    A key is placed on the first level where no other key wants its bit; its number is the
    count of bits before it.
    """

    def __init__(self, keys: np.ndarray):
        self.maps: list[np.ndarray] = []
        self.sizes: list[int] = []
        left = np.unique(keys)
        for level in range(_LEVELS):
            if not len(left):
                break
            size = int(max(64, _GAMMA * len(left)))
            at = (_mixed(left, level) % np.uint64(size)).astype(np.int64)
            single = np.bincount(at, minlength=size) == 1
            self.maps.append(np.packbits(single, bitorder="little"))
            self.sizes.append(size)
            left = left[~single[at]]
        self.rest = left  # empty but for a vanishing chance; searched after the levels
        bits = np.concatenate([np.unpackbits(m, count=s, bitorder="little") for m, s in zip(self.maps, self.sizes)] or [np.zeros(0, np.uint8)])
        self.first = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.bits = np.packbits(bits, bitorder="little")
        words = np.add.reduceat(bits, np.arange(0, len(bits), 512), dtype=np.int64) if len(bits) else np.zeros(0, np.int64)
        self.before = np.concatenate([[0], np.cumsum(words)]).astype(np.uint32)
        self.maps = []

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the keys; a key that was not among the n gets -1 or any number."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(left):
                return out
            at = self.first[level] + (_mixed(keys[left], level) % np.uint64(size)).astype(np.int64)
            hit = (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
            out[left[hit]] = self._rank(at[hit])
            left = left[~hit]
        if len(self.rest) and len(left):
            at = np.minimum(np.searchsorted(self.rest, keys[left]), len(self.rest) - 1)
            known = self.rest[at] == keys[left]
            out[left[known]] = self.before[-1] + at[known]
        return out

    def _rank(self, at: np.ndarray) -> np.ndarray:
        rank = self.before[at >> 9].astype(np.int64)
        begin = (at >> 9) << 6
        padded = np.concatenate([self.bits, np.zeros(64, np.uint8)])
        rows = padded[begin[:, None] + np.arange(64)] if len(at) else np.zeros((0, 64), np.uint8)
        whole = (at & 511) >> 3
        full = np.bitwise_count(rows)
        full[np.arange(64)[None, :] >= whole[:, None]] = 0
        last = padded[at >> 3] & ((1 << (at & 7)) - 1).astype(np.uint8)
        return rank + full.sum(1) + np.bitwise_count(last)


class Shard:
    """Arrays over the frequent keys of a shard, in the order of the perfect hash."""

    def __init__(self, low: np.ndarray, high: np.ndarray, counts: np.ndarray, keepers: np.ndarray):
        self.hash = PerfectHash(low)
        at = self.hash.index(low)
        n = len(low)
        self.fingerprints = np.zeros(n, np.uint64)
        self.counts = np.zeros(n, np.uint32)
        self.keepers = np.zeros(n, np.int64)
        self.fingerprints[at], self.counts[at], self.keepers[at] = high, np.minimum(counts, 2**32 - 1), keepers

    def probe(self, low: np.ndarray, high: np.ndarray, min_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are frequent, and their keepers."""
        if not len(self.counts):
            return np.zeros(len(low), bool), np.zeros(len(low), np.int64)
        at = self.hash.index(low)
        slot = np.maximum(at, 0)
        known = (at >= 0) & (self.fingerprints[slot] == high) & (self.counts[slot] >= min_docs)
        return known, self.keepers[slot]


_HASH_ROWS = pa.schema([("h", pa.binary()), ("n", pa.int64()), ("keeper", pa.int64())])


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys with documents and largest doc_id, summed over the rows of a piece."""
    for batch in batches:
        for piece in pieces(batch, limit=16 << 20):
            counts: dict[bytes, int] = {}
            keepers: dict[bytes, int] = {}
            for text, doc in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                doc = _NO_DOC if doc is None else doc
                if not text or len(text) < MIN_CHARS:
                    continue
                own = {key_hash(line) for line in text.split(b"\n")}
                own.discard(None)
                for h in own:
                    counts[h] = counts.get(h, 0) + 1
                    keepers[h] = max(keepers.get(h, doc), doc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.binary()), pa.array(list(counts.values())), pa.array([keepers[h] for h in counts])],
                schema=_HASH_ROWS,
            )


def frequent_keys(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(h, n, keeper) of the keys in at least ``min_docs`` documents, staged."""
    rows = docs.select(utf8(), F.col("doc_id").cast("long")).mapInArrow(_key_rows, "h binary, n long, keeper long")
    summed = rows.groupBy("h").agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper"))
    return stage(summed.where(F.col("n") >= min_docs), "frequent-lines")


def build_shards(keys: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """(shard, shards, index, bytes): one pickled ``Shard`` per row, staged. Keys are spread evenly by hash."""
    import pickle

    n = keys.count()
    shards = max(1, -(-n // shard_keys))
    number = F.pmod(F.conv(F.hex(F.substring("h", 1, 4)), 16, 10).cast("long"), F.lit(shards))

    def build(key, table):
        raw = np.frombuffer(b"".join(table.column("h").to_pylist()), "<u8").reshape(-1, 2)
        index = Shard(raw[:, 0].copy(), raw[:, 1].copy(), table.column("n").to_numpy(), table.column("keeper").to_numpy())
        data = pickle.dumps(index, 5)
        return pa.table({"shard": [key[0].as_py()], "index": pa.array([data], pa.binary()), "bytes": [len(data)]})

    built = keys.withColumn("shard", number).groupBy("shard").applyInArrow(build, "shard long, index binary, bytes long")
    return stage(built.withColumn("shards", F.lit(shards)), "line-shards")


def _blocks(shards: DataFrame, limit: int) -> Iterator[dict[int, bytes]]:
    sizes = sorted((r["shard"], r["bytes"]) for r in shards.select("shard", "bytes").collect())
    chosen, held = [], 0
    for at, (shard, size) in enumerate(sizes):
        chosen.append(shard)
        held += size
        if at == len(sizes) - 1 or held + sizes[at + 1][1] > limit:
            low, high = chosen[0], chosen[-1]
            yield {r["shard"]: bytes(r["index"]) for r in shards.where(F.col("shard").between(low, high)).collect()}
            chosen, held = [], 0


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with repeated lines gone from ``text``, and with n_lines and n_dropped."""
    spark = docs.sparkSession
    shards = build_shards(frequent_keys(docs, min_docs), shard_keys)
    first = shards.select("shards").first()
    count = first["shards"] if first else 1
    sent = [spark.sparkContext.broadcast(block) for block in _blocks(shards, block_bytes)]
    kept = [f for f in docs.schema if f.name not in ("text", "n_lines", "n_dropped")]
    names = [f.name for f in kept] + ["text", "n_lines", "n_dropped"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["text string, n_lines long, n_dropped long"])

    def run(batches):
        import pickle

        loaded: dict[int, dict[int, Shard]] = {}
        for batch in batches:
            for piece in pieces(batch, "_utf8", 16 << 20):
                lines = [(t or b"").split(b"\n") for t in piece.column(piece.num_columns - 1).to_pylist()]
                ids = piece.column(piece.num_columns - 2).to_pylist()
                places, hashes = [], []
                for i, own in enumerate(lines):
                    for j, line in enumerate(own):
                        h = key_hash(line)
                        if h is not None:
                            places.append((i, j))
                            hashes.append(h)
                raw = np.frombuffer(b"".join(hashes), "<u8").reshape(-1, 2)
                lead = np.frombuffer(b"".join(hashes), ">u4").reshape(-1, 4)[:, 0]
                owner = lead.astype(np.int64) % count
                doc = np.array([_NO_DOC if ids[i] is None else ids[i] for i, _ in places], np.int64)
                dropped = np.zeros(len(hashes), bool)
                for n, block in enumerate(sent):
                    if n not in loaded:
                        loaded.clear()  # one block in memory at a time
                        loaded[n] = {s: pickle.loads(data) for s, data in block.value.items()}
                    for s, index in loaded[n].items():
                        mine = np.flatnonzero(owner == s)
                        if len(mine):
                            known, keepers = index.probe(raw[mine, 0], raw[mine, 1], min_docs)
                            dropped[mine] = known & (keepers != doc[mine])
                gone: dict[int, set[int]] = {}
                for k in np.flatnonzero(dropped):
                    gone.setdefault(places[k][0], set()).add(places[k][1])
                texts = [
                    b"\n".join([x for j, x in enumerate(own) if j not in gone[i]] if i in gone else own) for i, own in enumerate(lines)
                ]
                columns = [piece.column(i) for i in range(len(kept))]
                columns += [
                    pa.array(texts, pa.binary()).cast(pa.string()),
                    pa.array([len(own) for own in lines], pa.int64()),
                    pa.array([len(gone.get(i, ())) for i in range(len(lines))], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    chosen = [f"`{f.name}`" for f in kept]
    return docs.select(*chosen, F.col("doc_id").cast("long").alias("_doc"), utf8().alias("_utf8")).mapInArrow(run, schema)
