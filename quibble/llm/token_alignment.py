"""Alignment of two tokenisations of the same bytes, and how often token pairs align in the corpus.

Both tokenizers cut a text into tokens that end at byte offsets. The shorter list of ends drives an
exponential and then a binary search into the longer one; ends found in both cut the text into
groups, and differences of the ranks of neighbouring common ends are the ranges of tokens of
either side that overlap there. All pairs of a group link.

Links are counted in two passes over bounded chunks of documents. The first tokenises each text
once and writes, per document, its pairs as numbers in the chunk's sorted list of distinct pairs,
and per chunk that list with the documents that hold each pair. Lists are summed by pair over all
chunks, and each chunk gets the sums of its own pairs back, so that what is shuffled is distinct
pairs of chunks, never one row per link.

Defined results: null and empty texts, and texts whose tokens of either side do not join to the
expected bytes (a literal U+2581, white space that a tokenizer folds), have no tokens and no
groups; strings of special tokens are plain text; a very long text is a chunk of its own; each
repeated row counts as a document; an empty table gives an empty one. ``align`` keeps other
columns, but replaces those named like its own.
"""

from __future__ import annotations

import codecs
import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quibble.llm.common import pieces
from quibble.llm.word_ids import WordIds
from quibble.sources.staging import stage

CHUNK_BYTES = 8 << 20  # text of a chunk
TOGETHER = 1 << 19  # bytes of text that are tokenised and aligned at once
STRIDE = 16  # ends of the shorter list from one search to the next
LARGE = 4096  # links of a group that is summed by distinct tokens
#: How byte-level tokenizers split texts, a fixed value.
USUAL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Between two pre-tokens: a byte that UTF-8 never has, and a character that maps no byte.
SURROGATE, MARK = "\udcff", "\u0200"


def _byte_characters() -> dict[str, int]:
    """The byte of each character of byte-level vocabularies: printable bytes are themselves, the rest follow U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = sorted(set(range(256)) - set(own))
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A byte-level tokenizer file; texts get a leading space.

    If the file splits texts by its usual pattern, they are split here. Words that the tokenizer is known to
    make one token of (``single``), or that came lately, are looked up; of all others the bytes are mapped, and the
    tokenizer only cuts at marks and merges. Texts with a character that the two patterns may class differently
    (``odd``) are left to the tokenizer, and a word whose bytes its tokens do not make up leaves its text without tokens.
    """

    def __init__(self, model: bytes, odd: str | None = None, single: list[int] = ()):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        self.tokenizer = tokenizers.Tokenizer.from_buffer(model)
        self.tokenizer.encode_special_tokens = True
        byte_of = _byte_characters()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.entries = [""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.entries[i] = entry
        self.tokens = [bytes(byte_of[c] for c in e) if all(c in byte_of for c in e) else e.encode() for e in self.entries]
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.odd = None if odd is None else re.compile(odd)
        self.pattern = regex.compile(USUAL_PATTERN)
        self.merger = tokenizers.Tokenizer.from_buffer(model)
        self.merger.encode_special_tokens = True
        self.merger.pre_tokenizer = tokenizers.pre_tokenizers.CharDelimiterSplit(MARK)
        self.mapped = "".join(sorted(byte_of, key=byte_of.get))[:255] + MARK  # UTF-8 has no byte 255
        words = {}
        for i in single:
            try:
                words[self.tokens[i].decode()] = i
            except UnicodeDecodeError:
                pass  # no word is a part of a character
        self.known = WordIds(words, self._merge)

    def singles(self) -> list[int]:
        """Ids whose entry alone becomes that one token."""
        encoded = self.merger.encode_batch_fast(self.entries, add_special_tokens=False)
        return [i for i, e in enumerate(encoded) if e.ids == [i]]

    def _merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words and their number; a word whose bytes the tokens do not make up has none."""
        raw = SURROGATE.join(words).encode("utf-8", "surrogateescape")
        mapped = codecs.charmap_decode(raw, "strict", self.mapped)[0]
        ids = np.array(self.merger.encode(mapped, add_special_tokens=False).ids, np.int32)
        marks = np.append(np.flatnonzero(np.frombuffer(raw, np.uint8) == 255), len(raw))
        ends = marks - np.arange(len(marks))  # of the words, in bytes without marks
        at = np.cumsum(self.sizes[ids])
        if len(at) and at[-1] == ends[-1] and (at[last := np.searchsorted(at, ends)] == ends).all():
            return ids, np.diff(last, prepend=-1)
        each = [np.array(e.ids, np.int32) for e in self.merger.encode_batch_fast(mapped.split(MARK), add_special_tokens=False)]
        each = [e if self.sizes[e].sum() == len(w.encode()) else e[:0] for e, w in zip(each, words)]
        return np.concatenate(each), np.array([len(e) for e in each], np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        texts = [" " + t for t in texts]
        usual = [self.odd is not None and (t.isascii() or not self.odd.search(t)) for t in texts]
        words = [self.pattern.findall(t) for t in itertools.compress(texts, usual)]
        ids, count = self.known.ids(list(itertools.chain.from_iterable(words)))
        ends = np.concatenate([[0], np.cumsum(count)])[np.cumsum([len(w) for w in words], dtype=np.int64)]
        by_words = iter(np.split(ids, ends[:-1])) if len(words) else iter(())
        rest = [t for t, u in zip(texts, usual) if not u]
        others = (np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False))
        return [next(by_words) if u else next(others) for u in usual]


def odd_characters(model: bytes) -> str | None:
    """A pattern of the characters that the file's splitter may class differently; None if it does not split as usual.

    Compared are the first plane and the symbols of the second, one character after the other, between
    a letter, a digit and a sign; all others count as odd.
    """
    tokenizer = tokenizers.Tokenizer.from_buffer(model)
    spec = json.loads(tokenizer.to_str())
    usual = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    splitter = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or spec.get("post_processor") and spec["post_processor"]["type"] != "ByteLevel":
        return None
    if any(splitter.get(k) != v for k, v in usual.items()):
        return None
    pattern, same = regex.compile(USUAL_PATTERN), []
    tried = [c for c in (*range(0x10000), *range(0x1F000, 0x20000)) if not 0xD800 <= c < 0xE000]
    for start in range(0, len(tried), 4096):
        some = tried[start : start + 4096]
        context = "".join(f"a{chr(c)}1{chr(c)}!" for c in some)
        cuts = [set(itertools.accumulate(map(len, pattern.findall(context))))]
        cuts.append({b for _, (_, b) in tokenizer.pre_tokenizer.pre_tokenize_str(context)})
        same += [c for k, c in enumerate(some) if len({tuple(5 * k + j in own for j in range(1, 6)) for own in cuts}) == 1]
    ranges, known = [], set(same)
    for c in sorted(known):
        if c - 1 not in known:
            ranges.append([c, c])
        ranges[-1][1] = c
    return "[^" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in ranges) + "]"


class Pieces:
    """A SentencePiece model that puts a space before the text by itself."""

    def __init__(self, model: bytes):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.tokens = [self._bytes(i) for i in range(self.processor.get_piece_size())]
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)

    def _bytes(self, i: int) -> bytes:
        piece = self.processor.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if self.processor.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int32) for ids in self.processor.encode(texts, out_type=int, num_threads=1)]


def _halve(values: np.ndarray, longer: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """First place of ``longer[left:right]`` that is not below the value, by halving all ranges together."""
    left, right = left.copy(), right.copy()
    for _ in range(int(np.max(right - left, initial=0)).bit_length()):
        middle = (left + right) >> 1
        less = (longer[np.minimum(middle, len(longer) - 1)] < values) & (middle < right)
        left = np.where(less, middle + 1, left)
        right = np.where(less, right, middle)
    return left


def gallop(values: np.ndarray, longer: np.ndarray, low: np.ndarray, high: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """For each value the first place of ``longer[low:high]``, which increases, that is not below it.

    All values search together: the distance to the guess doubles until the place is enclosed,
    then the enclosed range is halved.
    """
    left, right = low.copy(), high.copy()
    open_, step = np.arange(len(values)), 1
    while len(open_):
        a, b = np.maximum(guess[open_] - step, low[open_]), np.minimum(guess[open_] + step, high[open_])
        v = values[open_]
        below = (a == low[open_]) | (longer[a - 1] < v)
        above = (b == high[open_]) | (longer[np.minimum(b, len(longer) - 1)] >= v)
        # a bound that failed encloses the place from the other side
        left[open_] = np.where(above, np.where(below, a, left[open_]), b + 1)
        right[open_] = np.where(below, np.where(above, b, right[open_]), a - 1)
        open_, step = open_[~(below & above) & (left[open_] < right[open_])], step * 2
    return _halve(values, longer, left, right)


def common_ends(a: np.ndarray, a_from: np.ndarray, b: np.ndarray, b_from: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and ``b`` of the ends that both have.

    Ends count on over all documents; ``a_from`` and ``b_from`` have where each document's begin, and
    one past the last. In each document the shorter list drives.
    """
    n_a, n_b = np.diff(a_from), np.diff(b_from)
    found = []
    for short, s_from, n_s, longer, l_from, n_l, drives in (
        (a, a_from, n_a, b, b_from, n_b, n_a <= n_b),
        (b, b_from, n_b, a, a_from, n_a, n_a > n_b),
    ):
        doc = np.repeat(np.flatnonzero(drives), n_s[drives])
        if not len(doc):
            found.append((np.zeros(0, np.int64),) * 2)
            continue
        first = np.concatenate([[0], np.cumsum(n_s[drives])[:-1]])
        rank = np.arange(len(doc)) - np.repeat(first, n_s[drives])
        at = s_from[doc] + rank
        low, high = l_from[doc], l_from[doc + 1]
        place = np.empty(len(at), np.int64)
        lead = np.flatnonzero((rank % STRIDE == 0) | (rank == n_s[doc] - 1))
        place[lead] = gallop(short[at[lead]], longer, low[lead], high[lead], low[lead] + rank[lead] * n_l[doc[lead]] // n_s[doc[lead]])
        # the places of a stride lie between those of the values that lead it
        after = np.repeat(np.arange(len(lead)), np.diff(np.append(lead, len(at))))
        inner = np.setdiff1d(np.arange(len(at)), lead, assume_unique=True)
        before, behind = place[lead[after[inner]]], place[lead[np.minimum(after[inner] + 1, len(lead) - 1)]]
        place[inner] = _halve(short[at[inner]], longer, before, behind)
        both = (place < high) & (longer[np.minimum(place, len(longer) - 1)] == short[at])
        found.append((at[both], place[both]))
    (a1, b1), (b2, a2) = found
    at_a, at_b = np.concatenate([a1, a2]), np.concatenate([b1, b2])
    order = np.argsort(at_a, kind="stable")
    return at_a[order], at_b[order]


class Groups:
    """The groups of a list of texts: ids of both sides, and the ranks at which groups end."""

    def __init__(self, texts: list[bytes], one, two):
        sides = [[], []]
        own = [t.decode("utf-8", "replace") for t in texts]
        for raw, *both in zip(texts, *(side.encode(own) for side in (one, two))):
            expected = b" " + raw
            whole = raw and all(
                b"".join(map(side.tokens.__getitem__, ids.tolist())) == expected for side, ids in zip((one, two), both)
            )
            for kept, ids in zip(sides, both):
                kept.append(ids if whole else ids[:0])
        self.from_ = [np.concatenate([[0], np.cumsum([len(i) for i in side], dtype=np.int64)]).astype(np.int64) for side in sides]
        self.ids = [np.concatenate([np.zeros(0, np.int32), *side]) for side in sides]
        ends = [np.cumsum(side.sizes[i]) for side, i in zip((one, two), self.ids)]
        last = common_ends(ends[0], self.from_[0], ends[1], self.from_[1])
        self.ends = ends[0][last[0]]
        self.stop = [x + 1 for x in last]
        self.start = [np.concatenate([[0], x[:-1]]) for x in self.stop]
        self.doc = np.searchsorted(self.from_[0], last[0], side="right") - 1
        self.doc_from = np.searchsorted(self.doc, np.arange(len(texts) + 1))

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, pair, times); a pair is the id of either side in 32 bits. Small groups have one row per link."""
        n_a, n_b = (b - a for a, b in zip(self.start, self.stop))
        product = n_a * n_b
        small = np.flatnonzero(product <= LARGE)
        size, width = product[small], n_b[small]
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        down, across = np.divmod(inner, np.repeat(width, size))
        a = self.ids[0][np.repeat(self.start[0][small], size) + down].astype(np.int64)
        b = self.ids[1][np.repeat(self.start[1][small], size) + across]
        parts = [(np.repeat(self.doc[small], size), a << 32 | b, np.ones(len(a), np.int64))]
        for g in np.flatnonzero(product > LARGE):
            a, times_a = np.unique(self.ids[0][self.start[0][g] : self.stop[0][g]], return_counts=True)
            b, times_b = np.unique(self.ids[1][self.start[1][g] : self.stop[1][g]], return_counts=True)
            pair = (a.astype(np.int64)[:, None] << 32 | b[None, :]).ravel()
            parts.append((np.full(len(pair), self.doc[g]), pair, np.outer(times_a, times_b).ravel()))
        return tuple(np.concatenate(x) for x in zip(*parts))

    def as_text(self, numbers: list[np.ndarray]) -> list[str]:
        """Each document's groups as ``a1,a2|b1;a3|b2,b3``. ``numbers``: per side the ids as text, with ``,`` and with its mark."""
        n = [b - a for a, b in zip(self.start, self.stop)]
        at = [np.arange(len(i)) + np.repeat(other, own) for i, own, other in zip(self.ids, n, (self.start[1], self.stop[0]))]
        out = np.empty(sum(map(len, self.ids)), numbers[0].dtype)
        for side in (0, 1):
            ids = self.ids[side].astype(np.int64)
            ids[self.stop[side] - 1] += len(numbers[side]) // 2  # the last of its side in the group
            out[at[side]] = numbers[side][ids]
        raw = out.view(np.uint8).reshape(len(out), -1)
        used = raw != 0
        text = raw[used].tobytes().decode()
        ends = np.concatenate([[0], np.cumsum(used.sum(axis=1))])[self.from_[0] + self.from_[1]].tolist()
        return [text[i : max(i, j - 1)] for i, j in zip(ends, ends[1:])]


class Tokenizers:
    """The two model files, for tasks to open."""

    def __init__(self, byte_level: str, pieces_model: str):
        with open(byte_level, "rb") as one, open(pieces_model, "rb") as two:
            self.models = one.read(), two.read()
        self.odd = odd_characters(self.models[0])
        self.single = ByteLevel(self.models[0]).singles()

    def open(self) -> tuple[ByteLevel, Pieces]:
        return ByteLevel(self.models[0], self.odd, self.single), Pieces(self.models[1])


def _parts(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Runs of texts of about ``TOGETHER`` bytes."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > TOGETHER:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]


def _lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds - bounds[0], pa.int32()), pa.array(values, kind))


def _fields(df: DataFrame, without: set[str]) -> list[str]:
    return [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in without]


def align(docs: DataFrame, models: Tokenizers) -> DataFrame:
    """``docs`` without ``text``, with ``a_ids`` and ``b_ids`` and the groups: ``a_stop``, ``b_stop`` and ``stop``.

    Group g covers the ranks ``a_stop[g-1]`` to ``a_stop[g] - 1`` of side A, those of ``b_stop`` of side B, and
    ends at the byte offset ``stop[g]`` of the text.
    """
    added = ["a_ids", "b_ids", "a_stop", "b_stop", "stop"]
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = sent.value.open()
        for batch in batches:
            for piece in pieces(batch, limit=TOGETHER):
                g = Groups(_texts(piece), *sides)
                per = np.diff(g.doc_from)
                base = np.concatenate([[0], np.cumsum(np.bincount(g.doc, np.diff(np.concatenate([[0], g.ends])), len(per)))])
                columns = [piece.column(i) for i, n in enumerate(piece.schema.names) if n != "text" and n not in added]
                columns += [_lists(g.ids[s], g.from_[s], pa.int32()) for s in (0, 1)]
                columns += [_lists(g.stop[s] - np.repeat(g.from_[s][:-1], per), g.doc_from, pa.int32()) for s in (0, 1)]
                columns.append(_lists(g.ends - np.repeat(base[:-1].astype(np.int64), per) - 1, g.doc_from, pa.int64()))
                names = [n for n in piece.schema.names if n != "text" and n not in added]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *added])

    kinds = ["array<int>"] * 4 + ["array<bigint>"]
    schema = _fields(docs, {"text", *added}) + [f"{n} {k}" for n, k in zip(added, kinds)]
    return docs.withColumn("text", F.col("text").cast("binary")).mapInArrow(run, ", ".join(schema))


# --- counts of the corpus --------------------------------------------------------------

COUNTED = ("n_a", "n_b", "n_groups", "n_links")


def _per_document(doc: np.ndarray, pair: np.ndarray, times: np.ndarray, n_b: int) -> tuple[np.ndarray, ...]:
    """(document, pair, times) with one row per document and pair, in this order."""
    dense = (pair >> 32) * n_b + (pair & 0xFFFFFFFF)  # a part has few documents, so that both fit 63 bits
    wide = int(dense.max(initial=0)) + 1
    key = doc * wide + dense
    if (times == 1).all():
        key.sort()
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        total = np.diff(np.append(starts, len(key)))
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        total = np.add.reduceat(times[order], starts) if len(starts) else times
    doc, dense = np.divmod(key[starts], wide)
    return doc, (dense // n_b) << 32 | dense % n_b, total


def _pack(values: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes each as the largest needs, after one byte that says how many."""
    top = int(values.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def _first_pass(docs: DataFrame, models: Tokenizers, kept: list[str]) -> DataFrame:
    """Rows of documents (``kept``, counts, ``groups``, ``_pairs``, ``_times``) and of chunks (null counts, their distinct pairs)."""
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = sent.value.open()
        numbers = [
            np.array([f"{i}{m}" for m in (",", end) for i in range(len(side.tokens))], "S8") for side, end in ((one, "|"), (two, ";"))
        ]
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in pieces(batch, limit=CHUNK_BYTES):
                counts, groups, parts, first = [], [], [], 0
                for texts in _parts(_texts(piece)):
                    g = Groups(texts, one, two)
                    doc, pair, times = g.links()
                    n_links = np.bincount(doc, times, len(texts))
                    counts.append(np.stack([np.diff(g.from_[0]), np.diff(g.from_[1]), np.diff(g.doc_from), n_links]).astype(np.int64))
                    groups += g.as_text(numbers)
                    doc, pair, total = _per_document(doc, pair, times, len(two.tokens))
                    parts.append((doc + first, pair, total))
                    first += len(texts)
                doc, pair, times = (np.concatenate(x) for x in zip(*parts))
                distinct, number, holders = np.unique(pair, return_inverse=True, return_counts=True)
                bounds = np.searchsorted(doc, np.arange(first + 1))
                steps = [np.diff(number[a:b], prepend=0) for a, b in zip(bounds, bounds[1:])]
                counts = np.concatenate(counts, axis=1)
                own = {n: piece.column(piece.schema.get_field_index(n)) for n in kept}
                own |= {n: pa.array(counts[i]) for i, n in enumerate(COUNTED)}
                own |= {
                    "groups": pa.array(groups, pa.string()), "_chunk": pa.array(np.full(first, chunk)),
                    "_pairs": pa.array([_pack(s) for s in steps], pa.binary()),
                    "_times": pa.array([_pack(times[a:b]) for a, b in zip(bounds, bounds[1:])], pa.binary()),
                }
                yield pa.RecordBatch.from_pydict(own)
                of_chunk = {"_chunk": [chunk], "_pairs": [distinct.tobytes()], "_times": [holders.astype(np.int64).tobytes()]}
                yield pa.RecordBatch.from_pydict({n: pa.array(of_chunk.get(n, [None]), c.type) for n, c in own.items()})
                chunk += 1

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept]
    schema += [f"{n} long" for n in COUNTED] + ["groups string", "_chunk long", "_pairs binary", "_times binary"]
    return docs.withColumn("text", F.col("text").cast("binary")).mapInArrow(run, ", ".join(schema))


def _pairs_of_chunks(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, pairs, n in zip(*(c.to_pylist() for c in batch.columns)):
                pair = np.frombuffer(pairs, np.int64)
                columns = [pa.array(np.full(len(pair), chunk)), pa.array(pair), pa.array(np.frombuffer(n, np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["_chunk", "pair", "n"])

    return rows.where("n_a is null").select("_chunk", "_pairs", "_times").mapInArrow(run, "_chunk long, pair long, n long")


def pair_counts(of_chunks: DataFrame) -> DataFrame:
    """(pair, n, best): in how many documents a pair is linked, and whether no pair of its A id is in more."""
    counts = stage(of_chunks.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    counts = counts.withColumn("a_id", F.shiftright("pair", 32))
    highest = counts.groupBy("a_id").agg(F.max("n").alias("most"))  # one row per id of the vocabulary
    return counts.join(highest, "a_id").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def count_links(docs: DataFrame, models: Tokenizers, kept: list[str], groups: dict) -> DataFrame:
    """Columns ``kept`` of each document with n_a, n_b, n_groups, n_links, and over all its links n_best and count_sum.

    A link counts in how many documents of ``docs`` its pair of ids is linked; n_best are links with the
    highest count of their A id, ties included. ``groups`` names further columns, expressions over
    ``groups``, the document's groups as text (``a1,a2|b1;a3|b2,b3``), which itself is not written.
    """
    own = {n: f"_kept{i}" for i, n in enumerate(kept)}  # so that no name clashes
    given = docs.select(*[F.col(f"`{n}`").alias(o) for n, o in own.items()], "text")
    rows = _first_pass(given, models, list(own.values()))
    more = {f"_more{i}": (n, c) for i, (n, c) in enumerate(groups.items())}
    columns = [*own.values(), *COUNTED, "_chunk", "_pairs", "_times"]
    rows = stage(rows.select(*columns, *[c.alias(o) for o, (_, c) in more.items()]), "aligned")
    of_chunks = _pairs_of_chunks(rows)
    counted = pair_counts(of_chunks).join(of_chunks.select("_chunk", "pair"), "pair").select("_chunk", "pair", "n", "best")
    out = [*own.values(), *COUNTED, *more]

    def put(documents: pa.Table, pairs: pa.Table) -> pa.Table:
        order = np.argsort(pairs["pair"].to_numpy())
        n = pairs["n"].to_numpy()[order]
        best = pairs["best"].to_numpy()[order]
        sums = np.zeros((2, documents.num_rows), np.int64)
        for i, (steps, times) in enumerate(zip(documents["_pairs"], documents["_times"])):
            number, t = np.cumsum(_unpack(steps.as_py())), _unpack(times.as_py())
            sums[:, i] = t[best[number]].sum(), (t * n[number]).sum()
        table = documents.select(out)
        return table.append_column("n_best", pa.array(sums[0])).append_column("count_sum", pa.array(sums[1]))

    documents = rows.where("n_a is not null")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for n in out for f in documents.schema if f.name == n)
    joined = documents.groupBy("_chunk").cogroup(counted.groupBy("_chunk")).applyInArrow(put, schema + ", n_best long, count_sum long")
    names = {o: n for n, o in own.items()} | {o: n for o, (n, _) in more.items()}
    return joined.select(*[F.col(c).alias(names.get(c, c)) for c in (*own.values(), *COUNTED, "n_best", "count_sum", *more)])
