"""Benchmark decontamination with one Aho-Corasick automaton.

Words are runs of letters, digits and non-ASCII characters after lower-casing
A-Z. Ten consecutive words of a benchmark item are a window; an item with fewer
is one window. All windows go into one automaton, each document is normalised
and scanned once, and the words inside any occurrence are hit. Positions in the
normalised text are mapped back to character offsets of the original text.

The benchmark is the stated query set: it is read in blocks of at most
``BLOCK_BYTES`` of windows, and a block is the only thing that is broadcast.
Where it has more than one block, a task scans its rows with one after another.

Defined results: a null text has no words; an item without words has no window;
items that share a window are all reported; repeated rows are judged alike;
an empty benchmark hits nothing. Other columns of the documents are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quibble.llm.common import pieces, utf8

WINDOW = 10
BLOCK_BYTES = 32 << 20

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_PLAIN = bytes(
    b + 32 if 65 <= b <= 90 else (b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32) for b in range(256)
)
_RESULT = "n_words long, n_hit long, n_items long, items array<string>, spans array<struct<start:int,stop:int>>"
_RESULT_ARROW = [
    ("n_words", pa.int64()),
    ("n_hit", pa.int64()),
    ("n_items", pa.int64()),
    ("items", pa.list_(pa.string())),
    ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
]


def words_of(text: bytes | None) -> list[bytes]:
    """Normalised words; every byte from 128 on belongs to a non-ASCII character."""
    return (text or b"").translate(_PLAIN).split()


def windows_of(text: bytes | None, width: int = WINDOW) -> list[list[bytes]]:
    words = words_of(text)
    if not words:
        return []
    return [words[i : i + width] for i in range(max(1, len(words) - width + 1))]


def blocks(benchmark: DataFrame, width: int = WINDOW, limit: int = BLOCK_BYTES) -> Iterator[dict[bytes, list[str]]]:
    """Windows with the items that hold them, in blocks of bounded size."""
    block, held = {}, 0
    for item, text in benchmark.select(benchmark["item_id"].cast("string"), utf8()).toLocalIterator():
        if item is None:
            continue
        for window in windows_of(bytes(text) if text is not None else None, width):
            key = b" " + b" ".join(window) + b" "
            items = block.setdefault(key, [])
            if item not in items:
                items.append(item)
                held += len(key) + len(item)
        if held >= limit:
            yield block
            block, held = {}, 0
    if block:
        yield block


def automaton(block: dict[bytes, list[str]]) -> ahocorasick.Automaton:
    """Every byte is one character of the automaton, so that it needs no second encoding."""
    a = ahocorasick.Automaton()
    for key, items in block.items():
        a.add_word(key.decode("latin-1"), (key.count(b" ") - 1, items))
    a.make_automaton()
    return a


def occurrences(words: list[bytes], a: ahocorasick.Automaton) -> list[tuple[int, int, list[str]]]:
    """(first word, word after the last, items) of every occurrence."""
    norm = (b" " + b" ".join(words) + b" ").decode("latin-1")
    found = list(a.iter(norm))
    if not found:
        return []
    ends = np.cumsum([len(w) + 1 for w in words])  # place of the blank after each word
    stops = np.searchsorted(ends, [end for end, _ in found]) + 1
    return [(int(stop) - n, int(stop), items) for stop, (_, (n, items)) in zip(stops, found)]


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, stop in sorted(runs):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [tuple(r) for r in out]


def original_spans(text: bytes, runs: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Word runs as character offsets of the original text."""
    places = [m.span() for m in _WORD.finditer(text)]
    spans, at, chars = [], 0, 0
    for first, stop in runs:
        out = []
        for byte in (places[first][0], places[stop - 1][1]):
            chars += len(text[at:byte].decode("utf-8", "replace"))
            at = byte
            out.append(chars)
        spans.append({"start": out[0], "stop": out[1]})
    return spans


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items and spans; a column of one of these names is replaced."""
    sc = docs.sparkSession.sparkContext
    sent = [sc.broadcast(block) for block in blocks(benchmark, width)]
    added = [name for name, _ in _RESULT_ARROW]
    kept = [f for f in docs.schema if f.name not in added]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [_RESULT])

    def scan(batches):
        ready: dict[int, ahocorasick.Automaton] = {}
        for batch in batches:
            for piece in pieces(batch, "_utf8", 32 << 20):
                texts = piece.column(piece.num_columns - 1).to_pylist()
                words = [words_of(t) for t in texts]
                runs: list[list] = [[] for _ in texts]
                for n, block in enumerate(sent):
                    if n not in ready:
                        ready.clear()  # one automaton in memory at a time
                        ready[n] = automaton(block.value)
                    for i, w in enumerate(words):
                        if w:
                            runs[i] += occurrences(w, ready[n])
                joined = [merged([(a, b) for a, b, _ in r]) for r in runs]
                items = [sorted({x for _, _, held in r for x in held}) for r in runs]
                values = {
                    "n_words": [len(w) for w in words],
                    "n_hit": [sum(b - a for a, b in r) for r in joined],
                    "n_items": [len(x) for x in items],
                    "items": items,
                    "spans": [original_spans(t, r) if r else [] for t, r in zip(texts, joined)],
                }
                columns = [piece.column(i) for i in range(len(kept))]
                columns += [pa.array(values[name], kind) for name, kind in _RESULT_ARROW]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in kept] + added)

    return docs.select(*[f"`{f.name}`" for f in kept], utf8().alias("_utf8")).mapInArrow(scan, schema)
