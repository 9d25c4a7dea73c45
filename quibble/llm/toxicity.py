"""Toxicity by a gap-tolerant string-kernel machine with Nystroem landmarks.

The kernel of two strings counts the subsequences of four characters they share,
two of them letters at least and not both of the first two blank. A subsequence
may skip one character between any two of its own, at the price of ``GAP`` per
skip, so an insult keeps most of its features when characters are put between
its letters. Both counts are divided by the root of the length.

A support vector machine is fitted on the Nystroem features of words taken from
labelled sentences. Because the kernel is an inner product of subsequence
counts, the fitted expansion over landmarks collapses into one weight per
subsequence: scoring is eight table look-ups per character and no landmark is
touched again. A document is judged by its best window, wherever it lies.

Defined results: a null or empty text has no window and gets the score of the
calibration's lowest input; repeated rows get equal scores; other columns of
the input are kept, also one named ``score`` in the labels table. Without
labels of both classes every score is the share of toxic labels (0 without any).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quibble.llm.common import PIECE_BYTES, arrow_batch, bytes_and_offsets, labelled_sample, logistic, pieces, utf8
from quibble.sources.staging import stage

GAP = 0.75
SYMBOLS = 32
PAD = 32  # zeros around each text, longer than any window and subsequence together
WINDOWS = (6, 7, 8, 10, 12, 16, 20)
APART = 24  # characters between the best window and the second best
LANDMARKS = 256
WORDS = 20_000
PER_CLASS = 6_000
FLOOR = -3.0

_DROP = 255
_TABLE = np.zeros(256, np.uint8)
_TABLE[65:91] = _TABLE[97:123] = np.arange(1, 27)
_TABLE[128:192] = 27 + np.arange(64) % 5
_TABLE[192:] = _DROP  # the first byte of a longer character says little


def symbols(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts as symbols 0..31 (0: no letter, runs of it once) with ``PAD`` zeros between; starts and ends."""
    s = _TABLE[data]
    before = np.empty_like(s)
    before[1:] = s[:-1]
    before[bounds[:-1][bounds[:-1] < len(s)]] = 0
    if len(s):
        before[0] = 0
    keep = (s != _DROP) & ((s != 0) | (before != 0))
    placed = np.concatenate([[0], np.cumsum(keep)])[bounds]
    shift = PAD * (1 + np.arange(len(bounds) - 1))
    out = np.zeros(placed[-1] + PAD * len(bounds), np.uint8)
    lengths = np.diff(placed)
    out[np.arange(placed[-1]) + np.repeat(shift, lengths)] = s[keep]
    return out, placed[:-1] + shift, placed[1:] + shift


def _codes(s: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Code of the subsequence that starts at each place, for all eight gap patterns; number of gaps."""
    n = len(s) - 6
    s = s.astype(np.int32)
    for a in (1, 2):
        two = s[:n] * SYMBOLS + s[a : a + n]
        for b in (1, 2):
            three = two * SYMBOLS + s[a + b : a + b + n]
            for c in (1, 2):
                yield three * SYMBOLS + s[a + b + c : a + b + c + n], a + b + c - 3


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, subsequence code, value) of all words, blanks around them, scaled by length."""
    raw = [w.encode() for w in words]
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    s, starts, ends = symbols(np.frombuffer(b"".join(raw), np.uint8), bounds)
    owner = np.full(len(s), -1)
    for i, (a, b) in enumerate(zip(starts, ends)):
        owner[a - 1 : b + 1] = i
    rows, codes, values = [], [], []
    scale = 1 / np.sqrt(ends - starts + 2.0)
    for code, gaps in _codes(s):
        last = owner[3 + gaps : 3 + gaps + len(code)]
        blanks = sum((code >> shift) % SYMBOLS == 0 for shift in (0, 5, 10, 15))
        at = np.flatnonzero((owner[: len(code)] >= 0) & (owner[: len(code)] == last) & (blanks < 3) & (code >= SYMBOLS * SYMBOLS))
        rows.append(owner[at])
        codes.append(code[at])
        values.append(GAP**gaps * scale[owner[at]])
    return np.concatenate(rows), np.concatenate(codes), np.concatenate(values)


def _dense(features, n: int, columns: np.ndarray) -> np.ndarray:
    rows, codes, values = features
    at = np.searchsorted(columns, codes)
    at[at == len(columns)] = 0
    known = columns[at] == codes if len(columns) else np.zeros(0, bool)
    flat = np.bincount(rows[known] * len(columns) + at[known], values[known], n * len(columns))
    return flat.reshape(n, len(columns))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # per subsequence
    bias: float
    calibration: np.ndarray

    def probability(self, best: np.ndarray, second: np.ndarray) -> np.ndarray:
        z = np.column_stack([best, second, np.ones(len(best))]) @ self.calibration
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _with_gaps(words, toxic, clean, counts_as):
    """The surest toxic words and the most usual clean ones once more, spelled with blanks and with a letter put in.

    They carry a fifth of the word's sentences, so the machine learns what a gap may look like on both sides.
    """
    long = np.array([len(w) >= 5 for w in words])
    sure = np.flatnonzero(long & (toxic >= 5) & (toxic > 20 * clean))
    usual = np.flatnonzero(long & (clean > toxic))
    usual = usual[np.argsort(-clean[usual], kind="stable")][: 4 * max(16, len(sure))]
    more, source = [], []
    for i in [*sure, *usual]:
        w = words[i]
        for spelled in (" ".join(w), w[: len(w) // 2] + "x" + w[len(w) // 2 :], w[:2] + "-" + w[2:]):
            more.append(spelled)
            source.append(i)
    source = np.array(source, int)
    every = lambda x, share=1.0: np.concatenate([x, share * x[source]])
    return [*words, *more], every(toxic, 0.2), every(clean, 0.2), every(counts_as)


def fit_words(
    words: list[str], toxic: np.ndarray, clean: np.ndarray, counts_as: np.ndarray, landmarks: int = LANDMARKS
) -> tuple[np.ndarray, float]:
    """Weights per subsequence and bias, from words with the toxic and clean sentences that hold them.

    ``counts_as``: the number of words that each one stands for.
    """
    words, toxic, clean, counts_as = _with_gaps(words, toxic, clean, counts_as)
    t, c = toxic + 0.5, clean + 0.5
    lift = toxic * (np.log(t / t.sum()) - np.log(c / c.sum()))
    chosen = list(dict.fromkeys([*np.argsort(-lift, kind="stable")[: landmarks * 3 // 4], *np.argsort(-clean, kind="stable")[: landmarks // 4]]))
    marks = _features([words[i] for i in chosen])
    columns = np.unique(marks[1])
    phi = _dense(marks, len(chosen), columns)
    values, vectors = np.linalg.eigh(phi @ phi.T)
    kept = values > 1e-8 * max(values.max(initial=0), 1e-12)
    root = vectors[:, kept] / np.sqrt(values[kept])
    parts = [words[i : i + 200] for i in range(0, len(words), 200)]  # bounds the driver's memory
    z = np.concatenate([(_dense(_features(part), len(part), columns) @ phi.T) @ root for part in parts])
    # Each word counts once per class, with the sentences of that class.
    x = np.column_stack([np.vstack([z, z]), np.ones(2 * len(z))])
    y = np.concatenate([np.ones(len(z)), -np.ones(len(z))])
    weight = np.concatenate([toxic, clean]) * np.concatenate([counts_as, counts_as])
    w = np.zeros(x.shape[1])
    penalty = np.eye(x.shape[1]) * 1e-2
    penalty[-1, -1] = 1e-6
    for _ in range(30):  # Newton steps of the squared hinge loss
        inside = (y * (x @ w) < 1) & (weight > 0)
        xi = x[inside] * weight[inside, None]
        new = np.linalg.solve(xi.T @ x[inside] + penalty, xi.T @ y[inside])
        done = np.abs(new - w).max() < 1e-6
        w = new
        if done:
            break
    alpha = root @ w[:-1]
    table = np.zeros(SYMBOLS**4, np.float32)
    table[columns] = alpha @ phi
    return table, float(w[-1])


def window_scores(batch: pa.RecordBatch, weights: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
    """Best window of each text, and the best one at least ``APART`` characters off."""
    data, bounds = bytes_and_offsets(batch.column(batch.schema.get_field_index("text")))
    s, starts, ends = symbols(data, bounds)
    score = np.full(len(s), FLOOR, np.float32)
    longest, step = max(WINDOWS), 1 << 17
    for at in range(0, len(s), step):
        part = s[at : at + step + longest + 6]
        local = np.zeros((4, max(0, len(part) - 6)), np.float32)
        for code, gaps in _codes(part):
            local[gaps] += weights.take(code) * np.float32(GAP**gaps)
        sums = np.zeros((4, local.shape[1] + 1))
        np.cumsum(local, axis=1, out=sums[:, 1:])
        places = min(step, max(0, local.shape[1] - longest))
        own = score[at : at + places]
        for n in WINDOWS:  # the subsequences that begin and end in the n characters
            got = np.zeros(places)
            for gaps in range(min(4, n - 3)):
                got += sums[gaps, n - 3 - gaps : n - 3 - gaps + places]
                got -= sums[gaps, :places]
            np.maximum(own, got / np.sqrt(n) + bias, out=own, casting="same_kind")
    best, second = np.full(len(starts), FLOOR, np.float32), np.full(len(starts), FLOOR, np.float32)
    for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
        if a == b:
            continue
        own = score[a - 1 : b]
        at = int(own.argmax())
        best[i] = own[at]
        for rest in (own[: max(0, at - APART)], own[at + APART :]):
            if len(rest):
                second[i] = max(second[i], rest.max())
    return best, second


_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE_END = re.compile(r"[.!?\n]+")
_COUNTED = pa.schema([("word", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])
_WINDOWS = pa.schema([("label", pa.int32()), ("best", pa.float32()), ("second", pa.float32())])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sentences of each label that hold a word, summed per batch."""
    for batch in batches:
        counts = (Counter(), Counter())
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for sentence in _SENTENCE_END.split((text or b"").decode("utf-8", "replace").lower()):
                counts[label].update({w for w in _WORD.findall(sentence) if len(w) <= 40})
        words = sorted(counts[0].keys() | counts[1].keys())
        yield arrow_batch({"word": words, "toxic": [counts[1][w] for w in words], "clean": [counts[0][w] for w in words]}, _COUNTED)


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, per_class: int = PER_CLASS, words: int = WORDS) -> Model:
    """Fit on at most ``per_class`` labelled documents of each class (a documented bound).

    Three quarters of them give the words, the rest calibrates the window scores. At most
    ``2 * words`` words with their counts and ``per_class`` pairs of window scores reach the driver.
    """
    sample = labelled_sample(docs, labels, "toxic", modulus, held_out, per_class, seed=1)
    spark = docs.sparkSession
    quarter = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(4))
    counted = stage(
        sample.where(quarter > 0)
        .select(utf8(), "label")
        .mapInArrow(_count_words, "word string, toxic long, clean long")
        .groupBy("word")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")),
        "words",
    )
    # The words of most toxic sentences, and an even sample of all others that stands for them.
    most = [tuple(r) for r in counted.orderBy(F.desc("toxic"), "clean", "word").limit(words // 3).collect()]
    named = {r[0] for r in most}
    even = counted.orderBy(F.xxhash64("word"), "word").limit(words).collect()
    even = [tuple(r) for r in even if r[0] not in named][: words - len(most)]
    stands_for = (counted.count() - len(most)) / max(1, len(even))
    rows = most + even
    toxic, clean = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)
    weight = np.repeat([1.0, stands_for], [len(most), len(even)])
    if not rows or toxic.sum() == 0 or clean.sum() == 0:
        shares = sample.agg(F.avg("label")).first()[0] or 0.0
        flat = np.array([0, 0, np.log(max(shares, 1e-13) / max(1 - shares, 1e-13))])
        return Model(np.zeros(SYMBOLS**4, np.float32), 0.0, flat)
    weights, bias = fit_words([r[0] for r in rows], toxic, clean, weight)
    sent = spark.sparkContext.broadcast(weights)

    def windows(batches):
        for batch in batches:
            for piece in pieces(batch):
                best, second = window_scores(piece, sent.value, bias)
                yield arrow_batch({"label": piece.column(1), "best": best, "second": second}, _WINDOWS)

    seen = sample.where(quarter == 0).select(utf8(), "label").mapInArrow(windows, "label int, best float, second float")
    seen = np.array([tuple(r) for r in seen.collect()], float).reshape(-1, 3)
    if len(np.unique(seen[:, 0])) < 2:  # too few labels to calibrate with
        beta = np.array([4.0, 0.0, -1.0])
    else:
        beta = logistic(seen[:, 1:], seen[:, 0], ridge=0.1)
    return Model(weights, bias, beta)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``score`` from 0 to 1, and ``best_window`` and ``second_window``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema if f.name not in (text, "score", "best_window", "second_window")]
    added = "score double, best_window float, second_window float"
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [added])

    def scored(batches):
        m = sent.value
        for batch in batches:
            for piece in pieces(batch, limit=PIECE_BYTES):
                best, second = window_scores(piece, m.weights, m.bias)
                columns = [piece.column(i) for i in range(len(kept))]
                more = [pa.array(m.probability(best, second)), pa.array(best), pa.array(second)]
                yield pa.RecordBatch.from_arrays(
                    columns + more, names=[f.name for f in kept] + ["score", "best_window", "second_window"]
                )

    return docs.select(*[f"`{f.name}`" for f in kept], utf8(text).alias("text")).mapInArrow(scored, schema)
