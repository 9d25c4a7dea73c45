"""Quality classifier: random Fourier features over document statistics.

Statistics of a document (lengths, shares of character classes, repetition of
words and lines) are standardised and sent through random Fourier features,
which approximate a Gaussian kernel. The normal equations of a ridge regression
on these features are sums over rows, so every partition adds up its own and
Spark sums the partitions. Isotonic calibration on rows the ridge did not see
turns its output into a probability; its steps are joined by straight lines.

Defined results: a null text counts as empty, and an empty text has all
statistics zero and is scored by them; without labels of both classes every
score is the share of label 1 (0 without labels). Ties and repeated rows get
equal scores; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quibble.llm.common import bytes_and_offsets, labelled_sample, pieces, utf8
from quibble.sources.staging import stage

FEATURES = 256
WIDTH = 2.0  # of the Gaussian kernel, in standard deviations per statistic
RIDGE = 1e-3
PER_CLASS = 8_000
CALIBRATION_BINS = 512

STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "symbol", "bang", "stop", "comma", "pipe", "blank",
    "non_ascii", "other", "distinct", "repeated_next", "line_words", "repeated_lines", "longest_word",
)

_CLASSES = ("lower", "upper", "digit", "symbol", "bang", "stop", "comma", "pipe", "blank", "newline", "non_ascii", "other")
_CLASS = np.full(256, _CLASSES.index("other"), np.uint8)
for _name, _chars in {
    "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "symbol": b"#*$%&<>=@^~", "bang": b"!?",
    "stop": b".", "comma": b",;:", "pipe": b"|", "blank": b" \t\r\x0b\x0c", "newline": b"\n", "non_ascii": range(128, 256),
}.items():
    _CLASS[list(_chars)] = _CLASSES.index(_name)


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` for each text."""
    data, bounds = bytes_and_offsets(texts)
    n, k = len(bounds) - 1, len(_CLASSES)
    sizes = np.diff(bounds)
    counts = np.zeros((n, k))
    for i in range(n):
        counts[i] = np.bincount(_CLASS[data[bounds[i] : bounds[i + 1]]], minlength=k)
    share = dict(zip(_CLASSES, (counts / np.maximum(sizes, 1)[:, None]).T))
    out = np.zeros((n, len(STATISTICS)))
    for name in ("upper", "digit", "symbol", "bang", "stop", "comma", "pipe", "blank", "non_ascii", "other"):
        out[:, STATISTICS.index(name)] = share[name]
    for i, text in enumerate(texts.to_pylist()):
        words = (text or b"").split()
        if not words:
            continue
        lines = [x for x in text.split(b"\n") if x.strip()]
        m = len(words)
        own = {
            "log_bytes": np.log1p(len(text)), "log_words": np.log1p(m), "word_bytes": sum(map(len, words)) / m / 10,
            "distinct": len(set(words)) / m, "repeated_next": sum(map(eq, words, words[1:])) / m,
            "line_words": np.log1p(m / len(lines)), "repeated_lines": 1 - len(set(lines)) / len(lines),
            "longest_word": np.log1p(max(map(len, words))),
        }
        for name, value in own.items():
            out[i, STATISTICS.index(name)] = value
    return out


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    ridge: np.ndarray
    steps: np.ndarray  # ridge outputs
    values: np.ndarray  # calibrated, not falling

    def fourier(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.directions + self.phases
        return np.column_stack([np.sqrt(2 / len(self.phases)) * np.cos(z), np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.ridge

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.steps, self.values)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over rows in order of ``x``: block means of x and y."""
    blocks: list[list[float]] = []
    for xi, yi, w in zip(x, y, weight):
        blocks.append([xi, yi, w])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            (xa, ya, wa), (xb, yb, wb) = blocks[-2:]
            blocks[-2:] = [[(xa * wa + xb * wb) / (wa + wb), (ya * wa + yb * wb) / (wa + wb), wa + wb]]
    return np.array([b[0] for b in blocks]), np.array([b[1] for b in blocks])


def _summed(df: DataFrame, function, size: int) -> np.ndarray:
    """Sum over all partitions of the arrays that ``function`` makes of batches, block by block."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += function(batch)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["i", "v"])

    rows = df.mapInArrow(partial, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size)
    for i, v in rows:
        out[i] = v
    return out


def fit(
    docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0, per_class: int = PER_CLASS, seed: int = 7
) -> Model:
    """Fit on at most ``per_class`` labelled documents of each class (a documented bound).

    Three quarters of them give the ridge, the rest the calibration. Only sums whose size
    does not depend on the rows reach the driver.
    """
    sample = labelled_sample(docs, labels, "quality", modulus, held_out, per_class, seed=4)
    k = len(STATISTICS)

    def measure(batches):
        for batch in batches:
            for piece in pieces(batch):
                x = statistics(piece.column(0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(x), pa.list_(pa.float64())), piece.column(1), piece.column(2)], names=["x", "label", "part"]
                )

    part = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(4)).cast("int").alias("part")
    rows = stage(
        sample.select(utf8(), "label", part).mapInArrow(measure, "x array<double>, label int, part int"), "statistics"
    )

    def matrix(batch) -> tuple[np.ndarray, np.ndarray]:
        flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(-1, k), batch.column(1).to_numpy(zero_copy_only=False).astype(float)

    def moments(batch):
        x, y = matrix(batch)
        return np.concatenate([x.sum(0), (x * x).sum(0), [len(x), y.sum()]])

    m = _summed(rows, moments, 2 * k + 2)
    n = max(1.0, m[-2])
    mean = m[:k] / n
    scale = np.sqrt(np.maximum(m[k : 2 * k] / n - mean**2, 1e-8))
    rng = np.random.default_rng(seed)
    directions = rng.normal(size=(k, FEATURES)) / (WIDTH * np.sqrt(k))
    phases = rng.uniform(0, 2 * np.pi, FEATURES)
    if m[-1] in (0, m[-2]):
        flat = np.full(2, m[-1] / n)
        return Model(mean, scale, directions, phases, np.zeros(FEATURES + 1), np.array([0.0, 1.0]), flat)
    half = Model(mean, scale, directions, phases, np.zeros(FEATURES + 1), np.zeros(1), np.zeros(1))
    size = FEATURES + 1

    def equations(batch):
        x, y = matrix(batch)
        z = half.fourier(x)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    sums = _summed(rows.where("part > 0"), equations, size * size + size)
    gram, right = sums[: size * size].reshape(size, size), sums[size * size :]
    ridge = np.linalg.solve(gram + RIDGE * n / FEATURES * np.eye(size), right)
    fitted = Model(mean, scale, directions, phases, ridge, np.zeros(1), np.zeros(1))
    low, high = -0.5, 1.5
    bins = CALIBRATION_BINS

    def binned(batch):
        x, y = matrix(batch)
        raw = fitted.raw(x)
        at = np.clip((raw - low) / (high - low) * bins, 0, bins - 1).astype(int)
        return np.concatenate([np.bincount(at, minlength=bins), np.bincount(at, y, bins), np.bincount(at, raw, bins)])

    count, ones, total = _summed(rows.where("part = 0"), binned, 3 * bins).reshape(3, bins)
    used = count > 0
    if not used.any():
        return Model(mean, scale, directions, phases, ridge, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    # The sample may hold the classes in other shares than the labels: one class is not weighed against the other.
    steps, values = isotonic(total[used] / count[used], ones[used] / count[used], count[used])
    return Model(mean, scale, directions, phases, ridge, steps, np.clip(values, 0, 1))


def score(docs: DataFrame, model: Model, keep_text: bool = False) -> DataFrame:
    """``docs`` with ``score``; its text too if ``keep_text``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema if f.name != "score" and (keep_text or f.name != "text")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["score double"])

    def scored(batches):
        for batch in batches:
            for piece in pieces(batch, "_utf8"):
                p = sent.value.probability(statistics(piece.column(piece.num_columns - 1)))
                columns = [piece.column(i) for i in range(len(kept))] + [pa.array(p)]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in kept] + ["score"])

    return docs.select(*[f"`{f.name}`" for f in kept], utf8().alias("_utf8")).mapInArrow(scored, schema)
