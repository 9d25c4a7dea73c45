"""Language identification with language-bitmask n-gram filters.

One Bloom filter per language holds the character n-grams (1 and 3 characters of
words with a blank at both ends) that are usual in that language. The filters
are bit-sliced: place ``i`` of the table is a bitmask with one bit per language,
so the AND of an n-gram's ``HASHES`` places gives all languages that hold it at
once. Per document the languages' hits are counted, corrected for the filters'
false positives, and the largest estimate wins. A place has as many 64-bit words as the languages need.

An n-gram is usual if at least ``SHARE`` of the language's sampled documents
hold it and no other language's share is over ``RIVAL`` times as large.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
without a single known n-gram the most frequent language is given with score 0;
equal estimates go to the language with more documents; every language of a training
row is learned; no training rows: every text is ``und``.
Repeated rows get equal results; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quibble.llm.common import arrow_batch, pieces, remainder, utf8
from quibble.sources.staging import stage

BITS = 18  # 2^18 places of one bitmask
HASHES = 3
PER_LANGUAGE = 3_000
SHARE = 0.02
RIVAL = 0.25
LENGTHS = (1, 3)
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def letters(text: str) -> np.ndarray:
    """Code points in lower case; every run of other characters is one blank, also at both ends."""
    lower = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    codes = np.concatenate([[32], np.where(_IS_LETTER[np.minimum(lower, 0x10FFFF)], lower, 32), [32]]).astype(np.uint32)
    return codes[(codes != 32) | np.concatenate([[True], codes[:-1] != 32])]


def _letter_table() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[:0x32400] = [chr(c).isalpha() for c in range(0x32400)]  # no letters are assigned beyond
    return table


_IS_LETTER = _letter_table()


def grams(codes: np.ndarray) -> np.ndarray:
    """The n-grams of all lengths as 64-bit numbers, those across a word border left out."""
    out = []
    c = codes.astype(np.uint64)
    for n in LENGTHS:
        m = len(c) - n + 1
        if m <= 0:
            break
        value = c[:m].copy()
        for k in range(1, n):  # 21 bits hold any character
            value = (value << np.uint64(21)) | c[k : k + m]
        inside = codes[n // 2 : n // 2 + m] != 32  # a blank only at an end
        out.append(value[inside])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    out = []
    with np.errstate(over="ignore"):
        for k in range(HASHES):
            mixed = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(_MIX[k])
            mixed ^= mixed >> np.uint64(32)
            mixed *= np.uint64(_MIX[k])
            out.append((mixed >> np.uint64(64 - bits)).astype(np.int64))
    return out


@dataclass(frozen=True)
class Model:
    languages: list[str]
    table: np.ndarray  # bit-sliced filters: per place a mask of languages, in words of 64
    false_positive: np.ndarray  # per language
    bits: int

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages:
            return "und", 0.0
        codes = letters(text)
        if not (codes != 32).any():
            return "und", 0.0
        h = grams(codes)
        a, *rest = places(h, self.bits)
        mask = self.table[a]
        for p in rest:
            mask &= self.table[p]
        n = len(self.languages)
        if n <= 12:  # few masks are possible: count each
            per_mask = np.bincount(mask[:, 0].astype(np.int64), minlength=1 << n)
            hits = np.array([per_mask.reshape(-1, 2, 1 << i)[:, 1].sum() for i in range(n)], float)
        else:
            hits = np.zeros(64 * mask.shape[1])
            mask = mask[mask.any(axis=1)].astype("<u8")
            for at in range(0, len(mask), 1 << 14):  # bits take 64 times the room
                some = mask[at : at + (1 << 14)]
                hits += np.unpackbits(some.view(np.uint8), axis=1, bitorder="little").sum(axis=0)
            hits = hits[:n]
        estimate = np.maximum((hits - len(h) * self.false_positive) / (1 - self.false_positive), 0)
        if estimate.sum() <= 0:
            return self.languages[0], 0.0
        best = int(estimate.argmax())
        return self.languages[best], float(estimate[best] / estimate.sum())


_GRAM_SCHEMA = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each language that hold an n-gram, summed per batch."""
    for batch in batches:
        for piece in pieces(batch):
            found: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                own = np.unique(grams(letters((text or b"").decode("utf-8", "replace"))))
                found.setdefault(lang, []).append(own)
            for lang, parts in found.items():
                values, n = np.unique(np.concatenate(parts), return_counts=True)
                yield arrow_batch({"lang": [lang] * len(values), "gram": values.view(np.int64), "n": n}, _GRAM_SCHEMA)


def fit(docs: DataFrame, modulus: int = 4, held_out: int = 2, per_language: int = PER_LANGUAGE, bits: int = BITS) -> Model:
    """Fit on about ``per_language`` documents of each language, chosen by hash (a documented bound).

    Only documents with a language whose crc32 remainder is not ``held_out`` are looked at.
    What reaches the driver are the usual n-grams, at most ``1 / SHARE`` times the n-grams
    of one document per language.
    """
    spark = docs.sparkSession
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id", modulus) != held_out))
    counted = stage(usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    languages = [r["lang"] for r in counted.orderBy(F.desc("n"), "lang").collect()]  # one row per language
    words = max(1, -(-len(languages) // 64))
    if not languages:
        return Model([], np.zeros((1 << bits, words), np.uint64), np.zeros(0), bits)
    share = F.least(F.lit(1.0), per_language / F.col("n"))
    chance = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) / 1_000_000.0
    sample = usable.join(F.broadcast(counted.select("lang", share.alias("_share"))), "lang").where(chance < F.col("_share"))
    sample = stage(sample.select("lang", "text"), "language-sample")
    totals = sample.groupBy("lang").agg(F.count(F.lit(1)).alias("total"))
    counted = sample.select(utf8(), "lang").mapInArrow(_count_grams, "lang string, gram long, n long")
    shares = counted.groupBy("gram", "lang").agg(F.sum("n").alias("n")).join(F.broadcast(totals), "lang")
    shares = shares.withColumn("share", F.col("n") / F.col("total")).where(F.col("share") >= SHARE * RIVAL)
    top = shares.groupBy("gram").agg(F.max("share").alias("top"))
    usual = shares.join(top, "gram").where((F.col("share") >= SHARE) & (F.col("share") >= F.col("top") * RIVAL))
    # Held by one language alone it decides; shared n-grams keep all their bits.
    bit = {lang: i for i, lang in enumerate(languages)}
    table = np.zeros((1 << bits, words), np.uint64)
    for rows in _chunks(usual.select("gram", "lang").toLocalIterator()):
        h = np.array([r[0] for r in rows], np.int64).view(np.uint64)
        number = np.array([bit[r[1]] for r in rows], np.uint64)
        for p in places(h, bits):
            np.bitwise_or.at(table, (p, (number // np.uint64(64)).astype(np.int64)), np.uint64(1) << number % np.uint64(64))
    fill = np.array([((table[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))])
    return Model(languages, table, np.minimum(fill**HASHES, 0.99), bits)


def _chunks(rows, n: int = 100_000):
    held = []
    for r in rows:
        held.append(r)
        if len(held) == n:
            yield held
            held = []
    if held:
        yield held


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without text, with ``lang_pred`` and ``score``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema if f.name not in ("text", "lang_pred", "score")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["lang_pred string, score double"])

    def predict(batches):
        m = sent.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            found = [m.predict(t.as_py().decode("utf-8", "replace") if t.is_valid else None) for t in texts]
            columns = [batch.column(i) for i in range(len(kept))]
            columns += [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in kept] + ["lang_pred", "score"])

    return docs.select(*[f"`{f.name}`" for f in kept], utf8().alias("_utf8")).mapInArrow(predict, schema)
