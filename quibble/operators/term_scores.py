"""BM25 scores of many queries where documents lie: a task keeps its best k per query.

Queries lie in broadcast blocks. What a task holds is bounded by (documents looked at together) x (queries of a
block), what it sends by (queries x k) rows, whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from quibble.functions.filters import clauses_hold

QUERY_BLOCK = 1024
CLAUSES = "array<struct<field:string,op:string,value:string>>"
SCORE_DIGITS = 6
SCORED = 512  # documents scored together
HITS = 1 << 20  # (posting, query) pairs looked at together


class Best:
    """Best k (score, id) per query seen so far, ties to the lower id; ``more`` goes along with an id."""

    def __init__(self, queries: int, k: int):
        self.k, self.queries = k, queries
        self.floor = np.full(queries, -np.inf)  # score of the k-th best so far
        self.held = None  # query, id, score, more

    def offer(self, ids: np.ndarray, scores: np.ndarray, more: np.ndarray | None = None) -> None:
        """``scores`` is (documents x queries), NaN where a document is out."""
        scores = np.where(np.isnan(scores), -np.inf, scores)
        floor = self.floor
        if len(scores) > self.k:
            floor = np.maximum(floor, np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k])
        doc, query = np.nonzero((scores >= floor) & (scores > -np.inf))
        new = [query, ids[doc], scores[doc, query], (ids if more is None else more)[doc]]
        self.held = new if self.held is None else [np.concatenate(pair) for pair in zip(self.held, new)]
        if len(self.held[0]) > 4 * self.k * self.queries:
            self.trim()

    def trim(self) -> None:
        order = np.lexsort((self.held[1], -self.held[2], self.held[0]))
        held = [x[order] for x in self.held]
        query, scores = held[0], held[2]
        first = np.searchsorted(query, np.arange(self.queries))
        rank = np.arange(len(query)) - first[query]
        kth = rank == self.k - 1
        self.floor[query[kth]] = np.maximum(self.floor[query[kth]], scores[kth])
        self.held = [x[rank < self.k] for x in held]

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Query numbers, ids, scores and ``more``."""
        if self.held is None:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        self.trim()
        return tuple(self.held)


def query_blocks(queries: DataFrame, block: int) -> Iterator[list[Any]]:
    """The staged queries in lists of about ``block`` rows, dealt by their ``_row``: what is held at once stays bounded."""
    parts = max(1, -(-queries.count() // block))
    for p in range(parts):
        yield queries.filter(F.pmod(F.xxhash64("_row"), F.lit(parts)) == p).collect()


class FilterTests:
    """The distinct filters of queries, each one boolean that Spark computes of a document."""

    def __init__(self, fields: dict[str, DataType]):
        self.fields, self.number, self.tests = fields, {}, []

    def of(self, clauses: Iterable[Any] | None) -> int:
        key = tuple(sorted((c["field"], c["op"], c["value"]) for c in clauses or ()))
        if key not in self.number:
            self.number[key] = len(self.tests)
            used = {n: (F.col(n), t) for n, t in self.fields.items() if n in {c[0] for c in key}}
            listed = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("field", "op", "value"), c)]) for c in key])
            self.tests.append(clauses_hold(listed, used) if key else F.lit(True))
        return self.number[key]

    def column(self) -> Column:
        return F.array(*self.tests) if self.tests else F.array(F.lit(True))


class QueryTerms:
    """Queries of one block by term: ``query[start[t]:start[t + 1]]`` have the term ``t``."""

    def __init__(self, ids: list, which: list[int], terms: Sequence[Sequence[str]]):
        self.ids, self.which = ids, np.array(which, np.int64)
        flat = np.array([t for own in terms for t in own], object)
        query = np.repeat(np.arange(len(ids)), [len(own) for own in terms])
        found, number = np.unique(flat, return_inverse=True)
        order = np.argsort(number, kind="stable")
        self.terms, self.query = pa.array(found.tolist(), pa.string()), query[order]
        self.start = np.searchsorted(number[order], np.arange(len(found) + 1))
        self.idf = np.zeros(len(found))
        self.floor = np.full(len(ids), -np.inf)

    def numbers(self, words: pa.Array) -> np.ndarray:
        """Which term each word is, -1 for none."""
        if pa.types.is_dictionary(words.type):
            return self.numbers(words.dictionary)[words.indices.to_numpy()]
        return pc.fill_null(pc.index_in(words, value_set=self.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def weigh(self, df: dict[str, int], documents: int) -> None:
        n = np.array([df.get(t, 0) for t in self.terms.to_pylist()], np.float64)
        self.idf = np.where(n > 0, np.log(1 + (documents - n + 0.5) / (n + 0.5)), 0.0)

    def asking(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``term``, query) for each query that has it."""
        count = self.start[term + 1] - self.start[term]
        at = np.repeat(np.arange(len(term)), count)
        step = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        return at, self.query[self.start[term][at] + step]


def damped(tf, length, mean: float, k1: float, b: float) -> np.ndarray:
    """What a term gives a document, next to its weight."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))


def rounded(scores: np.ndarray, meets: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Scores (documents x queries) as they are ranked: NaN where nothing is shared or the query's filter fails."""
    scores = np.round(scores, SCORE_DIGITS)
    return np.where((scores > 0) & meets[:, which], scores, np.nan)


def matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """A column of equally long arrays of booleans."""
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1).astype(bool)


def postings(block: QueryTerms, words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, tf) of the asked terms in rows of words."""
    number = block.numbers(words.flatten())
    row = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
    asked = number >= 0
    key, tf = np.unique(row[asked] * max(1, len(block.terms)) + number[asked], return_counts=True)
    return key // max(1, len(block.terms)), key % max(1, len(block.terms)), tf


def row_slices(batches: Iterable[pa.RecordBatch], rows: int = SCORED) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def add_hits(block: QueryTerms, scores: np.ndarray, doc: np.ndarray, term: np.ndarray, part: np.ndarray) -> None:
    """Add to ``scores`` (documents x queries) what each posting gives the queries that ask for its term."""
    width = scores.shape[1]
    ends = np.cumsum(block.start[term + 1] - block.start[term])
    begin = 0
    while begin < len(term):
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + HITS, side="right")))
        at, query = block.asking(term[begin:end])
        at += begin
        scores += np.bincount(doc[at] * width + query, part[at], scores.size).reshape(scores.shape)
        begin = end
