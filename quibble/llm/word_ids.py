"""Token ids of words, kept for the words that a task has met lately."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np

KEPT_WORDS = 200_000
KEPT_IDS = 1_000_000

Encoder = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


class WordIds:
    """Looks words up, and has ``encode`` make ids of those it does not know: (all ids, their number per word).

    ``single`` are words of one id, always known. Others are forgotten all at once when there are more than
    ``KEPT_WORDS`` of them or ``KEPT_IDS`` ids; that changes no result.
    """

    def __init__(self, single: dict[str, int], encode: Encoder):
        self.single, self.encode = single, encode
        self._forget()

    def _forget(self) -> None:
        self.number = dict(zip(self.single, range(len(self.single))))
        self.pool, self.held = np.fromiter(self.single.values(), np.int32, len(self.single)), len(self.single)
        self.starts, self.counts = np.arange(self.held), np.ones(self.held, np.int64)

    def _learn(self, words: list[str]) -> None:
        new = list(dict.fromkeys(words))
        ids, counts = self.encode(new)
        first, more = len(self.number), self.held + len(ids)
        self.number.update(zip(new, range(first, first + len(new))))
        while len(self.pool) < more or len(self.starts) < len(self.number):  # room for twice as many
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), np.int32)])
            self.starts, self.counts = (np.concatenate([x, np.zeros(max(len(x), len(new)), np.int64)]) for x in (self.starts, self.counts))
        self.pool[self.held : more] = ids
        self.counts[first : first + len(new)] = counts
        self.starts[first : first + len(new)] = self.held + np.cumsum(counts) - counts
        self.held = more

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words one after the other, and their number per word."""
        if len(self.number) > len(self.single) + KEPT_WORDS or self.held > len(self.single) + KEPT_IDS:
            self._forget()
        at = np.fromiter(map(self.number.get, words, itertools.repeat(-1)), np.int64, len(words))
        unknown = at < 0
        if unknown.any():
            missing = list(itertools.compress(words, unknown.tolist()))
            self._learn(missing)
            at[unknown] = np.fromiter(map(self.number.__getitem__, missing), np.int64, len(missing))
        count = self.counts[at]
        place = np.repeat(self.starts[at] - np.cumsum(count) + count, count) + np.arange(count.sum())
        return self.pool[place], count
