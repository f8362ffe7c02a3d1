"""Words of texts as numbers, with what is known of each word worked out once."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import chain, islice

import numpy as np

MOST_WORDS = 300_000  # words that a worker remembers before it starts anew


class _Numbers(dict):
    """Gives each new word the next number."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class WordTable:
    """Numbers for words and columns of what ``describe`` says about them.

    The numbers hold until the table starts anew, which ``numbers`` may do at its start.
    Words in ``ready`` are always known; they have the first numbers.
    """

    def __init__(
        self,
        describe: Callable[[list[bytes]], Sequence[np.ndarray]],
        ready: Sequence[bytes] = (),
        most: int = MOST_WORDS,
    ):
        self.describe, self.most = describe, most
        self._ready = dict(zip(ready, range(len(ready))))
        self._start()

    def _start(self) -> None:
        self._numbers, self._known = _Numbers(self._ready), 0
        self.columns: list[np.ndarray] = []

    def numbers(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The words of all texts as one array of numbers, and each text's word count."""
        if len(self._numbers) > self.most + len(self._ready):
            self._start()
        counts = np.fromiter(map(len, texts), np.int64, len(texts))
        find = self._numbers.__getitem__
        out = np.fromiter(map(find, chain.from_iterable(texts)), np.int64, int(counts.sum()))
        if not self.columns or len(self._numbers) > self._known:
            self._learn()
        return out, counts

    def _learn(self) -> None:
        new = list(islice(self._numbers, self._known, None))
        described = self.describe(new)
        if not self.columns:
            self.columns = [np.zeros((0, *c.shape[1:]), c.dtype) for c in described]
        for k, column in enumerate(described):
            have = self.columns[k]
            if len(have) < self._known + len(new):
                grown = np.zeros((max(2 * len(have), self._known + len(new), 1024), *column.shape[1:]), column.dtype)
                grown[: self._known] = have[: self._known]
                self.columns[k] = grown
            self.columns[k][self._known : self._known + len(new)] = column
        self._known += len(new)


def starts_of(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64) if len(counts) else counts


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each text's values; 0 for a text without any."""
    total = np.zeros((len(counts), *values.shape[1:]), values.dtype)
    full = counts > 0
    if full.any():
        total[full] = np.add.reduceat(values, starts_of(counts)[full])
    return total
