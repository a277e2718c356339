"""Numbers for the words of texts.

Texts repeat their words, so what depends on a word alone is worked out once in each worker: a
whole text is then one dictionary look-up for each word and one numpy gather.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np

#: New words that `learn` gets at once, and characters of words that are remembered.
LEARNED, CHARS = 20_000, 32 << 20
_KEPT: list[tuple[tuple[str, str], object]] = []


def kept(name: str, key: str, make: Callable[[], object]) -> object:
    """What `make` returns, kept in this worker process for later tasks with the same name and key.

    Only the latest is held: a worker that goes on to another operator frees what the last one knew.
    """
    if not _KEPT or _KEPT[0][0] != (name, key):
        _KEPT.clear()
        _KEPT.append(((name, key), make()))
    return _KEPT[0][1]


def release() -> None:
    """Free what `kept` holds, in operators that keep nothing."""
    _KEPT.clear()


def grown(array: np.ndarray, rows: int) -> np.ndarray:
    """The array, with room for so many rows."""
    while len(array) < rows:
        array = np.concatenate([array, np.zeros_like(array)])
    return array


class Numbers:
    """Words numbered from 0 as they are met.

    cut(text) gives a text's words; learn(words, first) is told of new words, which get the
    numbers from `first` on. With more than `most` words, or CHARS characters of them, all is forgotten
    at the start of a batch, so a worker's memory is bounded; `first` is then 0 again.
    """

    def __init__(self, cut: Callable[[str], list], learn: Callable[[list, int], None], most: int = 400_000):
        self.cut, self.learn, self.most = cut, learn, most
        self.at: dict = {}
        self.chars = 0

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all words of all texts in turn, and how many belong to each text."""
        if len(self.at) > self.most or self.chars > CHARS:
            self.at, self.chars = {}, 0
        split = [self.cut(t) for t in texts]
        fresh = list(set().union(*split).difference(self.at))
        self.chars += sum(map(len, fresh))
        for i in range(0, len(fresh), LEARNED):
            words, first = fresh[i : i + LEARNED], len(self.at)
            self.learn(words, first)
            self.at.update(zip(words, range(first, first + len(words))))
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        return np.fromiter(map(self.at.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum())), sizes
