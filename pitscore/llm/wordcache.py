"""What a worker remembers of words, by their 64-bit hashes."""

from __future__ import annotations

import numpy as np


class Store:
    """An array that grows at its end; room is doubled when it runs out."""

    def __init__(self, kind, width: int | None = None):
        self._held = np.zeros(16 if width is None else (16, width), kind)
        self.n = 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self._held):
            grown = np.zeros((max(2 * len(self._held), self.n + len(values)), *self._held.shape[1:]), self._held.dtype)
            grown[: self.n] = self._held[: self.n]
            self._held = grown
        self._held[self.n : self.n + len(values)] = values
        self.n += len(values)

    @property
    def values(self) -> np.ndarray:
        return self._held[: self.n]


class WordNumbers:
    """Numbers words in the order in which they are added.

    Hashes lie in two sorted arrays. New ones go into the small one, which is merged into the large one
    once it is half as long, so a word is moved a few times only however many follow.
    """

    LEAST = 1 << 14

    def __init__(self):
        self.n = 0
        self._keys = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
        self._numbers = [np.zeros(0, np.int64), np.zeros(0, np.int64)]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for unknown ones."""
        out = np.full(len(keys), -1, np.int64)
        for known, numbers in zip(self._keys, self._numbers, strict=True):
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[at] == keys
                out[hit] = numbers[at[hit]]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Adds distinct unknown keys."""
        self._merge(1, keys, np.arange(self.n, self.n + len(keys)))
        self.n += len(keys)
        if len(self._keys[1]) > max(self.LEAST, len(self._keys[0]) // 2):
            self._merge(0, self._keys[1], self._numbers[1])
            self._keys[1], self._numbers[1] = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def _merge(self, place: int, keys: np.ndarray, numbers: np.ndarray) -> None:
        both = np.concatenate([self._keys[place], keys])
        order = np.argsort(both, kind="stable")
        self._keys[place] = both[order]
        self._numbers[place] = np.concatenate([self._numbers[place], numbers])[order]
