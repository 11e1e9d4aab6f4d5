"""A worker's memory of words, as numpy columns instead of Python objects."""

from __future__ import annotations

import numpy as np


class HashMemo:
    """Rows by 64-bit hash: a large and a small sorted run of keys with their row
    numbers, and growing columns. Takes some 30 bytes a word; ``limit`` rows at
    most (and those of one slice), then it starts anew."""

    def __init__(self, limit: int, **kinds):
        self.limit, self.kinds = limit, kinds
        self.clear()

    def clear(self) -> None:
        self.n = 0
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.old, self.new = none, none
        self.columns = {name: np.zeros(1024, kind) for name, kind in self.kinds.items()}

    def __getitem__(self, name: str) -> np.ndarray:
        return self.columns[name][: self.n]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 if it is not known."""
        out = np.full(len(keys), -1, dtype=np.int64)
        for known, rows in (self.old, self.new):
            if len(known):
                at = np.searchsorted(known, keys)
                at[at == len(known)] = 0
                hit = known[at] == keys
                out[hit] = rows[at[hit]]
        return out

    def add(self, keys: np.ndarray, **columns) -> None:
        """Rows for distinct, unknown keys."""
        rows = np.arange(self.n, self.n + len(keys))
        self.n += len(keys)
        for name, values in columns.items():
            if self.n > len(self.columns[name]):
                self.columns[name] = np.concatenate([self.columns[name], np.zeros(max(len(self.columns[name]), self.n), self.columns[name].dtype)])
            self.columns[name][rows] = values
        self.new = self._merged(self.new, (keys, rows))
        if len(self.new[0]) * 8 > len(self.old[0]):
            self.old, self.new = self._merged(self.old, self.new), (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    @staticmethod
    def _merged(a, b):
        keys, rows = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
        order = np.argsort(keys, kind="stable")
        return keys[order], rows[order]

    def rows(self, keys: np.ndarray, learn) -> np.ndarray:
        """Row of each of ``keys``; ``learn(first)`` gets the first places of the
        unknown ones and gives their columns."""
        every, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if self.n > self.limit:
            self.clear()
        found = self.find(every)
        if len(unknown := np.flatnonzero(found < 0)):
            found[unknown] = np.arange(self.n, self.n + len(unknown))
            self.add(every[unknown], **learn(first[unknown]))
        return found[inverse]
