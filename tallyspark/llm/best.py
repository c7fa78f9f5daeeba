"""Running best rows per group, kept by a task while it reads its rows."""

from __future__ import annotations

import numpy as np

LEAST, MOST = -(1 << 63) + 1, (1 << 63) - 1


class Best:
    """The best k rows of each group: highest score first, ties by the smaller id."""

    def __init__(self, groups: int, k: int):
        self.k = k
        self.filled = np.zeros(groups, np.int64)
        self.score, self.id = np.zeros((groups, k), np.int64), np.zeros((groups, k), np.int64)
        self.floor = np.full(groups, LEAST - 1)  # lower scores can't enter

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(group)
        old = np.repeat(touched, self.filled[touched])
        place = np.arange(self.k)[None, :] < self.filled[touched][:, None]
        group = np.concatenate([old, group])
        score, ids = np.concatenate([self.score[touched][place], score]), np.concatenate([self.id[touched][place], ids])
        order = np.lexsort((ids, ~score, group))  # ~x falls where x rises, without overflow
        group, score, ids = group[order], score[order], ids[order]
        rank = np.arange(len(group)) - np.searchsorted(group, group)
        kept = rank < self.k
        group, rank = group[kept], rank[kept]
        self.score[group, rank], self.id[group, rank] = score[kept], ids[kept]
        self.filled[touched] = np.bincount(np.searchsorted(touched, group), minlength=len(touched))
        full = touched[self.filled[touched] == self.k]
        self.floor[full] = self.score[full, -1]
