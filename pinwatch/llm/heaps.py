"""The best rows of many groups, added to in any order and merged across tasks."""

from __future__ import annotations

import numpy as np

_LEAST = np.iinfo(np.int64).min


class BestRows:
    """For each of ``groups`` groups the ``most`` rows with the highest score; of equal scores the smaller
    ``tie`` first, then the smaller ``row``. What two holders keep, added to a third, is what it would keep of
    all their rows."""

    def __init__(self, groups: int, most: int):
        self.most = most
        self.score = np.full((groups, most), _LEAST, dtype=np.int64)
        self.tie, self.row = np.zeros((groups, most), dtype=np.int64), np.zeros((groups, most), dtype=np.int64)
        self.count = np.zeros(groups, dtype=np.int64)

    def threshold(self) -> np.ndarray:
        """The least score that may still enter each group."""
        return np.where(self.count == self.most, self.score[:, -1], _LEAST)

    def add(self, group: np.ndarray, score: np.ndarray, tie: np.ndarray, row: np.ndarray) -> None:
        if not len(group):
            return
        touched = np.unique(group)
        held = np.arange(self.most) < self.count[touched][:, None]
        group = np.concatenate([group, np.repeat(touched, self.count[touched])])
        score = np.concatenate([score, self.score[touched][held]])
        tie = np.concatenate([tie, self.tie[touched][held]])
        row = np.concatenate([row, self.row[touched][held]])
        order = np.lexsort((row, tie, ~score, group))
        group = group[order]
        first = np.searchsorted(group, touched)
        place = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
        kept = place < self.most
        at, order = (group[kept], place[kept]), order[kept]
        self.score[at], self.tie[at], self.row[at] = score[order], tie[order], row[order]
        self.count[touched] = np.bincount(group[kept], minlength=len(self.count))[touched]

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Group, score, tie and row of all that is kept."""
        held = np.arange(self.most) < self.count[:, None]
        return np.repeat(np.arange(len(self.count)), self.count), self.score[held], self.tie[held], self.row[held]
