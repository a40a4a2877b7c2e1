"""Order statistics of many stretches of one sequence.

The values are split bit by bit, highest first, each time into those with the
bit clear and those with it set, order kept (a wavelet matrix).  Counts of
clear bits before every place then lead a stretch and a rank through all
levels, so any number of ranks takes as many array operations as values have
bits, whatever the length of the stretches.
"""

from __future__ import annotations

import numpy as np


class OrderStatistic:
    def __init__(self, values: np.ndarray):
        self.values, codes = np.unique(values, return_inverse=True)
        self.levels: list[tuple[int, np.ndarray]] = []
        for bit in reversed(range(max(1, int(len(self.values) - 1).bit_length()))):
            is_set = (codes >> bit) & 1 == 1
            self.levels.append((bit, np.concatenate([[0], np.cumsum(~is_set)])))
            codes = np.concatenate([codes[~is_set], codes[is_set]])

    def ranked(self, low: np.ndarray, high: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The value of ``rank`` (from 0, smallest first) in each non-empty stretch [low, high)."""
        code = np.zeros(len(low), dtype=np.int64)
        for bit, clear in self.levels:
            before, upto = clear[low], clear[high]
            is_set = rank >= upto - before
            rank = np.where(is_set, rank - (upto - before), rank)
            low = np.where(is_set, clear[-1] + low - before, before)
            high = np.where(is_set, clear[-1] + high - upto, upto)
            code |= is_set.astype(np.int64) << bit
        return self.values[code]
