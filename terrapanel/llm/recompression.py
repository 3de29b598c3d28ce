"""Run-length grammar of a sequence by recompression, and longest common extensions on it.

A round has two steps. Block compression gives every maximal run of one symbol a new symbol (by symbol and length). Pair
compression divides the symbols into left and right ones and gives every left-right pair a new symbol. Both are local: away from their
ends, equal stretches are divided alike. So equal symbols of a level stand for equal stretches, and two positions are compared by climbing as long as
both are borders of the next level, stepping over equal symbols, then descending to the first difference. A query takes
a constant number of steps on each level, in either direction. Many queries go at once, in numpy.
"""

from __future__ import annotations

import numpy as np

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _coin(symbols: np.ndarray, salt: int) -> np.ndarray:
    """A fixed pseudo-random bit of each symbol."""
    x = symbols.astype(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return (x >> np.uint64(40)) & np.uint64(1) == 1


class Grammar:
    """Levels of a sequence of non-negative numbers: for each, the symbols and where they start.

    `height[p]` is the highest level that has a border at position p. Odd levels come from block compression, even ones from pair
    compression. Building stops once `least` symbols or fewer are left.
    """

    def __init__(self, sequence: np.ndarray, least: int = 32):
        self.size = len(sequence)
        symbols, starts = sequence.astype(np.int64), np.arange(self.size)
        self.symbols, self.starts = [symbols], [np.append(starts, self.size)]
        self.height = np.zeros(self.size + 1, np.int16)
        while len(symbols) > least and len(self.symbols) < 400:
            symbols, starts = self._level(symbols, starts, self._blocks(symbols))
            symbols, starts = self._level(symbols, starts, self._pairs(symbols, len(self.symbols)))
        self.height[self.size] = len(self.symbols) - 1

    @staticmethod
    def _blocks(symbols: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))

    @staticmethod
    def _pairs(symbols: np.ndarray, salt: int) -> np.ndarray:
        """Where symbols start after joining: the way round that joins more."""
        left = _coin(symbols, salt)
        joined = max(left[:-1] & ~left[1:], ~left[:-1] & left[1:], key=np.count_nonzero) if len(symbols) > 1 else left[:0]
        return np.flatnonzero(np.concatenate([[True], ~joined]))

    def _level(self, symbols: np.ndarray, starts: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Name the groups that begin at `heads`: blocks by symbol and length, pairs by both symbols (of one alone, by it twice)."""
        counts = np.diff(np.append(heads, len(symbols)))
        first, last = symbols[heads], symbols[heads + counts - 1]
        if len(self.symbols) % 2:
            keys = first * (int(counts.max()) + 1) + counts
        else:
            keys = first * (int(symbols.max()) + 1) + last
        names = np.unique(keys, return_inverse=True)[1].astype(np.int64)
        starts = starts[heads]
        self.height[starts] = len(self.symbols)
        self.symbols.append(names)
        self.starts.append(np.append(starts, self.size))
        return names, starts

    def _step(self, level: int, at: np.ndarray, ahead: bool) -> tuple[np.ndarray, np.ndarray]:
        """Symbol of a level beside borders `at`, and how far it may be stepped: to the end of its run below a block level."""
        starts = self.starts[level]
        index = np.searchsorted(starts, at, "left") - (0 if ahead else 1)
        up = level + 1
        if up < len(self.starts) and up % 2:  # what comes next are blocks of equal symbols
            above = self.starts[up]
            border = above[np.searchsorted(above, at, "right")] if ahead else above[np.searchsorted(above, at, "left") - 1]
        else:
            border = starts[index + 1] if ahead else starts[index]
        return self.symbols[level][index], np.abs(border - at)

    def extend(self, i: np.ndarray, j: np.ndarray, ahead: bool = True) -> np.ndarray:
        """How many equal numbers follow (or precede) the borders i < j. The sequence's ends must differ from all else."""
        length = np.zeros(len(i), np.int64)
        sign, top = 1 if ahead else -1, len(self.starts) - 1
        stopped = np.zeros(len(i), np.int16)
        rising = np.arange(len(i))
        for level in range(top + 1):
            moving = rising
            stuck = []
            while len(moving):
                a, b = i[moving] + sign * length[moving], j[moving] + sign * length[moving]
                if level < top:
                    stay = np.minimum(self.height[a], self.height[b]) <= level
                    moving, a, b = moving[stay], a[stay], b[stay]
                if not len(moving):
                    break
                same, steps = self._common(level, a, b, ahead)
                length[moving[same]] += steps[same]
                stuck.append(moving[~same])
                moving = moving[same]
            if stuck:
                stuck = np.concatenate(stuck)
                stopped[stuck] = level
                gone = np.zeros(len(i), bool)
                gone[stuck] = True
                rising = rising[~gone[rising]]
            if not len(rising):
                break
        for level in range(int(stopped.max(initial=0)) - 1, -1, -1):
            moving = np.flatnonzero(stopped > level)
            while len(moving):
                a, b = i[moving] + sign * length[moving], j[moving] + sign * length[moving]
                same, steps = self._common(level, a, b, ahead)
                length[moving[same]] += steps[same]
                moving = moving[same]
        return length

    def _common(self, level: int, a: np.ndarray, b: np.ndarray, ahead: bool) -> tuple[np.ndarray, np.ndarray]:
        (one, far), (other, wide) = self._step(level, a, ahead), self._step(level, b, ahead)
        return one == other, np.minimum(far, wide)
