"""FM-index over a sequence of small integers: wavelet matrix ranks, backward search, sampled positions.

Symbol 0 separates runs; a pattern never contains it. Everything is vectorised over patterns and rows.
"""

from __future__ import annotations

import numpy as np

SAMPLE_RATE = 8


class RankBits:
    """Bit vector with constant-time rank: 64-bit words and the set bits before each."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, dtype=bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.ones = int(self.before[-1])

    def rank1(self, i: np.ndarray) -> np.ndarray:
        word, bit = i >> 6, (i & 63).astype("u8")
        low = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype("u8")) & np.uint64(1) == 1


class WaveletMatrix:
    """Ranks and access over a sequence of symbols, one bit vector for each bit from the highest down."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels: list[tuple[int, RankBits, int]] = []
        current = symbols
        for shift in range(max(1, (sigma - 1).bit_length()) - 1, -1, -1):
            bits = (current >> shift) & 1 == 1
            self.levels.append((shift, ranks := RankBits(bits), len(current) - ranks.ones))
            current = np.concatenate([current[~bits], current[bits]])

    def down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where prefix length ``i`` ends up among the symbol's path; differences of two are ranks."""
        for shift, ranks, zeros in self.levels:
            ones = ranks.rank1(i)
            i = np.where((symbol >> shift) & 1 == 1, zeros + ones, i - ones)
        return i

    def access(self, i: np.ndarray) -> np.ndarray:
        symbol = np.zeros(len(i), dtype=np.int64)
        for shift, ranks, zeros in self.levels:
            bit, ones = ranks.get(i), ranks.rank1(i)
            symbol |= bit.astype(np.int64) << shift
            i = np.where(bit, zeros + ones, i - ones)
        return symbol


def suffix_array(sequence: np.ndarray) -> np.ndarray:
    """Positions in suffix order by doubling. Separators differ from each other, in order of position, so the number
    of rounds follows the longest run, not the longest repeat."""
    n, apart = len(sequence), sequence == 0
    rank = np.where(apart, np.cumsum(apart) - 1, sequence.astype(np.int64) + int(apart.sum()))
    step = 1
    while True:
        follow = np.zeros(n, dtype=np.int64)
        follow[: max(0, n - step)] = rank[step:] + 1
        key = (rank << 32) | follow
        order = np.argsort(key, kind="stable")
        changed = np.diff(key[order], prepend=-1) != 0
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(changed) - 1
        if n == 0 or int(changed.sum()) == n:
            return order
        step *= 2


class FMIndex:
    def __init__(self, sequence: np.ndarray, sigma: int):
        """``sequence`` of symbols below ``sigma`` starts and ends with the separator 0."""
        order = suffix_array(sequence)
        last = sequence[order - 1]  # the symbol before each suffix; the first suffix wraps to a separator
        self.symbols = WaveletMatrix(last.astype(np.int64), sigma)
        counts = np.bincount(sequence, minlength=sigma)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.origin = self.symbols.down(np.arange(sigma), np.zeros(sigma, dtype=np.int64))
        sampled = (order % SAMPLE_RATE == 0) | (last == 0)  # a walk never has to cross a separator
        self.sampled, self.positions = RankBits(sampled), order[sampled]

    def _step(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.first[symbol] + self.symbols.down(symbol, i) - self.origin[symbol]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of right-aligned ``patterns`` (rows, padded with 0 on the left)."""
        low = np.zeros(len(patterns), dtype=np.int64)
        high = np.full(len(patterns), self.first[-1], dtype=np.int64)
        for back in range(1, patterns.shape[1] + 1):
            live = np.flatnonzero((lengths >= back) & (low < high))
            if not len(live):
                break
            symbol = patterns[live, -back]
            low[live], high[live] = self._step(symbol, low[live]), self._step(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Sequence positions of suffix rows."""
        out, at, steps = np.empty(len(rows), dtype=np.int64), np.arange(len(rows)), 0
        while len(at):
            known = self.sampled.get(rows)
            out[at[known]] = self.positions[self.sampled.rank1(rows[known])] + steps
            at, rows = at[~known], rows[~known]
            rows = self._step(self.symbols.access(rows), rows)
            steps += 1
        return out
