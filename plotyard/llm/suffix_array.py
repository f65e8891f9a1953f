"""Suffix arrays of byte strings by induced sorting, and permuted common prefixes.

Suffixes are classified as smaller (S) or larger (L) than their successor; leftmost S suffixes (those after an L) are sorted by
recursion on the names of the substrings between them, and all others are induced from these in two linear passes.
On the top level, where the alphabet is small, a bucket's suffixes are induced together with NumPy; the recursion,
at most a third as long and with as many names as positions, is a plain scan.
"""

from __future__ import annotations

import numpy as np


def classify(text: np.ndarray) -> np.ndarray:
    """True for S suffixes. The last symbol is a unique smallest one and counts as S."""
    n = len(text)
    s = np.ones(n, dtype=bool)
    if n > 1:
        differs = text[:-1] != text[1:]
        # the next position where neighbours differ decides a run of equal symbols
        at = np.where(differs, np.arange(n - 1), n - 1)
        nearest = np.minimum.accumulate(at[::-1])[::-1]
        known = nearest < n - 1
        s[:-1][known] = text[nearest[known]] < text[nearest[known] + 1]
    return s


def leftmost(s: np.ndarray) -> np.ndarray:
    return np.flatnonzero(s[1:] & ~s[:-1]) + 1


def _induce_by_bucket(text: np.ndarray, s: np.ndarray, seeds: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix order from the leftmost S suffixes in ``seeds`` order; alphabet of ``sigma`` symbols."""
    n = len(text)
    sizes = np.bincount(text, minlength=sigma)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    order = np.full(n, -1, dtype=np.int64)
    symbols = text[seeds]
    by_symbol = np.argsort(symbols, kind="stable")
    counts = np.bincount(symbols, minlength=sigma)
    at = np.repeat(ends - np.cumsum(counts), counts) + np.arange(len(seeds))
    seeds_of = np.split(seeds[by_symbol], np.cumsum(counts)[:-1])
    order[at] = seeds[by_symbol]
    fill = begins.copy()

    def place_left(positions: np.ndarray) -> None:
        """L suffixes before ``positions``, in their order, to the heads of their buckets."""
        before = positions[positions > 0] - 1
        before = before[~s[before]]
        if len(before):
            symbol = text[before]
            grouped = np.argsort(symbol, kind="stable")
            number = np.bincount(symbol, minlength=sigma)
            used = np.flatnonzero(number)
            offset = np.repeat(fill[used] - (np.cumsum(number[used]) - number[used]), number[used])
            order[offset + np.arange(len(before))] = before[grouped]
            fill[used] += number[used]

    for c in np.flatnonzero(sizes):
        low = begins[c]
        while low < fill[c]:  # a run of one symbol fills its bucket round by round
            high = fill[c]
            place_left(order[low:high])
            low = high
        if counts[c]:
            place_left(seeds_of[c])
    fill = ends.copy()

    def place_right(positions: np.ndarray) -> None:
        """S suffixes before ``positions``, given from the largest down, to the tails of their buckets."""
        before = positions[positions > 0] - 1
        before = before[s[before]]
        if len(before):
            symbol = text[before]
            grouped = np.argsort(symbol, kind="stable")
            number = np.bincount(symbol, minlength=sigma)
            used = np.flatnonzero(number)
            offset = np.repeat(fill[used] - 1 + (np.cumsum(number[used]) - number[used]), number[used])
            order[offset - np.arange(len(before))] = before[grouped]
            fill[used] -= number[used]

    larger = np.bincount(text[~s], minlength=sigma)
    for c in np.flatnonzero(sizes)[::-1]:
        high = ends[c]
        while fill[c] < high:
            low = fill[c]
            place_right(order[low:high][::-1])
            high = low
        place_right(order[begins[c] : begins[c] + larger[c]][::-1])
    order[0] = n - 1
    return order


def _induce_by_scan(text: list[int], s: list[bool], seeds: list[int], sigma: int) -> list[int]:
    """The same for an alphabet as large as the text."""
    n = len(text)
    ends = [0] * sigma
    for c in text:
        ends[c] += 1
    total, begins = 0, [0] * sigma
    for c in range(sigma):
        begins[c] = total
        total += ends[c]
        ends[c] = total
    order = [-1] * n
    tail = ends[:]
    for i in reversed(seeds):
        c = text[i]
        tail[c] -= 1
        order[tail[c]] = i
    head = begins[:]
    for k in range(n):
        i = order[k] - 1
        if i >= 0 and not s[i]:
            c = text[i]
            order[head[c]] = i
            head[c] += 1
    tail = ends[:]
    for k in range(n - 1, -1, -1):
        i = order[k] - 1
        if i >= 0 and s[i]:
            c = text[i]
            tail[c] -= 1
            order[tail[c]] = i
    order[0] = n - 1
    return order


def _induce(text: np.ndarray, s: np.ndarray, seeds: np.ndarray, sigma: int) -> np.ndarray:
    if sigma <= 1024:
        return _induce_by_bucket(text, s, seeds, sigma)
    return np.array(_induce_by_scan(text.tolist(), s.tolist(), seeds.tolist(), sigma), dtype=np.int64)


def suffix_array(text: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix order of ``text``, whose last symbol 0 occurs nowhere else."""
    n = len(text)
    if n <= 2:
        return np.arange(n - 1, -1, -1)
    s = classify(text)
    starts = leftmost(s)
    if len(starts) <= 1:
        return _induce(text, s, starts if len(starts) else np.array([n - 1]), sigma)
    rough = _induce(text, s, starts, sigma)
    is_start = np.zeros(n, dtype=bool)
    is_start[starts] = True
    ordered = rough[is_start[rough]]
    names = np.empty(n, dtype=np.int64)
    names[ordered] = np.cumsum(np.concatenate([[0], _differs(text, s, starts, ordered)]))
    reduced = names[starts]
    count = int(reduced.max()) + 1
    if count == len(starts):
        seeds = ordered
    else:
        seeds = starts[suffix_array(reduced, count)]
    return _induce(text, s, seeds, sigma)


def _differs(text: np.ndarray, s: np.ndarray, starts: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Whether each leftmost-S substring differs from the one before it in ``ordered``; symbols and kinds count."""
    n = len(text)
    length = np.empty(n, dtype=np.int64)
    length[starts] = np.diff(np.concatenate([starts, [n - 1]])) + 1
    a, b = ordered[:-1], ordered[1:]
    same = length[a] == length[b]
    live = np.flatnonzero(same)
    step = 0
    while len(live):
        x, y = a[live] + step, b[live] + step
        equal = (text[x] == text[y]) & (s[x] == s[y])
        same[live[~equal]] = False
        step += 1
        live = live[equal & (step < length[a[live]])]
    return ~same


def permuted_prefixes(text: np.ndarray, order: np.ndarray, positions: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``positions``, in their order: the suffix before it in ``order`` (-1 for the first) and their common prefix, at
    most ``most``."""
    n = len(text)
    previous = np.full(n, -1, dtype=np.int64)
    previous[order[1:]] = order[:-1]
    before = previous[positions]
    common = np.zeros(len(positions), dtype=np.int64)
    live = np.flatnonzero(before >= 0)
    depth = 0
    while len(live) and depth < most:
        x, y = positions[live] + depth, before[live] + depth
        inside = (x < n) & (y < n)
        live, x, y = live[inside], x[inside], y[inside]
        live = live[text[x] == text[y]]
        depth += 1
        common[live] = depth
    return before, common
