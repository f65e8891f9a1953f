"""Within an Arrow task: how many listings of a block every search of that block matches, exactly and without a row per search and listing.

Listings are held ordered by price, so a price range is two look-ups. Searches come ordered by what they ask for: those that differ in
ranges only share one selection of the listings. Prices and areas together are counted by ranks of the area within runs of the price order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CATEGORIES = ("purpose", "estate_type", "city", "district")
NUMBERS = ("lat", "lng", "price", "area", "beds")
FEW = 2_000  # searches whose ranges are counted one by one; the same counts either way


def _numbers(column: pa.Array) -> np.ndarray:
    """NULL is NaN here and meets no bound; a NaN is above every number, as in SQL."""
    above = pc.if_else(pc.is_nan(column), pa.scalar(np.inf, pa.float64()), column)
    return np.array(above.to_numpy(zero_copy_only=False), dtype=float)


def _below(ranks: np.ndarray, ends: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """For every (end, limit): how many of ``ranks[:end]`` are below the limit. A prefix is one chunk of each power of two in its length."""
    n, found = len(ranks), np.zeros(len(ends), np.int64)
    at = np.arange(n, dtype=np.int64)
    for level in range(n.bit_length()):
        has = np.flatnonzero((ends >> level) & 1)
        if len(has):
            keyed = np.sort((at >> level) * (n + 1) + ranks)
            chunk = (ends[has] >> level) - 1
            found[has] += np.searchsorted(keyed, chunk * (n + 1) + limits[has]) - (chunk << level)
    return found


def in_ranges(price: np.ndarray, area: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows within each search's ranges. ``price`` ascends, NaN last; ``bounds`` has a column per search: least and greatest price,
    least and greatest area, NaN where not given."""
    given = ~np.isnan(bounds)
    low_p, high_p, low_a, high_a = np.where(given, bounds, np.array([[-np.inf], [np.inf], [-np.inf], [np.inf]]))
    priced, sized = given[0] | given[1], given[2] | given[3]
    known = np.searchsorted(price, np.nan)
    first = np.where(priced, np.searchsorted(price[:known], low_p, "left"), 0)
    last = np.maximum(first, np.where(priced, np.searchsorted(price[:known], high_p, "right"), len(price)))
    counts = (last - first).astype(np.int64)
    wanted = np.flatnonzero(sized & (last > first))
    if not len(wanted):
        return counts
    first, last = first[wanted], last[wanted]
    if len(wanted) <= FEW:
        counts[wanted] = [
            np.count_nonzero((area[i:j] >= a) & (area[i:j] <= b)) for i, j, a, b in zip(first, last, low_a[wanted], high_a[wanted])
        ]
        return counts
    order = np.argsort(area, kind="stable")
    ranks = np.empty(len(area), np.int64)
    ranks[order] = np.arange(len(area))
    ascending = area[order]
    ascending = ascending[: np.searchsorted(ascending, np.nan)]
    from_, to = np.searchsorted(ascending, low_a[wanted], "left"), np.searchsorted(ascending, high_a[wanted], "right")
    to = np.maximum(from_, to)
    ends, limits = np.concatenate([last, last, first, first]), np.concatenate([to, from_, to, from_])
    counts[wanted] = np.array([1, -1, -1, 1]) @ _below(ranks, ends, limits).reshape(4, -1)
    return counts


class _Block:
    """The listings of a block, categories as numbers."""

    def __init__(self, name: str) -> None:
        self.name = name
        self.codes: list[dict[str, int]] = [{} for _ in CATEGORIES]
        self.parts: list[list[np.ndarray]] = []
        self.columns: list[np.ndarray] = []
        self.selected: tuple[tuple[int, ...], list[np.ndarray]] | None = None

    def _coded(self, column: pa.Array, codes: dict[str, int], absent: int, new: bool) -> np.ndarray:
        """Numbers of the values, ``absent`` for NULL; a value no listing has is -1."""
        encoded = column.dictionary_encode()
        names = encoded.dictionary.to_pylist()
        known = [codes.setdefault(v, len(codes)) if new else codes.get(v, -1) for v in names]
        places = encoded.indices.fill_null(len(names)).to_numpy(zero_copy_only=False)
        return np.array([*known, absent], dtype=np.int32)[places]

    def add(self, rows: pa.RecordBatch) -> None:
        categories = [self._coded(rows.column(c), codes, -1, True) for c, codes in zip(CATEGORIES, self.codes)]
        self.parts.append(categories + [_numbers(rows.column(c)) for c in NUMBERS])

    def _held(self) -> list[np.ndarray]:
        if self.parts:
            columns = [np.concatenate(c) for c in zip(*self.parts)]
            self.parts = []
            order = np.argsort(columns[len(CATEGORIES) + NUMBERS.index("price")], kind="stable")
            self.columns = [c[order] for c in columns]
        return self.columns

    def _select(self, wanted: tuple[int, ...]) -> list[np.ndarray]:
        """Numbers of the listings with these categories, -2 being any."""
        if self.selected is None or self.selected[0] != wanted:
            columns = self._held()
            categories, numbers = columns[: len(CATEGORIES)], columns[len(CATEGORIES) :]
            tests = [c == w for c, w in zip(categories, wanted) if w != -2]
            self.selected = (wanted, [n[np.logical_and.reduce(tests)] for n in numbers] if tests else numbers)
        return self.selected[1]

    def count(self, rows: pa.RecordBatch) -> np.ndarray:
        """Matches of each search."""
        asked = [self._coded(rows.column(c), codes, -2, False) for c, codes in zip(CATEGORIES, self.codes)]
        lat, lng, low_p, low_a, beds = (_numbers(rows.column(c)) for c in NUMBERS)
        high_p, high_a, km, per_lng, per_lat = (_numbers(rows.column(c)) for c in ("price_max", "area_max", "km", "km_per_lng", "km_per_lat"))
        bounds, counts = np.stack([low_p, high_p, low_a, high_a]), np.zeros(rows.num_rows, np.int64)
        for i, j in _runs([*asked, *(np.nan_to_num(c, nan=np.inf) for c in (beds, lat, lng, km))]):
            wanted = tuple(int(c[i]) for c in asked)
            if -1 in wanted:
                continue
            y, x, price, area, rooms = self._select(wanted)
            tests = []
            if not np.isnan(km[i]):
                if not np.isnan(np.concatenate([low_p[i:j], high_p[i:j]])).any():  # all of them set both ends: only those prices are measured
                    known = np.searchsorted(price, np.nan)
                    some = slice(np.searchsorted(price[:known], low_p[i:j].min(), "left"), np.searchsorted(price[:known], high_p[i:j].max(), "right"))
                    y, x, price, area, rooms = (c[some] for c in (y, x, price, area, rooms))
                dy, dx = (y - lat[i]) * per_lat[i], (x - lng[i]) * per_lng[i]
                tests.append(dx * dx + dy * dy <= km[i] * km[i])
            if not np.isnan(beds[i]):
                tests.append(rooms >= beds[i])
            if tests:
                kept = np.logical_and.reduce(tests)
                price, area = price[kept], area[kept]
            counts[i:j] = in_ranges(price, area, bounds[:, i:j])
        return counts


def _runs(columns: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """(first, end) of rows that are equal in all columns and follow each other."""
    changes = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    ends = [0, *(np.flatnonzero(changes) + 1).tolist(), len(columns[0])]
    return zip(ends[:-1], ends[1:])


def count_blocks(batches):
    """Arrow task: rows ordered by block, the listings of a block (``asks`` false) before its searches; gives ``rep`` and ``n`` for each search."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        blocks, asks = batch.column("block").dictionary_encode(), batch.column("asks").to_numpy(zero_copy_only=False)
        for i, j in _runs([blocks.indices.to_numpy(), asks]):
            rows, name = batch.slice(i, j - i), blocks[i].as_py()
            if not asks[i]:
                if held is None or held.name != name:
                    held = _Block(name)
                held.add(rows)
            elif held is not None and held.name == name:
                yield pa.RecordBatch.from_arrays([rows.column("rep"), pa.array(held.count(rows))], names=["rep", "n"])
