"""Saved searches are counted in blocks: the same counts at every block size, and no row per listing and shape of search."""

import itertools
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plotyard.operators import range_counts, searches

LISTING = "id long, lat double, lng double, price double, area double, beds int, estate_type string, estate_benefit string, city string, district string"
SEARCH = (
    "search_id long, purpose string, estate_type string, price_min double, price_max double, area_min double, area_max double, "
    "min_beds double, city string, district string, near_lat double, near_lng double, near_km double"
)
NAN, INF = math.nan, math.inf


def _listings():
    rows = []
    for i in range(400):
        price = (None, NAN, 0.0)[i // 40 % 3] if i % 40 == 0 else float(i * 7919 % 90)
        area = (None, NAN, INF)[i // 37 % 3] if i % 37 == 0 else float(i * 31 % 50)
        place = (None, None) if i % 43 == 0 else (24.0 + i * 37 % 100 / 250, 46.0 + i * 53 % 100 / 250)
        rows.append((i, *place, price, area, i % 6 if i % 7 else None, ("villa", "land", None)[i % 3], ("sell", "rental")[i % 5 == 0],
                     (None, "big", "small")[i % 4 % 3], None if i % 11 == 0 else f"d{i % 3}"))
    return rows


def _searches():
    """Every combination of criteria that are set or not, so all shapes are in use."""
    values = itertools.product((None, "sell"), (None, "land"), ((None, None), (20.0, None), (None, 60.0), (15.0, 55.0), (60.0, 20.0)),
                               ((None, None), (10.0, 40.0)), (None, 2.5), (None, "big"), (None, "d1"), ((None, None, None), (24.2, 46.2, 10.0), (24.249, 46.01, 20.0)))
    return [(k, p, t, *price, *area, beds, city, d, *near) for k, (p, t, price, area, beds, city, d, near) in enumerate(values)]


def _holds(x, low, high):
    """SQL's comparisons: NULL meets no bound, NaN is above all numbers."""
    if low is None and high is None:
        return True
    if x is None:
        return False
    x = INF if math.isnan(x) else x
    return (low is None or x >= low) and (high is None or x <= high)


def _matches(row, s):
    _, lat, lng, price, area, beds, kind, purpose, city, district = row
    _, p, t, low_p, high_p, low_a, high_a, rooms, c, d, y, x, km = s
    if any(w is not None and v != w for v, w in ((purpose, p), (kind, t), (city, c), (district, d))):
        return False
    if not (_holds(price, low_p, high_p) and _holds(area, low_a, high_a) and _holds(beds, rooms, None)):
        return False
    if km is None:
        return True
    if lat is None:
        return False
    dy, dx = (lat - y) * 111.19492664455873, (lng - x) * (111.19492664455873 * math.cos(math.radians(y)))
    return dx * dx + dy * dy <= km * km


@pytest.mark.parametrize("block_rows", [1_000_000, 23])
def test_counts_equal_the_full_comparison(spark, monkeypatch, block_rows):
    def never(*_):
        raise AssertionError("a row per listing and shape of search")

    monkeypatch.setattr(searches, "_cube_keys", never)
    monkeypatch.setattr(searches, "BLOCK_ROWS", block_rows, raising=False)
    rows, asked = _listings(), _searches()
    want = {s[0]: sum(_matches(r, s) for r in rows) for s in asked}
    assert len({tuple(v is None for v in s[1:]) for s in asked}) > 128 and sum(v > 0 for v in want.values()) > len(want) / 4
    got = searches.match_counts(spark.createDataFrame(rows, LISTING).repartition(3), spark.createDataFrame(asked, SEARCH))
    assert {r["search_id"]: r["matches"] for r in got.collect()} == want


def test_a_listing_is_sent_three_times_at_most(spark, monkeypatch):
    """Whatever the shapes in use: 960 searches of all shapes do not send more listings than those of one."""

    def listings_sent(batches):
        for batch in batches:
            n = sum(not a for a in batch.column("asks").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([n], pa.int64())], names=["rep", "n"])

    monkeypatch.setattr(searches, "count_blocks", listings_sent)
    rows, asked = spark.createDataFrame(_listings(), LISTING), spark.createDataFrame(_searches(), SEARCH)
    sent = searches.block_counts(rows, searches._distinct(asked)[0]).agg(F.sum("n")).first()[0]
    assert 400 < sent <= 3 * 400
    broad = asked.filter("city IS NULL AND near_km IS NULL")
    assert searches.block_counts(rows, searches._distinct(broad)[0]).agg(F.sum("n")).first()[0] == 400


@pytest.mark.parametrize("few", [0, 10_000])
def test_ranges_of_price_and_area_are_counted_exactly(monkeypatch, few):
    monkeypatch.setattr(range_counts, "FEW", few)
    draw = np.random.default_rng(5)
    for n in (0, 1, 2, 63, 64, 65, 300):
        price, area = (np.where(draw.random(n) < 0.1, np.nan, draw.integers(0, 40, n).astype(float)) for _ in range(2))
        price[draw.random(n) < 0.05] = np.inf
        price = np.sort(price)
        bounds = np.where(draw.random((4, 500)) < 0.4, np.nan, draw.integers(-3, 44, (4, 500)).astype(float))
        want = []
        for low_p, high_p, low_a, high_a in bounds.T:
            kept = np.ones(n, bool)
            for values, low, high in ((price, low_p, high_p), (area, low_a, high_a)):
                kept &= np.isnan(low) | (values >= low)
                kept &= np.isnan(high) | (values <= high)
            want.append(kept.sum())
        assert range_counts.in_ranges(price, area, bounds).tolist() == want
