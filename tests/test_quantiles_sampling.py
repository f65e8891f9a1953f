import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotyard.operators import joins, sampling
from plotyard.operators.quantiles import grouped_quantiles, nearest_rank_breaks, order_statistics


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(7)
    rows = [("hot", rng.choice([-3.5, 0.0, 2.0, rng.uniform(-1e6, 1e9)])) for _ in range(3000)]
    rows += [("cold", float(i)) for i in range(11)] + [(None, 5.0), (None, None), ("nan", float("nan"))]
    return spark.createDataFrame(rows, "k string, v double").repartition(5), rows


def _expected(rows, key, p):
    v = [x for k, x in rows if k == key and x is not None and not np.isnan(x)]
    return float(np.quantile(v, p)) if v else None


def test_grouped_quantiles_match_numpy(values):
    df, rows = values
    probs = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q995": 0.995, "q1": 1.0}
    got = grouped_quantiles(
        df, ["k"], {"v": (F.col("v"), probs)}, extra=[F.count(F.lit(1)).alias("n")]
    ).collect()
    assert {r["k"] for r in got} == {"hot", "cold", None, "nan"}
    for r in got:
        for name, p in probs.items():
            want = _expected(rows, r["k"], p)
            assert (r[name] is None) if want is None else r[name] == pytest.approx(want, rel=1e-12)


def test_global_quantile_without_keys(values, spark):
    df, rows = values
    spec = {"v": (F.col("v"), {"m": 0.5})}
    want = float(np.quantile([x for _, x in rows if x is not None and not np.isnan(x)], 0.5))
    assert grouped_quantiles(df, [], spec).first()["m"] == pytest.approx(want, rel=1e-12)
    assert [r["m"] for r in grouped_quantiles(df.limit(0), [], spec).collect()] == [None]


def test_order_statistics_are_the_sorted_values(values):
    df, rows = values
    ranks = {"first": lambda n: n * 0, "mid": lambda n: F.floor(n / 2), "last": lambda n: n - 1}
    got = {r["k"]: (r["n_values"], r["first"], r["mid"], r["last"]) for r in order_statistics(df, ["k"], F.col("v"), ranks).collect()}
    for key in ("hot", "cold", None):
        v = sorted(x for k, x in rows if k == key and x is not None)
        assert got.pop(key) == (len(v), v[0], v[len(v) // 2], v[-1])
    assert got == {}


def test_nothing_runs_before_the_action(values, spark):
    df, _ = values
    spark.sparkContext.setJobGroup("building quantiles", "")
    grouped_quantiles(df, ["k"], {"v": (F.col("v"), {"m": 0.5})})
    nearest_rank_breaks(df, ["k"], F.col("v"), 5)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup("building quantiles") == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("n", [0, 1, 4, 5, 9])
def test_nearest_rank_breaks(spark, n):
    df = spark.createDataFrame([("a", float(i * i)) for i in range(n)], "k string, v double")
    got = nearest_rank_breaks(df, ["k"], F.col("v"), 5).collect()
    if n == 0:
        assert got == []
    else:
        want = [float(int(i / 5 * (n - 1) + 0.5) ** 2) for i in range(1, 5)]
        assert got[0]["breaks"] == want


def test_uniform_sample_size_and_repeatability(spark):
    df = spark.range(5000).withColumnRenamed("id", "id")
    key = sampling.hash_key("id")
    first = {r[0] for r in sampling.uniform_sample(df, 700, key).collect()}
    again = {r[0] for r in sampling.uniform_sample(df.repartition(3), 700, key).collect()}
    assert first == again and len(first) == 700
    assert sampling.uniform_sample(df, 9000, key).count() == 5000


def test_stratified_quotas_round_half_even_and_never_zero(spark):
    rows = [(i, "big") for i in range(985)] + [(1000 + i, "mid") for i in range(14)] + [(2000, "tiny")]
    df = spark.createDataFrame(rows, "id long, t string")
    quotas = {r["t"]: r["quota"] for r in sampling.stratum_quotas(df, "t", 100).collect()}
    assert quotas == {"big": 98, "mid": 1, "tiny": 1}
    taken = sampling.stratified_sample(df, "t", 100, sampling.hash_key("id"))
    assert {r["t"]: r["count"] for r in taken.groupBy("t").count().collect()} == quotas
    assert sampling.stratified_sample(df, "t", 5000, sampling.hash_key("id")).count() == 1000


def test_null_keys_meet_in_null_safe_join(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2)], "k string, x int")
    right = spark.createDataFrame([(None, 10), ("a", 20)], "k string, y int")
    got = {(r["k"], r["x"], r["y"]) for r in joins.null_safe_join(left, right, ["k"]).collect()}
    assert got == {(None, 1, 10), ("a", 2, 20)}
