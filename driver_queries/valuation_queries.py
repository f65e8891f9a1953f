"""Price models and their accuracy. Metrics are checked in SQL on a given prediction table; the
fitted models are checked by rows only, as another engine's trees differ."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driver_queries import tables as T
from driver_queries.registry import WITH_L, WITH_LE, query
from plotyard import fixed_values as fv
from plotyard.functions import pricing
from plotyard.operators import metrics, models, sampling
from plotyard.session import scratch_path
from plotyard.sources import io

MARKETS = ("built", "land")


def _rows(spark, sf):
    listings = T.listings(spark, sf)
    flags = {f"{f}_na": F.col(f).isNull() for f in ("beds", "livings", "wc", "furnished", "street_width")}
    filled = listings.withColumns(flags).fillna(
        {"beds": 0, "livings": 0, "wc": 0, "furnished": 0, "street_width": 0.0}
    )
    return models.modelling_rows(filled.fillna({"district": "none"}))


def _union(frames):
    return reduce(DataFrame.unionByName, frames)


def _given(spark, sf):
    """Sale listings with the stand-in estimate as their prediction."""
    joined = T.listings(spark, sf).join(T.estimates(spark, sf), "id")
    market = pricing.market_for(F.col("estate_type"))
    area = F.when(market == "land", F.col("area")).otherwise(1.0)
    return joined.select(
        "id", market.alias("market"), "price", F.col("estimate").alias("predicted"),
        F.log1p(F.col("price") / area).alias("true_log"),
        F.log1p(F.col("estimate") / area).alias("predicted_log"), area.alias("scale"),
    )


_GIVEN_SQL = (
    f"{WITH_LE}, g AS MATERIALIZED (SELECT l.id, estimate_market AS market, price, estimate AS predicted, ln(1 + price / a) AS t, ln(1 + estimate / a) AS p, "
    "price / a AS tu, estimate / a AS pu FROM (SELECT *, CASE WHEN estate_type = 'land' THEN CASE WHEN area > 0 THEN area END ELSE 1e0 END AS a "
    "FROM l) l JOIN e USING (id))"
)
_METRICS_SQL = (
    "count(*) AS rows, round(1 - avg((p - t) ** 2) / var_pop(t), 6) AS R2_log, round(sqrt(avg((p - t) ** 2)), 6) AS RMSE_log, "
    "round(1 - avg((pu - tu) ** 2) / var_pop(tu), 6) AS R2_unit, round(avg(abs(pu - tu)), 3) AS MAE_unit, "
    "round(1 - avg((predicted - price) ** 2) / var_pop(price), 6) AS R2_total, round(avg(abs(predicted - price)), 2) AS MAE_total, "
    "round(median(abs(pu - tu) / tu * 100), 5) AS MedAPE_pct"
)


@query("D21_regression_metrics", f"{_GIVEN_SQL} SELECT market, {_METRICS_SQL} FROM g GROUP BY 1")
def _(spark, sf):
    table = metrics.accuracy(_given(spark, sf), ["market"])
    digits = {
        "R2_log": 6, "RMSE_log": 6, "R2_unit": 6, "MAE_unit": 3, "R2_total": 6, "MAE_total": 2,
        "MedAPE_pct": 5,
    }
    return table.select("market", "rows", *[F.round(c, d).alias(c) for c, d in digits.items()])


@query(
    "D22_interval",
    f"{_GIVEN_SQL} SELECT market, round(quantile_cont(price / predicted, 0.1), 8) AS low_q, round(quantile_cont(price / predicted, 0.9), 8) AS high_q "
    "FROM g GROUP BY 1",
)
def _(spark, sf):
    table = metrics.interval(_given(spark, sf))
    return table.select("market", *[F.round(c, 8).alias(c) for c in ("low_q", "high_q")])


@query(
    "K6_interval_columns",
    f"{_GIVEN_SQL}, i AS (SELECT market AS k, quantile_cont(price / predicted, 0.1) AS lo, quantile_cont(price / predicted, 0.9) AS hi FROM g GROUP BY 1) "
    "SELECT id, round_even(predicted, 0) AS estimate, round_even(predicted * lo, 0) AS estimate_low, round_even(predicted * hi, 0) AS estimate_high, "
    "market AS estimate_market FROM g JOIN i ON market = k",
)
def _(spark, sf):
    given = _given(spark, sf)
    return metrics.with_interval(given, metrics.interval(given))


_BUCKET = "('0x' || substr(md5('42|' || CAST(id AS VARCHAR)), 1, 7))::BIGINT % 100"


@query(
    "D33_leaderboard",
    f"{_GIVEN_SQL}, s AS (SELECT market, {_BUCKET} < 70 AS train, count(*) AS n, 1 - avg((p - t) ** 2) / var_pop(t) AS r FROM g GROUP BY 1, 2) "
    "SELECT a.market AS target, 'gbt' AS model, round(a.r, 6) AS R2_log, b.n AS train_rows, round(b.r - a.r, 6) AS R2_gap, CASE a.market WHEN 'land' "
    "THEN 'lands' ELSE 'buildings' END AS label FROM s a JOIN s b ON a.market = b.market AND NOT a.train AND b.train",
)
def _(spark, sf):
    part = F.when(sampling.split_bucket() < 70, "train").otherwise("test")
    given = _given(spark, sf).withColumns(
        {"target": F.col("market"), "model": F.lit("gbt"), "split": part}
    )
    board = metrics.leaderboard(metrics.accuracy(given, ["target", "model", "split"]))
    return board.select(
        "target", "model", F.round("R2_log", 6).alias("R2_log"), "train_rows",
        F.round("R2_gap", 6).alias("R2_gap"), "label",
    )


@query(
    "D34_returns",
    f"{_GIVEN_SQL}, s AS (SELECT market AS target, count(*) AS params, 1 - avg((p - t) ** 2) / var_pop(t) AS r FROM g GROUP BY 1) "
    "SELECT target, params, round(r / 2, 4) AS R2_per_train_s, round(params / (r * 100), 1) AS params_per_R2_point FROM s",
)
def _(spark, sf):
    scored = metrics.accuracy(_given(spark, sf), ["market"]).select(
        F.col("market").alias("target"), F.lit("gbt").alias("model"), F.col("rows").alias("params"),
        F.lit(2.0).alias("train_total_s"), "R2_log",
    )
    return metrics.returns(scored).select("target", "params", "R2_per_train_s", "params_per_R2_point")


_RANK = "(rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2e0)"


@query(
    "D20_rank_correlations",
    f"{WITH_L}, b AS (SELECT city, count(*) AS params, avg(price) AS mean_price, avg(area) AS mean_area FROM l GROUP BY 1), "
    f"r AS (SELECT {_RANK.format('params')} AS n, {_RANK.format('mean_price')} AS p, {_RANK.format('mean_area')} AS a FROM b) "
    "SELECT 'mean_price' AS metric, 'params' AS size, round(corr(p, n), 3) AS rho FROM r UNION ALL "
    "SELECT 'mean_area', 'params', round(corr(a, n), 3) FROM r",
)
def _(spark, sf):
    board = T.listings(spark, sf).groupBy("city").agg(
        F.count(F.lit(1)).alias("params"), F.avg("price").alias("mean_price"), F.avg("area").alias("mean_area")
    )
    return metrics.rank_correlations(board, ["mean_price", "mean_area"], ["params"])


@query("K1_vocabulary", f"{WITH_LE} SELECT DISTINCT city, CAST(dense_rank() OVER (ORDER BY city) - 1 AS DOUBLE) AS code FROM l JOIN e USING (id)")
def _(spark, sf):
    rows = _rows(spark, sf)
    encoders, _ = models.fit_encoders(rows)
    return encoders.transform(rows).select("city", F.col("city_code").alias("code")).distinct()


@query("K3_boosted_fit")
def _(spark, sf):
    rows = _rows(spark, sf)
    fits = models.fit_markets(rows, MARKETS)
    scored = [models.predict(models.market_rows(rows, m), x) for m, x in zip(MARKETS, fits)]
    return _union([part.select("id", "predicted_log", "predicted") for part in scored])


@query("K4_random_search")
def _(spark, sf):
    rows = _rows(spark, sf)
    found = models.at_once(spark, [lambda m=m: models.search(rows, m)[1] for m in MARKETS])
    scored = [(m, str(p), float(s)) for m, candidates in zip(MARKETS, found) for p, s in candidates]
    return spark.createDataFrame(scored, "target string, params string, rmse double")


def _out_of_fold(spark, sf, market):
    predictions = models.out_of_fold(_rows(spark, sf), market)
    return predictions.filter(F.col("predicted").isNotNull()).select("id", "market", "price")


@query("K5_out_of_fold", f"{WITH_LE} SELECT id, market, price FROM (SELECT id, estimate_market AS market, price FROM l JOIN e USING (id)) WHERE market = 'land'")
def _(spark, sf):
    return _out_of_fold(spark, sf, "land")


@query("K5_out_of_fold_built", f"{WITH_LE} SELECT id, market, price FROM (SELECT id, estimate_market AS market, price FROM l JOIN e USING (id)) WHERE market = 'built'")
def _(spark, sf):
    return _out_of_fold(spark, sf, "built")


@query("K7_score_described")
def _(spark, sf):
    rows = _rows(spark, sf)
    fitted = models.at_once(spark, [lambda m=m: models.value_market(rows, m, models.DEFAULT_PARAMS)[1] for m in MARKETS])
    # the described properties are the listings themselves, some in places nobody has seen; what was not given is null
    absent = {v: F.when(F.col(flag) == 0, F.col(v)) for flag, v in fv.MISSING_FLAG_OF.items()}
    given = sorted({f for x in fitted for f in x.features} - set(absent) - set(fv.MISSING_FLAG_OF) - {"city"})
    described = rows.select(
        F.col("id").alias("request_id"), F.when(F.col("is_urgent") == 1, "nowhere").otherwise(F.col("city")).alias("city"),
        "estate_type", *given, *[c.alias(v) for v, c in absent.items()],
        F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng"),
    )
    return models.score_described(described, fitted)


@query("A14_model_round_trip")
def _(spark, sf):
    from plotyard.plans.offline import load_fitted

    rows, folder, parts = _rows(spark, sf), scratch_path(spark, "model"), []
    for market, fitted in zip(MARKETS, models.fit_markets(rows, MARKETS)):
        io.save_model(fitted.model, fitted.metadata(), f"{folder}/models/{market}", spark)
        parts.append(models.predict(models.market_rows(rows, market), load_fitted(spark, folder, market)))
    return _union([part.select("id", "predicted") for part in parts])


@query("K9_linear_baselines")
def _(spark, sf):
    rows, parts = _rows(spark, sf), []
    for market in MARKETS:
        train, test = sampling.train_test_split(models.market_rows(rows, market))
        train, test, _ = models.linear_frame(train, test, market)
        scale = F.col("area_m2") if market == "land" else F.lit(1.0)
        for kind in ("linear", "ridge", "lasso"):
            model, _ = models.fit_linear(train, kind)
            scored = model.transform(test).select("true_log", "predicted_log", scale.alias("scale"))
            size = F.lit(models.model_size(model)).alias("coefficients")
            parts.append(
                metrics.accuracy(scored).select(F.lit(market).alias("target"), F.lit(kind).alias("model"), size, "rows", "R2_log")
            )
    return _union(parts)


@query("K8_standardised_train")
def _(spark, sf):
    rows, parts = _rows(spark, sf), []
    for market in MARKETS:
        train, test = sampling.train_test_split(models.market_rows(rows, market))
        scaled, _, kept = models.linear_frame(train, test, market)
        values = scaled.select(F.posexplode(vector_to_array("features")).alias("at", "v"))
        ends = [F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_samp("v"), 6).alias("std")]
        names = F.element_at(F.array(*map(F.lit, kept)), F.col("at") + 1).alias("feature")
        parts.append(values.groupBy("at").agg(*ends).select(F.lit(market).alias("target"), names, "mean", "std"))
    return _union(parts)


@query("K10_permutation_importance")
def _(spark, sf):
    rows = _rows(spark, sf)
    tables = [models.permutation_importance(rows, x).select(F.lit(x.market).alias("target"), "*") for x in models.fit_markets(rows, MARKETS)]
    return _union(tables)


@query("K11_model_size")
def _(spark, sf):
    rows = _rows(spark, sf)
    sizes = [(x.market, models.model_size(x.model), len(x.features)) for x in models.fit_markets(rows, MARKETS)]
    return spark.createDataFrame(sizes, "target string, leaves long, features long")


@query("K12_market_comparison")
def _(spark, sf):
    return models.compare_markets(_rows(spark, sf)).select("target", "split", "rows", "R2_log", "MedAPE_pct")


@query(
    "K2_feature_rows",
    f"{WITH_LE} SELECT estimate_market AS market, count(*) AS n, round(sum(ln(1 + CASE WHEN estimate_market = 'land' THEN price / CASE WHEN area > 0 THEN "
    "area END ELSE price END)), 4) AS target FROM l JOIN e USING (id) GROUP BY 1",
)
def _(spark, sf):
    rows = _rows(spark, sf)
    for market in ("built", "land"):
        models.assert_no_leakage(models.feature_names(rows.columns, market))
    return rows.groupBy("market").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("true_log"), 4).alias("target")
    )


_PRESENT = {"beds", "livings", "wc", "area", "street_width", "furnished", *fv.AMENITY_FLAGS, *(f"{f}_na" for f in ("beds", "livings", "wc", "furnished", "street_width"))}
_SOURCE_OF = {fv.MODEL_NAMES.get(c, c): c for c in fv.MODEL_SOURCE_COLUMNS if c in _PRESENT}
_VECTOR_FEATURES = {
    "built": ["city", "district", *(n for n in _SOURCE_OF if n not in fv.NOT_FEATURES)],
    "land": [n for n in fv.LAND_FEATURES if n in ("city", "district") or n in _SOURCE_OF],
}


def _feature_sql(name: str) -> str:
    if name in ("city", "district"):
        return f"{name}_code"
    source = _SOURCE_OF[name]
    return f"({source.removesuffix('_na')} IS NULL)::INT" if source.endswith("_na") else f"coalesce({source}, 0)"


@query(
    "K2_feature_vectors",
    f"{WITH_LE}, g AS (SELECT l.*, estimate_market AS market, coalesce(district, 'none') AS place FROM l JOIN e USING (id)), c AS (SELECT *, dense_rank() OVER "
    "(PARTITION BY market ORDER BY city) - 1 AS city_code, dense_rank() OVER (PARTITION BY market ORDER BY place) - 1 AS district_code FROM g) "
    + " UNION ALL ".join(
        f"SELECT '{m}' AS market, {i}::INT AS at, '{n}' AS feature, round(sum({_feature_sql(n)})::DOUBLE, 2) AS total, round(sum({_feature_sql(n)} * ln(1 + price))::DOUBLE, 2) "
        f"AS weighted FROM c WHERE market = '{m}'"
        for m, names in _VECTOR_FEATURES.items()
        for i, n in enumerate(names)
    ),
)
def _(spark, sf):
    """Every position of the encoded vectors, plain and weighted by the price, so that values out of place would show."""
    parts = []
    for market in MARKETS:
        encoded = models.encode(_rows(spark, sf), market)
        values = encoded.rows.select("price", F.posexplode(vector_to_array("features")).alias("at", "v"))
        names = F.element_at(F.array(*map(F.lit, encoded.features)), F.col("at") + 1).alias("feature")
        sums = [F.round(F.sum("v"), 2).alias("total"), F.round(F.sum(F.col("v") * F.log1p("price")), 2).alias("weighted")]
        parts.append(values.groupBy("at").agg(*sums).select(F.lit(market).alias("market"), "at", names, "total", "weighted"))
    return _union(parts)
