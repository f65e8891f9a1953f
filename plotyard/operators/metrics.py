"""Accuracy of price predictions: metrics, intervals, leaderboards and their correlations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotyard import fixed_values as fv
from plotyard.functions.pricing import absolute_error_pct
from plotyard.operators.joins import null_safe_join
from plotyard.operators.quantiles import grouped_quantiles


def accuracy(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Metrics per group from (true_log, predicted_log, scale): the fitted log space, the predicted
    unit, and total money (unit times scale). R2 uses sums of squares, so one pass suffices for
    everything but the median error."""
    by = list(by)
    t, p = F.col("true_log"), F.col("predicted_log")
    unit_t, unit_p = F.expm1(t), F.expm1(p)
    rows = predictions.select(
        *by, t.alias("t0"), p.alias("p0"), unit_t.alias("t1"), unit_p.alias("p1"),
        (unit_t * F.col("scale")).alias("t2"), (unit_p * F.col("scale")).alias("p2"),
        absolute_error_pct(unit_t, unit_p).alias("ape"),
    )
    extra = [F.count(F.lit(1)).alias("rows")]
    for i, name in enumerate(("log", "unit", "total")):
        error = F.col(f"p{i}") - F.col(f"t{i}")
        # var_pop is computed around the running mean, so large prices do not cancel out
        extra += [
            (1 - F.try_divide(F.avg(error * error), F.var_pop(f"t{i}"))).alias(f"R2_{name}"),
            F.sqrt(F.avg(error * error)).alias(f"RMSE_{name}"),
            F.avg(F.abs(error)).alias(f"MAE_{name}"),
        ]
    extra += [
        (F.avg((F.col("ape") <= 0.10).cast("double")) * 100).alias("within_10_pct"),
        (F.avg((F.col("ape") <= 0.20).cast("double")) * 100).alias("within_20_pct"),
    ]
    scored = grouped_quantiles(rows, by, {"ape": (F.col("ape") * 100, {"MedAPE_pct": 0.5})}, extra)
    return scored.drop("MAE_log")


def interval(
    predictions: DataFrame, by: Sequence[str] = ("market",),
    quantiles: tuple[float, float] = fv.INTERVAL_QUANTILES,
) -> DataFrame:
    """Empirical quantiles of true / predicted price per group."""
    ratio = F.try_divide(F.col("price"), F.col("predicted"))
    return grouped_quantiles(
        predictions, by, {"ratio": (ratio, {"low_q": quantiles[0], "high_q": quantiles[1]})}
    )


def with_interval(predictions: DataFrame, intervals: DataFrame, by: Sequence[str] = ("market",)) -> DataFrame:
    """Estimate and its bounds, rounded half-even to whole money."""
    joined = null_safe_join(predictions, intervals, by)
    value = F.col("predicted")
    return joined.select(
        "id",
        F.bround(value, 0).alias("estimate"),
        F.bround(value * F.col("low_q"), 0).alias("estimate_low"),
        F.bround(value * F.col("high_q"), 0).alias("estimate_high"),
        F.col("market").alias("estimate_market"),
    )


def _mapped(column: str, values: Mapping[str, object]) -> Column:
    table = F.create_map(*[F.lit(v) for pair in values.items() for v in pair])
    return table[F.col(column)]


def leaderboard(scored: DataFrame) -> DataFrame:
    """Train and test metrics (rows with ``split``) side by side per (target, model), with the R2
    gap, in reading order."""
    train = scored.filter("split = 'train'").select(
        "target", "model", F.col("R2_log").alias("R2_log_train"), F.col("rows").alias("train_rows")
    )
    test = scored.filter("split = 'test'").drop("split", "rows")
    return (
        test.join(train, ["target", "model"])
        .withColumn("R2_gap", F.col("R2_log_train") - F.col("R2_log"))
        .withColumn("label", _mapped("target", fv.TARGET_LABEL))
        .orderBy(_mapped("target", fv.TARGET_RANK), _mapped("model", fv.MODEL_RANK), "model")
    )


def returns(board: DataFrame) -> DataFrame:
    """What each model got back for its size and its training time."""
    return board.select(
        "target", "model", "params", "train_total_s", "R2_log",
        F.round(F.try_divide(F.col("R2_log"), F.col("train_total_s")), 4).alias("R2_per_train_s"),
        F.round(F.try_divide(F.col("params"), F.col("R2_log") * 100), 1).alias("params_per_R2_point"),
    )


def rank_correlations(board: DataFrame, columns: Sequence[str], against: Sequence[str]) -> DataFrame:
    """Spearman correlation of each metric column with each size column: (metric, size, rho)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    names = [*columns, *against]
    numeric = board.select(*[F.col(c).cast("double").alias(c) for c in names]).dropna()
    vectors = VectorAssembler(inputCols=names, outputCol="v").transform(numeric)
    matrix = Correlation.corr(vectors, "v", "spearman").first()[0].toArray()
    rows = [
        (c, a, round(float(matrix[names.index(c)][names.index(a)]), 3))
        for c in columns
        for a in against
    ]
    return board.sparkSession.createDataFrame(rows, "metric string, size string, rho double")
