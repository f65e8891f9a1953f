"""Measured accuracy of the extraction: ground truth, samples, metrics, gates and a baseline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotyard import fixed_values as fv
from plotyard.operators.extraction.fields import exempt
from plotyard.operators.extraction.run import Extractor, outcomes
from plotyard.operators.joins import null_safe_join
from plotyard.operators.quantiles import grouped_quantiles
from plotyard.operators.sampling import hash_key, stratified_sample

DETAIL = ("id", "field", "actual", "predicted", "status", "evidence", "latency_ms")


def eligible(df: DataFrame, field: str) -> DataFrame:
    """Rows usable as truth: value present, field meaningful for the type, text usable."""
    return df.filter(
        F.col(field).isNotNull() & ~exempt(field) & (F.length("clean") >= fv.MIN_USABLE_CHARS)
    )


def evaluate_field(
    df: DataFrame, field: str, extractor: Extractor, sample_size: int, model_name: str, seed: int = 42
) -> DataFrame:
    """Detail rows of one field: sample per type, hide the value, extract, compare."""
    sample = stratified_sample(
        eligible(df, field), "estate_type", sample_size, hash_key("id", seed=seed)
    )
    work = sample.select("id", "clean", F.array(F.lit(field)).alias("needed"))
    judged = outcomes(work, extractor, model_name).filter(F.col("field") == field)
    truth = sample.select("id", "estate_type", F.col(field).cast("double").alias("actual"))
    return truth.join(judged, "id").select(
        "id", "field", "estate_type", "actual", F.col("value").alias("predicted"), "status",
        "evidence", "latency_ms",
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom)


def field_metrics(detail: DataFrame, by: Sequence[str] = ("field",)) -> DataFrame:
    """Coverage, exactness, errors, precision/recall/F1, rejections and the gate per group, in one
    aggregation. ``detail`` has field, actual, predicted and status."""
    used = F.col("status").isin(*fv.ACCEPTED_STATUSES) & F.col("predicted").isNotNull()
    error = F.when(used, F.abs(F.col("actual") - F.col("predicted")))
    said, so = F.col("predicted") == 1, F.col("actual") == 1
    tolerance = fv.GATES["street_width_tolerance"]
    counted = detail.groupBy(*by).agg(
        F.count(F.lit(1)).alias("sampled"),
        F.count_if(used).alias("attempted"),
        F.count_if(error == 0).alias("__exact"),
        F.count_if(error <= 1).alias("__one"),
        F.count_if(error <= tolerance).alias("__within"),
        F.sum(error).alias("__error"),
        F.count_if(used & said & so).alias("__tp"),
        F.count_if(used & said & (F.col("actual") == 0)).alias("__fp"),
        F.count_if(used & (F.col("predicted") == 0) & so).alias("__fn"),
        *[
            F.count_if(F.col("status") == s).alias(s)
            for s in ("rejected_ungrounded", "rejected_out_of_range", "retry_exhausted")
        ],
    )
    boolean = F.col("field") == "furnished"
    tried = F.col("attempted") > 0
    zero = F.lit(0.0)
    precision = F.coalesce(_ratio(F.col("__tp"), F.col("__tp") + F.col("__fp")), zero)
    recall = F.coalesce(_ratio(F.col("__tp"), F.col("__tp") + F.col("__fn")), zero)
    measured = counted.withColumns(
        {
            "coverage": F.coalesce(_ratio(F.col("attempted"), F.col("sampled")), zero),
            "exact_match": _ratio(F.col("__exact"), F.col("attempted")),
            "off_by_one": F.when(~boolean, _ratio(F.col("__one"), F.col("attempted"))),
            "mae": F.when(~boolean, _ratio(F.col("__error"), F.col("attempted"))),
            "within_tolerance": F.when(~boolean, _ratio(F.col("__within"), F.col("attempted"))),
            "precision": F.when(boolean & tried, precision),
            "recall": F.when(boolean & tried, recall),
        }
    )
    both = F.col("precision") + F.col("recall")
    scored = measured.withColumn(
        "f1",
        F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).when(both == 0, zero),
    )
    gate = (
        F.when(
            boolean,
            (F.col("precision") >= fv.GATES["furnished_precision"])
            & (F.col("f1") >= fv.GATES["furnished_f1"]),
        )
        .when(
            F.col("field") == "street_width",
            (F.col("within_tolerance") >= fv.GATES["street_width_within"])
            & (F.col("mae") <= fv.GATES["street_width_mae"]),
        )
        .otherwise(
            (F.col("exact_match") >= fv.GATES["count_exact"])
            & (F.col("off_by_one") >= fv.GATES["count_off_by_one"])
        )
    )
    return scored.withColumn("passed_gate", F.coalesce(gate, F.lit(False))).drop(
        "__exact", "__one", "__within", "__error", "__tp", "__fp", "__fn"
    )


def group_median_fill(
    df: DataFrame, field: str, sample: DataFrame, group: str = "district_id"
) -> DataFrame:
    """Sampled rows with the median of their group, sampled rows excluded from it, and the overall
    median where the group has none."""
    rest = df.join(sample.select("id"), "id", "left_anti")
    medians = grouped_quantiles(rest, [group], {"v": (F.col(field), {"group_median": 0.5})})
    overall = grouped_quantiles(rest, [], {"v": (F.col(field), {"overall": 0.5})})
    rows = df.join(sample.select("id"), "id", "left_semi").filter(F.col(field).isNotNull())
    return null_safe_join(rows, medians, [group], "left").select(
        "id", group, F.col(field).cast("double").alias("actual"),
        F.coalesce("group_median", overall.scalar()).alias("predicted"),
    )


def median_baseline(
    df: DataFrame, field: str, sample: DataFrame, group: str = "district_id"
) -> DataFrame:
    """Exactness, mean error and within-tolerance share of filling from the group median."""
    error = F.abs(F.col("actual") - F.col("predicted"))
    return group_median_fill(df, field, sample, group).agg(
        F.avg((error == 0).cast("double")).alias("exact_match"),
        F.avg(error).alias("mae"),
        F.avg((error <= fv.GATES["street_width_tolerance"]).cast("double")).alias("within_tolerance"),
    )


def gate_report(metrics: DataFrame) -> DataFrame:
    """One readable line per field, failed ones first."""
    boolean = F.col("field") == "furnished"

    def pct(name: str) -> Column:
        return F.format_string("%.3f", F.col(name))

    figures = F.when(
        boolean, F.concat(F.lit("precision "), pct("precision"), F.lit(", F1 "), pct("f1"))
    ).otherwise(F.concat(F.lit("exact "), pct("exact_match"), F.lit(", MAE "), pct("mae")))
    verdict = F.when(F.col("passed_gate"), "passed").otherwise("failed")
    return metrics.select(
        "field", "passed_gate", verdict.alias("verdict"),
        F.coalesce(figures, F.lit("nothing attempted")).alias("figures"),
    ).orderBy("passed_gate", "field")


def trusted_fields(metrics: DataFrame) -> list[str]:
    """Fields that cleared their gate (at most one per extraction target)."""
    return sorted(r[0] for r in metrics.filter("passed_gate").select("field").collect())
