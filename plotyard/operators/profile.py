"""Column profiles, rates, counts and distribution tables - each one pass over the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotyard.functions.pricing import half_even
from plotyard.operators.quantiles import grouped_quantiles


def _unpivot(row: DataFrame, prefixes: Sequence[str], names: Sequence[str], label: str) -> DataFrame:
    """One wide row ``<prefix><i>`` to one row per name."""
    entries = [
        F.struct(
            F.lit(name).alias(label), *[F.col(f"{p}{i}").alias(p.strip("_")) for p in prefixes]
        )
        for i, name in enumerate(names)
    ]
    return row.select(F.explode(F.array(*entries)).alias("r")).select("r.*")


def column_profile(df: DataFrame) -> DataFrame:
    """Type, non-null count and null share (1 decimal) per column."""
    names = df.columns
    kinds = dict(df.dtypes)
    one = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(F.col(f"`{c}`")).alias(f"non_null{i}") for i, c in enumerate(names)],
    )
    typed = one.select("*", *[F.lit(kinds[c]).alias(f"dtype{i}") for i, c in enumerate(names)])
    share = [
        half_even(100 - F.try_divide(F.col(f"non_null{i}"), F.col("rows")) * 100, 1).alias(f"null_pct{i}")
        for i in range(len(names))
    ]
    nulls = [(F.col("rows") - F.col(f"non_null{i}")).alias(f"nulls{i}") for i in range(len(names))]
    return _unpivot(
        typed.select("*", *share, *nulls), ["dtype", "non_null", "nulls", "null_pct"], names, "column"
    )


def null_profile_by(df: DataFrame, column: str, by: str) -> DataFrame:
    return df.groupBy(by).agg(
        F.count_if(F.col(column).isNull()).alias("nulls"),
        F.count(column).alias("non_null"),
        F.count(F.lit(1)).alias("total"),
    )


def value_counts(df: DataFrame, column: str, keep_null: bool = True) -> DataFrame:
    """Count and share per value. The total comes from the counts, so the data is read once."""
    source = df if keep_null else df.filter(F.col(column).isNotNull())
    counts = source.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n"))
    return counts.withColumn("share", F.col("n") / total.scalar())


def size_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))


def rates(df: DataFrame, flags: Sequence[str] | dict[str, Column]) -> DataFrame:
    """Share of raised flags in percent (2 decimals), lowest first."""
    columns = flags if isinstance(flags, dict) else {f: F.col(f) for f in flags}
    names = list(columns)
    one = df.agg(
        *[
            half_even(F.avg(c.cast("double")) * 100, 2).alias(f"rate_pct{i}")
            for i, c in enumerate(columns.values())
        ]
    )
    return _unpivot(one, ["rate_pct"], names, "flag").orderBy("rate_pct", "flag")


def group_mean(df: DataFrame, column: str, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.avg(column).alias(f"mean_{column}"))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max, one row per column."""
    quartiles = {
        f"q{i}": (F.col(c), {f"p25{i}": 0.25, f"p50{i}": 0.5, f"p75{i}": 0.75})
        for i, c in enumerate(columns)
    }
    extra = []
    for i, c in enumerate(columns):
        value = F.col(c).cast("double")
        extra += [
            F.count(value).alias(f"count{i}"),
            F.avg(value).alias(f"mean{i}"),
            F.stddev_samp(value).alias(f"std{i}"),
            F.min(value).alias(f"min{i}"),
            F.max(value).alias(f"max{i}"),
        ]
    one = grouped_quantiles(df, [], quartiles, extra)
    return _unpivot(
        one, ["count", "mean", "std", "min", "p25", "p50", "p75", "max"], columns, "column"
    )


def quantile_table(df: DataFrame, column: str, probs: Sequence[float]) -> DataFrame:
    """One row per probability."""
    one = grouped_quantiles(
        df, [], {"v": (F.col(column), {f"value{i}": p for i, p in enumerate(probs)})}
    )
    return _unpivot(one, ["value"], [float(p) for p in probs], "prob")


def tail_counts(df: DataFrame, column: str, prob: float) -> DataFrame:
    """Counts per value above a quantile, with the cut and the size of the whole tail.

    The cut is a scalar subquery and the tail size comes from the counts, not from the rows."""
    cut = grouped_quantiles(df, [], {"v": (F.col(column), {"cut": prob})})
    tail = (
        df.select(F.col(column).cast("double").alias("value"))
        .withColumn("cut", cut.scalar())
        .filter(F.col("value") > F.col("cut"))
        .groupBy("value", "cut")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    above = tail.agg(F.sum("n"))
    return tail.withColumn("above", above.scalar())


def histogram(
    df: DataFrame, column: str, bins: int = 50, trim: tuple[float, float] | None = (0.001, 0.99),
    log10: bool = False,
) -> DataFrame:
    """Equal-width histogram of the trimmed (or log10 of the positive) values: bin, edges, count."""
    value = F.col(column).cast("double")
    source = df.select(F.when(value > 0, F.log10(value)).alias("v") if log10 else value.alias("v"))
    if trim is not None:
        cuts = grouped_quantiles(source, [], {"v": (F.col("v"), {"a": trim[0], "b": trim[1]})})
        low, high = cuts.select("a").scalar(), cuts.select("b").scalar()
        source = source.filter((F.col("v") >= low) & (F.col("v") <= high))
    source = source.filter(F.col("v").isNotNull())
    span = source.agg(F.min("v").alias("a"), F.max("v").alias("b"))
    low, high = span.select("a").scalar(), span.select("b").scalar()
    width = (high - low) / bins
    position = F.when(width > 0, F.floor((F.col("v") - low) / width)).otherwise(0)
    placed = source.select(F.least(position, F.lit(bins - 1)).cast("int").alias("bin"))
    counted = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(
        "bin",
        (low + F.col("bin") * width).alias("left_edge"),
        (low + (F.col("bin") + 1) * width).alias("right_edge"),
        "n",
    )


def box_stats(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Quartiles, whiskers (furthest value within 1.5 IQR) and outlier count per group."""
    by = list(by)
    quartiles = grouped_quantiles(
        df, by, {"v": (F.col(column), {"q1": 0.25, "median": 0.5, "q3": 0.75})}
    ).withColumns(
        {
            "low": F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")),
            "high": F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")),
        }
    )
    value = F.col(column).cast("double")
    if by:
        from plotyard.operators.joins import null_safe_join

        fenced = null_safe_join(df.select(*by, value.alias("v")), quartiles, by)
    else:
        fenced = df.select(
            value.alias("v"),
            *[quartiles.select(c).scalar().alias(c) for c in quartiles.columns],
        )
    inside = (F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high"))
    return fenced.groupBy(*by, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )


def fill_audit(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls before and after a fill step and the difference, per column."""

    def nulls(df: DataFrame) -> DataFrame:
        return _unpivot(
            df.agg(*[F.count_if(F.col(c).isNull()).alias(f"nulls{i}") for i, c in enumerate(columns)]),
            ["nulls"], columns, "column",
        )

    left = nulls(before).withColumnRenamed("nulls", "nulls_before")
    right = nulls(after).withColumnRenamed("nulls", "nulls_after")
    return left.join(right, "column").withColumn(
        "filled", F.col("nulls_before") - F.col("nulls_after")
    )


def top_correlations(df: DataFrame, columns: Sequence[str], threshold: float = 0.7) -> DataFrame:
    """Column pairs with an absolute Pearson correlation above the threshold, strongest first."""
    return correlation_pairs(df, columns).filter(F.abs("r") > threshold).orderBy(
        F.abs("r").desc(), "a", "b"
    )


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every column pair, complete pairs only, in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(
        *[
            F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}")
            for i, (a, b) in enumerate(pairs)
        ]
    )
    entries = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r"))
        for i, (a, b) in enumerate(pairs)
    ]
    return one.select(F.explode(F.array(*entries)).alias("p")).select("p.*")
