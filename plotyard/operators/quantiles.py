"""Exact order statistics and interpolated quantiles per group, at any group size, in one lazy plan.

1. Rows are counted per (group, label, value), combined map-side and spread by value.
2. Counts are added up per bucket, a monotone function of the value (about 15 millionths of it wide); running totals over the
   buckets of a group give exact bounds of the ranks in each and so find the bucket every wanted rank falls in.
3. Only the values of the buckets hit are ranked.

The same plan serves every size: nothing runs before the caller's action, no group is collected or sorted whole, and
running totals are only taken over buckets (bounded in number) or over the values of one bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotyard.operators.joins import null_safe_join

_LOG_STEPS = 65_536

Rank = Callable[[Column], Column]


def clean_numeric(value: Column) -> Column:
    """NaN ranks above every number, so it is turned into NULL before ranking."""
    value = value.cast("double")
    return F.when(~F.isnan(value), value)


def _asked(asks: Column) -> Column:
    """The asks whose rank lies among the rows before ``upto``, with their rank among these rows."""
    before = F.col("upto") - F.col("c")
    inside = F.filter(asks, lambda a: (a["rank"] >= before) & (a["rank"] < F.col("upto")))
    return F.transform(inside, lambda a: F.struct(a["stat"].alias("stat"), (a["rank"] - before).alias("rank")))


def _ranked(
    df: DataFrame, keys: Sequence[str], values: dict[str, tuple[Column, dict[str, Rank]]]
) -> DataFrame:
    """Per group ``g`` (a struct of the keys), also one without values: ``stats``, a map of the values at the wanted ranks,
    and ``counts``, a map of the values per label."""
    labelled = [F.struct(F.lit(label).alias("label"), clean_numeric(v).alias("v")) for label, (v, _) in values.items()]
    group = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]) if keys else F.struct(F.lit(0).alias("all"))
    rows = df.select(group.alias("g"), F.explode(F.array(*labelled)).alias("x")).select("g", "x.label", "x.v")
    bucket = F.floor(F.signum("v") * F.log1p(F.abs("v")) * _LOG_STEPS).alias("b")  # that of NULL is NULL and ranks nothing
    counted = rows.groupBy("g", "label", bucket, "v").agg(F.count(F.lit(1)).alias("c"))

    group_of = Window.partitionBy("g", "label")
    totals = counted.groupBy("g", "label", "b").agg(F.sum(F.when(F.col("v").isNotNull(), F.col("c")).otherwise(0)).alias("c"))
    upto = F.sum("c").over(group_of.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    known = totals.withColumns({"n": F.sum("c").over(group_of), "upto": upto})
    wanted = F.lit(None).cast("array<struct<stat:string,rank:bigint>>")
    for label, (_, ranks) in values.items():
        asks = [F.struct(F.lit(s).alias("stat"), fn(F.col("n")).cast("long").alias("rank")) for s, fn in ranks.items()]
        wanted = F.when(F.col("label") == label, F.array(*asks)).otherwise(wanted)
    hit = known.select("g", "label", "b", "n", _asked(wanted).alias("asks")).filter((F.size("asks") > 0) | F.col("b").isNull())

    inside = null_safe_join(counted, hit, ["g", "label", "b"])
    along = Window.partitionBy("g", "label", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = inside.withColumn("upto", F.sum("c").over(along))
    found = ranked.select("g", "label", "n", "v", _asked(F.col("asks")).alias("asks")).filter((F.size("asks") > 0) | F.col("v").isNull())
    found = found.select("g", "label", "n", F.transform("asks", lambda a: F.struct(a["stat"].alias("stat"), F.col("v").alias("v"))).alias("hits"))
    return found.groupBy("g").agg(
        F.map_from_entries(F.flatten(F.collect_list("hits"))).alias("stats"),
        F.map_from_entries(F.collect_set(F.struct("label", "n"))).alias("counts"),
    )


def _keys_of(keys: Sequence[str]) -> list[Column]:
    return [F.col(f"g.k{i}").alias(k) for i, k in enumerate(keys)]


def order_statistics(
    df: DataFrame, keys: Sequence[str], value: Column, ranks: dict[str, Rank]
) -> DataFrame:
    """Values at 0-based ranks per group, one column per rank; ``ranks`` maps a name to a
    function of the group's row count. NULL and NaN values are not ranked, and groups without others are absent."""
    if not ranks:
        raise ValueError("order_statistics needs at least one rank")
    found = _ranked(df, keys, {"v": (value, ranks)})
    n = F.col("counts")["v"]
    return found.filter(n > 0).select(
        *_keys_of(keys), n.alias("n_values"), *[F.col("stats")[name].alias(name) for name in ranks]
    )


def grouped_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    values: dict[str, tuple[Column, dict[str, float]]],
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Exact quantiles (linear interpolation between the two nearest ranks) plus ordinary aggregates per group.

    ``values`` maps a label to (expression, {output column: probability}); ``extra`` are aliased
    aggregates. Groups are compared NULL-safe and kept. Without keys there is exactly one row.
    """
    keys = list(keys)
    wanted: dict[str, tuple[Column, dict[str, Rank]]] = {}
    picked: list[Column] = []
    for label, (expression, probs) in values.items():
        ranks: dict[str, Rank] = {}
        for name, p in probs.items():
            ranks[f"{name}__lo"] = lambda n, p=p: F.floor((n - 1) * F.lit(float(p)))
            ranks[f"{name}__hi"] = lambda n, p=p: F.ceil((n - 1) * F.lit(float(p)))
            position = (F.col("counts")[label] - 1) * F.lit(float(p))
            lo, hi = F.col("stats")[f"{name}__lo"], F.col("stats")[f"{name}__hi"]
            part = position - F.floor(position)
            picked.append(F.when(lo == hi, lo).otherwise((1 - part) * lo + part * hi).alias(name))
        wanted[label] = (expression, ranks)
    found = _ranked(df, keys, wanted).select(*_keys_of(keys), *picked)
    if keys and not extra:
        return found
    whole = df.groupBy(*keys).agg(*(list(extra) or [F.count(F.lit(1)).alias("__ignored")]))
    if keys:
        return null_safe_join(whole, found, keys, "left")
    return whole.join(found, F.lit(True), "left").drop("__ignored")  # one row each


def nearest_rank_breaks(df: DataFrame, keys: Sequence[str], value: Column, steps: int) -> DataFrame:
    """``steps - 1`` ascending break values per group by nearest rank (no interpolation)."""
    ranks: dict[str, Rank] = {
        f"b{i}": (lambda n, i=i: F.floor((n - 1) * F.lit(i / steps) + F.lit(0.5)))
        for i in range(1, steps)
    }
    stats = order_statistics(df, keys, value, ranks)
    return stats.select(
        *keys, F.array(*[F.col(f"b{i}") for i in range(1, steps)]).alias("breaks"), "n_values"
    )
