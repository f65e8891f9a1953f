"""Top-n, seeded uniform samples, splits and stratified samples without a single-task sort.

Sampling orders rows by a hash of their id, so it is reproducible and independent of the
partitioning. Large samples first find the hash value below which just over n rows lie, from
counts of the leading hex digits, and only rows below it are ever sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotyard.operators.joins import null_safe_join


def hash_key(*columns: str, seed: int = 42) -> Column:
    """Sort key of a seeded sample: 32 hex digits, equal in any engine that has md5."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("∅")) for c in columns]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def newest_first(df: DataFrame, limit: int, time: str = "last_update", tie: str = "id") -> DataFrame:
    return df.orderBy(F.col(time).desc(), F.col(tie)).limit(limit)


def n_extreme(df: DataFrame, column: str, n: int, largest: bool, tie: str = "id") -> DataFrame:
    order = F.col(column).desc_nulls_last() if largest else F.col(column).asc_nulls_last()
    return df.orderBy(order, F.col(tie)).limit(n)


def uniform_sample(df: DataFrame, n: int, key: Column, digits: int = 4) -> DataFrame:
    """Exactly min(n, rows) rows, uniformly, after whatever filter ``df`` carries.

    The count per leading ``digits`` hex digits (at most 16**digits rows, combined map-side)
    gives the cut below which at least n rows lie.
    """
    keyed = df.withColumn("__h", key).withColumn("__p", F.substring("__h", 1, digits))
    buckets = keyed.groupBy("__p").agg(F.count(F.lit(1)).alias("c"))
    before = (
        F.sum("c").over(
            Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        - F.col("c")
    )
    cut = buckets.withColumn("before", before).filter(F.col("before") < n).agg(F.max("__p"))
    return (
        keyed.filter(F.col("__p") <= cut.scalar())
        .orderBy("__h", *[c for c in ("id",) if c in df.columns])
        .limit(n)
        .drop("__h", "__p")
    )


def hash_fold(df: DataFrame, folds: int, id_column: str = "id", seed: int = 42) -> Column:
    """Fold number that depends on the id alone."""
    return F.pmod(F.xxhash64(F.col(id_column), F.lit(seed)), F.lit(folds)).cast("int")


def split_bucket(id_column: str = "id", seed: int = 42) -> Column:
    """0..99 from the id alone, the same in any engine that has md5."""
    head = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_column).cast("string"))), 1, 7)
    return (F.conv(head, 16, 10).cast("long") % 100).cast("int")


def train_test_split(
    df: DataFrame, train_pct: int = 70, id_column: str = "id", seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    bucket = split_bucket(id_column, seed)
    return df.filter(bucket < train_pct), df.filter(bucket >= train_pct)


def stratum_quotas(df: DataFrame, stratum: str, size: int) -> DataFrame:
    """Rows to take per stratum: its proportional share rounded half-even, at least one, at most
    all of it. One row per stratum."""
    counts = df.groupBy(F.col(stratum)).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    share = F.bround(F.lit(size) * F.col("n") / total.scalar(), 0).cast("long")
    return counts.select(
        stratum,
        "n",
        total.scalar().alias("total"),
        F.least(F.col("n"), F.greatest(F.lit(1).cast("long"), share)).alias("quota"),
    )


def stratified_sample(
    df: DataFrame, stratum: str, size: int, key: Column, digits: int = 4
) -> DataFrame:
    """Proportional sample per stratum, then capped to ``size``; everything when ``df`` is small.

    Per stratum only rows up to the hash bucket that completes the quota are ranked, so a stratum
    holding most rows is not sorted in one task.
    """
    keyed = df.withColumn("__h", key).withColumn("__p", F.substring("__h", 1, digits))
    quotas = stratum_quotas(df, stratum, size).withColumn(
        "quota", F.when(F.col("total") <= size, F.col("n")).otherwise(F.col("quota"))
    )
    buckets = keyed.groupBy(stratum, "__p").agg(F.count(F.lit(1)).alias("c"))
    before = (
        F.sum("c").over(
            Window.partitionBy(stratum)
            .orderBy("__p")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        - F.col("c")
    )
    cuts = (
        null_safe_join(buckets.withColumn("before", before), quotas.drop("n", "total"), [stratum])
        .filter(F.col("before") < F.col("quota"))
        .groupBy(stratum)
        .agg(F.max("__p").alias("__cut"), F.first("quota").alias("__quota"))
    )
    near = null_safe_join(keyed, cuts, [stratum]).filter(F.col("__p") <= F.col("__cut"))
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy("__h"))
    taken = near.withColumn("__rank", rank).filter(F.col("__rank") <= F.col("__quota"))
    # rounding up small strata can overshoot: the cap keeps the smallest hashes
    return taken.orderBy("__h").limit(size).drop("__h", "__p", "__cut", "__quota", "__rank")
