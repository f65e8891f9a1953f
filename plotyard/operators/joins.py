"""Join shapes shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join in which NULL keys match each other; the left key columns are kept."""
    renamed = right.withColumnsRenamed({k: f"__j_{k}" for k in keys})
    on = [left[k].eqNullSafe(renamed[f"__j_{k}"]) for k in keys]
    return left.join(renamed, on, how).drop(*[f"__j_{k}" for k in keys])


def pending(queue: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Rows of the queue whose key is not among the finished ones."""
    return queue.join(done.select(key).distinct(), key, "left_anti")


def sampled_rows(df: DataFrame, sample: DataFrame, key: str = "id") -> DataFrame:
    return df.join(sample.select(key), key, "left_semi")
