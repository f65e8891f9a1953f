"""Column helpers: values named once inside an expression, spans of pattern matches, and ids of rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotyard.session import hand_over


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where the body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def match_spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, match>> in code points, end exclusive."""
    found = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match")
    )
    none = F.expr("cast(array() as array<struct<start:int,end:int,match:string>>)")

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        span = F.struct(start.alias("start"), (start + F.length(x["match"])).alias("end"), x["match"].alias("match"))
        step = F.struct(span["end"].alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))
        return F.when(x["match"].isNull(), acc).otherwise(step)

    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    return F.when(text.rlike(pattern), F.aggregate(found, start, add)["spans"]).otherwise(none)


def unused_names(df: DataFrame, count: int) -> list[str]:
    """Column names that ``df`` doesn't have."""
    names, taken, k = [], {c.lower() for c in df.columns}, 0
    while len(names) < count:
        if (name := f"plotyard_{k}") not in taken:
            names.append(name)
        k += 1
    return names


def with_row_ids(df: DataFrame, name: str, plain_reader: bool = False) -> DataFrame:
    """``df`` with a column that tells its rows apart and is the same whenever it is read: the file and the place in it where ``df`` is known to
    be a plain reader of Parquet files, else a number in a written copy."""
    if plain_reader:
        try:
            return df.withColumn(name, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))
        except AnalysisException:  # readers of other kinds have no such place
            pass
    return hand_over(df.withColumn(name, F.monotonically_increasing_id()), "numbered-rows")
