"""Listing preparation: typing, category split, fills, renames, encodings and dataset splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotyard import fixed_values as fv
from plotyard.functions import labels, pricing, text
from plotyard.session import spread_heavy


def category_dimension(spark: SparkSession) -> DataFrame:
    """The fixed category list as constants of the plan, so that its size is known before anything runs."""
    rows = [F.struct(F.lit(c).cast("int").alias("category"), F.lit(t).cast("string").alias("estate_type"), F.lit(b).cast("string").alias("estate_benefit")) for c, t, b in fv.CATEGORY_ROWS]
    return spark.range(1).select(F.inline(F.array(*rows)))


def split_category(df: DataFrame, dimension: DataFrame) -> DataFrame:
    """Category code to (estate_type, estate_benefit); unknown codes keep NULL. The dimension has
    one row per code, a fixed list, so it is broadcast."""
    return df.drop("estate_type", "estate_benefit").join(
        F.broadcast(dimension), "category", "left"
    )


def flatten_names(df: DataFrame) -> DataFrame:
    """Dotted coordinate names from flattened JSON to plain ones."""
    renames = {"location.lat": "lat", "location.lng": "lng"}
    return df.withColumnsRenamed({k: v for k, v in renames.items() if k in df.columns})


def slim_map(df: DataFrame) -> DataFrame:
    """Narrow projection for the map mart."""
    return df.select(
        "id",
        F.col("lat").cast("float").alias("lat"),
        F.col("lng").cast("float").alias("lng"),
        "price",
        "area",
        F.col("beds").cast("smallint").alias("beds"),
        "estate_type",
        "estate_benefit",
        "city",
        "district",
        "last_update",
    )


def drop_columns(df: DataFrame, columns: Sequence[str] = fv.SCRAPE_ONLY_COLUMNS) -> DataFrame:
    """Drop by exact name; dotted names are column names here, not struct paths."""
    gone = set(columns)
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in gone])


def rename_for_model(df: DataFrame, names: Mapping[str, str] = fv.MODEL_NAMES) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def flags_to_bytes(df: DataFrame, suffix: str | None = None) -> DataFrame:
    """Boolean columns (all, or those with the suffix) to 0/1 bytes."""
    chosen = [
        f.name
        for f in df.schema.fields
        if (f.name.endswith(suffix) if suffix else isinstance(f.dataType, T.BooleanType))
    ]
    return df.withColumns({c: F.col(c).cast("byte") for c in chosen})


def null_unless_positive(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: labels.positive_or_null(F.col(c)) for c in columns})


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep rows in which every given column has a value (NaN counts as none)."""
    return df.dropna(how="any", subset=list(columns))


def fill_constant(df: DataFrame, values: Mapping[str, int | float | str]) -> DataFrame:
    return df.fillna(dict(values))


def seller_over_text(df: DataFrame) -> DataFrame:
    """The seller's own answer wins; the text flag only fills the gaps."""
    return df.withColumns(
        {
            "f_ac": F.coalesce(F.col("ac").cast("double"), F.col("f_ac").cast("double")).cast("byte"),
            "f_kitchen": F.coalesce(
                F.col("ketchen").cast("double"), F.col("f_kitchen").cast("double")
            ).cast("byte"),
        }
    ).drop("ac", "ketchen")


def either_flag(first: str, second: str) -> Column:
    """1 when either flag is 1; a missing flag is not 1."""
    one = F.coalesce(F.col(first) == 1, F.lit(False))
    other = F.coalesce(F.col(second) == 1, F.lit(False))
    return (one | other).cast("byte")


def merge_furnished(df: DataFrame) -> DataFrame:
    return df.withColumn("furnished", either_flag("furnished", "f_furnished")).drop("f_furnished")


def with_unit_price(df: DataFrame) -> DataFrame:
    unit = pricing.half_even(pricing.price_per_m2(F.col("price"), F.col("area")), 2)
    return df.withColumn("price_per_m2", unit)


def with_text_flags(df: DataFrame, pack: Mapping[str, str] | None = None) -> DataFrame:
    """Keyword, park, garden and yard flags from title and content, in one projection."""
    source = spread_heavy(df, *df.columns[:1]).withColumn(
        "__text", text.strip_negations(text.normalize_flags(text.title_and_content()))
    )
    flags = text.keyword_flags(F.col("__text"), dict(pack or fv.FLAG_PATTERNS))
    return source.select(*df.columns, *flags, *text.park_flags(F.col("__text")))


def one_hot(
    df: DataFrame, column: str = "estate_type", vocabulary: Sequence[str] = fv.MODELLED_TYPES,
    prefix: str = "type",
) -> DataFrame:
    """0/1 byte per value of a fixed vocabulary; the source column is replaced."""
    columns = [
        F.when(F.col(column) == v, 1).otherwise(0).cast("byte").alias(f"{prefix}_{v}")
        for v in vocabulary
    ]
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, *columns)


def one_hot_check(df: DataFrame, prefix: str = "type_") -> DataFrame:
    """Distribution of the row sum over the one-hot columns; 1 everywhere when sound."""
    hot = [F.col(c) for c in df.columns if c.startswith(prefix)]
    total = reduce(lambda a, b: a + b, [c.cast("int") for c in hot])
    return df.groupBy(total.alias("raised")).agg(F.count(F.lit(1)).alias("listings"))


def split_purpose(df: DataFrame, drops: Sequence[str] = fv.SPLIT_DROPS) -> tuple[DataFrame, DataFrame]:
    """(sale, rental) model tables without ids and positions."""
    sale = df.filter(F.col("estate_benefit") == "sell").drop(*drops)
    rental = df.filter(F.col("estate_benefit") == "rental").drop(*drops)
    return sale, rental


def restore_columns(df: DataFrame, reference: Sequence[str]) -> DataFrame:
    """Exactly the reference columns, in their order."""
    return df.select(*[F.col(f"`{c}`") for c in reference])


def drop_constant_columns(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Remove numeric columns with no spread; one row of statistics reaches the driver."""
    spread = df.agg(*[F.stddev_samp(F.col(c).cast("double")).alias(c) for c in columns]).first()
    constant = [c for c in columns if not (spread[c] is not None and spread[c] > 0)]
    return df.drop(*constant), constant


def integer_codes(df: DataFrame, column: str, vocabulary: Sequence[str]) -> Column:
    """0-based position in the alphabetical vocabulary, -1 for a value outside it or NULL."""
    ordered = F.array(*[F.lit(v) for v in sorted(vocabulary)])
    position = F.array_position(ordered, F.col(column)).cast("int") - 1
    return F.coalesce(position, F.lit(-1)).cast("int")
