"""Nulls that mean "does not apply": zero-filled and flagged; genuinely missing values stay NULL."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotyard import fixed_values as fv


def exempt_types(exemptions: Mapping[str, Sequence[str]], field: str) -> list[str]:
    return [kind for kind, fields in exemptions.items() if field in fields]


def _exempt(types: Sequence[str]) -> Column:
    return F.coalesce(F.col("estate_type").isin(*types), F.lit(False)) if types else F.lit(False)


def _zeroed(field: str, exempt: Column, dtype: str) -> Column:
    return F.when(exempt & F.col(field).isNull(), F.lit(0).cast(dtype)).otherwise(F.col(field))


def zero_fill(
    df: DataFrame,
    exemptions: Mapping[str, Sequence[str]] = fv.ZERO_FILL_EXEMPTIONS,
    fields: Sequence[str] = fv.ZERO_FILL_FIELDS,
) -> DataFrame:
    """Flag the field by type alone, and zero it only where it is NULL and does not apply."""
    types = dict(df.dtypes)
    columns = {}
    for field in fields:
        exempt = _exempt(exempt_types(exemptions, field))
        columns[f"{field}_na"] = exempt
        columns[field] = _zeroed(field, exempt, types[field])
    return df.withColumns(columns)


def extend_exemptions(
    df: DataFrame, rules: Iterable[tuple[str, Sequence[str], str]] = fv.SECOND_EXEMPTIONS
) -> DataFrame:
    """Further exemptions; the flag is ORed into the present one or set outright."""
    types = dict(df.dtypes)
    columns = {}
    for field, kinds, mode in rules:
        exempt = _exempt(list(kinds))
        flag = f"{field}_na"
        columns[flag] = (F.col(flag) | exempt) if mode == "or" else exempt
        columns[field] = _zeroed(field, exempt, types[field])
    return df.withColumns(columns)


def add_rooms(df: DataFrame) -> DataFrame:
    """rooms = beds + livings, unknown when either part is; not applicable only when both are."""
    return df.withColumns(
        {
            "rooms": F.col("beds") + F.col("livings"),
            "rooms_na": F.col("beds_na") & F.col("livings_na"),
        }
    )


def fill_rooms_from_extractions(df: DataFrame, extractions: DataFrame) -> DataFrame:
    """Accepted extracted totals fill the rooms that could not be derived."""
    accepted = (
        extractions.filter(
            F.col("rooms_status").isin(*fv.ACCEPTED_STATUSES) & F.col("rooms_value").isNotNull()
        )
        .select("id", F.col("rooms_value").alias("__rooms"))
    )
    dtype = dict(df.dtypes)["rooms"]
    return (
        df.join(accepted, "id", "left")
        .withColumn("rooms", F.coalesce("rooms", F.col("__rooms").cast(dtype)))
        .drop("__rooms")
    )


def drop_incomplete(df: DataFrame, required: Sequence[str] = ("livings", "wc")) -> DataFrame:
    return df.dropna(how="any", subset=list(required))


def late_exemptions(
    df: DataFrame, rules: Iterable[tuple[str, Sequence[str], str]] = fv.LATE_EXEMPTIONS
) -> DataFrame:
    """Exemptions closed last; totals that become computable are filled, known ones are kept."""
    fixed = extend_exemptions(df, rules)
    return fixed.withColumn("rooms", F.coalesce("rooms", F.col("beds") + F.col("livings")))


def model_ready(df: DataFrame, extractions: DataFrame) -> DataFrame:
    """The whole structural path, in order."""
    ready = add_rooms(zero_fill(df))
    recovered = fill_rooms_from_extractions(add_rooms(extend_exemptions(ready)), extractions)
    return late_exemptions(drop_incomplete(recovered))
