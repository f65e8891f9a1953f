"""Merging verified values back: gaps only, trusted fields and types only, everything audited."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from plotyard import fixed_values as fv
from plotyard.operators.extraction.fields import FIELDS, exempt, value_type
from plotyard.sources.io import guarded_write


def latest(extractions: DataFrame, key: str = "id", time: str = "extracted_at") -> DataFrame:
    """Newest row per key, ties broken by the remaining columns in order. Spark keeps the first row of each key before
    the shuffle (a rank limit), so a key with many attempts sends one row per task."""
    kinds = {f.name: f.dataType for f in extractions.schema.fields}
    by = [F.col(c) if _orderable(kinds[c]) else F.to_json(c) for c in (time, *(c for c in kinds if c not in (key, time)))]
    newest = Window.partitionBy(key).orderBy(*[c.desc() for c in by])
    return extractions.withColumn("__rank", F.row_number().over(newest)).filter("__rank = 1").drop("__rank")


def _orderable(kind: DataType) -> bool:
    return "map<" not in kind.simpleString()


def apply_extractions(
    source: DataFrame, extractions: DataFrame, trusted: Iterable[str]
) -> DataFrame:
    """Fill gaps and add ``<field>_extraction_status`` per field.

    ``extractions`` has one row per id. rooms and driver_room are created here, so they have no
    prior value. A grounded value that may not be filled is marked for review, not dropped.
    """
    trusted = set(trusted)
    new = [f for f in fv.EXTRACTION_NEW_COLUMNS]
    base = source.drop(*new).withColumns({f: F.lit(None).cast(value_type(f)) for f in new})
    offered = extractions.select(
        "id",
        *[F.col(f"{f}_value").alias(f"__v_{f}") for f in FIELDS],
        *[F.col(f"{f}_status").alias(f"__s_{f}") for f in FIELDS],
    )
    joined = base.join(offered, "id", "left")
    types = dict(joined.dtypes)
    columns = {}
    for field in FIELDS:
        status, value, original = F.col(f"__s_{field}"), F.col(f"__v_{field}"), F.col(field)
        usable = F.coalesce(
            original.isNull() & status.isin(*fv.ACCEPTED_STATUSES) & value.isNotNull(), F.lit(False)
        )
        kinds = fv.TRUSTED_ESTATE_TYPES[field]
        if kinds is None:
            type_ok = F.lit(True)
        elif kinds:
            type_ok = F.coalesce(F.col("estate_type").isin(*kinds), F.lit(False))
        else:
            type_ok = F.lit(False)
        fill = usable & type_ok if field in trusted else F.lit(False)
        columns[f"{field}_extraction_status"] = (
            F.when(usable & ~fill, "needs_human_review")
            .when(fill, "llm_filled")
            .when(original.isNull() & status.isNotNull(), F.concat(F.lit("llm_"), status))
            .when(original.isNull() & exempt(field), "not_attempted_structural_exempt")
            .when(original.isNotNull(), "original")
            .otherwise("not_attempted")
        )
        columns[field] = F.when(fill, value.cast(types[field])).otherwise(original)
    kept = [*source.columns, *[f for f in new if f not in source.columns]]
    audit = [f"{f}_extraction_status" for f in FIELDS]
    return joined.withColumns(columns).select(*kept, *audit)


def merge_to_table(
    source: DataFrame, extractions: DataFrame, trusted: Iterable[str], path: str
) -> None:
    """Write the filled table, refusing when a row or an existing value would be lost."""
    merged = apply_extractions(source, latest(extractions), trusted)
    kept = [f for f in FIELDS if f not in fv.EXTRACTION_NEW_COLUMNS]
    guarded_write(source, merged, path, kept)
