"""What can be extracted, and the table shapes of the run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotyard import fixed_values as fv

FIELDS = tuple(row[0] for row in fv.EXTRACTION_FIELDS)
KIND = {row[0]: row[1] for row in fv.EXTRACTION_FIELDS}
QUEUE_FLAG = {row[0]: row[4] for row in fv.EXTRACTION_FIELDS}
LIST_EVIDENCE = tuple(row[0] for row in fv.EXTRACTION_FIELDS if row[5])
_VALUE_TYPE = {"int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType()}

# One row per (listing, field) as an extractor returns it.
CANDIDATE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("field", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("is_boolean", T.BooleanType()),
        T.StructField("evidence", T.ArrayType(T.StringType())),
        T.StructField("failed", T.BooleanType()),
        T.StructField("attempt_count", T.LongType()),
        T.StructField("latency_ms", T.LongType()),
    ]
)

# One row per listing in the checkpoint: provenance, then a triple per field.
CHECKPOINT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("prompt_version", T.StringType()),
        T.StructField("extracted_at", T.TimestampType()),
        T.StructField("attempt_count", T.LongType()),
        T.StructField("latency_ms", T.LongType()),
        *[
            part
            for f in FIELDS
            for part in (
                T.StructField(f"{f}_value", _VALUE_TYPE[KIND[f]]),
                T.StructField(f"{f}_evidence", T.StringType()),
                T.StructField(f"{f}_status", T.StringType()),
            )
        ],
    ]
)


def value_type(field: str) -> T.DataType:
    return _VALUE_TYPE[KIND[field]]


def exempt(field: str) -> Column:
    """True where the field carries no meaning for the estate type."""
    kinds = [k for k, fields in fv.EXTRACTION_EXEMPTIONS.items() if field in fields]
    return F.coalesce(F.col("estate_type").isin(*kinds), F.lit(False)) if kinds else F.lit(False)


def in_range(field: Column, value: Column, is_boolean: Column) -> Column:
    """Type and bounds per field: booleans only for boolean fields, numbers only for the others."""
    rule = F.lit(False)
    for name, kind, low, high, _, _ in fv.EXTRACTION_FIELDS:
        fits = is_boolean if kind == "bool" else ~is_boolean & value.between(low, high)
        rule = F.when(field == name, fits).otherwise(rule)
    return F.coalesce(rule, F.lit(False))
