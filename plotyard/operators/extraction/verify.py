"""Mechanical check of proposed values: an accepted value quotes text that exists.

Everything is a JVM-side expression except the fuzzy comparison, and that sees only the spans
that were not found verbatim: for all other rows its inputs are NULL.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotyard import fixed_values as fv
from plotyard.functions.text import collapse_whitespace
from plotyard.operators.extraction.fields import (
    CHECKPOINT_SCHEMA,
    FIELDS,
    in_range,
    value_type,
)
from plotyard.session import spread


def verify(candidates: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Candidates (id, clean, field, value, is_boolean, evidence) to outcomes.

    Order of the checks: no value, no evidence, out of range, not grounded, accepted. Rejected
    rows keep their evidence and lose the value; a missing value drops its evidence. A ``failed``
    column, where present, marks attempts that never produced an answer.
    """
    failed = (
        F.coalesce(F.col("failed"), F.lit(False)) if "failed" in candidates.columns else F.lit(False)
    )
    spans = F.transform("evidence", collapse_whitespace)
    checked = spread(candidates, "id").withColumns(
        {"__hay": collapse_whitespace(F.col("clean")), "__spans": spans}
    ).withColumns(
        {
            "__missing": F.filter("__spans", lambda s: ~F.contains(F.col("__hay"), s)),
            "__trivial": F.exists("__spans", lambda s: F.length(s) < fv.MIN_EVIDENCE_CHARS),
            "__fits": in_range(F.col("field"), F.col("value"), F.col("is_boolean")),
        }
    )
    live = F.col("value").isNotNull() & F.col("evidence").isNotNull() & F.col("__fits")
    open_spans = live & ~F.col("__trivial") & (F.size("__spans") > 0)
    residual = open_spans & (F.size("__missing") > 0)
    found = open_spans & (F.size("__missing") == 0)
    if fuzzy:
        close = all_close(
            F.when(residual, F.col("__hay")), F.when(residual, F.col("__missing"))
        )
    else:
        close = F.lit(False)
    judged = checked.withColumn("__close", F.coalesce(close, F.lit(False)))
    status = (
        F.when(failed, "retry_exhausted")
        .when(F.col("value").isNull(), "null_not_mentioned")
        .when(F.col("evidence").isNull(), "rejected_schema_invalid")
        .when(~F.col("__fits"), "rejected_out_of_range")
        .when(found, "accepted")
        .when(residual & F.col("__close"), "accepted_fuzzy")
        .otherwise("rejected_ungrounded")
    )
    kept = judged.withColumn("status", status)
    accepted = F.col("status").isin(*fv.ACCEPTED_STATUSES)
    answered = ~F.col("status").isin("null_not_mentioned", "rejected_schema_invalid", "retry_exhausted")
    return kept.withColumns(
        {
            "value": F.when(accepted, F.col("value")),
            "evidence": F.when(answered, F.array_join("evidence", fv.EVIDENCE_SEPARATOR)),
        }
    ).drop("__hay", "__spans", "__missing", "__trivial", "__fits", "__close")


def all_close(hay: Column, spans: Column) -> Column:
    """True where every span has a near-verbatim place in the text; NULL input gives False."""

    @F.pandas_udf("boolean")
    def close(hays: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series(
            [
                h is not None
                and s is not None
                and all(close_match(x, h, fv.FUZZY_THRESHOLD) for x in s)
                for h, s in zip(hays, lists)
            ],
            dtype=bool,
        )

    return close(hay, spans)


def close_match(needle: str, hay: str, threshold: float) -> bool:
    """Whether some window of the longer text has a normalised insert/delete similarity of at
    least ``threshold`` percent with the shorter one. Windows are as long as the shorter text,
    and shorter at both ends. Only windows sharing enough characters are compared."""
    if len(needle) > len(hay):
        needle, hay = hay, needle
    m, n = len(needle), len(hay)
    if m == 0:
        return False
    starts = np.arange(-(m - 1), n)
    lo, hi = np.maximum(starts, 0), np.minimum(starts + m, n)
    codes = np.frombuffer(hay.encode("utf-32-le"), dtype=np.uint32)
    shared = np.zeros(len(starts), dtype=np.int64)
    symbols, counts = np.unique(
        np.frombuffer(needle.encode("utf-32-le"), dtype=np.uint32), return_counts=True
    )
    for symbol, count in zip(symbols, counts):
        upto = np.concatenate([[0], np.cumsum(codes == symbol)])
        shared += np.minimum(upto[hi] - upto[lo], count)
    # the common subsequence is no longer than the shared characters
    possible = 200.0 * shared >= threshold * (m + hi - lo)
    masks: dict[str, int] = {}
    for i, ch in enumerate(needle):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << m) - 1
    for a, b in zip(lo[possible], hi[possible]):
        free = full
        for ch in hay[a:b]:
            taken = free & masks.get(ch, 0)
            free = ((free + taken) | (free - taken)) & full
        common = m - free.bit_count()
        if 200.0 * common >= threshold * (m + int(b - a)):
            return True
    return False


def to_wide(outcomes: DataFrame) -> DataFrame:
    """Outcomes (with provenance columns) to the checkpoint layout: a value/evidence/status triple
    per field, NULL where the field was not requested."""
    provenance = ["model_name", "prompt_version", "extracted_at"]
    triples = []
    for f in FIELDS:
        here = F.col("field") == f
        for part in ("value", "evidence", "status"):
            picked = F.max(F.when(here, F.col(part)))
            if part == "value":
                picked = picked.cast("long").cast("boolean") if value_type(f).typeName() == "boolean" else picked.cast(value_type(f))
            triples.append(picked.alias(f"{f}_{part}"))
    wide = outcomes.groupBy("id", *provenance).agg(
        F.max("attempt_count").alias("attempt_count"),
        F.max("latency_ms").alias("latency_ms"),
        *triples,
    )
    return wide.select(*[f.name for f in CHECKPOINT_SCHEMA.fields])
