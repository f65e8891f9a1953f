"""The extraction cycle as one plan: queue, run, evaluation, gates, trusted fields, merge. The run resumes by id from its checkpoint, the report
and the merged listings are published tables, and the merge is refused where it would lose a row or a value."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotyard.functions import text
from plotyard.operators.extraction import evaluate, merge, queue
from plotyard.operators.extraction.fields import CHECKPOINT_SCHEMA
from plotyard.operators.extraction.run import Extractor, run_extraction
from plotyard.sources import io

EVALUATED = ("livings", "wc", "furnished", "age", "street_width")


def measure(listings: DataFrame, extractor: Extractor, model_name: str, sample_size: int, fields: Sequence[str] = EVALUATED) -> DataFrame:
    """Metrics and gates per field, from rows whose value is known and hidden from the extractor."""
    rows = listings.withColumn("clean", text.normalize_content(F.col("content")))
    detail = [evaluate.evaluate_field(rows, field, extractor, sample_size, model_name) for field in fields]
    return evaluate.field_metrics(reduce(DataFrame.unionByName, detail))


def extraction_cycle(
    listings: DataFrame, extractor: Extractor, folder: str, model_name: str, sample_size: int = 200, fields: Sequence[str] = EVALUATED
) -> tuple[DataFrame, DataFrame]:
    """(merged listings, gate report): missing values are extracted from the ad texts, each field's accuracy is measured, and only fields that
    clear their gate are filled; the others are marked for review. ``folder`` gets ``checkpoint``, ``gates`` and ``merged``."""
    spark = listings.sparkSession
    run_extraction(queue.build_queue(listings), extractor, f"{folder}/checkpoint", model_name)
    io.write_table(measure(listings, extractor, model_name, sample_size, fields), f"{folder}/gates")
    gates = io.read_table(spark, f"{folder}/gates")
    extracted = io.read_checkpoint(spark, f"{folder}/checkpoint", CHECKPOINT_SCHEMA)
    merge.merge_to_table(listings, extracted, evaluate.trusted_fields(gates), f"{folder}/merged")
    return io.read_table(spark, f"{folder}/merged"), evaluate.gate_report(gates)
