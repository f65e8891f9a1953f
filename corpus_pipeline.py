"""Training-corpus pipeline over ``documents``: each stage is one operator of ``plotyard.llm``.

Every stage works on all rows its predecessor kept; all but the last return the columns of ``documents``. Stages are
written to the shared folder and read again, so a lost executor costs at most the stage that runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plotyard.llm.decontaminate import drop_contaminated
from plotyard.llm.line_dedup import without_duplicate_lines
from plotyard.llm.packing import pack_documents
from plotyard.llm.quality_classifier import keep_quality
from plotyard.llm.shingle_join import one_per_class
from plotyard.session import discard, hand_over, release_shuffles


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat earlier ones, exactly or within two edits."""
    return without_duplicate_lines(docs, plain_reader=True)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return one_per_class(docs, plain_reader=True)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences with their token ids."""
    return pack_documents(docs, keep_ids=True)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", packing),
]
ORACLE_SQL = None  # the first stage is a fitted model


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, given = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = hand_over(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release_shuffles(spark)
        discard(*given)
        given = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
