"""Extraction runs: only pending rows, a caller-supplied extractor per batch, append-only output."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotyard.operators.extraction.fields import CANDIDATE_SCHEMA, CHECKPOINT_SCHEMA
from plotyard.operators.extraction.queue import prompt_version, tasks
from plotyard.operators.extraction.verify import to_wide, verify
from plotyard.operators.joins import pending
from plotyard.sources.io import append_checkpoint, read_checkpoint

# Takes a batch with id, clean, needed; returns rows with the candidate columns.
Extractor = Callable[[pd.DataFrame], pd.DataFrame]


def propose(work: DataFrame, extractor: Extractor) -> DataFrame:
    """Run the extractor over batches of each partition; the text travels along for the check."""
    names = [f.name for f in CANDIDATE_SCHEMA.fields]

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            proposed = extractor(frame).reindex(columns=names)
            texts = frame[["id", "clean"]]
            yield proposed.merge(texts, on="id", how="inner")[[*names, "clean"]]

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in CANDIDATE_SCHEMA.fields)
    return work.mapInPandas(batches, f"{fields}, clean string")


def outcomes(
    work: DataFrame, extractor: Extractor, model_name: str, version: str | None = None
) -> DataFrame:
    """Verified outcomes with provenance, one row per (id, field)."""
    return verify(propose(work, extractor)).withColumns(
        {
            "model_name": F.lit(model_name),
            "prompt_version": F.lit(version or prompt_version()),
            "extracted_at": F.current_timestamp(),
        }
    )


def pending_work(queue: DataFrame, done: DataFrame, limit: int | None = None, partitions: int | None = None) -> DataFrame:
    """Queued rows with something to extract that ``done`` does not hold."""
    work = pending(tasks(queue), done)
    if limit is not None:
        work = work.orderBy("id").limit(limit)
    return work.repartition(partitions) if partitions is not None else work


def run_extraction(
    queue: DataFrame,
    extractor: Extractor,
    checkpoint: str,
    model_name: str,
    limit: int | None = None,
    partitions: int | None = None,
) -> None:
    """Extract every queued row that the checkpoint does not hold yet and append the result.

    An interrupted run loses only its unfinished write; the next one resumes by id.
    """
    spark = queue.sparkSession
    done = read_checkpoint(spark, checkpoint, CHECKPOINT_SCHEMA)
    work = pending_work(queue, done, limit, partitions)
    append_checkpoint(to_wide(outcomes(work, extractor, model_name)), checkpoint, CHECKPOINT_SCHEMA)
