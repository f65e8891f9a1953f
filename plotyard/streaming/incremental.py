"""Incremental extraction over a folder of newly arriving queue files.

The file source remembers what it has read. Each batch subtracts the ids that committed batches hold, writes its results under the name of the
stream and its own number, and commits them with a row; a batch that is replayed after a failure overwrites its own
folder. So every id is extracted and kept once, wherever a run stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from plotyard.operators.extraction.fields import CHECKPOINT_SCHEMA
from plotyard.operators.extraction.run import Extractor, outcomes, pending_work
from plotyard.operators.extraction.verify import to_wide
from plotyard.sources import io


def read_extracted(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Results of all committed batches."""
    return io.read_batches(spark, checkpoint, CHECKPOINT_SCHEMA)


def extract_batch(batch: DataFrame, name: str, extractor: Extractor, checkpoint: str, model_name: str) -> None:
    """Extract and keep what no other committed batch holds; an id that arrives in several files of a batch is extracted once."""
    done = io.read_batches(batch.sparkSession, checkpoint, CHECKPOINT_SCHEMA, without=name)
    work = pending_work(batch.dropDuplicates(["id"]), done)
    io.append_batch(to_wide(outcomes(work, extractor, model_name)), checkpoint, name, CHECKPOINT_SCHEMA)


def start_incremental(
    spark: SparkSession, queue_folder: str, queue_schema: T.StructType, extractor: Extractor,
    checkpoint: str, progress: str, model_name: str,
    files_per_batch: int = 100,
) -> StreamingQuery:
    """Process every file present, then stop. ``checkpoint`` holds the results, ``progress`` the
    stream's own position."""
    arriving = (
        spark.readStream.schema(queue_schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(queue_folder)
    )

    def extract(batch: DataFrame, number: int) -> None:
        # the stream's id is kept with its progress: another stream's batches have other names
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        extract_batch(batch, f"{stream}-{number}", extractor, checkpoint, model_name)

    return (
        arriving.writeStream.foreachBatch(extract)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
