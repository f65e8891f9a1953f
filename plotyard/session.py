"""Session helpers: a tuned session for local runs and lineage cutting for cluster runs."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

# Rows above which a lookup table is no longer offered to executors as a broadcast.
BROADCAST_MAX_ROWS = 200_000


def local_session(app: str = "plotyard", cpus: int | None = None, **conf: str) -> SparkSession:
    """Session for tests and the local bench; a cluster job brings its own session."""
    cores = cpus or os.cpu_count() or 1
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session for intermediate data: the checkpoint folder already set,
    else ``spark.checkpoint.dir``, else a fresh local folder, which only a local master may use."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir"
    )
    if not shared:
        if not context.master.startswith("local["):
            raise ValueError(
                "set spark.checkpoint.dir to a folder that the driver and all executors share"
            )
        shared = tempfile.mkdtemp(prefix="plotyard-checkpoint-")
    context.setCheckpointDir(shared)
    return context.getCheckpointDir() or shared


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder so later steps neither recompute nor
    depend on the executors that produced it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path next to the checkpoints, for tables that live as long as one job."""
    return f"{checkpoint_dir(spark)}/plotyard-{uuid.uuid4().hex}/{name}"


def hand_over(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and return a reader of it."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written.handed_over = path
    return written


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``hand_over`` wrote, once what reads them last is written too."""
    for table in tables:
        remove_path(table.sparkSession, table.handed_over)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps now, not whenever the driver's JVM
    happens to collect; a long chain of written tables then needs the disk of its largest step only."""
    gc.collect()
    for pause in (0.5, 0.0):  # what the first collection frees on the driver's queues holds the rest
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove intermediate data under the shared folder; other paths are refused."""
    root = checkpoint_dir(spark)
    if not path.startswith(f"{root}/plotyard-"):
        raise ValueError(f"not an intermediate path: {path}")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


SPREAD_BYTES_PER_TASK = 32 << 20
HEAVY_BYTES_PER_TASK = 4 << 20  # of the input files, for work of several CPU seconds a megabyte


def input_bytes(df: DataFrame) -> int:
    """Size of the files and tables behind ``df`` by the optimizer's statistics; runs nothing. Rows whose size Spark does not know (it then
    gives the largest long) count as a split of SPREAD_BYTES_PER_TASK for each of their partitions."""
    session = df.sparkSession
    unknown = int(session._jsparkSession.sessionState().conf().defaultSizeInBytes())
    leaves, total = df._jdf.queryExecution().optimizedPlan().collectLeaves(), 0
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        size = int(str(leaf.stats().sizeInBytes()))
        if size >= unknown:
            of_rdd = leaf.getClass().getSimpleName() in ("LogicalRDD", "ExternalRDD")
            splits = leaf.rdd().getNumPartitions() if of_rdd else session.sparkContext.defaultParallelism
            size = splits * SPREAD_BYTES_PER_TASK
        total += size
    return total


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition rows by ``keys`` before CPU-heavy work, but only where the input is too small
    to give every core a split of its own; a large input is already spread by its splits."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if input_bytes(df) >= cores * SPREAD_BYTES_PER_TASK:
        return df
    return df.repartition(cores, *keys)


def spread_heavy(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition rows by ``keys`` before work that takes several seconds a megabyte, into tasks of about
    HEAVY_BYTES_PER_TASK each: a split or row group of 128 MB would keep one task busy for many minutes."""
    tasks = -(-input_bytes(df) // HEAVY_BYTES_PER_TASK)
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, tasks), *keys)
