"""Token-id store: documents compressed one by one with a shared zstandard dictionary.

File format. A store is a folder with three Parquet tables, so that any file system Spark writes to holds it
and Spark's commit protocol covers lost executors:

* ``dictionary``: one row, the dictionary and its hash (the first 16 bytes of its SHA-256).
* ``blocks``: one row per block of consecutive documents in ascending ``doc_id`` order: ``shard`` (a file's
  number in that order), ``block``, ``first_doc``, ``last_doc``, the index arrays ``doc_ids`` and ``starts``
  (ids of the shard before each document), ``n_tokens`` and ``payload``.
* ``manifest``: per shard its number of ids and the ids before it.

A payload is a self-contained image: magic ``PTK1``, id width in bytes (u4), dictionary hash (16 bytes), number
of documents n (u4), n + 1 frame offsets (u8), n id counts (u8), then the zstandard frames; all numbers are
little-endian. A short document is read by its block's offset alone: the scan prunes blocks by ``first_doc`` and
``last_doc``, and one frame is decompressed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plotyard.llm.tokens import default_tokenizer, encoder
from plotyard.session import remove_path, scratch_path

MAGIC = b"PTK1"
END_ID = 1
SAMPLE_DOCUMENTS = 2_000  # documents whose ids train the dictionary, by the smallest hash of their id
SAMPLE_BYTES = 2_048  # serialized ids of each of them that are shown to the trainer, from anywhere in its text
DICTIONARY_BYTES = 65_536
BLOCK_BYTES = 1 << 20
LEVEL = 3

BLOCKS = (
    "shard int, block int, first_doc long, last_doc long, doc_ids array<long>, starts array<long>, "
    "n_tokens long, payload binary"
)


def dictionary_hash(dictionary: bytes) -> bytes:
    return hashlib.sha256(dictionary).digest()[:16]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def write_block(frames: list[bytes], counts: list[int], width: int, dict_hash: bytes) -> bytes:
    offsets = np.cumsum([0, *map(len, frames)]).astype("<u8")
    head = MAGIC + np.uint32(width).tobytes() + dict_hash + np.uint32(len(frames)).tobytes()
    return b"".join([head, offsets.tobytes(), np.array(counts, "<u8").tobytes(), *frames])


class BlockReader:
    """Random access to the documents of one payload."""

    def __init__(self, payload: bytes, dictionary: bytes):
        if payload[:4] != MAGIC or payload[8:24] != dictionary_hash(dictionary):
            raise ValueError("not a block of this dictionary")
        n = int(np.frombuffer(payload, "<u4", 1, 24)[0])
        self.dtype = f"<u{int(np.frombuffer(payload, '<u4', 1, 4)[0])}"
        self.offsets = np.frombuffer(payload, "<u8", n + 1, 28)
        self.counts = np.frombuffer(payload, "<u8", n, 28 + 8 * (n + 1))
        self.frames = memoryview(payload)[28 + 8 * (2 * n + 1) :]
        self.decompressor = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def __len__(self) -> int:
        return len(self.counts)

    def ids(self, k: int) -> np.ndarray:
        frame = self.frames[int(self.offsets[k]) : int(self.offsets[k + 1])]
        return np.frombuffer(self.decompressor.decompress(frame), self.dtype)


def sample_piece(ids: bytes, width: int, key: int) -> bytes:
    """At most ``SAMPLE_BYTES`` of serialized ids, from a place in the whole that a hash chooses."""
    places = len(ids) - SAMPLE_BYTES
    if places <= 0:
        return ids
    start = xxhash.xxh3_64_intdigest(key.to_bytes(8, "little", signed=True)) % (places // width + 1) * width
    return ids[start : start + SAMPLE_BYTES]


def train_dictionary(
    documents: DataFrame, tokenizer_path: str | None = None, sample_documents: int = SAMPLE_DOCUMENTS
) -> bytes:
    """Dictionary from a piece of the ids of at most ``sample_documents`` documents, anywhere in their whole texts; empty where they
    are too few to train on. Only compression depends on it, never what is read back."""
    by_hash = documents.filter("doc_id IS NOT NULL").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = [r.doc_id for r in by_hash.limit(sample_documents).collect()]

    def serialize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer_path or default_tokenizer())
        width = np.dtype(words.dtype).itemsize
        for batch in batches:
            whole = (words.encode(x.as_py() or "").tobytes() for x in batch.column(1))
            pieces = [sample_piece(ids, width, key) for ids, key in zip(whole, batch.column(0).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.binary())], names=["ids"])

    sample = documents.filter(F.col("doc_id").isin(chosen)).select("doc_id", "text").mapInArrow(serialize, "ids binary")
    samples = [bytes(r.ids) for r in sample.limit(sample_documents).collect() if len(r.ids) >= 16]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes() if len(samples) >= 50 else b""
    except zstandard.ZstdError:
        return b""


def write_store(
    documents: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int = END_ID, block_bytes: int = BLOCK_BYTES
) -> None:
    """Write the ids of every whole text of ``documents`` (``doc_id``, ``text``; other columns are ignored) to ``path``.

    A null text is an empty one: its end id alone. Null ids come first; rows with the same ``doc_id`` are kept, in the
    order of the input. An empty table gives an empty store.
    """
    spark = documents.sparkSession
    documents = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    dictionary = train_dictionary(documents, tokenizer_path)
    dict_hash = dictionary_hash(dictionary)
    spark.createDataFrame([(dict_hash, dictionary)], "dict_hash binary, dictionary binary").coalesce(1).write.parquet(
        f"{path}/dictionary"
    )

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer_path or default_tokenizer())
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary), write_content_size=True)
        end = np.array([end_id], dtype=words.dtype).tobytes()
        for batch in batches:
            frames, counts = [], []
            for text in batch.column(2):
                ids = words.encode(text.as_py()).tobytes() + end
                counts.append(len(ids) // np.dtype(words.dtype).itemsize)
                frames.append(pack.compress(ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(frames, pa.binary()),
                 pa.array([np.dtype(words.dtype).itemsize] * len(counts), pa.int32())],
                names=["doc_id", "row_id", "n_tokens", "frame", "width"],
            )

    staged = scratch_path(spark, "frames")
    numbered = documents.select("doc_id", F.monotonically_increasing_id().alias("row_id"), "text")
    numbered.mapInArrow(compress, "doc_id long, row_id long, n_tokens long, frame binary, width int").write.option(
        "compression", "none"
    ).parquet(staged)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        doc_ids: list = []
        starts: list[int] = []
        frames: list[bytes] = []
        counts: list[int] = []
        size, width = 0, 0

        def emit() -> pa.RecordBatch:
            nonlocal block, doc_ids, starts, frames, counts, size
            known = [d for d in doc_ids if d is not None]
            row = {
                "shard": [shard], "block": [block], "first_doc": [doc_ids[0]], "last_doc": [known[-1] if known else None],
                "doc_ids": [doc_ids], "starts": [starts], "n_tokens": [sum(counts)],
                "payload": [write_block(frames, counts, width, dict_hash)],
            }
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            block, doc_ids, starts, frames, counts, size = block + 1, [], [], [], [], 0
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(row.values(), types, strict=True)], names=list(row)
            )

        for batch in batches:
            for doc_id, n, frame, width in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                doc_ids.append(doc_id)
                starts.append(before)
                frames.append(frame)
                counts.append(n)
                before += n
                size += len(frame)
                if size >= block_bytes:
                    yield emit()
        if doc_ids:
            yield emit()

    ordered = spark.read.parquet(staged).repartitionByRange("doc_id", "row_id").sortWithinPartitions("doc_id", "row_id")
    ordered.select("doc_id", "n_tokens", "frame", "width").mapInArrow(blocks, BLOCKS).write.option(
        "compression", "none"
    ).option("parquet.block.size", 16 * BLOCK_BYTES).parquet(f"{path}/blocks")
    remove_path(spark, staged)

    shards = spark.read.parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("n_tokens").alias("n_tokens"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per written file
    shards.withColumn("before", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0))).write.parquet(f"{path}/manifest")


def read_store(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids`` (little-endian, 32 bits), read
    from a store's files; only the blocks and frames of ``doc_ids`` where given."""
    rows = spark.read.parquet(f"{path}/dictionary").collect()  # one row of at most DICTIONARY_BYTES
    dictionary = bytes(rows[0].dictionary)
    wanted = set(doc_ids) if doc_ids is not None else None
    stored = spark.read.parquet(f"{path}/blocks")
    if wanted is not None:
        spans = [(F.col("last_doc") >= d) & (F.coalesce("first_doc", F.lit(d)) <= d) for d in wanted]
        stored = stored.filter(_any(spans))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = BlockReader(batch.column(3)[i].as_py(), dictionary)
                doc, start = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                keep = [k for k in range(len(block)) if wanted is None or doc[k] in wanted]
                raw = [block.ids(k).astype("<u4").tobytes() for k in keep]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column(0)[i].as_py()] * len(keep), pa.int32()),
                        pa.array([doc[k] for k in keep], pa.int64()),
                        pa.array([start[k] for k in keep], pa.int64()),
                        pa.array(raw, pa.binary()),
                    ],
                    names=["shard", "doc_id", "start", "ids"],
                )

    decoded = stored.select("shard", "doc_ids", "starts", "payload").mapInArrow(
        decode, "shard int, doc_id long, start long, ids binary"
    )
    manifest = spark.read.parquet(f"{path}/manifest").select("shard", "before")
    return decoded.join(manifest, "shard").select(
        "doc_id",
        (F.col("start") + F.col("before")).alias("start"),
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
    )


def _any(conditions: list) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out
