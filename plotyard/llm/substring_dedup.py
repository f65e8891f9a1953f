"""Exact removal of long repeated byte strings with suffix arrays over shards.

A window is ``window`` consecutive bytes of a document. Shards are made so that equal windows meet in one: of the ``GRAM``-byte
strings inside a window the one with the smallest hash (leftmost of equals) is its anchor, so equal windows have equal
anchors. Consecutive windows with the same anchor are one segment, at most 2 * window - ``GRAM`` bytes. Segments whose
anchor occurs once are unique and go no further. Equal segments are counted and need no comparison: all their windows
repeat. The distinct segments of an anchor that has several are compared in a shard: its suffix array (induced sorting)
and common prefixes of at least ``window`` between neighbours give the windows that repeat.

An anchor with more distinct segments than fit a shard is split over several by a hash of the segment. Each of these
sends on every distinct window once (128-bit hash), under an anchor of nine tenths of the window; windows whose longer
anchor no other row has are unique, and a window that two shards sent repeats. So no task holds more than a bounded
part of a group, and no pairs are formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotyard.llm.suffix_array import permuted_prefixes, suffix_array
from plotyard.session import hand_over, release_shuffles

WINDOW = 200
GRAM = 40
CHUNK = 1 << 19  # bytes of a document whose anchors are found at once; its windows are whole
SHARD_SEGMENTS = 6_000  # distinct segments in a suffix array, at most about 2 MB

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
SEGMENTS = "doc_id long, text_hash long, anchor long, segment long, start long, length int"


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if CHUNK not in _POWERS:
        n = CHUNK + 4096
        up, down = np.full(n, _BASE), np.full(n, _BASE_INVERSE)
        up[0] = down[0] = 1
        _POWERS[CHUNK] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[CHUNK]


def anchors(raw: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments of a stretch of at most CHUNK + window - 1 bytes: anchor hash, first window and last window of each."""
    up, down = _powers()
    n = len(raw)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(raw * up[:n], out=sums[1:])
    grams = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
    grams ^= grams >> np.uint64(32)
    grams *= _MIX
    grams ^= grams >> np.uint64(29)
    bits = np.uint64(20)
    least = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    span, have = window - gram + 1, 1
    while 2 * have <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < span:
        least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
    at = (least & np.uint64((1 << 20) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    return grams[at[first]].view(np.int64), first, last


def _cut_segments(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            parts: list[list] = [[], [], [], [], [], []]
            rows = 0
            for k in range(batch.num_rows):
                data = texts[k].as_py()
                for base in range(0, max(0, len(data) - window + 1), CHUNK):
                    piece = data[base : base + CHUNK + window - 1]
                    key, first, last = anchors(np.frombuffer(piece, dtype=np.uint8), window, gram)
                    view = memoryview(piece)
                    hashed = [xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(first.tolist(), (last + window).tolist(), strict=True)]
                    for part, value in zip(
                        parts,
                        ([batch.column(0)[k].as_py()] * len(key), [batch.column(1)[k].as_py()] * len(key), key, np.array(hashed, dtype=np.uint64).view(np.int64), first + base, last - first + window),
                        strict=True,
                    ):
                        part.append(value)
                    rows += len(key)
                    if rows > 200_000:
                        yield _segment_batch(parts)
                        parts, rows = [[], [], [], [], [], []], 0
            if rows:
                yield _segment_batch(parts)

    return run


def _segment_batch(parts: list[list]) -> pa.RecordBatch:
    ids = pa.array([x for part in parts[0] for x in part], pa.int64())
    hashes = pa.array([x for part in parts[1] for x in part], pa.int64())
    rest = [pa.array(np.concatenate(p), t) for p, t in zip(parts[2:], (pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
    rest[3] = rest[3].cast(pa.int32())
    return pa.RecordBatch.from_arrays([ids, hashes, *rest], names=[f.split()[0] for f in SEGMENTS.split(", ")])


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the segments that each row's document stands for."""
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        out: list[list] = [[], [], [], [], []]
        for k, wanted in enumerate(batch.column("wanted").to_pylist()):
            data = texts[k].as_py()
            for w in wanted:
                row = w["anchor"], w["segment"], w["parts"], w["shard"], data[w["start"] : w["start"] + w["length"]]
                for column, value in zip(out, row, strict=True):
                    column.append(value)
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["anchor", "segment", "parts", "shard", "bytes"])


def repeated_windows(segments: list[bytes], window: int) -> list[np.ndarray]:
    """For each of several distinct strings the starts of its windows that occur elsewhere among them, from a suffix array
    of all of them."""
    lengths = np.array([len(x) for x in segments], dtype=np.int64)
    text = np.frombuffer(b"\x00".join(segments) + b"\x00", dtype=np.uint8).astype(np.int64) + 2
    begins = np.cumsum(lengths + 1) - lengths - 1
    text[begins + lengths] = 1  # separators below every byte
    text = np.append(text, 0)
    order = suffix_array(text, 258)
    counts = np.maximum(lengths - window + 1, 0)
    owner = np.repeat(np.arange(len(segments)), counts)
    starts = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    positions = begins[owner] + starts
    before, common = permuted_prefixes(text, order, positions, window)
    hit = np.zeros(len(text), dtype=bool)
    equal = common >= window
    hit[positions[equal]] = True
    hit[before[equal]] = True
    found = hit[positions]
    return np.split(starts[found], np.searchsorted(owner[found], np.arange(1, len(segments))))


COMPARED = "anchor long, segment long, low int, high int, fine binary, at array<int>, hashes binary"


def _compare(window: int):
    fine = window - window // 10

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["anchor", "segment"])
        found = repeated_windows(pdf["bytes"].tolist(), window)
        out: list[tuple] = []
        sent: set[bytes] = set()  # windows of this shard that already have a row
        for anchor, segment, parts, data, at in zip(pdf["anchor"], pdf["segment"], pdf["parts"], pdf["bytes"], found, strict=True):
            for low, high in _runs(at):
                out.append((anchor, segment, low, high, None, None, None))
            if parts > 1:
                view = memoryview(data)
                key, first, last = anchors(np.frombuffer(data, dtype=np.uint8), window, fine)
                for k, low, high in zip(key.tolist(), first.tolist(), last.tolist(), strict=True):
                    fresh = []
                    for i in range(low, high + 1):
                        digest = xxhash.xxh3_128_digest(view[i : i + window])
                        if digest not in sent:
                            sent.add(digest)
                            fresh.append((i, digest))
                    if fresh:
                        out.append((anchor, segment, low, high, k.to_bytes(8, "little", signed=True), [i for i, _ in fresh], b"".join(h for _, h in fresh)))
        kinds = {"anchor": "int64", "segment": "int64", "low": "int32", "high": "int32"}
        return pd.DataFrame(out, columns=["anchor", "segment", "low", "high", "fine", "at", "hashes"]).astype(kinds)

    return run


def _runs(at: np.ndarray) -> list[tuple[int, int]]:
    if not len(at):
        return []
    breaks = np.flatnonzero(np.diff(at) > 1)
    return list(zip(at[np.concatenate([[0], breaks + 1])].tolist(), at[np.concatenate([breaks, [len(at) - 1]])].tolist(), strict=True))


def repeated_spans(documents: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``doc_id``, ``text`` (bytes) and ``spans``: array of ``start``, ``length`` in bytes, unmerged, of what repeated windows cover, a row per
    document. See ``remove_repeats``."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    segments = hand_over(docs.mapInArrow(_cut_segments(window, gram), SEGMENTS), "segments")
    often = segments.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor")
    shared = hand_over(segments.join(often, "anchor", "left_semi"), "shared-segments")
    release_shuffles(spark)
    one = F.min(F.struct("doc_id", "text_hash", "start")).alias("one")
    distinct = hand_over(shared.groupBy("anchor", "segment", "length").agg(F.count(F.lit(1)).alias("copies"), one), "distinct-segments")
    kinds = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    parts = F.ceil(F.col("kinds") / SHARD_SEGMENTS).cast("int")
    contested = distinct.join(kinds, "anchor").withColumn("parts", parts)
    shards = F.greatest(F.ceil(F.lit(contested.count()) / (SHARD_SEGMENTS / 3)), F.lit(1))
    # small groups share shards; a part of a large one is a shard of its own
    shard = F.when(F.col("parts") > 1, F.xxhash64("anchor", F.pmod("segment", "parts"))).otherwise(F.pmod(F.xxhash64("anchor"), shards))
    wanted = contested.withColumn("shard", shard).groupBy(F.col("one.doc_id").alias("of_doc"), F.col("one.text_hash").alias("of_text")).agg(
        F.collect_list(F.struct("anchor", "segment", "parts", "shard", "one.start", "length")).alias("wanted")
    )
    same = F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("text_hash") == F.col("of_text"))
    fetched = docs.join(wanted, same).select("text", "wanted").mapInArrow(_fetch, "anchor long, segment long, parts int, shard long, bytes binary")
    compared = fetched.groupBy("shard").applyInPandas(_compare(window), COMPARED)
    compared = hand_over(compared, "compared-windows")
    release_shuffles(spark)
    # windows of split groups: only where a longer anchor is shared can a window be, and only one of each shard is sent
    across = compared.filter("fine IS NOT NULL")
    met = across.groupBy("anchor", "fine").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor", "fine")
    sent = across.join(met, ["anchor", "fine"], "left_semi").select("anchor", "segment", F.posexplode("at").alias("k", "low"), "hashes")
    sent = sent.select("anchor", "segment", "low", F.col("low").alias("high"), F.substring("hashes", F.col("k") * 16 + 1, F.lit(16)).alias("hash"))
    twice = sent.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash")
    split = sent.join(twice, "hash", "left_semi")
    span = ["anchor", "segment", "low", "high"]
    runs = compared.filter("fine IS NULL").select(*span).unionByName(split.select(*span))
    whole = distinct.filter("copies > 1").select("anchor", "segment", F.lit(0).alias("low"), (F.col("length") - window).alias("high"))
    runs = runs.unionByName(whole).groupBy("anchor", "segment").agg(F.collect_set(F.struct("low", "high")).alias("runs"))
    placed = shared.join(runs, ["anchor", "segment"]).select("doc_id", "text_hash", "start", F.explode("runs").alias("run"))
    spans = placed.groupBy(F.col("doc_id").alias("of_doc"), F.col("text_hash").alias("of_text")).agg(
        F.collect_set(F.struct((F.col("start") + F.col("run.low")).alias("start"), (F.col("run.high") - F.col("run.low") + window).cast("long").alias("length"))).alias("spans")
    )
    spans = hand_over(spans, "repeat-spans")
    release_shuffles(spark)
    return docs.join(spans, same, "left").select("doc_id", "text", "spans")


def remove_repeats(documents: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per document ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (binary): its UTF-8 bytes without those covered by a string
    of ``window`` bytes that also starts anywhere else in the table, the same document and overlaps included.

    ``documents`` needs ``doc_id`` and ``text``; other columns are ignored. A null text is an empty one. Strings never cross
    documents and are judged on the input. Repeated rows are each judged and repeat each other. Empty tables give no
    rows. ``kept`` can break a character where a span does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            sizes, removed, counts, kept = [], [], [], []
            for k, spans in enumerate(batch.column(2).to_pylist()):
                data = texts[k].as_py()
                pieces, end, n, gone = [], 0, 0, 0
                last_end = -1
                for start, length in sorted((s["start"], s["length"]) for s in spans or ()):
                    if start > last_end:
                        pieces.append(data[end:start])
                        n += 1
                        end = start
                    last_end = max(last_end, start + length)
                    if last_end > end:
                        gone += last_end - end
                        end = last_end
                pieces.append(data[end:])
                sizes.append(len(data))
                removed.append(gone)
                counts.append(n)
                kept.append(b"".join(pieces))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, removed, counts)), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return repeated_spans(documents, window, gram).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")

