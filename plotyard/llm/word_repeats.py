"""Exact removal of word sequences that earlier documents hold, by seed and extend.

A window is ``window`` consecutive words of a document. Its anchor is the ``gram`` words inside it with the smallest hash (leftmost of
equals), so equal windows have equal anchors and a text of n words has about n / 6 of them. Anchors are the seeds:

1. Documents meet on their anchors. A seed that two documents share goes on, all others are unique and end here.
2. Each shared seed is extended to the left and to the right, to every window that it anchors, and the extended words
   meet again, each with the smallest ``doc_id`` that holds them. A window is a repeat where that id is smaller than the own.
3. Repeats that overlap or touch are joined: the spans left are maximal, and at least ``window`` words long.

Documents are worked on in slices of about 2 MB. A slice sends every anchor and every extended window once, with the smallest id of
its documents, in one block per range of hashes; a range answers with one bit for each. So copies within a slice meet
nobody, an anchor that every document holds is one entry per slice, no pairs are formed, and answers are small. Words, anchors and
windows are compared by 64-bit hashes, windows only among those with the same anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotyard.session import hand_over, release_shuffles

WINDOW = 13
GRAM = 4
SLICE_BYTES = 2 << 20  # texts worked on at once; a longer text is a slice of its own
RANGE_BYTES = 32 << 20  # bytes of text for each range of hashes
STEP = 1 << 19  # windows whose anchors are found at once; a window is never cut
NULL_ID = np.iinfo(np.int64).min  # a null doc_id comes before all others

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
SLICES = "slice long, doc_ids array<long>, n_bytes long, texts array<string>"
RESULT = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,length:long>>, kept string"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, modulo 2**64."""
    if n > max(_POWERS, default=0):
        size = max(n, SLICE_BYTES + (1 << 16))
        up, down = np.full(size, _BASE, dtype=np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        _POWERS.clear()
        _POWERS[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return next(iter(_POWERS.values()))


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= _MIX
    x ^= x >> np.uint64(29)
    return x


def _hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of ``values[start:end]`` (unsigned, none zero) for each pair."""
    up, down = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return _mixed((sums[ends] - sums[starts]) * down[starts])


class Words:
    """Words of some texts: their hashes, and per text the number of the first one."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        inside = ~_SPACE[raw]
        edges = np.flatnonzero(np.diff(inside, prepend=False))
        starts, ends = edges[::2], edges[1::2]
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.first = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes + 1)]))
        self.hashes = _hashes(raw.astype(np.uint64) + np.uint64(1), starts, ends) | np.uint64(1)

    def __len__(self) -> int:
        return len(self.hashes)


class Seeds:
    """Windows of a slice, in order: ``at`` (number of the first word), ``doc`` (the text's number) and ``anchors``."""

    def __init__(self, words: Words, window: int, gram: int, step: int = STEP):
        self.words, self.window = words, window
        counts = np.diff(words.first)
        held = np.maximum(counts - window + 1, 0)
        self.doc = np.repeat(np.arange(len(counts)), held)
        self.at = np.arange(len(self.doc)) + np.repeat(words.first[:-1] - (np.cumsum(held) - held), held)
        n = len(words)
        starts = np.arange(max(n - gram + 1, 0))
        grams = _hashes(words.hashes, starts, starts + gram)
        parts, span = [], window - gram + 1
        for low in range(0, max(n - window + 1, 0), step):
            some = grams[low : low + step + span - 1]
            bits = np.uint64(20)
            least, have = (some >> bits << bits) | np.arange(len(some), dtype=np.uint64), 1
            while 2 * have <= span:
                least = np.minimum(least[:-have], least[have:])
                have *= 2
            if have < span:
                least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
            parts.append(some[(least & np.uint64((1 << 20) - 1)).astype(np.int64)])
        every = np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)
        self.anchors = every[self.at]

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """The anchors, rising, and whether two texts of the slice hold them."""
        turn = np.ones(len(self.at), dtype=bool)  # windows after the first of a run add nothing
        turn[1:] = (self.anchors[1:] != self.anchors[:-1]) | (self.doc[1:] != self.doc[:-1])
        anchors, doc = self.anchors[turn], self.doc[turn]
        order = np.argsort(anchors, kind="stable")
        anchors, doc = anchors[order], doc[order]
        heads = _heads(anchors)
        return anchors[heads], np.maximum.reduceat(doc, heads) > np.minimum.reduceat(doc, heads) if len(heads) else np.empty(0, dtype=bool)

    def extended(self, shared: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Seeds among ``shared`` (rising) extended to all their windows: the places of these in this slice's windows, the entry of
        each, and per entry anchor, hash and the smallest id."""
        k = np.minimum(np.searchsorted(shared, self.anchors), max(len(shared) - 1, 0))
        places = np.flatnonzero(shared[k] == self.anchors) if len(shared) else np.empty(0, dtype=np.int64)
        starts = self.at[places]
        found = _hashes(self.words.hashes, starts, starts + self.window)
        anchors, own = self.anchors[places], ids[self.doc[places]]
        order = np.lexsort((found, anchors))
        anchors, found, own = anchors[order], found[order], own[order]
        heads = _heads(anchors, found)
        entry = np.empty(len(places), dtype=np.int64)
        entry[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(order))))
        least = np.minimum.reduceat(own, heads) if len(heads) else own
        return places, entry, anchors[heads], found[heads], least


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    n = len(columns[0])
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _ranges(anchors: np.ndarray, ranges: int) -> np.ndarray:
    """Bounds, among rising anchors, of the equal ranges of hashes."""
    starts = np.array([(k << 64) // ranges for k in range(1, ranges)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(anchors, starts), [len(anchors)]])


def _ids(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column, NULL_ID).to_numpy(zero_copy_only=False)


def _texts(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def _cut_slices(slice_bytes: int):
    """Rows of ``SLICES`` from rows of ``doc_id`` and ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, size = TaskContext.get().partitionId(), 0, 0
        held: list[pa.RecordBatch] = []

        def row() -> pa.RecordBatch:
            ids, texts = (pa.concat_arrays([b.column(c) for b in held]) for c in (0, 1))
            ends = pa.array([0, len(ids)], pa.int32())
            columns = [pa.array([(part << 32) | number], pa.int64()), pa.ListArray.from_arrays(ends, ids), pa.array([size], pa.int64()), pa.ListArray.from_arrays(ends, texts)]
            return pa.RecordBatch.from_arrays(columns, names=["slice", "doc_ids", "n_bytes", "texts"])

        for batch in batches:
            begin = 0
            for k, length in enumerate(pc.binary_length(batch.column(1)).to_pylist()):
                if size and size + length > slice_bytes:
                    held.append(batch.slice(begin, k - begin))
                    yield row()
                    number, size, held, begin = number + 1, 0, [], k
                size += length
            held.append(batch.slice(begin))
        if sum(b.num_rows for b in held):
            yield row()

    return run


BLOCK = "slice long, range int, anchors binary, windows binary, ids binary"


def _blocks(number: int, bounds: np.ndarray, anchors: np.ndarray, *more: np.ndarray) -> Iterator[pa.RecordBatch]:
    some = [k for k in range(len(bounds) - 1) if bounds[k] < bounds[k + 1]]
    if some:
        cut = lambda c: pa.array([c[bounds[k] : bounds[k + 1]].tobytes() for k in some], pa.binary())
        columns = [cut(anchors), *(cut(c) for c in more)] + [pa.nulls(len(some), pa.binary())] * (2 - len(more))
        heads = [pa.array([number] * len(some), pa.int64()), pa.array(some, pa.int32())]
        yield pa.RecordBatch.from_arrays([*heads, *columns], names=[f.split()[0] for f in BLOCK.split(", ")])


ANSWER = "slice long, range int, bits binary"


def _answers(pdf: pd.DataFrame, found: np.ndarray, sizes: list[int]) -> pd.DataFrame:
    parts = np.split(found, np.cumsum(sizes)[:-1])
    return pd.DataFrame({"slice": pdf["slice"], "range": pdf["range"], "bits": [np.packbits(p).tobytes() for p in parts]})


def _joined(column: pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=kind)


def _shared_anchors(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each slice's anchors whether another slice has them too."""
    anchors = _joined(pdf["anchors"], "<u8")
    order = np.argsort(anchors, kind="stable")
    heads = _heads(anchors[order])
    counts = np.diff(np.append(heads, len(anchors)))
    found = np.empty(len(anchors), dtype=bool)
    found[order] = np.repeat(counts > 1, counts)
    return _answers(pdf, found, [len(x) // 8 for x in pdf["anchors"]])


def _earlier_windows(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each slice's windows whether another slice has them under a smaller id."""
    anchors, windows, ids = _joined(pdf["anchors"], "<u8"), _joined(pdf["windows"], "<u8"), _joined(pdf["ids"], "<i8")
    order = np.lexsort((windows, anchors))
    heads = _heads(anchors[order], windows[order])
    least = np.minimum.reduceat(ids[order], heads)
    found = np.empty(len(ids), dtype=bool)
    found[order] = np.repeat(least, np.diff(np.append(heads, len(ids)))) < ids[order]
    return _answers(pdf, found, [len(x) // 8 for x in pdf["windows"]])


def _bits(answers: list[dict] | None, bounds: np.ndarray) -> np.ndarray:
    found = np.zeros(bounds[-1], dtype=bool)
    for a in answers or ():
        low, high = bounds[a["range"]], bounds[a["range"] + 1]
        found[low:high] = np.unpackbits(np.frombuffer(a["bits"], dtype=np.uint8), count=high - low)
    return found


def _per_slice(answers: DataFrame, name: str) -> DataFrame:
    """A row per slice: answers of all ranges, a bit for each entry."""
    return hand_over(answers.groupBy("slice").agg(F.collect_list(F.struct("range", "bits")).alias(name)), f"{name}-answers")


def _repeats(seeds: Seeds, places: np.ndarray) -> list[list[tuple[int, int]]]:
    """Per text the maximal spans (first word and words) that windows at ``places`` cover."""
    first, spans = seeds.words.first, [[] for _ in range(len(seeds.words.first) - 1)]
    if len(places):
        at, doc = seeds.at[places], seeds.doc[places]
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + seeds.window)])
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(at)) - 1
        for d, a, b in zip(doc[heads].tolist(), at[heads].tolist(), (at[tails] + seeds.window).tolist(), strict=True):
            spans[d].append((a - int(first[d]), b - a))
    return spans


def _kept(text: bytes, spans: list[tuple[int, int]]) -> str:
    words = text.split()  # bytes split at the same six characters as words
    end, out = 0, []
    for start, length in spans:
        out += words[end:start]
        end = start + length
    return b" ".join(out + words[end:]).decode()


def remove_word_repeats(
    documents: DataFrame, window: int = WINDOW, gram: int = GRAM, slice_bytes: int = SLICE_BYTES, range_bytes: int = RANGE_BYTES, step: int = STEP
) -> DataFrame:
    """Per document ``doc_id``, ``n_words``, ``n_removed``, ``spans`` (removed maximal runs: ``start`` and ``length`` in words) and ``kept``, the other words
    joined by one space.

    Words are runs of characters other than space, tab, line feed, vertical tab, form feed and carriage return. A word goes if a window
    over it also starts in a document with a smaller ``doc_id``; windows are judged on the input. A null text has no words. A
    null id comes before all others. Rows with the same id never repeat each other, and each is judged. Empty tables give
    no rows. Other columns are ignored. The last three parameters change no result. A text is worked on in one piece, with about 80 bytes of memory for each of its bytes.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    slices = hand_over(rows.mapInArrow(_cut_slices(slice_bytes), SLICES), "slices")
    total = slices.agg(F.sum("n_bytes")).first()[0] or 0
    ranges = -(-total // range_bytes) or 1

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, list[bytes], Seeds, pa.RecordBatch, int]]:
        for batch in batches:
            for i in range(batch.num_rows):
                texts = _texts(batch.column("texts")[i].values)
                yield batch.column("slice")[i].as_py(), batch.column("doc_ids")[i].values, texts, Seeds(Words(texts), window, gram, step), batch, i

    def shared(seeds: Seeds, batch: pa.RecordBatch, i: int) -> np.ndarray:
        anchors, local = seeds.distinct()
        return anchors[local | _bits(batch.column("seeds")[i].as_py(), _ranges(anchors, ranges))]

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, _, seeds, _, _ in each(batches):
            anchors, _ = seeds.distinct()
            yield from _blocks(number, _ranges(anchors, ranges), anchors)

    def send_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, _, seeds, batch, i in each(batches):
            _, _, anchors, windows, least = seeds.extended(shared(seeds, batch, i), _ids(ids))
            yield from _blocks(number, _ranges(anchors, ranges), anchors, windows, least)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, texts, seeds, batch, i in each(batches):
            own = _ids(ids)
            places, entry, anchors, _, least = seeds.extended(shared(seeds, batch, i), own)
            elsewhere = _bits(batch.column("windows")[i].as_py(), _ranges(anchors, ranges))
            gone = elsewhere[entry] | (least[entry] < own[seeds.doc[places]])
            spans = _repeats(seeds, places[gone])
            removed = [sum(length for _, length in s) for s in spans]
            columns = [
                ids, pa.array(np.diff(seeds.words.first)), pa.array(removed, pa.int64()),
                pa.array([[{"start": a, "length": n} for a, n in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
                pa.array([_kept(t, s) for t, s in zip(texts, spans, strict=True)], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "spans", "kept"])

    seeds = _per_slice(slices.mapInArrow(send_anchors, BLOCK).groupBy("range").applyInPandas(_shared_anchors, ANSWER), "seeds")
    release_shuffles(spark)
    seeded = slices.join(seeds, "slice", "left")
    windows = _per_slice(seeded.mapInArrow(send_windows, BLOCK).groupBy("range").applyInPandas(_earlier_windows, ANSWER), "windows")
    release_shuffles(spark)
    return seeded.join(windows, "slice", "left").mapInArrow(remove, RESULT)
