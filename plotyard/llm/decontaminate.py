"""Benchmark decontamination: an FM-index for each shard of documents, searched for every benchmark window.

Words: A-Z lower-cased, then runs of characters other than ASCII control characters, blanks and punctuation.
A window is ``window`` consecutive words of a benchmark item; an item of fewer words, but not none, is one window.

A shard is a bounded stretch of an input split. Only runs of words that occur in the benchmark, at least as long
as the shortest window, can hold an occurrence, so only these enter the shard's index; that is exact. Backward
search finds all windows at once, sampled positions locate their occurrences, and these are merged to spans.
Documents are not shuffled. Benchmark items are the query set: they go to the tasks in blocks of
``QUERY_BLOCK_CHARS``, one pass over the documents each, whose spans add up.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotyard.llm.fmindex import FMIndex

WINDOW = 13
SHARD_WORDS = 1_000_000  # words in a shard's index
SHARD_BYTES = 32 << 20  # text of a shard's documents
SLICE_BYTES = 4 << 20  # text of documents split into words at once
QUERY_BLOCK_CHARS = 8 << 20

_WORD_BYTES = bytes(
    c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)
)
_END = b"\x01"  # stands between documents; never a word

SPANS = "array<struct<start:int,end:int>>"
FOUND = f"n_words long, spans {SPANS}, items array<long>"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def split_words(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


class Windows:
    """Distinct windows of a block of items over the vocabulary of the block."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int):
        found: dict[tuple[bytes, ...], set] = {}
        for item_id, text in items:
            words = split_words((text or "").encode())
            for k in range(max(1, len(words) - window + 1) if words else 0):
                found.setdefault(tuple(words[k : k + window]), set()).add(item_id)
        self.vocabulary = {w: i + 1 for i, w in enumerate(dict.fromkeys(w for words in found for w in words))}
        self.lookup = self.vocabulary | {_END: -1}
        self.lengths = np.array([len(words) for words in found], dtype=np.int64)
        self.patterns = np.zeros((len(found), window), dtype=np.int64)
        for row, words in zip(self.patterns, found, strict=True):
            row[window - len(words) :] = [self.vocabulary[w] for w in words]
        self.items = [sorted(i for i in ids if i is not None) for ids in found.values()]
        self.shortest = int(self.lengths.min()) if found else 0


class Shard:
    """Documents of one shard: their runs of benchmark words, then the occurrences found in them."""

    def __init__(self, windows: Windows):
        self.windows, self.n_words = windows, []
        self.pieces: list[np.ndarray] = [np.zeros(1, dtype=np.int32)]
        self.runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # document, first word, length
        self.size, self.bytes = 1, 0

    def add(self, texts: list[bytes]) -> None:
        words = (b" " + _END + b" ").join([t.translate(_WORD_BYTES) for t in texts]).split()
        ids = np.fromiter(map(self.windows.lookup.get, words, repeat(0)), dtype=np.int32, count=len(words))
        ends = np.concatenate([np.flatnonzero(ids < 0), [len(ids)]])
        begins = np.concatenate([[0], ends[:-1] + 1])
        first = len(self.n_words)
        self.n_words += (ends - begins).tolist()
        inside = np.concatenate([[False], ids > 0, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        low, high = edges[::2], edges[1::2]
        if self.windows.shortest:
            keep = high - low >= self.windows.shortest
            low, high = low[keep], high[keep]
            doc = np.searchsorted(begins, low, side="right") - 1
            self.runs.append((doc + first, low - begins[doc], high - low))
            lengths = high - low + 1  # each run is followed by a separator
            at = np.repeat(low - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))
            run = np.append(ids, np.int32(0))[at]
            run[np.cumsum(lengths) - 1] = 0
            self.pieces.append(run)
            self.size += len(run)

    def occurrences(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, first word and window of every occurrence."""
        none = np.zeros(0, dtype=np.int64)
        if self.size == 1:
            return none, none, none
        index = FMIndex(np.concatenate(self.pieces), len(self.windows.vocabulary) + 1)
        low, high = index.search(self.windows.patterns, self.windows.lengths)
        counts = np.maximum(high - low, 0)
        rows = np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
        at = index.locate(rows)
        doc, word, length = (np.concatenate([r[k] for r in self.runs]) for k in range(3))
        begin = 1 + np.cumsum(length + 1) - length - 1
        run = np.searchsorted(begin, at, side="right") - 1
        return doc[run], word[run] + at - begin[run], np.repeat(np.arange(len(counts)), counts)

    def found(self, earlier: list[tuple[list[dict], list[int]]]) -> tuple[list[list[dict]], list[list[int]]]:
        """Spans and items of each document, together with what earlier query blocks found."""
        doc, word, window = self.occurrences()
        order = np.lexsort((word, doc))
        doc, word, window = doc[order], word[order], window[order]
        length = self.windows.lengths[window]
        bounds = np.searchsorted(doc, np.arange(len(self.n_words) + 1))
        spans, items = [], []
        for d, (old_spans, old_items) in enumerate(earlier):
            a, b = bounds[d], bounds[d + 1]
            if a == b:
                spans.append(old_spans)
                items.append(old_items)
                continue
            start, end = word[a:b], word[a:b] + length[a:b]
            if old_spans:
                start = np.concatenate([start, [x["start"] for x in old_spans]])
                end = np.concatenate([end, [x["end"] for x in old_spans]])
                order = np.argsort(start, kind="stable")
                start, end = start[order], end[order]
            spans.append([{"start": x, "end": y} for x, y in zip(*merge_spans(start, end), strict=True)])
            items.append(sorted({i for k in set(window[a:b].tolist()) for i in self.windows.items[k]} | set(old_items)))
        return spans, items


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[list[int], list[int]]:
    """Union of half-open spans sorted by start, touching ones joined."""
    reach = np.maximum.accumulate(ends)
    fresh = np.concatenate([[True], starts[1:] > reach[:-1]])
    last = np.concatenate([np.flatnonzero(fresh)[1:] - 1, [len(starts) - 1]])
    return starts[fresh].tolist(), reach[last].tolist()


def _search(items: list[tuple[int | None, str | None]], window: int):
    """Task of one query block: columns row (a document), spans and items in; row and those of FOUND out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(items, window)
        kept: list[pa.RecordBatch] = []
        shard = Shard(windows)

        def emit() -> pa.RecordBatch:
            nonlocal shard, kept
            rows = pa.Table.from_batches(kept)
            earlier = list(zip(rows["spans"].to_pylist(), rows["items"].to_pylist(), strict=True))
            spans, ids = shard.found(earlier)
            out = pa.RecordBatch.from_arrays(
                [rows["row"].combine_chunks(), pa.array(shard.n_words, pa.int64()), pa.array(spans, _SPAN_TYPE), pa.array(ids, pa.list_(pa.int64()))],
                names=["row", "n_words", "spans", "items"],
            )
            shard, kept = Shard(windows), []
            return out

        for batch in batches:
            texts = pa.compute.struct_field(batch.column("row"), "text").cast(pa.binary()).fill_null(b"")
            for low, high in slices(pa.compute.binary_length(texts).to_pylist(), SLICE_BYTES):
                part = texts.slice(low, high - low)
                shard.add(part.to_pylist())
                shard.bytes += part.nbytes
                kept.append(batch.slice(low, high - low))
                if shard.size >= SHARD_WORDS or shard.bytes >= SHARD_BYTES:
                    yield emit()
        if kept:
            yield emit()

    return run


def slices(sizes, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``most`` bytes, or one row."""
    low = total = 0
    for i, size in enumerate(sizes):
        if i > low and total + size > most:
            yield low, i
            low, total = i, 0
        total += size
    if len(sizes):
        yield low, len(sizes)


def benchmark_spans(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``row`` (the document with all its columns), ``n_words``, ``spans`` (array of ``start``, ``end`` in words, merged, end exclusive) and
    ``items`` (sorted ids of items with an occurring window).

    ``documents`` needs ``text``; ``benchmark`` needs ``item_id`` and ``text``. Null and empty texts have no words. An item with
    a null id marks spans but is not listed. Repeated rows are each judged. Windows never cross documents.
    """
    nothing = [F.expr(f"cast(array() as {SPANS})").alias("spans"), F.expr("cast(array() as array<long>)").alias("items")]
    whole = documents.withColumn("text", F.col("text").cast("string"))
    frame = whole.select(F.struct(*(F.col(f"`{c}`") for c in whole.columns)).alias("row"), *nothing)
    kind = frame.schema["row"].dataType.simpleString()
    for items in query_blocks(benchmark):
        frame = frame.select("row", "spans", "items").mapInArrow(_search(items, window), f"row {kind}, {FOUND}")
    return frame


def query_blocks(benchmark: DataFrame, block_chars: int = QUERY_BLOCK_CHARS) -> list[list[tuple[int | None, str | None]]]:
    """The benchmark's items, the stated query set, in blocks of bounded size; at least one, perhaps empty."""
    blocks: list[list] = [[]]
    size = 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        if size > block_chars:
            blocks.append([])
            size = 0
        blocks[-1].append((row.item_id, row.text))
        size += len(row.text or "")
    return blocks


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``benchmark_spans`` with ``n_hit`` (words inside spans) and ``contaminated``: at least a twentieth of the words."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    found = benchmark_spans(documents, benchmark, window).withColumn("n_hit", hit)
    return found.withColumn("contaminated", F.expr("n_hit > 0 AND 20 * n_hit >= n_words"))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``documents``, same columns, without the contaminated ones; the others keep every word. Null and blank texts stay; repeated rows stay or
    go together, whatever their ids. An empty table gives an empty one, an empty benchmark all documents."""
    return contamination(documents, benchmark, window).filter("NOT contaminated").select("row.*")
