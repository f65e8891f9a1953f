"""Packing of documents into training sequences of several lengths.

Every document is routed by its length: whole windows of the longest tier leave at once, and the rest of the
document waits in the tier that holds it. Each tier is then packed from the longest down; the gap at the end
of a window is filled from shorter tiers (the largest waiting rest that fits, else a cut of the smallest one
that does not), so windows are full as long as anything waits. Windows are dealt to step groups so that
groups of a block hold equally many tokens.

A task packs the rows of its own input split in blocks of bounded size and carries what is left to the next
block. No token is shuffled, no window depends on another task, and a retried task gives the same rows. Only
the last tokens of a split can be fewer than the smallest tier; they are cut at powers of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from heapq import heapify, heapreplace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotyard.llm.tokens import default_tokenizer, encoder

TIERS = (4096, 2048, 1024, 512, 256)
BLOCK_TOKENS = 2_000_000
STEP_TOKENS = 16 * 4096
END_ID = 2

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
    "offset long, sequence_length long, tier long, step_group long, ids binary"
)


class TierPool:
    """Waiting rests of documents by size; ``sizes`` has a bit for every size that occurs."""

    def __init__(self):
        self.rests: dict[int, list[tuple[int, int]]] = {}
        self.sizes = 0

    def put(self, doc: int, start: int, length: int) -> None:
        if length:
            self.rests.setdefault(length, []).append((doc, start))
            self.sizes |= 1 << length

    def take(self, size: int) -> tuple[int, int, int]:
        waiting = self.rests[size]
        doc, start = waiting.pop()
        if not waiting:
            del self.rests[size]
            self.sizes &= ~(1 << size)
        return doc, start, size

    def largest(self, most: int) -> int:
        return (self.sizes & ((1 << (most + 1)) - 1)).bit_length() - 1

    def smallest(self, over: int) -> int:
        above = self.sizes >> (over + 1)
        return over + (above & -above).bit_length() if above else 0


def pack_block(lengths: list[int], tiers: tuple[int, ...]) -> tuple[list[list[tuple[int, int, int]]], list]:
    """Windows as lists of (document, start, length), all full, and the last window's pieces if it is not."""
    longest, pool, windows = tiers[0], TierPool(), []
    for doc, length in enumerate(lengths):
        for start in range(0, length - longest + 1, longest):
            windows.append([(doc, start, longest)])
        pool.put(doc, length - length % longest, length % longest)
    while pool.sizes:
        head = pool.take(pool.sizes.bit_length() - 1)
        size = min(t for t in tiers if t >= head[2])
        window, gap = [head], size - head[2]
        while gap and pool.sizes:
            if (fits := pool.largest(gap)) > 0:
                piece = pool.take(fits)
            else:
                doc, start, length = pool.take(pool.smallest(gap))
                piece = (doc, start, gap)
                pool.put(doc, start + gap, length - gap)
            window.append(piece)
            gap -= piece[2]
        if gap:
            return windows, window
        windows.append(window)
    return windows, []


def cut_at_powers(pieces: list[tuple[int, int, int]], tiers: tuple[int, ...]) -> list[list[tuple[int, int, int]]]:
    """The pieces of a last window, fewer tokens than its tier, as windows of powers of two."""
    left, windows = sum(length for _, _, length in pieces), []
    pieces = list(reversed(pieces))
    while left:
        room, window = min(1 << (left.bit_length() - 1), tiers[0]), []
        left -= room
        while room:
            doc, start, length = pieces.pop()
            if length > room:
                pieces.append((doc, start + room, length - room))
                length = room
            window.append((doc, start, length))
            room -= length
        windows.append(window)
    return windows


def step_groups(sizes: list[int], step_tokens: int) -> list[int]:
    """Group of each window; longest windows first, each to the group with the fewest tokens."""
    groups = max(1, round(sum(sizes) / step_tokens))
    heap, out = [(0, g) for g in range(groups)], [0] * len(sizes)
    heapify(heap)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        tokens, group = heap[0]
        out[i] = group
        heapreplace(heap, (tokens + sizes[i], group))
    return out


def pack_documents(
    documents: DataFrame,
    tokenizer_path: str | None = None,
    end_id: int = END_ID,
    tiers: tuple[int, ...] = TIERS,
    block_tokens: int = BLOCK_TOKENS,
    step_tokens: int = STEP_TOKENS,
    keep_ids: bool = False,
) -> DataFrame:
    """One row per piece of a document: the sequence it lies in, its offset there, and its ids' checksum.

    ``documents`` needs ``doc_id`` and ``text``; further columns are ignored. A null or empty text is its end id
    alone. A null ``doc_id`` stays null and repeated ids are packed as separate documents. An empty table gives
    no rows. ``tiers`` are powers of two, longest first. ``ids`` (little-endian, 32 bits) is null unless
    ``keep_ids``. ``sequence_id`` and ``step_group`` are unique over the table; the order inside a split is that
    of the input.
    """
    if list(tiers) != sorted(tiers, reverse=True) or any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be powers of two, longest first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer_path or default_tokenizer())
        base = TaskContext.get().partitionId() << 33
        windows_out = groups_out = 0
        docs: list[tuple] = []  # (doc_id, start of this part in its document, ids, tokens of the document)
        held = 0

        def emit(last: bool) -> pa.RecordBatch:
            nonlocal docs, held, windows_out, groups_out
            windows, rest = pack_block([len(ids) for _, _, ids, _ in docs], tiers)
            carried = []
            if last:
                windows += cut_at_powers(rest, tiers)
            else:
                carried = [(d, s + at, ids[at : at + n], t) for i, at, n in rest for d, s, ids, t in [docs[i]]]
            sizes = [sum(n for _, _, n in w) for w in windows]
            groups = step_groups(sizes, step_tokens)
            out: list[list] = [[] for _ in range(11)]
            for w, (window, size, group) in enumerate(zip(windows, sizes, groups, strict=True)):
                offset = 0
                for i, at, n in window:
                    doc_id, start, ids, total = docs[i]
                    raw = ids[at : at + n].astype("<u4").tobytes()
                    row = (
                        doc_id, start + at, n, zlib.crc32(raw), total, base + windows_out + w, offset, size,
                        size, base + groups_out + group, raw if keep_ids else None,
                    )
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    offset += n
            windows_out += len(windows)
            groups_out += max(groups, default=-1) + 1
            docs, held = carried, sum(len(x[2]) for x in carried)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, type=pa.int64()) for c in out[:10]] + [pa.array(out[10], type=pa.binary())],
                names=[f.split()[0] for f in PIECES.split(", ")],
            )

        end = np.array([end_id], dtype=words.dtype)
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.concatenate([words.encode(text.as_py()), end])
                for start in range(0, len(ids), block_tokens):  # a very long document fills several blocks
                    part = ids[start : start + block_tokens]
                    docs.append((doc_id.as_py(), start, part, len(ids)))
                    held += len(part)
                    if held >= block_tokens:
                        yield emit(last=False)
        if docs:
            yield emit(last=True)

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)
