"""Near-duplicate documents by Jaccard similarity of word shingles: MinHash LSH forest, then exact verification.

Every distinct shingle set gets ``TREES`` signatures of ``DEPTH`` min-hashes; a tree is the trie of one signature over all sets.
Matched prefixes are shortened from ``DEPTH`` until a pair at exactly the threshold shares a prefix in some tree with at
least the target recall. Sets in one trie node of that depth are candidates.

Documents with equal shingle sets are one representative with a count. Representatives connected over trie nodes form
candidate groups. A group is cut into blocks by a hash of the representative, and each pair of blocks is one task of
bounded size that verifies its candidate pairs exactly. A task returns, per representative, how many documents it is linked to and
one edge that keeps it connected: links are counted, not listed, and no group meets in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotyard.llm.columns import unused_names, with_row_ids
from plotyard.llm.components import components
from plotyard.session import discard, hand_over, release_shuffles

WORDS = 5
TREES, DEPTH, TARGET_RECALL = 40, 8, 0.9999
BLOCK = 160  # representatives of a candidate group in a block
PACKED_BYTES = 16 << 20  # memory for the bit matrix of a block pair; longer sets are intersected pair by pair
CHUNK = 8192  # shingles hashed at once
MAX_CACHED_WORDS = 300_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > MAX_CACHED_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _WordHashes()


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of runs of ``words`` lower-cased words parted by white space; a text with fewer words, but not
    none, is one shingle."""
    found = (text or "").lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    hashed = np.fromiter(map(_HASHES.__getitem__, found), dtype=np.uint64, count=len(found))
    width = min(words, len(hashed))
    out = np.zeros(len(hashed) - width + 1, dtype=np.uint64)
    for k in range(width):
        out = out * _MIX + hashed[k : len(hashed) - width + 1 + k]
        out ^= out >> np.uint64(31)
    return np.unique(out)


def prefix_depth(threshold: float, trees: int = TREES, depth: int = DEPTH, target: float = TARGET_RECALL) -> int:
    """The longest prefix at which a pair of similarity ``threshold`` meets in some tree with probability ``target`` or more."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < target:
        depth -= 1
    return depth


class Forest:
    """Keys of the trie nodes that a shingle set lies in, one for each tree, at the chosen prefix length."""

    def __init__(self, trees: int, depth: int):
        rng = np.random.default_rng(20)
        self.trees, self.depth = trees, depth
        self.turn = rng.integers(0, 1 << 32, trees * depth, dtype=np.uint32)[:, None]
        self.times = (rng.integers(0, 1 << 32, trees * depth, dtype=np.uint32) | np.uint32(1))[:, None]

    def nodes(self, sets: np.ndarray) -> np.ndarray:
        low = ((sets * _MIX) >> np.uint64(32)).astype(np.uint32)
        least = np.full(self.trees * self.depth, 0xFFFFFFFF, dtype=np.uint32)
        for at in range(0, len(low), CHUNK):
            np.minimum(least, ((low[at : at + CHUNK] ^ self.turn) * self.times).min(axis=1), out=least)
        signatures = least.reshape(self.trees, self.depth)
        return np.array([xxhash.xxh3_64_intdigest(s.tobytes(), seed=t) for t, s in enumerate(signatures)], dtype=np.uint64).view(np.int64)


def _sign(words: int, trees: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest(trees, depth)
        for batch in batches:
            sizes, firsts, seconds, nodes = [], [], [], []
            for text in batch.column(2):
                found = shingles(text.as_py(), words)
                raw = xxhash.xxh3_128_digest(found.tobytes())
                sizes.append(len(found))
                firsts.append(int.from_bytes(raw[:8], "little", signed=True))
                seconds.append(int.from_bytes(raw[8:], "little", signed=True))
                nodes.append(forest.nodes(found) if len(found) else np.zeros(0, dtype=np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(firsts, pa.int64()), pa.array(seconds, pa.int64()), pa.array(nodes, pa.list_(pa.int64())), batch.column(3)],
                names=["doc_id", "text_hash", "size", "h1", "h2", "nodes", "row"],
            )

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x.as_py(), words).tobytes() for x in batch.column("text")]
            yield batch.drop_columns(["text"]).append_column("shingles", pa.array(sets, pa.binary()))

    return run


def similar_pairs(left: list[np.ndarray], right: list[np.ndarray], pairs: np.ndarray, numerator: int, denominator: int) -> np.ndarray:
    """Which of ``pairs`` (rows of left and right) have a Jaccard similarity of at least numerator / denominator, exactly."""
    n_left, n_right = (np.array([len(x) for x in side], dtype=np.int64) for side in (left, right))
    a, b = n_left[pairs[:, 0]], n_right[pairs[:, 1]]
    pairs = pairs[denominator * np.minimum(a, b) >= numerator * np.maximum(a, b)]
    if not len(pairs):
        return pairs
    used_left, used_right = np.unique(pairs[:, 0]), np.unique(pairs[:, 1])
    rows = [left[i] for i in used_left] + [right[i] for i in used_right]
    every = np.unique(np.concatenate(rows))
    if len(rows) * (len(every) // 8 + 1) <= PACKED_BYTES:
        packed = np.zeros((len(rows), (len(every) + 7) // 8), dtype=np.uint8)
        for row, x in zip(packed, rows, strict=True):
            bits = np.zeros(len(every), dtype=bool)
            bits[np.searchsorted(every, x)] = True
            row[:] = np.packbits(bits)
        i = np.searchsorted(used_left, pairs[:, 0])
        j = np.searchsorted(used_right, pairs[:, 1]) + len(used_left)
        both = np.concatenate([
            np.bitwise_count(packed[i[k : k + 64]] & packed[j[k : k + 64]]).sum(axis=1, dtype=np.int64) for k in range(0, len(pairs), 64)
        ])
    else:
        both = np.array([len(np.intersect1d(left[i], right[j], assume_unique=True)) for i, j in pairs], dtype=np.int64)
    total = n_left[pairs[:, 0]] + n_right[pairs[:, 1]] - both
    return pairs[denominator * both >= numerator * total]


def _verify(numerator: int, denominator: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("rep").reset_index(drop=True)
        sides = [pdf[pdf["block"] == pdf[c].iloc[0]].reset_index(drop=True) for c in ("first_block", "second_block")]
        same = pdf["first_block"].iloc[0] == pdf["second_block"].iloc[0]
        a, b = sides
        out = {"rep": [], "other": [], "links": []}
        if len(a) and len(b):
            sets = [[np.frombuffer(x, dtype=np.uint64) for x in side["shingles"]] for side in sides]
            nodes = [np.stack(side["nodes"].to_list()) for side in sides]
            met = np.zeros((len(a), len(b)), dtype=bool)
            for t in range(nodes[0].shape[1]):
                met |= nodes[0][:, t, None] == nodes[1][None, :, t]
            if same:
                met = np.triu(met, 1)
            pairs = similar_pairs(sets[0], sets[1], np.argwhere(met), numerator, denominator)
            links, other = {}, {}
            reps, copies = [side["rep"].to_numpy() for side in sides], [side["copies"].to_numpy() for side in sides]
            root: dict[int, int] = {}

            def find(x: int) -> int:
                while root.setdefault(x, x) != x:
                    root[x] = x = root[root[x]]
                return x

            for i, j in pairs:
                x, y = int(reps[0][i]), int(reps[1][j])
                links[x] = links.get(x, 0) + int(copies[1][j])
                links[y] = links.get(y, 0) + int(copies[0][i])
                if find(x) != find(y):
                    root[find(x)] = find(y)
            other = {x: find(x) for x in links}
            out = {"rep": list(links), "other": [other[x] for x in links], "links": list(links.values())}
        return pd.DataFrame(out).astype("int64")

    return run


def _classified(keyed: DataFrame, numerator: int, denominator: int, words: int) -> DataFrame:
    """``row``, ``doc_id``, ``class`` (a number, null for texts without words), ``class_id`` and ``n_links`` of ``row``, ``doc_id`` and ``text``; a written table."""
    spark = keyed.sparkSession
    depth = prefix_depth(numerator / denominator)
    keyed = keyed.select("row", "doc_id", F.xxhash64("text").alias("text_hash"), "text")
    schema = "doc_id long, text_hash long, size int, h1 long, h2 long, nodes array<long>"
    row_type = keyed.schema["row"].dataType.simpleString()
    signed = hand_over(keyed.select("doc_id", "text_hash", "text", "row").mapInArrow(_sign(words, TREES, depth), f"{schema}, row {row_type}"), "signatures")
    chosen = F.min(F.struct("doc_id", "text_hash", "nodes"))
    reps = signed.filter("size > 0").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"), chosen.alias("one"))
    reps = hand_over(
        reps.select(F.monotonically_increasing_id().alias("rep"), "h1", "h2", "copies", "first_doc", "one.doc_id", "one.text_hash", "one.nodes"), "representatives"
    )
    sizes = hand_over(signed.select("row", "doc_id", "size", "h1", "h2"), "set-sizes")  # the rest of the signatures is not needed any more
    release_shuffles(spark)
    discard(signed)
    lies = reps.select("rep", F.explode("nodes").alias("node"))
    shared = lies.groupBy("node").agg(F.min("rep").alias("lead"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("node", "lead")
    groups = components(lies.join(shared, "node").filter("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")))
    blocks = groups.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n_blocks"))
    placed = groups.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("id"), F.col("n_blocks")).cast("int"))
    cand = hand_over(
        placed.join(reps, placed["id"] == reps["rep"]).select("rep", "component", "block", "n_blocks", "copies", "nodes", F.col("doc_id").alias("of_doc"), F.col("text_hash").alias("of_text")), "candidates"
    )
    release_shuffles(spark)
    discard(groups)
    texts = keyed.join(cand, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("text_hash") == F.col("of_text")))
    texts = texts.select("rep", "component", "block", "n_blocks", "copies", "nodes", "text")
    with_sets = texts.mapInArrow(_sets(words), "rep long, component long, block int, n_blocks int, copies long, nodes array<long>, shingles binary")
    ends = F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j")))
    spread = with_sets.withColumn("ends", F.explode(ends)).select(
        "component", F.col("ends.i").alias("first_block"), F.col("ends.j").alias("second_block"), "rep", "block", "copies", "nodes", "shingles"
    )
    found = spread.groupBy("component", "first_block", "second_block").applyInPandas(_verify(numerator, denominator), "rep long, other long, links long")
    found = hand_over(found, "links")
    release_shuffles(spark)
    discard(cand)
    classes = components(found.select(F.col("rep").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    judged = reps.select("rep", "h1", "h2", "copies", "first_doc").join(classes.withColumnRenamed("id", "rep"), "rep", "left").join(counts, "rep", "left")
    judged = judged.withColumn("class", F.coalesce("component", "rep"))
    named = hand_over(judged.groupBy("class").agg(F.min("first_doc").alias("class_id")), "class-names")
    judged = judged.join(named, "class").select("h1", "h2", "class", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    joined = sizes.join(judged, ["h1", "h2"], "left")
    alone = F.col("size") == 0
    joined = joined.select(
        "row", "doc_id", "class", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"),
    )
    joined = hand_over(joined, "classified")
    release_shuffles(spark)
    discard(reps, sizes, found, classes, named)
    return joined


def near_duplicates(documents: DataFrame, numerator: int = 4, denominator: int = 5, words: int = WORDS) -> DataFrame:
    """``doc_id``, ``class_id`` (smallest ``doc_id`` of the documents connected by links) and ``n_links`` (other documents whose
    similarity is at least numerator / denominator), a row per document.

    ``documents`` needs ``doc_id`` and ``text``; other columns are ignored. A null text is an empty one; texts without words are
    linked to nothing and have their own id as class. Copies count as links but are never paired. Null ids are no class
    id unless nothing else is there. An empty table gives no rows.
    """
    keyed = documents.select(F.lit(0).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return _classified(keyed, numerator, denominator, words).select("doc_id", "class_id", "n_links")


def one_per_class(documents: DataFrame, numerator: int = 4, denominator: int = 5, words: int = WORDS, plain_reader: bool = False) -> DataFrame:
    """``documents``, same columns, with one row of each class of near duplicates: that of the smallest ``doc_id`` (a null one is the
    smallest), of equal ones any. Texts without words, null ones too, all stay. An empty table gives an empty one. Columns of any name
    come through. A ``plain_reader`` of files is read again, anything else is first written."""
    (row,) = unused_names(documents, 1)
    numbered = with_row_ids(documents, row, plain_reader)
    keyed = numbered.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    classified = _classified(keyed, numerator, denominator, words)
    first = classified.filter("class IS NOT NULL").groupBy("class").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    stays = classified.filter("class IS NULL").select(F.col("row").alias(row)).unionByName(first.select(F.col("first.row").alias(row)))
    stays = hand_over(stays, "first-of-class")
    release_shuffles(documents.sparkSession)
    discard(classified)
    # a row for each row that stays: merged at every size, never broadcast
    return numbered.join(stays.hint("merge"), row, "left_semi").select(*documents.columns)
