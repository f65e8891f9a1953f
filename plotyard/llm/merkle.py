"""Merkle manifest of a table: a postorder append log of digests per source and one over the sources, and proofs from it.

Each row is a leaf, the rows of a source in order are a tree of ``ARITY``, and the sources' roots in order are the leaves of the top
tree. A log holds the nodes of its tree in the order in which they are completed: a node follows its last child at once, and what is
left open at the end is closed from below. Where a node stands in a log needs no index: how many nodes of each level are complete
after so many leaves is a quotient, so ``log_position`` is a closed form of level, number and leaves.

Builders are aligned: each writes the log of one subtree of ``ARITY ** BAND`` leaves, a row of the log's table, without a look at the others; the
roots of these subtrees are the leaves of the next band of builders, until a tree is done. A row's siblings are read from the
stretches of its builders by position, from the top band down, so what lies above a builder is found once for all its rows.

Ranks within a source come from a range-partitioned sort and the counts of its partitions, so a source of any size is
spread over many tasks, and no task holds more than one builder's leaves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotyard.session import hand_over, release_shuffles

ARITY = 16
BAND = 3  # levels that a builder adds
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TOP = "2"  # key of the tree over the sources; sources have "0" (null) or "1" and their name

SEGMENT = "tree string, block long, n long, leaves int, height int, nodes binary, top binary"
PROOF = "doc_id long, tree string, rank long, leaf string, proof_sha256 string, folded_root string"


def height_of(leaves: int) -> int:
    """Levels above the leaves of a tree."""
    height, nodes = 0, leaves
    while nodes > 1:
        height, nodes = height + 1, -(-nodes // ARITY)
    return height


def log_size(leaves: int, height: int | None = None) -> int:
    return sum(-(-leaves // ARITY**k) for k in range((height_of(leaves) if height is None else height) + 1))


def log_position(level: int, number: int, leaves: int, height: int | None = None) -> int:
    """Where the node ``number`` of ``level`` stands in the log of a tree: the nodes completed before it."""
    height = height_of(leaves) if height is None else height
    end = (number + 1) * ARITY**level  # leaves after which it is complete
    if end <= leaves:
        own = sum(end // ARITY**k for k in range(level + 1))
        return own + sum((end - 1) // ARITY**k for k in range(level + 1, height + 1)) - 1
    # closed at the end: after all complete nodes and the open ones below it
    return sum(leaves // ARITY**k for k in range(height + 1)) + sum(leaves % ARITY**k > 0 for k in range(1, level))


def parent(children: list[bytes]) -> bytes:
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def append_log(leaves: list[bytes], height: int) -> list[bytes]:
    """Nodes of a tree, brought to ``height``, in the order of their completion."""
    log: list[bytes] = []
    waiting: list[list[bytes]] = [[] for _ in range(height + 1)]
    for node in leaves:
        level = 0
        while True:
            log.append(node)
            waiting[level].append(node)
            if level == height or len(waiting[level]) < ARITY:
                break
            node, waiting[level], level = parent(waiting[level]), [], level + 1
    for level in range(height):
        if waiting[level]:
            log.append(parent(waiting[level]))
            waiting[level + 1].append(log[-1])
    return log


class Stretch:
    """One builder's stretch of a log, addressed by position."""

    def __init__(self, nodes: bytes, leaves: int, height: int):
        self.nodes, self.leaves, self.height = nodes, leaves, height
        self._runs: dict[tuple[int, int], list[bytes]] = {}

    def node(self, level: int, number: int) -> bytes:
        at = 32 * log_position(level, number, self.leaves, self.height)
        return self.nodes[at : at + 32]

    def run(self, level: int, number: int) -> list[bytes]:
        """The nodes that share a parent, the ``number``-th such run of ``level``."""
        if (level, number) not in self._runs:
            last = min(ARITY * (number + 1), -(-self.leaves // ARITY**level))
            self._runs[level, number] = [self.node(level, i) for i in range(ARITY * number, last)]
        return self._runs[level, number]

    def path(self, leaf: int) -> bytes:
        """Siblings of a leaf and its ancestors below the stretch's root: per level the own place, the number of siblings, the siblings."""
        out = []
        for level in range(self.height):
            own = leaf // ARITY**level
            run = self.run(level, own // ARITY)
            place = own % ARITY
            out += [bytes([place, len(run) - 1]), *run[:place], *run[place + 1 :]]
        return b"".join(out)


def siblings_of(path: bytes) -> Iterator[tuple[int, list[bytes]]]:
    at = 0
    while at < len(path):
        place, count = path[at], path[at + 1]
        yield place, [path[at + 2 + 32 * i : at + 34 + 32 * i] for i in range(count)]
        at += 2 + 32 * count


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and its siblings give."""
    for place, siblings in siblings_of(path):
        leaf = parent([*siblings[:place], leaf, *siblings[place:]])
    return leaf


@dataclass
class Manifest:
    """Written tables: ``rows`` (``tree``, ``rank``, ``n``, ``digest`` and what was carried), the stretches of each band of the ``sources``' logs
    and of the ``top`` log, ``subroots`` (``tree``, ``rank`` in the top tree, ``subroot``), and the root, null for an empty table."""

    rows: DataFrame
    sources: list[DataFrame]
    top: list[DataFrame]
    subroots: DataFrame
    root: bytes | None
    band: int = BAND

    @property
    def builder_leaves(self) -> int:
        return ARITY**self.band


def leaf_digest(fields: list[Column]) -> Column:
    """Binary SHA-256 of fields: ``-`` for a null, else its length in bytes, ``:`` and the value."""
    text = [f.cast("string") for f in fields]
    return F.unhex(F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256))


def _ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows``, a written table, with ``rank`` among those of the same ``tree`` and their number ``n``."""
    ordered = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    ordered = hand_over(ordered.withColumn("at", F.monotonically_increasing_id()), "ordered-rows")
    part = F.shiftright("at", 33).alias("part")
    counts = ordered.groupBy("tree", part).agg(F.count(F.lit(1)).alias("count"), F.min("at").alias("first"))
    whole = Window.partitionBy("tree")
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition of the sort
    starts = counts.select(
        F.col("tree").alias("of_tree"), F.col("part").alias("of_part"),
        (F.coalesce(F.sum("count").over(earlier), F.lit(0)) - F.col("first")).alias("shift"), F.sum("count").over(whole).alias("n"),
    )
    ranked = ordered.join(starts, (F.col("tree") == F.col("of_tree")) & (F.shiftright("at", 33) == F.col("of_part")))
    return ranked.withColumn("rank", F.col("at") + F.col("shift")).drop("at", "of_tree", "of_part", "shift")


def _build(band: int):
    names = [f.split()[0] for f in SEGMENT.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tree, block, n = (batch.column(k)[i].as_py() for k in range(3))
                leaves = [x["digest"] for x in sorted(batch.column(3)[i].as_py(), key=lambda x: x["rank"])]
                height = min(band, height_of(n))
                log = append_log(leaves, height)
                row = tree, block, n, len(leaves), height, b"".join(log), log[-1]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=names)

    return run


def _write_logs(ranked: DataFrame, band: int) -> tuple[list[DataFrame], DataFrame]:
    """The bands of the logs of all trees in ``ranked`` (``tree``, ``rank``, ``n``, ``digest``), and ``tree`` and ``top``."""
    bands, rows, leaves = [], ranked, ARITY**band
    while True:
        block = F.floor(F.col("rank") / leaves).alias("block")
        gathered = rows.groupBy("tree", block, "n").agg(F.collect_list(F.struct("rank", "digest")).alias("leaves"))
        bands.append(hand_over(gathered.mapInArrow(_build(band), SEGMENT), "log-stretches"))
        above = bands[-1].filter(F.col("n") > leaves)
        if not above.limit(1).count():
            break
        rows = above.select("tree", F.col("block").alias("rank"), F.ceil(F.col("n") / leaves).alias("n"), F.col("top").alias("digest"))
    tops = [b.filter(F.col("n") <= leaves).select("tree", "top") for b in bands]
    whole = tops[0]
    for more in tops[1:]:
        whole = whole.unionByName(more)
    return bands, whole


def build_manifest(
    documents: DataFrame, fields: tuple[str, ...] = FIELDS, source: str = "source", order: str = "doc_id",
    altered: Callable[[Column], dict[str, Column]] | None = None, band: int = BAND,
) -> Manifest:
    """Logs of ``documents``: a leaf per row over ``fields``, a tree per ``source`` with leaves by rising ``order``, a top tree over the sources by
    name, bytewise.

    Nulls come first in either order; a null ``source`` is a source of its own. Rows with equal ``order`` are put in the
    order of their digests, so repeated rows give the same manifest however they are read. Empty texts are values, nulls
    are not. Other columns are ignored. Of an empty table there is no root. ``altered`` gives, from a struct of the row, columns to
    replace in a second digest of each row, ``claim``, for ``prove`` to check; without it the claim is the digest. ``band`` only decides how many
    leaves a builder has.
    """
    spark = documents.sparkSession
    row = documents.select(F.struct(*(F.col(f) for f in dict.fromkeys((*fields, source, order)))).alias("row"))
    changed = altered(F.col("row")) if altered else {}
    name = F.col(f"row.{source}").cast("string")
    leaves = row.select(
        F.coalesce(F.concat(F.lit("1"), name), F.lit("0")).alias("tree"),
        F.col(f"row.{order}").cast("long").alias("doc_id"),
        leaf_digest([F.col(f"row.{f}") for f in fields]).alias("digest"),
        leaf_digest([changed.get(f, F.col(f"row.{f}")) for f in fields]).alias("claim"),
        F.monotonically_increasing_id().alias("number"),
    )
    leaves = hand_over(leaves, "leaves")
    rows = hand_over(_ranked(leaves, ["doc_id", "digest", "number"]).drop("number"), "ranked-leaves")
    release_shuffles(spark)
    sources, tops = _write_logs(rows.select("tree", "rank", "n", "digest"), band)
    subroots = hand_over(tops.select(F.lit(TOP).alias("tree"), F.col("tree").alias("of"), F.col("top").alias("digest")), "subroots")
    subroots = hand_over(_ranked(subroots, ["of"]), "ranked-subroots")
    release_shuffles(spark)
    top, root = _write_logs(subroots.select("tree", "rank", "n", "digest"), band)
    found = root.select("top").first()
    subroots = subroots.select(F.col("of").alias("tree"), "rank", F.col("digest").alias("subroot"))
    return Manifest(rows, sources, top, subroots, bytes(found.top) if found else None, band)


def _descend(builder_leaves: int):
    """Paths of the leaves of stretches: own siblings, then the path of the stretch's root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tree, block, leaves, height, nodes, above = (batch.column(k)[i].as_py() for k in range(6))
                stretch = Stretch(nodes, leaves, height)
                paths = [stretch.path(leaf) + above for leaf in range(leaves)]
                ranks = range(block * builder_leaves, block * builder_leaves + leaves)
                yield pa.RecordBatch.from_arrays([pa.array([tree] * leaves), pa.array(ranks, pa.int64()), pa.array(paths, pa.binary())], names=["tree", "rank", "path"])

    return run


def _paths_down(manifest: Manifest, bands: list[DataFrame], above: DataFrame) -> DataFrame:
    """``tree``, ``block`` and ``path`` of the lowest band's stretches, from ``above``, the path of each tree's root."""
    paths, leaves = None, manifest.builder_leaves
    for k in range(len(bands) - 1, -1, -1):
        whole = bands[k].filter(F.col("n") <= leaves).select("tree", "block").join(above, "tree")
        paths = whole if paths is None else whole.unionByName(paths)
        if k:
            joined = bands[k].join(paths, ["tree", "block"]).select("tree", "block", "leaves", "height", "nodes", "path")
            paths = joined.mapInArrow(_descend(leaves), "tree string, rank long, path binary").withColumnRenamed("rank", "block")
            paths = hand_over(paths, "log-paths")
    return paths


def prove(manifest: Manifest, claims: DataFrame) -> DataFrame:
    """Per claim (``tree``, ``rank``, ``doc_id``, ``claim``): ``doc_id``, ``tree``, ``rank``, ``leaf`` as the log has it, ``proof_sha256`` (of the siblings up to the root)
    and ``folded_root``, what the claimed digest and those siblings give."""
    spark = claims.sparkSession
    nothing = manifest.subroots.select(F.lit(TOP).alias("tree"), F.lit(b"").alias("path")).distinct()
    joined = manifest.top[0].join(_paths_down(manifest, manifest.top, nothing), ["tree", "block"])
    top = joined.select("tree", "block", "leaves", "height", "nodes", "path").mapInArrow(_descend(manifest.builder_leaves), "tree string, rank long, path binary")
    above = hand_over(top.drop("tree").join(manifest.subroots, "rank").select("tree", "path"), "source-paths")
    stretches = manifest.sources[0].join(_paths_down(manifest, manifest.sources, above), ["tree", "block"])
    stretches = hand_over(stretches.select("tree", "block", "leaves", "height", "nodes", "path"), "stretches-with-paths")
    release_shuffles(spark)
    builder_leaves = manifest.builder_leaves
    block = F.floor(F.col("rank") / builder_leaves).alias("block")
    asked = claims.groupBy("tree", block).agg(F.collect_list(F.struct("rank", "doc_id", "claim")).alias("claims"))
    names = [f.split()[0] for f in PROOF.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tree, first, leaves, height, nodes, above, asked = (batch.column(k)[i].as_py() for k in range(7))
                stretch, out = Stretch(nodes, leaves, height), []
                for c in asked:
                    leaf = c["rank"] - first * builder_leaves
                    path = stretch.path(leaf) + above
                    proof = hashlib.sha256("".join(s.hex() for _, siblings in siblings_of(path) for s in siblings).encode()).hexdigest()
                    out.append((c["doc_id"], tree, c["rank"], stretch.node(0, leaf).hex(), proof, fold(c["claim"], path).hex()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    found = stretches.join(asked, ["tree", "block"]).select("tree", "block", "leaves", "height", "nodes", "path", "claims")
    return found.mapInArrow(run, PROOF)


def manifest_proofs(documents: DataFrame, altered: Callable[[Column], dict[str, Column]] | None = None, band: int = BAND) -> DataFrame:
    """Per row of ``documents`` (see ``build_manifest``): ``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` (from the row as ``altered``
    leaves it) and ``verified``, whether that is the root. An empty table gives no rows."""
    manifest = build_manifest(documents, altered=altered, band=band)
    if manifest.root is None:
        return documents.sparkSession.createDataFrame(
            [], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        )
    subroots = manifest.subroots.select("tree", F.lower(F.hex("subroot")).alias("subroot"))
    root = F.lit(manifest.root.hex())
    proofs = prove(manifest, manifest.rows.select("tree", "rank", "doc_id", "claim")).join(subroots, "tree")
    return proofs.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def log_nodes(manifest: Manifest, band: int = 0) -> DataFrame:
    """``tree``, ``position`` in the tree's log and ``digest`` of every node that the builders of a band of the sources' logs completed. A band
    above the lowest also holds the roots given to it, which are in the log once: those are left out here."""
    levels = manifest.band

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tree, block, total, leaves, height, nodes = (batch.column(k)[i].as_py() for k in range(6))
                stretch, found = Stretch(nodes, leaves, height), []
                for level in range(1 if band else 0, height + 1):
                    first = block * ARITY ** (levels - level)
                    for k in range(-(-leaves // ARITY**level)):
                        found.append((log_position(band * levels + level, first + k, total), stretch.node(level, k)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tree] * len(found)), pa.array([p for p, _ in found], pa.int64()), pa.array([d for _, d in found], pa.binary())],
                    names=["tree", "position", "digest"],
                )

    totals = manifest.rows.groupBy("tree").agg(F.max("n").alias("total"))
    stretches = manifest.sources[band].join(totals, "tree").select("tree", "block", "total", "leaves", "height", "nodes")
    return stretches.mapInArrow(run, "tree string, position long, digest binary")
