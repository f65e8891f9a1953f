"""Nearest-feature distances and within-radius counts, to real geometry, at any density.

The features of each category are summarised in a pyramid of grid cells. Every cell knows the
bounding box and the number of the features in it; a cell with at most ``LEAF_ROWS`` distinct
geometries is a leaf. A search then walks down the pyramid as a series of equi-joins:

* the largest distance to a non-empty box bounds the nearest distance from above, and boxes
  further away than that bound are dropped;
* a box entirely within a radius adds its count without being opened; one entirely outside is
  dropped; only boxes cut by the circle are opened.

Listings are answered in query cells, small where listings are dense. The walk is done once per
query cell, its coarse part once per cell of 4,096 m, and ends in the features that a listing of the
cell must be measured to. Listings then meet these by cell, so what is shuffled grows with listings
and cells, never with pairs of a listing and a feature. The result is exact.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotyard.fixed_values import POI_CATEGORIES, POI_CATEGORY_NAMES, POI_RADII_M
from plotyard.functions import geo
from plotyard.session import BROADCAST_MAX_ROWS, cut_lineage, hand_over

LEAF_ROWS = 32
START_BOXES = 256  # boxes per category a walk starts from
_TOP_BITS = 22  # level 0 cells are 2**22 m wide; each level divides the width by 4
_LEVELS = 11
_QUERY_LEVEL = 5  # query cells of 4,096 m share the coarse part of the walk
_FINEST_LEVEL = 8  # query cells are 64 m wide at least
CELL_ROWS = 1_024  # points of a query cell that is not divided further
PART_ROWS = 2_048  # points of a cell of the finest level that are answered together
PAIRS_AT_ONCE = 500_000  # pairs of a point and a feature or edge in one array
_CELL = ("cell_level", "cell_x", "cell_y", "cell_part")
_BOX = ("x0", "y0", "x1", "y1")
_SLACK = 1 + 1e-9


def _size(level: int) -> float:
    return float(2 ** (_TOP_BITS - 2 * level))


# --- feature selection ---------------------------------------------------------------------


def category_features(features: DataFrame, worship: DataFrame) -> DataFrame:
    """Features of every category from the general and the places-of-worship layers.

    Both inputs carry ``fclass, kind, rings`` (and ``feature_id``); rows with missing or empty
    geometry are dropped.
    """
    def labelled(layer: DataFrame, position: int) -> DataFrame:
        matches = [
            F.when(F.col("fclass").isin(*row[position]), F.lit(row[0]))
            for row in POI_CATEGORIES
            if row[position]
        ]
        wanted = sorted({c for row in POI_CATEGORIES for c in row[position]})
        return layer.filter(F.col("fclass").isin(*wanted)).withColumn(
            "category", F.explode(F.array_compact(F.array(*matches)))
        )

    selected = labelled(features, 1).unionByName(labelled(worship, 2), allowMissingColumns=True)
    usable = F.col("rings").isNotNull() & (F.size(F.flatten("rings")) > 0)
    return selected.filter(usable).select("feature_id", "category", "kind", "rings")


def to_objects(features: DataFrame) -> DataFrame:
    """Metric boxes and edges of features given as rings of (lng, lat); points have no edges."""
    metric = features.withColumn("m", F.transform("rings", geo.project_ring))
    area = F.col("kind") != "point"
    vertices = F.flatten("m")
    return metric.select(
        "feature_id",
        "category",
        F.array_min(F.transform(vertices, lambda p: p["x"])).alias("x0"),
        F.array_min(F.transform(vertices, lambda p: p["y"])).alias("y0"),
        F.array_max(F.transform(vertices, lambda p: p["x"])).alias("x1"),
        F.array_max(F.transform(vertices, lambda p: p["y"])).alias("y1"),
        F.when(area, F.flatten(F.transform("m", geo.ring_edges))).alias("edges"),
        area.alias("is_area"),
    )


# --- pyramid -------------------------------------------------------------------------------


@dataclass(frozen=True)
class FeatureIndex:
    nodes: DataFrame
    leaf_objects: DataFrame
    categories: tuple[str, ...]
    start_level: int
    deepest_internal: int
    small: bool

    def offered(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.small else df


def build_index(
    objects: DataFrame,
    categories: Sequence[str] = POI_CATEGORY_NAMES,
    leaf_rows: int = LEAF_ROWS,
) -> FeatureIndex:
    """Pyramid over metric objects. Identical geometries become one row with a weight."""
    unique = cut_lineage(
        objects.groupBy("category", *_BOX, "edges", "is_area").agg(F.count(F.lit(1)).alias("weight"))
    )
    levels = F.explode(F.sequence(F.lit(0), F.lit(_LEVELS - 1)))
    size = F.pow(F.lit(2.0), F.lit(_TOP_BITS) - 2 * F.col("level"))
    placed = (
        unique.withColumn("level", levels)
        .withColumn("cx", F.floor((F.col("x0") + F.col("x1")) / 2 / size))
        .withColumn("cy", F.floor((F.col("y0") + F.col("y1")) / 2 / size))
    )
    cells = placed.groupBy("category", "level", "cx", "cy").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("weight").alias("cnt"),
        F.min("x0").alias("x0"),
        F.min("y0").alias("y0"),
        F.max("x1").alias("x1"),
        F.max("y1").alias("y1"),
    )
    cells = cells.withColumn(
        "internal", (F.col("rows") > leaf_rows) & (F.col("level") < _LEVELS - 1)
    ).withColumns({"pcx": F.shiftright("cx", 2), "pcy": F.shiftright("cy", 2)})
    parents = cells.filter("internal").select(
        "category", (F.col("level") + 1).alias("level"), F.col("cx").alias("pcx"), F.col("cy").alias("pcy")
    )
    below = cells.filter("level > 0").join(parents, ["category", "level", "pcx", "pcy"], "left_semi")
    nodes = cut_lineage(cells.filter("level = 0").unionByName(below))
    leaves = nodes.filter(~F.col("internal")).select("category", "level", "cx", "cy")
    leaf_objects = cut_lineage(
        placed.join(leaves, ["category", "level", "cx", "cy"], "left_semi").select(
            "category", "level", "cx", "cy", *_BOX, "edges", "is_area", "weight"
        )
    )
    # one row per category and level: at most _LEVELS rows per category
    facts = (
        nodes.groupBy("category", "level")
        .agg(
            F.count(F.lit(1)).alias("boxes"),
            F.count_if("internal").alias("internal"),
            F.sum(F.when(~F.col("internal"), F.col("rows")).otherwise(0)).alias("objects"),
        )
        .collect()
    )
    missing = [c for c in categories if c not in {r["category"] for r in facts}]
    if missing:
        raise ValueError(f"no features for categories: {', '.join(missing)}")
    internal = [r["level"] for r in facts if r["internal"]]
    return FeatureIndex(
        nodes=nodes,
        leaf_objects=leaf_objects,
        categories=tuple(categories),
        start_level=_start_level(facts),
        deepest_internal=max(internal, default=-1),
        small=sum(r["boxes"] + r["objects"] for r in facts) <= BROADCAST_MAX_ROWS,
    )


def _start_level(facts) -> int:
    """Deepest level at which no category needs more than START_BOXES boxes to be covered."""
    best = 0
    for level in range(1, _LEVELS):
        boxes: dict[str, int] = {}
        for r in facts:
            if r["level"] <= level:
                whole = r["level"] == level
                boxes[r["category"]] = boxes.get(r["category"], 0) + (
                    r["boxes"] if whole else r["boxes"] - r["internal"]
                )
        if max(boxes.values()) > START_BOXES:
            break
        best = level
    return best


# --- walking down --------------------------------------------------------------------------

_NODE_FIELDS = ("level", "cx", "cy", "internal", *_BOX, "cnt")


def _gap(entry: Column) -> Column:
    return geo.box_gap(*[F.col(f"q{b}") for b in _BOX], *[entry[b] for b in _BOX])


def _reach(entry: Column) -> Column:
    return geo.box_reach(*[F.col(f"q{b}") for b in _BOX], *[entry[b] for b in _BOX])


def _smallest_radius(value: Column, radii: Sequence[int]) -> Column:
    """Smallest radius not below ``value``, or infinity."""
    rule = F.lit(float("inf"))
    for r in sorted(radii, reverse=True):
        rule = F.when(value <= float(r), F.lit(float(r))).otherwise(rule)
    return rule


def _needed(gap: Column, bound: Column, done: Column, radii: Sequence[int]) -> Column:
    """A box matters while it may hold the nearest feature or is cut by a circle."""
    return (gap <= bound * _SLACK) | (_smallest_radius(gap, radii) < done)


def _step(
    state: DataFrame, index: FeatureIndex, ids: list[str], radii: Sequence[int], expand: Column
) -> DataFrame:
    """Open the boxes selected by ``expand``, tighten the bound, count whole boxes, drop the rest."""
    carried = [*ids, *[f"q{b}" for b in _BOX], "category", "bound", *[f"n{r}" for r in radii]]
    rows = state.select(*carried, F.explode_outer("front").alias("e")).withColumn(
        "open", F.coalesce(expand, F.lit(False))
    )
    children = index.nodes.filter("level > 0").select(
        F.col("category").alias("c_category"),
        F.col("pcx"),
        F.col("pcy"),
        *[F.col(f).alias(f"c_{f}") for f in _NODE_FIELDS],
    )
    joined = rows.join(
        index.offered(children),
        F.col("open")
        & (F.col("category") == F.col("c_category"))
        & (F.col("e.level") + 1 == F.col("c_level"))
        & (F.col("e.cx") == F.col("pcx"))
        & (F.col("e.cy") == F.col("pcy")),
        "left",
    )
    child = F.struct(*[F.col(f"c_{f}").alias(f) for f in _NODE_FIELDS], F.col("e.done").alias("done"))
    entry = F.when(F.col("c_level").isNotNull(), child).otherwise(F.col("e"))
    measured = (
        joined.select(*carried, entry.alias("e"))
        .withColumn("gap", _gap(F.col("e")))
        .withColumn("reach", _reach(F.col("e")))
        .withColumn("whole", _smallest_radius(F.col("reach"), radii))
    )
    counted = [
        F.sum(
            F.when(
                (F.lit(float(r)) < F.col("e.done")) & (F.col("reach") <= float(r)), F.col("e.cnt")
            ).otherwise(0)
        ).alias(f"add{r}")
        for r in radii
    ]
    done = F.least(F.col("e.done"), F.col("whole"))
    kept = F.struct(
        *[F.col(f"e.{f}").alias(f) for f in _NODE_FIELDS], done.alias("done"), F.col("gap").alias("gap")
    )
    grouped = measured.groupBy(*carried).agg(
        F.min("reach").alias("best"),
        *counted,
        F.collect_list(
            F.when(_needed(F.col("gap"), F.col("bound"), done, radii), kept)
        ).alias("kept"),
    )
    bound = F.least(F.col("bound"), F.coalesce(F.col("best"), F.col("bound")))
    tightened = grouped.withColumn("bound", bound).withColumns(
        {f"n{r}": F.col(f"n{r}") + F.col(f"add{r}") for r in radii}
    )
    front = F.transform(
        F.filter("kept", lambda e: _needed(e["gap"], F.col("bound"), e["done"], radii)),
        lambda e: F.struct(*[e[f].alias(f) for f in _NODE_FIELDS], e["done"].alias("done")),
    )
    return tightened.select(*carried, front.alias("front"))


def _start(queries: DataFrame, index: FeatureIndex, ids: list[str], radii: Sequence[int]) -> DataFrame:
    """Measure the boxes the walk starts from: one pass for bound and counts, one to keep what
    matters. The boxes are at most START_BOXES per category, so they travel as one small array."""
    roots = index.nodes.filter(
        (F.col("level") == index.start_level)
        | ((F.col("level") < index.start_level) & ~F.col("internal"))
    )
    roots = roots.groupBy("category").agg(
        F.collect_list(F.struct(*[F.col(f) for f in _NODE_FIELDS])).alias("boxes")
    )
    keys = [*ids, *[f"q{b}" for b in _BOX], "category"]
    counts = [f"n{r}" for r in radii]
    each = queries.withColumn(
        "category", F.explode(F.array(*[F.lit(c) for c in index.categories]))
    )
    reach = _reach(F.col("e"))
    measured = (
        each.join(F.broadcast(roots), "category")
        .select(*keys, F.explode("boxes").alias("e"))
        .groupBy(*keys)
        .agg(
            F.min(reach).alias("bound"),
            *[F.sum(F.when(reach <= float(r), F.col("e.cnt")).otherwise(0)).alias(f"n{r}") for r in radii],
        )
    )
    # a cheap test first: it is evaluated for every box, the exact one only for what it leaves
    gap = _gap(F.col("e"))
    near = (
        measured.join(F.broadcast(roots), "category")
        .select(*keys, "bound", *counts, F.explode("boxes").alias("e"))
        .filter(gap <= _search_limit(radii))
        .select(*keys, "bound", *counts, "e", gap.alias("gap"), reach.alias("reach"))
    )
    done = _smallest_radius(F.col("reach"), radii)
    kept = F.struct(*[F.col(f"e.{f}").alias(f) for f in _NODE_FIELDS], done.alias("done"))
    return near.groupBy(*keys, "bound", *counts).agg(
        F.collect_list(F.when(_needed(F.col("gap"), F.col("bound"), done, radii), kept)).alias("front")
    )


def _search_limit(radii: Sequence[int]) -> Column:
    """Nothing further than this can matter: neither nearest nor within a radius."""
    return F.greatest(F.col("bound"), F.lit(float(max(radii)))) * _SLACK


def _query_cells(points: DataFrame) -> DataFrame:
    """One row per query cell: its box and its points.

    A cell of 4,096 m is divided while it holds more than CELL_ROWS points, down to 64 m; what is still
    crowded then, copies of one place for instance, is dealt by id into parts of PART_ROWS points."""
    levels = range(_QUERY_LEVEL, _FINEST_LEVEL + 1)
    fine = _size(_FINEST_LEVEL)
    gridded = points.withColumns(
        {"fx": F.floor(F.col("x") / fine).cast("int"), "fy": F.floor(F.col("y") / fine).cast("int")}
    )
    held = gridded.groupBy("fx", "fy").agg(F.count(F.lit(1)).alias("rows"))
    above = {
        level: [F.shiftright(c, 2 * (_FINEST_LEVEL - level)).alias(f"{c}{level}") for c in ("fx", "fy")]
        for level in levels
    }
    held = held.select("fx", "fy", "rows", *[c for pair in above.values() for c in pair])
    # windows within a cell of 4,096 m: at most 4,096 rows, as the finest cells are counted already
    keys: list[str] = []
    for level in levels:
        keys += [f"fx{level}", f"fy{level}"]
        held = held.withColumn(f"rows{level}", F.sum("rows").over(Window.partitionBy(*keys)))
    level = F.lit(_FINEST_LEVEL)
    cell_x, cell_y, rows = F.col("fx"), F.col("fy"), F.col(f"rows{_FINEST_LEVEL}")
    for coarser in reversed(levels[:-1]):
        whole = F.col(f"rows{coarser}") <= CELL_ROWS
        level = F.when(whole, F.lit(coarser)).otherwise(level)
        cell_x = F.when(whole, F.col(f"fx{coarser}")).otherwise(cell_x)
        cell_y = F.when(whole, F.col(f"fy{coarser}")).otherwise(cell_y)
        rows = F.when(whole, F.col(f"rows{coarser}")).otherwise(rows)
    parts = F.ceil(rows / PART_ROWS).cast("int")
    of_cell = held.select(
        "fx", "fy", level.alias("cell_level"), cell_x.alias("cell_x"), cell_y.alias("cell_y"), parts.alias("parts")
    )
    placed = gridded.join(of_cell, ["fx", "fy"]).select(
        "id", "x", "y", "cell_level", "cell_x", "cell_y",
        F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("cell_part"),
    )
    cells = placed.groupBy(*_CELL).agg(
        F.min("x").alias("qx0"), F.min("y").alias("qy0"), F.max("x").alias("qx1"), F.max("y").alias("qy1"),
        F.collect_list(F.struct("id", "x", "y")).alias("points"),
    )
    return hand_over(cells, "query-cells")


def _located(cells: DataFrame, index: FeatureIndex, radii: Sequence[int]) -> DataFrame:
    """Boxes that matter to each query cell: a coarse walk per cell of 4,096 m, then the fine one."""
    placed = cells.withColumns(
        {q: F.expr(f"shiftright({c}, 2 * (cell_level - {_QUERY_LEVEL}))") for q, c in (("qcx", "cell_x"), ("qcy", "cell_y"))}
    )
    wide = placed.groupBy("qcx", "qcy").agg(
        F.min("qx0").alias("qx0"), F.min("qy0").alias("qy0"), F.max("qx1").alias("qx1"), F.max("qy1").alias("qy1")
    )
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    state = _start(wide.repartition(parts, "qcx", "qcy"), index, ["qcx", "qcy"], radii)
    coarse = F.col("e.internal") & (F.col("e.level") < _QUERY_LEVEL)
    for _ in range(max(0, min(index.deepest_internal + 1, _QUERY_LEVEL) - index.start_level)):
        state = _step(state, index, ["qcx", "qcy"], radii, coarse)
    state = cut_lineage(state)
    rows = state.limit(BROADCAST_MAX_ROWS // 4 + 1).count()
    shared = state.drop(*[f"q{b}" for b in _BOX])
    shared = F.broadcast(shared) if rows <= BROADCAST_MAX_ROWS // 4 else shared
    fine = placed.repartition(parts, *_CELL).join(shared, ["qcx", "qcy"]).drop("qcx", "qcy")
    for _ in range(max(0, index.deepest_internal + 1 - max(_QUERY_LEVEL, index.start_level))):
        fine = _step(fine, index, list(_CELL), radii, F.col("e.internal"))
    return fine


def _candidates(cells: DataFrame, index: FeatureIndex, radii: Sequence[int]) -> DataFrame:
    """Per query cell and category the features that its points must be measured to: those that may be
    nearest to one of them or may lie in a circle and are not counted yet."""
    located = _located(cells, index, radii)
    carried = [*_CELL, *[f"q{b}" for b in _BOX], "category", *[f"n{r}" for r in radii], "bound"]
    boxes = located.select(*carried, F.explode("front").alias("e")).filter(_gap(F.col("e")) <= _search_limit(radii))
    boxes = boxes.select(
        *carried, F.col("e.level").alias("level"), F.col("e.cx").alias("cx"), F.col("e.cy").alias("cy"),
        F.col("e.done").alias("done"),
    )
    opened = boxes.join(index.offered(index.leaf_objects), ["category", "level", "cx", "cy"])
    feature = F.struct(*[F.col(c) for c in (*_BOX, "edges", "is_area", "weight", "done")]).alias("e")
    needed = _needed(_gap(F.col("e")), F.col("bound"), F.col("e.done"), radii)
    # dealt by query cell once: neither the grouping nor the join with the points shuffles it again
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = opened.select(*carried, feature).filter(needed).drop("bound", *[f"q{b}" for b in _BOX])
    return kept.repartition(parts, *_CELL).groupBy(*_CELL, "category").agg(
        *[F.max(f"n{r}").alias(f"n{r}") for r in radii], F.collect_list("e").alias("objects")
    )


def _edge_distances(px: np.ndarray, py: np.ndarray, starts: np.ndarray, edges: Sequence[np.ndarray], area: np.ndarray) -> np.ndarray:
    """Distances of points to geometries given by their edges, whose first ones are at ``starts``; the same
    steps as ``geo.edges_distance``."""
    x1, y1, x2, y2 = edges
    dx, dy = x2 - x1, y2 - y1
    px, py = px[:, None], py[:, None]
    length2 = dx * dx + dy * dy
    t = np.divide((px - x1) * dx + (py - y1) * dy, length2, out=np.zeros((len(px), len(dx))), where=length2 != 0)
    t = np.clip(t, 0.0, 1.0)
    away_x, away_y = px - (x1 + t * dx), py - (y1 + t * dy)
    nearest = np.fmin.reduceat(np.sqrt(away_x * away_x + away_y * away_y), starts, axis=1)
    at_x = x1 + np.divide((py - y1) * dx, dy, out=np.zeros(t.shape), where=dy != 0)
    crossings = np.add.reduceat(((y1 > py) != (y2 > py)) & (px < at_x), starts, axis=1, dtype=np.int64)
    return np.where(area & (crossings % 2 == 1), 0.0, nearest)


def _measure_cells(radii: Sequence[int]):
    """Arrow task: rows of a query cell and a category with its points and features to a row per point."""

    def flat(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
        lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        return column.flatten(), np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))

    def numbers(struct: pa.StructArray, *names: str) -> list[np.ndarray]:
        return [pc.struct_field(struct, [n]).to_numpy(zero_copy_only=False) for n in names]

    def measure(batches):
        for batch in batches:
            points, point_ends = flat(batch.column("points"))
            objects, object_ends = flat(batch.column("objects"))
            edges, edge_ends = flat(pc.struct_field(objects, ["edges"]))
            x, y = numbers(points, "x", "y")
            *boxes, area, weight, done = numbers(objects, *_BOX, "is_area", "weight", "done")
            segments = numbers(edges, "x1", "y1", "x2", "y2")
            before = np.stack([batch.column(f"n{r}").to_numpy(zero_copy_only=False) for r in radii])
            nearest, counts = np.empty(len(x)), np.empty((len(radii), len(x)), np.int64)
            for row in range(batch.num_rows):
                first, last = object_ends[row], object_ends[row + 1]
                x0, y0, x1, y1 = (b[first:last] for b in boxes)
                heavy, limits = weight[first:last], done[first:last]
                ends = edge_ends[first : last + 1]
                edged = np.flatnonzero(np.diff(ends))
                width = max(1, last - first, int(ends[-1] - ends[0]))
                step = max(1, PAIRS_AT_ONCE // width)  # bounds the memory of a crowded cell
                for low in range(point_ends[row], point_ends[row + 1], step):
                    part = slice(low, min(low + step, point_ends[row + 1]))
                    px, py = x[part], y[part]
                    dx = np.maximum(np.maximum(x0 - px[:, None], px[:, None] - x1), 0.0)
                    dy = np.maximum(np.maximum(y0 - py[:, None], py[:, None] - y1), 0.0)
                    d = np.sqrt(dx * dx + dy * dy)
                    if len(edged):
                        d[:, edged] = _edge_distances(
                            px, py, ends[edged] - ends[0], [e[ends[0] : ends[-1]] for e in segments], area[first:last][edged]
                        )
                    nearest[part] = d.min(axis=1)
                    for k, r in enumerate(radii):
                        open_ = np.flatnonzero(limits > r)
                        counts[k, part] = before[k, row] + (d[:, open_] <= r).astype(float) @ heavy[open_].astype(float)
            of_row = np.repeat(np.arange(batch.num_rows), np.diff(point_ends))
            yield pa.RecordBatch.from_arrays(
                [pc.struct_field(points, ["id"]), batch.column("category").take(pa.array(of_row)), pa.array(nearest), *map(pa.array, counts)],
                names=["id", "category", "d", *[f"count_{r}m" for r in radii]],
            )

    return measure


def _described(points: DataFrame, index: FeatureIndex, radii: Sequence[int]) -> DataFrame:
    """A row per point and category, distances not rounded yet. Points and features meet by query cell, and a task measures a cell's
    points to its features, so no row per point and feature is ever made."""
    cells = _query_cells(points)
    met = cells.select(*_CELL, "points").join(_candidates(cells.drop("points"), index, radii), list(_CELL))
    counts = [f"count_{r}m" for r in radii]
    return met.select("category", *[f"n{r}" for r in radii], "points", "objects").mapInArrow(
        _measure_cells(radii),
        T.StructType(
            [points.schema["id"], T.StructField("category", T.StringType()), T.StructField("d", T.DoubleType())]
            + [T.StructField(f"count_{r}m", T.LongType()) for r in radii]
        ),
    )


def describe_points(
    points: DataFrame, index: FeatureIndex, radii: Sequence[int] = POI_RADII_M
) -> DataFrame:
    """Long form: one row per (id, category) with the distance in metres and a count per radius.
    ``points`` carries id, lat, lng; rows of one id count together."""
    return _described(_project(points), index, radii).groupBy("id", "category").agg(
        F.round(F.min("d"), 1).alias("distance_m"),
        *[F.sum(f"count_{r}m").cast("int").alias(f"count_{r}m") for r in radii],
    )


def enrich_listings(
    listings: DataFrame, index: FeatureIndex, radii: Sequence[int] = POI_RADII_M
) -> DataFrame:
    """Wide form: id, then dist_<category>_m and count_<category>_<r>m; rows of one id count together."""
    aggregates = []
    for category in index.categories:
        this = F.col("category") == category
        aggregates.append(F.round(F.min(F.when(this, F.col("d"))), 1).alias(f"dist_{category}_m"))
        aggregates += [F.sum(F.when(this, F.col(f"count_{r}m"))).cast("int").alias(f"count_{category}_{r}m") for r in radii]
    return _described(_project(listings), index, radii).groupBy("id").agg(*aggregates)


def _project(points: DataFrame) -> DataFrame:
    """Metric position per id; rows without a position cannot be measured."""
    return points.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull()).select(
        "id", geo.mercator_x(F.col("lng")).alias("x"), geo.mercator_y(F.col("lat")).alias("y")
    )


def category_report(
    features: DataFrame, described: DataFrame, expected: dict[str, float], keep_ratio: float = 3.0
) -> DataFrame:
    """Per category: feature count, median distance, ratio to a plausible one, keep or drop."""
    from plotyard.operators.quantiles import grouped_quantiles

    counts = features.groupBy("category").agg(F.count(F.lit(1)).alias("features"))
    medians = grouped_quantiles(
        described, ["category"], {"d": (F.col("distance_m"), {"median_m": 0.5})}
    )
    plausible = F.create_map(*[F.lit(v) for pair in expected.items() for v in pair])
    ratio = F.round(F.col("median_m") / plausible[F.col("category")], 3)
    return (
        counts.join(medians, "category")
        .withColumn("ratio", ratio)
        .withColumn("kept", F.col("ratio") < keep_ratio)
    )
