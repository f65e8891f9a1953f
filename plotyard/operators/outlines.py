"""District outlines: a concave hull per (city, district), simplified and bounded in area.

Positions are reduced to one per grid cell of ``precision`` degrees before they are grouped. The precision is the same
for every group and well below the simplification tolerance, so a group's outline depends on its own positions alone,
and a group's points are bounded by its area, not by its number of listings.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotyard import fixed_values as fv
from plotyard.functions import geo
from plotyard.functions.predicates import country_clip

PRECISION_DEG = 1e-4  # about 11 m
_SCHEMA = "city string, district string, points long, ring array<struct<lng:double,lat:double>>"


def reduced_points(
    listings: DataFrame, keys: Sequence[str] = ("city", "district"), precision: float = PRECISION_DEG
) -> DataFrame:
    """One real position per occupied grid cell of each group, with the group's listing count."""
    keys = list(keys)
    located = listings.filter(country_clip())
    for key in keys:
        located = located.filter(F.col(key).isNotNull())
    cells = located.groupBy(
        *keys, F.floor(F.col("lng") / precision).alias("gx"), F.floor(F.col("lat") / precision).alias("gy")
    ).agg(F.min(F.struct("lng", "lat")).alias("p"), F.count(F.lit(1)).alias("n"))
    points = cells.groupBy(*keys).agg(F.sum("n").alias("points"))
    return cells.join(points, keys).select(*keys, "points", "p.lng", "p.lat")


def district_outlines(
    listings: DataFrame,
    minimum: int = fv.OUTLINE_MIN_POINTS,
    ratio: float = fv.OUTLINE_RATIO,
    tolerance: float = fv.OUTLINE_SIMPLIFY_DEG,
    max_km2: float = fv.OUTLINE_MAX_KM2,
    precision: float = PRECISION_DEG,
) -> DataFrame:
    """city, district, points, ring (closed, lng/lat), area_km2; degenerate groups have none."""

    def outline(pdf: pd.DataFrame) -> pd.DataFrame:
        ring = concave_ring(pdf[["lng", "lat"]].to_numpy(), ratio)
        if ring is None:
            return pd.DataFrame(columns=["city", "district", "points", "ring"])
        ring = simplify_ring(ring, tolerance)
        first = pdf.iloc[0]
        return pd.DataFrame(
            {
                "city": [first["city"]],
                "district": [first["district"]],
                "points": [first["points"]],
                "ring": [[{"lng": float(x), "lat": float(y)} for x, y in ring]],
            }
        )

    eligible = reduced_points(listings, precision=precision).filter(F.col("points") >= minimum)
    # hulls cost far more than their bytes suggest, so small partitions are not to be merged
    parts = int(listings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = eligible.repartition(parts, "city", "district").groupBy("city", "district")
    hulls = grouped.applyInPandas(outline, _SCHEMA)
    area = geo.ring_area(geo.project_ring(F.col("ring"))) / 1e6
    return hulls.withColumn("area_km2", area).filter(F.col("area_km2") <= max_km2)


# --- helpers for one group -----------------------------------------------------------------


def _triangulate(points: np.ndarray) -> np.ndarray:
    """Delaunay triangles of points in ascending x, by incremental insertion. The circumcircle test of a new point runs
    over all open triangles at once; the cavity it opens is small and is refilled in place. A triangle whose
    circle ends before the new point meets no later one and is set aside, so that the open ones stay along the front."""
    n = len(points)
    span = float(np.ptp(points, axis=0).max()) or 1.0
    mid = points.mean(axis=0)
    outer = mid + span * 1e3 * np.array([[-1.0, -1.0], [1.0, -1.0], [0.0, 1.5]])
    pts = np.vstack([points, outer])
    tris = np.tile(np.array([n, n + 1, n + 2]), (4 * n + 8, 1))
    circles = np.full((len(tris), 3), -1.0)  # a negative radius never contains a point
    circles[:1] = _circumcircles(pts, tris[:1])
    used, limit, closed = 1, 64, []
    for i in range(n):
        if used > limit:
            ends = circles[:used, 0] + np.sqrt(np.maximum(circles[:used, 2], 0.0)) * (1 + 1e-9) + 1e-9
            alive = circles[:used, 2] >= 0
            done = alive & (ends < pts[i, 0])
            closed.append(tris[:used][done])
            still = np.flatnonzero(alive & ~done)
            tris[: len(still)], circles[: len(still)] = tris[still], circles[still]
            used = len(still)
            limit = 2 * used + 64
        dx = circles[:used, 0] - pts[i, 0]
        dy = circles[:used, 1] - pts[i, 1]
        bad = np.flatnonzero(dx * dx + dy * dy < circles[:used, 2] * (1 + 1e-12))
        rim: dict[tuple[int, int], None] = {}
        for x, y, z in tris[bad].tolist():
            for u, v in ((x, y), (y, z), (z, x)):
                key = (u, v) if u < v else (v, u)
                if key in rim:
                    del rim[key]
                else:
                    rim[key] = None
        fresh = np.array([(u, v, i) for u, v in rim])
        grown = max(0, len(fresh) - len(bad))
        if used + grown > len(tris):
            tris = np.vstack([tris, np.tile([n, n + 1, n + 2], (grown + n, 1))])
            circles = np.vstack([circles, np.full((grown + n, 3), -1.0)])
        slots = np.concatenate([bad, np.arange(used, used + grown)])[: len(fresh)]
        circles[bad] = -1.0
        tris[bad] = (n, n + 1, n + 2)
        tris[slots] = fresh
        circles[slots] = _circumcircles(pts, fresh)
        used += grown
    tris = np.vstack([*closed, tris[:used]])
    return tris[(tris < n).all(axis=1)]


def _circumcircles(pts: np.ndarray, tris: np.ndarray) -> np.ndarray:
    """Centre x, y and squared radius per triangle; flat triangles get an unbounded circle."""
    a, b, c = pts[tris[:, 0]], pts[tris[:, 1]], pts[tris[:, 2]]
    b, c = b - a, c - a
    d = 2 * (b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0])
    with np.errstate(divide="ignore", invalid="ignore"):
        b2, c2 = (b**2).sum(axis=1), (c**2).sum(axis=1)
        ux = (c[:, 1] * b2 - b[:, 1] * c2) / d
        uy = (b[:, 0] * c2 - c[:, 0] * b2) / d
    flat = ~np.isfinite(ux) | ~np.isfinite(uy)
    ux, uy = np.where(flat, 0.0, ux), np.where(flat, 0.0, uy)
    r2 = np.where(flat, np.inf, ux**2 + uy**2)
    return np.column_stack([a[:, 0] + ux, a[:, 1] + uy, r2])


def concave_ring(points: np.ndarray, ratio: float) -> np.ndarray | None:
    """Closed outline of the points: border edges longer than ``ratio`` of the range of
    triangulation edge lengths are worn away from outside, longest first, while every point
    stays in and the outline stays one piece. None when the points span no area."""
    unique = np.unique(points, axis=0)
    if len(unique) < 3:
        return None
    scale = float(np.ptp(unique, axis=0).max())
    local = (unique - unique.min(axis=0)) / (scale or 1.0)
    tris = [tuple(int(v) for v in t) for t in _triangulate(local)]
    if not tris:
        return None
    owners: dict[tuple[int, int], set[int]] = {}
    for t, tri in enumerate(tris):
        for edge in _edges(tri):
            owners.setdefault(edge, set()).add(t)
    length = {e: float(np.hypot(*(local[e[0]] - local[e[1]]))) for e in owners}
    limit = min(length.values()) + ratio * (max(length.values()) - min(length.values()))
    border = {e for e, o in owners.items() if len(o) == 1}
    on_border = {v for e in border for v in e}
    queue = [(-length[e], e) for e in border]
    heapq.heapify(queue)
    while queue:
        negative, edge = heapq.heappop(queue)
        if -negative <= limit:
            break
        if edge not in border or len(owners[edge]) != 1:
            continue
        (tri,) = owners[edge]
        inner = [e for e in _edges(tris[tri]) if e != edge]
        (tip,) = set(tris[tri]) - set(edge)
        if any(e in border for e in inner) or tip in on_border:
            continue
        border.discard(edge)
        owners[edge].clear()
        on_border.add(tip)
        for e in inner:
            owners[e].discard(tri)
            border.add(e)
            heapq.heappush(queue, (-length[e], e))
    return _closed_ring(border, unique)


def _edges(tri: tuple[int, int, int]) -> list[tuple[int, int]]:
    a, b, c = tri
    return [tuple(sorted(e)) for e in ((a, b), (b, c), (c, a))]


def _closed_ring(border: set[tuple[int, int]], points: np.ndarray) -> np.ndarray | None:
    """Border edges chained into one closed ring."""
    nexts: dict[int, list[int]] = {}
    for a, b in border:
        nexts.setdefault(a, []).append(b)
        nexts.setdefault(b, []).append(a)
    if any(len(v) != 2 for v in nexts.values()):
        return None
    start = min(nexts)
    ring, previous, current = [start], None, start
    while True:
        step = nexts[current][0] if nexts[current][0] != previous else nexts[current][1]
        if step == start:
            break
        ring.append(step)
        previous, current = current, step
    if len(ring) != len(nexts):
        return None
    return points[[*ring, start]]


def simplify_ring(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker on a closed ring, split at the vertex furthest from the start; the ring is
    returned as it was when simplifying would collapse it or make it cross itself."""
    far = int(((ring - ring[0]) ** 2).sum(axis=1).argmax())
    if far in (0, len(ring) - 1):
        return ring
    head, tail = _simplify_path(ring[: far + 1], tolerance), _simplify_path(ring[far:], tolerance)
    out = np.vstack([head[:-1], tail])
    return ring if len(out) < 4 or _crosses_itself(out) else out


def _simplify_path(path: np.ndarray, tolerance: float) -> np.ndarray:
    keep = np.zeros(len(path), dtype=bool)
    keep[[0, -1]] = True
    spans = [(0, len(path) - 1)]
    while spans:
        lo, hi = spans.pop()
        if hi - lo < 2:
            continue
        a, b, mid = path[lo], path[hi], path[lo + 1 : hi]
        d = b - a
        t = np.clip(((mid - a) @ d) / max(float(d @ d), 1e-300), 0, 1)
        away = np.hypot(*(mid - (a + t[:, None] * d)).T)
        worst = int(away.argmax())
        if away[worst] > tolerance:
            keep[lo + 1 + worst] = True
            spans += [(lo, lo + 1 + worst), (lo + 1 + worst, hi)]
    return path[keep]


def _crosses_itself(ring: np.ndarray) -> bool:
    a, b = ring[:-1], ring[1:]

    def side(p, q, r):
        return (q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (
            r[..., 0] - p[..., 0]
        )

    p, q = a[:, None], b[:, None]
    r, s = a[None], b[None]
    crossing = (side(p, q, r) * side(p, q, s) < 0) & (side(r, s, p) * side(r, s, q) < 0)
    return bool(crossing.any())
