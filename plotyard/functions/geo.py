"""Planar geometry as Column expressions: projection, box distances, exact ring distances."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotyard.fixed_values import MERCATOR_RADIUS_M


def mercator_x(lng: Column) -> Column:
    return F.lit(MERCATOR_RADIUS_M) * F.radians(lng)


def mercator_y(lat: Column) -> Column:
    return F.lit(MERCATOR_RADIUS_M) * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def project_ring(ring: Column) -> Column:
    """Ring of (lng, lat) structs to a ring of metric (x, y) structs."""
    return F.transform(
        ring, lambda p: F.struct(mercator_x(p["lng"]).alias("x"), mercator_y(p["lat"]).alias("y"))
    )


def hypot(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def box_gap(qx0, qy0, qx1, qy1, x0, y0, x1, y1) -> Column:
    """Smallest distance between two axis-aligned boxes (0 when they touch)."""
    dx = F.greatest(F.lit(0.0), x0 - qx1, qx0 - x1)
    dy = F.greatest(F.lit(0.0), y0 - qy1, qy0 - y1)
    return hypot(dx, dy)


def box_reach(qx0, qy0, qx1, qy1, x0, y0, x1, y1) -> Column:
    """Largest distance between any two points of two axis-aligned boxes."""
    return hypot(F.greatest(x1 - qx0, qx1 - x0), F.greatest(y1 - qy0, qy1 - y0))


def ring_edges(ring: Column) -> Column:
    """Consecutive vertex pairs of a closed ring as (x1, y1, x2, y2) structs."""
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(ring) - 1, F.lit(1))),
        lambda i: F.struct(
            F.element_at(ring, i)["x"].alias("x1"),
            F.element_at(ring, i)["y"].alias("y1"),
            F.element_at(ring, F.least(i + 1, F.size(ring)))["x"].alias("x2"),
            F.element_at(ring, F.least(i + 1, F.size(ring)))["y"].alias("y2"),
        ),
    )


def segment_distance(px: Column, py: Column, e: Column) -> Column:
    """Distance from a point to one edge."""
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    length2 = dx * dx + dy * dy
    t = F.coalesce(
        F.try_divide((px - e["x1"]) * dx + (py - e["y1"]) * dy, length2), F.lit(0.0)
    )
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return hypot(px - (e["x1"] + t * dx), py - (e["y1"] + t * dy))


def inside_edges(px: Column, py: Column, edges: Column) -> Column:
    """Even-odd crossing test over the edges of all rings, so holes count as outside."""

    def crossing(e):
        straddles = (e["y1"] > py) != (e["y2"] > py)
        at_x = e["x1"] + F.try_divide((py - e["y1"]) * (e["x2"] - e["x1"]), e["y2"] - e["y1"])
        return F.when(straddles & (px < at_x), 1).otherwise(0)

    crossings = F.aggregate(edges, F.lit(0), lambda acc, e: acc + crossing(e))
    return crossings % 2 == 1


def edges_distance(px: Column, py: Column, edges: Column, is_area: Column) -> Column:
    """Distance from a point to a geometry given by its edges; 0 inside an area."""
    nearest = F.array_min(F.transform(edges, lambda e: segment_distance(px, py, e)))
    return F.when(is_area & inside_edges(px, py, edges), F.lit(0.0)).otherwise(nearest)


def ring_area(ring: Column) -> Column:
    """Unsigned shoelace area of a closed metric ring."""
    doubled = F.aggregate(
        ring_edges(ring), F.lit(0.0), lambda acc, e: acc + (e["x1"] * e["y2"] - e["x2"] * e["y1"])
    )
    return F.abs(doubled) / 2


def ring_centre(ring: Column) -> Column:
    """Mean of all vertices as given (the closing vertex counts), as a (lng, lat) struct."""

    def mean(part: str) -> Column:
        return F.aggregate(ring, F.lit(0.0), lambda acc, p: acc + p[part]) / F.size(ring)

    return F.when(F.size(ring) > 0, F.struct(mean("lng").alias("lng"), mean("lat").alias("lat")))
