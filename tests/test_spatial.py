import json
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotyard.functions import geo
from plotyard.operators import outlines, spatial
from plotyard.functions.predicates import Near, near_predicate
from plotyard.sources import io

R = 6378137.0


def _xy(lat, lng):
    return R * math.radians(lng), R * math.log(math.tan(math.pi / 4 + math.radians(lat) / 2))


def _features(rng, n):
    """Points and triangles, clustered so that some cells are crowded and copies occur."""
    rows = []
    for i in range(n):
        lat, lng = (24.7 + rng.gauss(0, 0.01), 46.7 + rng.gauss(0, 0.01)) if i % 3 else (
            rng.uniform(17, 32), rng.uniform(35, 55))
        cat = ("mosque", "hospital", "mall", "university")[i % 4]
        if i % 5 == 0:
            ring = [(lng, lat), (lng + 0.01, lat), (lng, lat + 0.008), (lng, lat)]
            rows.append((i, cat, "area", [[{"lng": a, "lat": b} for a, b in ring]]))
        else:
            rows.append((i, cat, "point", [[{"lng": lng, "lat": lat}]]))
            rows.append((i + 10_000, cat, "point", [[{"lng": lng, "lat": lat}]]))
    return rows


def _distance(px, py, ring):
    pts = [_xy(p["lat"], p["lng"]) for p in ring]
    if len(pts) == 1:
        return math.hypot(px - pts[0][0], py - pts[0][1])
    inside, best = False, math.inf
    for (x1, y1), (x2, y2) in zip(pts, pts[1:]):
        dx, dy = x2 - x1, y2 - y1
        t = max(0.0, min(1.0, ((px - x1) * dx + (py - y1) * dy) / (dx * dx + dy * dy)))
        best = min(best, math.hypot(px - x1 - t * dx, py - y1 - t * dy))
        if (y1 > py) != (y2 > py) and px < x1 + (py - y1) * (x2 - x1) / (y2 - y1):
            inside = not inside
    return 0.0 if inside else best


@pytest.mark.parametrize("leaf_rows", [2, 32])
def test_nearest_and_counts_equal_brute_force(spark, leaf_rows):
    rng = random.Random(3)
    rows = _features(rng, 240)
    points = [(i, 24.7 + rng.gauss(0, 0.02), 46.7 + rng.gauss(0, 0.02)) for i in range(60)]
    points += [(100 + i, rng.uniform(16, 33), rng.uniform(34, 56)) for i in range(40)]
    features = spark.createDataFrame(
        rows, "feature_id long, category string, kind string, rings array<array<struct<lng:double,lat:double>>>"
    )
    index = spatial.build_index(spatial.to_objects(features), leaf_rows=leaf_rows)
    df = spark.createDataFrame(points, "id long, lat double, lng double")
    got = {(r["id"], r["category"]): r for r in spatial.describe_points(df, index).collect()}
    assert len(got) == len(points) * 4
    for pid, lat, lng in points:
        px, py = _xy(lat, lng)
        for cat in index.categories:
            ds = [_distance(px, py, r[3][0]) for r in rows if r[1] == cat]
            row = got[(pid, cat)]
            assert row["distance_m"] == pytest.approx(min(ds), abs=0.051)
            assert [row[f"count_{r}m"] for r in (500, 1000, 2000)] == [
                sum(d <= r for d in ds) for r in (500, 1000, 2000)
            ]
    wide = spatial.enrich_listings(df, index).filter("id = 0").first()
    assert wide["dist_mall_m"] == got[(0, "mall")]["distance_m"]
    assert wide["count_mall_2000m"] == got[(0, "mall")]["count_2000m"]


def test_empty_category_is_an_error(spark):
    features = spark.createDataFrame(
        [(1, "mosque", "point", [[{"lng": 46.0, "lat": 24.0}]])],
        "feature_id long, category string, kind string, rings array<array<struct<lng:double,lat:double>>>",
    )
    with pytest.raises(ValueError, match="hospital"):
        spatial.build_index(spatial.to_objects(features))


@pytest.mark.parametrize("x, y, want", [(5.0, 5.0, 0.0), (5.0, -3.0, 3.0), (13.0, 14.0, 5.0)])
def test_polygon_inside_edge_vertex(spark, x, y, want):
    ring = [{"x": a, "y": b} for a, b in ((0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0))]
    df = spark.createDataFrame([(x, y, ring)], "x double, y double, ring array<struct<x:double,y:double>>")
    d = geo.edges_distance(F.col("x"), F.col("y"), geo.ring_edges(F.col("ring")), F.lit(True))
    assert df.select(d).first()[0] == pytest.approx(want)
    assert df.select(geo.ring_area(F.col("ring"))).first()[0] == pytest.approx(100.0)


@pytest.mark.parametrize("radius", [1, 3, 5, 10, 20])
def test_near_circle_is_inclusive(spark, radius):
    km = 111.19492664455873
    rows = [(1, 24.0 + radius * 0.999 / km, 46.0), (2, 24.0 + radius * 1.001 / km, 46.0)]
    df = spark.createDataFrame(rows, "id long, lat double, lng double")
    assert [r["id"] for r in df.filter(near_predicate(Near(24.0, 46.0, radius))).collect()] == [1]


def _area(ring):
    x, y = ring[:, 0], ring[:, 1]
    return abs(np.dot(x[:-1], y[1:]) - np.dot(x[1:], y[:-1])) / 2


def test_hull_contains_all_points_and_tightens_with_the_ratio():
    rng = np.random.default_rng(5)
    cloud = rng.uniform(0, 1, (300, 2))
    cloud = cloud[(cloud[:, 0] < 0.3) | (cloud[:, 1] < 0.3)]  # an L, so the concave hull is smaller
    convex = outlines.concave_ring(cloud, 1.0)
    tight = outlines.concave_ring(cloud, 0.4)
    assert 0 < _area(tight) < 0.9 * _area(convex)
    for x, y in cloud:
        on_edge = min(
            np.hypot(x - a[0], y - a[1]) for a in tight[:-1]
        ) < 1e-12
        crossings = sum(
            (a[1] > y) != (b[1] > y) and x < a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1])
            for a, b in zip(tight, tight[1:])
        )
        assert on_edge or crossings % 2 == 1


def test_degenerate_groups_have_no_outline():
    line = np.column_stack([np.linspace(0, 1, 20), np.linspace(0, 1, 20)])
    assert outlines.concave_ring(line, 0.4) is None
    assert outlines.concave_ring(line[:2], 0.4) is None


def test_a_far_listing_costs_a_dense_district_nothing(spark):
    rng = random.Random(1)
    rows = [("c", "d", 24 + rng.random() * 0.05, 46 + rng.random() * 0.05) for _ in range(5000)]
    schema = "city string, district string, lat double, lng double"
    positions = lambda rs: {(r.lat, r.lng) for r in outlines.reduced_points(spark.createDataFrame(rs, schema)).collect()}
    dense, with_far = positions(rows), positions([*rows, ("c", "d", 26.0, 46.0)])
    assert len(dense) > 4800 and with_far == dense | {(26.0, 46.0)}


GEOMETRIES = {
    "point": {"type": "Point", "coordinates": [46.0, 24.0]},
    "points": {"type": "MultiPoint", "coordinates": [[46.0, 24.0], [46.2, 24.1]]},
    "line": {"type": "LineString", "coordinates": [[46.0, 24.0], [46.1, 24.05], [46.1, 24.2]]},
    "lines": {"type": "MultiLineString", "coordinates": [[[46.0, 24.0], [46.1, 24.0]], [[46.3, 24.3], [46.3, 24.2]]]},
    "ring_line": {"type": "LineString", "coordinates": [[46.0, 24.0], [46.2, 24.0], [46.2, 24.2], [46.0, 24.2], [46.0, 24.0]]},
    "area": {"type": "Polygon", "coordinates": [[[46.0, 24.0], [46.2, 24.0], [46.2, 24.2], [46.0, 24.2], [46.0, 24.0]], [[46.08, 24.08], [46.12, 24.08], [46.12, 24.12], [46.08, 24.08]]]},
    "areas": {"type": "MultiPolygon", "coordinates": [[[[46.0, 24.0], [46.1, 24.0], [46.1, 24.1], [46.0, 24.0]]], [[[46.3, 24.0], [46.4, 24.0], [46.4, 24.1], [46.3, 24.0]]]]},
}
GEOMETRIES["mixed"] = {"type": "GeometryCollection", "geometries": [GEOMETRIES["line"], {"type": "GeometryCollection", "geometries": [GEOMETRIES["areas"], GEOMETRIES["points"]]}]}


def _flat_distance(px, py, geometry):
    """Plain Python, on projected metres."""
    project = lambda p: (math.radians(p[0]) * 6378137.0, 6378137.0 * math.log(math.tan(math.pi / 4 + math.radians(p[1]) / 2)))

    def segment(a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        t = 0.0 if dx == dy == 0 else max(0.0, min(1.0, ((px - a[0]) * dx + (py - a[1]) * dy) / (dx * dx + dy * dy)))
        return math.hypot(px - a[0] - t * dx, py - a[1] - t * dy)

    def path(points):
        points = [project(p) for p in points]
        return min(segment(a, b) for a, b in zip(points, points[1:] or points))

    def polygon(rings):
        inside = False
        for r in rings:
            points = [project(p) for p in r]
            for (x1, y1), (x2, y2) in zip(points, points[1:]):
                if (y1 > py) != (y2 > py) and px < x1 + (py - y1) * (x2 - x1) / (y2 - y1):
                    inside = not inside
        return 0.0 if inside else min(path(r) for r in rings)

    kind, c = geometry["type"], geometry.get("coordinates")
    if kind == "GeometryCollection":
        return min(_flat_distance(px, py, g) for g in geometry["geometries"])
    one = {"Point": lambda: path([c]), "MultiPoint": lambda: min(path([p]) for p in c), "LineString": lambda: path(c),
           "MultiLineString": lambda: min(map(path, c)), "Polygon": lambda: polygon(c), "MultiPolygon": lambda: min(map(polygon, c))}
    return one[kind]()


def test_geometries_of_every_kind_have_their_distances(spark, tmp_path):
    (tmp_path / "layer").mkdir()
    (tmp_path / "layer" / "a.json").write_text("\n".join(json.dumps({"type": "Feature", "properties": {"fclass": n}, "geometry": g}) for n, g in GEOMETRIES.items()))
    features = io.read_features(spark, {"l": str(tmp_path / "layer")})
    kinds = {r["fclass"]: r["kind"] for r in features.collect()}
    assert kinds == {"point": "point", "points": "area", "line": "line", "lines": "line", "ring_line": "line", "area": "area", "areas": "area", "mixed": "area"}
    objects = spatial.to_objects(features.withColumn("category", F.col("fclass")))
    places = [(46.05, 24.03), (46.1, 24.1), (46.11, 24.09), (46.0, 24.0), (46.35, 24.02), (47.0, 25.0), (46.15, 24.15)]
    asked = spark.createDataFrame(places, "lng double, lat double").select("lng", "lat", geo.mercator_x(F.col("lng")).alias("px"), geo.mercator_y(F.col("lat")).alias("py"))
    px, py = F.col("px"), F.col("py")
    far = F.when(F.col("edges").isNull(), geo.hypot(px - F.col("x0"), py - F.col("y0"))).otherwise(geo.edges_distance(px, py, F.col("edges"), F.col("is_area")))
    rows = asked.join(objects, F.lit(True)).select("category", "px", "py", far.alias("d")).collect()
    assert len(rows) == len(places) * len(GEOMETRIES)
    for r in rows:
        assert r["d"] == pytest.approx(_flat_distance(r["px"], r["py"], GEOMETRIES[r["category"]]), abs=1e-6), r["category"]


def test_unknown_geometries_are_counted_and_refused(spark, tmp_path):
    lines = [{"type": "Curve", "coordinates": []}, {"type": "GeometryCollection", "geometries": [{"type": "Curve"}, GEOMETRIES["point"]]}, None, GEOMETRIES["point"]]
    (tmp_path / "a.json").write_text("\n".join(json.dumps({"properties": {"fclass": "x"}, "geometry": g}) for g in lines))
    with pytest.raises(io.GuardError, match="2 x Curve in l"):
        io.read_features(spark, {"l": str(tmp_path / "a.json")})
    kept = io.read_features(spark, {"l": str(tmp_path / "a.json")}, refuse_unknown=False).collect()
    assert [r["rings"] is not None for r in kept] == [False, False, False, True]


def test_crowded_cells_and_copies_equal_brute_force(spark, monkeypatch):
    """Cells divided to the finest, one place held by many listings, and listings far from every feature."""
    monkeypatch.setattr(spatial, "CELL_ROWS", 4)
    monkeypatch.setattr(spatial, "PART_ROWS", 8)
    monkeypatch.setattr(spatial, "PAIRS_AT_ONCE", 50)
    rng = random.Random(11)
    rows = _features(rng, 400)
    points = [(i, 24.7, 46.7) for i in range(60)]
    points += [(100 + i, 24.7 + rng.gauss(0, 0.003), 46.7 + rng.gauss(0, 0.003)) for i in range(60)]
    points += [(200 + i, rng.uniform(16, 33), rng.uniform(34, 56)) for i in range(10)]
    features = spark.createDataFrame(
        rows, "feature_id long, category string, kind string, rings array<array<struct<lng:double,lat:double>>>"
    )
    index = spatial.build_index(spatial.to_objects(features))
    df = spark.createDataFrame(points, "id long, lat double, lng double")
    got = {(r["id"], r["category"]): r for r in spatial.describe_points(df, index).collect()}
    assert len(got) == len(points) * 4
    for pid, lat, lng in points:
        px, py = _xy(lat, lng)
        for cat in index.categories:
            ds = [_distance(px, py, r[3][0]) for r in rows if r[1] == cat]
            assert got[(pid, cat)]["distance_m"] == pytest.approx(min(ds), abs=0.051)
            assert [got[(pid, cat)][f"count_{r}m"] for r in (500, 1000, 2000)] == [
                sum(d <= r for d in ds) for r in (500, 1000, 2000)
            ]


def test_no_row_per_listing_and_feature_is_planned(spark):
    """Listings meet features by query cell; what is made per pair would grow with their product."""
    rows = _features(random.Random(2), 80)
    features = spark.createDataFrame(
        rows, "feature_id long, category string, kind string, rings array<array<struct<lng:double,lat:double>>>"
    )
    index = spatial.build_index(spatial.to_objects(features))
    df = spark.createDataFrame([(1, 24.7, 46.7)], "id long, lat double, lng double")
    plan = spatial.describe_points(df, index)._jdf.queryExecution().optimizedPlan().toString()
    after = plan[: plan.index("MapInArrow")]
    assert "Generate" not in after and "Join" not in after


def test_a_point_is_tested_against_open_triangles_only(monkeypatch):
    points = np.unique(np.random.default_rng(4).uniform(0, 1, (2000, 2)), axis=0)
    tested = []
    found = np.flatnonzero
    monkeypatch.setattr(outlines.np, "flatnonzero", lambda a: tested.append(a.size) or found(a))
    tris = outlines._triangulate(points)
    assert sum(tested) < 600 * len(points)  # all triangles so far would be about 2,000 a point
    hull = outlines._closed_ring(
        {e for e, n in Counter(e for t in tris for e in outlines._edges(tuple(int(v) for v in t))).items() if n == 1}, points
    )
    assert len(tris) == 2 * len(points) - 2 - (len(hull) - 1)  # Euler's count of a whole triangulation


def test_district_distances_are_measured_once(spark):
    """Medians, means and sums read written rows; the plan that makes them has no spatial step of its own."""
    import os

    import __spark_entry__ as entry_module

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("driver tables are not here")
    found = entry_module.queries()["D2_district_distances"](spark, folder)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "parquet" in plan
    assert found.count() > 20
