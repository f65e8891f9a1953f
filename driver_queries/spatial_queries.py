"""Amenity distances and counts, district outlines and their shading."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_queries import tables as T
from driver_queries.registry import MERC_X, MERC_Y, WITH_L, WITH_LE, query
from plotyard import fixed_values as fv
from plotyard.functions import geo
from plotyard.operators import districts, outlines, spatial
from plotyard.operators.joins import null_safe_join
from plotyard.plans import marts
from plotyard.session import hand_over

CLIP = "lat BETWEEN 16e0 AND 33e0 AND lng BETWEEN 34e0 AND 56e0"
_CATEGORY = (
    "CASE WHEN fclass LIKE 'muslim%' THEN 'mosque' WHEN fclass IN ('hospital', 'clinic') THEN 'hospital' WHEN fclass IN "
    "('mall', 'department_store') THEN 'mall' WHEN fclass IN ('university', 'college') THEN 'university' END"
)
_FEATURES_SQL = (
    f"f AS MATERIALIZED (SELECT feature_id, kind, {_CATEGORY} AS category, {MERC_X.format('lng - half_lng')} AS x0, "
    f"{MERC_X.format('lng + half_lng')} AS x1, {MERC_Y.format('lat - half_lat')} AS y0, {MERC_Y.format('lat + half_lat')} AS y1 "
    f"FROM ({T.FEATURES}) WHERE fclass <> 'bench')"
)
_POINTS_SQL = f"p AS MATERIALIZED (SELECT *, {MERC_X.format('lng')} AS x, {MERC_Y.format('lat')} AS y FROM l)"
_PAIRS_SQL = (
    "d AS (SELECT p.id, f.category, sqrt(greatest(0, x0 - x, x - x1) ** 2 + greatest(0, y0 - y, y - y1) ** 2) AS d FROM p, f)"
)
_DESCRIBED_SQL = (
    f"{WITH_LE}, {_FEATURES_SQL}, {_POINTS_SQL}, {_PAIRS_SQL}, n AS MATERIALIZED (SELECT id, category, round(min(d), 1) AS distance_m, "
    "CAST(count(*) FILTER (d <= 500) AS INT) AS count_500m, CAST(count(*) FILTER (d <= 1000) AS INT) AS count_1000m, "
    "CAST(count(*) FILTER (d <= 2000) AS INT) AS count_2000m FROM d GROUP BY 1, 2)"
)
_WIDE = ", ".join(
    f"max(distance_m) FILTER (category = '{c}') AS dist_{c}_m, "
    + ", ".join(f"max(count_{r}m) FILTER (category = '{c}') AS count_{c}_{r}m" for r in fv.POI_RADII_M)
    for c in fv.POI_CATEGORY_NAMES
)
_WIDE_SQL = f"{_DESCRIBED_SQL}, w AS MATERIALIZED (SELECT id, {_WIDE} FROM n GROUP BY 1)"


def _selected(spark, sf):
    features = T.features(spark, sf)
    worship = features.filter(F.col("fclass").startswith("muslim"))
    return spatial.category_features(features, worship)


def _index(spark, sf):
    return spatial.build_index(spatial.to_objects(_selected(spark, sf)))


@query("B26_category_features", f"WITH {_FEATURES_SQL} SELECT category, kind, count(*) AS features FROM f GROUP BY 1, 2")
def _(spark, sf):
    return _selected(spark, sf).groupBy("category", "kind").agg(F.count(F.lit(1)).alias("features"))


@query("G2_union_layers", f"WITH {_FEATURES_SQL} SELECT feature_id, category FROM f")
def _(spark, sf):
    return _selected(spark, sf).select("feature_id", "category")


@query(
    "H22_mercator",
    f"{WITH_L} SELECT id, round({MERC_X.format('lng')}, 4) AS x, round({MERC_Y.format('lat')}, 4) AS y FROM l",
)
def _(spark, sf):
    return T.listings(spark, sf).select(
        "id", F.round(geo.mercator_x(F.col("lng")), 4).alias("x"),
        F.round(geo.mercator_y(F.col("lat")), 4).alias("y"),
    )


# Distance of every listing to a rectangle around its own district's corner.
_NEAR_SQUARE = (
    f"{WITH_L}, {_POINTS_SQL}, s AS (SELECT id, x, y, 6378137.0e0 * radians(floor(lng * 20) / 20) AS x0, 6378137.0e0 * radians(floor(lng * 20) "
    "/ 20 + 0.02e0) AS x1, 6378137.0e0 * ln(tan(pi() / 4 + radians(floor(lat * 20) / 20) / 2)) AS y0, 6378137.0e0 * ln(tan(pi() / 4 + "
    "radians(floor(lat * 20) / 20 + 0.02e0) / 2)) AS y1 FROM p)"
)


@query(
    "H23_ring_distance",
    f"{_NEAR_SQUARE} SELECT id, round(sqrt(greatest(0, x0 - x, x - x1) ** 2 + greatest(0, y0 - y, y - y1) ** 2), 3) AS d FROM s",
)
def _(spark, sf):
    corner = T.listings(spark, sf).select(
        "id", "lat", "lng", (F.floor(F.col("lat") * 20) / 20).alias("a"), (F.floor(F.col("lng") * 20) / 20).alias("b")
    )

    def vertex(dx: float, dy: float):
        return F.struct((F.col("b") + dx).alias("lng"), (F.col("a") + dy).alias("lat"))

    ring = F.array(vertex(0, 0), vertex(0.02, 0), vertex(0.02, 0.02), vertex(0, 0.02), vertex(0, 0))
    edges = geo.ring_edges(geo.project_ring(ring))
    distance = geo.edges_distance(
        geo.mercator_x(F.col("lng")), geo.mercator_y(F.col("lat")), edges, F.lit(True)
    )
    return corner.select("id", F.round(distance, 3).alias("d"))


@query("C8_nearest_distance", f"{_DESCRIBED_SQL} SELECT id, category, distance_m FROM n")
def _(spark, sf):
    described = spatial.describe_points(T.listings(spark, sf), _index(spark, sf))
    return described.select("id", "category", "distance_m")


@query("C9_within_radius", f"{_WIDE_SQL} SELECT * FROM w")
def enriched(spark, sf):
    return spatial.enrich_listings(T.listings(spark, sf), _index(spark, sf))


@query(
    "C10_describe_points",
    f"WITH {_FEATURES_SQL}, p AS MATERIALIZED (SELECT c_custkey AS id, {MERC_X.format('36.2e0 + (n_nationkey * 11) % 19 + c_acctbal / 1e5')} "
    f"AS x, {MERC_Y.format('17.1e0 + (n_nationkey * 7) % 15 + c_acctbal / 1e5')} AS y FROM customer JOIN nation ON c_nationkey = n_nationkey), "
    f"{_PAIRS_SQL} SELECT id, category, round(min(d), 1) AS distance_m, CAST(count(*) FILTER (d <= 500) AS INT) AS count_500m, CAST(count(*) "
    "FILTER (d <= 1000) AS INT) AS count_1000m, CAST(count(*) FILTER (d <= 2000) AS INT) AS count_2000m FROM d GROUP BY 1, 2",
)
def _(spark, sf):
    T.load(spark, sf, "customer", "nation")
    dropped = spark.sql(
        "SELECT c_custkey AS id, 17.1e0 + (n_nationkey * 7) % 15 + c_acctbal / 1e5 AS lat, "
        "36.2e0 + (n_nationkey * 11) % 19 + c_acctbal / 1e5 AS lng FROM customer JOIN nation ON c_nationkey = n_nationkey"
    )
    return spatial.describe_points(dropped, _index(spark, sf))


@query("E2_one_row_per_target", f"{_DESCRIBED_SQL} SELECT category, count(*) AS rows, count(DISTINCT id) AS listings FROM n GROUP BY 1")
def _(spark, sf):
    described = spatial.describe_points(T.listings(spark, sf), _index(spark, sf))
    return described.groupBy("category").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("listings")
    )


@query(
    "D32_category_report",
    f"{_DESCRIBED_SQL}, e2(category, m) AS (VALUES ('mosque', 300e0), ('hospital', 1500e0), ('mall', 3000e0), ('university', 5000e0)), "
    "r AS (SELECT category, count(*) AS features FROM f GROUP BY 1), q AS (SELECT category, median(distance_m) AS median_m FROM n GROUP BY 1) "
    "SELECT category, features, round(median_m, 4) AS median_m, round(median_m / m, 3) AS ratio, round(median_m / m, 3) < 3 AS kept FROM r JOIN q "
    "USING (category) JOIN e2 USING (category)",
)
def _(spark, sf):
    described = spatial.describe_points(T.listings(spark, sf), _index(spark, sf))
    report = spatial.category_report(_selected(spark, sf), described, fv.POI_EXPECTED_DISTANCE_M)
    return report.withColumn("median_m", F.round("median_m", 4))


@query(
    "D2_district_distances",
    f"{_WIDE_SQL} SELECT city, district, count(*) AS listing_count, "
    + ", ".join(f"round(sum(dist_{c}_m), 1) AS sum_dist_{c}_m" for c in fv.POI_CATEGORY_NAMES)
    + ", "
    + ", ".join(f"avg(dist_{c}_m) IS NOT NULL AS mean_dist_{c}_fits" for c in fv.POI_CATEGORY_NAMES)
    + ", count(*) >= 10 AS sufficient FROM l JOIN w USING (id) GROUP BY 1, 2",
)
def _(spark, sf):
    listings = T.listings(spark, sf)
    joined = listings.join(spatial.enrich_listings(listings, _index(spark, sf)), "id")
    # the medians, counts and sums read the rows several times; the distances are measured once
    joined = hand_over(joined.select("id", "city", "district", "price", "area", *[f"dist_{c}_m" for c in fv.POI_CATEGORY_NAMES]), "district-distances")
    stats = districts.district_stats(joined)
    sums = [F.round(F.sum(f"dist_{c}_m"), 1).alias(f"sum_dist_{c}_m") for c in fv.POI_CATEGORY_NAMES]
    averages = [F.avg(f"dist_{c}_m").alias(f"avg_{c}") for c in fv.POI_CATEGORY_NAMES]
    totals = joined.groupBy("city", "district").agg(*sums, *averages)
    # a mean carries one decimal, half to even; ties differ between engines, so it must lie within half a decimal
    off = {c: F.abs(F.col(f"mean_dist_{c}_m") - F.col(f"avg_{c}")) for c in fv.POI_CATEGORY_NAMES}
    means = [F.coalesce(off[c] < 0.0500001, F.lit(False)).alias(f"mean_dist_{c}_fits") for c in fv.POI_CATEGORY_NAMES]
    both = null_safe_join(stats, totals, ["city", "district"])
    return both.select("city", "district", "listing_count", "sufficient", *means, *[f"sum_dist_{c}_m" for c in fv.POI_CATEGORY_NAMES])


@query(
    "C1_map_mart_joined",
    f"{_WIDE_SQL} SELECT l.id, l.price, e.estimate, CASE WHEN e.estimate > 0 THEN round((l.price - e.estimate) / e.estimate, 4) END AS "
    f"price_delta_pct FROM l JOIN w ON l.id = w.id LEFT JOIN e ON l.id = e.id WHERE {CLIP}",
)
def _(spark, sf):
    listings = T.listings(spark, sf)
    mart = marts.map_mart(listings, enriched(spark, sf), T.estimates(spark, sf))
    return mart.select("id", "price", "estimate", "price_delta_pct")


@query(
    "B7_details_mart",
    f"{_WIDE_SQL} SELECT l.id, title, beds, livings, wc, area, f_ac, f_yard, w.* EXCLUDE (id) FROM l JOIN w ON l.id = w.id WHERE {CLIP}",
)
def _(spark, sf):
    listings = T.listings(spark, sf).withColumn("rooms", F.col("beds") + F.col("livings"))
    mart = marts.details_mart(listings, enriched(spark, sf))
    amenity = [c for c in mart.columns if c.startswith(("dist_", "count_"))]
    return mart.select("id", "title", "beds", "livings", "wc", "area", "f_ac", "f_yard", *amenity)


# --- outlines ------------------------------------------------------------------------------


@query("L1_outlines")
def _(spark, sf):
    rings = outlines.district_outlines(T.listings(spark, sf))
    return rings.select(
        "city", "district", "points", F.size("ring").alias("vertices"), F.round("area_km2", 3).alias("area_km2")
    )


@query(
    "L1_outline_groups",
    f"{WITH_L} SELECT city, district, count(*) AS points FROM l WHERE {CLIP} AND district IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 10",
)
def _(spark, sf):
    rings = outlines.district_outlines(T.listings(spark, sf), max_km2=float("inf"))
    return rings.select("city", "district", "points")


# With ratio 1 and no tolerance the outline is the convex hull; its extent is that of the points.
@query(
    "L2_outline_extent",
    f"{WITH_L} SELECT city, district, min(lng) AS west, max(lng) AS east, min(lat) AS south, max(lat) AS north FROM l WHERE {CLIP} AND district "
    "IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 10",
)
def _(spark, sf):
    rings = outlines.district_outlines(T.listings(spark, sf), ratio=1.0, tolerance=0.0, max_km2=float("inf"))
    part = {"lng": F.col("ring.lng"), "lat": F.col("ring.lat")}
    return rings.select(
        "city", "district", F.array_min(part["lng"]).alias("west"), F.array_max(part["lng"]).alias("east"),
        F.array_min(part["lat"]).alias("south"), F.array_max(part["lat"]).alias("north"),
    )


def _boxes(spark, sf):
    """Bounding rectangle of every district as its outline."""
    located = T.listings(spark, sf).filter(F.col("district").isNotNull())
    ends = located.groupBy("city", "district").agg(
        F.min("lng").alias("w"), F.max("lng").alias("e"), F.min("lat").alias("s"), F.max("lat").alias("n")
    )

    def vertex(x: str, y: str):
        return F.struct(F.col(x).alias("lng"), F.col(y).alias("lat"))

    ring = F.array(vertex("w", "s"), vertex("e", "s"), vertex("e", "n"), vertex("w", "n"), vertex("w", "s"))
    return ends.select("city", "district", ring.alias("ring"))


_BOX_SQL = (
    f"{WITH_L}, o AS (SELECT city, district, min(lng) AS w, max(lng) AS e, min(lat) AS s, max(lat) AS n FROM l WHERE district IS NOT NULL "
    "GROUP BY 1, 2)"
)


@query(
    "L3_area_ceiling",
    f"{_BOX_SQL}, a AS (SELECT city, district, ({MERC_X.format('e')} - {MERC_X.format('w')}) * ({MERC_Y.format('n')} - {MERC_Y.format('s')}) "
    "/ 1e6 AS area_km2 FROM o) SELECT city, district, round(area_km2, 4) AS area_km2 FROM a WHERE area_km2 <= 300",
)
def _(spark, sf):
    area = geo.ring_area(geo.project_ring(F.col("ring"))) / 1e6
    sized = _boxes(spark, sf).select("city", "district", area.alias("area_km2"))
    kept = sized.filter(F.col("area_km2") <= fv.OUTLINE_MAX_KM2)
    return kept.withColumn("area_km2", F.round("area_km2", 4))


@query(
    "D30_outline_centres",
    f"{_BOX_SQL} SELECT city, district, round((3 * w + 2 * e) / 5, 8) AS lng, round((3 * s + 2 * n) / 5, 8) AS lat FROM o",
)
def _(spark, sf):
    centres = districts.outline_centres(_boxes(spark, sf))
    return centres.select("city", "district", *[F.round(c, 8).alias(c) for c in ("lat", "lng")])


@query(
    "A11_geojson_features",
    f"{_BOX_SQL} SELECT city, district, count(*) OVER () AS features, 5::BIGINT AS vertices, round(w, 5) AS west FROM o",
)
def _(spark, sf):
    from plotyard.sources import io

    features = io.geojson_features(_boxes(spark, sf))
    total = features.agg(F.count(F.lit(1)))
    ring = F.from_json(
        F.get_json_object("value", "$.geometry.coordinates"), "array<array<array<double>>>"
    )[0]
    return features.select(
        "city", "district", total.scalar().alias("features"),
        F.size(ring).cast("long").alias("vertices"), ring[0][0].alias("west"),
    )


_UNIT = "CASE WHEN area > 0 THEN price / area END"


@query(
    "C12_outline_shading",
    f"{_BOX_SQL}, v AS (SELECT city, district, round(median({_UNIT})) AS value FROM l WHERE {CLIP} AND area > 0 AND price > 0 AND district IS "
    "NOT NULL AND estate_type = 'store' AND estate_benefit = 'rental' GROUP BY 1, 2 HAVING count(*) >= 5) SELECT o.city, o.district, value FROM o "
    "LEFT JOIN v ON o.city = v.city AND o.district = v.district",
)
def _(spark, sf):
    from plotyard.operators.viewport import segment
    from plotyard.session import cut_lineage

    prices = cut_lineage(districts.district_prices(T.listings(spark, sf)))
    breaks = segment(districts.national_breaks(prices), "store", "rental")
    shaded = districts.shade_outlines(_boxes(spark, sf), segment(prices, "store", "rental"), breaks)
    return shaded.select("city", "district", "value")
