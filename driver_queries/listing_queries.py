"""Predicates, projections, joins, aggregations, sorts and set operations on listings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from driver_queries import tables as T
from driver_queries.registry import WITH_L, WITH_LE, query
from plotyard import fixed_values as fv
from plotyard.functions import labels, predicates, pricing
from plotyard.functions.predicates import Bounds, Filters, Near
from plotyard.operators import districts, joins, prepare, profile, sampling, searches, viewport
from plotyard.plans import marts
from plotyard.session import cut_lineage, scratch_path
from plotyard.sources import io

BOX = Bounds(south=18.0, west=37.0, north=27.5, east=48.0)
BOX_SQL = "lat BETWEEN 18.0e0 AND 27.5e0 AND lng BETWEEN 37.0e0 AND 48.0e0"
FILTERS = Filters(
    purpose="sell", estate_types=("villa", "apartment"), price_min=300000.0, price_max=4500000.0,
    area_min=100.0, area_max=900.0, min_beds=2.0,
)
FILTERS_SQL = (
    "estate_benefit = 'sell' AND estate_type IN ('villa', 'apartment') AND price >= 300000e0 "
    "AND price <= 4500000e0 AND area >= 100e0 AND area <= 900e0 AND beds >= 2"
)
NEAR = Near(lat=24.05, lng=47.1, radius_km=20.0)
_KM = "111.19492664455873e0"
_KMLNG = f"({_KM} * cos(radians(24.05e0)))"
NEAR_SQL = (
    f"lat BETWEEN 24.05e0 - 20e0 / {_KM} AND 24.05e0 + 20e0 / {_KM} "
    f"AND lng BETWEEN 47.1e0 - 20e0 / {_KMLNG} AND 47.1e0 + 20e0 / {_KMLNG} "
    f"AND ((lng - 47.1e0) * {_KMLNG}) * ((lng - 47.1e0) * {_KMLNG}) "
    f"+ ((lat - 24.05e0) * {_KM}) * ((lat - 24.05e0) * {_KM}) <= 400e0"
)
CLIP = "lat BETWEEN 16e0 AND 33e0 AND lng BETWEEN 34e0 AND 56e0"
UNIT = "CASE WHEN area > 0 THEN price / area END"


def _map(spark, sf):
    """Map mart rows without the amenity join."""
    listings, estimates = T.listings(spark, sf), T.estimates(spark, sf)
    joined = listings.join(estimates, "id", "left")
    return joined.withColumn("price_delta_pct", pricing.price_delta(F.col("price"), F.col("estimate")))


_MAP_SQL = (
    f"{WITH_LE}, m AS (SELECT l.*, e.estimate, e.estimate_low, e.estimate_high, "
    "CASE WHEN e.estimate > 0 THEN round((l.price - e.estimate) / e.estimate, 4) END AS price_delta_pct "
    "FROM l LEFT JOIN e ON l.id = e.id)"
)

# --- B: projections, filters, predicates -----------------------------------------------------


@query("B1_country_clip", f"{WITH_L} SELECT id, lat, lng FROM l WHERE {CLIP}")
def _(spark, sf):
    return T.listings(spark, sf).filter(predicates.country_clip()).select("id", "lat", "lng")


@query("B2_bounds", f"{WITH_L} SELECT id FROM l WHERE {BOX_SQL}")
def _(spark, sf):
    return T.listings(spark, sf).filter(predicates.bounds_predicate(BOX)).select("id")


@query("B3_listing_predicate", f"{WITH_L} SELECT id, price, area, beds FROM l WHERE {FILTERS_SQL}")
def _(spark, sf):
    return (
        T.listings(spark, sf)
        .filter(predicates.listing_predicate(FILTERS))
        .select("id", "price", "area", "beds")
    )


@query("B4_near", f"{WITH_L} SELECT id, lat, lng FROM l WHERE {NEAR_SQL}")
def _(spark, sf):
    return (
        T.listings(spark, sf).filter(predicates.near_predicate(NEAR)).select("id", "lat", "lng")
    )


@query("B5_non_finite_ignored", f"{WITH_L} SELECT id FROM l WHERE price >= 1000000e0")
def _(spark, sf):
    odd = Filters(price_min=1000000.0, price_max=float("nan"), area_max=float("inf"))
    return T.listings(spark, sf).filter(predicates.listing_predicate(odd)).select("id")


@query(
    "B6_slim_map",
    f"{WITH_L} SELECT id, CAST(lat AS FLOAT) AS lat, CAST(lng AS FLOAT) AS lng, price, area, "
    "CAST(beds AS SMALLINT) AS beds, estate_type, estate_benefit, city, district, last_update FROM l",
)
def _(spark, sf):
    return prepare.slim_map(T.listings(spark, sf))


@query("B7_all_but_id", "SELECT * EXCLUDE (o_orderkey) FROM orders")
def _(spark, sf):
    T.load(spark, sf, "orders")
    return spark.table("orders").drop("o_orderkey")


@query("B8_drop_columns", f"{WITH_L} SELECT id, price, area FROM l")
def _(spark, sf):
    listings = T.listings(spark, sf)
    return prepare.drop_columns(listings, [c for c in listings.columns if c not in ("id", "price", "area")])


@query(
    "B9_rename_for_model",
    f"{WITH_L} SELECT id, wc AS bathrooms, livings AS living_rooms, beds AS bedrooms, area AS area_m2, "
    "f_ac AS has_ac, f_near_masjid AS near_masjid FROM l",
)
def _(spark, sf):
    listings = T.listings(spark, sf).select("id", "wc", "livings", "beds", "area", "f_ac", "f_near_masjid")
    return prepare.rename_for_model(listings)


@query(
    "B10_bool_to_byte",
    f"{WITH_L} SELECT id, CAST(area > 500 AS TINYINT) AS big, CAST(beds IS NULL AS TINYINT) AS unknown FROM l",
)
def _(spark, sf):
    flagged = T.listings(spark, sf).select(
        "id", (F.col("area") > 500).alias("big"), F.col("beds").isNull().alias("unknown")
    )
    return prepare.flags_to_bytes(flagged)


@query("B11_price_delta", f"{_MAP_SQL} SELECT id, price_delta_pct FROM m")
def _(spark, sf):
    return _map(spark, sf).select("id", "price_delta_pct")


_SALE = (
    "estate_benefit = 'sell' AND estate_type IN ('apartment','building','esterahah','farm','floor',"
    "'house','land','store','villa') AND price > 0 AND area > 0"
)
_BOUNDS = (
    "CASE WHEN estate_type = 'land' THEN price >= 1000 AND price / CASE WHEN area > 0 THEN area END "
    "BETWEEN 10e0 AND 20000e0 ELSE price BETWEEN 50000e0 AND 50000000e0 END"
)


@query("B12_sale_selection", f"{WITH_L} SELECT id, estate_type FROM l WHERE {_SALE}")
def _(spark, sf):
    return T.listings(spark, sf).filter(pricing.sale_selection()).select("id", "estate_type")


@query(
    "B13_market_split",
    f"{WITH_L} SELECT id, CASE WHEN estate_type = 'land' THEN 'land' ELSE 'built' END AS market "
    f"FROM l WHERE {_SALE} AND {_BOUNDS}",
)
def _(spark, sf):
    return (
        T.listings(spark, sf)
        .filter(pricing.sale_selection() & pricing.in_market_bounds())
        .select("id", pricing.market_for(F.col("estate_type")).alias("market"))
    )


@query(
    "B14_market_for",
    f"{WITH_L} SELECT estate_type, CASE WHEN estate_type = 'land' THEN 'land' ELSE 'built' END AS market, "
    "count(*) AS n FROM l GROUP BY 1, 2",
)
def _(spark, sf):
    market = pricing.market_for(F.col("estate_type")).alias("market")
    return T.listings(spark, sf).groupBy("estate_type", market).agg(F.count(F.lit(1)).alias("n"))


@query(
    "B15_point_lookups",
    f"{_MAP_SQL} SELECT id, lat, lng, price, area, beds, estate_type, estate_benefit, city, district, "
    "estimate, estimate_low, estimate_high, price_delta_pct FROM m WHERE id = (SELECT max(id) FROM l)",
)
def _(spark, sf):
    newest = T.listings(spark, sf).agg(F.max("id")).first()[0]
    return viewport.listing_by_id(_map(spark, sf), newest)


_TOP_PLACE = "SELECT city, district FROM l WHERE id = (SELECT max(id) FROM l WHERE district IS NOT NULL)"


def _top_place(spark, sf):
    """City, district, type and purpose of the newest listing with a district."""
    placed = T.listings(spark, sf).filter("district IS NOT NULL")
    return placed.agg(F.max_by(F.struct("city", "district", "estate_type", "estate_benefit"), "id").alias("p")).first()["p"]


@query(
    "B15_detail_lookup",
    f"{WITH_L} SELECT id, title, content, beds, livings, wc, area, street_width, age, furnished FROM l WHERE id = (SELECT max(id) FROM l)",
)
def _(spark, sf):
    target, listings = scratch_path(spark, "details"), T.listings(spark, sf)
    columns = ["id", "title", "content", "beds", "livings", "wc", "area", "street_width", "age", "furnished"]
    io.write_mart(io.cluster_by_id(listings.select(columns), 8), target, fv.DETAILS_ROW_GROUP_ROWS, lookup=("id",))
    return viewport.detail_by_id(spark.read.parquet(target), listings.agg(F.max("id")).first()[0])


@query(
    "B15_district_lookup",
    f"{WITH_L} SELECT city, district, listings FROM (SELECT city, district, count(*) AS listings FROM l GROUP BY 1, 2) JOIN ({_TOP_PLACE}) USING (city, district)",
)
def _(spark, sf):
    target, place = scratch_path(spark, "district-counts"), _top_place(spark, sf)
    counts = T.listings(spark, sf).groupBy("city", "district").agg(F.count(F.lit(1)).alias("listings"))
    io.write_mart(counts, target, lookup=("district",))
    return viewport.district(spark.read.parquet(target), place["city"], place["district"])


@query(
    "B15_comparable_lookup",
    f"{WITH_L}, t AS (SELECT city, district, estate_type, estate_benefit FROM l WHERE id = (SELECT max(id) FROM l WHERE district IS NOT NULL)) "
    "SELECT city, district, estate_type, estate_benefit, count(*) AS listings, round(max(price), 2) AS highest FROM l "
    "JOIN t USING (city, district, estate_type, estate_benefit) GROUP BY ALL",
)
def _(spark, sf):
    target, place = scratch_path(spark, "segment-counts"), _top_place(spark, sf)
    segments = T.listings(spark, sf).groupBy("city", "district", "estate_type", "estate_benefit")
    io.write_mart(segments.agg(F.count(F.lit(1)).alias("listings"), F.round(F.max("price"), 2).alias("highest")), target, lookup=("district",))
    return viewport.comparable(spark.read.parquet(target), *place)


@query(
    "B16_street_width_sentinel",
    f"{WITH_L} SELECT id, CASE WHEN street_width > 0 THEN street_width END AS street_width FROM l",
)
def _(spark, sf):
    listings = T.listings(spark, sf).select("id", "street_width")
    return prepare.null_unless_positive(listings, "street_width")


@query(
    "B17_require_columns",
    f"{WITH_L} SELECT id FROM l WHERE beds IS NOT NULL AND street_width IS NOT NULL AND age IS NOT NULL "
    "AND furnished IS NOT NULL",
)
def _(spark, sf):
    return prepare.require(T.listings(spark, sf), fv.REQUIRED_FOR_MODEL).select("id")


@query("B18_fill_constant", f"{WITH_L} SELECT id, coalesce(daily_rentable, 0) AS daily_rentable FROM l")
def _(spark, sf):
    return prepare.fill_constant(
        T.listings(spark, sf).select("id", "daily_rentable"), {"daily_rentable": 0}
    )


@query(
    "B19_seller_over_text",
    f"{WITH_L} SELECT id, CAST(coalesce(ac, f_ac) AS TINYINT) AS f_ac, "
    "CAST(coalesce(ketchen, f_kitchen) AS TINYINT) AS f_kitchen FROM l",
)
def _(spark, sf):
    return prepare.seller_over_text(
        T.listings(spark, sf).select("id", "ac", "ketchen", "f_ac", "f_kitchen")
    )


@query(
    "B20_either_flag",
    f"{WITH_L} SELECT id, CAST(coalesce(furnished = 1, false) OR coalesce(f_new = 1, false) AS TINYINT) "
    "AS furnished FROM l",
)
def _(spark, sf):
    return T.listings(spark, sf).select("id", prepare.either_flag("furnished", "f_new").alias("furnished"))


@query(
    "B21_positive_or_null",
    f"{WITH_L} SELECT id, CASE WHEN area > 0 THEN area END AS area, CASE WHEN beds > 0 THEN beds END AS beds, "
    "CASE WHEN age > 0 THEN age END AS age FROM l",
)
def _(spark, sf):
    return T.listings(spark, sf).select(
        "id", *[labels.positive_or_null(F.col(c)).alias(c) for c in ("area", "beds", "age")]
    )


_AMENITY_SQL = "concat_ws(',', " + ", ".join(
    f"CASE WHEN {f} = 1 THEN '{f}' END" for f in fv.AMENITY_FLAGS
) + ")"


@query("B22_active_amenities", f"{WITH_L} SELECT id, {_AMENITY_SQL} AS amenities FROM l")
def _(spark, sf):
    return T.listings(spark, sf).select(
        "id", F.array_join(labels.active_amenities(), ",").alias("amenities")
    )


_PCT = "CAST(CAST(floor(abs(price_delta_pct) * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%'"


@query(
    "B23_valuation_label",
    f"{_MAP_SQL} SELECT id, CASE WHEN estimate IS NULL THEN CASE WHEN estate_benefit = 'rental' "
    "THEN 'none_rental' ELSE 'none_out_of_range' END WHEN abs(price_delta_pct) < 0.05e0 THEN 'inline' "
    f"WHEN price_delta_pct > 0 THEN 'above:' || {_PCT} ELSE 'below:' || {_PCT} END AS label FROM m",
)
def _(spark, sf):
    label = pricing.valuation_label(
        F.col("estimate"), F.col("estimate_low"), F.col("estimate_high"), F.col("price_delta_pct"),
        F.col("estate_benefit"),
    )
    return _map(spark, sf).select("id", label.alias("label"))


@query("B24_inspection_filter", f"{WITH_L} SELECT id, street_width FROM l WHERE street_width >= 40e0")
def _(spark, sf):
    return T.listings(spark, sf).filter(F.col("street_width") >= 40.0).select("id", "street_width")


@query("B25_restore_columns", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(spark, sf):
    T.load(spark, sf, "customer")
    original = spark.table("customer")
    working = original.withColumn("extra", F.lit(1)).select("extra", *reversed(original.columns))
    return prepare.restore_columns(working, original.columns)


@query(
    "B27_constant_columns",
    f"{WITH_L} SELECT count(*) AS listings, sum(CAST(price > 0 AS BIGINT))::BIGINT AS priced FROM l",
)
def _(spark, sf):
    listings = T.listings(spark, sf).select("price", "area", F.lit(7).alias("same"))
    kept, constant = prepare.drop_constant_columns(listings, ["price", "area", "same"])
    if constant != ["same"]:
        raise AssertionError(f"expected the constant column only, got {constant}")
    return kept.agg(
        F.count(F.lit(1)).alias("listings"), F.count_if(F.col("price") > 0).alias("priced")
    )


@query(
    "B28_purpose_split",
    f"{WITH_L} SELECT estate_benefit AS part, count(*) AS n, round(sum(price), 2) AS total FROM l GROUP BY 1",
)
def _(spark, sf):
    listings = T.listings(spark, sf)
    sale, rental = prepare.split_purpose(listings)
    parts = [
        part.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 2).alias("total")).select(
            F.lit(name).alias("part"), "n", "total"
        )
        for name, part in (("sell", sale), ("rental", rental))
    ]
    return parts[0].unionByName(parts[1])


# --- C: joins ------------------------------------------------------------------------------


@query("C2_left_join_estimates", f"{WITH_LE} SELECT l.id, e.estimate FROM l LEFT JOIN e ON l.id = e.id")
def _(spark, sf):
    return T.listings(spark, sf).join(T.estimates(spark, sf), "id", "left").select("id", "estimate")


_CATEGORY_VALUES = ", ".join(f"({c}, '{t}', '{b}')" for c, t, b in fv.CATEGORY_ROWS)


@query(
    "C3_category_dimension",
    f"{WITH_L}, d(category, estate_type, estate_benefit) AS (VALUES {_CATEGORY_VALUES}) "
    "SELECT l.id, d.estate_type, d.estate_benefit FROM l LEFT JOIN d ON l.category = d.category",
)
def _(spark, sf):
    split = prepare.split_category(T.listings(spark, sf), prepare.category_dimension(spark))
    return split.select("id", "estate_type", "estate_benefit")


@query("C6_anti_join", f"{WITH_LE} SELECT id FROM l WHERE id NOT IN (SELECT id FROM e)")
def _(spark, sf):
    return joins.pending(T.listings(spark, sf), T.estimates(spark, sf)).select("id")


@query("C7_semi_join", f"{WITH_LE} SELECT id, price FROM l WHERE id IN (SELECT id FROM e)")
def _(spark, sf):
    return joins.sampled_rows(T.listings(spark, sf), T.estimates(spark, sf)).select("id", "price")


@query(
    "C11_page_index",
    f"{WITH_L}, s AS (SELECT city, district FROM l GROUP BY 1, 2 HAVING count(*) >= 10) "
    "SELECT locale, replace(city, ' ', '-') AS city, replace(district, ' ', '-') AS district "
    "FROM s, (VALUES ('ar'), ('en')) v(locale)",
)
def _(spark, sf):
    counts = T.listings(spark, sf).groupBy("city", "district").agg(F.count("id").alias("n"))
    return districts.page_index(counts.withColumn("sufficient", F.col("n") >= 10))


_STATS_SQL = (
    f"s AS (SELECT city, district, count(id) AS listing_count, round_even(median(price) * 10, 0) / 10 AS "
    f"median_price, round_even(median({UNIT}) * 10, 0) / 10 AS median_price_per_m2, count(id) >= 10 AS sufficient "
    "FROM l GROUP BY 1, 2)"
)
_PRICES_SQL = (
    f"p AS (SELECT city, district, estate_type, estate_benefit, count(*) AS listing_count, "
    f"round(median({UNIT})) AS median_price_per_m2, round(quantile_cont({UNIT}, 0.25)) AS p25_price_per_m2, "
    f"round(quantile_cont({UNIT}, 0.75)) AS p75_price_per_m2, round(median(price)) AS median_price FROM l "
    f"WHERE {CLIP} AND area > 0 AND price > 0 AND city IS NOT NULL AND district IS NOT NULL "
    "GROUP BY ALL HAVING count(*) >= 5)"
)


def _prices(spark, sf):
    """The price mart as a stored table, as the map layers read it."""
    return cut_lineage(districts.district_prices(T.listings(spark, sf)))


def _stats(spark, sf):
    return districts.district_stats(T.listings(spark, sf), categories=())


@query(
    "C13_dossiers",
    f"{_MAP_SQL}, {_STATS_SQL}, {_PRICES_SQL} SELECT m.id, m.age, m.rooms, s.median_price AS "
    "district_median_price, p.median_price_per_m2 AS comparable_median_per_m2, p.listing_count AS "
    "comparable_listings FROM (SELECT *, beds + livings AS rooms FROM m) m LEFT JOIN s ON m.city = s.city AND m.district = s.district "
    "LEFT JOIN p ON m.city = p.city AND m.district = p.district AND m.estate_type = p.estate_type AND "
    "m.estate_benefit = p.estate_benefit",
)
def _(spark, sf):
    listings = T.listings(spark, sf)
    details = listings.select("id", "age", (F.col("beds") + F.col("livings")).alias("rooms"))
    map_rows = _map(spark, sf).drop("age")
    return viewport.dossiers(
        map_rows, details, _stats(spark, sf), districts.district_prices(listings)
    ).select(
        "id", "age", "rooms", "district_median_price", "comparable_median_per_m2", "comparable_listings"
    )


# One saved search per customer; criteria come and go with the customer's key.
SEARCHES = """
SELECT c_custkey AS search_id,
  CASE WHEN c_custkey % 2 = 0 THEN 'sell' WHEN c_custkey % 7 = 0 THEN 'lease' END AS purpose,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'building' WHEN 'AUTOMOBILE' THEN 'villa'
    WHEN 'MACHINERY' THEN 'land' WHEN 'HOUSEHOLD' THEN '' ELSE NULL END AS estate_type,
  CASE WHEN c_custkey % 3 = 0 THEN abs(c_acctbal) * 100e0 END AS price_min,
  CASE WHEN c_custkey % 5 = 0 THEN abs(c_acctbal) * 400e0 END AS price_max,
  CASE WHEN c_custkey % 11 = 0 THEN 200e0 END AS area_min,
  CASE WHEN c_custkey % 13 = 0 THEN 800e0 END AS area_max,
  CASE WHEN c_custkey % 17 = 0 THEN 3e0 END AS min_beds,
  CASE WHEN c_custkey % 4 < 3 THEN n_name END AS city,
  CASE WHEN c_custkey % 8 < 3 THEN concat('D', CAST(c_custkey % 8 AS VARCHAR(3))) END AS district,
  CASE WHEN c_custkey % 6 = 1 THEN 17.1e0 + (n_nationkey * 7) % 15 END AS near_lat,
  CASE WHEN c_custkey % 6 = 1 THEN 36.1e0 + (n_nationkey * 11) % 19 END AS near_lng,
  CASE WHEN c_custkey % 9 = 1 THEN 7e0 WHEN c_custkey % 9 < 5 THEN 20e0 ELSE 10e0 END AS near_km
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""
_NEAR_OK = "near_lat IS NOT NULL AND near_lng IS NOT NULL AND near_km IN (1, 3, 5, 10, 20)"
_MATCH_SQL = (
    f"{WITH_L}, q AS MATERIALIZED (SELECT search_id, CASE WHEN purpose IN ('sell', 'rental') THEN purpose END AS purpose, "
    "nullif(estate_type, '') AS kind, price_min, price_max, area_min, area_max, min_beds, city AS q_city, "
    f"district AS q_district, CASE WHEN {_NEAR_OK} THEN near_lat END AS a, CASE WHEN {_NEAR_OK} THEN near_lng END "
    f"AS b, CASE WHEN {_NEAR_OK} THEN near_km END AS km FROM ({SEARCHES})), "
    "hit AS (SELECT search_id, id, price, last_update FROM q JOIN l ON (purpose IS NULL OR estate_benefit = purpose) "
    "AND (kind IS NULL OR estate_type = kind) AND (price_min IS NULL OR price >= price_min) "
    "AND (price_max IS NULL OR price <= price_max) AND (area_min IS NULL OR area >= area_min) "
    "AND (area_max IS NULL OR area <= area_max) AND (min_beds IS NULL OR beds >= min_beds) "
    "AND (q_city IS NULL OR city = q_city) AND (q_district IS NULL OR district = q_district) "
    f"AND (km IS NULL OR ((lng - b) * ({_KM} * cos(radians(a)))) * ((lng - b) * ({_KM} * cos(radians(a)))) "
    f"+ ((lat - a) * {_KM}) * ((lat - a) * {_KM}) <= km * km))"
)


def _searches(spark, sf):
    T.load(spark, sf, "customer", "nation")
    return spark.sql(SEARCHES)


@query(
    "C15_saved_search_counts",
    f"{_MATCH_SQL} SELECT q.search_id, count(hit.id) AS matches FROM q LEFT JOIN hit ON q.search_id = hit.search_id "
    "GROUP BY 1",
)
def _(spark, sf):
    return searches.match_counts(T.listings(spark, sf), _searches(spark, sf))


@query(
    "C15_saved_search_newest",
    f"{_MATCH_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY last_update DESC, id) AS rank "
    "FROM hit) SELECT search_id, CAST(rank AS INT) AS rank, id, price FROM r WHERE rank <= 5",
)
def _(spark, sf):
    found = searches.newest_matches(T.listings(spark, sf), _searches(spark, sf), 5)
    return found.select("search_id", "rank", "id", "price")


# --- D: aggregations -----------------------------------------------------------------------


@query("D1_viewport_total", f"{WITH_L} SELECT count(*) AS total FROM l WHERE {BOX_SQL} AND {FILTERS_SQL}")
def _(spark, sf):
    return viewport.viewport_total(T.listings(spark, sf), BOX, FILTERS)


@query(
    "D2_district_stats",
    f"{WITH_L}, {_STATS_SQL} SELECT * FROM s",
)
def _(spark, sf):
    return _stats(spark, sf)


@query("D3_district_prices", f"{WITH_L}, {_PRICES_SQL} SELECT * FROM p")
def district_prices(spark, sf):
    return districts.district_prices(T.listings(spark, sf))


@query(
    "D4_site_stats",
    f"{_MAP_SQL} SELECT count(*) AS listings, count(estimate) AS with_estimate, count(DISTINCT city) AS cities, "
    "count(DISTINCT (city, district)) AS districts FROM m",
)
def _(spark, sf):
    return districts.site_stats(_map(spark, sf))


@query(
    "D5_sorted_values",
    f"{WITH_L} SELECT string_agg(t, ',' ORDER BY t) AS estate_types FROM (SELECT DISTINCT estate_type AS t FROM l)",
)
def _(spark, sf):
    values = districts.sorted_values(T.listings(spark, sf), "estate_type")
    return values.select(F.array_join("values", ",").alias("estate_types"))


@query(
    "D6_city_districts",
    f"{WITH_L} SELECT city, string_agg(coalesce(district, '-'), ',' ORDER BY district NULLS LAST) AS districts "
    "FROM (SELECT DISTINCT city, district FROM l) GROUP BY city",
)
def _(spark, sf):
    nested = districts.city_districts(T.listings(spark, sf))
    return nested.select("city", F.array_join("districts", ",", "-").alias("districts"))


@query(
    "D7_slider_bounds",
    f"{WITH_L} SELECT CAST(round_even(quantile_cont(price, 0.995) FILTER (price > 0), 0) AS BIGINT) AS price_max, "
    "CAST(round_even(quantile_cont(area, 0.995) FILTER (area > 0), 0) AS BIGINT) AS area_max FROM l",
)
def _(spark, sf):
    return districts.slider_bounds(T.listings(spark, sf))


@query(
    "D8_sufficient_districts",
    f"{WITH_L}, {_STATS_SQL} SELECT * FROM s WHERE sufficient",
)
def _(spark, sf):
    return districts.sufficient_districts(_stats(spark, sf))


@query(
    "D9_city_rollup",
    f"{WITH_L}, {_STATS_SQL} SELECT city, sum(listing_count)::BIGINT AS total, string_agg(coalesce(district, '') || ':' || listing_count, ',' "
    "ORDER BY district NULLS FIRST) AS districts FROM s GROUP BY 1",
)
def _(spark, sf):
    rolled = districts.city_rollup(_stats(spark, sf))
    one = lambda d: F.concat(F.coalesce(d["district"], F.lit("")), F.lit(":"), d["listing_count"].cast("string"))
    return rolled.select("city", "total", F.array_join(F.transform("districts", one), ",").alias("districts"))


_PROFILE_COLUMNS = ("price", "beds", "livings", "wc", "street_width", "furnished", "district")


@query(
    "D10_column_profile",
    f"{WITH_L} " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS non_null, count(*) - count({c}) AS nulls, "
        f"round_even((100 - count({c}) / count(*)::DOUBLE * 100) * 10, 0) / 10 AS null_pct FROM l"
        for c in _PROFILE_COLUMNS
    ),
)
def _(spark, sf):
    return profile.column_profile(T.listings(spark, sf).select(*_PROFILE_COLUMNS)).drop("dtype")


@query(
    "D11_null_profile_by",
    f"{WITH_L} SELECT estate_type, count(*) FILTER (beds IS NULL) AS nulls, count(beds) AS non_null, "
    "count(*) AS total FROM l GROUP BY 1",
)
def _(spark, sf):
    return profile.null_profile_by(T.listings(spark, sf), "beds", "estate_type")


@query(
    "D12_value_counts",
    f"{WITH_L} SELECT beds, count(*) AS n, count(*) / (SELECT count(*) FROM l)::DOUBLE AS share FROM l GROUP BY 1",
)
def _(spark, sf):
    return profile.value_counts(T.listings(spark, sf), "beds")


@query("D13_multi_key_size", f"{WITH_L} SELECT furnished, f_new, count(*) AS size FROM l GROUP BY 1, 2")
def _(spark, sf):
    return profile.size_by(T.listings(spark, sf), "furnished", "f_new")


@query(
    "D14_flag_rates",
    f"{WITH_L} " + " UNION ALL ".join(
        f"SELECT '{f}' AS flag, round_even(avg({f}) * 100 * 100, 0) / 100 AS rate_pct FROM l"
        for f in fv.AMENITY_FLAGS
    ),
)
def _(spark, sf):
    return profile.rates(T.listings(spark, sf), list(fv.AMENITY_FLAGS))


@query("D15_group_mean", f"{WITH_L} SELECT estate_benefit, round(avg(price), 4) AS mean_price FROM l GROUP BY 1")
def _(spark, sf):
    mean = profile.group_mean(T.listings(spark, sf), "price", "estate_benefit")
    return mean.select("estate_benefit", F.round("mean_price", 4).alias("mean_price"))


@query(
    "D16_describe",
    f"{WITH_L} " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, "
        f"min({c})::DOUBLE AS min, round(quantile_cont({c}::DOUBLE, 0.25), 4) AS p25, round(median({c}::DOUBLE), 4) AS p50, "
        f"round(quantile_cont({c}::DOUBLE, 0.75), 4) AS p75, max({c})::DOUBLE AS max FROM l"
        for c in ("price", "area", "beds")
    ),
)
def _(spark, sf):
    table = profile.describe(T.listings(spark, sf), ["price", "area", "beds"])
    return table.select(
        "column", "count", "min", "max",
        *[F.round(c, 4).alias(c) for c in ("mean", "std", "p25", "p50", "p75")],
    )


_PROBS = (0.0, 0.001, 0.01, 0.05, 0.5, 0.95, 0.99, 0.999, 1.0)


@query(
    "D17_quantile_table",
    f"{WITH_L} " + " UNION ALL ".join(
        f"SELECT {p}e0 AS prob, round(quantile_cont(price, {p}), 4) AS value FROM l" for p in _PROBS
    ),
)
def _(spark, sf):
    table = profile.quantile_table(T.listings(spark, sf), "price", _PROBS)
    return table.select("prob", F.round("value", 4).alias("value"))


@query(
    "D17_tail_counts",
    f"{WITH_L}, c AS (SELECT quantile_cont(street_width, 0.95) AS cut FROM l) SELECT street_width AS value, cut, "
    "count(*) AS n, sum(count(*)) OVER ()::BIGINT AS above FROM l, c WHERE street_width > cut GROUP BY 1, 2",
)
def _(spark, sf):
    return profile.tail_counts(T.listings(spark, sf), "street_width", 0.95)


@query(
    "D18_histogram",
    f"{WITH_L}, v AS (SELECT area AS v FROM l WHERE area >= (SELECT quantile_cont(area, 0.001) FROM l) AND area <= "
    "(SELECT quantile_cont(area, 0.99) FROM l)), b AS (SELECT min(v) AS a, (max(v) - min(v)) / 50 AS w FROM v) "
    "SELECT CAST(least(floor((v - a) / w), 49) AS INT) AS bin, count(*) AS n FROM v, b GROUP BY 1",
)
def _(spark, sf):
    return profile.histogram(T.listings(spark, sf), "area").select("bin", "n")


@query(
    "D18_box_stats",
    f"{WITH_L}, q AS (SELECT estate_type AS k, quantile_cont(price, 0.25) AS q1, median(price) AS median, "
    "quantile_cont(price, 0.75) AS q3 FROM l GROUP BY 1) SELECT estate_type, round(q1, 4) AS q1, round(median, 4) AS "
    "median, round(q3, 4) AS q3, min(price) FILTER (price >= q1 - 1.5 * (q3 - q1)) AS whisker_low, max(price) FILTER "
    "(price <= q3 + 1.5 * (q3 - q1)) AS whisker_high, count(*) FILTER (price < q1 - 1.5 * (q3 - q1) OR price > q3 + "
    "1.5 * (q3 - q1)) AS outliers FROM l JOIN q ON estate_type = k GROUP BY 1, 2, 3, 4",
)
def _(spark, sf):
    table = profile.box_stats(T.listings(spark, sf), "price", ["estate_type"])
    return table.select(
        "estate_type", *[F.round(c, 4).alias(c) for c in ("q1", "median", "q3")],
        "whisker_low", "whisker_high", "outliers",
    )


_CORR = ("price", "area", "beds", "livings")


@query(
    "D19_correlation_pairs",
    f"{WITH_L} " + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}::DOUBLE, {b}::DOUBLE), 6) AS r FROM l"
        for i, a in enumerate(_CORR) for b in _CORR[i + 1 :]
    ),
)
def _(spark, sf):
    pairs = profile.correlation_pairs(T.listings(spark, sf), _CORR)
    return pairs.select("a", "b", F.round("r", 6).alias("r"))


_LINKED = {"price": "price", "area": "area", "cost": "price * 0.9e0 + area * 100e0", "rebate": "area - price * 2e0"}


@query(
    "D19_top_correlations",
    f"{WITH_L}, n AS (SELECT {', '.join(f'{e} AS {c}' for c, e in _LINKED.items())} FROM l), c AS ("
    + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM n" for i, a in enumerate(_LINKED) for b in list(_LINKED)[i + 1 :]
    )
    + ") SELECT a, b, round(r, 6) AS r, row_number() OVER (ORDER BY abs(r) DESC, a, b)::INT AS place FROM c WHERE abs(r) > 0.7e0",
)
def _(spark, sf):
    linked = T.listings(spark, sf).selectExpr(*[f"{e} AS {c}" for c, e in _LINKED.items()])
    top = profile.top_correlations(linked, list(_LINKED))
    place = F.row_number().over(Window.orderBy(F.abs("r").desc(), "a", "b"))  # a row per pair of columns
    return top.withColumn("place", place).select("a", "b", F.round("r", 6).alias("r"), "place")


@query(
    "D26_fill_audit",
    f"{WITH_L} SELECT 'beds' AS \"column\", count(*) FILTER (beds IS NULL) AS nulls_before, 0::BIGINT AS nulls_after, "
    "count(*) FILTER (beds IS NULL) AS filled FROM l UNION ALL SELECT 'wc', count(*) FILTER (wc IS NULL), "
    "count(*) FILTER (wc IS NULL), 0::BIGINT FROM l",
)
def _(spark, sf):
    before = T.listings(spark, sf)
    return profile.fill_audit(before, prepare.fill_constant(before, {"beds": 0}), ["beds", "wc"])


_BREAK_ROWS = (
    "r AS (SELECT estate_type, estate_benefit, median_price_per_m2 AS v, row_number() OVER (PARTITION BY "
    "estate_type, estate_benefit ORDER BY median_price_per_m2) - 1 AS i, count(*) OVER (PARTITION BY estate_type, "
    "estate_benefit) AS n FROM p)"
)
_BREAK_COLUMNS = ", ".join(
    f"max(v) FILTER (i = floor((n - 1) * ({i} / 5e0) + 0.5)) AS b{i}" for i in range(1, 5)
)


@query(
    "D27_quantile_breaks",
    f"{WITH_L}, {_PRICES_SQL}, {_BREAK_ROWS} SELECT estate_type, estate_benefit, max(n) AS districts, {_BREAK_COLUMNS} "
    "FROM r GROUP BY 1, 2",
)
def _(spark, sf):
    breaks = districts.national_breaks(_prices(spark, sf))
    return breaks.select(
        "estate_type", "estate_benefit", "districts",
        *[F.col("breaks")[i - 1].alias(f"b{i}") for i in range(1, 5)],
    )


_CENTRES = "c AS (SELECT city, district, avg(lat) AS lat, avg(lng) AS lng FROM l WHERE district IS NOT NULL GROUP BY 1, 2)"


@query(
    "D28_visible_breaks",
    f"{WITH_L}, {_PRICES_SQL}, {_CENTRES}, pv AS (SELECT p.* FROM p JOIN c USING (city, district) WHERE {BOX_SQL}), "
    f"{_BREAK_ROWS}, nat AS (SELECT estate_type, estate_benefit, {_BREAK_COLUMNS} FROM r GROUP BY 1, 2), "
    f"{_BREAK_ROWS.replace('r AS', 'rv AS').replace('FROM p)', 'FROM pv)')}, loc AS (SELECT estate_type, estate_benefit, "
    f"max(n) AS visible, {_BREAK_COLUMNS} FROM rv GROUP BY 1, 2) SELECT nat.estate_type, nat.estate_benefit, "
    "coalesce(visible, 0) AS visible, "
    + ", ".join(f"CASE WHEN visible >= 8 THEN loc.b{i} ELSE nat.b{i} END AS b{i}" for i in range(1, 5))
    + " FROM nat LEFT JOIN loc USING (estate_type, estate_benefit)",
)
def _(spark, sf):
    listings = T.listings(spark, sf)
    centres = (
        listings.filter(F.col("district").isNotNull())
        .groupBy("city", "district")
        .agg(F.avg("lat").alias("lat"), F.avg("lng").alias("lng"))
    )
    breaks = districts.visible_breaks(_prices(spark, sf), centres, BOX)
    return breaks.select(
        "estate_type", "estate_benefit", "visible",
        *[F.col("breaks")[i - 1].alias(f"b{i}") for i in range(1, 5)],
    )


_STEP = " ".join(f"WHEN value <= b{i} THEN {i - 1}" for i in range(1, 5))


@query(
    "D29_shade_steps",
    f"{WITH_L}, {_PRICES_SQL}, {_BREAK_ROWS}, b AS (SELECT {_BREAK_COLUMNS} FROM r WHERE estate_type = 'villa' AND "
    "estate_benefit = 'sell'), o AS (SELECT DISTINCT city, district FROM l WHERE district IS NOT NULL), v AS (SELECT city, "
    "district, median_price_per_m2 AS value FROM p WHERE estate_type = 'villa' AND estate_benefit = 'sell') "
    f"SELECT o.city, o.district, value, CAST(CASE WHEN value IS NULL THEN NULL {_STEP} ELSE 4 END AS INT) AS step "
    "FROM o CROSS JOIN b LEFT JOIN v ON o.city = v.city AND o.district = v.district",
)
def _(spark, sf):
    listings = T.listings(spark, sf)
    prices = _prices(spark, sf)
    chosen = viewport.segment(prices, "villa", "sell")
    outlined = listings.filter(F.col("district").isNotNull()).select("city", "district").distinct()
    breaks = viewport.segment(districts.national_breaks(prices), "villa", "sell")
    return districts.shade_outlines(outlined, chosen, breaks)


# --- E, F: windows, sorts, samples -----------------------------------------------------------


@query(
    "E1_latest_per_key",
    "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, "
    "event_id DESC) AS rn FROM events) WHERE rn = 1",
)
def _(spark, sf):
    from plotyard.operators.extraction.merge import latest

    T.load(spark, sf, "events")
    return latest(spark.table("events"), "user_id", "ts").select("user_id", "event_id", "event_type")


_MD5 = "md5('42|' || CAST(id AS VARCHAR))"


@query(
    "E3_stratified_sample",
    f"{WITH_L}, q AS (SELECT estate_type AS k, count(*) AS n, least(count(*), greatest(1, CAST(round_even(400 * count(*) / "
    "(SELECT count(*) FROM l)::DOUBLE, 0) AS BIGINT))) AS quota FROM l GROUP BY 1), r AS (SELECT id, estate_type, quota, "
    f"{_MD5} AS h, row_number() OVER (PARTITION BY estate_type ORDER BY {_MD5}) AS rn FROM l JOIN q ON estate_type = k) "
    "SELECT id, estate_type FROM r WHERE rn <= quota ORDER BY h LIMIT 400",
)
def _(spark, sf):
    listings = T.listings(spark, sf).select("id", "estate_type")
    return sampling.stratified_sample(listings, "estate_type", 400, sampling.hash_key("id"))


@query(
    "F1_newest_pins",
    f"{_MAP_SQL} SELECT id, price, estimate FROM m WHERE {BOX_SQL} AND {FILTERS_SQL} ORDER BY last_update DESC, id LIMIT 500",
)
def _(spark, sf):
    return viewport.pins(_map(spark, sf), BOX, FILTERS, 500).select("id", "price", "estimate")


@query(
    "F2_uniform_sample",
    f"{WITH_L} SELECT id, lat, lng FROM l WHERE {BOX_SQL} ORDER BY {_MD5} LIMIT 2500",
)
def _(spark, sf):
    hits = T.listings(spark, sf).filter(predicates.bounds_predicate(BOX)).select("id", "lat", "lng")
    return sampling.uniform_sample(hits, 2500, sampling.hash_key("id"))


@query(
    "F3_tier_heat",
    f"{WITH_L} SELECT lat, lng FROM l WHERE {BOX_SQL} AND {FILTERS_SQL} ORDER BY {_MD5} LIMIT 25000",
)
def _(spark, sf):
    return viewport.viewport(_map(spark, sf), BOX, FILTERS, zoom=9).rows


@query(
    "F3_tier_pins",
    f"{WITH_L} SELECT id, price FROM l WHERE {BOX_SQL} AND {FILTERS_SQL} ORDER BY last_update DESC, id LIMIT 200",
)
def _(spark, sf):
    return viewport.viewport(_map(spark, sf), BOX, FILTERS, zoom=15, screen="small").rows.select("id", "price")


@query(
    "F4_extremes",
    f"{WITH_L} (SELECT id, price, 'largest' AS side FROM l ORDER BY price DESC, id LIMIT 10) UNION ALL "
    "(SELECT id, price, 'smallest' AS side FROM l ORDER BY price, id LIMIT 10)",
)
def _(spark, sf):
    listings = T.listings(spark, sf).select("id", "price")
    largest = sampling.n_extreme(listings, "price", 10, largest=True).withColumn("side", F.lit("largest"))
    smallest = sampling.n_extreme(listings, "price", 10, largest=False).withColumn("side", F.lit("smallest"))
    return largest.unionByName(smallest)


@query(
    "F5_featured",
    f"{WITH_L}, {_STATS_SQL} SELECT * FROM s WHERE sufficient ORDER BY listing_count DESC, city, district NULLS FIRST LIMIT 8",
)
def _(spark, sf):
    return districts.featured(_stats(spark, sf))


@query("F6_random_peek", f"{WITH_L} SELECT id, price FROM l ORDER BY {_MD5} LIMIT 5")
def _(spark, sf):
    return sampling.uniform_sample(T.listings(spark, sf).select("id", "price"), 5, sampling.hash_key("id"))


@query(
    "F9_train_test_split",
    f"{WITH_L} SELECT id, CASE WHEN ('0x' || substr({_MD5}, 1, 7))::BIGINT % 100 < 70 THEN 'train' ELSE 'test' END AS part FROM l",
)
def _(spark, sf):
    train, test = sampling.train_test_split(T.listings(spark, sf).select("id"))
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


# --- G: set operations ---------------------------------------------------------------------


@query(
    "G1_union_markets",
    f"{WITH_LE} SELECT id, estimate, estimate_market FROM e",
)
def _(spark, sf):
    estimates = T.estimates(spark, sf).select("id", "estimate", "estimate_market")
    built = estimates.filter("estimate_market = 'built'")
    return built.unionByName(estimates.filter("estimate_market = 'land'"))


@query("G4_distinct", f"{WITH_L} SELECT DISTINCT city, district FROM l")
def _(spark, sf):
    return T.listings(spark, sf).select("city", "district").distinct()


# --- H: scalar functions on listings ----------------------------------------------------------


# every tier occurs: prices as they are, in thousands, in millions and a thousandfold
_TIERS = "(CASE id % 4 WHEN 0 THEN price WHEN 1 THEN price / 1e3 WHEN 2 THEN price / 1e6 ELSE price * 1e4 END)"


@query(
    "H10_compact_price",
    f"{WITH_L}, t AS (SELECT id, {_TIERS} AS p FROM l) SELECT id, CASE "
    + " ".join(
        f"WHEN p >= {unit} THEN rtrim(rtrim(CASE WHEN p / {unit} < 10 THEN printf('%.2f', p / {unit}) "
        f"ELSE printf('%.1f', p / {unit}) END, '0'), '.') || '{suffix}'"
        for unit, suffix in (("1e9", "B"), ("1e6", "M"))
    )
    + " WHEN p >= 1e3 THEN (CASE WHEN p / 1e3 < 10 THEN "
    "rtrim(rtrim(printf('%.1f', p / 1e3), '0'), '.') ELSE printf('%.0f', p / 1e3) END) || 'K' "
    "ELSE format('{:,}', CAST(floor(p + 0.5e0) AS BIGINT)) || ' SAR' END AS label FROM t",
)
def _(spark, sf):
    priced = T.listings(spark, sf).select("id", F.expr(_TIERS).alias("p"))
    return priced.select("id", labels.compact_price(F.col("p")).alias("label"))


@query(
    "H12_district_slug",
    f"{WITH_L} SELECT DISTINCT city, replace(city, ' ', '-') AS slug, replace(city, '-', ' ') AS back FROM l",
)
def _(spark, sf):
    cities = T.listings(spark, sf).select("city").distinct()
    slug = labels.district_slug(F.col("city"))
    return cities.select("city", slug.alias("slug"), labels.district_from_slug(slug).alias("back"))


@query("H19_price_per_m2", f"{WITH_L} SELECT id, round_even({UNIT} * 100, 0) / 100 AS price_per_m2 FROM l")
def _(spark, sf):
    return prepare.with_unit_price(T.listings(spark, sf)).select("id", "price_per_m2")


@query(
    "H20_log_target",
    f"{WITH_L}, t AS (SELECT id, area, estate_type = 'land' AS land, CASE WHEN estate_type = 'land' THEN price / area ELSE "
    f"price END AS y FROM l WHERE {_SALE}) SELECT id, round(ln(1 + y), 8) AS true_log, round(CASE WHEN land THEN "
    "(exp(ln(1 + y)) - 1) * area ELSE exp(ln(1 + y)) - 1 END, 3) AS back FROM t",
)
def _(spark, sf):
    market = pricing.market_for(F.col("estate_type"))
    target = pricing.log_target(F.col("price"), F.col("area"), market)
    rows = T.listings(spark, sf).filter(pricing.sale_selection())
    return rows.select(
        "id", F.round(target, 8).alias("true_log"),
        F.round(pricing.from_log_target(target, F.col("area"), market), 3).alias("back"),
    )


@query(
    "H24_absolute_error",
    f"{_MAP_SQL} SELECT id, round(abs(estimate - price) / price, 8) AS ape, abs(estimate - price) / price <= 0.1 AS close "
    "FROM m WHERE estimate IS NOT NULL",
)
def _(spark, sf):
    error = pricing.absolute_error_pct(F.col("price"), F.col("estimate"))
    priced = _map(spark, sf).filter(F.col("estimate").isNotNull())
    return priced.select("id", F.round(error, 8).alias("ape"), (error <= 0.1).alias("close"))


_TYPES = ("apartment", "building", "land", "store", "villa")


@query(
    "H27_integer_codes",
    f"{WITH_L} SELECT id, CAST(list_position(['apartment', 'building', 'land', 'store', 'villa'], estate_type) - 1 AS INT) "
    "AS code FROM l",
)
def _(spark, sf):
    listings = T.listings(spark, sf)
    return listings.select("id", prepare.integer_codes(listings, "estate_type", _TYPES).alias("code"))


@query(
    "H28_one_hot",
    f"{WITH_L} SELECT id, " + ", ".join(
        f"CAST(estate_type = '{t}' AS TINYINT) AS type_{t}" for t in fv.MODELLED_TYPES
    ) + " FROM l",
)
def _(spark, sf):
    return prepare.one_hot(T.listings(spark, sf).select("id", "estate_type"))


@query("D35_one_hot_check", f"{WITH_L} SELECT CAST(1 AS INT) AS raised, count(*) AS listings FROM l")
def _(spark, sf):
    return prepare.one_hot_check(prepare.one_hot(T.listings(spark, sf).select("id", "estate_type")))


@query(
    "H29_estimable_types",
    f"{WITH_L} SELECT string_agg(t, ',' ORDER BY t) AS types, max(d) AS districts FROM (SELECT DISTINCT estate_type AS t FROM l), "
    "(SELECT string_agg(coalesce(district, '-'), ',' ORDER BY district NULLS LAST) AS d FROM (SELECT DISTINCT district FROM l "
    "WHERE city = 'NATION_1'))",
)
def _(spark, sf):
    bounds = districts.filter_bounds(_map(spark, sf))
    types = districts.estimable_types(bounds).select(F.array_join("estate_types", ",").alias("types"))
    return types.withColumn(
        "districts",
        districts.districts_of(bounds, "NATION_1").select(F.array_join("districts", ",", "-")).scalar(),
    )


@query(
    "M_map_mart",
    f"{_MAP_SQL} SELECT id, CAST(lat AS FLOAT) AS lat, price, estimate, price_delta_pct FROM m WHERE {CLIP}",
)
def _(spark, sf):
    listings = T.listings(spark, sf)
    mart = marts.map_mart(listings, listings.select("id"), T.estimates(spark, sf))
    return mart.select("id", "lat", "price", "estimate", "price_delta_pct")
