"""Sources and sinks as round trips: written by the library, read back, compared with the input."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_queries import tables as T
from driver_queries.registry import WITH_L, WITH_LE, query
from driver_queries.spatial_queries import _FEATURES_SQL, _selected
from plotyard import fixed_values as fv
from plotyard.functions import labels
from plotyard.operators import districts
from plotyard.session import scratch_path
from plotyard.sources import io

_ORDERS_SQL = "SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS keys, round(sum(o_totalprice), 2) AS total FROM orders"


def _orders(spark, sf):
    T.load(spark, sf, "orders")
    return spark.table("orders")


def _orders_summary(df):
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"),
        F.round(F.sum("o_totalprice"), 2).alias("total"),
    )


@query("A1_typed_scan", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 0")
def _(spark, sf):
    customers = io.read_parquet(
        spark, f"{sf}/customer.parquet", "c_custkey long, c_acctbal double, c_mktsegment string"
    )
    return customers.filter("c_acctbal > 0").select("c_custkey", "c_mktsegment")


@query("A2_merge_parts", _ORDERS_SQL)
def _(spark, sf):
    parts, merged = scratch_path(spark, "parts"), scratch_path(spark, "merged")
    _orders(spark, sf).repartition(6, "o_orderkey").write.parquet(parts)
    io.merge_parts(spark, parts, merged)
    return _orders_summary(spark.read.parquet(merged))


@query(
    "A3_union_by_name",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS o_totalprice, CASE WHEN o_orderstatus <> 'F' THEN "
    "o_orderpriority END AS o_orderpriority FROM orders",
)
def _(spark, sf):
    folder = scratch_path(spark, "varied")
    orders = _orders(spark, sf)
    orders.filter("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice").write.parquet(f"{folder}/a")
    orders.filter("o_orderstatus <> 'F'").select("o_orderkey", "o_orderpriority").write.parquet(f"{folder}/b")
    return io.read_parts(spark, f"{folder}/a", f"{folder}/b").select(
        "o_orderkey", "o_totalprice", "o_orderpriority"
    )


@query(
    "A4_chunked_export",
    "SELECT count(*) AS n, sum(l_orderkey)::BIGINT AS keys, true AS within_limit FROM lineitem",
)
def _(spark, sf):
    T.load(spark, sf, "lineitem")
    target = scratch_path(spark, "chunks")
    io.write_chunks(spark.table("lineitem"), target)
    per_file = spark.read.parquet(target).groupBy(F.input_file_name().alias("file")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("l_orderkey").alias("keys")
    )
    return per_file.agg(
        F.sum("rows").alias("n"), F.sum("keys").alias("keys"),
        (F.max("rows") <= fv.EXPORT_PART_ROWS).alias("within_limit"),
    )


@query(
    "A5_feature_ingest",
    f"SELECT fclass, kind, count(*) AS features, round(min(lng - half_lng), 6) AS west, round(max(lat + half_lat), 6) AS north "
    f"FROM ({T.FEATURES}) GROUP BY 1, 2",
)
def _(spark, sf):
    folder = scratch_path(spark, "layers")
    features = T.features(spark, sf)
    pair = F.transform("rings", lambda r: F.transform(r, lambda p: F.array(p["lng"], p["lat"])))
    for kind, shape, coordinates in (("point", "Point", pair[0][0]), ("area", "Polygon", pair)):
        geometry = F.struct(F.lit(shape).alias("type"), coordinates.alias("coordinates"))
        line = F.struct(
            F.lit("Feature").alias("type"), F.struct("fclass").alias("properties"), geometry.alias("geometry")
        )
        features.filter(F.col("kind") == kind).select(F.to_json(line)).write.text(f"{folder}/{kind}")
    layers = io.read_features(spark, {k: f"{folder}/{k}" for k in ("point", "area")})
    vertices = F.flatten("rings")
    return layers.groupBy("fclass", "kind").agg(
        F.count(F.lit(1)).alias("features"),
        F.round(F.min(F.array_min(F.transform(vertices, lambda p: p["lng"]))), 6).alias("west"),
        F.round(F.max(F.array_max(F.transform(vertices, lambda p: p["lat"]))), 6).alias("north"),
    )


@query(
    "A6_feature_store",
    f"WITH {_FEATURES_SQL} SELECT category, count(*) AS features FROM f WHERE category IN ('mosque', 'mall') GROUP BY 1",
)
def _(spark, sf):
    store = scratch_path(spark, "features")
    io.write_feature_store(_selected(spark, sf), store)
    read = io.read_feature_store(spark, store, ["mosque", "mall"])
    return read.groupBy("category").agg(F.count(F.lit(1)).alias("features"))


@query("A7_zstd_row_groups", _ORDERS_SQL)
def _(spark, sf):
    target = scratch_path(spark, "zstd")
    io.write_mart(_orders(spark, sf), target, row_group_rows=fv.DETAILS_ROW_GROUP_ROWS)
    return _orders_summary(spark.read.parquet(target))


@query("A8_spatial_layout", f"{WITH_L} SELECT id, lat, lng FROM l WHERE lat BETWEEN 20e0 AND 24.1e0")
def _(spark, sf):
    target = scratch_path(spark, "spatial")
    listings = T.listings(spark, sf).select("id", "lat", "lng", "price")
    io.write_mart(io.cluster_spatially(listings, 8), target, fv.MAP_ROW_GROUP_ROWS)
    return spark.read.parquet(target).filter(F.col("lat").between(20.0, 24.1)).select("id", "lat", "lng")


@query("A9_id_layout", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)")
def _(spark, sf):
    target = scratch_path(spark, "by-id")
    orders = _orders(spark, sf).withColumnRenamed("o_orderkey", "id")
    io.write_mart(io.cluster_by_id(orders, 8), target, fv.DETAILS_ROW_GROUP_ROWS)
    stored = spark.read.parquet(target)
    top = stored.agg(F.max("id")).first()[0]
    return stored.filter(F.col("id") == top).select(F.col("id").alias("o_orderkey"), "o_totalprice")


def _map(spark, sf):
    return T.listings(spark, sf).join(T.estimates(spark, sf), "id", "left")


@query("A10_json_array", f"{WITH_L} SELECT city, district, count(*) AS n FROM l GROUP BY 1, 2")
def _(spark, sf):
    target = scratch_path(spark, "array-json")
    counts = T.listings(spark, sf).groupBy("city", "district").agg(F.count(F.lit(1)).alias("n"))
    io.write_json_array(counts, target, "city")
    return io.read_json_array(spark, target, "city string, district string, n long")


@query(
    "A12_checkpoint_append",
    "SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS keys, count(o_totalprice) AS priced FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' "
    "THEN o_totalprice END AS o_totalprice FROM orders)",
)
def _(spark, sf):
    from pyspark.sql import types as S

    target = scratch_path(spark, "checkpoint")
    schema = S.StructType([S.StructField("o_orderkey", S.LongType()), S.StructField("o_totalprice", S.DoubleType())])
    orders = _orders(spark, sf)
    io.append_checkpoint(orders.filter("o_orderstatus = 'F'"), target, schema)
    unpriced = orders.filter("o_orderstatus <> 'F'").withColumn("o_totalprice", F.lit(None).cast("double"))
    io.append_checkpoint(unpriced, target, schema)
    return io.read_checkpoint(spark, target, schema).agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"), F.count("o_totalprice").alias("priced")
    )


@query("A13_registered_marts", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def _(spark, sf):
    folder = scratch_path(spark, "marts")
    _orders(spark, sf).write.parquet(f"{folder}/map_orders")
    io.register_marts(spark, folder, ["map_orders"])
    return spark.sql("SELECT o_orderpriority, count(*) AS n FROM map_orders GROUP BY 1")


@query(
    "A15_predictions_sink",
    f"{WITH_LE} SELECT estimate_market, count(*) AS n, round(sum(estimate), 0) AS total FROM e GROUP BY 1",
)
def _(spark, sf):
    target = scratch_path(spark, "estimates")
    io.write_mart(T.estimates(spark, sf), target)
    return spark.read.parquet(target).groupBy("estimate_market").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("estimate"), 0).alias("total")
    )


@query("A16_guarded_write", f"{WITH_L} SELECT count(*) AS n, count(coalesce(beds, 0)) AS known FROM l")
def _(spark, sf):
    target = scratch_path(spark, "guarded")
    before = T.listings(spark, sf).select("id", "beds", "wc")
    io.guarded_write(before, before.fillna({"beds": 0}), target, ["beds", "wc"])
    try:
        io.check_no_overwrite(before, before.withColumn("wc", F.lit(9)), ["beds", "wc"])
    except io.GuardError:
        return io.read_table(spark, target).agg(F.count(F.lit(1)).alias("n"), F.count("beds").alias("known"))
    raise AssertionError("an overwrite was not refused")


@query("A17_copy_table", _ORDERS_SQL)
def _(spark, sf):
    source, target = scratch_path(spark, "source"), scratch_path(spark, "copy")
    _orders(spark, sf).write.parquet(source)
    io.copy_table(spark, source, target)
    return _orders_summary(spark.read.parquet(target))


@query(
    "A18_site_json",
    f"{WITH_LE} SELECT count(*) AS listings, count(e.id) AS with_estimate, count(DISTINCT city) AS cities, count(DISTINCT (city, district)) AS "
    "districts FROM l LEFT JOIN e ON l.id = e.id",
)
def _(spark, sf):
    target = scratch_path(spark, "site-stats")
    io.write_json_lines(districts.site_stats(_map(spark, sf)), target)
    return io.read_json(spark, target, "listings long, with_estimate long, cities long, districts long")


@query(
    "T12_filter_bounds",
    f"{WITH_L} SELECT (SELECT count(DISTINCT estate_type) FROM l) AS types, (SELECT count(DISTINCT city) FROM l) AS cities, (SELECT count(*) FROM "
    "(SELECT DISTINCT city, district FROM l)) AS districts, CAST(round_even(quantile_cont(price, 0.995) FILTER (price > 0), 0) AS BIGINT) AS price_max "
    "FROM l",
)
def _(spark, sf):
    target = scratch_path(spark, "bounds")
    io.write_json_lines(districts.filter_bounds(_map(spark, sf)), target)
    schema = (
        "estate_types array<string>, purposes array<string>, "
        "cities array<struct<city:string,districts:array<string>>>, price_max long, area_max long"
    )
    bounds = io.read_json(spark, target, schema)
    total = F.aggregate("cities", F.lit(0), lambda a, c: a + F.size(c["districts"]))
    return bounds.select(
        F.size("estate_types").cast("long").alias("types"), F.size("cities").cast("long").alias("cities"),
        total.cast("long").alias("districts"), "price_max",
    )


@query(
    "H11_radius_label",
    f"{WITH_L} SELECT DISTINCT area, CASE WHEN area < 1000 THEN CAST(area AS VARCHAR) || ' m' END AS label FROM l",
)
def _(spark, sf):
    areas = T.listings(spark, sf).select("area").distinct()
    return areas.select("area", labels.radius_label(F.col("area")).alias("label"))
