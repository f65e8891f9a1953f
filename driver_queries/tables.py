"""Stand-in views: the driver's tables have no listings, so listings, features, estimates and
candidates are derived from them by SQL that Spark and DuckDB both accept. Values (not row
selections) are made from keys by arithmetic; every source row is used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plotyard.fixed_values import AMENITY_FLAGS

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

_CITY_LAT = "(CASE WHEN n_nationkey = 24 THEN 32.85e0 ELSE 17e0 + (n_nationkey * 7) % 15 END)"
_CITY_LNG = "(36e0 + (n_nationkey * 11) % 19)"
_FLAGS = ",\n  ".join(
    f"CAST(CASE WHEN (o_orderkey * {7 + 2 * i}) % {5 + i % 4} = 0 THEN 1 ELSE 0 END AS INT) AS {f}"
    for i, f in enumerate(AMENITY_FLAGS)
)

LISTINGS = f"""
SELECT o_orderkey AS id,
  {_CITY_LAT} + 0.05e0 * (o_custkey % 4)
    + ((o_orderkey * 7919) % 4001) / 1e5 * (CASE WHEN o_custkey % 8 = 7 THEN 10e0 ELSE 1e0 END) AS lat,
  {_CITY_LNG} + (CASE WHEN o_custkey % 8 >= 4 THEN 0.05e0 ELSE 0e0 END)
    + ((o_orderkey * 104729) % 4003) / 1e5 * (CASE WHEN o_custkey % 8 = 7 THEN 10e0 ELSE 1e0 END) AS lng,
  o_totalprice * 10e0 AS price,
  CASE WHEN o_orderkey % 53 = 0 THEN 0.0e0 ELSE 50e0 + (o_orderkey * 31) % 950 END AS area,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderkey % 7 AS INT) END AS beds,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderkey % 4 AS INT) END AS livings,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_orderkey % 5 AS INT) END AS wc,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE CAST((o_orderkey * 13) % 40 AS INT) END AS age,
  CASE WHEN o_orderkey % 29 = 0 THEN NULL WHEN o_orderkey % 23 = 0 THEN 0e0
    ELSE 10e0 + (o_orderkey * 3) % 40 END AS street_width,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 2 AS INT) END AS furnished,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 2 AS INT) END AS ac,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST((o_orderkey * 3) % 2 AS INT) END AS ketchen,
  CASE WHEN o_orderkey % 6 = 0 THEN CAST(1 AS INT) END AS daily_rentable,
  CAST(1 + o_orderkey % 24 AS INT) AS category,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'building' WHEN 'AUTOMOBILE' THEN 'villa'
    WHEN 'MACHINERY' THEN 'land' WHEN 'HOUSEHOLD' THEN 'apartment' ELSE 'store' END AS estate_type,
  CASE WHEN o_orderstatus = 'P' OR o_orderkey % 5 = 0 THEN 'rental' ELSE 'sell' END AS estate_benefit,
  n_name AS city,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE concat('D', CAST(o_custkey % 8 AS VARCHAR(3))) END AS district,
  CAST(n_nationkey AS BIGINT) AS city_id,
  n_nationkey * 8 + o_custkey % 8 AS district_id,
  o_orderdate AS last_update,
  c_name AS title,
  concat('order of ', o_orderpriority) AS content,
  {_FLAGS}
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
"""

# Points from customers, axis-aligned rectangles from suppliers (half widths in degrees).
FEATURES = f"""
SELECT c_custkey AS feature_id, 'point' AS kind,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'muslim' WHEN 'AUTOMOBILE' THEN 'hospital'
    WHEN 'MACHINERY' THEN 'mall' WHEN 'HOUSEHOLD' THEN 'college' ELSE 'bench' END AS fclass,
  {_CITY_LAT} + ((c_custkey * 6151) % 2003) / 1e4 AS lat,
  {_CITY_LNG} + ((c_custkey * 15877) % 2011) / 1e4 AS lng,
  0e0 AS half_lat, 0e0 AS half_lng
FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL
SELECT -1 - s_suppkey AS feature_id, 'area' AS kind,
  CASE s_suppkey % 4 WHEN 0 THEN 'muslim_sunni' WHEN 1 THEN 'clinic' WHEN 2 THEN 'department_store'
    ELSE 'university' END AS fclass,
  {_CITY_LAT} + ((s_suppkey * 6151) % 2003) / 1e4 AS lat,
  {_CITY_LNG} + ((s_suppkey * 15877) % 2011) / 1e4 AS lng,
  0.001e0 + (s_suppkey % 5) / 1e3 AS half_lat, 0.002e0 + (s_suppkey % 3) / 1e3 AS half_lng
FROM supplier JOIN nation ON s_nationkey = n_nationkey
"""

_ESTIMATES = """
SELECT id,
  price * (0.7e0 + ((id * 17) % 61) / 1e2) AS estimate,
  price * (0.7e0 + ((id * 17) % 61) / 1e2) * 0.8e0 AS estimate_low,
  price * (0.7e0 + ((id * 17) % 61) / 1e2) * 1.2e0 AS estimate_high,
  CASE WHEN estate_type = 'land' THEN 'land' ELSE 'built' END AS estimate_market
FROM {source}
WHERE estate_benefit = 'sell' AND price > 0 AND area > 0
  AND CASE WHEN estate_type = 'land'
      THEN price >= 1000 AND price / CASE WHEN area > 0 THEN area END BETWEEN 10e0 AND 20000e0
      ELSE price BETWEEN 50000e0 AND 50000000e0 END
"""

ESTIMATES = _ESTIMATES.format(source=f"({LISTINGS}) l")
ESTIMATES_OF_L = _ESTIMATES.format(source="l")  # where a query already names the listings l

# One proposed value per document: null values, null evidence, out-of-range values and spans
# that do or do not occur in the text.
CANDIDATES = """
SELECT doc_id AS id, text AS clean, 'wc' AS field,
  CASE WHEN doc_id % 6 = 0 THEN NULL WHEN doc_id % 10 = 1 THEN 99e0 ELSE CAST(doc_id % 7 AS DOUBLE) END AS value,
  CASE WHEN doc_id % 8 = 3 THEN NULL WHEN doc_id % 9 = 4 THEN 'zzqq not in text zzqq'
    ELSE regexp_extract(text, '[A-Za-z]+ [a-z]+', 0) END AS evidence,
  CASE WHEN doc_id % 3 = 0 THEN 'apartment' WHEN doc_id % 3 = 1 THEN 'villa' ELSE 'land' END AS estate_type
FROM documents
"""


def load(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Register the driver's Parquet tables as temporary views (lazy)."""
    for name in names or TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    load(spark, sf_dir, "orders", "customer", "nation")
    return spark.sql(LISTINGS)


def estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    load(spark, sf_dir, "orders", "customer", "nation")
    return spark.sql(ESTIMATES)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features with rings, as an ingest of point and area layers would give them."""
    load(spark, sf_dir, "customer", "supplier", "nation")
    from pyspark.sql import functions as F

    raw = spark.sql(FEATURES)

    def corner(a: int, b: int):
        return F.struct(
            (F.col("lng") + a * F.col("half_lng")).alias("lng"),
            (F.col("lat") + b * F.col("half_lat")).alias("lat"),
        )

    square = F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1), corner(-1, -1))
    ring = F.when(F.col("kind") == "point", F.array(corner(0, 0))).otherwise(square)
    return raw.select("feature_id", "kind", "fclass", F.array(ring).alias("rings"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    load(spark, sf_dir, "documents")
    return spark.sql(CANDIDATES)
