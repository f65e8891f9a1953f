"""Serving marts: the slim map table, the wide detail table, district tables and site JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotyard import fixed_values as fv
from plotyard.functions import pricing
from plotyard.functions.predicates import country_clip
from plotyard.operators import districts, outlines, prepare
from plotyard.session import discard, hand_over
from plotyard.sources import io

DETAIL_COLUMNS = (
    "id", "title", "content", "beds", "livings", "wc", "area", "street_width", "age", "rooms",
    "furnished", *fv.AMENITY_FLAGS,
)


def map_mart(listings: DataFrame, pois: DataFrame, estimates: DataFrame) -> DataFrame:
    """Slim rows of measured listings inside the country, with the estimate where there is one."""
    slim = prepare.slim_map(listings.filter(country_clip()))
    priced = slim.join(pois.select("id"), "id").join(
        estimates.select("id", "estimate", "estimate_low", "estimate_high"), "id", "left"
    )
    return priced.withColumn("price_delta_pct", pricing.price_delta(F.col("price"), F.col("estimate")))


def details_mart(listings: DataFrame, pois: DataFrame) -> DataFrame:
    """Everything the detail record shows; amenity measures come without repeating the id."""
    wide = listings.filter(country_clip()).select(*DETAIL_COLUMNS)
    return wide.join(pois, "id")


def build_marts(
    listings: DataFrame, pois: DataFrame, estimates: DataFrame, folder: str, partitions: int = 200
) -> None:
    """Write every mart under ``folder``. The map mart is written once and read back for what is
    derived from it, so the joins behind it run once."""
    spark = listings.sparkSession
    io.write_mart(
        io.cluster_spatially(map_mart(listings, pois, estimates), partitions),
        f"{folder}/map", fv.MAP_ROW_GROUP_ROWS,
    )
    io.write_mart(
        io.cluster_by_id(details_mart(listings, pois), partitions),
        f"{folder}/details", fv.DETAILS_ROW_GROUP_ROWS, lookup=("id",),
    )
    clipped = listings.filter(country_clip())
    io.write_mart(districts.district_stats(clipped.join(pois, "id")), f"{folder}/districts", lookup=("district",))
    io.write_mart(districts.district_prices(listings), f"{folder}/district_prices", lookup=("district",))
    stored = spark.read.parquet(f"{folder}/map")
    stats = spark.read.parquet(f"{folder}/districts", lookup=("district",))
    io.write_json_lines(districts.site_stats(stored), f"{folder}/site-stats")
    io.write_json_lines(districts.sufficient_districts(stats), f"{folder}/districts-json")
    io.write_json_lines(districts.filter_bounds(stored), f"{folder}/filter-bounds")
    shapes = hand_over(outlines.district_outlines(listings), "outlines")
    io.write_geojson(shapes, f"{folder}/outlines")
    io.write_geojson_collection(shapes, f"{folder}/outlines-collection")
    discard(shapes)
