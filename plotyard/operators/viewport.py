"""Interactive queries over the marts: totals, pins, heat samples, lookups and dossiers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotyard import fixed_values as fv
from plotyard.functions.predicates import Bounds, Filters, bounds_predicate, listing_predicate
from plotyard.operators.sampling import hash_key, newest_first, uniform_sample

PIN_COLUMNS = (
    "id", "lat", "lng", "price", "area", "beds", "estate_type", "estate_benefit", "city",
    "district", "estimate", "estimate_low", "estimate_high", "price_delta_pct",
)
DISTRICT = ["city", "district"]
SEGMENT = [*DISTRICT, "estate_type", "estate_benefit"]


@dataclass(frozen=True)
class Viewport:
    tier: str
    rows: DataFrame
    total: DataFrame


def matching(map_mart: DataFrame, bounds: Bounds, filters: Filters) -> DataFrame:
    return map_mart.filter(bounds_predicate(bounds) & listing_predicate(filters))


def viewport_total(map_mart: DataFrame, bounds: Bounds, filters: Filters) -> DataFrame:
    return matching(map_mart, bounds, filters).agg(F.count(F.lit(1)).alias("total"))


def pins(map_mart: DataFrame, bounds: Bounds, filters: Filters, limit: int) -> DataFrame:
    """Newest matching listings; top-n per partition, then merged."""
    return newest_first(matching(map_mart, bounds, filters), limit).select(*PIN_COLUMNS)


def heat_points(
    map_mart: DataFrame, bounds: Bounds, filters: Filters, limit: int, seed: int = 42
) -> DataFrame:
    """Uniform sample of the matches, drawn after the filter."""
    hits = matching(map_mart, bounds, filters).select("id", "lat", "lng")
    return uniform_sample(hits, limit, hash_key("id", seed=seed)).select("lat", "lng")


def tier_for_zoom(zoom: float) -> str:
    return "pins" if zoom >= fv.PIN_ZOOM else "heat"


def viewport(
    map_mart: DataFrame, bounds: Bounds, filters: Filters, zoom: float, screen: str = "desktop"
) -> Viewport:
    tier = tier_for_zoom(zoom)
    rows = (
        pins(map_mart, bounds, filters, fv.PIN_LIMIT[screen])
        if tier == "pins"
        else heat_points(map_mart, bounds, filters, fv.HEAT_LIMIT[screen])
    )
    return Viewport(tier, rows, viewport_total(map_mart, bounds, filters))


def listing_by_id(map_mart: DataFrame, listing_id: int) -> DataFrame:
    return map_mart.filter(F.col("id") == listing_id).select(*PIN_COLUMNS).limit(1)


def detail_by_id(details: DataFrame, listing_id: int) -> DataFrame:
    return details.filter(F.col("id") == listing_id).limit(1)


def district(stats: DataFrame, city: str, name: str) -> DataFrame:
    return stats.filter((F.col("city") == city) & (F.col("district") == name)).limit(1)


def comparable(prices: DataFrame, city: str, name: str, kind: str, purpose: str) -> DataFrame:
    return (
        segment(prices, kind, purpose)
        .filter((F.col("city") == city) & (F.col("district") == name))
        .limit(1)
    )


def segment(prices: DataFrame, kind: str, purpose: str) -> DataFrame:
    return prices.filter((F.col("estate_type") == kind) & (F.col("estate_benefit") == purpose))


def dossiers(
    map_mart: DataFrame, details: DataFrame, stats: DataFrame, prices: DataFrame
) -> DataFrame:
    """Map row with its details, district figures and comparables, for any number of listings.

    The two district tables have one row per district (segment), so even a city holding most
    listings meets one row each; AQE broadcasts or splits them by their size at run time."""
    extra = details.select("id", *[c for c in details.columns if c not in map_mart.columns])
    figures = stats.select(
        *DISTRICT,
        F.col("listing_count").alias("district_listings"),
        F.col("median_price").alias("district_median_price"),
        F.col("median_price_per_m2").alias("district_median_per_m2"),
        "sufficient",
    )
    comparables = prices.select(
        *SEGMENT,
        F.col("listing_count").alias("comparable_listings"),
        F.col("median_price_per_m2").alias("comparable_median_per_m2"),
        F.col("p25_price_per_m2").alias("comparable_p25_per_m2"),
        F.col("p75_price_per_m2").alias("comparable_p75_per_m2"),
    )
    return (
        map_mart.join(extra, "id", "left")
        .join(figures, DISTRICT, "left")
        .join(comparables, SEGMENT, "left")
    )
