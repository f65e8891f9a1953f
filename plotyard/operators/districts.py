"""District statistics, price segments, site summaries, filter bounds and choropleth scales.

A district is always the pair (city, district): names repeat across cities.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotyard import fixed_values as fv
from plotyard.functions import geo, labels, predicates, pricing
from plotyard.operators.joins import null_safe_join
from plotyard.operators.quantiles import grouped_quantiles, nearest_rank_breaks

DISTRICT = ["city", "district"]


def district_stats(
    listings: DataFrame,
    categories: Sequence[str] = fv.POI_CATEGORY_NAMES,
    minimum: int = fv.MIN_LISTINGS_DISTRICT,
) -> DataFrame:
    """Count, medians and mean amenity distances per (city, district), NULL keys kept."""
    unit = pricing.price_per_m2(F.col("price"), F.col("area"))
    means = [F.avg(f"dist_{c}_m").alias(f"mean_dist_{c}_m") for c in categories]
    stats = grouped_quantiles(
        listings,
        DISTRICT,
        {
            "price": (F.col("price"), {"median_price": 0.5}),
            "unit": (unit, {"median_price_per_m2": 0.5}),
        },
        extra=[F.count("id").alias("listing_count"), *means],
    )
    floats = ["median_price", "median_price_per_m2", *[f"mean_dist_{c}_m" for c in categories]]
    return stats.select(
        *DISTRICT,
        "listing_count",
        *[pricing.half_even(F.col(c), 1).alias(c) for c in floats],
        (F.col("listing_count") >= minimum).alias("sufficient"),
    )


def district_prices(listings: DataFrame, minimum: int = fv.MIN_LISTINGS_PRICE) -> DataFrame:
    """Price per square metre by district, type and purpose; thin segments are left out."""
    usable = listings.filter(
        predicates.country_clip()
        & (F.col("area") > 0)
        & (F.col("price") > 0)
        & F.col("city").isNotNull()
        & F.col("district").isNotNull()
    )
    keys = [*DISTRICT, "estate_type", "estate_benefit"]
    unit = pricing.price_per_m2(F.col("price"), F.col("area"))
    priced = grouped_quantiles(
        usable.select(*keys, "price", "area"),
        keys,
        {
            "unit": (
                unit,
                {"median_price_per_m2": 0.5, "p25_price_per_m2": 0.25, "p75_price_per_m2": 0.75},
            ),
            "price": (F.col("price"), {"median_price": 0.5}),
        },
        extra=[F.count(F.lit(1)).alias("listing_count")],
    )
    medians = ["median_price_per_m2", "p25_price_per_m2", "p75_price_per_m2", "median_price"]
    return priced.filter(F.col("listing_count") >= minimum).select(
        *keys, "listing_count", *[F.round(F.col(c)).alias(c) for c in medians]
    )


def site_stats(map_mart: DataFrame) -> DataFrame:
    """One row of totals. Pairs are counted as tuples, so a pair with a NULL part counts."""
    totals = map_mart.agg(
        F.count(F.lit(1)).alias("listings"), F.count("estimate").alias("with_estimate")
    )
    pairs = map_mart.select("city", "district").distinct()
    names = pairs.agg(
        F.count_distinct("city").alias("cities"), F.count(F.lit(1)).alias("districts")
    )
    return totals.select(
        "listings",
        "with_estimate",
        names.select("cities").scalar().alias("cities"),
        names.select("districts").scalar().alias("districts"),
    )


def sorted_values(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values as one array; NULL, where present, comes last as in a SQL sort."""
    distinct = df.select(column).distinct()
    return distinct.agg(_sorted_list(column).alias("values"))


def _sorted_list(column: str) -> Column:
    """Ascending list of already distinct values with NULL kept at the end."""
    wrapped = F.array_sort(
        F.collect_list(F.struct(F.col(column).isNull().alias("n"), F.col(column).alias("v")))
    )
    return F.transform(wrapped, lambda s: s["v"])


def city_districts(df: DataFrame) -> DataFrame:
    """City with the sorted list of its districts. Pairs are made distinct first, so a list grows
    with the number of districts, never with the number of listings."""
    pairs = df.select("city", "district").distinct()
    return pairs.groupBy("city").agg(_sorted_list("district").alias("districts"))


def filter_bounds(map_mart: DataFrame, quantile: float = fv.SLIDER_QUANTILE) -> DataFrame:
    """One row: types, purposes, cities with districts, and clamped price and area ceilings."""
    cities = city_districts(map_mart).agg(
        F.array_sort(
            F.collect_list(
                F.struct(F.col("city").isNull().alias("n"), F.struct("city", "districts").alias("v"))
            )
        ).alias("c")
    ).select(F.transform("c", lambda s: s["v"]).alias("cities"))
    return slider_bounds(map_mart, quantile).select(
        sorted_values(map_mart, "estate_type").scalar().alias("estate_types"),
        sorted_values(map_mart, "estate_benefit").scalar().alias("purposes"),
        cities.scalar().alias("cities"),
        "price_max",
        "area_max",
    )


def slider_bounds(df: DataFrame, quantile: float = fv.SLIDER_QUANTILE) -> DataFrame:
    """Clamped ceilings over positive values, rounded (not truncated) to whole numbers."""
    positive = {
        name: (F.when(F.col(column) > 0, F.col(column)), {name: quantile})
        for column, name in (("price", "price_max"), ("area", "area_max"))
    }
    bounds = grouped_quantiles(df, [], positive)
    return bounds.select(
        *[F.bround(F.col(c), 0).cast("long").alias(c) for c in ("price_max", "area_max")]
    )


def sufficient_districts(stats: DataFrame) -> DataFrame:
    """Districts that may have a page, busiest first."""
    return (
        stats.filter("sufficient")
        .select(*DISTRICT, "listing_count", "median_price", "median_price_per_m2", "sufficient")
        .orderBy(F.col("listing_count").desc(), *DISTRICT)
    )


def city_rollup(stats: DataFrame) -> DataFrame:
    """Cities with their districts and total listings, largest first."""
    return (
        stats.groupBy("city")
        .agg(
            F.sum("listing_count").alias("total"),
            F.array_sort(F.collect_list(F.struct("district", "listing_count"))).alias("districts"),
        )
        .orderBy(F.col("total").desc(), "city")
    )


def featured(stats: DataFrame, n: int = fv.FEATURED_DISTRICTS) -> DataFrame:
    return sufficient_districts(stats).limit(n)


def estimable_types(bounds: DataFrame, modelled: Sequence[str] = fv.MODELLED_TYPES) -> DataFrame:
    """Types both present in the data and priceable, in the order of the data."""
    wanted = F.array(*[F.lit(t) for t in modelled])
    return bounds.select(F.array_intersect("estate_types", wanted).alias("estate_types"))


def districts_of(bounds: DataFrame, city: str) -> DataFrame:
    """District list of one city from the bounds row; empty when the city is unknown."""
    hit = F.filter("cities", lambda c: c["city"] == city)
    return bounds.select(
        F.when(F.size(hit) > 0, hit[0]["districts"])
        .otherwise(F.array().cast("array<string>"))
        .alias("districts")
    )


def page_index(stats: DataFrame, locales: Sequence[str] = ("ar", "en")) -> DataFrame:
    """One row per locale and district page, with URL slugs."""
    return stats.filter("sufficient").select(
        F.explode(F.array(*[F.lit(x) for x in locales])).alias("locale"),
        labels.district_slug(F.col("city")).alias("city"),
        labels.district_slug(F.col("district")).alias("district"),
    )


# --- choropleth ----------------------------------------------------------------------------


def national_breaks(prices: DataFrame, steps: int = fv.CHOROPLETH_STEPS) -> DataFrame:
    """Breaks per (type, purpose) over all districts of the segment."""
    keys = ["estate_type", "estate_benefit"]
    return nearest_rank_breaks(prices, keys, F.col("median_price_per_m2"), steps).select(
        *keys, "breaks", F.col("n_values").alias("districts")
    )


def visible_breaks(
    prices: DataFrame,
    centres: DataFrame,
    bounds: predicates.Bounds,
    steps: int = fv.CHOROPLETH_STEPS,
    minimum: int = fv.MIN_LOCAL_DISTRICTS,
) -> DataFrame:
    """Breaks refit to the districts whose outline centre is in view; the national ones are kept
    where fewer than ``minimum`` are. ``centres`` carries city, district, lat, lng."""
    keys = ["estate_type", "estate_benefit"]
    inside = centres.filter(predicates.bounds_predicate(bounds)).select(*DISTRICT)
    local = nearest_rank_breaks(
        prices.join(inside, DISTRICT, "left_semi"), keys, F.col("median_price_per_m2"), steps
    ).select(*keys, F.col("breaks").alias("local"), F.col("n_values").alias("visible"))
    joined = null_safe_join(national_breaks(prices, steps), local, keys, "left")
    visible = F.coalesce("visible", F.lit(0).cast("long"))
    return joined.select(
        *keys,
        F.when(visible >= minimum, F.col("local")).otherwise(F.col("breaks")).alias("breaks"),
        visible.alias("visible"),
    )


def shade_outlines(
    outlines: DataFrame, prices: DataFrame, breaks: DataFrame, steps: int = fv.CHOROPLETH_STEPS
) -> DataFrame:
    """Every outline with the figure and step of a segment; no figure stays "no data".

    ``prices`` and ``breaks`` are those of one (type, purpose)."""
    value = prices.select(*DISTRICT, F.col("median_price_per_m2").alias("value"))
    shaded = outlines.join(value, DISTRICT, "left").withColumn(
        "breaks", breaks.select("breaks").scalar()
    )
    return shaded.withColumn("step", labels.shade_step(F.col("value"), F.col("breaks"), steps)).drop(
        "breaks"
    )


def outline_centres(outlines: DataFrame) -> DataFrame:
    centre = geo.ring_centre(F.col("ring"))
    return outlines.select(*DISTRICT, centre["lat"].alias("lat"), centre["lng"].alias("lng"))


def legend(breaks: DataFrame) -> DataFrame:
    return breaks.withColumn("labels", labels.band_labels(F.col("breaks")))

