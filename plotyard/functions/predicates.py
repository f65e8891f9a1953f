"""Filter parameters as Columns: every absent parameter leaves its clause out, so Catalyst can
push what remains (ranges, equalities, IN lists) to the Parquet scan."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotyard.fixed_values import COUNTRY_BBOX, KM_PER_DEGREE


@dataclass(frozen=True)
class Bounds:
    south: float
    west: float
    north: float
    east: float


@dataclass(frozen=True)
class Near:
    lat: float
    lng: float
    radius_km: float


@dataclass(frozen=True)
class Filters:
    purpose: str | None = None
    estate_types: tuple[str, ...] = ()
    price_min: float | None = None
    price_max: float | None = None
    area_min: float | None = None
    area_max: float | None = None
    min_beds: float | None = None
    city: str | None = None
    district: str | None = None
    near: Near | None = field(default=None)


def country_clip(lat: str = "lat", lng: str = "lng", bbox=COUNTRY_BBOX) -> Column:
    """Inclusive country box."""
    return F.col(lat).between(bbox[0], bbox[1]) & F.col(lng).between(bbox[2], bbox[3])


def bounds_predicate(bounds: Bounds) -> Column:
    return F.col("lat").between(bounds.south, bounds.north) & F.col("lng").between(
        bounds.west, bounds.east
    )


def near_predicate(near: Near) -> Column:
    """Box first (prunes row groups), then the equirectangular circle on a spherical earth."""
    per_lng = KM_PER_DEGREE * math.cos(math.radians(near.lat))
    dlat, dlng = near.radius_km / KM_PER_DEGREE, near.radius_km / per_lng
    dy = (F.col("lat") - F.lit(near.lat)) * F.lit(KM_PER_DEGREE)
    dx = (F.col("lng") - F.lit(near.lng)) * F.lit(per_lng)
    return (
        F.col("lat").between(near.lat - dlat, near.lat + dlat)
        & F.col("lng").between(near.lng - dlng, near.lng + dlng)
        & (dx * dx + dy * dy <= F.lit(float(near.radius_km) ** 2))
    )


def is_finite_number(value: float | None) -> bool:
    return value is not None and math.isfinite(value)


def finite(column: Column) -> Column:
    """The value where it is a finite number, else NULL."""
    return F.when(
        ~F.isnan(column) & (F.abs(column) != F.lit(float("inf"))), column
    )


def listing_predicate(filters: Filters) -> Column:
    """AND of the given clauses; TRUE when there are none. Non-finite numbers are ignored."""
    ranges = (
        ("price", ">=", filters.price_min),
        ("price", "<=", filters.price_max),
        ("area", ">=", filters.area_min),
        ("area", "<=", filters.area_max),
        ("beds", ">=", filters.min_beds),
    )
    clauses: list[Column] = []
    if filters.purpose is not None:
        clauses.append(F.col("estate_benefit") == filters.purpose)
    if filters.estate_types:
        clauses.append(F.col("estate_type").isin(*filters.estate_types))
    for name, side, value in ranges:
        if is_finite_number(value):
            clauses.append(F.col(name) >= value if side == ">=" else F.col(name) <= value)
    if filters.city is not None:
        clauses.append(F.col("city") == filters.city)
    if filters.district is not None:
        clauses.append(F.col("district") == filters.district)
    if filters.near is not None:
        clauses.append(near_predicate(filters.near))
    return reduce(lambda a, b: a & b, clauses, F.lit(True))
