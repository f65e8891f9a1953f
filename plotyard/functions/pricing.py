"""Price expressions: unit prices, log targets and their inverse, errors, valuation labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotyard.fixed_values import (
    BUILT_PRICE,
    IN_LINE_THRESHOLD,
    LAND_PRICE_MIN,
    LAND_PRICE_PER_M2,
    MODELLED_TYPES,
)


def half_even(value: Column, digits: int) -> Column:
    """Round half-even in binary floating point, as array libraries do."""
    factor = float(10**digits)
    return F.rint(value * F.lit(factor)) / F.lit(factor)


def price_per_m2(price: Column, area: Column) -> Column:
    """NULL unless the area is positive."""
    return F.when(area > 0, F.try_divide(price, area))


def price_delta(price: Column, estimate: Column) -> Column:
    """Signed relative gap between the ask and the estimate, 4 decimals, NULL without estimate."""
    return F.when(estimate > 0, F.round(F.try_divide(price - estimate, estimate), 4))


def market_for(estate_type: Column) -> Column:
    return F.when(estate_type == "land", "land").otherwise("built")


def sale_selection() -> Column:
    """Sale listings of the modelled types with a usable price and area."""
    return (
        (F.col("estate_benefit") == "sell")
        & F.col("estate_type").isin(*MODELLED_TYPES)
        & (F.col("price") > 0)
        & (F.col("area") > 0)
    )


def in_market_bounds(price="price", area="area", estate_type="estate_type") -> Column:
    """Built listings are bounded on price, land on price and on price per square metre."""
    p, unit = F.col(price), F.try_divide(F.col(price), F.col(area))
    land = F.col(estate_type) == "land"
    return F.when(land, (p >= LAND_PRICE_MIN) & unit.between(*LAND_PRICE_PER_M2)).otherwise(
        p.between(*BUILT_PRICE)
    )


def log_target(price: Column, area: Column, market: Column) -> Column:
    return F.log1p(F.when(market == "land", F.try_divide(price, area)).otherwise(price))


def from_log_target(predicted_log: Column, area: Column, market: Column) -> Column:
    """Total price again: land predictions are per square metre."""
    value = F.expm1(predicted_log)
    return F.when(market == "land", value * area).otherwise(value)


def absolute_error_pct(true: Column, predicted: Column) -> Column:
    return F.try_divide(F.abs(predicted - true), true)


def valuation_label(
    estimate: Column, low: Column, high: Column, delta: Column, purpose: Column
) -> Column:
    """inline / above:<pct>% / below:<pct>%, or the reason there is no estimate."""
    gap = F.coalesce(delta, F.lit(0.0))
    pct = F.concat(F.floor(F.abs(gap) * 100 + 0.5).cast("string"), F.lit("%"))
    return (
        F.when(
            estimate.isNull() | low.isNull() | high.isNull(),
            F.when(purpose == "rental", "none_rental").otherwise("none_out_of_range"),
        )
        .when(F.abs(gap) < IN_LINE_THRESHOLD, "inline")
        .when(gap > 0, F.concat(F.lit("above:"), pct))
        .otherwise(F.concat(F.lit("below:"), pct))
    )
