"""Display values as Column expressions: compact numbers, distances, slugs, amenity lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotyard.fixed_values import AMENITY_FLAGS


def _fixed(value: Column, digits: int) -> Column:
    """Fixed-point text without grouping."""
    return F.format_string(f"%.{digits}f", value)


def _trim_fraction(text: Column) -> Column:
    """Trailing zeros go only when the text has a decimal point."""
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def compact_number(value: Column) -> Column:
    """B / M / K tiers with fewer digits as the figure grows; grouped whole number below 1,000."""

    def tier(unit: float, small: int, large: int, suffix: str) -> Column:
        scaled = value / F.lit(unit)
        text = F.when(scaled < 10, _fixed(scaled, small)).otherwise(_fixed(scaled, large))
        return F.concat(_trim_fraction(text), F.lit(suffix))

    return (
        F.when(value >= 1e9, tier(1e9, 2, 1, "B"))
        .when(value >= 1e6, tier(1e6, 2, 1, "M"))
        .when(value >= 1e3, tier(1e3, 1, 0, "K"))
        .otherwise(F.format_string("%,d", F.floor(value + 0.5)))
    )


def compact_price(value: Column, unit: str = "SAR") -> Column:
    """Only figures under a thousand carry the currency word."""
    text = compact_number(value)
    return F.when(value >= 1e3, text).otherwise(F.concat(text, F.lit(f" {unit}")))


def whole_number(value: Column, unit: str | None = None) -> Column:
    text = F.format_string("%,d", F.floor(value + 0.5))
    return F.concat(text, F.lit(f" {unit}")) if unit else text


def distance_label(metres: Column) -> Column:
    usable = metres.isNotNull() & ~F.isnan(metres) & (F.abs(metres) != float("inf"))
    near = F.concat(F.floor(metres + 0.5).cast("string"), F.lit(" m"))
    far = F.concat(_fixed(metres / 1000, 1), F.lit(" km"))
    return F.when(~usable, "—").when(metres < 1000, near).otherwise(far)


def radius_label(metres: Column) -> Column:
    km = F.regexp_replace((metres / 1000).cast("string"), r"\.0$", "")
    return F.when(metres < 1000, F.concat(metres.cast("string"), F.lit(" m"))).otherwise(
        F.concat(km, F.lit(" km"))
    )


def district_slug(name: Column) -> Column:
    return F.url_encode(F.regexp_replace(name, r"(?U)\s+", "-"))


def district_from_slug(slug: Column) -> Column:
    return F.regexp_replace(F.url_decode(slug), "-", " ")


def positive_or_null(value: Column) -> Column:
    """Zero means "does not apply" in the detail record, so it is not shown."""
    return F.when(value > 0, value)


def active_amenities(flags=AMENITY_FLAGS) -> Column:
    """Names of the raised flags, in a fixed order."""
    return F.array_compact(F.array(*[F.when(F.col(f) == 1, F.lit(f)) for f in flags]))


def band_labels(breaks: Column) -> Column:
    """One label per shade, each naming the span it covers, scaled by the largest break."""
    largest = F.element_at(breaks, -1)
    divisor = F.when(largest >= 1e6, 1e6).when(largest >= 1e3, 1e3).otherwise(1.0)

    def scaled(value: Column) -> Column:
        result = value / divisor
        text = F.when(result >= 100, _fixed(result, 0)).otherwise(_fixed(result, 1))
        return F.regexp_replace(text, r"\.0$", "")

    first = F.concat(F.lit("< "), scaled(F.element_at(breaks, 1)))
    last = F.concat(scaled(largest), F.lit("+"))
    middle = F.transform(
        F.sequence(F.lit(2), F.size(breaks)),
        lambda i: F.concat(
            scaled(F.element_at(breaks, i - 1)), F.lit("–"), scaled(F.element_at(breaks, i))
        ),
    )
    return F.when(
        F.size(breaks) > 1, F.concat(F.array(first), middle, F.array(last))
    ).when(F.size(breaks) == 1, F.array(first, last))


def shade_step(value: Column, breaks: Column, steps: int) -> Column:
    """0-based step: the first break not below the value, else the last step; NULL for no data."""
    hits = F.filter(
        F.sequence(F.lit(1), F.size(breaks)), lambda i: value <= F.element_at(breaks, i)
    )
    step = F.when(F.size(hits) > 0, F.element_at(hits, 1) - 1).otherwise(steps - 1)
    return F.when(value.isNotNull() & (F.size(breaks) > 0), step)
