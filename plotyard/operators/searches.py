"""Saved searches against listings: which listings match which search, counts and newest hits.

Counts are made block by block where searches and listings meet, without pairs. For the listings themselves:
every criterion may be absent, and matching is an equi-join, not a comparison of every listing with
every search: a search carries only the keys it sets (purpose, type, city, district, grid cells
of its circle, price bins of its range) and its *shape* says which. A listing offers one key per
shape in use - at most 64 - and the exact predicate then runs on the joined rows only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotyard import fixed_values as fv
from plotyard.functions.predicates import finite
from plotyard.operators.joins import null_safe_join
from plotyard.operators.range_counts import count_blocks
from plotyard.session import BROADCAST_MAX_ROWS, cut_lineage, discard, hand_over, spread

CRITERIA = (
    "purpose", "estate_type", "price_min", "price_max", "area_min", "area_max", "min_beds",
    "city", "district", "near_lat", "near_lng", "near_km",
)
_NUMBERS = ("price_min", "price_max", "area_min", "area_max", "min_beds", "near_lat", "near_lng", "near_km")
_CELLS_PER_DEGREE = 4
_BINS_PER_OCTAVE = 2
_LAST_BIN = 127
_SALTS = 16
_KEYS = ("k_shape", "k_purpose", "k_type", "k_city", "k_district", "k_gy", "k_gx", "k_bin")


def canonical(searches: DataFrame) -> DataFrame:
    """Validated criteria: unknown purposes, empty types, non-finite numbers and incomplete or
    out-of-envelope circles count as not given."""
    numbers = {c: finite(F.col(c).cast("double")) for c in _NUMBERS}
    out = searches.withColumns(numbers).withColumns(
        {
            "purpose": F.when(F.col("purpose").isin("sell", "rental"), F.col("purpose")),
            "estate_type": F.when(F.col("estate_type") != "", F.col("estate_type")),
        }
    )
    lat0, lat1, lng0, lng1 = fv.SEARCH_ENVELOPE
    usable = (
        F.col("near_lat").between(lat0, lat1)
        & F.col("near_lng").between(lng0, lng1)
        & F.col("near_km").isin(*[float(r) for r in fv.NEAR_RADII_KM])
    )
    whole = F.coalesce(usable, F.lit(False))
    return out.withColumns(
        {c: F.when(whole, F.col(c)) for c in ("near_lat", "near_lng", "near_km")}
    ).select("search_id", *CRITERIA)


def _bin(price: Column) -> Column:
    """Monotone logarithmic price bin, 0.._LAST_BIN."""
    raw = F.floor(F.log2(F.greatest(price, F.lit(1.0))) * _BINS_PER_OCTAVE)
    return F.greatest(F.lit(0), F.least(F.lit(_LAST_BIN), raw.cast("int")))


def _km_per_lng(lat: Column) -> Column:
    return F.lit(fv.KM_PER_DEGREE) * F.cos(F.radians(lat))


def _key_lists(distinct: DataFrame) -> DataFrame:
    """Searches with their shape, the keys they set once, and lists of those they are met under: grid cells and price bins."""
    priced = F.col("price_min").isNotNull() | F.col("price_max").isNotNull()
    near = F.col("near_km").isNotNull()
    dlat = F.col("near_km") / fv.KM_PER_DEGREE
    dlng = F.col("near_km") / _km_per_lng(F.col("near_lat"))

    def cells(centre: str, delta: Column) -> Column:
        lo = F.floor((F.col(centre) - delta) * _CELLS_PER_DEGREE).cast("int")
        hi = F.floor((F.col(centre) + delta) * _CELLS_PER_DEGREE).cast("int")
        return F.when(near, F.sequence(lo, hi)).otherwise(F.array(F.lit(0)))

    low = _bin(F.coalesce("price_min", F.lit(1.0)))
    high = F.when(F.col("price_max").isNull(), F.lit(_LAST_BIN)).otherwise(
        _bin(F.col("price_max"))
    )
    bins = (
        F.when(priced & (low <= high), F.sequence(low, high))
        .when(priced, F.array().cast("array<int>"))
        .otherwise(F.array(F.lit(0)))
    )
    given = [F.col(c).isNotNull() for c in ("purpose", "estate_type", "city", "district")]
    shape = F.concat(*[F.when(g, "1").otherwise("0") for g in [*given, near, priced]])
    return distinct.withColumns(
        {
            "k_shape": shape,
            "k_purpose": F.coalesce("purpose", F.lit("")),
            "k_type": F.coalesce("estate_type", F.lit("")),
            "k_city": F.coalesce("city", F.lit("")),
            "k_district": F.coalesce("district", F.lit("")),
            "k_gy": cells("near_lat", dlat),
            "k_gx": cells("near_lng", dlng),
            "k_bin": bins,
        }
    )


def _search_keys(distinct: DataFrame) -> DataFrame:
    """One row per key combination a search can be met under, some dozens a search: made where they are read, never written."""
    listed = _key_lists(distinct)
    for k in ("k_gy", "k_gx", "k_bin"):
        listed = listed.withColumn(k, F.explode(k))
    return listed


def _listing_keys(listings: DataFrame, shapes: list[str]) -> DataFrame:
    """One row per (listing, shape in use); a listing without the value a shape needs has no key."""

    def part(bit: int, value: Column, absent: str | int) -> Column:
        return F.when(F.substring("k_shape", bit, 1) == "1", value).otherwise(F.lit(absent))

    def cell(name: str) -> Column:
        return F.floor(F.col(name) * _CELLS_PER_DEGREE).cast("int")

    placed = listings.withColumns({"__gy": cell("lat"), "__gx": cell("lng"), "__bin": _bin(F.col("price"))})
    shaped = placed.withColumn("k_shape", F.explode(F.array(*[F.lit(s) for s in shapes])))
    return shaped.withColumns(
        {
            "k_purpose": part(1, F.col("estate_benefit"), ""),
            "k_type": part(2, F.col("estate_type"), ""),
            "k_city": part(3, F.col("city"), ""),
            "k_district": part(4, F.col("district"), ""),
            "k_gy": part(5, F.col("__gy"), 0),
            "k_gx": part(5, F.col("__gx"), 0),
            "k_bin": part(6, F.col("__bin"), 0),
        }
    ).drop("__gy", "__gx", "__bin")


def _exact() -> Column:
    """The whole predicate, every absent criterion being true."""

    def at_least(column: str, bound: str) -> Column:
        return F.col(bound).isNull() | (F.col(column) >= F.col(bound))

    def at_most(column: str, bound: str) -> Column:
        return F.col(bound).isNull() | (F.col(column) <= F.col(bound))

    dy = (F.col("lat") - F.col("near_lat")) * F.lit(fv.KM_PER_DEGREE)
    dx = (F.col("lng") - F.col("near_lng")) * _km_per_lng(F.col("near_lat"))
    circle = F.col("near_km").isNull() | (dx * dx + dy * dy <= F.col("near_km") * F.col("near_km"))
    return (
        at_least("price", "price_min")
        & at_most("price", "price_max")
        & at_least("area", "area_min")
        & at_most("area", "area_max")
        & at_least("beds", "min_beds")
        & circle
    )


def match(listings: DataFrame, searches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs of a distinct search ``rep`` and a matching listing, and the
    ``search_id`` to ``rep`` mapping. Searches that ask the same are matched once."""
    reps, members = _distinct(searches)
    return _pairs(listings, cut_lineage(reps)), members


def _distinct(searches: DataFrame) -> tuple[DataFrame, DataFrame]:
    wanted = canonical(searches)
    reps = wanted.groupBy(*CRITERIA).agg(F.min("search_id").alias("rep"))
    return reps, null_safe_join(wanted, reps, CRITERIA).select("search_id", "rep")


def _keys_by_shape(reps: DataFrame) -> dict[str, int]:
    """Keys of the searches of each shape; a shape is six yes/no marks, so at most 64 of them reach the driver."""
    combinations = F.size("k_gy").cast("long") * F.size("k_gx") * F.size("k_bin")
    found = _key_lists(reps).groupBy("k_shape").agg(F.sum(combinations).alias("keys")).orderBy("k_shape").collect()
    return {r["k_shape"]: r["keys"] for r in found}


def _pairs(listings: DataFrame, reps: DataFrame, salted: bool = True, most: int | None = None, few: bool = False) -> DataFrame:
    """Matches of ``listings``, ``most`` of them where that is known, and distinct searches, ``few`` where a broadcast holds their keys."""
    by_shape = _keys_by_shape(reps)
    shapes, keyed = list(by_shape), sum(by_shape.values())
    offered = _listing_keys(
        spread(listings, "id").select(*_LISTING_COLUMNS),
        shapes,
    ).drop("estate_type", "city", "district", "estate_benefit")
    criteria = _search_keys(reps).select(
        "rep", *_KEYS, *[c for c in CRITERIA if c not in ("purpose", "estate_type", "city", "district")]
    )
    keys = list(_KEYS)
    if few or keyed <= BROADCAST_MAX_ROWS:
        criteria = F.broadcast(criteria)
    elif most is not None and most * len(shapes) <= BROADCAST_MAX_ROWS:
        offered = F.broadcast(offered)
    elif salted:
        # a key many listings share is spread over salts, its searches repeated per salt
        offered = offered.withColumn("k_salt", F.pmod(F.xxhash64("id"), F.lit(_SALTS)).cast("int"))
        criteria = criteria.withColumn("k_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        keys.append("k_salt")
    pairs = offered.join(criteria, keys).filter(_exact())
    return pairs.select("rep", "id", "price", "last_update")


# --- a cube of bins -----------------------------------------------------------------------------
# Which bins count whole and which listings at edges are opened; ``match_counts`` does without it, as its rows grow with the shapes in use.
# Listings are counted once in a cube: purpose, type, place, grid cell, price bin, area bin and beds, each only where the searches of a shape
# set it. A search adds up the cube's rows that lie wholly within its ranges and its circle, and opens only those that an
# edge of them cuts. So what is joined grows with the rows of the cube, which are bounded by its bins however many listings there are, and with
# the listings at the edges.

_FINE_PRICE, _FINE_AREA = 8, 8  # bins per octave of the cube
_PLACE_KEYS = ("k_shape", "k_purpose", "k_type", "k_city", "k_district", "k_gy", "k_gx")
_BIN_KEYS = ("k_price", "k_area", "k_beds")


def _fine_bin(value: Column, per_octave: int) -> Column:
    bin_ = F.least(F.floor(F.log2(F.greatest(value, F.lit(1.0))) * per_octave), F.lit(10_000))
    return F.when(value.isNotNull(), bin_).cast("int")  # greatest() passes over a NULL


def _wanted_cells(reps: DataFrame) -> DataFrame:
    """Searches with their shape (eight marks), the places they are met at and the bins of their ranges' ends."""
    near = F.col("near_km").isNotNull()
    dlat, dlng = F.col("near_km") / fv.KM_PER_DEGREE, F.col("near_km") / _km_per_lng(F.col("near_lat"))

    def cells(centre: str, delta: Column) -> Column:
        low, high = (F.floor((F.col(centre) + d) * _CELLS_PER_DEGREE).cast("int") for d in (-delta, delta))
        return F.when(near, F.sequence(low, high)).otherwise(F.array(F.lit(0)))

    def ranged(name: str) -> Column:
        return F.col(f"{name}_min").isNotNull() | F.col(f"{name}_max").isNotNull()

    marks = [*(F.col(c).isNotNull() for c in ("purpose", "estate_type", "city", "district")), near, ranged("price"), ranged("area"), F.col("min_beds").isNotNull()]
    placed = reps.withColumn("k_shape", F.concat(*[F.when(m, "1").otherwise("0") for m in marks]))
    placed = placed.withColumns({f"k_{k}": F.coalesce(c, F.lit("")) for k, c in (("purpose", "purpose"), ("type", "estate_type"), ("city", "city"), ("district", "district"))})
    ends = {f"{name}_{end}_bin": _fine_bin(F.col(f"{name}_{end}"), steps) for name, steps in (("price", _FINE_PRICE), ("area", _FINE_AREA)) for end in ("min", "max")}
    return placed.withColumns(ends).withColumn("k_gy", F.explode(cells("near_lat", dlat))).withColumn("k_gx", F.explode(cells("near_lng", dlng)))


def _cube_keys(rows: DataFrame, shapes: list[str]) -> DataFrame:
    """A row per shape in use with the keys that the shape sets; rows without a value that it needs have none."""

    def part(bit: int, value: str, absent: str | int) -> Column:
        return F.when(F.substring("k_shape", bit, 1) == "1", F.col(value)).otherwise(F.lit(absent))

    shaped = rows.withColumn("k_shape", F.explode(F.array(*[F.lit(x) for x in shapes])))
    keys = {
        "k_purpose": part(1, "estate_benefit", ""), "k_type": part(2, "estate_type", ""), "k_city": part(3, "city", ""), "k_district": part(4, "district", ""),
        "k_gy": part(5, "__gy", 0), "k_gx": part(5, "__gx", 0), "k_price": part(6, "__price", 0), "k_area": part(7, "__area", 0), "k_beds": part(8, "__beds", 0.0),
    }
    named = shaped.select(*[c for c in rows.columns if c not in ("estate_benefit", "estate_type", "city", "district")], "k_shape", *[v.alias(k) for k, v in keys.items()])
    return named.dropna(subset=list(keys)).drop("__gy", "__gx", "__price", "__area", "__beds")


def counted_parts(listings: DataFrame, searches: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(whole, opened, members): per distinct search ``rep`` the cube's rows that count as they are, ``n``; the listings of cut ones that match;
    and the ``search_id`` to ``rep`` mapping."""
    wanted = canonical(searches)
    reps = wanted.groupBy(*CRITERIA).agg(F.min("search_id").alias("rep"))
    members = null_safe_join(wanted, reps, CRITERIA).select("search_id", "rep")
    asked = cut_lineage(_wanted_cells(reps))
    # a shape is eight yes/no marks, so at most 256 of them reach the driver
    shapes = sorted(r[0] for r in asked.select("k_shape").distinct().collect())
    cell = lambda c: F.floor(F.col(c) * _CELLS_PER_DEGREE).cast("int")
    rows = listings.select(
        "id", "lat", "lng", "price", "area", "beds", "estate_benefit", "estate_type", "city", "district", cell("lat").alias("__gy"), cell("lng").alias("__gx"),
        _fine_bin(F.col("price"), _FINE_PRICE).alias("__price"), _fine_bin(F.col("area"), _FINE_AREA).alias("__area"), F.col("beds").cast("double").alias("__beds"),
    )
    binned = [c for c in rows.columns if c not in ("id", "lat", "lng", "price", "area", "beds")]
    cube = _cube_keys(rows.groupBy(*binned).agg(F.count(F.lit(1)).alias("n")), shapes)
    cube = cube.groupBy(*_PLACE_KEYS, *_BIN_KEYS).agg(F.sum("n").alias("n"))

    def above(bin_: str, low: str) -> Column:
        return F.coalesce(F.col(bin_) >= F.col(low), F.lit(True))

    def below(bin_: str, high: str) -> Column:
        return F.coalesce(F.col(bin_) <= F.col(high), F.lit(True))

    def at_edge(bin_: str, name: str) -> Column:
        return F.coalesce(F.col(bin_) == F.col(f"{name}_min_bin"), F.lit(False)) | F.coalesce(F.col(bin_) == F.col(f"{name}_max_bin"), F.lit(False))

    possible = above("k_price", "price_min_bin") & below("k_price", "price_max_bin") & above("k_area", "area_min_bin") & below("k_area", "area_max_bin")
    possible = possible & above("k_beds", "min_beds")
    side = 1 / _CELLS_PER_DEGREE
    south, west = F.col("k_gy") * side, F.col("k_gx") * side
    dy = F.greatest(F.abs(south - F.col("near_lat")), F.abs(south + side - F.col("near_lat"))) * fv.KM_PER_DEGREE
    dx = F.greatest(F.abs(west - F.col("near_lng")), F.abs(west + side - F.col("near_lng"))) * _km_per_lng(F.col("near_lat"))
    # the cell's farthest corner, with room for rounding
    cut = F.col("near_km").isNotNull() & (dx * dx + dy * dy > F.col("near_km") * F.col("near_km") * (1 - 1e-9))
    met = cube.join(asked, list(_PLACE_KEYS)).filter(possible).withColumn("cut", cut | at_edge("k_price", "price") | at_edge("k_area", "area"))
    whole = met.filter(~F.col("cut")).select("rep", "n")
    edges = met.filter("cut").drop("n", "cut", "purpose", "estate_type", "city", "district")
    opened = _cube_keys(rows, shapes).join(edges, [*_PLACE_KEYS, *_BIN_KEYS]).filter(_exact()).select("rep", "id")
    return whole, opened, members


# --- counting in blocks ----------------------------------------------------------------------
# A search meets listings in one kind of place: the grid cells of its circle, else its city, else the whole table. A listing is in at
# most one place of each kind, so it is sent three times whatever the searches set; a place of many listings is dealt to blocks, and
# its searches go to each of them.

BLOCK_ROWS = 1_000_000  # listings that a task holds at once


def _places(rows: DataFrame) -> Column:
    cell = [F.floor(F.col(c) * _CELLS_PER_DEGREE).cast("int").cast("string") for c in ("lat", "lng")]
    kinds = F.array(F.lit("all"), F.concat(F.lit("city "), "city"), F.concat(F.lit("cell "), cell[0], F.lit(" "), cell[1]))
    return F.explode(F.array_compact(kinds))


def _asked_places() -> Column:
    def cells(centre: str, delta: Column) -> Column:
        # with room for rounding
        low, high = (F.floor((F.col(centre) + d * (1 + 1e-9)) * _CELLS_PER_DEGREE).cast("int") for d in (-delta, delta))
        return F.sequence(low, high)

    rows = cells("near_lat", F.col("near_km") / fv.KM_PER_DEGREE)
    columns = cells("near_lng", F.col("near_km") / _km_per_lng(F.col("near_lat")))
    met = F.flatten(F.transform(rows, lambda y: F.transform(columns, lambda x: F.concat_ws(" ", F.lit("cell"), y.cast("string"), x.cast("string")))))
    by_city = F.when(F.col("city").isNotNull(), F.array(F.concat(F.lit("city "), "city"))).otherwise(F.array(F.lit("all")))
    return F.explode(F.when(F.col("near_km").isNotNull(), met).otherwise(by_city))


def block_counts(listings: DataFrame, reps: DataFrame) -> DataFrame:
    """``rep``, ``n``: matches of each distinct search in each block where it is met; a search without any may be missing."""
    number = lambda c: F.col(c).cast("double")
    rows = listings.select(
        "id", F.col("estate_benefit").alias("purpose"), "estate_type", "city", "district", *[number(c).alias(c) for c in ("lat", "lng", "price", "area", "beds")]
    )
    placed = rows.withColumn("place", _places(rows))
    asked = reps.withColumn("place", _asked_places())
    sizes = placed.groupBy("place").agg(F.count(F.lit(1)).alias("rows")).join(asked.select("place").distinct(), "place")
    sizes = cut_lineage(sizes.withColumn("parts", F.ceil(F.col("rows") / F.lit(BLOCK_ROWS)).cast("int")))
    places, met = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    parts = sizes.select("place", "parts")
    if places <= BROADCAST_MAX_ROWS:
        parts = F.broadcast(parts)
    block = lambda part: F.concat_ws(" ", part.cast("string"), "place").alias("block")
    # a search's centre and least values are in the columns of the listings' own
    limits = ("price_max", "area_max", "km", "km_per_lng", "km_per_lat")
    kept = [F.col(c) for c in ("purpose", "estate_type", "city", "district")]
    offered = placed.join(parts, "place").select(
        block(F.pmod(F.xxhash64("id"), F.col("parts"))), F.lit(False).alias("asks"), *kept, *[F.col(c) for c in ("lat", "lng", "price", "area", "beds")],
        *[F.lit(None).cast("double").alias(c) for c in limits], F.lit(None).cast(reps.schema["rep"].dataType).alias("rep"),
    )
    near = {"lat": "near_lat", "lng": "near_lng", "price": "price_min", "area": "area_min", "beds": "min_beds"}
    met_by = asked.join(parts, "place").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met_by = met_by.select(
        block(F.col("part")), F.lit(True).alias("asks"), *kept, *[F.col(c).alias(name) for name, c in near.items()], "price_max", "area_max",
        F.col("near_km").alias("km"), _km_per_lng(F.col("near_lat")).alias("km_per_lng"), F.lit(fv.KM_PER_DEGREE).alias("km_per_lat"), "rep",
    )
    tasks = max(listings.sparkSession.sparkContext.defaultParallelism, -(-4 * met // BLOCK_ROWS))
    dealt = offered.unionByName(met_by).repartition(tasks, "block")
    ordered = dealt.sortWithinPartitions("block", "asks", "purpose", "estate_type", "city", "district", "beds", "lat", "lng", "km")
    return ordered.mapInArrow(count_blocks, T.StructType([reps.schema["rep"], T.StructField("n", T.LongType())]))


def match_counts(listings: DataFrame, searches: DataFrame) -> DataFrame:
    """Matches per search, zero included, without a row per search and listing (see ``block_counts``)."""
    reps, members = _distinct(searches)
    counts = block_counts(listings, cut_lineage(reps)).groupBy("rep").agg(F.sum("n").alias("matches"))
    return members.join(counts, "rep", "left").select(
        "search_id", F.coalesce("matches", F.lit(0).cast("long")).alias("matches")
    )


_LISTING_COLUMNS = ("id", "lat", "lng", "price", "area", "beds", "estate_benefit", "estate_type", "city", "district", "last_update")
_MOST_PARTS = 64  # passes over a slice's listings at most
_FIRST_SLICES = (500, 4_000, 32_000)  # newest listings tried first; later slices are eight times as many
_CUT_ROWS = 20_000  # rows that choose the later cuts


def _cuts(listings: DataFrame) -> list[tuple[object, object]]:
    """(last_update, id) of the last listing of every slice but the last one. They share out the work and change no result."""
    rows, newest = listings.select("last_update", "id").filter("last_update IS NOT NULL"), (F.col("last_update").desc(), F.col("id"))
    total = rows.count()
    ranks = [n for n in _FIRST_SLICES if n < total]
    first = rows.orderBy(*newest).limit(ranks[-1]).withColumn("rank", F.row_number().over(Window.orderBy(*newest))) if ranks else None
    cuts = [(r.last_update, r.id) for r in first.filter(F.col("rank").isin(ranks)).orderBy("rank").collect()] if ranks else []
    later, n = [], _FIRST_SLICES[-1] * 8
    while n < total:
        later.append(n)
        n *= 8
    if later:
        every = max(1, total // _CUT_ROWS)
        marks = rows.filter(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).orderBy(*newest).collect()  # about _CUT_ROWS
        cuts += [(marks[n // every].last_update, marks[n // every].id) for n in later if n // every < len(marks)]
    return cuts


def _search_parts(by_shape: dict[str, int], limit: int) -> list[tuple[list[str], int, int]]:
    """(shapes, n, k): the searches of these shapes whose hash is k modulo n, so that a part has about ``limit`` keys at most."""
    parts, shapes, keys, limit = [], [], 0, max(1, limit)
    for shape, n in sorted(by_shape.items(), key=lambda x: x[1]):
        if n > limit:
            split = -(-5 * n // (4 * limit))  # hashed parts differ in size
            parts += [([shape], split, k) for k in range(split)]
            continue
        if keys + n > limit:
            parts.append((shapes, 1, 0))
            shapes, keys = [], 0
        shapes, keys = [*shapes, shape], keys + n
    return [*parts, (shapes, 1, 0)] if shapes else parts


def _hits(listings: DataFrame, reps: DataFrame, top: Callable[[DataFrame], DataFrame], last: bool, most: int | None) -> DataFrame:
    """The newest matches of a slice, written. Searches of too many keys for one broadcast come in parts, each with a broadcast of its own: the
    slice's listings are then written once as they are, and no row per listing and shape is ever shuffled."""
    by_shape = _keys_by_shape(reps)
    few = sum(by_shape.values()) <= BROADCAST_MAX_ROWS or most is not None
    parts = [] if few else _search_parts(by_shape, BROADCAST_MAX_ROWS)
    if few or len(parts) > _MOST_PARTS:
        return cut_lineage(top(_pairs(listings, reps, last, most)).drop("rank"))
    held, found = hand_over(listings.select(*_LISTING_COLUMNS), "slice"), None
    shaped = _key_lists(reps)
    for shapes, n, k in parts:
        part = shaped.filter(F.col("k_shape").isin(shapes) & (F.pmod(F.xxhash64("rep"), F.lit(n)) == k)).select(*reps.columns)
        hits = cut_lineage(top(_pairs(held, part, few=True)).drop("rank"))
        found = hits if found is None else found.unionByName(hits)
    discard(held)
    return found


def newest_matches(listings: DataFrame, searches: DataFrame, n: int = 10) -> DataFrame:
    """Top-n newest listings per search. Searches meet the newest listings first, in slices of growing size, and one that has
    n hits meets no older slice; a small slice needs no salts; so a broad search makes few pairs, and only narrow ones come to the last slice."""
    reps, members = _distinct(searches)
    asked = cut_lineage(reps)
    order = Window.partitionBy("rep").orderBy(F.col("last_update").desc(), F.col("id"))
    top = lambda pairs: pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)

    def within(cut: tuple[object, object]) -> Column:
        updated, id_ = (F.lit(v) for v in cut)
        return F.coalesce((F.col("last_update") > updated) | ((F.col("last_update") == updated) & (F.col("id") <= id_)), F.lit(False))

    found, earlier = None, F.lit(False)
    for i, cut in enumerate([*_cuts(listings), None]):
        until = within(cut) if cut else F.lit(True)
        most = _FIRST_SLICES[i] if cut and i < len(_FIRST_SLICES) else None
        hits = _hits(listings.filter(until & ~earlier), asked, top, cut is None, most)
        found = hits if found is None else found.unionByName(hits)
        if cut is None:
            break
        served = found.groupBy("rep").agg(F.count(F.lit(1)).alias("hits")).filter(F.col("hits") >= n)
        asked, earlier = cut_lineage(asked.join(served, "rep", "left_anti")), until
        if asked.isEmpty():
            break
    return members.join(top(found), "rep").select("search_id", "rank", "id", "price", "last_update")
