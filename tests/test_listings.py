import glob
import json
import math

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from plotyard.functions import pricing
from plotyard.functions.predicates import Bounds, Filters, Near, bounds_predicate, listing_predicate
from plotyard.operators import districts, metrics, models, prepare, searches, viewport
from plotyard.sources import io

LISTING = (
    "id long, lat double, lng double, price double, area double, beds int, estate_type string, estate_benefit string, "
    "city string, district string, last_update string"
)


@pytest.fixture(scope="module")
def listings(spark):
    rows = []
    for i in range(600):
        rows.append(
            (i, 24.0 + (i * 37 % 100) / 500, 46.0 + (i * 53 % 100) / 500, float(100_000 + i * 9_973 % 900_000),
             0.0 if i % 50 == 0 else float(50 + i * 7 % 400), i % 6 if i % 7 else None, ("villa", "land", "apartment")[i % 3],
             "rental" if i % 5 == 0 else "sell", "big" if i % 3 else "small", None if i % 41 == 0 else f"d{i % 4}", f"2024-01-{1 + i % 28:02d}")
        )
    return spark.createDataFrame(rows, LISTING).repartition(4)


def _plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "10000")
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_scan_and_columns_are_pruned(spark, listings, tmp_path):
    path = str(tmp_path / "map")
    io.write_mart(io.cluster_spatially(listings, 4), path, 100)
    stored = spark.read.parquet(path)
    filters = Filters(purpose="sell", price_min=1e5, near=Near(24.1, 46.1, 5))
    hits = stored.filter(bounds_predicate(Bounds(24.0, 46.0, 24.15, 46.15)) & listing_predicate(filters)).select("id")
    plan = _plan(hits)
    for pushed in ("GreaterThanOrEqual(lat,", "LessThanOrEqual(lng,", "EqualTo(estate_benefit,sell)", "GreaterThanOrEqual(price,"):
        assert pushed in plan
    assert "district" not in plan.split("ReadSchema")[1]
    assert "Python" not in plan
    assert "TakeOrderedAndProject" in _plan(viewport.newest_first(stored, 10))


def test_row_groups_have_the_chosen_size(spark, listings, tmp_path):
    path = str(tmp_path / "details")
    io.write_mart(io.cluster_by_id(listings, 1), path, 100)
    groups = [
        pq.ParquetFile(f).metadata.row_group(g).num_rows
        for f in glob.glob(f"{path}/*.parquet")
        for g in range(pq.ParquetFile(f).metadata.num_row_groups)
    ]
    assert sum(groups) == 600 and max(groups) <= 100 and len(groups) >= 6


def test_non_finite_parameters_are_ignored(listings):
    odd = Filters(price_min=math.nan, area_max=math.inf)
    assert listings.filter(listing_predicate(odd)).count() == 600


def test_pairs_with_a_missing_part_are_counted(spark, listings):
    stats = districts.site_stats(listings.withColumn("estimate", F.lit(None).cast("double"))).first()
    pairs = {(r["city"], r["district"]) for r in listings.select("city", "district").collect()}
    assert (stats["listings"], stats["with_estimate"], stats["districts"]) == (600, 0, len(pairs))


def test_filter_bounds_keep_null_districts_and_round(spark, listings):
    row = districts.filter_bounds(listings).first()
    assert row["estate_types"] == ["apartment", "land", "villa"] and row["purposes"] == ["rental", "sell"]
    assert [c["city"] for c in row["cities"]] == ["big", "small"]
    assert row["cities"][0]["districts"][-1] is None
    assert districts.districts_of(districts.filter_bounds(listings), "nowhere").first()["districts"] == []


def test_local_breaks_need_enough_districts(spark):
    prices = spark.createDataFrame(
        [("c", f"d{i}", "villa", "sell", float(100 * i)) for i in range(20)],
        "city string, district string, estate_type string, estate_benefit string, median_price_per_m2 double",
    )
    centres = spark.createDataFrame(
        [("c", f"d{i}", 20.0 + i, 40.0) for i in range(20)], "city string, district string, lat double, lng double"
    )
    national = districts.national_breaks(prices).first()["breaks"]
    seven = districts.visible_breaks(prices, centres, Bounds(19.5, 39.0, 26.5, 41.0)).first()
    eight = districts.visible_breaks(prices, centres, Bounds(19.5, 39.0, 27.5, 41.0)).first()
    assert (seven["visible"], seven["breaks"]) == (7, national)
    assert eight["visible"] == 8 and eight["breaks"] == [100.0, 300.0, 400.0, 600.0]


SEARCH = (
    "search_id long, purpose string, estate_type string, price_min double, price_max double, area_min double, area_max double, "
    "min_beds double, city string, district string, near_lat double, near_lng double, near_km double"
)


def _searches(spark):
    rows = [
        (1, None, None, None, None, None, None, None, None, None, None, None, None),
        (2, "sell", "villa", 2e5, 6e5, None, None, 2.0, "big", "d1", None, None, None),
        (3, "lease", "", math.nan, None, None, None, None, "small", None, None, None, None),
        (4, None, None, None, None, None, None, None, None, None, 24.1, 46.1, 5.0),
        (5, None, None, None, None, None, None, None, None, None, 24.1, 46.1, 7.0),
        (6, "rental", None, 9e5, 1e5, None, None, None, None, None, None, None, None),
        (7, None, None, None, 3e5, 100.0, 300.0, None, None, None, 24.1, 46.1, 10.0),
        (8, "sell", "villa", 2e5, 6e5, None, None, 2.0, "big", "d1", None, None, None),
        (9, None, None, 5e5, None, 120.0, None, None, None, None, None, None, None),
        (10, None, "land", None, None, None, 90.0, 3.0, None, None, 24.1, 46.1, 20.0),
    ]
    return spark.createDataFrame(rows, SEARCH)


def _matches(listing, s):
    purpose = s["purpose"] if s["purpose"] in ("sell", "rental") else None
    near = s["near_km"] in (1.0, 3.0, 5.0, 10.0, 20.0)
    price_min = None if s["price_min"] is not None and math.isnan(s["price_min"]) else s["price_min"]
    km = 111.19492664455873
    return (
        (purpose is None or listing["estate_benefit"] == purpose)
        and (not s["estate_type"] or listing["estate_type"] == s["estate_type"])
        and (price_min is None or listing["price"] >= price_min)
        and (s["price_max"] is None or listing["price"] <= s["price_max"])
        and (s["area_min"] is None or listing["area"] >= s["area_min"])
        and (s["area_max"] is None or listing["area"] <= s["area_max"])
        and (s["min_beds"] is None or (listing["beds"] is not None and listing["beds"] >= s["min_beds"]))
        and (s["city"] is None or listing["city"] == s["city"])
        and (s["district"] is None or listing["district"] == s["district"])
        and (not near or ((listing["lat"] - s["near_lat"]) * km) ** 2
             + ((listing["lng"] - s["near_lng"]) * km * math.cos(math.radians(s["near_lat"]))) ** 2 <= s["near_km"] ** 2)
    )


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_saved_searches_equal_the_full_comparison(spark, listings, monkeypatch, broadcast_rows):
    monkeypatch.setattr(searches, "BROADCAST_MAX_ROWS", broadcast_rows)
    saved = _searches(spark)
    rows = listings.collect()
    want = {s["search_id"]: sorted(r["id"] for r in rows if _matches(r, s)) for s in saved.collect()}
    counts = {r["search_id"]: r["matches"] for r in searches.match_counts(listings, saved).collect()}
    assert counts == {k: len(v) for k, v in want.items()}
    newest = searches.newest_matches(listings, saved, 3).collect()
    by_id = {r["id"]: r for r in rows}
    for sid, ids in want.items():
        order = sorted(ids, key=lambda i: i)
        order = sorted(order, key=lambda i: by_id[i]["last_update"], reverse=True)[:3]
        assert [r["id"] for r in sorted((x for x in newest if x["search_id"] == sid), key=lambda x: x["rank"])] == order


def test_newest_matches_write_no_search_keys_and_no_row_per_shape(spark, listings, monkeypatch):
    """Beyond one broadcast the searches of a slice come in parts; keys, some dozens a search, are never written."""
    saved, seen, cut, split, pairs = _searches(spark), [], searches.cut_lineage, searches._search_parts, searches._pairs
    rows = listings.collect()
    want = {s["search_id"]: {r["id"] for r in rows if _matches(r, s)} for s in saved.collect()}
    monkeypatch.setattr(searches, "BROADCAST_MAX_ROWS", 60)
    monkeypatch.setattr(searches, "_FIRST_SLICES", (5,))
    monkeypatch.setattr(searches, "cut_lineage", lambda df: seen.append(set(df.columns)) or cut(df))
    parts, plans = [], []
    monkeypatch.setattr(searches, "_search_parts", lambda *a: parts.append(split(*a)) or parts[-1])

    def planned(*a, **k):
        found = pairs(*a, **k)
        plans.append(found._jdf.queryExecution().optimizedPlan().toString())
        return found

    monkeypatch.setattr(searches, "_pairs", planned)
    newest = searches.newest_matches(listings, saved, 1_000).collect()
    got = {s: {r["id"] for r in newest if r["search_id"] == s} for s in want}
    assert got == want
    assert not any(c.startswith("k_") for columns in seen for c in columns)
    assert parts and all(1 < len(p) <= searches._MOST_PARTS for p in parts) and not any("k_salt" in p for p in plans)
    assert sorted(searches._search_parts({"a": 10, "b": 90, "c": 20}, 40)) == [(["a", "c"], 1, 0), (["b"], 3, 0), (["b"], 3, 1), (["b"], 3, 2)]


def test_counting_joins_grow_with_searches_and_listings(spark, listings):
    """Ten times the listings: the cube's rows stay, the listings opened at edges grow ten times, no pair is listed for whole bins."""
    saved = _searches(spark)
    many = listings.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("id", F.col("id") * 10 + F.col("__k")).drop("__k")
    one, ten = searches.counted_parts(listings, saved), searches.counted_parts(many, saved)
    assert one[0].count() == ten[0].count() and one[0].groupBy().sum("n").first()[0] * 10 == ten[0].groupBy().sum("n").first()[0]
    assert one[1].count() * 10 == ten[1].count() < many.count() * saved.count() / 10
    copies = saved.unionByName(saved.withColumn("search_id", F.col("search_id") + 100))
    assert searches.counted_parts(listings, copies)[0].count() == one[0].count()  # equal searches are counted once
    got = {r["search_id"]: r["matches"] for r in searches.match_counts(listings, copies).collect()}
    assert all(got[i] == got[i + 100] for i in range(1, 11))


def test_valuation_labels(spark):
    rows = [(100.0, 90.0, 110.0, 0.04, "sell"), (100.0, 90.0, 110.0, 0.055, "sell"), (100.0, 90.0, 110.0, -0.2, "sell"),
            (None, None, None, None, "rental"), (None, None, None, None, "sell")]
    df = spark.createDataFrame(rows, "e double, lo double, hi double, d double, p string")
    label = pricing.valuation_label(*[F.col(c) for c in ("e", "lo", "hi", "d", "p")])
    assert [r[0] for r in df.select(label).collect()] == ["inline", "above:6%", "below:20%", "none_rental", "none_out_of_range"]


def test_category_split_and_one_hot(spark):
    df = spark.createDataFrame([(1, 6), (2, 21), (3, 99)], "id long, category int")
    split = prepare.split_category(df, prepare.category_dimension(spark))
    got = {r["id"]: (r["estate_type"], r["estate_benefit"]) for r in split.collect()}
    assert got == {1: ("apartment", "sell"), 2: ("furnished_apartment", "rental"), 3: (None, None)}
    checks = {r["raised"]: r["listings"] for r in prepare.one_hot_check(prepare.one_hot(split.drop("category"))).collect()}
    assert checks == {1: 1, 0: 2}


def test_missing_layer_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="pois"):
        io.read_features(spark, {"pois": str(tmp_path / "absent")})


def test_accuracy_within_shares(spark):
    rows = [(math.log1p(100.0), math.log1p(p), 1.0) for p in (100.0, 109.0, 115.0, 150.0)]
    row = metrics.accuracy(spark.createDataFrame(rows, "true_log double, predicted_log double, scale double")).first()
    assert (row["within_10_pct"], row["within_20_pct"]) == (50.0, 75.0)
    assert row["MedAPE_pct"] == pytest.approx(12.0)


QUICK = {"maxIter": 2, "maxDepth": 3, "stepSize": 0.3}


def test_out_of_fold_covers_every_row_once_and_scoring_flags_unknown_places(spark, listings):
    flags = {f"f_{n}": F.lit(0) for n in ("corner", "investment", "near_masjid", "negotiable")}
    rows = models.modelling_rows(
        listings.fillna({"district": "none"}).withColumns({**flags, "street_width": F.lit(10.0)})
    )
    land = rows.filter("market = 'land'")
    predictions = models.out_of_fold(rows, "land", QUICK, folds=2)
    assert predictions.count() == predictions.select("id").distinct().count() == land.count()
    _, fitted = models.value_market(rows, "land", QUICK, folds=2)
    asked = spark.createDataFrame(
        [(1, "big", "d1", "land", 200.0, 24.0, 46.0), (2, "big", "unseen", "land", 200.0, None, None),
         (3, "big", "d1", "office", 200.0, None, None), (4, "big", "d1", "land", 0.0, None, None), (5, "big", "d1", "land", 10.0, 50.0, 46.0)],
        "request_id long, city string, district string, estate_type string, area_m2 double, lat double, lng double",
    )
    got = {r["request_id"]: r for r in models.score_described(asked, [fitted]).collect()}
    assert set(got) == {1, 2}
    assert (got[1]["unknown_district"], got[2]["unknown_district"], got[2]["unknown_city"]) == (False, True, False)
    assert got[1]["estimate_low"] <= got[1]["estimate"] * 1.001
    rejected = models.check_described(asked)[1]
    assert {r["request_id"]: r["reasons"] for r in rejected.collect()} == {3: ["type"], 4: ["area"], 5: ["position"]}


def test_serving_features_zero_and_flag(spark):
    df = spark.createDataFrame([(1, None, None)], "request_id long, bedrooms double, living_rooms double")
    row = models.serving_features(df, ("bedrooms", "bedrooms_missing", "living_rooms", "has_pool")).first()
    assert (row["bedrooms"], row["bedrooms_missing"], row["living_rooms"], row["has_pool"]) == (0.0, 1.0, None, 0.0)


def test_shuffled_column_is_a_permutation(listings):
    moved = models.shuffled(listings, "price", seed=5, bucket_rows=100).select("id", "price").collect()
    original = {r["id"]: r["price"] for r in listings.collect()}
    assert sorted(r["price"] for r in moved) == sorted(original.values())
    assert sum(r["price"] != original[r["id"]] for r in moved) > 500


def test_target_must_not_be_a_feature():
    with pytest.raises(ValueError, match="price"):
        models.assert_no_leakage(("area_m2", "price"))


def test_dotted_scrape_columns_are_dropped_by_exact_name(spark):
    df = spark.createDataFrame([(1, 24.0, 46.0, "x", 5)], "id long, `location.lat` double, `location.lng` double, `user.img` string, uri int")
    clean = prepare.flatten_names(prepare.drop_columns(df))
    assert clean.columns == ["id", "lat", "lng"]


def test_framed_json_of_many_parts_is_one_document(spark, tmp_path):
    rows = [(i, f'a "{i}"', None if i % 3 else i / 2) for i in range(997)]
    df = spark.createDataFrame(rows, "n long, name string, v double").repartition(7)
    whole = lambda p: "".join(f.read_text() for f in sorted(p.glob("part-*")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a table this small would be one part
    io.write_json_array(df, str(tmp_path / "array"), "n")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "array").glob("part-*"))) > 1
    got = json.loads(whole(tmp_path / "array"))
    assert [(r["n"], r["name"], r.get("v")) for r in got] == rows
    assert sorted(map(tuple, io.read_json_array(spark, str(tmp_path / "array"), df.schema).collect())) == rows
    io.write_json_array(df.limit(0), str(tmp_path / "none"), "n")
    assert json.loads(whole(tmp_path / "none")) == []
    ring = F.array(*(F.struct(F.lit(float(x)).alias("lng"), F.lit(float(y)).alias("lat")) for x, y in ((0, 0), (0, 1), (1, 1), (0, 0))))
    outlines = df.select(F.lit("c").alias("city"), F.col("name").alias("district"), ring.alias("ring"))
    io.write_geojson_collection(outlines, str(tmp_path / "geo"))
    geo = json.loads(whole(tmp_path / "geo"))
    assert geo["type"] == "FeatureCollection" and [f["properties"]["district"] for f in geo["features"]] == sorted(r[1] for r in rows)


def test_a_lookup_reads_one_row_group(spark, tmp_path):
    """Unsorted text keys: every row group's range allows the value, its Bloom filter only in one."""
    rows = spark.range(40_000).select(F.sha2(F.col("id").cast("string"), 256).alias("place"), "id")
    for name, lookup in (("plain", ()), ("filtered", ("place",))):
        io.write_mart(rows.coalesce(1), str(tmp_path / name), 4_000, lookup=lookup)
    read = {}
    for name in ("plain", "filtered"):
        found = spark.read.parquet(str(tmp_path / name)).filter(F.col("place") == F.sha2(F.lit("777"), 256))
        assert [r["id"] for r in found.collect()] == [777]
        plan = found._jdf.queryExecution().executedPlan()
        scan = plan.collectLeaves().head()
        read[name] = scan.metrics().apply("numOutputRows").value()
    assert read["plain"] == 40_000 and read["filtered"] <= 8_000


def test_newest_matches_make_few_pairs_and_none_is_missed(spark, monkeypatch):
    i = F.col("id")
    listings = spark.range(3000).select(
        "id", F.lit(24.0).alias("lat"), F.lit(46.0).alias("lng"), (i * 1.0 + 1).alias("price"), F.lit(100.0).alias("area"), F.lit(2).alias("beds"),
        F.lit("sell").alias("estate_benefit"), F.lit("villa").alias("estate_type"), F.lit("c").alias("city"), F.lit("d").alias("district"),
        F.when(i % 10 > 0, (i * 7919 % 40).cast("int")).alias("last_update"),
    )
    nothing = [F.lit(None).cast("string" if c in ("purpose", "estate_type", "city", "district") else "double").alias(c) for c in searches.CRITERIA if c != "price_min"]
    saved = spark.range(30).select(F.col("id").alias("search_id"), (F.col("id") * 103.0).alias("price_min"), *nothing)
    made, pairs = [], searches._pairs

    def counted(*args, **kwargs):
        made.append(pairs(*args, **kwargs).count())
        return pairs(*args, **kwargs)

    monkeypatch.setattr(searches, "_FIRST_SLICES", (20, 100))
    monkeypatch.setattr(searches, "_CUT_ROWS", 500)
    monkeypatch.setattr(searches, "_pairs", counted)
    got = {(r.search_id, r["rank"]): r.id for r in searches.newest_matches(listings, saved, 5).collect()}
    rows = sorted(((r.last_update is None, -(r.last_update or 0), r.id, r.price) for r in listings.collect()))
    wanted = {(k, j + 1): x[2] for k in range(30) for j, x in enumerate([x for x in rows if x[3] >= k * 103.0][:5])}
    assert got == wanted and len(made) > 2
    assert sum(made) < 3000  # all pairs are about 45,000
