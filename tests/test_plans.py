import pandas as pd
import pytest
from pyspark.sql import functions as F

from plotyard.plans import extraction, preparation
from plotyard.sources import io

RAW = (
    "id long, category int, title string, content string, price double, area double, beds int, livings int, wc int, age int, "
    "street_width double, furnished int, ac double, ketchen double, daily_rentable int, city string, district string, city_id long, "
    "district_id long, `location.lat` double, `location.lng` double, uri string"
)


def _raw(spark):
    base = (500000.0, 250.0, 3, 1, 2, 4, 15.0, 0, None, None, None, "c", "d", 1, 2, 24.0, 46.0, "u")
    rows = [
        (1, 3, "فيلا", "مسبح و مكيفات", *base),
        (2, 1, "شقة", "بدون مسبح", *base[:6], 0.0, *base[7:]),  # a street width of 0 is unknown; a rental without a word on cooling
        (3, 2, "ارض", "زاوية", *base[:2], None, None, None, None, 20.0, None, *base[8:]),
        (4, 99, "?", "?", *base),
        (5, 6, "شقة مفروشة", "مفروشه", *base),
    ]
    return spark.createDataFrame(rows, RAW)


def test_raw_parts_become_sale_and_rental_tables(spark, tmp_path):
    folder = str(tmp_path)
    raw = _raw(spark)
    raw.filter("id <= 2").drop("uri").write.parquet(f"{folder}/a")
    raw.filter("id > 2").write.parquet(f"{folder}/b")
    listings = {r["id"]: r for r in preparation.prepare_listings(spark, [f"{folder}/a", f"{folder}/b"], folder).collect()}
    assert len(listings) == 5 and not {"uri", "category", "ac", "f_roof", "location.lat"} & set(listings[1].asDict())
    assert (listings[1]["estate_type"], listings[1]["estate_benefit"], listings[1]["f_pool"], listings[1]["f_ac"]) == ("villa", "sell", 1, 1)
    assert (listings[2]["f_pool"], listings[2]["f_ac"], listings[2]["street_width"], listings[2]["daily_rentable"]) == (0, 0, None, 0)
    assert listings[4]["estate_type"] is None and listings[1]["lat"] == 24.0
    none = spark.createDataFrame([], "id long, rooms_value long, rooms_status string")
    sale, rental = preparation.finish_listings(spark, folder, none)
    sold = {r["estate_type"]: r for r in sale.collect()}
    assert set(sold) == {"villa", "land", "apartment"} and sold["apartment"]["is_furnished"] == 1 and sold["villa"]["is_furnished"] == 0
    assert (sold["land"]["bedrooms"], sold["land"]["bedrooms_missing"], sold["villa"]["has_pool"]) == (0, True, 1)
    assert [r["street_width_m"] for r in rental.collect()] == [0.0]  # an apartment's street has no width of its own
    assert not {"id", "title", "price_per_m2", "lat"} & set(sale.columns)
    # a second run publishes new versions and leaves one table
    preparation.prepare_listings(spark, [f"{folder}/a", f"{folder}/b"], folder)
    assert io.read_table(spark, f"{folder}/listings").count() == 5


def _reader(frame: pd.DataFrame) -> pd.DataFrame:
    """Finds what the text says of bathrooms; of living rooms it always says 9."""
    said = {"wc": lambda r: float(r.clean.split("wc=")[1][0]), "livings": lambda r: 9.0}
    return pd.DataFrame(
        [
            {"id": r.id, "field": f, "value": said[f](r) if f in said else None, "is_boolean": False, "evidence": [r.clean[:4]] if f in said else None,
             "failed": False, "attempt_count": 1, "latency_ms": 5}
            for r in frame.itertuples(index=False)
            for f in r.needed
        ]
    )


@pytest.mark.parametrize("again", [False, True])
def test_the_cycle_fills_only_fields_that_clear_their_gate(spark, tmp_path, again):
    rows = [(i, "apartment", 1, i % 4 if i % 5 else None, i % 7 if i % 3 else None, f"listing wc={i % 7} and more", 2, 0, 10.0) for i in range(60)]
    listings = spark.createDataFrame(rows, "id long, estate_type string, beds int, livings int, wc int, content string, age int, furnished int, street_width double")
    folder = str(tmp_path / "cycle")
    for _ in range(1 + again):  # a second cycle finds nothing to extract and gives the same
        merged, report = extraction.extraction_cycle(listings, _reader, folder, "m", 20)
    assert {r["field"] for r in report.filter("passed_gate").collect()} == {"wc"}
    got = {r["id"]: r for r in merged.collect()}
    assert len(got) == 60 and all(r["wc"] == i % 7 for i, r in got.items())
    assert {r["livings_extraction_status"] for i, r in got.items() if i % 5 == 0} == {"needs_human_review"}
    assert all(r["livings"] is None for i, r in got.items() if i % 5 == 0)
    assert io.read_table(spark, f"{folder}/gates").filter(F.col("field") == "wc").first()["passed_gate"]
