import os

import pytest
from pyspark.sql import functions as F

from driver_queries import tables as T
from plotyard import fixed_values as fv
from plotyard.plans import offline
from plotyard.sources import io

SF_DIR = "/root/testdata/sf0.001"
QUICK = {"maxIter": 2, "maxDepth": 3, "stepSize": 0.3}


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are not here")
def test_build_writes_every_mart(spark, tmp_path):
    listings = T.listings(spark, SF_DIR).fillna({"beds": 0, "livings": 0, "wc": 0, "furnished": 0, "street_width": 0.0, "district": "none"})
    listings = listings.withColumn("rooms", F.col("beds") + F.col("livings")).withColumns(
        {f"{f}_na": F.lit(False) for f in ("beds", "livings", "wc", "furnished", "street_width")}
    )
    features = T.features(spark, SF_DIR)
    worship = features.filter(F.col("fclass").startswith("muslim"))
    folder = str(tmp_path / "build")
    offline.build(listings, features, worship, folder, QUICK, partitions=4)
    public = f"{folder}/public"
    marts = {n: spark.read.parquet(f"{public}/{n}") for n in ("map", "details", "districts", "district_prices")}
    inside = listings.filter(F.col("lat").between(*fv.COUNTRY_BBOX[:2]) & F.col("lng").between(*fv.COUNTRY_BBOX[2:])).count()
    assert marts["map"].count() == marts["details"].count() == inside
    assert marts["map"].filter("estimate is not null").count() > 0
    assert marts["districts"].filter("mean_dist_mosque_m is null").count() == 0
    assert marts["district_prices"].filter("listing_count < 5").count() == 0
    stats = io.read_json(spark, f"{public}/site-stats", "listings long, with_estimate long, cities long, districts long").first()
    assert stats["listings"] == inside
    fitted = offline.load_fitted(spark, folder, "land")
    assert fitted.interval[0] < fitted.interval[1] and "district" in fitted.features
