"""The offline build end to end: amenities, valuation, marts. Every hand-off is a written table,
so a lost executor or a restarted job repeats one stage, not the whole build."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from plotyard.functions.predicates import country_clip
from plotyard.operators import models, spatial
from plotyard.plans.marts import build_marts
from plotyard.sources import io


def enrich(listings: DataFrame, features: DataFrame, worship: DataFrame, folder: str) -> None:
    """Feature store and listing amenities."""
    spark = listings.sparkSession
    io.write_feature_store(spatial.category_features(features, worship), f"{folder}/poi_features")
    stored = io.read_feature_store(spark, f"{folder}/poi_features")
    index = spatial.build_index(spatial.to_objects(stored))
    pois = spatial.enrich_listings(listings.filter(country_clip()), index)
    io.write_mart(pois, f"{folder}/listing_pois")


def value(listings: DataFrame, folder: str, params: Mapping[str, object] | None = None) -> None:
    """Models with metadata and the out-of-fold estimates of both markets."""
    spark = listings.sparkSession
    rows = models.modelling_rows(listings)
    parts = []
    for market in ("built", "land"):
        estimates, fitted = models.value_market(rows, market, params)
        io.save_model(fitted.model, fitted.metadata(), f"{folder}/models/{market}", spark)
        parts.append(estimates)
    io.write_mart(parts[0].unionByName(parts[1]), f"{folder}/estimates")


def load_fitted(spark, folder: str, market: str) -> models.Fitted:
    model, meta = io.load_model(spark, f"{folder}/models/{market}")
    bounds = meta["interval"]
    return models.Fitted(
        market, model, tuple(meta["features"]), meta["categories"], meta["params"],
        (bounds["low"], bounds["high"]) if bounds else None, meta["metrics"],
    )


def build(
    listings: DataFrame, features: DataFrame, worship: DataFrame, folder: str,
    params: Mapping[str, object] | None = None, partitions: int = 200,
) -> None:
    spark = listings.sparkSession
    enrich(listings, features, worship, folder)
    value(listings, folder, params)
    build_marts(
        listings, spark.read.parquet(f"{folder}/listing_pois"),
        spark.read.parquet(f"{folder}/estimates"), f"{folder}/public", partitions,
    )
