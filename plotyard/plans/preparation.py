"""Preparation as one plan: raw parts of a scrape to the cleaned listings, then, once extracted values are merged in, to the model-ready
table and its sale and rental tables. Each hand-off is a published table (``io.write_table``), so a restarted job repeats one step."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotyard import fixed_values as fv
from plotyard.functions import text
from plotyard.operators import prepare, structural
from plotyard.sources import io


def cleaned(raw: DataFrame, pack: Mapping[str, str] | None = None) -> DataFrame:
    """One projection over the raw rows and a broadcast of the fixed category list: category split, plain coordinate names, cooling of
    rentals from their text, text flags with the seller's answer first, unusable street widths unknown, no scrape-only columns."""
    df = prepare.split_category(raw, prepare.category_dimension(raw.sparkSession))
    df = prepare.flatten_names(df)
    df = df.withColumn("ac", text.fill_ac(F.col("ac")))
    df = prepare.seller_over_text(prepare.with_text_flags(df, pack))
    df = prepare.drop_columns(df, [*fv.SCRAPE_ONLY_COLUMNS, *fv.UNUSED_TEXT_FLAGS])
    return prepare.fill_constant(prepare.null_unless_positive(df, "street_width"), {"daily_rentable": 0})


def model_table(listings: DataFrame, extractions: DataFrame) -> DataFrame:
    """Model-ready rows under their model names: structural nulls zeroed and flagged, rooms recovered, rows without the required values left out,
    both furnished answers merged, unit price added."""
    ready = structural.model_ready(listings, extractions)
    ready = prepare.require(ready, fv.REQUIRED_FOR_MODELS).drop("rooms", "rooms_na")
    return prepare.rename_for_model(prepare.with_unit_price(prepare.merge_furnished(ready)))


def prepare_listings(spark: SparkSession, parts: Sequence[str], folder: str, pack: Mapping[str, str] | None = None) -> DataFrame:
    """Merge part files by column name, clean them and publish ``listings``."""
    io.write_table(cleaned(io.read_parts(spark, *parts), pack), f"{folder}/listings")
    return io.read_table(spark, f"{folder}/listings")


def finish_listings(spark: SparkSession, folder: str, extractions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Publish ``model_ready``, ``sale`` and ``rental`` from the published listings; (sale, rental)."""
    io.write_table(model_table(io.read_table(spark, f"{folder}/listings"), extractions), f"{folder}/model_ready")
    split = prepare.split_purpose(io.read_table(spark, f"{folder}/model_ready"))
    for name, part in zip(("sale", "rental"), split):
        io.write_table(part.drop("id", "title", "content"), f"{folder}/{name}")
    return io.read_table(spark, f"{folder}/sale"), io.read_table(spark, f"{folder}/rental")
