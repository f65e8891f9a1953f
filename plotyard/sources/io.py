"""Reads and writes: typed Parquet, part merging, features, marts, JSON, checkpoints, guards."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotyard import fixed_values as fv
from plotyard.session import discard, hand_over

FEATURE_SCHEMA = (
    "feature_id long, fclass string, kind string, rings array<array<struct<lng:double,lat:double>>>"
)


class GuardError(ValueError):
    """A write was refused because the data broke an invariant."""


# --- reads ---------------------------------------------------------------------------------


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Typed scan: with a schema no file footer is read for inference."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def read_parts(spark: SparkSession, *paths: str) -> DataFrame:
    """Parts whose columns may differ: matched by name, absent ones NULL."""
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def union_by_name(first: DataFrame, *others: DataFrame) -> DataFrame:
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def merge_parts(spark: SparkSession, source: str, target: str) -> None:
    """Many part files to one table."""
    spark.read.parquet(source).write.mode("overwrite").parquet(target)


def copy_table(spark: SparkSession, source: str, target: str) -> None:
    spark.read.parquet(source).write.mode("overwrite").option("compression", "zstd").parquet(target)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_database(
    spark: SparkSession, url: str, table: str, key: str, bounds: tuple[int, int],
    partitions: int, **options: str,
) -> DataFrame:
    """Database table read in parallel ranges of a numeric key (the driver jar is the caller's)."""
    reader = spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=key, lowerBound=str(bounds[0]),
        upperBound=str(bounds[1]), numPartitions=str(partitions), **options,
    )
    return reader.load()


_PART = "struct<type:string, coordinates:string, geometries:string>"
_NESTING = 4  # levels of collections within collections that are opened
GEOMETRIES = ("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon")


def geometry_parts(geometry: Column) -> Column:
    """A GeoJSON geometry (type, coordinates and geometries as text) as an array of geometries that are no collections."""
    parts = F.when(geometry["type"].isNotNull(), F.array(geometry)).otherwise(F.from_json(F.lit("[]"), f"array<{_PART}>"))

    def opened(p: Column) -> Column:
        inner = F.coalesce(F.from_json(p["geometries"], f"array<{_PART}>"), F.from_json(F.lit("[]"), f"array<{_PART}>"))
        return F.when(p["type"] == "GeometryCollection", inner).otherwise(F.array(p))

    for _ in range(_NESTING):
        parts = F.flatten(F.transform(parts, opened))
    return parts


def part_rings(part: Column) -> Column:
    """Rings of (lng, lat) of one geometry. A line is a ring that goes there and back, so it has no inside: whatever crosses it
    crosses it twice; a point is a ring of one vertex. NULL for a type that is none of ``GEOMETRIES``."""
    kind, text = part["type"], part["coordinates"]
    points, lines = "array<array<double>>", "array<array<array<double>>>"

    def ring(given: Column) -> Column:
        return F.transform(given, lambda p: F.struct(p[0].alias("lng"), p[1].alias("lat")))

    def there_and_back(line: Column) -> Column:
        return ring(F.when(F.size(line) > 1, F.concat(line, F.reverse(F.slice(line, 1, F.size(line) - 1)))).otherwise(line))

    return (
        F.when(kind == "Point", F.array(ring(F.array(F.from_json(text, "array<double>")))))
        .when(kind == "MultiPoint", F.transform(F.from_json(text, points), lambda p: ring(F.array(p))))
        .when(kind == "LineString", F.array(there_and_back(F.from_json(text, points))))
        .when(kind == "MultiLineString", F.transform(F.from_json(text, lines), there_and_back))
        .when(kind == "Polygon", F.transform(F.from_json(text, lines), ring))
        .when(kind == "MultiPolygon", F.transform(F.flatten(F.from_json(text, f"array<{lines}>")), ring))
    )


def read_features(spark: SparkSession, layers: Mapping[str, str], refuse_unknown: bool = True) -> DataFrame:
    """Feature layers as newline-delimited GeoJSON, class and geometry only.

    ``layers`` maps a layer name to a path; a missing one is an error. Geometries of all kinds, collections too, become rings of
    (lng, lat) (see ``part_rings``); ``kind`` is ``point``, ``line`` or ``area``, the last for mixed ones. The id is made from the
    layer and the content. Features with a geometry of an unknown type are counted and refused before anything is returned; with
    ``refuse_unknown`` off they have no rings. A feature without a geometry has none either.
    """
    shape = f"properties struct<fclass:string>, geometry {_PART}"
    frames = []
    for name, path in layers.items():
        try:
            frames.append(spark.read.schema(shape).json(path).withColumn("layer", F.lit(name)))
        except AnalysisException as error:
            raise FileNotFoundError(f"missing feature layer {name}: {path}") from error
    raw = union_by_name(*frames).withColumn("parts", geometry_parts(F.col("geometry")))
    types = F.transform("parts", lambda p: p["type"])
    if refuse_unknown:
        strange = raw.select("layer", F.explode(F.array_distinct(types)).alias("type")).filter(~F.coalesce(F.col("type").isin(*GEOMETRIES), F.lit(False)))
        found = strange.groupBy("layer", "type").agg(F.count(F.lit(1)).alias("n")).orderBy("layer", "type").limit(20).collect()
        if found:
            raise GuardError("unknown geometries: " + ", ".join(f"{r['n']} x {r['type']} in {r['layer']}" for r in found))
    known = F.forall(types, lambda t: F.coalesce(t.isin(*GEOMETRIES), F.lit(False))) & (F.size("parts") > 0)
    lines = F.forall(types, lambda t: t.isin("LineString", "MultiLineString"))
    one_point = (F.size("parts") == 1) & (F.get(types, F.lit(0)) == "Point")
    content = F.coalesce("geometry.coordinates", "geometry.geometries")
    return raw.select(
        F.xxhash64("layer", "properties.fclass", content).alias("feature_id"),
        F.col("properties.fclass").alias("fclass"),
        F.when(one_point, "point").when(lines & known, "line").otherwise("area").alias("kind"),
        F.when(known, F.flatten(F.transform("parts", part_rings))).alias("rings"),
        "layer",
    )


# --- layouts and Parquet writes ------------------------------------------------------------


def cluster_spatially(df: DataFrame, partitions: int, per_degree: int = fv.GRID_PER_DEGREE) -> DataFrame:
    """Rows of a compact patch of the country next to each other, for row-group skipping. The id
    is part of the range, so one crowded patch is split over several partitions."""
    grid = [F.floor(F.col("lat") * per_degree), F.floor(F.col("lng") * per_degree)]
    return df.repartitionByRange(partitions, *grid, F.col("id")).sortWithinPartitions(*grid, "id")


def cluster_by_id(df: DataFrame, partitions: int) -> DataFrame:
    """Id order, so a point lookup touches one row group."""
    return df.repartitionByRange(partitions, "id").sortWithinPartitions("id")


def write_mart(
    df: DataFrame, path: str, row_group_rows: int | None = None, file_rows: int | None = None, lookup: Sequence[str] = ()
) -> None:
    """ZSTD Parquet with a chosen row-group size in rows, and Bloom filters on the columns that rows are looked up by: of the row groups
    whose smallest and largest value allow a value, only those are read that can hold it."""
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if row_group_rows:
        writer = writer.option("parquet.block.row.count.limit", str(row_group_rows))
    if file_rows:
        writer = writer.option("maxRecordsPerFile", file_rows)
    for column in lookup:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer = writer.option(f"parquet.bloom.filter.expected.ndv#{column}", str(row_group_rows or 1_000_000))
    writer.parquet(path)


def write_chunks(df: DataFrame, path: str, rows: int = fv.EXPORT_PART_ROWS) -> None:
    """Snappy Parquet in parts of at most ``rows`` rows."""
    df.write.mode("overwrite").option("compression", "snappy").option(
        "maxRecordsPerFile", rows
    ).parquet(path)


def write_feature_store(features: DataFrame, path: str) -> None:
    features.write.mode("overwrite").partitionBy("category").parquet(path)


def read_feature_store(spark: SparkSession, path: str, categories: Sequence[str] = ()) -> DataFrame:
    """Stored features; with categories given only their partitions are read."""
    features = spark.read.parquet(path)
    return features.filter(F.col("category").isin(*categories)) if categories else features


def append_checkpoint(df: DataFrame, path: str, schema: T.StructType) -> None:
    """Append with pinned types, so an all-NULL batch cannot change a part's schema."""
    pinned = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    pinned.write.mode("append").parquet(path)


def read_checkpoint(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Every part so far; an empty frame before the first one."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def register_marts(spark: SparkSession, folder: str, names: Sequence[str]) -> None:
    """Named views over mart files; nothing but footers is read until one is queried."""
    for name in names:
        spark.read.parquet(f"{folder}/{name}").createOrReplaceTempView(name)


# --- JSON ----------------------------------------------------------------------------------


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_framed(rows: DataFrame, order: Sequence[str], text: str, path: str, head: str, tail: str) -> None:
    """One document in parts: ``head``, the ``text`` of all rows in order with commas between them, ``tail``. The parts, put together by
    file name, are the document, so no task and no row holds more of it than its own. An empty table gives head and tail."""
    spark = rows.sparkSession
    ordered = rows.repartitionByRange(*order, text).sortWithinPartitions(*order, text)
    ordered = hand_over(ordered.select(F.monotonically_increasing_id().alias("at"), F.col(text).alias("value")), "framed-rows")
    ends = ordered.agg(F.min("at").alias("first"), F.max("at").alias("last")).first()
    if ends["first"] is None:
        lines = spark.createDataFrame([(head + tail,)], "value string").coalesce(1)
    else:
        before = F.when(F.col("at") == ends["first"], head).otherwise("")
        after = F.when(F.col("at") == ends["last"], tail).otherwise(",")
        lines = ordered.repartitionByRange("at").sortWithinPartitions("at").select(F.concat(before, "value", after).alias("value"))
    lines.write.mode("overwrite").text(path)
    discard(ordered)


def write_json_array(df: DataFrame, path: str, order: str) -> None:
    """The table as one JSON array, ordered by a column, in parts (see ``write_framed``)."""
    write_framed(df.select(F.col(order).alias("__o"), F.to_json(F.struct("*")).alias("__j")), ["__o"], "__j", path, "[", "]")


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of such an array, read in parallel: every line holds one of them and its share of the frame."""
    value = F.regexp_replace("value", r"^\[|[,\]]$", "")
    return spark.read.text(path).filter(F.length(value) > 0).select(F.from_json(value, schema).alias("r")).select("r.*")


def geojson_features(outlines: DataFrame, digits: int = 5) -> DataFrame:
    """One GeoJSON feature per outline, coordinates rounded to about a metre."""
    ring = F.transform("ring", lambda p: F.array(F.round(p["lng"], digits), F.round(p["lat"], digits)))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct("city", "district").alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
    )
    return outlines.select("city", "district", F.to_json(feature).alias("value"))


def write_geojson(outlines: DataFrame, path: str) -> None:
    """Newline-delimited features, written in parallel."""
    geojson_features(outlines).select("value").write.mode("overwrite").text(path)


def write_geojson_collection(outlines: DataFrame, path: str) -> None:
    """One FeatureCollection in parts (see ``write_framed``)."""
    write_framed(geojson_features(outlines), ["city", "district"], "value", path, '{"type":"FeatureCollection","features":[', "]}")


# --- guards --------------------------------------------------------------------------------


def check_no_overwrite(before: DataFrame, after: DataFrame, columns: Sequence[str], key: str = "id") -> None:
    """Refuse when a side repeats a key, a key appears on one side only, or an existing value was replaced."""
    for name, side in (("before", before), ("after", after)):
        if side.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count():
            raise GuardError(f"{key} is not unique in the table {name}")
    left = before.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__b_{c}") for c in columns], F.lit(1).alias("__b"))
    right = after.select(F.col(key).alias("__r"), *columns, F.lit(1).alias("__a"))
    joined = left.join(right, F.col("__k").eqNullSafe(F.col("__r")), "full")
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    overwritten = [
        F.count_if(both & F.col(f"__b_{c}").isNotNull() & ~F.col(f"__b_{c}").eqNullSafe(F.col(c))).alias(f"__o_{c}")
        for c in columns
    ]
    facts = joined.agg(
        F.count("__b").alias("before"), F.count("__a").alias("after"), F.count_if(both).alias("both"), *overwritten
    ).first()
    if not facts["before"] == facts["after"] == facts["both"]:
        raise GuardError(f"row count changed: {facts['before']} -> {facts['after']}, {facts['both']} in both")
    for c in columns:
        if facts[f"__o_{c}"]:
            raise GuardError(f"{facts[f'__o_{c}']} existing {c} values would be overwritten")


def guarded_write(
    before: DataFrame, after: DataFrame, path: str, columns: Sequence[str], key: str = "id"
) -> None:
    """Write ``after`` as a version of the table at ``path``, check the written rows, then publish it: what is checked is what is kept.
    ``before`` may read the table itself."""
    spark = after.sparkSession
    version = write_version(after, path)
    try:
        check_no_overwrite(before, spark.read.schema(after.schema).parquet(f"{path}/{version}"), columns, key)
        publish(spark, path, version)
    finally:
        if current_version(spark, path) != version:
            _delete(spark, f"{path}/{version}")


# --- versioned tables ------------------------------------------------------------------------
# A table is a folder of versions, each a Parquet folder of its own, and a one-line pointer to the one that counts. A version is
# written whole before the pointer moves, and moving it is one rename, so a reader or a job that starts after a crash finds the old table or the
# new one, never neither.

POINTER = "_current"


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _delete(spark: SparkSession, path: str) -> None:
    files, at = _hadoop(spark, path)
    files.delete(at, True)


def write_version(df: DataFrame, path: str) -> str:
    """Write ``df`` as a version of the table at ``path`` that nobody reads yet; its name."""
    version = f"version-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(f"{path}/{version}")
    return version


def current_version(spark: SparkSession, path: str) -> str | None:
    """The version that the pointer names; none before the first one is published."""
    files, at = _hadoop(spark, f"{path}/{POINTER}")
    if not files.exists(at):
        return None
    stream = files.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, version: str) -> None:
    """Let readers of ``path`` see ``version``: the pointer is written beside the old one and takes its place in one step."""
    files, staged = _hadoop(spark, f"{path}/{POINTER}-{uuid.uuid4().hex}")
    stream = files.create(staged)
    stream.write(bytearray(version.encode()))
    stream.close()
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(staged.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(staged, _hadoop(spark, f"{path}/{POINTER}")[1], options)


def write_table(df: DataFrame, path: str) -> None:
    """Replace the table at ``path``."""
    publish(df.sparkSession, path, write_version(df, path))


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """The published version; a reader keeps it while newer ones are published."""
    version = current_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"no published table at {path}")
    return read_parquet(spark, f"{path}/{version}", schema)


def prune_versions(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Remove all versions but the published one and, of the others, the ``keep - 1`` latest, which readers may still hold; how many went."""
    files, at = _hadoop(spark, path)
    held = [x for x in files.listStatus(at) if x.getPath().getName().startswith("version-")]
    published = current_version(spark, path)
    others = sorted((x for x in held if x.getPath().getName() != published), key=lambda x: -x.getModificationTime())
    for gone in others[max(0, keep - 1) :]:
        files.delete(gone.getPath(), True)
    return len(others[max(0, keep - 1) :])


# --- batches of a stream -----------------------------------------------------------------------


def append_batch(df: DataFrame, folder: str, batch: str, schema: T.StructType) -> None:
    """Results of one batch, in a folder of its own that a replay overwrites, and then its commit row: without that row the batch isn't read."""
    pinned = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    pinned.write.mode("overwrite").parquet(f"{folder}/batches/{batch}")
    commit_batch(df.sparkSession, folder, batch)


def commit_batch(spark: SparkSession, folder: str, batch: str) -> None:
    row = spark.createDataFrame([(batch,)], "batch string").coalesce(1)
    row.write.mode("overwrite").parquet(f"{folder}/commits/{batch}")


def read_batches(spark: SparkSession, folder: str, schema: T.StructType, without: str | None = None) -> DataFrame:
    """Rows of all committed batches but one, an empty frame before the first one."""
    commits, batches = _hadoop(spark, f"{folder}/commits")
    # a commit stands once Spark has put its success mark; one name per batch comes here
    names = [x.getPath().getName() for x in commits.listStatus(batches)] if commits.exists(batches) else []
    done = [n for n in names if n != without and commits.exists(_hadoop(spark, f"{folder}/commits/{n}/_SUCCESS")[1])]
    if not done:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{folder}/batches/{n}" for n in sorted(done)])


# --- model artefacts -----------------------------------------------------------------------


def save_model(model, metadata: Mapping[str, object], path: str, spark: SparkSession) -> None:
    """Fitted pipeline plus a one-row metadata table."""
    model.write().overwrite().save(f"{path}/model")
    row = [(json.dumps(metadata, ensure_ascii=False),)]
    spark.createDataFrame(row, "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_model(spark: SparkSession, path: str):
    from pyspark.ml import PipelineModel

    try:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        return PipelineModel.load(f"{path}/model"), meta
    except AnalysisException as error:
        raise FileNotFoundError(f"no saved model under {path}") from error
