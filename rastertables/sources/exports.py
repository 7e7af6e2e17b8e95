"""Polygon exports: one GeoJSON file a scene, stored under its export key."""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rastertables.functions import names
from rastertables.sources.objects import folder_listing
from rastertables.storage import child_names, path_exists, publish, remove, replace_groups

EXPORT_SUFFIX = "_masks.geojson"
MERGED_SUFFIX = "_outlines.parquet"


def export_key(key: Column) -> Column:
    return F.concat(names.export_prefix(key), names.safe_source_name(key), F.lit(EXPORT_SUFFIX))


def merged_key(key: Column) -> Column:
    return F.concat(names.export_prefix(key), names.safe_source_name(key), F.lit(MERGED_SUFFIX))


def _ring_coordinates(rings: Column) -> Column:
    return F.transform(rings, lambda ring: F.transform(ring, lambda p: F.array(p["lon"], p["lat"])))


def polygon_features(polygons: DataFrame) -> DataFrame:
    """Feature text per polygon. Holes of a component follow its outer ring."""
    properties = F.struct(F.col("filename").alias("tile_id"), "mask_name", "fill_ratio")
    geometry = F.struct(F.lit("Polygon").alias("type"), _ring_coordinates(F.col("rings")).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry"))
    return polygons.select(
        export_key(F.col("scene_key")).alias("export_key"),
        F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature"))


def merged_rows(outlines: DataFrame) -> DataFrame:
    """United masks as vertex rows: one name for every part of a scene.

    A united mask may cover a whole scene, so its vertices stay rows and are never one value.
    """
    return outlines.select(
        merged_key(F.col("scene_key")).alias("export_key"), F.lit("mask").alias("name"),
        "component", "ring", "seq", "lon", "lat")


COLLECTION_START, COLLECTION_END = '{"type":"FeatureCollection","features":[', "]}"


def collection_lines(features: DataFrame) -> DataFrame:
    """(export_key, line): each scene's features as the lines of one FeatureCollection, in order.

    A scene's lines pass through one task as a sorted stream; they are never held together.
    """
    bounds = features.select("export_key").distinct().select("export_key", F.explode(F.array(
        F.struct(F.lit(0).alias("place"), F.lit(COLLECTION_START).alias("line")),
        F.struct(F.lit(2).alias("place"), F.lit(COLLECTION_END).alias("line")))).alias("e")).select("export_key", "e.place", "e.line")
    lines = bounds.unionByName(features.select("export_key", F.lit(1).alias("place"), F.col("feature").alias("line")))
    number = F.row_number().over(Window.partitionBy("export_key").orderBy("place", "line"))
    comma = F.when((F.col("place") == 1) & (number > 2), ",").otherwise("")
    return lines.withColumn("line", F.concat(comma, "line")).select("export_key", "line")


def export_polygons(features: DataFrame, path: str) -> None:
    """Store each scene's features as one GeoJSON file under its export key; a file stored before is replaced.

    Files are written to a hidden folder first, where Spark's commit leaves those of finished tasks only, and moved
    to their keys when all are complete. The driver moves one file a scene of this run.
    """
    spark = features.sparkSession
    staged = f"{path}/_staged-{uuid.uuid4().hex}"
    try:
        collection_lines(features).write.partitionBy("export_key").text(staged)
        for folder in child_names(spark, staged):
            if folder.startswith("export_key="):
                part, = [n for n in child_names(spark, f"{staged}/{folder}") if n.startswith("part-")]
                publish(spark, f"{staged}/{folder}/{part}", f"{path}/{unquote(folder.partition('=')[2])}")
    finally:
        remove(spark, staged)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(export_key, feature) of all files that export_polygons stored; a feature is a line, so large files are split."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "export_key string, feature string")
    place = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(
        F.substring_index(place, path.rstrip("/") + "/", -1).alias("export_key"), F.ltrim(F.col("value"), F.lit(",")).alias("feature"))
    return lines.where(~F.col("feature").isin(COLLECTION_START, COLLECTION_END))


def export_merged(rows: DataFrame, path: str) -> None:
    """Store the vertex rows of each scene under its export key; a scene stored before is replaced."""
    replace_groups(rows, "export_key").parquet(path)


def stored_exports(spark: SparkSession, path: str) -> DataFrame:
    """(export_key) of every file stored at a path; files are listed, not opened."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "export_key string")
    return folder_listing(spark, path).select(F.col("object_key").alias("export_key"))


def export_keys(polygons: DataFrame) -> DataFrame:
    """Key of the export of every scene that has polygons."""
    scenes = polygons.select(F.col("scene_key").alias("object_key")).distinct()
    return scenes.select("object_key", export_key(F.col("object_key")).alias("export_key"))

