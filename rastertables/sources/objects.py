"""Object listings, uploads and notifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rastertables import params as P
from rastertables.functions import names
from rastertables.schemas import NOTIFICATION


def folder_listing(spark: SparkSession, root: str) -> DataFrame:
    """Keys of all files below a folder. Only paths are read, never the contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", "^file:/+", "/")
    return files.select(F.substring_index(path, root.rstrip("/") + "/", -1).alias("object_key"))


def list_raw_objects(listing: DataFrame, prefix: str = P.RAW_PREFIX) -> DataFrame:
    """Keys under a prefix without folder placeholders."""
    key = F.col("object_key")
    return listing.where(key.startswith(prefix) & ~key.endswith("/"))


def filter_geotiff(df: DataFrame, key_col: str = "object_key") -> DataFrame:
    return df.where(names.is_geotiff(F.col(key_col)))


def exports_by_source(listing: DataFrame, sources: DataFrame) -> DataFrame:
    """Export keys of each scene. A key belongs to the folder named like the scene."""
    folder = F.regexp_extract("export_key", "^(" + P.EXPORT_PREFIX + "[^/]+/)", 1)
    wanted = sources.select("source_object_key", names.export_prefix(F.col("source_object_key")).alias("folder"))
    return wanted.join(listing.withColumn("folder", folder), "folder").select("source_object_key", "export_key")


def new_uploads(local: DataFrame, existing: DataFrame, prefix: str = P.RAW_PREFIX) -> DataFrame:
    """GeoTIFF files of a folder tree whose key is not stored yet."""
    keyed = filter_geotiff(local, "relative_path").withColumn(
        "object_key", F.concat(F.lit(prefix), F.replace(F.col("relative_path"), F.lit("\\"), F.lit("/")))
    )
    return keyed.dropDuplicates(["object_key"]).join(
        existing.select("object_key"), "object_key", "left_anti"
    )


def upload_actions(local: DataFrame, existing: DataFrame, prefix: str = P.RAW_PREFIX) -> DataFrame:
    """GeoTIFF files of a watched flat folder: upload, or only notify when already stored."""
    filename = names.source_label(F.col("relative_path"))
    keyed = filter_geotiff(local, "relative_path").select(
        F.concat(F.lit(prefix), filename).alias("object_key"), filename.alias("filename")
    ).distinct()
    stored = existing.select("object_key").distinct().withColumn("stored", F.lit(True))
    return keyed.join(stored, "object_key", "left").select(
        "object_key", "filename",
        F.when(F.col("stored"), "notify_only").otherwise("upload").alias("action"),
    )


def encode_notifications(uploads: DataFrame, bucket: str = P.DEFAULT_BUCKET) -> DataFrame:
    """Queue messages, as JSON text."""
    filename = F.col("filename") if "filename" in uploads.columns else names.source_label(F.col("object_key"))
    message = F.struct(F.lit(bucket).alias("bucket"), F.col("object_key"), filename.alias("filename"))
    return uploads.select(F.to_json(message).alias("value"))


def _decoded(messages: DataFrame) -> DataFrame:
    value = F.col("value").cast("string")
    return messages.withColumn("message", F.from_json(value, NOTIFICATION, {"mode": "PERMISSIVE"}))


def _has_key() -> Column:
    return F.coalesce(F.col("message.object_key"), F.lit("")) != ""


def parse_notifications(messages: DataFrame) -> DataFrame:
    """Messages that name an object; other columns of the messages are kept."""
    others = [c for c in messages.columns if c != "value"]
    return _decoded(messages).where(_has_key()).select(*others, "message.bucket", "message.object_key", "message.filename")


def rejected_notifications(messages: DataFrame) -> DataFrame:
    """Messages that are not JSON or name no object."""
    return _decoded(messages).where(~_has_key()).drop("message")
