"""GeoJSON features and collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rastertables import params as P
from rastertables.functions import bbox, names

PAGE_FEATURES = 1000


def _pair(first: Column, second: Column) -> Column:
    return F.array(first, second)


def tile_feature(color: Column) -> Column:
    """Feature struct of a tile row: links, corners as [lat, lon], ring as [lon, lat]."""
    corners = bbox.filled_corners()
    box = bbox.tile_bbox(corners)
    grown = bbox.padded_bounds(box, P.RENDER_PADDING_RATIO)
    tile_key = names.tile_object_key(F.col("filename"))
    mask_key = names.mask_object_key(F.col("mask_name"))
    ring = [_pair(corners[f"{c}_lon"], corners[f"{c}_lat"]) for c in (*bbox.CORNERS, bbox.CORNERS[0])]
    properties = F.struct(
        "filename", "mask_name",
        names.object_url(tile_key).alias("image_url"),
        names.mask_url(mask_key, color).alias("mask_image_url"),
        F.struct(*(_pair(corners[f"{c}_lat"], corners[f"{c}_lon"]).alias(c) for c in bbox.CORNERS)).alias("corners"),
        F.array(_pair(box.south, box.west), _pair(box.north, box.east)).alias("bounds"),
        F.array(_pair(grown.south, grown.west), _pair(grown.north, grown.east)).alias("image_bounds"),
    )
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(F.array(*ring)).alias("coordinates"))
    return F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry"))


def tile_features(tiles: DataFrame, color: str = P.DEFAULT_MASK_COLOR) -> DataFrame:
    """One feature per row; the form that scales to any number of tiles."""
    feature = tile_feature(names.sanitize_hex_color(F.lit(color)))
    return tiles.select("source_object_key", "ordinal", feature.alias("feature"))


def feature_collections(features: DataFrame, view: bbox.Box | None = None, page: int = PAGE_FEATURES) -> DataFrame:
    """FeatureCollection texts per scene, in pages of a bounded number of features."""
    none = F.lit(None).cast("double")
    view = view or bbox.Box(none, none, none, none)
    paged = features.withColumn("page", F.floor(F.col("ordinal") / page))
    grouped = paged.groupBy("source_object_key", "page").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "feature"))).alias("rows")
    )
    meta = F.struct(
        F.col("source_object_key").alias("source"), F.struct(*view.columns()).alias("requested_bbox")
    )
    body = F.struct(
        F.lit("FeatureCollection").alias("type"),
        F.transform("rows", lambda r: r["feature"]).alias("features"), meta.alias("meta"),
    )
    return grouped.select(
        "source_object_key", "page", F.size("rows").alias("features"),
        F.to_json(body, {"ignoreNullFields": "false"}).alias("geojson"),
    )


def empty_collection(warning: str = "") -> Column:
    """Collection without features, with an optional warning."""
    fields = [F.lit("FeatureCollection").alias("type"), F.array().cast("array<string>").alias("features")]
    if warning:
        fields.append(F.struct(F.lit(warning).alias("warning")).alias("properties"))
    return F.to_json(F.struct(*fields))


def frame_features(df: DataFrame, geometry_col: str) -> DataFrame:
    """Features of any frame: JSON-safe properties; rows with no geometry are skipped."""
    properties = F.struct(*(
        names.json_safe(F.col(c), dtype).alias(c) for c, dtype in df.dtypes if c != geometry_col
    ))
    feature = F.struct(
        F.lit("Feature").alias("type"), properties.alias("properties"), F.col(geometry_col).alias("geometry")
    )
    return df.where(F.col(geometry_col).isNotNull()).select(
        F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature")
    )
