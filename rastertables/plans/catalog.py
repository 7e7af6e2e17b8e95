"""Catalog, viewport, search and progress queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rastertables import params as P
from rastertables.functions import bbox, names
from rastertables.functions.bbox import Box
from rastertables.operators.binning import bin_pairs


def tile_extents(tiles: DataFrame) -> DataFrame:
    """Tile count and box per scene; partial sums meet, never the tiles of a scene."""
    box = bbox.tile_bbox()
    return tiles.groupBy("source_object_key").agg(
        F.count(F.lit(1)).alias("tile_count"),
        F.min(box.west).alias("west"), F.min(box.south).alias("south"),
        F.max(box.east).alias("east"), F.max(box.north).alias("north"),
    )


def image_catalog(tasks: DataFrame, tiles: DataFrame) -> DataFrame:
    """Every scene known from a task or a tile, with its box and state.

    Both sides hold one row per scene before they meet, so the join never fans out.
    """
    progress = ("status", "updated_at", "stage", "progress_current", "progress_total", "details")
    state = tasks.groupBy(F.col("object_key").alias("source_object_key")).agg(
        *(F.max(c).alias(c) for c in progress)
    )
    return tile_extents(tiles).join(state, "source_object_key", "full").withColumns({
        "tile_count": F.coalesce("tile_count", F.lit(0).cast("bigint")),
        "status": F.coalesce("status", F.lit(P.UNKNOWN_STATUS)),
    })


def describe_catalog(catalog: DataFrame) -> DataFrame:
    """Catalog rows with names, date and links."""
    key = F.col("source_object_key")
    return catalog.withColumns({
        "id": names.safe_source_name(key),
        "source_label": names.source_label(key),
        "acquisition_date": names.extract_date(key),
        "updated_text": names.iso_timestamp(F.col("updated_at")),
        "tiles_url": names.tiles_url(key),
        "outline_url": names.outline_url(key),
        "download_url": names.download_url(key),
    })


def order_catalog(catalog: DataFrame) -> DataFrame:
    """Newest date first; the update time stands in for a missing date."""
    dated = F.coalesce("acquisition_date", "updated_text", F.lit(""))
    return describe_catalog(catalog).orderBy(
        dated.desc(), F.col("updated_at").desc_nulls_last(), "source_object_key"
    )


def completed_keys(tasks: DataFrame) -> DataFrame:
    return tasks.where(F.col("status").isin(*P.FINAL_STATUSES)).select("object_key")


def pending_keys(notifications: DataFrame, listing: DataFrame, tasks: DataFrame, markers: DataFrame) -> DataFrame:
    """Keys still to be processed, each with the place it was first seen at.

    Notified keys come before listed ones. `notifications` has a `position`; listings are in
    key order, so they need none.
    """
    notified = notifications.select("object_key", F.struct(
        F.lit(0).alias("origin"), F.col("position").cast("bigint").alias("position")).alias("seen"))
    listed = listing.select("object_key", F.struct(
        F.lit(1).alias("origin"), F.lit(0).cast("bigint").alias("position")).alias("seen"))
    first = notified.unionByName(listed).groupBy("object_key").agg(F.min("seen").alias("seen"))
    marked = first.withColumn("marker_key", names.marker_key(F.col("object_key")))
    return (
        marked.join(completed_keys(tasks), "object_key", "left_anti")
        .join(markers.select("marker_key"), "marker_key", "left_anti")
        .select("object_key", "seen.origin", "seen.position")
    )


def in_pending_order(pending: DataFrame) -> DataFrame:
    return pending.orderBy("origin", "position", "object_key")


def all_tiles(tiles: DataFrame) -> DataFrame:
    """All tiles in numbering order."""
    return tiles.orderBy("source_object_key", "ordinal")


def tiles_by_source(tiles: DataFrame, key: str) -> DataFrame:
    """Tiles of one scene in numbering order, old rows with their corners filled in."""
    return (
        tiles.where(F.col("source_object_key") == key)
        .withColumns(bbox.filled_corners()).orderBy("ordinal")
    )


def sources_with_tiles(tiles: DataFrame) -> DataFrame:
    return tiles.select("source_object_key").distinct().orderBy("source_object_key")


def missing_exports(tiles: DataFrame, exports: DataFrame, suffix: str = ".shp") -> DataFrame:
    """Scenes that have tiles but no main export file in their folder."""
    complete = exports.where(F.col("export_key").endswith(suffix)).select(
        F.regexp_extract("export_key", "^(" + P.EXPORT_PREFIX + "[^/]+/)", 1).alias("folder")
    )
    sources = tiles.select("source_object_key").distinct()
    return sources.withColumn("folder", names.export_prefix(F.col("source_object_key"))).join(
        complete, "folder", "left_anti"
    ).select("source_object_key")


def recent_tasks(tasks: DataFrame, n: int = 12) -> DataFrame:
    """Running tasks first, then the newest."""
    idle = F.when(F.col("status") == "processing", 0).otherwise(1)
    return tasks.orderBy(idle, F.col("updated_at").desc(), "object_key").limit(n)


def recent_logs(logs: DataFrame, n: int = 40) -> DataFrame:
    return logs.orderBy(F.col("created_at").desc(), "object_key").limit(n)


def processing_overview(tasks: DataFrame, logs: DataFrame, n: int = 12, m: int = 40) -> DataFrame:
    """Task and log rows of the progress panel in one frame; both limits are clamped."""
    clamp = lambda value, top: max(1, min(value, top))
    shown = ("object_key", "worker_name", "stage", "progress_current", "progress_total")
    task_rows = recent_tasks(tasks, clamp(n, 50)).select(
        F.lit("task").alias("kind"), *shown, F.col("status").alias("state"),
        F.col("details").alias("text"), names.iso_timestamp(F.col("updated_at")).alias("at"))
    log_rows = recent_logs(logs, clamp(m, 200)).select(
        F.lit("log").alias("kind"), *shown, F.col("level").alias("state"),
        F.col("message").alias("text"), names.iso_timestamp(F.col("created_at")).alias("at"))
    return task_rows.unionByName(log_rows)


def tiles_in_viewport(
    tiles: DataFrame, source: str, west: float | None = None, south: float | None = None,
    east: float | None = None, north: float | None = None,
) -> DataFrame:
    """Tiles of one scene that meet a view; a missing bound means all of them."""
    chosen = tiles.where(F.col("source_object_key") == source)
    if None in (west, south, east, north):
        return chosen
    view = Box(*(bbox.normalize_bbox(F.lit(float(v))) for v in (west, south, east, north)))
    return chosen.where(bbox.bounds_intersect(bbox.tile_bbox(), view))


def _has_bounds(box: Box) -> Column:
    return box.west.isNotNull() & box.south.isNotNull() & box.east.isNotNull() & box.north.isNotNull()


def tiles_in_viewports(tiles: DataFrame, views: DataFrame, bin_degrees: float = 0.05) -> DataFrame:
    """(view_id, filename) for many requests, each on one scene.

    Tiles and views meet by scene and degree cell, so only near pairs are formed. A view is cut to the
    extent of its scene first: it has no more cells than the scene, however large it is.
    """
    boxed = tiles.select("filename", "source_object_key", *bbox.tile_bbox().columns())
    sides = ("west", "south", "east", "north")
    asked = views.select("view_id", "source_object_key", *(bbox.normalize_bbox(F.col(s)).alias(s) for s in sides))
    open_views = asked.where(~_has_bounds(Box.of())).select("view_id", "source_object_key")
    everything = open_views.join(boxed.select("filename", "source_object_key"), "source_object_key")
    extents = boxed.groupBy("source_object_key").agg(
        F.min("west").alias("e_west"), F.min("south").alias("e_south"), F.max("east").alias("e_east"), F.max("north").alias("e_north"))
    met = asked.where(_has_bounds(Box.of())).join(extents, "source_object_key").where(
        bbox.bounds_intersect(Box.of(), Box.of("e_")))
    cut = met.select(
        "view_id", "source_object_key", F.greatest("west", "e_west").alias("west"), F.greatest("south", "e_south").alias("south"),
        F.least("east", "e_east").alias("east"), F.least("north", "e_north").alias("north"))
    near = bin_pairs(boxed, cut, bin_degrees, on=["source_object_key"])
    return near.select("view_id", "filename").unionByName(everything.select("view_id", "filename"))


def images_in_viewport(catalog: DataFrame, view: Box, pad: float = P.IMAGE_VIEW_PAD) -> DataFrame:
    """Catalog rows with a flag: does the scene meet the padded view."""
    meets = bbox.bounds_intersect(Box.of(), bbox.padded_bounds(view, pad))
    return catalog.withColumn("in_view", F.coalesce(meets, F.lit(False)))


def images_in_viewports(catalog: DataFrame, views: DataFrame, pad: float = P.IMAGE_VIEW_PAD, bin_degrees: float = 1.0) -> DataFrame:
    """(view_id, source_object_key) for many padded views."""
    padded = views.select("view_id", *bbox.padded_bounds(Box.of(), pad).columns())
    located = catalog.where(_has_bounds(Box.of())).select("source_object_key", *Box.of().columns())
    return bin_pairs(located, padded, bin_degrees).select("view_id", "source_object_key")


def scene_search(
    catalog: DataFrame, region: tuple[float, float, float, float], start: str, end: str, limit: int = 3,
    polarisation: str = "VV", mode: str = "IW",
) -> DataFrame:
    """Newest scenes that meet a region in a half-open range of dates."""
    asked = Box(*(F.lit(float(v)) for v in region))
    return (
        catalog.where(
            bbox.bounds_intersect(Box.of(), asked)
            & (F.col("start_time") >= F.lit(start).cast("timestamp_ntz"))
            & (F.col("start_time") < F.lit(end).cast("timestamp_ntz"))
            & F.array_contains("pols", polarisation)
            & (F.col("mode") == mode)
        )
        .orderBy(F.col("start_time").desc(), "scene_id").limit(limit)
    )


def download_names(found: DataFrame) -> DataFrame:
    """File names in result order. `found` is a limited search result."""
    position = F.row_number().over(Window.orderBy(F.col("start_time").desc(), "scene_id")) - 1
    return found.withColumn("position", position).withColumn(
        "filename",
        F.format_string("sentinel1_%s_%d.tif", F.date_format("start_time", "yyyyMMdd"), F.col("position")),
    )


def run_summary(results: DataFrame) -> DataFrame:
    """Scenes per status, and how many of them got at least one tile."""
    return results.groupBy("status").agg(
        F.count(F.lit(1)).alias("scenes"), F.count_if(F.col("tile_count") > 0).alias("with_tiles")
    )
