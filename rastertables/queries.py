"""Registered queries: every operator over the whole derived tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rastertables.fixtures import CLIPPED_GRID, FIRST_RUN, PARAMS, SAMPLE_CAP, Inputs, scene_key, task_key
from rastertables.functions import bbox, geojson, names, overlay
from rastertables.functions.bbox import Box
from rastertables.functions.crs import pixel_to_wgs84
from rastertables.operators import blocks, closing, components, grid, kernels, land, masks, raster, rings, zones
from rastertables.operators.blocks import SIZED_TILE, TILE
from rastertables.functions.worker import worker_name as running_worker
from rastertables.plans import catalog, scene_run
from rastertables.schemas import LOGS, TILES
from rastertables.sources import clustered, deltas, exports as polygon_exports, objects, state
from rastertables.storage import materialize, shared_folder
from rastertables.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(build: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    """Register a function of Inputs under its own name."""
    REGISTRY[build.__name__] = lambda spark, sf_dir: build(Inputs(spark, sf_dir))
    return build


def key() -> Column:
    return F.col("object_key")


# --- listings, notifications, uploads -------------------------------------------------


@query
def list_raw_objects(i: Inputs) -> DataFrame:
    return objects.list_raw_objects(i.listing)


@query
def filter_geotiff(i: Inputs) -> DataFrame:
    return objects.filter_geotiff(i.listing)


@query
def parse_notifications(i: Inputs) -> DataFrame:
    return objects.parse_notifications(i.notifications)


@query
def rejected_notifications(i: Inputs) -> DataFrame:
    return objects.rejected_notifications(i.notifications)


@query
def encode_notifications(i: Inputs) -> DataFrame:
    raw = objects.filter_geotiff(objects.list_raw_objects(i.listing))
    return objects.encode_notifications(raw)


@query
def new_uploads(i: Inputs) -> DataFrame:
    return objects.new_uploads(i.local_files, i.listing)


@query
def upload_actions(i: Inputs) -> DataFrame:
    flat = objects.list_raw_objects(i.listing).select(
        F.regexp_replace("object_key", "^raw/a/", "raw/").alias("object_key"))
    return objects.upload_actions(i.local_files, flat)


@query
def exports_by_source(i: Inputs) -> DataFrame:
    sources = i.scenes.select(F.col("scene_key").alias("source_object_key"))
    return objects.exports_by_source(i.exports(), sources)


# --- names, links, colours ------------------------------------------------------------


def _all_keys(i: Inputs) -> DataFrame:
    return i.listing.unionByName(i.table("pages").select(F.col("url").alias("object_key")))


@query
def source_names(i: Inputs) -> DataFrame:
    return _all_keys(i).select(
        "object_key", names.safe_source_name(key()).alias("safe_name"),
        names.source_label(key()).alias("label"), names.stem(key()).alias("stem"),
    )


@query
def extract_date(i: Inputs) -> DataFrame:
    return _all_keys(i).select("object_key", names.extract_date(key()).alias("date"))


@query
def percent_encode(i: Inputs) -> DataFrame:
    return _all_keys(i).select("object_key", names.percent_encode(key()).alias("encoded"))


@query
def api_urls(i: Inputs) -> DataFrame:
    return i.listing.select(
        "object_key", names.tiles_url(key()).alias("tiles_url"), names.outline_url(key()).alias("outline_url"),
        names.download_url(key()).alias("download_url"), names.object_url(key()).alias("object_url"),
        names.mask_url(names.mask_object_key(key()), F.lit("2d6a4f")).alias("mask_url"),
    )


@query
def sanitize_hex_color(i: Inputs) -> DataFrame:
    part = F.col("p_partkey")
    six = F.upper(F.lpad(F.hex(part * 7919 % 16777216), 6, "0"))
    raw = (
        F.when(part % 4 == 0, F.concat(F.lit(" ##"), six))
        .when(part % 4 == 1, F.concat(F.lit("#"), F.substring(six, 4, 3)))
        .when(part % 4 == 2, F.col("p_brand"))
    )
    return i.table("part").select(
        F.col("p_partkey").alias("part"), names.sanitize_hex_color(raw).alias("color"))


@query
def iso_timestamps(i: Inputs) -> DataFrame:
    return i.events.select("event_id", names.iso_timestamp(F.col("created_at")).alias("created_text")).unionByName(
        i.scene_catalog.select(F.col("scene_id").alias("event_id"), names.iso_timestamp(F.col("start_time")).alias("created_text")))


@query
def json_safe(i: Inputs) -> DataFrame:
    part = i.table("part").withColumn(
        "price", F.when(F.col("p_size") > 25, F.col("p_retailprice")).otherwise(F.lit(float("nan"))))
    return part.select("p_partkey", names.json_safe(F.col("price"), "double").alias("price"),
                       names.json_safe(F.col("p_name"), "string").alias("name"))


@query
def status_label(i: Inputs) -> DataFrame:
    return i.events.select("event_id", names.status_label(
        F.when(F.col("level").isNotNull(), F.col("status")),
        F.when(F.col("status") != "failed", F.col("stage")),
        F.col("progress_current"),
        F.when(F.col("progress_current") % 3 != 0, F.col("progress_total")).otherwise(0)).alias("label"))


# --- boxes and features ---------------------------------------------------------------


@query
def normalize_bbox(i: Inputs) -> DataFrame:
    return i.table("customer").select(
        "c_custkey", bbox.normalize_bbox(F.col("c_acctbal") / 77).alias("degrees"))


@query
def filled_corners(i: Inputs) -> DataFrame:
    return i.old_tiles().select("filename", *(c.alias(n) for n, c in bbox.filled_corners().items()))


@query
def tile_bbox(i: Inputs) -> DataFrame:
    return i.old_tiles().select("filename", *bbox.tile_bbox().columns())


@query
def padded_bounds(i: Inputs) -> DataFrame:
    grown = bbox.padded_bounds(bbox.tile_bbox(), 0.0015)
    return i.tiles.select("filename", *(F.round(c, 9).alias(n) for c, n in zip(
        (grown.west, grown.south, grown.east, grown.north), ("west", "south", "east", "north"))))


@query
def corner_delta(i: Inputs) -> DataFrame:
    c = F.col
    return i.tiles.select("filename", F.round(bbox.corner_delta(
        c("top_left_lon"), c("top_left_lat"), c("bottom_right_lon"), c("bottom_right_lat")), 9).alias("delta"))


@query
def bounds_polygon(i: Inputs) -> DataFrame:
    ring = F.posexplode(bbox.bounds_polygon(bbox.tile_bbox())).alias("seq", "p")
    return i.tiles.select("filename", ring).select("filename", "seq", "p.lon", "p.lat")


@query
def tile_feature(i: Inputs) -> DataFrame:
    feature = geojson.tile_features(i.old_tiles(), "#2D6A4F").select("feature.*")
    props, ring = F.col("properties"), F.col("geometry.coordinates")[0]
    return feature.select(
        props["filename"].alias("filename"), props["image_url"].alias("image_url"),
        props["mask_image_url"].alias("mask_image_url"),
        props["corners"]["top_right"][0].alias("top_right_lat"),
        props["bounds"][0][1].alias("west"), props["bounds"][1][0].alias("north"),
        F.round(props["image_bounds"][1][1], 9).alias("padded_east"),
        F.size(ring).alias("ring_points"), ring[2][0].alias("third_lon"), ring[4][1].alias("last_lat"),
    )


@query
def feature_collections(i: Inputs) -> DataFrame:
    return geojson.feature_collections(geojson.tile_features(i.old_tiles()), page=25)


@query
def feature_collection_pages(i: Inputs) -> DataFrame:
    pages = geojson.feature_collections(geojson.tile_features(i.old_tiles()), page=25)
    return pages.select(
        "source_object_key", "page", "features",
        F.get_json_object("geojson", "$.type").alias("type"),
        F.get_json_object("geojson", "$.meta.source").alias("source"),
        F.get_json_object("geojson", "$.features[0].properties.filename").alias("first_file"),
    )


@query
def overlay_colours(i: Inputs) -> DataFrame:
    color = names.sanitize_hex_color(F.lit("#9d4edd"))
    grey = F.col("grey")
    return _grey_cells(i).select(
        *TILE, "at", overlay.overlay_alpha(grey).alias("alpha"),
        *(overlay.channel(color, n).alias(c) for n, c in enumerate(("red", "green", "blue"))),
    )


# --- raster ---------------------------------------------------------------------------


@query
def valid_pixels(i: Inputs) -> DataFrame:
    return raster.valid_pixels(i.pixels)


@query
def assign_tiles(i: Inputs) -> DataFrame:
    return blocks.assign_tiles(i.pixels, i.scenes, CLIPPED_GRID.tile_size).drop("value")


def _cells(tiles: DataFrame, column: str, name: str) -> DataFrame:
    return tiles.select(*SIZED_TILE, F.posexplode(column).alias("at", name))


@query
def blocks_from_pixels(i: Inputs) -> DataFrame:
    tiles = blocks.blocks_from_pixels(i.pixels, i.scenes, CLIPPED_GRID.tile_size)
    return _cells(tiles, "band", "value")


@query
def tiles_from_chunks(i: Inputs) -> DataFrame:
    return _cells(blocks.tiles_from_chunks(i.chunks, i.scenes, CLIPPED_GRID.tile_size), "band", "value")


@query
def pixels_from_blocks(i: Inputs) -> DataFrame:
    return blocks.pixels_from_blocks(blocks.tiles_from_chunks(i.chunks, i.scenes, CLIPPED_GRID.tile_size))


@query
def tile_stats(i: Inputs) -> DataFrame:
    tiles = blocks.tiles_from_chunks(i.chunks, i.scenes, CLIPPED_GRID.tile_size)
    return raster.tile_stats(raster.blank_invalid(tiles)).drop("band").where(F.col("valid_count") > 0)


@query
def valid_tiles(i: Inputs) -> DataFrame:
    return i.kept().drop("band")


@query
def valid_tiles_clipped_grid(i: Inputs) -> DataFrame:
    return i.kept(CLIPPED_GRID).drop("band")


@query
def data_window(i: Inputs) -> DataFrame:
    """From the zone maps that are stored with the chunks."""
    return zones.zone_window(zones.chunk_zones(i.spark, i.stored_chunks()), i.scenes, CLIPPED_GRID)


@query
def chunk_zones(i: Inputs) -> DataFrame:
    return zones.chunk_zones(i.spark, i.stored_chunks()).drop("error")


@query
def filled_chunks(i: Inputs) -> DataFrame:
    """Cells of the chunks that a run reads."""
    return blocks.pixels_from_chunks(i.filled_chunks)


@query
def sample_contrast(i: Inputs) -> DataFrame:
    return raster.sample_contrast(i.kept(), SAMPLE_CAP)


@query
def contrast_bounds(i: Inputs) -> DataFrame:
    return i.bounds().select("scene_key", F.round("low", 12).alias("low"), F.round("high", 12).alias("high"))


@query
def scene_bounds(i: Inputs) -> DataFrame:
    """The bounds of a run: from the buckets of all valid cells."""
    tiles = blocks.tiles_from_chunks(i.chunks, i.scenes, PARAMS.tile_size)
    bounds = raster.scene_bounds(tiles, kernels.good_summaries(i.summaries(), PARAMS), PARAMS)
    return bounds.select("scene_key", F.round("low", 12).alias("low"), F.round("high", 12).alias("high"))


def _grey_cells(i: Inputs) -> DataFrame:
    return _cells(i.stretched(), "grey", "grey")


@query
def stretch(i: Inputs) -> DataFrame:
    return _grey_cells(i)


@query
def standardise_rgb(i: Inputs) -> DataFrame:
    channels = overlay.standardised(F.col("grey"))
    return _grey_cells(i).select(*TILE, "at", *(
        F.round(c, 9).alias(n) for c, n in zip(channels, ("red", "green", "blue"))))


@query
def drop_black_tiles(i: Inputs) -> DataFrame:
    return raster.drop_black_tiles(i.stretched()).select(*SIZED_TILE, F.array_max("grey").alias("grey_max"))


@query
def number_tiles(i: Inputs) -> DataFrame:
    return i.numbered().select(*TILE, "ordinal")


@query
def tile_names(i: Inputs) -> DataFrame:
    return i.numbered().select(
        *TILE, "filename", "mask_name", names.tile_object_key(F.col("filename")).alias("tile_key"),
        names.mask_object_key(F.col("mask_name")).alias("mask_key"))


@query
def tile_kind(i: Inputs) -> DataFrame:
    kinds = raster.tile_kind(i.kept())
    opaque = F.size(F.filter("alpha", lambda a: a == 255))
    return kinds.select(*SIZED_TILE, "partial", "extension", opaque.alias("opaque_cells"))


@query
def pixel_to_wgs84(i: Inputs) -> DataFrame:
    located = i.pixels.drop("value").join(i.scenes, "scene_key").withColumn(
        "point", raster.pixel_to_wgs84(F.col("px"), F.col("py")))
    return located.select("scene_key", "px", "py", F.round("point.lon", 9).alias("lon"),
                          F.round("point.lat", 9).alias("lat"))


@query
def tile_corners(i: Inputs) -> DataFrame:
    return i.build_tiles().drop("ordinal", "partial")


# --- keyed state ----------------------------------------------------------------------


def _first_run_tiles(i: Inputs) -> DataFrame:
    """Tiles of an earlier run with a stricter quality gate."""
    return i.stored("first_run_tiles", lambda: i.build_tiles(FIRST_RUN))


@query
def upsert_tiles(i: Inputs) -> DataFrame:
    day = lambda text: F.lit(text).cast("timestamp_ntz")
    current = _first_run_tiles(i).drop("ordinal", "partial").withColumn("created_at", day("2024-01-01"))
    updates = i.tiles.drop("ordinal", "partial").withColumn("created_at", day("2024-02-01"))
    merged = state.upsert_tiles(current, updates)
    return merged.withColumn("created_at", names.iso_timestamp(F.col("created_at")))


def tasks(i: Inputs) -> DataFrame:
    return state.reported_tasks(i.task_reports, ["reported_at", "event_id"])


def _task_text(df: DataFrame) -> DataFrame:
    return df.withColumns({c: names.iso_timestamp(F.col(c)) for c in ("created_at", "updated_at")})


@query
def reported_tasks(i: Inputs) -> DataFrame:
    return _task_text(tasks(i))


@query
def upsert_tasks(i: Inputs) -> DataFrame:
    order = ["reported_at", "event_id"]
    middle = F.lit("2024-01-15").cast("timestamp_ntz")
    early = state.reported_tasks(i.task_reports.where(F.col("reported_at") < middle), order)
    late = i.task_reports.where(F.col("reported_at") >= middle)
    return _task_text(state.upsert_tasks(early, late, order))


@query
def tile_deltas(i: Inputs) -> DataFrame:
    """Tiles of two runs stored as deltas, compacted and read back."""
    day = lambda text: F.lit(text).cast("timestamp_ntz")
    runs = [(_first_run_tiles(i), "2024-01-01"), (i.tiles, "2024-02-01")]
    runs = [state.newest_tiles(tiles).drop("ordinal", "partial").withColumn("created_at", day(at)) for tiles, at in runs]
    table = deltas.KeyedTable(_fresh_folder(i, "tile-deltas"), runs[0].schema, "filename", oldest=("created_at",))
    for number, rows in enumerate(runs):
        deltas.write_delta(rows, table, number)
        deltas.compact(i.spark, table, number, waiting=0)
    return deltas.read_state(i.spark, table).withColumn("created_at", names.iso_timestamp(F.col("created_at")))


@query
def task_deltas(i: Inputs) -> DataFrame:
    """Task reports stored as deltas of twelve batches in no order of time, compacted twice on the way."""
    order = ["reported_at", "event_id"]
    reports = i.task_reports.withColumn("batch", F.pmod(F.xxhash64("event_id"), F.lit(12)))
    table = None
    for number in range(12):
        rows = state.reported_tasks(reports.where(F.col("batch") == number).drop("batch"), order)
        table = table or deltas.KeyedTable(_fresh_folder(i, "task-deltas"), rows.schema, "object_key", order=("updated_at",), oldest=("created_at",))
        deltas.write_delta(rows, table, number)
        deltas.compact(i.spark, table, number + 1, waiting=5)
    return _task_text(deltas.read_state(i.spark, table))


@query
def prepare_log(i: Inputs) -> DataFrame:
    return state.prepare_log(i.events).select(
        "object_key", "worker_name", "stage", "level", "message", "progress_current", "progress_total",
        names.iso_timestamp(F.col("created_at")).alias("created_at"))


def markers(i: Inputs) -> DataFrame:
    """Markers of the finished tasks and of scene 03."""
    finished = tasks(i).where(F.col("status").isin("processed", "empty") | (F.col("object_key") == "raw/S1_IW_20240103.tif"))
    return state.build_markers(finished.select(
        "object_key", "status",
        F.array(F.concat(names.export_prefix(key()), names.safe_source_name(key()), F.lit("_masks.shp"))).alias("shapefile_keys"),
        F.col("updated_at").alias("processed_at")))


@query
def build_markers(i: Inputs) -> DataFrame:
    return markers(i)


@query
def parse_markers(i: Inputs) -> DataFrame:
    return state.parse_markers(markers(i)).withColumn("shapefile_keys", F.array_join("shapefile_keys", ","))


@query
def conform_schema(i: Inputs) -> DataFrame:
    narrow = i.tiles.select("filename", "source_object_key", "top_left_lon", "top_left_lat",
                            "bottom_right_lon", "bottom_right_lat", "mask_name")
    return state.conform_schema(narrow, TILES).drop("created_at")


# --- catalog and viewport queries -----------------------------------------------------


def _catalog(i: Inputs) -> DataFrame:
    return catalog.image_catalog(tasks(i), i.old_tiles())


@query
def image_catalog(i: Inputs) -> DataFrame:
    return _catalog(i).withColumn("updated_at", names.iso_timestamp(F.col("updated_at")))


@query
def order_catalog(i: Inputs) -> DataFrame:
    return catalog.order_catalog(_catalog(i)).drop("updated_at")


@query
def completed_keys(i: Inputs) -> DataFrame:
    return catalog.completed_keys(tasks(i))


@query
def pending_keys(i: Inputs) -> DataFrame:
    notified = objects.parse_notifications(i.notifications).withColumnRenamed("event_id", "position")
    listed = objects.list_raw_objects(i.listing)
    return catalog.in_pending_order(catalog.pending_keys(notified, listed, tasks(i), markers(i)))


@query
def all_tiles(i: Inputs) -> DataFrame:
    return catalog.all_tiles(i.tiles)


@query
def tiles_by_source(i: Inputs) -> DataFrame:
    return catalog.tiles_by_source(i.old_tiles(), "raw/S1_IW_20240104.tif")


@query
def sources_with_tiles(i: Inputs) -> DataFrame:
    return catalog.sources_with_tiles(i.tiles)


@query
def missing_exports(i: Inputs) -> DataFrame:
    return catalog.missing_exports(i.tiles, i.exports())


@query
def recent_tasks(i: Inputs) -> DataFrame:
    return _task_text(catalog.recent_tasks(tasks(i), 7))


def _logs(i: Inputs) -> DataFrame:
    return state.prepare_log(i.events)


@query
def recent_logs(i: Inputs) -> DataFrame:
    return catalog.recent_logs(_logs(i), 60).select(
        "object_key", "stage", "level", names.iso_timestamp(F.col("created_at")).alias("created_at"))


@query
def processing_overview(i: Inputs) -> DataFrame:
    return catalog.processing_overview(tasks(i), _logs(i), 500, 0)


@query
def tiles_in_viewport(i: Inputs) -> DataFrame:
    return catalog.tiles_in_viewport(
        i.old_tiles(), "raw/S1_IW_20240104.tif", 71.50004, 74.07, 71.53, 74.10001).select("filename")


@query
def clustered_tiles_in_view(i: Inputs) -> DataFrame:
    """Tiles of all scenes in one view, from the store along the curve; its layer is written twice."""
    tiles, path = i.old_tiles(), f"{shared_folder(i.spark)}/clustered-{uuid.uuid4().hex}"
    for _ in range(2):
        clustered.store_clustered(tiles, path, "first", file_rows=64)
    found = clustered.read_clustered(i.spark, path, tiles.schema, (71.50004, 74.07, 71.53, 74.10001))
    return found.select("source_object_key", "filename")


def _requests(i: Inputs) -> DataFrame:
    """Viewport requests: each third leaves a bound open."""
    return i.viewports.select(
        "view_id", scene_key(F.col("view_id") % 10 + 1).alias("source_object_key"),
        F.when(F.col("view_id") % 3 != 0, F.col("west")).alias("west"), "south", "east", "north")


@query
def tiles_in_viewports(i: Inputs) -> DataFrame:
    return catalog.tiles_in_viewports(i.old_tiles(), _requests(i))


@query
def images_in_viewport(i: Inputs) -> DataFrame:
    view = Box(*(F.lit(v) for v in (71.0, 73.6, 71.53, 74.5)))
    return catalog.images_in_viewport(_catalog(i), view).select("source_object_key", "in_view")


@query
def images_in_viewports(i: Inputs) -> DataFrame:
    return catalog.images_in_viewports(_catalog(i), i.viewports)


@query
def scene_search(i: Inputs) -> DataFrame:
    found = catalog.scene_search(i.scene_catalog, (60.0, 50.0, 90.0, 80.0), "1993-01-01", "1998-01-01", 12)
    return found.select("scene_id", names.iso_timestamp(F.col("start_time")).alias("start_time"), "west", "south")


@query
def download_names(i: Inputs) -> DataFrame:
    found = catalog.scene_search(i.scene_catalog, (60.0, 50.0, 90.0, 80.0), "1990-01-01", "2000-01-01", 12)
    return catalog.download_names(found).select("scene_id", "position", "filename")


@query
def run_summary(i: Inputs) -> DataFrame:
    return catalog.run_summary(_catalog(i))


# --- masks and land -------------------------------------------------------------------


@query
def segment_tiles(i: Inputs) -> DataFrame:
    return masks.mask_cells(i.build_masked())


def _mean_split(image: np.ndarray) -> np.ndarray:
    """Stand-in model on a coarser grid: brighter than the threshold, at every other cell."""
    return image[::2, ::2].astype("float64") - PARAMS.mask_threshold - 0.5


@query
def segment_with_model(i: Inputs) -> DataFrame:
    tiles = blocks.tiles_from_chunks(i.chunks, i.scenes, PARAMS.tile_size)
    bounded = raster.with_bounds(tiles, i.bounds())
    return masks.mask_cells(kernels.masked_tiles(bounded, PARAMS, lambda: _mean_split))


@query
def tile_summaries(i: Inputs) -> DataFrame:
    tiles = blocks.tiles_from_chunks(i.chunks, i.scenes, CLIPPED_GRID.tile_size)
    return kernels.good_summaries(kernels.tile_summaries(tiles, CLIPPED_GRID), CLIPPED_GRID).select(
        *SIZED_TILE, "total_count", "valid_count", "value_min", "value_max")


@query
def mask_fill(i: Inputs) -> DataFrame:
    return masks.mask_fill(i.masked).select(*TILE, "filled", F.round("fill_ratio", 9).alias("fill_ratio"))


@query
def filled_masks(i: Inputs) -> DataFrame:
    return masks.filled_masks(i.masked, PARAMS.min_fill_ratio).select(*TILE, "filled")


@query
def mask_runs(i: Inputs) -> DataFrame:
    return masks.run_rows(i.masked)


@query
def stored_masks(i: Inputs) -> DataFrame:
    share = F.col("l_discount") * 10
    alpha = masks.stored_alpha(share)
    return i.table("lineitem").select("l_orderkey", "l_linenumber", alpha.alias("alpha"), masks.is_set(alpha).alias("set"))


@query
def land_edges(i: Inputs) -> DataFrame:
    return i.land_edges


@query
def land_candidates(i: Inputs) -> DataFrame:
    return land.land_candidates(i.boxed_tiles(), i.land_edges)


def _span_cells(spans: DataFrame) -> DataFrame:
    return spans.select(*TILE, "row", F.explode(F.sequence("c0", "c1")).alias("col"))


@query
def rasterize_land(i: Inputs) -> DataFrame:
    return _span_cells(land.rasterize_land(i.boxed_tiles(), i.land_edges))


@query
def union_land(i: Inputs) -> DataFrame:
    merged = land.union_land(land.land_spans(i.boxed_tiles(), i.land_edges))
    return merged.groupBy(*TILE).agg(
        F.count(F.lit(1)).alias("spans"), F.sum(F.col("c1") - F.col("c0") + 1).alias("cells"))


@query
def clip_mask_to_water(i: Inputs) -> DataFrame:
    return masks.mask_cells(land.clip_mask_to_water(i.masked, i.boxed_tiles(), i.land_edges))


@query
def centre_land(i: Inputs) -> DataFrame:
    return _span_cells(land.centre_land_spans(i.boxed_tiles(), i.land_edges))


@query
def clip_polygons_to_water(i: Inputs) -> DataFrame:
    return masks.mask_cells(land.clip_polygons_to_water(i.masked, i.boxed_tiles(), i.land_edges))


# --- components, polygons, outlines ---------------------------------------------------


@query
def polygonize(i: Inputs) -> DataFrame:
    return components.polygonize(i.masked).drop("runs", "component")


def _polygons(i: Inputs) -> DataFrame:
    return components.located_polygons(i.masked, i.boxed_tiles())


@query
def polygon_area(i: Inputs) -> DataFrame:
    return _polygons(i).select(*TILE, "seed_row", "seed_col", "cells", F.round("area", 12).alias("area"))


@query
def large_polygons(i: Inputs) -> DataFrame:
    large = components.large_polygons(_polygons(i), PARAMS.min_area)
    return large.select("filename", "mask_name", "seed_row", "seed_col", "cells")


@query
def component_rings(i: Inputs) -> DataFrame:
    points = rings.ring_points(rings.component_rings(components.polygonize(i.masked)))
    sides = F.aggregate(F.sequence(F.lit(0), F.size("points") - 2), F.lit(0), lambda n, k: (
        n + F.abs(F.get("points", k)["x"] - F.get("points", k + 1)["x"])
        + F.abs(F.get("points", k)["y"] - F.get("points", k + 1)["y"])))
    return points.withColumn("sides", sides).groupBy(*TILE, "seed_row", "seed_col").agg(
        F.sum("sides").alias("perimeter"), (F.sum("double_area") / 2).cast("bigint").alias("cells"),
        F.count_if(F.col("double_area") > 0).alias("outer_rings"))


@query
def located_rings(i: Inputs) -> DataFrame:
    outlined = rings.located_rings(rings.component_rings(_polygons(i)))
    return outlined.select(*TILE, "seed_row", "seed_col", F.posexplode("rings").alias("ring", "points")).select(
        *TILE, "seed_row", "seed_col", "ring", F.posexplode("points").alias("seq", "p")).select(
        *TILE, "seed_row", "seed_col", "ring", "seq", "p.lon", "p.lat")


def _by_component(runs: DataFrame) -> DataFrame:
    return runs.groupBy("scene_key", "component").agg(
        F.sum(F.col("c1") - F.col("c0") + 1).alias("cells"), F.min("c0").alias("x_min"), F.max("c1").alias("x_max"),
        F.min("row").alias("y_min"), F.max("row").alias("y_max"))


@query
def merge_masks(i: Inputs) -> DataFrame:
    return _by_component(components.merge_masks(i.masked, i.scenes, PARAMS.tile_size))


@query
def merge_masks_closing_gaps(i: Inputs) -> DataFrame:
    return _by_component(components.merge_masks(i.masked, i.scenes, PARAMS.tile_size, gap=1))


def _ring_areas(outlines: DataFrame) -> DataFrame:
    """Twice the signed area inside the outlines of each component, and its outer rings."""
    numbered = outlines.select("scene_key", "component", "ring", "seq", "x", "y")
    pairs = Window.partitionBy("scene_key", "ring").orderBy("seq")
    stepped = numbered.select(
        "scene_key", "component", "ring", "x", "y",
        F.coalesce(F.lead("x").over(pairs), F.first("x").over(pairs)).alias("nx"),
        F.coalesce(F.lead("y").over(pairs), F.first("y").over(pairs)).alias("ny"))
    by_ring = stepped.groupBy("scene_key", "component", "ring").agg(
        F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y")).alias("twice"))
    return by_ring.groupBy("scene_key", "component").agg(
        (F.sum("twice") / 2).cast("bigint").alias("cells"), F.count_if(F.col("twice") > 0).alias("outer_rings"))


@query
def scene_outlines(i: Inputs) -> DataFrame:
    merged = components.merge_masks(i.masked, i.scenes, PARAMS.tile_size)
    return _ring_areas(rings.scene_outlines(merged))


@query
def merged_outlines(i: Inputs) -> DataFrame:
    polygons = components.large_polygons(_polygons(i), PARAMS.min_area)
    return scene_run.merged_outlines(polygons, i.scenes, replace(PARAMS, merge_masks=True, gap_cells=1))


@query
def close_gaps(i: Inputs) -> DataFrame:
    return _run_cells(closing.close_gaps(components.scene_runs(i.masked), 2))


@query
def close_gaps_by_degrees(i: Inputs) -> DataFrame:
    """Every scene by its own radii: systems in degrees, Mercator and UTM."""
    return _run_cells(closing.close_gaps(components.scene_runs(i.masked), closing.radii_in_cells(i.scenes, 0.0021)))


def _run_cells(runs: DataFrame) -> DataFrame:
    return runs.select("scene_key", F.col("row").alias("y"), F.explode(F.sequence("c0", "c1")).alias("x"))


@query
def validate_corners(i: Inputs) -> DataFrame:
    return grid.validate_corners(i.tiles)


@query
def validate_corners_other_rows(i: Inputs) -> DataFrame:
    """Tiles of every other grid row moved by a little: all seams along rows must show."""
    moved = F.when(F.col("tile_y") % 16 == 0, F.col("bottom_left_lat") + 0.000001).otherwise(F.col("bottom_left_lat"))
    return grid.validate_corners(i.tiles.withColumn("bottom_left_lat", moved))


@query
def footprint_sides(i: Inputs) -> DataFrame:
    return grid.footprint_sides(i.old_tiles()).drop("lon", "lat", "tile")


@query
def footprint_area(i: Inputs) -> DataFrame:
    return grid.footprint_area(i.tiles).withColumn("area", F.round("area", 9))


@query
def scene_footprint(i: Inputs) -> DataFrame:
    return grid.scene_footprint(i.old_tiles()).drop("tile")


@query
def footprint_rings(i: Inputs) -> DataFrame:
    """Enclosed grid area per scene from the ordered rings: outer rings minus holes."""
    ordered = grid.scene_footprint(i.old_tiles())
    after = ordered.select("source_object_key", "ring", (F.col("seq") - 1).alias("seq"),
                           F.col("ax").alias("nx"), F.col("ay").alias("ny"))
    stepped = ordered.join(after, ["source_object_key", "ring", "seq"], "left")
    start = F.first(F.when(F.col("seq") == 0, F.struct("ax", "ay")), ignorenulls=True)
    sums = stepped.groupBy("source_object_key", "ring").agg(
        F.sum(F.col("ax") * F.col("ny") - F.col("nx") * F.col("ay")).alias("open"),
        F.max_by(F.struct("ax", "ay"), "seq").alias("last"), start.alias("start"), F.count(F.lit(1)).alias("sides"))
    closing = F.col("last.ax") * F.col("start.ay") - F.col("start.ax") * F.col("last.ay")
    return sums.groupBy("source_object_key").agg(
        F.sum("sides").alias("sides"), (F.sum(F.col("open") + closing) / 2).cast("bigint").alias("grid_area"))


def _twice_area(ring: Column) -> Column:
    """Twice the signed area in degrees of a closed ring of (lon, lat) pairs."""
    return F.aggregate(F.sequence(F.lit(0), F.size(ring) - 2), F.lit(0.0), lambda total, k: total + (
        F.get(ring, k)[0] * F.get(ring, k + 1)[1] - F.get(ring, k + 1)[0] * F.get(ring, k)[1]))


@query
def footprint_features(i: Inputs) -> DataFrame:
    return grid.footprint_features(i.old_tiles())


@query
def footprint_parts(i: Inputs) -> DataFrame:
    """Polygons of each footprint text and the area inside them, holes taken off."""
    rings = "array<array<array<double>>>"
    text = F.col("feature")
    kind = F.get_json_object(text, "$.geometry.type")
    one = F.from_json(F.concat(F.lit('{"c":['), F.get_json_object(text, "$.geometry.coordinates"), F.lit("]}")), f"c array<{rings}>")["c"]
    many = F.from_json(F.concat(F.lit('{"c":'), F.get_json_object(text, "$.geometry.coordinates"), F.lit("}")), f"c array<{rings}>")["c"]
    parts = grid.footprint_features(i.old_tiles()).select("source_object_key", F.explode(F.when(kind == "Polygon", one).otherwise(many)).alias("rings"))
    area = F.abs(_twice_area(F.col("rings")[0])) - F.aggregate(
        F.slice("rings", 2, F.greatest(F.size("rings") - 1, F.lit(1))), F.lit(0.0), lambda total, ring: total + F.abs(_twice_area(ring)))
    return parts.groupBy("source_object_key").agg(F.count(F.lit(1)).alias("parts"), F.round(F.sum(area) / 2, 6).alias("area"))


# --- whole run ------------------------------------------------------------------------


def _run(i: Inputs, keys: DataFrame | None = None) -> scene_run.SceneRun:
    wanted = keys if keys is not None else i.scenes.select(F.col("scene_key").alias("object_key"))
    return scene_run.process_scenes(
        wanted, i.filled_chunks, i.scenes, i.land_edges, kernels.threshold_model(PARAMS.mask_threshold), PARAMS)


@query
def process_scenes(i: Inputs) -> DataFrame:
    run = _run(i)
    corner_names = [c for c in run.tiles.columns if c.endswith(("_lon", "_lat"))]
    return run.tiles.withColumns({c: F.round(c, 9) for c in corner_names})


@query
def processed_masks(i: Inputs) -> DataFrame:
    return masks.mask_cells(_run(i).masks)


@query
def processed_polygons(i: Inputs) -> DataFrame:
    return _run(i).polygons.select("filename", "mask_name", "seed_row", "seed_col", "cells",
                                   F.round("fill_ratio", 9).alias("fill_ratio"))


@query
def scene_status(i: Inputs) -> DataFrame:
    """All scenes, and the listed objects that are no raster of ours."""
    scenes = i.scenes.select(F.col("scene_key").alias("object_key"))
    keys = scenes.unionByName(objects.list_raw_objects(i.listing))
    return _run(i, keys).results.select("object_key", "status", "stage", "tile_count", "progress_total")


@query
def scene_status_with_failures(i: Inputs) -> DataFrame:
    """Scenes of an unknown reference system and with bands cut short fail alone; one lies on a polar grid."""
    polar, short = F.col("scene_key") == scene_key(F.lit(1)), F.col("scene_key") == scene_key(F.lit(3))
    placed = dict(zip("abcdef", (10.0, 0.0, -1000000.0, 0.0, -10.0, -1000000.0)))
    scenes = i.scenes.withColumns({
        "epsg": F.when(polar, 3413).when(F.col("epsg") == 3857, 2154).otherwise(F.col("epsg")),
        **{term: F.when(polar, value).otherwise(F.col(term)) for term, value in placed.items()}})
    chunks = i.filled_chunks.withColumn("band", F.when(short, F.slice("band", 1, 3)).otherwise(F.col("band")))
    run = scene_run.process_scenes(
        scenes.select(F.col("scene_key").alias("object_key")), chunks, scenes, i.land_edges, kernels.threshold_model(PARAMS.mask_threshold), PARAMS)
    arctic = run.tiles.groupBy(F.col("source_object_key").alias("object_key")).agg((F.min("bottom_left_lat") > 76).alias("is_arctic"))
    return run.results.join(arctic, "object_key", "left").select("object_key", "status", "stage", "level", "tile_count", "is_arctic")


@query
def polygon_features(i: Inputs) -> DataFrame:
    return polygon_exports.polygon_features(_run(i).polygons)


@query
def rebuild_exports(i: Inputs) -> DataFrame:
    run = _run(i)
    stored = i.exports().withColumn("export_key", F.regexp_replace("export_key", "shp$", "geojson"))
    _, reports = scene_run.rebuild_exports(run.tiles, run.masks, stored, i.land_edges, PARAMS)
    return reports


@query
def scan_events(i: Inputs) -> DataFrame:
    window = raster.data_window(i.summaries(), i.scenes, PARAMS)
    return scene_run.scan_events(i.kept(), window, i.bounds(), PARAMS).drop("message")


@query
def progress_events(i: Inputs) -> DataFrame:
    kept = materialize(i.stretched().select(*SIZED_TILE, (F.array_max("grey") == 0).alias("black")), "kept-tiles")
    return scene_run.progress_events(kept, F.col("black"), step=10)


@query
def run_events(i: Inputs) -> DataFrame:
    """Events of all kinds that a whole run leaves for the log."""
    return _run(i).events


@query
def worker_name_events(i: Inputs) -> DataFrame:
    """Every event has a worker, whichever it was."""
    named = i.events.select(running_worker(F.col("event_id")).alias("worker_name"))
    return named.agg(F.count("worker_name").alias("events"), F.count_if(F.length("worker_name") > 0).alias("named"))


@query
def worker_names(i: Inputs) -> DataFrame:
    named = i.events.select("event_id", running_worker(F.col("event_id")).alias("worker_name"))
    return named.groupBy("worker_name").agg(F.count(F.lit(1)).alias("events"))


# --- streams --------------------------------------------------------------------------


def _fresh_folder(i: Inputs, name: str) -> str:
    return f"{shared_folder(i.spark)}/{name}-{uuid.uuid4().hex}"


def _message_files(i: Inputs) -> str:
    folder = _fresh_folder(i, "messages")
    i.notifications.repartition(4, "event_id").select("value").write.text(folder)
    return folder


@query
def notification_stream(i: Inputs) -> DataFrame:
    out = _fresh_folder(i, "notified")
    parsed = objects.parse_notifications(streams.notification_stream(i.spark, _message_files(i), 1))
    writer = parsed.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return i.spark.read.schema(parsed.schema).parquet(out)


@query
def dedup_keys(i: Inputs) -> DataFrame:
    out = _fresh_folder(i, "distinct-keys")
    parsed = objects.parse_notifications(streams.notification_stream(i.spark, _message_files(i), 1))
    keys = streams.dedup_keys(parsed)
    writer = keys.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return i.spark.read.schema(keys.schema).parquet(out)


def _streamed(i: Inputs, rows: DataFrame) -> DataFrame:
    folder = _fresh_folder(i, "stream-input")
    rows.repartition(4, "event_id").write.parquet(folder)
    return i.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@query
def task_state_stream(i: Inputs) -> DataFrame:
    root = _fresh_folder(i, "task-state")
    reports = i.task_reports.withColumn("reported_at", F.col("reported_at").cast("timestamp"))
    streams.task_state_stream(_streamed(i, reports), root, root + "-checkpoint", ["reported_at", "event_id"]).awaitTermination()
    return _task_text(deltas.read_state(i.spark, streams.task_table(root)))


@query
def log_stream(i: Inputs) -> DataFrame:
    out = _fresh_folder(i, "log")
    stream = _streamed(i, i.events)
    streams.log_stream(stream, out, out + "-checkpoint").awaitTermination()
    logged = i.spark.read.schema(stream.schema).parquet(out)
    return logged.select(
        "object_key", "worker_name", "stage", "level", "message", "progress_current", "progress_total",
        names.iso_timestamp(F.col("created_at")).alias("created_at"))


def _ingested(i: Inputs) -> streams.IngestStore:
    store = streams.IngestStore(_fresh_folder(i, "ingest"))
    listed = i.scenes.select(F.col("scene_key").alias("object_key"))
    messages = streams.notification_stream(i.spark, _message_files(i), 2)
    streams.ingest_stream(
        messages, lambda: listed, lambda keys: _run(i, keys), store,
        rebuild=lambda tiles, masked, stored: scene_run.rebuild_exports(tiles, masked, stored, i.land_edges, PARAMS),
    ).awaitTermination()
    return store


@query
def ingest_stream(i: Inputs) -> DataFrame:
    store = _ingested(i)
    return deltas.read_state(i.spark, streams.task_table(store.path("tasks"))).select("object_key", "status", "stage", "progress_current")


@query
def retry_failed(i: Inputs) -> DataFrame:
    """Two quiet cycles over the listed scenes; in the first the rasters in web mercator are not there yet."""
    store = streams.IngestStore(_fresh_folder(i, "retry"))
    listed = i.scenes.select(F.col("scene_key").alias("object_key"))
    early = i.scenes.where(~F.col("epsg").eqNullSafe(3857))
    quiet = i.spark.createDataFrame([(None,)], "value string")
    for number, scenes in enumerate((early, i.scenes)):
        streams.ingest_batch(quiet, number, listed, lambda keys, scenes=scenes: scene_run.process_scenes(
            keys, i.filled_chunks, scenes, i.land_edges, kernels.threshold_model(PARAMS.mask_threshold), PARAMS), store)
    failures = i.spark.read.schema(LOGS).parquet(store.path("logs")).groupBy("object_key").agg(F.count_if(F.col("stage") == "failed").alias("failures"))
    tasks = deltas.read_state(i.spark, streams.task_table(store.path("tasks")))
    return tasks.join(failures, "object_key").select("object_key", "status", "stage", "progress_current", "failures")


@query
def ingested_exports(i: Inputs) -> DataFrame:
    """Features stored under each export key by the ingest loop."""
    return polygon_exports.read_features(i.spark, _ingested(i).path("exports")).groupBy("export_key").agg(F.count(F.lit(1)).alias("features"))


@query
def ingested_masks(i: Inputs) -> DataFrame:
    """Cells of the masks that the ingest loop keeps."""
    return masks.mask_cells(i.spark.read.parquet(_ingested(i).path("masks")))
