"""The whole run over a batch of scenes, as one set of Spark jobs for all of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rastertables import params as P, schemas
from rastertables.functions import bbox, names
from rastertables.functions.crs import is_supported
from rastertables.operators import blocks, closing, components, grid, kernels, land, masks, raster, rings
from rastertables.operators.blocks import SIZED_TILE, TILE
from rastertables.operators.kernels import Predictor
from rastertables.operators.ranking import number_within
from rastertables.plans.catalog import missing_exports
from rastertables.sources.exports import EXPORT_SUFFIX, export_keys
from rastertables.storage import broadcast_if_small, materialize

# Stages and processor names of reports.
GEOTIFF_PROCESSOR = "geotiff_processor"
MASK_ASSEMBLER = "mask_assembler"
STAGE_SKIPPED = "validate_input"
STAGE_DONE = "completed"
STAGE_FAILED = "failed"
STAGE_SCAN = "scan_tiles"
STAGE_GENERATE = "generate_tiles"
STAGE_ASSEMBLE = "assemble_shapefile"
STAGE_VALIDATE = "validate_tile_corners"
STAGE_REBUILD = "rebuild_shapefile"


@dataclass(frozen=True)
class SceneRun:
    """Frames a run leaves behind; tiles, masks and polygons are written."""

    tiles: DataFrame
    masks: DataFrame
    polygons: DataFrame
    merged: DataFrame | None
    exports: DataFrame
    results: DataFrame
    events: DataFrame


def cut_tiles(
    chunks: DataFrame, scenes: DataFrame, load: Callable[[], Predictor], params: P.SceneParams
) -> tuple[DataFrame, DataFrame]:
    """Surviving tiles with their mask runs, and the tiles that failed with their error; written.

    First pass: statistics and value buckets of every tile. Then the values that decide the contrast of
    a scene, from the tiles that hold them. Last pass, over kept tiles only: stretch, segment. The
    cells stay in the row of their tile; what is written is small. Tiles that have to be cut from
    other chunks are written once, so that their cells are shuffled once.
    """
    located = scenes.where(is_supported(F.col("epsg")))
    tiles, as_stored = blocks.laid_out_tiles(chunks, located, params.tile_size)
    if not as_stored:
        tiles = materialize(tiles, "cut-cells")
    summaries = materialize(kernels.tile_summaries(tiles, params), "tile-summaries")
    kept = kernels.good_summaries(summaries, params)
    bounds = raster.scene_bounds(tiles, kept, params)
    wanted = tiles.join(broadcast_if_small(kept.select(*TILE)), TILE, "left_semi")
    cut = materialize(kernels.masked_tiles(raster.with_bounds(wanted, bounds), params, load), "cut-tiles")
    failed = summaries.where(F.col("error").isNotNull()).select(*TILE, "error").unionByName(
        cut.where(F.col("error").isNotNull()).select(*TILE, "error"))
    return cut.where(F.col("error").isNull()).drop("error"), failed


def scene_errors(failed: DataFrame, scenes: DataFrame) -> DataFrame:
    """(scene_key, error): why a scene cannot be finished, one row per such scene."""
    tiles = failed.groupBy("scene_key").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("tile_y", "tile_x", "error")).alias("first"))
    text = F.format_string("%d tiles failed, first at (%d, %d): %s", "n", "first.tile_x", "first.tile_y", "first.error")
    unknown = scenes.where(F.col("epsg").isNotNull() & ~is_supported(F.col("epsg")))
    return tiles.select("scene_key", text.alias("error")).unionByName(unknown.select(
        "scene_key", F.format_string("reference system EPSG:%d is not supported", "epsg").alias("error")))


def tile_table(cut: DataFrame, scenes: DataFrame) -> DataFrame:
    """Numbered, named and located tiles, with their box."""
    numbered = number_within(cut.drop("runs", "model_missing"), ["scene_key"], ["tile_y"], ["tile_x"], "ordinal")
    cornered = raster.tile_corners(raster.name_tiles(numbered), scenes)
    return cornered.select("*", *bbox.tile_bbox().columns())


def mask_polygons(
    masked: DataFrame, tiles: DataFrame, land_edges: DataFrame | None, params: P.SceneParams
) -> DataFrame:
    """Outlined polygons of well filled masks: cut at the coast, large enough, in degrees."""
    filled = masks.filled_masks(masked, params.min_fill_ratio).select(*SIZED_TILE, "runs", "fill_ratio")
    watered = land.clip_polygons_to_water(filled, tiles, land_edges)
    polygons = components.large_polygons(components.located_polygons(watered, tiles), params.min_area)
    return rings.located_rings(rings.component_rings(polygons)).drop("outlines")


def merged_outlines(polygons: DataFrame, scenes: DataFrame, params: P.SceneParams) -> DataFrame:
    """Outline rows of the united polygons of each scene, gaps closed by a radius in degrees or, without it, in cells."""
    gap = closing.radii_in_cells(scenes, params.gap_degrees) if params.gap_degrees > 0 else params.gap_cells
    united = components.merge_masks(
        polygons.select(*TILE, "runs"), scenes.select("scene_key", "width", "height"), params.tile_size, gap)
    return rings.located_outlines(rings.scene_outlines(united), scenes)


def stored_tiles(tiles: DataFrame) -> DataFrame:
    """Columns of the tiles table."""
    corner_names = [f"{c}_{a}" for c in bbox.CORNERS for a in ("lon", "lat")]
    return tiles.select(
        "filename", F.col("scene_key").alias("source_object_key"), *corner_names,
        "tile_x", "tile_y", "tile_width", "tile_height", "mask_name", "ordinal")


def process_scenes(
    keys: DataFrame, chunks: DataFrame, scenes: DataFrame, land_edges: DataFrame | None,
    load: Callable[[], Predictor], params: P.SceneParams = P.SceneParams(),
) -> SceneRun:
    """Run every key (object_key) through cutting, masking, checking and polygonising.

    `load` gives the predictor; each Python worker calls it once. What fails in one scene, be it its
    reference system, a band, the predictor or its corners, fails that scene alone.
    """
    wanted = keys.where(names.is_geotiff(F.col("object_key"))).select(F.col("object_key").alias("scene_key")).distinct()
    chosen = materialize(scenes.join(wanted, "scene_key", "left_semi"), "chosen-scenes")
    if chosen.limit(1).count() == 0:
        return _nothing_cut(keys, chosen)
    own_chunks = chunks.join(broadcast_if_small(chosen.select("scene_key")), "scene_key", "left_semi")

    cut, failed = cut_tiles(own_chunks, chosen, load, params)
    errors = materialize(scene_errors(failed, chosen), "scene-errors")
    cut = cut.join(broadcast_if_small(errors.select("scene_key")), "scene_key", "left_anti")
    located = materialize(tile_table(cut, chosen), "located-tiles")

    checked = grid.validate_corners(stored_tiles(located), params.corner_tolerance)
    checks = materialize(grid.with_examples(checked, stored_tiles(located), params.corner_tolerance), "corner-checks")
    sound = checks.where("consistent").select(F.col("source_object_key").alias("scene_key"))
    tiles = materialize(located.join(broadcast_if_small(sound), "scene_key", "left_semi"), "tiles")
    masked = materialize(land.clip_mask_to_water(cut.join(broadcast_if_small(sound), "scene_key", "left_semi").select(
        *SIZED_TILE, "runs"), tiles, land_edges), "masks")
    polygons = materialize(mask_polygons(masked, tiles, land_edges, params), "polygons")
    merged = merged_outlines(polygons, chosen, params) if params.merge_masks else None
    exports = export_keys(polygons)
    broken = checks.where("not consistent").select(F.col("source_object_key").alias("scene_key"), F.format_string(
        "%d of %d corners of neighbouring tiles disagree: %s", "mismatches", "checked", F.array_join("examples", "; ")).alias("error"))
    warnings = cut.where("model_missing").select("scene_key").distinct()
    results = scene_status(keys, chosen, tiles, errors.unionByName(broken), exports, warnings)
    events = run_events(stored_tiles(located), checks, polygons)
    return SceneRun(stored_tiles(tiles), masked, polygons, merged, exports, results, events)


STORED_TILES = T.StructType([
    *(f for f in schemas.TILES.fields if f.name != "created_at"), T.StructField("ordinal", T.IntegerType())])
MASKS = ("scene_key string, tile_x int, tile_y int, tile_width int, tile_height int, "
         "runs array<struct<row:int,c0:int,c1:int>>")
POLYGONS = ("scene_key string, filename string, mask_name string, fill_ratio double, cells bigint, area double, "
            "rings array<array<struct<lon:double,lat:double>>>")


EVENTS = "object_key string, stage string, level string, message string, progress_current int, progress_total int"


def _nothing_cut(keys: DataFrame, chosen: DataFrame) -> SceneRun:
    """A cycle in which no offered key has a raster, for example retries only."""
    empty = lambda schema: keys.sparkSession.createDataFrame([], schema)
    tiles, polygons = empty(STORED_TILES), empty(POLYGONS)
    results = scene_status(
        keys, chosen, tiles.withColumnRenamed("source_object_key", "scene_key"),
        empty("scene_key string, error string"), export_keys(polygons), empty("scene_key string"))
    return SceneRun(tiles, empty(MASKS), polygons, None, export_keys(polygons), results, empty(EVENTS))


def scene_status(
    keys: DataFrame, scenes: DataFrame, tiles: DataFrame, errors: DataFrame, exports: DataFrame, warnings: DataFrame
) -> DataFrame:
    """Final report per key: skipped, failed, empty or processed.

    `errors` has the reason of every scene that failed. `warnings` names scenes whose model could not be
    loaded: they are finished with empty masks, and `level` and the details tell so.
    """
    def of(frame: DataFrame, *columns) -> DataFrame:
        return frame.select(F.col("scene_key").alias("object_key"), *columns)

    counts = tiles.groupBy(F.col("scene_key").alias("object_key")).agg(F.count(F.lit(1)).cast("int").alias("tile_count"))
    files = exports.groupBy("object_key").agg(F.sort_array(F.collect_set("export_key")).alias("export_keys"))
    joined = (
        keys.select("object_key").distinct()
        .join(of(scenes, F.lit(True).alias("found")), "object_key", "left")
        .join(counts, "object_key", "left").join(of(errors, "error"), "object_key", "left")
        .join(of(warnings, F.lit(True).alias("no_model")), "object_key", "left").join(files, "object_key", "left")
    )
    count = F.coalesce("tile_count", F.lit(0))
    no_files = F.array().cast("array<string>")
    files_of = F.coalesce("export_keys", no_files)
    supported = names.is_geotiff(F.col("object_key"))
    status = (
        F.when(~supported, "skipped").when(F.col("found").isNull() | F.col("error").isNotNull(), "failed")
        .when(count == 0, "empty").otherwise("processed")
    )
    finished = F.col("status").isin("empty", "processed")
    done = F.format_string("Tiles created: %d. Export files: %d.", count, F.size(files_of))
    details = (
        F.when(F.col("status") == "skipped", "Skipped: only GeoTIFF files are supported.")
        .when(F.col("found").isNull(), "Processing failed: the source raster was not found.")
        .when(F.col("status") == "failed", F.concat(F.lit("Processing failed: "), F.col("error"), F.lit(".")))
        .when(F.col("no_model"), F.concat(F.lit("Model could not be loaded, masks are empty. "), done)).otherwise(done)
    )
    level = F.when(F.col("status") == "failed", "ERROR").when(F.col("no_model"), "WARNING").otherwise(P.DEFAULT_LEVEL)
    paths = F.when(F.size(files_of) > 0, F.array_join(files_of, ",")).otherwise(F.lit(P.PROCESSED_PREFIX))
    return joined.withColumn("status", status).select(
        "object_key", "status", F.lit(GEOTIFF_PROCESSOR).alias("processor_name"),
        F.when(F.col("status") == "skipped", STAGE_SKIPPED).when(F.col("status") == "failed", STAGE_FAILED)
        .otherwise(STAGE_DONE).alias("stage"),
        F.when(finished, count).alias("progress_current"), F.when(finished, count).alias("progress_total"),
        F.when(finished, paths).alias("result_path"), details.alias("details"), level.alias("level"),
        count.alias("tile_count"), files_of.alias("shapefile_keys"),
    )


def rebuild_exports(
    tiles: DataFrame, masked: DataFrame, exports: DataFrame, land_edges: DataFrame | None,
    params: P.SceneParams = P.SceneParams(),
) -> tuple[DataFrame, DataFrame]:
    """Polygons and reports of scenes that have tiles but no export yet.

    `tiles` is the stored table, `masked` the stored masks.
    """
    missing = missing_exports(tiles, exports, EXPORT_SUFFIX)
    keyed = tiles.join(missing, "source_object_key", "left_semi").withColumnRenamed("source_object_key", "scene_key")
    own = masked.join(missing.withColumnRenamed("source_object_key", "scene_key"), "scene_key", "left_semi")
    filled = grid.filled_grid(keyed.withColumnRenamed("scene_key", "source_object_key")).withColumnRenamed("source_object_key", "scene_key")
    boxed = filled.select("*", *bbox.tile_bbox().columns())
    polygons = materialize(mask_polygons(own, boxed, land_edges, params), "rebuilt-polygons")
    reports = export_keys(polygons).groupBy("object_key").agg(
        F.array_join(F.sort_array(F.collect_set("export_key")), ",").alias("result_path")
    ).select(
        "object_key", F.lit("processed").alias("status"), F.lit(MASK_ASSEMBLER).alias("processor_name"),
        F.lit(STAGE_REBUILD).alias("stage"), "result_path",
        F.lit("Export rebuilt from stored tiles and masks.").alias("details"))
    return polygons, reports


def scan_events(kept: DataFrame, window: DataFrame, bounds: DataFrame, params: P.SceneParams) -> DataFrame:
    """One event per scene after the first pass: kept tiles of scanned windows."""
    steps = lambda low, high: F.ceil((F.col(high) - F.col(low)) / params.tile_size)
    counted = kept.groupBy("scene_key").agg(F.count(F.lit(1)).cast("int").alias("progress_current"))
    scanned = window.select("scene_key", (steps("x_start", "x_stop") * steps("y_start", "y_stop")).cast("int").alias("progress_total"))
    message = F.format_string("Tiles kept: %d of %d. Contrast: %.4f..%.4f.", "progress_current", "progress_total", "low", "high")
    return counted.join(scanned, "scene_key").join(bounds, "scene_key").select(
        F.col("scene_key").alias("object_key"), F.lit(STAGE_SCAN).alias("stage"), message.alias("message"),
        "progress_current", "progress_total")


def progress_events(kept: DataFrame, is_black: Column, step: int = P.PROGRESS_STEP) -> DataFrame:
    """Events at the first, each `step`-th and the last kept tile; black tiles report nothing.

    `kept` holds tile rows without cells and is read several times.
    """
    numbered = number_within(kept, ["scene_key"], ["tile_y"], ["tile_x"], "index").withColumn(
        "progress_current", F.col("index") + 1)
    totals = kept.groupBy("scene_key").agg(F.count(F.lit(1)).cast("int").alias("progress_total"))
    due = (
        (F.col("progress_current") == 1) | (F.col("progress_current") % step == 0)
        | (F.col("progress_current") == F.col("progress_total"))
    )
    return numbered.join(totals, "scene_key").where(due & ~is_black).select(
        F.col("scene_key").alias("object_key"), F.lit(STAGE_GENERATE).alias("stage"),
        F.format_string("Tiles prepared: %d of %d.", "progress_current", "progress_total").alias("message"),
        "progress_current", "progress_total")


def run_events(tiles: DataFrame, checks: DataFrame, polygons: DataFrame, step: int = P.PROGRESS_STEP) -> DataFrame:
    """Events of a run as EVENTS: tiles prepared, corners checked, and the assembly of the polygons.

    `tiles` have ordinals, `checks` one row a scene. A scene whose corners disagree ends there with an error. The assembly has
    a start, progress at the first, each `step`-th and the last tile, and a warning where no polygon is left.
    """
    counted = tiles.groupBy("source_object_key").agg(F.count(F.lit(1)).cast("int").alias("progress_total"), F.min("ordinal").alias("first"))
    placed = tiles.select("source_object_key", "ordinal").join(broadcast_if_small(counted), "source_object_key").withColumn(
        "progress_current", F.col("ordinal") - F.col("first") + 1)
    due = placed.where((F.col("progress_current") == 1) | (F.col("progress_current") % step == 0) | (F.col("progress_current") == F.col("progress_total")))

    def events(rows: DataFrame, stage: str, level: str | Column, message: Column, current: str | None, limit: str | None) -> DataFrame:
        number = lambda c: (F.col(c) if c else F.lit(None)).cast("int")
        return rows.select(
            F.col("source_object_key").alias("object_key"), F.lit(stage).alias("stage"), (F.lit(level) if isinstance(level, str) else level).alias("level"),
            message.alias("message"), number(current).alias("progress_current"), number(limit).alias("progress_total"))

    def progress(rows: DataFrame, stage: str, text: str) -> DataFrame:
        return events(rows, stage, P.DEFAULT_LEVEL, F.format_string(text, "progress_current", "progress_total"), "progress_current", "progress_total")

    agrees = F.col("mismatches") == 0
    validated = events(
        checks, STAGE_VALIDATE, F.when(agrees, P.DEFAULT_LEVEL).otherwise("ERROR"),
        F.when(agrees, F.format_string("Corners of neighbouring tiles checked: %d.", "checked")).otherwise(
            F.format_string("%d of %d corners of neighbouring tiles disagree.", "mismatches", "checked")), "checked", "checked")
    sound = broadcast_if_small(checks.where("consistent").select("source_object_key"))
    assembled = due.join(sound, "source_object_key", "left_semi")
    started = events(
        counted.join(sound, "source_object_key", "left_semi"), STAGE_ASSEMBLE, P.DEFAULT_LEVEL,
        F.format_string("Assembly begun. Tiles: %d.", "progress_total"), None, None)
    found = polygons.select(F.col("scene_key").alias("source_object_key")).distinct()
    nothing = events(
        counted.join(sound, "source_object_key", "left_semi").join(found, "source_object_key", "left_anti"), STAGE_ASSEMBLE, "WARNING",
        F.lit("No suitable polygons, no export."), None, None)
    return (progress(due, STAGE_GENERATE, "Tiles prepared: %d of %d.").unionByName(validated).unionByName(started)
            .unionByName(progress(assembled, STAGE_ASSEMBLE, "Masks processed: %d of %d.")).unionByName(nothing))
