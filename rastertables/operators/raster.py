"""From raster cells to kept, stretched and numbered tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rastertables import params as P
from rastertables.functions import names
from rastertables.functions.bbox import CORNERS
from rastertables.functions.crs import is_supported, pixel_to_wgs84
from rastertables.operators import kernels
from rastertables.operators.blocks import SIZED_TILE, TILE, computed_once
from rastertables.operators.ranking import number_within
from rastertables.operators.selection import exact_quantiles
from rastertables.storage import broadcast_if_small, materialize


def is_valid(value: Column, epsilon: float = P.BACKGROUND_EPSILON) -> Column:
    """Present, finite and not the zero background."""
    size = F.abs(value)
    return F.coalesce(~F.isnan(value) & (size < F.lit(float("inf"))) & (size > F.lit(epsilon)), F.lit(False))


def valid_pixels(pixels: DataFrame, epsilon: float = P.BACKGROUND_EPSILON) -> DataFrame:
    return pixels.where(is_valid(F.col("value"), epsilon))


def blank_invalid(tiles: DataFrame, epsilon: float = P.BACKGROUND_EPSILON) -> DataFrame:
    """Tiles whose invalid cells are NULL."""
    return computed_once(tiles, {"band": F.transform("band", lambda v: F.when(is_valid(v, epsilon), v))})


def tile_stats(tiles: DataFrame) -> DataFrame:
    """Valid count, total and value range of each tile. Expects blanked cells."""
    return computed_once(tiles.select(*SIZED_TILE, "band"), {
        "valid_count": F.size(F.array_compact("band")),
        "total_count": F.col("tile_width") * F.col("tile_height"),
        "value_min": F.array_min("band"),
        "value_max": F.array_max("band"),
    })


def passes_quality(min_ratio: float) -> Column:
    """Enough valid cells, and more than one value."""
    return (
        (F.col("valid_count") > 0)
        & (F.col("valid_count") / F.col("total_count") >= F.lit(min_ratio))
        & (F.col("value_max") - F.col("value_min") != 0)
    )


def valid_tiles(tiles: DataFrame, params: P.SceneParams) -> DataFrame:
    """Blanked tiles that pass the quality gate, with their statistics."""
    return tile_stats(blank_invalid(tiles, params.background_epsilon)).where(
        passes_quality(params.min_valid_ratio)
    )


def _aligned_window(scenes: DataFrame, tile_size: int) -> DataFrame:
    """Preview rounding, one preview cell of padding, outward alignment, clipping."""
    side = F.greatest(F.lit(1), F.ceil(F.greatest("width", "height") / P.PREVIEW_SIDE)).cast("int")

    def start(low: str) -> Column:
        preview = F.floor(F.col(low) / F.col("scale")) * F.col("scale") - F.col("scale")
        return F.floor(F.greatest(F.lit(0), preview) / tile_size) * tile_size

    def stop(high: str, limit: str) -> Column:
        preview = (F.floor(F.col(high) / F.col("scale")) + 2) * F.col("scale")
        aligned = F.ceil(F.least(F.col(limit), preview) / tile_size) * tile_size
        return F.least(F.col(limit), aligned)

    return scenes.withColumn("scale", side).select(
        "scene_key",
        F.coalesce(start("min_px"), F.lit(0)).cast("int").alias("x_start"),
        F.coalesce(start("min_py"), F.lit(0)).cast("int").alias("y_start"),
        F.coalesce(stop("max_px", "width"), F.col("width")).cast("int").alias("x_stop"),
        F.coalesce(stop("max_py", "height"), F.col("height")).cast("int").alias("y_stop"),
    )


def data_window(summaries: DataFrame, scenes: DataFrame, params: P.SceneParams) -> DataFrame:
    """Tile-aligned extent of the valid cells of each scene; the whole raster if none is.

    Takes tile summaries, which know the extent of their valid cells; no cell becomes a row.
    """
    extent = summaries.groupBy("scene_key").agg(
        F.min(F.col("tile_x") + F.col("min_col")).alias("min_px"), F.min(F.col("tile_y") + F.col("min_row")).alias("min_py"),
        F.max(F.col("tile_x") + F.col("max_col")).alias("max_px"), F.max(F.col("tile_y") + F.col("max_row")).alias("max_py"),
    )
    return _aligned_window(scenes.join(extent, "scene_key", "left"), params.tile_size)


def sample_contrast(kept: DataFrame, cap: int) -> DataFrame:
    """Per tile all valid values up to the cap, else evenly spaced ones in row-major order."""
    values = computed_once(kept.select(*TILE, "band"), {"values": F.array_compact("band")})
    step = F.greatest(F.lit(1), F.floor(F.size("values") / F.lit(cap))).cast("int")
    wanted = F.least(F.size("values"), F.lit(cap))
    spaced = F.transform(F.sequence(F.lit(0), wanted - 1), lambda n: F.get("values", n * F.col("step")))
    stepped = computed_once(values.where(wanted > 0), {"step": step})
    return stepped.select(*TILE, F.explode(spaced).alias("value"))


def valid_values(kept: DataFrame) -> DataFrame:
    """Every valid value of the kept tiles as a row."""
    return computed_once(kept.select(*TILE, "band"), {"values": F.array_compact("band")}).select(
        *TILE, F.explode("values").alias("value"))


def contrast_bounds(values: DataFrame) -> DataFrame:
    """Low and high quantile of value rows per scene; scenes with no range are left out."""
    low, high = P.CONTRAST_QUANTILES
    written = materialize(values.select("scene_key", "value"), "contrast-values")
    bounds = exact_quantiles(written, "scene_key", "value", {"low": low, "high": high})
    return materialize(bounds.where(F.col("high") - F.col("low") != 0), "contrast-bounds")


def scene_bounds(tiles: DataFrame, kept: DataFrame, params: P.SceneParams) -> DataFrame:
    """Bounds as in contrast_bounds, of all valid cells, without a row for each cell.

    `kept` holds the written summaries of the tiles that count. Their buckets tell which of them hold
    the wanted ranks; only tiles with values there are read again, and of these values only the
    different ones travel, with their numbers.
    """
    fractions = dict(zip(("low", "high"), P.CONTRAST_QUANTILES))
    in_order = Window.partitionBy("scene_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = kept.select("scene_key", F.inline("buckets")).groupBy("scene_key", "bucket").agg(F.sum("n").alias("n"))
    placed = buckets.withColumns({
        "before": F.coalesce(F.sum("n").over(in_order), F.lit(0)), "total": F.sum("n").over(Window.partitionBy("scene_key"))})

    def position(fraction: float) -> Column:
        return F.lit(fraction) * (F.col("total") - 1)

    ends = [end for f in fractions.values() for end in (F.floor(position(f)), F.ceil(position(f)))]
    hit = placed.withColumn("ranks", F.filter(
        F.array_distinct(F.array(*ends)), lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n"))))
    hit = materialize(hit.where(F.size("ranks") > 0).drop("n"), "rank-buckets")

    wanted = hit.groupBy("scene_key").agg(F.collect_set("bucket").alias("wanted"))
    holding = kept.join(broadcast_if_small(wanted), "scene_key").where(F.arrays_overlap("buckets.bucket", "wanted"))
    chosen = tiles.join(broadcast_if_small(holding.select(*TILE, "wanted")), TILE)
    values = kernels.wanted_values(chosen, params).groupBy("scene_key", "bucket", "value").agg(F.sum("n").alias("n"))
    inside = Window.partitionBy("scene_key", "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = values.join(broadcast_if_small(hit), ["scene_key", "bucket"]).withColumn(
        "stop", F.col("before") + F.sum("n").over(inside))
    found = ranked.select("scene_key", "total", "value", F.explode(F.filter(
        "ranks", lambda r: (r >= F.col("stop") - F.col("n")) & (r < F.col("stop")))).alias("rank"))

    def at_rank(rank: Column) -> Column:
        return F.max(F.when(F.col("rank") == rank, F.col("value")))

    def interpolated(fraction: float) -> Column:
        at = position(fraction)
        lower, upper = at_rank(F.floor(at)), at_rank(F.ceil(at))
        return lower + (upper - lower) * F.max(at - F.floor(at))

    bounds = found.groupBy("scene_key").agg(*(interpolated(f).alias(name) for name, f in fractions.items()))
    return materialize(bounds.where(F.col("high") - F.col("low") != 0), "contrast-bounds")


def grey_value(value: Column) -> Column:
    """0..255 between the scene bounds; invalid cells are 0."""
    scaled = F.lit(255.0) * ((value - F.col("low")) / (F.col("high") - F.col("low")))
    return F.coalesce(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(255.0)).cast("int"), F.lit(0))


def with_bounds(tiles: DataFrame, bounds: DataFrame) -> DataFrame:
    """Tiles with the bounds of their scene; scenes without bounds drop out."""
    return tiles.join(broadcast_if_small(bounds), "scene_key")


def stretch(kept: DataFrame, bounds: DataFrame) -> DataFrame:
    """Tiles with a grey array."""
    return computed_once(with_bounds(kept, bounds), {"grey": F.transform("band", grey_value)})


def drop_black_tiles(stretched: DataFrame) -> DataFrame:
    return stretched.where(F.array_max("grey") > 0)


def number_tiles(tiles: DataFrame) -> DataFrame:
    """Ordinal of each surviving tile in scan order, from 0 in each scene.

    Takes tile rows without their cells; they are written because numbering reads them twice.
    """
    written = materialize(tiles, "surviving-tiles")
    return number_within(written, ["scene_key"], ["tile_y"], ["tile_x"], "ordinal")


def is_partial() -> Column:
    return F.col("valid_count") < F.col("total_count")


def tile_kind(kept: DataFrame) -> DataFrame:
    """Partial flag, file extension and the alpha of every cell."""
    return kept.select(
        *SIZED_TILE, "band", is_partial().alias("partial"),
        F.when(is_partial(), ".png").otherwise(".jpg").alias("extension"),
        F.transform("band", lambda v: F.when(v.isNotNull(), 255).otherwise(0)).alias("alpha"),
    )


def name_tiles(numbered: DataFrame) -> DataFrame:
    key = F.col("scene_key")
    return numbered.withColumns({
        "filename": names.tile_filename(key, F.col("ordinal"), is_partial()),
        "mask_name": names.mask_filename(key, F.col("ordinal")),
    })


def tile_corners(tiles: DataFrame, scenes: DataFrame) -> DataFrame:
    """Eight corner columns; scenes without a known reference system drop out."""
    x0, y0 = F.col("tile_x"), F.col("tile_y")
    x1, y1 = x0 + F.col("tile_width"), y0 + F.col("tile_height")
    nodes = F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))))
    frame = scenes.where(is_supported(F.col("epsg"))).select("scene_key", "epsg", *"abcdef")
    placed = tiles.join(broadcast_if_small(frame, counted=scenes.select("scene_key")), "scene_key")
    placed = placed.withColumn("points", F.transform(nodes, lambda n: pixel_to_wgs84(n["x"], n["y"])))
    flat = {
        f"{name}_{axis}": F.col("points")[i][axis]
        for i, name in enumerate(CORNERS) for axis in ("lon", "lat")
    }
    return placed.withColumns(flat).drop("epsg", *"abcdef", "points")
