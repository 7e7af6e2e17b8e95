"""Raster cells in three forms.

chunks  scene_key, chunk_x, chunk_y, chunk_width, chunk_height, band array<double>
        storage blocks of a raster, on any grid
tiles   scene_key, tile_x, tile_y, tile_width, tile_height, band array<double>
        one row per tile of the processing grid, row-major, NULL where a cell is absent
pixels  scene_key, px, py, value
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rastertables.storage import broadcast_if_small

TILE = ["scene_key", "tile_x", "tile_y"]
SIZED_TILE = TILE + ["tile_width", "tile_height"]


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add or replace columns that are expensive and used more than once.

    Filters on such columns would be pushed below their projection and evaluate the whole
    array expression again; nothing is pushed below a generator.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def tile_origin(position: Column, tile_size: int) -> Column:
    """Grid origin of a pixel position. The data window is aligned to the same grid."""
    return (F.floor(position / F.lit(tile_size)) * tile_size).cast("int")


def tile_extent(origin: Column, limit: Column, tile_size: int) -> Column:
    """Tile side: the tile size, shorter at the raster edge."""
    return F.least(F.lit(tile_size), limit - origin)


def assign_tiles(pixels: DataFrame, scenes: DataFrame, tile_size: int) -> DataFrame:
    """Pixels with the tile they fall in."""
    sized = scenes.select("scene_key", "width", "height")
    return (
        pixels.join(sized, "scene_key")
        .withColumn("tile_x", tile_origin(F.col("px"), tile_size))
        .withColumn("tile_y", tile_origin(F.col("py"), tile_size))
        .withColumn("tile_width", tile_extent(F.col("tile_x"), F.col("width"), tile_size))
        .withColumn("tile_height", tile_extent(F.col("tile_y"), F.col("height"), tile_size))
        .drop("width", "height")
    )


def _gathered(segments: DataFrame) -> DataFrame:
    """One dense tile per (scene, tile) from its (at, cells) segments; a tile bounds the group.

    The segments are put in order and concatenated, with NULL cells in the gaps.
    """
    grouped = segments.groupBy(*SIZED_TILE).agg(F.collect_list(F.struct("at", "cells")).alias("s"))
    ordered = computed_once(grouped, {"s": F.array_sort("s")})
    no_cells = F.lit(None).cast("double")

    def with_gap(segment: Column, i: Column) -> Column:
        previous = F.get("s", i - 1)
        stop = F.when(i == 0, F.lit(0)).otherwise(previous["at"] + F.size(previous["cells"]))
        return F.concat(F.array_repeat(no_cells, segment["at"] - stop), segment["cells"])

    body = computed_once(ordered, {"s": F.flatten(F.transform("s", with_gap))})
    rest = F.col("tile_width") * F.col("tile_height") - F.size("s")
    return body.select(*SIZED_TILE, F.concat("s", F.array_repeat(no_cells, rest)).alias("band"))


def blocks_from_pixels(pixels: DataFrame, scenes: DataFrame, tile_size: int) -> DataFrame:
    """Tiles from single pixels: one shuffle of the pixels by tile."""
    placed = assign_tiles(pixels, scenes, tile_size)
    at = (F.col("py") - F.col("tile_y")) * F.col("tile_width") + F.col("px") - F.col("tile_x")
    return _gathered(placed.select(*SIZED_TILE, at.alias("at"), F.array("value").alias("cells")))


def pixels_from_blocks(tiles: DataFrame) -> DataFrame:
    """Inverse of blocks_from_pixels; absent cells give no row."""
    cells = tiles.select("scene_key", "tile_x", "tile_y", "tile_width", F.posexplode("band").alias("at", "value"))
    return cells.where(F.col("value").isNotNull()).select(
        "scene_key",
        (F.col("tile_x") + F.col("at") % F.col("tile_width")).alias("px"),
        (F.col("tile_y") + F.floor(F.col("at") / F.col("tile_width"))).cast("int").alias("py"),
        "value",
    )


def tiles_from_chunks(chunks: DataFrame, scenes: DataFrame, tile_size: int) -> DataFrame:
    """Cut storage chunks into the processing grid."""
    return laid_out_tiles(chunks, scenes, tile_size)[0]


def laid_out_tiles(chunks: DataFrame, scenes: DataFrame, tile_size: int) -> tuple[DataFrame, bool]:
    """Tiles of the processing grid, and whether every storage chunk is one already.

    A chunk that already is a whole tile passes through without a shuffle. The others are cut
    into row segments, so the shuffle moves arrays and not single cells. The layout columns
    are looked at first, so that the cells are read by the branches that are needed only.
    """
    x, y = F.col("chunk_x"), F.col("chunk_y")
    w, h = F.col("chunk_width"), F.col("chunk_height")
    sized = scenes.select("scene_key", "width", "height")
    placed = chunks.join(broadcast_if_small(sized), "scene_key")
    whole = (
        (x % tile_size == 0) & (y % tile_size == 0)
        & (w == F.least(F.lit(tile_size), F.col("width") - x))
        & (h == F.least(F.lit(tile_size), F.col("height") - y))
    )
    layout = placed.agg(F.count(F.lit(1)).alias("chunks"), F.count_if(whole).alias("whole")).first()
    aligned = placed.where(whole).select(
        "scene_key", x.alias("tile_x"), y.alias("tile_y"), w.alias("tile_width"),
        h.alias("tile_height"), "band",
    )
    if layout["whole"] == layout["chunks"]:
        return aligned, True
    by_row = placed.where(~whole).withColumn("line", F.explode(F.sequence(F.lit(0), h - 1)))
    by_segment = by_row.withColumn(
        "tile_x", F.explode(F.sequence(tile_origin(x, tile_size), tile_origin(x + w - 1, tile_size), F.lit(tile_size)))
    )
    start = F.greatest(x, F.col("tile_x"))
    stop = F.least(x + w, F.col("tile_x") + tile_size)
    row = y + F.col("line")
    segments = (
        by_segment
        .withColumn("tile_y", tile_origin(row, tile_size))
        .withColumn("tile_width", tile_extent(F.col("tile_x"), F.col("width"), tile_size))
        .withColumn("tile_height", tile_extent(F.col("tile_y"), F.col("height"), tile_size))
        .select(
            *SIZED_TILE,
            ((row - F.col("tile_y")) * F.col("tile_width") + start - F.col("tile_x")).alias("at"),
            F.slice("band", F.col("line") * w + start - x + 1, stop - start).alias("cells"),
        )
    )
    cut = _gathered(segments)
    return cut if layout["whole"] == 0 else aligned.unionByName(cut), False


def pixels_from_chunks(chunks: DataFrame) -> DataFrame:
    """Every cell of the chunks as a row."""
    cells = chunks.select("scene_key", "chunk_x", "chunk_y", "chunk_width", F.posexplode("band").alias("at", "value"))
    return cells.select(
        "scene_key",
        (F.col("chunk_x") + F.col("at") % F.col("chunk_width")).alias("px"),
        (F.col("chunk_y") + F.floor(F.col("at") / F.col("chunk_width"))).cast("int").alias("py"),
        "value",
    )
