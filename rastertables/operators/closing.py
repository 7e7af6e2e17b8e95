"""Closing of gaps in scene masks: grow by a radius, then shrink by it, by distances to the mask.

A scene is cut into blocks that see the cells around them. In a block the distance of every cell to the
mask along its column comes from two running passes; a column at distance v then covers the cells of
its row within the half width that the radius leaves at v, and the covers of a row are added up from
their ends. Work follows the cells of the blocks, whatever the radius; runs are copied to the blocks
that see them, not by offset.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from rastertables.functions.crs import is_supported, pixel_to_wgs84
from rastertables.shipping import ship_package
from rastertables.storage import broadcast_if_small

#: Cells along the side of a block, and cells that a task looks at for one block at most.
BLOCK, SEEN_CELLS = 1024, 1 << 22
_RUN = "scene_key string, row int, c0 int, c1 int"
#: Added before a root is cut to whole cells, so that whole radii stay whole.
_SLACK = 1e-9


def joined_runs(runs: DataFrame, *same: str) -> DataFrame:
    """Runs of one scene row that touch or overlap become one.

    Joined runs agree on the columns `same`, which are kept.
    """
    in_order = Window.partitionBy("scene_key", "row").orderBy("c0", "c1")
    reach = F.max("c1").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    opened = runs.withColumn("opens", F.when(reach >= F.col("c0") - 1, 0).otherwise(1))
    numbered = opened.withColumn("island", F.sum("opens").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("scene_key", "row", "island").agg(
        F.min("c0").alias("c0"), F.max("c1").alias("c1"), *(F.max(c).alias(c) for c in same)).drop("island")


def radii_in_cells(scenes: DataFrame, degrees: float) -> DataFrame:
    """(scene_key, gap_x, gap_y): how many columns and rows `degrees` are, measured at the middle of a scene.

    Scenes without a known reference system have none.
    """
    x, y = F.floor(F.col("width") / 2).cast("int"), F.floor(F.col("height") / 2).cast("int")
    located = scenes.where(is_supported(F.col("epsg"))).withColumns({
        "at": pixel_to_wgs84(x, y), "right": pixel_to_wgs84(x + 1, y), "below": pixel_to_wgs84(x, y + 1)})

    def cells(end: str) -> Column:
        lon = F.pmod(F.col(end)["lon"] - F.col("at")["lon"] + 180.0, F.lit(360.0)) - 180.0
        return F.lit(float(degrees)) / F.nullif(F.hypot(lon, F.col(end)["lat"] - F.col("at")["lat"]), F.lit(0.0))

    return located.select("scene_key", cells("right").alias("gap_x"), cells("below").alias("gap_y"))


def half_widths(gap_x: float, gap_y: float) -> np.ndarray:
    """Columns that the ellipse of the two radii reaches to either side, by rows from its middle."""
    rows = np.arange(math.floor(gap_y + _SLACK) + 1)
    left = 1 - (rows / gap_y) ** 2 if gap_y > 0 else np.ones(1)
    return np.floor(gap_x * np.sqrt(np.maximum(left, 0)) + _SLACK).astype(np.int64)


def _filled(row: np.ndarray, c0: np.ndarray, c1: np.ndarray, height: int, width: int) -> np.ndarray:
    """Cells that some run covers; runs are cut to the block."""
    c0, end = np.maximum(c0, 0), np.minimum(c1, width - 1) + 1
    some = (row >= 0) & (row < height) & (c0 < end)
    at = row[some] * (width + 1)
    size = height * (width + 1)
    steps = np.bincount(at + c0[some], minlength=size) - np.bincount(at + end[some], minlength=size)
    return np.cumsum(steps.reshape(height, width + 1), axis=1)[:, :width] > 0


def grown(cells: np.ndarray, halves: np.ndarray) -> np.ndarray:
    """Cells within the ellipse around some cell of the mask."""
    height, width = cells.shape
    at, far = np.arange(height, dtype=np.int32)[:, None], np.int32(2**30)
    above = np.maximum.accumulate(np.where(cells, at, -far), axis=0)
    below = np.minimum.accumulate(np.where(cells, at, far)[::-1], axis=0)[::-1]
    away = np.minimum(at - above, below - at)
    row, col = np.nonzero(away < len(halves))
    half = halves[away[row, col]]
    return _filled(row, col - half, col + half, height, width)


def closed_cells(cells: np.ndarray, halves: np.ndarray) -> np.ndarray:
    """The closing, right for cells two radii away from the border of the array."""
    return ~grown(~grown(cells, halves), halves)


def _in_blocks(runs: DataFrame, block: int) -> DataFrame:
    """Runs closed in every block that holds or sees mask cells; runs end at the borders of blocks."""
    def blocks(first: Column, last: Column, gap: str) -> Column:
        seen = 2 * F.floor(F.col(gap) + _SLACK)
        return F.explode(F.sequence(F.floor((first - seen) / block), F.floor((last + seen) / block)))

    spread = runs.withColumn("block_y", blocks(F.col("row"), F.col("row"), "gap_y")).withColumn(
        "block_x", blocks(F.col("c0"), F.col("c1"), "gap_x"))
    ship_package(runs.sparkSession)

    def close(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        scene, by, bx = key
        halves = half_widths(float(frame["gap_x"].iloc[0]), float(frame["gap_y"].iloc[0]))
        dy, dx = 2 * (len(halves) - 1), 2 * int(halves[0])
        top, left = by * block - dy, bx * block - dx
        row, c0, c1 = (frame[c].to_numpy(np.int64) - start for c, start in (("row", top), ("c0", left), ("c1", left)))
        seen = _filled(row, c0, c1, block + 2 * dy, block + 2 * dx)
        own = closed_cells(seen, halves)[dy:dy + block, dx:dx + block]
        edges = np.diff(np.pad(own, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, start = np.nonzero(edges == 1)
        end = np.nonzero(edges == -1)[1] - 1
        return pd.DataFrame({"scene_key": scene, "row": row + by * block, "c0": start + bx * block, "c1": end + bx * block})

    return spread.groupBy("scene_key", "block_y", "block_x").applyInPandas(close, _RUN)


def _by_offsets(runs: DataFrame) -> DataFrame:
    """The same closing with a copy of every run for each row of the ellipse, for radii that no block can see around."""
    rows = F.floor(F.col("gap_y") + _SLACK).cast("int")
    left = 1 - F.coalesce(F.pow(F.col("dy") / F.nullif(F.col("gap_y"), F.lit(0.0)), F.lit(2.0)), F.lit(0.0))
    half = F.floor(F.col("gap_x") * F.sqrt(F.greatest(left, F.lit(0.0))) + _SLACK).cast("int")

    def copies(some: DataFrame) -> DataFrame:
        return some.withColumn("dy", F.explode(F.sequence(-rows, rows))).withColumn("half", half)

    kept = ("gap_x", "gap_y")
    wide = joined_runs(copies(runs).select(
        "scene_key", (F.col("row") + F.col("dy")).alias("row"),
        (F.col("c0") - F.col("half")).alias("c0"), (F.col("c1") + F.col("half")).alias("c1"), *kept), *kept)
    narrow = copies(wide).select(
        "scene_key", (F.col("row") - F.col("dy")).alias("row"), (F.col("c0") + F.col("half")).alias("c0"),
        (F.col("c1") - F.col("half")).alias("c1"), (2 * rows + 1).alias("depth")).where(F.col("c0") <= F.col("c1"))
    return _covered(narrow)


def _covered(runs: DataFrame) -> DataFrame:
    """Parts of a row that `depth` runs cover."""
    ends = F.explode(F.array(
        F.struct(F.col("c0").alias("at"), F.lit(1).alias("step")),
        F.struct((F.col("c1") + 1).alias("at"), F.lit(-1).alias("step")))).alias("e")
    steps = runs.select("scene_key", "row", "depth", ends).groupBy("scene_key", "row", F.col("e.at").alias("at")).agg(
        F.sum("e.step").alias("step"), F.max("depth").alias("depth"))
    in_order = Window.partitionBy("scene_key", "row").orderBy("at")
    swept = steps.withColumns({
        "held": F.sum("step").over(in_order.rowsBetween(Window.unboundedPreceding, 0)),
        "stop": F.lead("at").over(in_order),
    })
    return swept.where(F.col("held") == F.col("depth")).select(
        "scene_key", "row", F.col("at").alias("c0"), (F.col("stop") - 1).alias("c1"))


def close_gaps(runs: DataFrame, gap: float | DataFrame, block: int = BLOCK, seen_cells: int = SEEN_CELLS) -> DataFrame:
    """Morphological closing of scene runs: grow, then shrink, by distances between the middles of cells.

    `gap` is a radius in cells or a frame (scene_key, gap_x, gap_y) of radii by scene, see `radii_in_cells`; scenes
    that it leaves out, and radii of null or at most 0, leave their runs merely joined. Radii for which a block would
    have to look at more than `seen_cells` cells take copies of runs by offset instead; results are equal.
    """
    merged = joined_runs(runs)
    if not isinstance(gap, DataFrame):
        if gap <= 0:
            return merged
        sized = merged.withColumns({"gap_x": F.lit(float(gap)), "gap_y": F.lit(float(gap))})
        widest = _seen(float(gap), float(gap), block)
    else:
        radii = gap.select("scene_key", *(F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0)).cast("double").alias(c) for c in ("gap_x", "gap_y")))
        sized = merged.join(broadcast_if_small(radii), "scene_key", "left").fillna(0.0, ["gap_x", "gap_y"])
        widest = radii.agg(F.max(_seen(F.col("gap_x"), F.col("gap_y"), block))).first()[0] or 0
    if widest <= seen_cells:
        return joined_runs(_in_blocks(sized, block))
    fits = _seen(F.col("gap_x"), F.col("gap_y"), block) <= seen_cells
    return joined_runs(_in_blocks(sized.where(fits), block).unionByName(_by_offsets(sized.where(~fits))))


def _seen(gap_x: float | Column, gap_y: float | Column, block: int) -> float | Column:
    """Cells that a block looks at."""
    return (gap_x * 4 + block) * (gap_y * 4 + block)
