"""4-connected components of mask cells, inside tiles and across whole scenes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.functions import pandas_udf

from rastertables.operators.blocks import SIZED_TILE, TILE, tile_extent, tile_origin
from rastertables.operators.closing import close_gaps
from rastertables.operators.kernels import RUN
from rastertables.operators.land import tile_affine
from rastertables.operators.masks import run
from rastertables.shipping import ship_package
from rastertables.storage import materialize


def label_runs(row: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> np.ndarray:
    """Smallest run index of the component each run belongs to. Runs are in scan order.

    The runs of the next row that overlap a run are neighbours in scan order, so two binary
    searches give all pairs; labels then fall to the minimum along the pairs.
    """
    n = len(row)
    label = np.arange(n)
    if n < 2:
        return label
    stride = int(c1.max()) + 2
    below = (row + 1) * stride
    first = np.searchsorted(row * stride + c1, below + c0, "left")
    last = np.searchsorted(row * stride + c0, below + c1, "right")
    reach = np.maximum(last - first, 0)
    a = np.repeat(np.arange(n), reach)
    b = np.repeat(first, reach) + np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
    while True:
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if np.array_equal(label[a], label[b]) and np.array_equal(label, label[label]):
            return label


def _labels() -> Column:
    @pandas_udf("array<int>")
    def labels(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for rows, starts, ends in batches:
            yield pd.Series([
                label_runs(*(np.asarray(v, dtype=np.int64) for v in tile)).astype(np.int32)
                for tile in zip(rows, starts, ends)
            ])

    return labels("runs.row", "runs.c0", "runs.c1")


def labelled_runs(masked: DataFrame) -> DataFrame:
    """One row per run with its component and the component's first cell.

    The component is the index of its first run. A tile is labelled where it lies: its runs travel as three integer arrays, nothing is
    shuffled.
    """
    ship_package(masked.sparkSession)
    labelled = masked.withColumn("labels", _labels())
    seeds = F.transform("labels", lambda n: F.get("runs", n))
    joined = F.inline(F.arrays_zip(F.col("runs").alias("run"), F.col("labels").alias("label"), seeds.alias("seed")))
    kept = [c for c in masked.columns if c != "runs"]
    return labelled.select(*kept, joined).select(
        *kept, F.col("label").alias("component"), "run.row", "run.c0", "run.c1",
        F.col("seed.row").alias("seed_row"), F.col("seed.c0").alias("seed_col"))


PIECE = (
    "array<struct<component:int,cells:bigint,col_min:int,col_max:int,row_min:int,row_max:int,"
    "runs:array<struct<row:int,c0:int,c1:int>>>>"
)


def component_pieces(rows: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    """Components of each tile, in the order of their first runs, from its run arrays."""
    per_tile, firsts, stats, parts = [0], [], [], []
    for tile in zip(rows, starts, ends):
        row, c0, c1 = (v.values.to_numpy(zero_copy_only=False).astype(np.int64) for v in tile)
        if len(row) == 0:
            per_tile.append(per_tile[-1])
            continue
        label = label_runs(row, c0, c1)
        order = np.argsort(label, kind="stable")
        label, row, c0, c1 = label[order], row[order], c0[order], c1[order]
        at = np.flatnonzero(np.diff(label, prepend=-1))
        firsts.append(np.diff(np.append(at, len(label))))
        stats.append((
            label[at], np.add.reduceat(c1 - c0 + 1, at), np.minimum.reduceat(c0, at), np.maximum.reduceat(c1, at),
            np.minimum.reduceat(row, at), np.maximum.reduceat(row, at)))
        parts.append((row, c0, c1))
        per_tile.append(per_tile[-1] + len(at))
    joined = lambda lists, i, kind: pa.array(np.concatenate([v[i] for v in lists] or [np.zeros(0)]), kind)
    runs = pa.StructArray.from_arrays(
        [joined([[p.astype(np.int32) for p in v] for v in parts], i, pa.int32()) for i in range(3)], fields=list(RUN))
    offsets = np.concatenate([[0], *firsts]).cumsum().astype(np.int32)
    names = ["component", "cells", "col_min", "col_max", "row_min", "row_max"]
    kinds = [pa.int32(), pa.int64()] + [pa.int32()] * 4
    columns = [joined(stats, i, pa.int64()).cast(kind) for i, kind in enumerate(kinds)]
    pieces = pa.StructArray.from_arrays(
        [*columns, pa.ListArray.from_arrays(pa.array(offsets), runs)], names=[*names, "runs"])
    return pa.ListArray.from_arrays(pa.array(np.array(per_tile, dtype=np.int32)), pieces)


def polygonize(masked: DataFrame) -> DataFrame:
    """Components of every tile: seed cell, cells, box and their runs in scan order.

    Nothing is shuffled: a tile's components come out of the row of the tile, and the other
    columns of the tile go along.
    """
    ship_package(masked.sparkSession)
    kept = [c for c in masked.columns if c != "runs"]
    pieces = F.arrow_udf(component_pieces, PIECE).asNondeterministic()("runs.row", "runs.c0", "runs.c1")
    split = masked.withColumn("pieces", pieces).select(*kept, F.inline("pieces"))
    return split.withColumns({"seed_row": F.col("runs")[0]["row"], "seed_col": F.col("runs")[0]["c0"]})


def polygon_area(cells: Column) -> Column:
    """Square degrees of a number of cells, by the tile's corner affine."""
    m = tile_affine()
    return cells * F.abs(m["lx"] * m["ay"] - m["ly"] * m["ax"])


def located_polygons(masked: DataFrame, tiles: DataFrame) -> DataFrame:
    """Polygons with the tile's names and corners, and their area.

    The tile's columns are joined to the mask, one row per tile, before it is taken apart.
    """
    extra = [c for c in tiles.columns if c not in masked.columns]
    located = masked.join(tiles.select(*TILE, *extra), TILE)
    return polygonize(located).withColumn("area", polygon_area(F.col("cells")))


def large_polygons(polygons: DataFrame, min_area: float) -> DataFrame:
    return polygons.where(F.col("area") >= F.lit(min_area))


# --- components across tiles ----------------------------------------------------------


def connected_components(edges: DataFrame, key: str) -> DataFrame:
    """(key, u, root) for nodes of undirected edges (key, u, v); root is the smallest node.

    Alternating star contraction: every round hangs neighbours on the smallest node around
    and is written to the shared folder. Nodes that are their own root give no row.
    """
    current = materialize(_directed(edges, key), "cc-start")
    while _unsettled(current, key):
        current = materialize(_small_star(_large_star(current, key), key), "cc-round", replaces=current)
    return current.select(key, "u", F.col("v").alias("root"))


def _unsettled(edges: DataFrame, key: str) -> bool:
    """True while a node has two parents or hangs on a node that hangs itself."""
    roles = edges.select(key, F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(key, F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    seen = roles.groupBy(key, "node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not seen.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def _directed(edges: DataFrame, key: str) -> DataFrame:
    """Each edge once, from the larger to the smaller node."""
    return edges.where(F.col("u") != F.col("v")).select(
        key, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(edges: DataFrame, key: str) -> DataFrame:
    """Hang the larger neighbours of each node on its smallest neighbour."""
    both = edges.unionByName(edges.select(key, F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy(key, "u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    hung = both.join(lowest, [key, "u"]).where(F.col("v") > F.col("u"))
    return hung.select(key, F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, key: str) -> DataFrame:
    """Hang each node and its smaller neighbours on the smallest of them."""
    lowest = edges.groupBy(key, "u").agg(F.min("v").alias("m"))
    hung = edges.join(lowest, [key, "u"]).where(F.col("v") != F.col("m"))
    moved = hung.select(key, F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(lowest.select(key, "u", F.col("m").alias("v"))).distinct()


def scene_runs(masked: DataFrame) -> DataFrame:
    """Runs in scene coordinates: scene_key, row, c0, c1."""
    runs = masked.select(*TILE, F.explode("runs").alias("r"))
    return runs.select(
        "scene_key", (F.col("tile_y") + F.col("r.row")).alias("row"),
        (F.col("tile_x") + F.col("r.c0")).alias("c0"), (F.col("tile_x") + F.col("r.c1")).alias("c1"))


def retile(runs: DataFrame, scenes: DataFrame, tile_size: int) -> DataFrame:
    """Scene runs cut back into tiles; cells outside the raster fall away."""
    sized = runs.join(scenes.select("scene_key", "width", "height"), "scene_key").where(
        F.col("row").between(F.lit(0), F.col("height") - 1))
    inside = sized.withColumns({
        "c0": F.greatest("c0", F.lit(0)), "c1": F.least("c1", F.col("width") - 1)}).where(F.col("c0") <= F.col("c1"))
    spread = inside.withColumn("tile_x", F.explode(F.sequence(
        tile_origin(F.col("c0"), tile_size), tile_origin(F.col("c1"), tile_size), F.lit(tile_size))))
    local = run(
        F.col("row") - F.col("tile_y"), F.greatest(F.col("c0") - F.col("tile_x"), F.lit(0)),
        F.least(F.col("c1"), F.col("tile_x") + tile_size - 1) - F.col("tile_x"))
    return (
        spread.withColumn("tile_y", tile_origin(F.col("row"), tile_size))
        .withColumn("tile_width", tile_extent(F.col("tile_x"), F.col("width"), tile_size))
        .withColumn("tile_height", tile_extent(F.col("tile_y"), F.col("height"), tile_size))
        .groupBy(*SIZED_TILE).agg(F.array_sort(F.collect_list(local)).alias("runs"))
    )


def _border_cells(runs: DataFrame) -> DataFrame:
    """Scene positions of the cells on tile borders, with the sides they lie on."""
    across = (F.col("row") == 0) | (F.col("row") == F.col("tile_height") - 1)
    ends = F.array_distinct(F.array("c0", "c1"))
    on_border = F.filter(ends, lambda c: (c == 0) | (c == F.col("tile_width") - 1))
    cols = F.when(across, F.sequence("c0", "c1")).otherwise(on_border)
    cells = runs.withColumn("col", F.explode(cols))
    return cells.select(
        "scene_key", "seed", (F.col("tile_x") + F.col("col")).alias("x"), (F.col("tile_y") + F.col("row")).alias("y"),
        (F.col("col") == F.col("tile_width") - 1).alias("right"), (F.col("col") == 0).alias("left"),
        (F.col("row") == F.col("tile_height") - 1).alias("bottom"), (F.col("row") == 0).alias("top"),
    )


def merged_components(runs: DataFrame, scenes: DataFrame, tile_size: int) -> DataFrame:
    """Scene runs with the component of the whole scene they belong to.

    Tiles are labelled alone, then only border cells meet by position, and the small graph of
    touching tile components is contracted. A component is named by its first cell in scan
    order, row * width + column.
    """
    local = labelled_runs(retile(runs, scenes, tile_size)).join(scenes.select("scene_key", "width"), "scene_key")
    position = (F.col("tile_y") + F.col("seed_row")).cast("bigint") * F.col("width") + F.col("tile_x") + F.col("seed_col")
    seeded = materialize(local.withColumn("seed", position), "seeded-runs")

    border = _border_cells(seeded)
    keys = ["scene_key", "x", "y"]
    to_right = border.where("right").select("scene_key", (F.col("x") + 1).alias("x"), "y", F.col("seed").alias("u"))
    to_below = border.where("bottom").select("scene_key", "x", (F.col("y") + 1).alias("y"), F.col("seed").alias("u"))
    touching = to_right.join(border.where("left").select(*keys, F.col("seed").alias("v")), keys).unionByName(
        to_below.join(border.where("top").select(*keys, F.col("seed").alias("v")), keys))
    roots = connected_components(touching.select("scene_key", "u", "v"), "scene_key")
    named = seeded.join(roots.withColumnRenamed("u", "seed"), ["scene_key", "seed"], "left")
    return named.select(
        "scene_key", F.coalesce("root", "seed").alias("component"),
        (F.col("tile_y") + F.col("row")).alias("row"),
        (F.col("tile_x") + F.col("c0")).alias("c0"), (F.col("tile_x") + F.col("c1")).alias("c1"))


def merge_masks(masked: DataFrame, scenes: DataFrame, tile_size: int, gap: float | DataFrame = 0) -> DataFrame:
    """Components of the united masks of each scene, gaps closed; for `gap` see `close_gaps`."""
    return merged_components(close_gaps(scene_runs(masked), gap), scenes, tile_size)
