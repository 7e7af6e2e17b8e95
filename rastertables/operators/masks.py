"""Masks as runs of set cells.

A masked tile row carries runs array<struct<row,c0,c1>>: the set cells of the tile, in scan
order, as column ranges with both ends included.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from rastertables.operators.blocks import SIZED_TILE, TILE, computed_once

SET_ALPHA = 127


def run(row: Column, c0: Column, c1: Column) -> Column:
    return F.struct(row.cast("int").alias("row"), c0.cast("int").alias("c0"), c1.cast("int").alias("c1"))


def stored_alpha(mask: Column) -> Column:
    """Byte kept for a mask value of 0..1."""
    return F.floor(F.least(F.greatest(mask, F.lit(0.0)), F.lit(1.0)) * 255).cast("int")


def is_set(alpha: Column) -> Column:
    return alpha > SET_ALPHA


def runs_of(mask: Column, width: Column) -> Column:
    """Maximal horizontal runs of a row-major boolean array."""
    last = F.size(mask) - 1
    cells = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    at = lambda i: F.coalesce(F.get(mask, i), F.lit(False))
    starts = F.filter(cells, lambda i: at(i) & ((i % width == 0) | ~at(i - 1)))
    ends = F.filter(cells, lambda i: at(i) & ((i % width == width - 1) | ~at(i + 1)))
    return F.zip_with(starts, ends, lambda s, e: run(F.floor(s / width), s % width, e % width))


def segment_tiles(stretched: DataFrame, predicate: Callable[[Column], Column]) -> DataFrame:
    """Runs of the cells a Column predictor sets. Invalid cells stay unset."""
    mask = F.zip_with("grey", "band", lambda g, v: v.isNotNull() & predicate(g))
    kept = [c for c in stretched.columns if c not in ("band", "grey")]
    masked = computed_once(stretched.select(*kept, "band", "grey"), {"mask": mask})
    return masked.select(*kept, runs_of(F.col("mask"), F.col("tile_width")).alias("runs"))


def filled_cells(runs: Column) -> Column:
    return F.aggregate(runs, F.lit(0), lambda total, r: total + r["c1"] - r["c0"] + 1)


def mask_fill(masked: DataFrame) -> DataFrame:
    """Non-empty masks with their share of set cells."""
    counted = computed_once(masked, {"filled": filled_cells(F.col("runs"))})
    return counted.where(F.col("filled") > 0).withColumn(
        "fill_ratio", F.col("filled") / (F.col("tile_width") * F.col("tile_height"))
    )


def filled_masks(masked: DataFrame, min_ratio: float) -> DataFrame:
    return mask_fill(masked).where(F.col("fill_ratio") >= F.lit(min_ratio))


def run_rows(masked: DataFrame) -> DataFrame:
    """One row per run."""
    return masked.select(*SIZED_TILE, F.explode("runs").alias("r")).select(*SIZED_TILE, "r.*")


def mask_cells(masked: DataFrame) -> DataFrame:
    """One row per set cell, for small results and checks."""
    runs = run_rows(masked)
    return runs.select(*TILE, "row", F.explode(F.sequence("c0", "c1")).alias("col"))


def _pieces(one: Column, spans: Column) -> Column:
    """Parts of a run outside sorted, disjoint spans."""
    starts = F.concat(F.array(one["c0"]), F.transform(spans, lambda s: F.greatest(s["c1"] + 1, one["c0"])))
    ends = F.concat(F.transform(spans, lambda s: F.least(s["c0"] - 1, one["c1"])), F.array(one["c1"]))
    parts = F.zip_with(starts, ends, lambda a, b: run(one["row"], a, b))
    return F.filter(parts, lambda p: p["c0"] <= p["c1"])


def subtract_spans(masked: DataFrame, spans: DataFrame) -> DataFrame:
    """Masked tiles without the cells of the spans (TILE, row, c0, c1; disjoint per row).

    Spans become one array per tile, indexed by row, so a run looks its row up directly.
    """
    no_spans = F.array().cast("array<struct<c0:int,c1:int>>")
    by_row = spans.groupBy(*TILE, "row").agg(F.array_sort(F.collect_list(F.struct("c0", "c1"))).alias("spans"))
    by_tile = by_row.groupBy(*TILE).agg(F.array_sort(F.collect_list(F.struct("row", "spans"))).alias("rows"))
    first, last = F.col("rows")[0]["row"], F.element_at("rows", -1)["row"]
    filled = F.flatten(F.transform("rows", lambda r, i: F.concat(
        F.array_repeat(no_spans, r["row"] - F.when(i == 0, first).otherwise(F.get("rows", i - 1)["row"] + 1)),
        F.array(r["spans"]))))
    indexed = by_tile.select(*TILE, first.alias("first_row"), last.alias("last_row"), filled.alias("by_row"))
    joined = masked.join(indexed, TILE, "left")

    def outside(r: Column) -> Column:
        inside_rows = r["row"].between(F.col("first_row"), F.col("last_row"))
        own = F.when(inside_rows, F.get("by_row", r["row"] - F.col("first_row"))).otherwise(no_spans)
        return _pieces(r, own)

    clipped = F.when(F.col("by_row").isNull(), F.col("runs")).otherwise(F.flatten(F.transform("runs", outside)))
    return joined.withColumn("runs", clipped).drop("first_row", "last_row", "by_row")
