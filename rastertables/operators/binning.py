"""Joins of boxes by degree cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rastertables.functions.bbox import Box, bounds_intersect


def degree_bin(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(size))


def in_bins(df: DataFrame, size: float) -> DataFrame:
    """One row per degree cell a box (west, south, east, north) covers."""
    first_x, first_y = degree_bin(F.col("west"), size), degree_bin(F.col("south"), size)
    spread = df.withColumns({"first_x": first_x, "first_y": first_y})
    spread = spread.withColumn("bin_x", F.explode(F.sequence("first_x", degree_bin(F.col("east"), size))))
    return spread.withColumn("bin_y", F.explode(F.sequence("first_y", degree_bin(F.col("north"), size))))


def bin_pairs(left: DataFrame, right: DataFrame, size: float, on: list[str] | None = None) -> DataFrame:
    """Pairs whose boxes meet, each once.

    Both sides are spread over degree cells and joined on the cell. A pair is reported in the
    first cell both cover, so no duplicate has to be removed afterwards.
    """
    keys = (on or []) + ["bin_x", "bin_y"]
    own = {"west", "south", "east", "north", "first_x", "first_y"}
    a = in_bins(left, size).select(*keys, *(F.col(c).alias(f"_l_{c}") if c in own else F.col(c)
                                            for c in [*left.columns, "first_x", "first_y"] if c not in keys))
    b = in_bins(right, size).select(*keys, *(F.col(c).alias(f"_r_{c}") if c in own else F.col(c)
                                             for c in [*right.columns, "first_x", "first_y"] if c not in keys))
    first_common = (
        (F.col("bin_x") == F.greatest("_l_first_x", "_r_first_x"))
        & (F.col("bin_y") == F.greatest("_l_first_y", "_r_first_y"))
    )
    return a.join(b, keys).where(first_common & bounds_intersect(Box.of("_l_"), Box.of("_r_")))
