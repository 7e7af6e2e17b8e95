"""Dense numbering that never sorts a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def number_within(
    df: DataFrame, group: list[str], coarse: list[str], fine: list[str | Column], name: str
) -> DataFrame:
    """0-based position of each row in its group, ordered by coarse, then fine.

    Two levels: rows are numbered inside each (group, coarse) cell, and cells get the number
    of rows before them. Only one row per cell meets in the window over the whole group.
    """
    cell = group + coarse
    before = (
        Window.partitionBy(*group).orderBy(*coarse)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        df.groupBy(*cell).agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .drop("_rows")
    )
    inside = F.row_number().over(Window.partitionBy(*cell).orderBy(*fine)) - 1
    return (
        df.withColumn("_inside", inside)
        .join(offsets, cell)
        .withColumn(name, (F.col("_before") + F.col("_inside")).cast("int"))
        .drop("_before", "_inside")
    )
