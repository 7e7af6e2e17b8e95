"""Exact quantiles per group without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rastertables.storage import broadcast_if_small, materialize

SKETCH_ACCURACY = 10_000


def exact_quantiles(df: DataFrame, key: str, value: str, quantiles: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles of `value` per `key`, one column for each name.

    A mergeable sketch brackets every quantile, which cuts each group into a few segments.
    Segment sizes are counted exactly, and only a segment that holds a wanted rank is sorted,
    with equal values counted first. A poor bracket would make a segment larger, never the
    answer wrong. `df` is read three times, so pass a written table.
    """
    fractions = list(quantiles.values())
    margin = 2.0 / SKETCH_ACCURACY
    probes = sorted({min(1.0, max(0.0, f + s * margin)) for f in fractions for s in (-1, 1)})
    brackets = materialize(
        df.groupBy(key).agg(
            F.percentile_approx(value, probes, SKETCH_ACCURACY).alias("_cuts"),
            F.count(F.lit(1)).alias("_total"),
        ),
        "brackets",
    )
    segment = sum(
        (F.when(F.col(value) > F.col("_cuts")[i], 1).otherwise(0) for i in range(len(probes))), F.lit(0)
    )

    def position(fraction: float) -> Column:
        return F.lit(fraction) * (F.col("_total") - 1)

    placed = df.join(broadcast_if_small(brackets), key).withColumn("_segment", segment)
    in_order = Window.partitionBy(key).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        placed.groupBy(key, "_segment", "_total").agg(F.count(F.lit(1)).alias("_size"))
        .withColumn("_before", F.coalesce(F.sum("_size").over(in_order), F.lit(0)))
    )
    ranks = F.array_distinct(F.flatten(F.array(*(
        F.array(F.floor(position(f)), F.ceil(position(f))) for f in fractions
    ))))
    here = F.filter(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_size")))
    hit = sizes.select(key, "_segment", "_before", here.alias("_ranks")).where(F.size("_ranks") > 0)

    inside = (
        Window.partitionBy(key, "_segment").orderBy(value)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = (
        placed.join(broadcast_if_small(hit, counted=brackets), [key, "_segment"])
        .groupBy(key, "_segment", value, "_total", "_before", "_ranks").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_stop", F.col("_before") + F.sum("_n").over(inside))
        .withColumn("_start", F.col("_stop") - F.col("_n"))
    )
    found = ranked.select(
        key, "_total", value,
        F.explode(F.filter("_ranks", lambda r: (r >= F.col("_start")) & (r < F.col("_stop")))).alias("_rank"),
    )

    def at_rank(rank: Column) -> Column:
        return F.max(F.when(F.col("_rank") == rank, F.col(value)))

    def interpolated(fraction: float) -> Column:
        at = position(fraction)
        lower, upper = at_rank(F.floor(at)), at_rank(F.ceil(at))
        return lower + (upper - lower) * F.max(at - F.floor(at))

    return found.groupBy(key).agg(*(interpolated(f).alias(name) for name, f in quantiles.items()))
