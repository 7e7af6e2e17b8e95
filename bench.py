"""Time the headline queries and print one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the data and the cores. Stored input tables (raster
chunks, scenes, tiles, masks, land edges) are written once and their time is reported
under "load"; every query then runs to its last row. Tiles of full size are timed apart.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = (
    "list_raw_objects", "source_names", "pending_keys", "upsert_tasks", "upsert_tiles", "image_catalog",
    "order_catalog", "recent_tasks", "processing_overview", "tiles_in_viewports", "scene_search",
    "valid_tiles", "valid_tiles_clipped_grid", "tiles_from_chunks", "data_window", "contrast_bounds", "stretch",
    "number_tiles", "tile_corners", "segment_tiles", "segment_with_model", "land_candidates", "rasterize_land",
    "clip_mask_to_water", "polygonize", "component_rings", "merge_masks", "close_gaps", "validate_corners",
    "footprint_sides", "scene_footprint", "process_scenes", "processed_polygons", "task_state_stream",
)


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("rastertables-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="rastertables-"))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def full_size(spark: SparkSession, tiles: int = 16, side: int = 1000) -> dict[str, float]:
    """Million pixels a second of the cell kernels on tiles of full size, made of scattered numbers."""
    from pyspark.sql import functions as F

    from rastertables.operators import components, kernels, raster, rings
    from rastertables.params import SceneParams
    from rastertables.storage import materialize

    params, cells = SceneParams(tile_size=side), F.sequence(F.lit(0), F.lit(side * side - 1))
    noise = F.transform(cells, lambda i: (F.pmod(F.xxhash64("id", i), F.lit(10007)) + F.floor(i / 4000)).cast("double"))
    placed = spark.range(tiles, numPartitions=tiles).select(
        F.lit("s").alias("scene_key"), (F.col("id") * side).cast("int").alias("tile_x"), F.lit(0).alias("tile_y"),
        F.lit(side).alias("tile_width"), F.lit(side).alias("tile_height"), noise.alias("band"))
    stored, rate = materialize(placed, "full-size"), {}

    def timed(name: str, run):
        started = time.perf_counter()
        done = run()
        rate[name] = round(tiles * side * side / 1e6 / (time.perf_counter() - started), 1)
        return done

    summaries = timed("summaries", lambda: materialize(kernels.tile_summaries(stored, params), "full-summaries"))
    bounds = timed("bounds", lambda: raster.scene_bounds(stored, summaries, params))
    masked = timed("masks", lambda: materialize(
        kernels.masked_tiles(raster.with_bounds(stored, bounds), params, kernels.threshold_model(128)), "full-masks"))
    polygons = timed("polygons", lambda: materialize(components.polygonize(masked.drop("error", "model_missing")), "full-polygons"))
    timed("rings", lambda: rings.component_rings(polygons).write.format("noop").mode("overwrite").save())
    return rate


def main() -> None:
    from rastertables.fixtures import Inputs
    from rastertables.queries import REGISTRY

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))

    started = time.perf_counter()
    inputs = Inputs(spark, sf_dir)
    for table in (inputs.chunks, inputs.scenes, inputs.tiles, inputs.masked, inputs.land_edges):
        table.write.format("noop").mode("overwrite").save()
    load = time.perf_counter() - started

    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    rates = full_size(spark)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "load": round(load, 3), "full_size_mpx_per_sec": rates, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
