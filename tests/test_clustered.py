import numpy as np
from pyspark.sql import functions as F

from rastertables.sources import clustered

CORNERS = ("top_left", "top_right", "bottom_right", "bottom_left")
SCHEMA = "source_object_key string, filename string, " + ", ".join(f"{c}_lon double, {c}_lat double" for c in CORNERS) + ", extra string"


def tile(name, west, south, side=0.1):
    if west is None:
        return ("s", name, *[None] * 8, "x")
    east, north = west + side, south + side
    return ("s", name, west, north, east, north, east, south, west, south, "x")


def frame(spark, n=4000, seed=3):
    rng = np.random.default_rng(seed)
    rows = [tile(f"t{i}", float(rng.uniform(-170, 170)), float(rng.uniform(-80, 80))) for i in range(n)]
    rows += [tile(f"hot{i}", 10.0, 20.0) for i in range(1000)] + [tile("none", None, None), tile("big", -100.0, -40.0, 60.0)]
    return spark.createDataFrame(rows, SCHEMA), rows


def names(found):
    return sorted(r["filename"] for r in found.select("filename").collect())


def meet(rows, view):
    west, south, east, north = view
    return sorted(r[1] for r in rows if r[2] is not None and r[4] >= west and r[2] <= east and r[3] >= south and r[7] <= north)


def test_a_view_opens_few_files(spark, tmp_path):
    tiles, rows = frame(spark)
    clustered.store_clustered(tiles, f"{tmp_path}/s", "a", file_rows=50)
    assert names(clustered.read_clustered(spark, f"{tmp_path}/s", tiles.schema)) == sorted(r[1] for r in rows)
    total = len(clustered.read_clustered(spark, f"{tmp_path}/s", tiles.schema).inputFiles())
    assert total > 60
    for view in ((50.0, 30.0, 52.0, 32.0), (-150.0, -70.0, -149.0, -68.0), (100.0, 0.5, 104.0, 3.0)):
        found = clustered.read_clustered(spark, f"{tmp_path}/s", tiles.schema, view)
        assert len(found.inputFiles()) <= 6
        assert names(found) == meet(rows, view)
        assert "PushedFilters: [IsNotNull(box_" in found._jdf.queryExecution().executedPlan().toString()
    hot = clustered.read_clustered(spark, f"{tmp_path}/s", tiles.schema, (10.0, 20.0, 10.01, 20.01))
    assert len(hot.inputFiles()) > 10 and names(hot) == meet(rows, (10.0, 20.0, 10.01, 20.01))
    world = clustered.read_clustered(spark, f"{tmp_path}/s", tiles.schema, (-180, -90, 180, 90), named_files=5)
    assert names(world) == meet(rows, (-180, -90, 180, 90))
    assert hot.columns == tiles.columns


def test_layers_are_added_and_replaced(spark, tmp_path):
    one = spark.createDataFrame([tile("a", 0.0, 0.0), tile("b", 1.0, 1.0)], SCHEMA)
    two = spark.createDataFrame([tile("c", 0.0, 0.0)], SCHEMA)
    path = f"{tmp_path}/s"
    for layer, rows in (("x", one), ("y", two), ("x", one)):
        clustered.store_clustered(rows, path, layer)
    assert names(clustered.read_clustered(spark, path, one.schema)) == ["a", "b", "c"]
    clustered.store_clustered(two, path, "x")
    assert names(clustered.read_clustered(spark, path, one.schema, (0, 0, 0.05, 0.05))) == ["c", "c"]
    assert names(clustered.read_clustered(spark, path, one.schema, (50, 50, 51, 51))) == []
    clustered.store_clustered(one.limit(0), path, "x")
    assert names(clustered.read_clustered(spark, path, one.schema)) == ["c"]
    clustered.store_clustered(one.limit(0), f"{tmp_path}/empty", "x")
    assert names(clustered.read_clustered(spark, f"{tmp_path}/empty", one.schema)) == []


def test_the_key_takes_bits_by_turns(spark):
    points = [(-180.0, -90.0), (180.0, 90.0), (12.5, 41.3), (-0.001, 0.001), (None, 1.0)]
    got = spark.createDataFrame(points, "lon double, lat double").select(clustered.curve_key(F.col("lon"), F.col("lat")).alias("k")).collect()

    def key(lon, lat):
        x, y = (min(int(np.floor((v - low) / span * 2**20)), 2**20 - 1) for v, low, span in ((lon, -180, 360), (lat, -90, 180)))
        return sum(((x >> b & 1) << 2 * b) | ((y >> b & 1) << 2 * b + 1) for b in range(20))

    assert [r["k"] for r in got] == [key(*p) if p[0] is not None else None for p in points]
