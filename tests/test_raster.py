import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastertables.fixtures import PARAMS, Inputs
from rastertables.functions.crs import pixel_to_wgs84
from rastertables.operators import blocks, kernels, masks, raster, zones
from rastertables.operators.ranking import number_within
from rastertables.operators.selection import exact_quantiles
from rastertables.params import SceneParams

SCENE = "scene_key string, width int, height int"


def tile_frame(spark, *bands, width=4, height=4):
    data = [("s", 4 * n, 0, width, height, [float(v) if v is not None else None for v in band])
            for n, band in enumerate(bands)]
    return spark.createDataFrame(
        data, "scene_key string, tile_x int, tile_y int, tile_width int, tile_height int, band array<double>")


@pytest.mark.parametrize("tile_size", [3, 5, 8, 64])
def test_pixels_and_chunks_give_the_same_tiles(spark, as_rows, tile_size):
    rng = np.random.default_rng(tile_size)
    width, height = 21, 14
    values = rng.normal(size=(height, width))
    holes = rng.random((height, width)) < 0.2
    pixels = [("s", x, y, float(values[y, x])) for y in range(height) for x in range(width) if not holes[y, x]]
    chunks = []
    for y in range(0, height, 5):
        for x in range(0, width, 8):
            part = values[y:y + 5, x:x + 8]
            gone = holes[y:y + 5, x:x + 8]
            band = [None if g else float(v) for v, g in zip(part.ravel(), gone.ravel())]
            chunks.append(("s", x, y, part.shape[1], part.shape[0], band))
    scenes = spark.createDataFrame([("s", width, height)], SCENE)
    from_pixels = blocks.blocks_from_pixels(
        spark.createDataFrame(pixels, "scene_key string, px int, py int, value double"), scenes, tile_size)
    from_chunks = blocks.tiles_from_chunks(
        spark.createDataFrame(chunks, "scene_key string, chunk_x int, chunk_y int, chunk_width int, chunk_height int, band array<double>"),
        scenes, tile_size)
    assert as_rows(from_pixels.select(*blocks.SIZED_TILE, "band")) == as_rows(from_chunks.select(*blocks.SIZED_TILE, "band"))
    assert as_rows(blocks.pixels_from_blocks(from_chunks)) == sorted(pixels, key=lambda r: tuple((True, str(v)) for v in r))


def test_aligned_chunks_are_not_shuffled(spark, sf_dir):
    kept = Inputs(spark, sf_dir).kept()
    assert "Exchange hashpartitioning" not in kept._jdf.queryExecution().executedPlan().toString()


def test_quality_gate(spark):
    inf, nan = float("inf"), float("nan")
    empty = [0] * 16
    constant = [5] * 16
    two_of_sixteen = [1, 2] + [0] * 14
    one_of_sixteen = [1] + [0] * 15
    infinite = [1, 2, inf, -inf, nan, None] + [0] * 10
    kept = raster.valid_tiles(
        tile_frame(spark, empty, constant, two_of_sixteen, one_of_sixteen, infinite), SceneParams(tile_size=4, min_valid_ratio=2 / 16))
    got = {r["tile_x"]: (r["valid_count"], r["value_min"], r["value_max"]) for r in kept.collect()}
    assert got == {8: (2, 1.0, 2.0), 16: (2, 1.0, 2.0)}


def test_tiny_background_is_invalid(spark):
    blanked = raster.blank_invalid(tile_frame(spark, [1e-12, 1.1e-12, -1.1e-12, 0] + [1] * 12)).first()["band"]
    assert blanked[:4] == [None, 1.1e-12, -1.1e-12, None]


@pytest.mark.parametrize("cap", [1, 3, 4, 7, 16, 100])
def test_contrast_sample(spark, cap):
    band = [float(v) if v % 5 else None for v in range(16)]
    values = [v for v in band if v is not None]
    expected = values if len(values) <= cap else values[::max(1, len(values) // cap)][:cap]
    sampled = raster.sample_contrast(tile_frame(spark, band), cap)
    assert sorted(r["value"] for r in sampled.collect()) == sorted(expected)


@pytest.mark.parametrize("seed", range(3))
def test_kernels_equal_the_column_operators(spark, as_rows, seed):
    rng = np.random.default_rng(seed)
    bands = []
    for _ in range(6):
        band = np.round(rng.normal(size=16), 3)
        band[rng.random(16) < 0.3] = 0.0
        bands.append([None if rng.random() < 0.1 else v for v in band])
    bands += [[0.0] * 16, [3.0] * 16, [float("nan")] * 16, [None] * 16, [float("inf"), 1.0] + [0.0] * 14]
    params = SceneParams(tile_size=4, min_valid_ratio=0.3)
    tiles = tile_frame(spark, *bands)
    kept = raster.valid_tiles(tiles, params)
    stats = ["tile_x", "valid_count", "total_count", "value_min", "value_max"]
    summaries = kernels.good_summaries(kernels.tile_summaries(tiles, params), params).cache()
    assert as_rows(summaries.select(*stats)) == as_rows(kept.select(*stats))
    exact = raster.contrast_bounds(raster.valid_values(kept)).first()
    assert tuple(raster.scene_bounds(tiles, summaries, params).first())[1:] == pytest.approx(tuple(exact)[1:], rel=1e-12)
    bounds = spark.createDataFrame([("s", -1.0, 1.0)], "scene_key string, low double, high double")
    columns = masks.segment_tiles(
        raster.drop_black_tiles(raster.stretch(kept, bounds)).select(*blocks.SIZED_TILE, "band", "grey"), lambda g: g > 128)
    fused = kernels.masked_tiles(raster.with_bounds(tiles, bounds), params, kernels.threshold_model(128))
    assert as_rows(fused.select("tile_x", "runs")) == as_rows(columns.select("tile_x", "runs"))


@pytest.mark.parametrize("kind", ["normal", "duplicates", "constant", "single", "outliers"])
def test_quantiles_equal_numpy(spark, kind):
    rng = np.random.default_rng(3)
    data = {
        "normal": rng.normal(size=4001), "duplicates": rng.integers(0, 3, size=2000).astype(float),
        "constant": np.full(50, 2.5), "single": np.array([7.0]),
        "outliers": np.concatenate([rng.normal(size=3000), [1e12, -1e12]]),
    }[kind]
    frame = spark.createDataFrame([("a", float(v)) for v in data] + [("b", 1.0), ("b", 2.0)], "k string, v double")
    got = {r["k"]: (r["low"], r["mid"], r["high"]) for r in exact_quantiles(
        frame, "k", "v", {"low": 0.02, "mid": 0.5, "high": 0.98}).collect()}
    assert got["a"] == pytest.approx(tuple(np.percentile(data, [2, 50, 98])), rel=1e-12)
    assert got["b"] == pytest.approx((1.02, 1.5, 1.98))


def test_numbering_is_dense_and_ordered(spark):
    rng = np.random.default_rng(1)
    cells = {("ab"[g], int(y), int(x)) for g, y, x in rng.integers(0, (2, 30, 30), size=(300, 3))}
    frame = spark.createDataFrame(sorted(cells, key=str), "k string, y int, x int")
    numbered = number_within(frame, ["k"], ["y"], ["x"], "n").collect()
    for group in "ab":
        assert [(r["y"], r["x"]) for r in sorted((r for r in numbered if r["k"] == group), key=lambda r: r["n"])] == sorted(
            (y, x) for k, y, x in cells if k == group)
        assert sorted(r["n"] for r in numbered if r["k"] == group) == list(range(sum(k == group for k, _, _ in cells)))


def test_data_window(spark):
    scenes = spark.createDataFrame([("s", 10000, 9000), ("none", 50, 60)], SCENE)
    summaries = spark.createDataFrame(
        [("s", 2000, 1000, 500, 200, 500, 200), ("s", 4000, 1000, 100, 300, 100, 300), ("none", 0, 0, None, None, None, None)],
        "scene_key string, tile_x int, tile_y int, min_col int, min_row int, max_col int, max_row int")
    got = {r["scene_key"]: tuple(r)[1:] for r in raster.data_window(summaries, scenes, SceneParams(tile_size=1000)).collect()}
    assert got == {"s": (2000, 1000, 5000, 2000), "none": (0, 0, 50, 60)}


CHUNKS = "scene_key string, chunk_x int, chunk_y int, chunk_width int, chunk_height int, band array<double>"


def test_zone_maps_spare_empty_chunks(spark, tmp_path):
    """Zones equal what the cells say; files of empty chunks are not opened, and zones need no cells."""
    rng = np.random.default_rng(2)
    chunks, expected = [], {}
    for n in range(60):
        band = np.where(rng.random((5, 7)) < rng.choice([0, 0, 0.1, 0.6]), rng.normal(size=(5, 7)), rng.choice([0.0, np.nan, np.inf, 1e-13]))
        chunks.append(("ab"[n % 2], 7 * n, 0, 7, 5, band.ravel().tolist()))
        at = np.argwhere(np.isfinite(band) & (np.abs(band) > 1e-12))
        if len(at):
            values = band[at[:, 0], at[:, 1]]
            expected["ab"[n % 2], 7 * n] = (len(at), values.min(), values.max(), *at.min(0)[::-1], *at.max(0)[::-1])
    chunks += [("c", 0, 0, 7, 5, [1.0] * 3), ("c", 7, 0, 7, 5, None), ("c", 14, 0, 7, 5, [None] * 35)]
    path = str(tmp_path / "zoned")
    zones.store_chunks(spark.createDataFrame(chunks, CHUNKS), path)
    assert zones.all_chunks(spark, path).count() == 63
    for part in (tmp_path / "zoned" / "filled=false").glob("*.parquet"):
        part.write_bytes(b"no parquet at all")  # whoever opens it fails
    filled = zones.filled_chunks(spark, path).collect()
    assert {(r["scene_key"], r["chunk_x"]) for r in filled} == {*expected, ("c", 0), ("c", 7)}
    got = {(r["scene_key"], r["chunk_x"]): tuple(r)[5:12] for r in zones.chunk_zones(spark, path).where("error is null").collect()}
    assert got == expected and 20 < len(expected) < 50
    assert {r["chunk_x"] for r in zones.chunk_zones(spark, path).where("error is not null").collect()} == {0, 7}
    plan = zones.zone_window(zones.chunk_zones(spark, path), spark.createDataFrame([("a", 420, 5)], SCENE), SceneParams(tile_size=7))
    text = plan._jdf.queryExecution().toString()
    read = [line for line in text.splitlines() if "FileScan parquet" in line]
    assert read and all("band" not in line for line in read) and all("PartitionFilters: [isnotnull(filled" in line for line in read)


def test_window_by_zones_equals_window_by_summaries(spark, sf_dir):
    from rastertables.fixtures import CLIPPED_GRID, Inputs

    inputs = Inputs(spark, sf_dir)
    by_zones = zones.zone_window(zones.chunk_zones(spark, inputs.stored_chunks()), inputs.scenes, CLIPPED_GRID)
    by_tiles = raster.data_window(inputs.summaries(CLIPPED_GRID), inputs.scenes, CLIPPED_GRID)
    assert sorted(map(tuple, by_zones.collect())) == sorted(map(tuple, by_tiles.collect()))


@pytest.mark.parametrize("low, high, n", [(0.5, 2.0, 5000), (-1e300, 1e300, 50), (-3.0, 3.0, 5000), (7.0, 7.0, 3)])
def test_counted_buckets(low, high, n):
    values = np.random.default_rng(1).uniform(low / 2, high / 2, n) * 2
    expected = np.unique(kernels.bucket_of(values), return_counts=True)
    for got, wanted in zip(kernels.counted_buckets(values), expected):
        assert got.tolist() == wanted.tolist()


def test_stretch_clips_and_truncates(spark):
    kept = raster.valid_tiles(tile_frame(spark, [-5, 1, 1.5, 2, 3, 9, None, 0] + [1] * 8), SceneParams(tile_size=4))
    bounds = spark.createDataFrame([("s", 1.0, 3.0)], "scene_key string, low double, high double")
    grey = raster.stretch(kept, bounds).first()["grey"]
    assert grey[:8] == [0, 0, 63, 127, 255, 255, 0, 0]


def utm_forward(lon, lat, zone):
    """Forward transverse Mercator by the classic power series, as an independent check."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    phi, lam = math.radians(lat), math.radians(lon - (6 * zone - 183))
    n = a / math.sqrt(1 - e2 * math.sin(phi) ** 2)
    t, c, A = math.tan(phi) ** 2, ep2 * math.cos(phi) ** 2, lam * math.cos(phi)
    steps = 2000  # meridian arc by Simpson's rule
    nodes = np.linspace(0.0, phi, 2 * steps + 1)
    arc = a * (1 - e2) / (1 - e2 * np.sin(nodes) ** 2) ** 1.5
    m = phi / (6 * steps) * (arc[0] + arc[-1] + 4 * arc[1::2].sum() + 2 * arc[2:-1:2].sum())
    x = k0 * n * (A + (1 - t + c) * A**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * A**5 / 120) + 500000
    y = k0 * (m + n * math.tan(phi) * (A * A / 2 + (5 - t + 9 * c + 4 * c * c) * A**4 / 24
                                       + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * A**6 / 720))
    return float(x), float(y)


GRID = "epsg int, a double, b double, c double, d double, e double, f double"


@pytest.mark.parametrize("lon,lat,zone", [(68.2, 75.1, 42), (69.0, 0.5, 42), (71.3, -33.0, 42), (-179.0, 60.0, 1)])
def test_utm_round_trip(spark, lon, lat, zone):
    x, y = utm_forward(lon, lat, zone)
    south = lat < 0
    frame = spark.createDataFrame([(32700 + zone if south else 32600 + zone, 1.0, 0.0, x, 0.0, -1.0, y + (1e7 if south else 0.0))], GRID)
    got = frame.select(pixel_to_wgs84(F.lit(0), F.lit(0)).alias("p")).first()["p"]
    assert (got["lon"], got["lat"]) == pytest.approx((lon, lat), abs=2e-9)


def test_reference_systems(spark):
    place = lambda epsg: spark.createDataFrame([(epsg, 0.5, 0.0, 10.0, 0.0, -0.5, 20.0)], GRID).select(
        pixel_to_wgs84(F.lit(4), F.lit(2)).alias("p")).first()["p"]
    assert tuple(place(4326)) == (12.0, 19.0)
    assert place(None) is None
    assert place(2154) is None


def test_shared_corners_are_identical(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    cornered = raster.tile_corners(inputs.numbered(PARAMS), inputs.scenes).collect()
    at = {(r["scene_key"], r["tile_x"], r["tile_y"]): r for r in cornered}
    pairs = [(r, at[r["scene_key"], r["tile_x"] + r["tile_width"], r["tile_y"]]) for r in cornered
             if (r["scene_key"], r["tile_x"] + r["tile_width"], r["tile_y"]) in at]
    assert len(pairs) > 100
    assert all(a["top_right_lon"] == b["top_left_lon"] and a["bottom_right_lat"] == b["bottom_left_lat"] for a, b in pairs)


def test_bounds_see_every_cell(spark):
    """The upper half of a tile is dark; only the lower half decides the high bound."""
    band = [1.0 + i * 1e-6 for i in range(5000)] + [100.0 + i for i in range(5000)]
    tiles = tile_frame(spark, band, width=100, height=100)
    params = SceneParams(tile_size=100)
    kept = kernels.good_summaries(kernels.tile_summaries(tiles, params), params).cache()
    got = raster.scene_bounds(tiles, kept, params).first()
    assert (got["low"], got["high"]) == pytest.approx(tuple(np.percentile(band, [2, 98])), rel=1e-12)


def test_buckets_keep_the_order():
    values = np.sort(np.concatenate([np.random.default_rng(2).normal(size=500) * 10.0 ** np.arange(-250, 250), [0.0, -0.0, np.inf, -np.inf]]))
    assert (np.diff(kernels.bucket_of(values)) >= 0).all()


def test_extent_of_valid_cells(spark):
    band = [0.0] * 16
    band[6] = band[9] = 2.0
    row = kernels.tile_summaries(tile_frame(spark, band), SceneParams(tile_size=4)).first()
    assert (row["min_col"], row["min_row"], row["max_col"], row["max_row"]) == (1, 1, 2, 2)


def test_bad_band_is_an_error_of_its_tile(spark):
    rows = [("s", 0, 0, 4, 4, [1.0, 2.0]), ("s", 4, 0, 4, 4, None), ("s", 8, 0, 4, 4, [float(v) for v in range(16)])]
    tiles = spark.createDataFrame(rows, "scene_key string, tile_x int, tile_y int, tile_width int, tile_height int, band array<double>")
    got = {r["tile_x"]: (r["valid_count"], r["error"]) for r in kernels.tile_summaries(tiles, SceneParams(tile_size=4)).collect()}
    assert got[8] == (15, None) and "2 cells" in got[0][1] and "0 cells" in got[4][1]


def test_two_predictors_in_one_session(spark):
    tiles = tile_frame(spark, [float(v) for v in range(16)]).crossJoin(spark.createDataFrame([(0.0, 15.0)], "low double, high double"))
    params = SceneParams(tile_size=4)

    def cells(threshold):
        runs = kernels.masked_tiles(tiles, params, kernels.threshold_model(threshold)).first()["runs"]
        return sum(r["c1"] - r["c0"] + 1 for r in runs)

    assert [cells(128), cells(250), cells(128)] == [8, 1, 8]


def test_polar_grids_round_trip(spark):
    """Points of a plain forward projection come back."""
    import math

    from rastertables.functions import crs

    e = math.sqrt(crs.FLATTENING * (2 - crs.FLATTENING))
    rows = []
    for code, (true, meridian) in crs.POLAR_GRIDS.items():
        side = math.copysign(1, true)
        for lat in (60.0, 71.5, 83.0, 89.99):
            for lon in (-170.0, -45.0, 0.0, 12.5, 135.0, 179.0):
                phi = math.radians(lat)
                t = math.tan(math.pi / 4 - phi / 2) / ((1 - e * math.sin(phi)) / (1 + e * math.sin(phi))) ** (e / 2)
                rho, turn = crs.polar_scale(true) * t, math.radians(lon - meridian)
                rows.append((code, rho * math.sin(turn), -side * rho * math.cos(turn), lon, side * lat))
    frame = spark.createDataFrame(rows, "epsg int, c double, f double, lon double, lat double")
    frame = frame.select("*", *(F.lit(0.0).alias(n) for n in "abde"))
    for r in frame.withColumn("p", pixel_to_wgs84(F.lit(0), F.lit(0))).collect():
        assert abs(r["p"]["lat"] - r["lat"]) < 1e-9 and abs((r["p"]["lon"] - r["lon"] + 180) % 360 - 180) < 1e-8


def test_unknown_reference_system_gives_null(spark):
    frame = spark.createDataFrame([(9999,), (None,)], "epsg int").select("epsg", *(F.lit(1.0).alias(n) for n in "abcdef"))
    assert [r["p"] for r in frame.select(pixel_to_wgs84(F.lit(0), F.lit(0)).alias("p")).collect()] == [None, None]
