import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastertables.operators import closing, components, grid, kernels, land, masks, rings
from rastertables.params import SceneParams

TILE = "scene_key string, tile_x int, tile_y int, tile_width int, tile_height int"


def runs_of(mask):
    out = []
    for row, line in enumerate(mask):
        col = 0
        while col < len(line):
            if line[col]:
                start = col
                while col < len(line) and line[col]:
                    col += 1
                out.append((row, start, col - 1))
            else:
                col += 1
    return out


def masked_frame(spark, masks_by_tile):
    """masks_by_tile: (scene, x, y) -> 2-d boolean array."""
    data = [(s, x, y, m.shape[1], m.shape[0], runs_of(m)) for (s, x, y), m in masks_by_tile.items()]
    return spark.createDataFrame(data, TILE + ", runs array<struct<row:int,c0:int,c1:int>>")


def flood(mask):
    """Label image of 4-connected components by flood fill; -1 outside."""
    label = np.full(mask.shape, -1)
    for start in zip(*np.nonzero(mask)):
        if label[start] >= 0:
            continue
        seed = start[0] * mask.shape[1] + start[1]
        todo = [start]
        while todo:
            y, x = todo.pop()
            if 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and mask[y, x] and label[y, x] < 0:
                label[y, x] = seed
                todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    return label


def spiral(n):
    """One cell wide spiral: one long component."""
    out = np.zeros((n, n), dtype=bool)
    y, x, dy, dx = 0, 0, 0, 1
    out[0, 0] = True
    for _ in range(n * n):
        ny, nx = y + dy, x + dx
        ahead = (ny + dy, nx + dx)
        free = 0 <= ny < n and 0 <= nx < n and not out[ny, nx]
        touches = 0 <= ahead[0] < n and 0 <= ahead[1] < n and out[ahead]
        if not free or touches:
            dy, dx = dx, -dy
            ny, nx = y + dy, x + dx
            if not (0 <= ny < n and 0 <= nx < n) or out[ny, nx]:
                break
            if 0 <= ny + dy < n and 0 <= nx + dx < n and out[ny + dy, nx + dx]:
                break
        y, x = ny, nx
        out[y, x] = True
    return out


@pytest.mark.parametrize("density", [0.1, 0.45, 0.6, 0.9])
def test_labels_equal_flood_fill(density):
    rng = np.random.default_rng(int(density * 100))
    for size in [(1, 1), (1, 30), (30, 1), (25, 40)]:
        mask = rng.random(size) < density
        runs = np.array(runs_of(mask), dtype=np.int64).reshape(-1, 3)
        labels = components.label_runs(*runs.T)
        expected = flood(mask)
        seeds = [runs[n][0] * size[1] + runs[n][1] for n in labels]
        assert seeds == [expected[r, c] for r, c, _ in runs]


def test_polygonize_equals_flood_fill(spark):
    tiles = {("s", 20 * n, 0): np.random.default_rng(n).random((11, 20)) < 0.2 * n for n in range(5)}
    got = components.polygonize(masked_frame(spark, tiles)).collect()
    for (_, x, _), mask in tiles.items():
        expected = flood(mask)
        own = [r for r in got if r["tile_x"] == x]
        cells = {(r["row"], c): p["seed_row"] * 20 + p["seed_col"] for p in own for r in p["runs"] for c in range(r["c0"], r["c1"] + 1)}
        assert cells == {(y, c): expected[y, c] for y, c in zip(*map(list, np.nonzero(mask)))}
        assert sum(p["cells"] for p in own) == mask.sum()
        for p in own:
            rows, cols = np.nonzero(expected == p["seed_row"] * 20 + p["seed_col"])
            assert (p["row_min"], p["row_max"], p["col_min"], p["col_max"]) == (rows.min(), rows.max(), cols.min(), cols.max())


def test_polygonize_does_not_shuffle(spark):
    frame = masked_frame(spark, {("s", 0, 0): np.ones((3, 3), dtype=bool)})
    assert "Exchange" not in components.polygonize(frame)._jdf.queryExecution().executedPlan().toString()


def test_spiral_is_one_component():
    mask = spiral(41)
    assert len(set(components.label_runs(*np.array(runs_of(mask)).T))) == 1


def test_runs_of_mask(spark):
    rng = np.random.default_rng(5)
    mask = rng.random((9, 7)) < 0.5
    frame = spark.createDataFrame([(mask.ravel().tolist(), 7)], "mask array<boolean>, w int")
    got = frame.select(masks.runs_of(F.col("mask"), F.col("w")).alias("r")).first()["r"]
    assert [tuple(r) for r in got] == runs_of(mask)


def test_model_on_a_coarser_grid_and_broken_model(spark):
    band = [None] + [float(v) for v in range(1, 36)]
    frame = spark.createDataFrame([("s", 0, 0, 6, 6, band, 0.0, 36.0)], TILE + ", band array<double>, low double, high double")
    params = SceneParams(tile_size=6)

    def quarter(image):
        return np.array([[1.0, -1.0], [0.0, 5.0]])

    def broken():
        raise ImportError("no weights")

    got = masks.mask_cells(kernels.masked_tiles(frame, params, lambda: quarter)).collect()
    expected = {(r, c) for r in range(6) for c in range(6) if (r < 3) == (c < 3)} - {(0, 0)}
    assert {(r["row"], r["col"]) for r in got} == expected
    empty = kernels.masked_tiles(frame, params, broken).collect()
    assert [(r["valid_count"], r["runs"], r["model_missing"]) for r in empty] == [(35, [], True)]


@pytest.mark.parametrize("requested,cuda,device", [
    ("auto", False, "cpu"), ("auto", True, "cuda"), ("cuda:1", True, "cuda:1"), ("cuda", False, "cpu"), ("CPU", True, "cpu")])
def test_choose_device(requested, cuda, device):
    assert kernels.choose_device(requested, cuda) == device


def test_a_loader_is_told_its_device(spark):
    frame = spark.createDataFrame(
        [("s", 0, 0, 6, 6, [float(v) for v in range(1, 37)], 1.0, 36.0)],
        "scene_key string, tile_x int, tile_y int, tile_width int, tile_height int, band array<double>, low double, high double")

    def load(device):
        return lambda image: np.full((1, 1), 1.0 if device == "cpu" else -1.0)

    for asked in ("auto", "cpu", "cuda:3"):  # no task of a local session has a GPU
        got = masks.mask_cells(kernels.masked_tiles(frame, SceneParams(tile_size=6, device=asked), load)).count()
        assert got == 36


def test_device_of_a_task_with_a_gpu(monkeypatch):
    monkeypatch.setattr(kernels, "task_devices", lambda: ["2", "3"])
    assert [kernels.task_device(r) for r in ("auto", "cpu", "cuda", "cuda:7")] == ["cuda:2", "cpu", "cuda:2", "cuda:7"]
    asked = []

    def load(device):
        asked.append(device)
        if device != "cpu":
            raise MemoryError(device)
        return device

    assert [kernels.load_once("broken there", load, "cuda:2") for _ in range(2)] == ["cpu", "cpu"]
    assert asked == ["cuda:2", "cpu"]
    assert kernels.load_once("plain", lambda: "model", "cuda:2") == "model"


def test_subtract_spans(spark):
    rng = np.random.default_rng(8)
    mask, gone = rng.random((12, 20)) < 0.6, rng.random((12, 20)) < 0.3
    gone[:3] = False
    frame = masked_frame(spark, {("s", 0, 0): mask, ("s", 20, 0): mask})
    spans = spark.createDataFrame([("s", 0, 0, *r) for r in runs_of(gone)],
                                  "scene_key string, tile_x int, tile_y int, row int, c0 int, c1 int")
    left = masks.mask_cells(masks.subtract_spans(frame, spans)).collect()
    assert {(r["row"], r["col"]) for r in left if r["tile_x"] == 0} == set(zip(*map(list, np.nonzero(mask & ~gone))))
    assert {(r["row"], r["col"]) for r in left if r["tile_x"] == 20} == set(zip(*map(list, np.nonzero(mask))))


def scene_image(seed, height=23, width=31, density=0.55):
    return np.random.default_rng(seed).random((height, width)) < density


def cut(image, size):
    return {("s", x, y): image[y:y + size, x:x + size]
            for y in range(0, image.shape[0], size) for x in range(0, image.shape[1], size)}


def close_by_brute_force(image, gap):
    offsets = [(dy, dx) for dy in range(-gap, gap + 1) for dx in range(-gap, gap + 1) if dy * dy + dx * dx <= gap * gap]
    grown = {(y + dy, x + dx) for y, x in zip(*np.nonzero(image)) for dy, dx in offsets}
    kept = {(y, x) for y, x in grown if all((y + dy, x + dx) in grown for dy, dx in offsets)}
    out = np.zeros_like(image)
    for y, x in kept:
        if 0 <= y < image.shape[0] and 0 <= x < image.shape[1]:
            out[y, x] = True
    return out, kept


@pytest.mark.parametrize("gap,density", [(0, 0.55), (1, 0.3), (2, 0.12), (3, 0.05)])
def test_merged_components_equal_flood_fill(spark, gap, density):
    image = scene_image(gap, density=density)
    scenes = spark.createDataFrame([("s", image.shape[1], image.shape[0])], "scene_key string, width int, height int")
    got = components.merge_masks(masked_frame(spark, cut(image, 7)), scenes, 7, gap).collect()
    closed, _ = close_by_brute_force(image, gap)
    expected = flood(closed)
    cells = {(r["row"], c): r["component"] for r in got for c in range(r["c0"], r["c1"] + 1)}
    assert cells == {(y, x): expected[y, x] for y, x in zip(*map(list, np.nonzero(closed)))}


@pytest.mark.parametrize("radii", [(2.3, 0.4), (0.0, 2.0), (1.2, 3.7), (3.0, 3.0)])
@pytest.mark.parametrize("seen_cells", [1 << 24, 0])
def test_closing_by_radii_of_scenes_across_blocks(spark, radii, seen_cells):
    image = scene_image(7, density=0.12)
    gap_x, gap_y = radii
    reach = int(max(radii)) + 1
    offsets = [
        (dy, dx) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)
        if (dy == 0 or gap_y > 0) and (dx == 0 or gap_x > 0) and (dy / (gap_y or 1)) ** 2 + (dx / (gap_x or 1)) ** 2 <= 1 + 1e-12]
    wide = {(y + dy, x + dx) for y, x in zip(*map(list, np.nonzero(image))) for dy, dx in offsets}
    expected = {(y, x) for y, x in wide if all((y + dy, x + dx) in wide for dy, dx in offsets)}
    runs = spark.createDataFrame([(k, *r) for k in ("s", "t", "u") for r in runs_of(image)], "scene_key string, row int, c0 int, c1 int")
    sizes = spark.createDataFrame([("s", gap_x, gap_y), ("u", None, None)], "scene_key string, gap_x double, gap_y double")
    got = closing.close_gaps(runs, sizes, block=8, seen_cells=seen_cells).collect()
    cells = {(r["scene_key"], r["row"], c) for r in got for c in range(r["c0"], r["c1"] + 1)}
    own = set(zip(*map(list, np.nonzero(image))))
    assert {c[1:] for c in cells if c[0] == "s"} == {(y, x) for y, x in expected if any((y + dy, x + dx) in wide for dy, dx in offsets)}
    assert {c[1:] for c in cells if c[0] == "t"} == own == {c[1:] for c in cells if c[0] == "u"}
    assert sum(r["c1"] - r["c0"] + 1 for r in got) == len(cells)


def test_closing_copies_no_run_by_offset(spark):
    runs = spark.range(2000).select(F.lit("s").alias("scene_key"), F.col("id").cast("int").alias("row"), F.lit(0).alias("c0"), F.lit(9).alias("c1"))
    few, many = (closing._in_blocks(runs.withColumns({"gap_x": F.lit(g), "gap_y": F.lit(g)}), 1024) for g in (2.0, 100.0))
    for frame in (few, many):
        assert "Window" not in frame._jdf.queryExecution().executedPlan().toString()
    assert joined_count(few) == joined_count(many) == 2000


def joined_count(frame):
    return closing.joined_runs(frame).where("c0 = 0 and c1 = 9").count()


def test_radii_of_a_scene_in_degrees(spark):
    scenes = spark.createDataFrame(
        [("g", 10, 10, 4326, 0.01, 0.0, 30.0, 0.0, -0.02, 60.0), ("m", 10, 10, 3857, 100.0, 0.0, 0.0, 0.0, -100.0, 8399737.9),
         ("n", 10, 10, None, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0)],
        "scene_key string, width int, height int, epsg int, a double, b double, c double, d double, e double, f double")
    got = {r["scene_key"]: (r["gap_x"], r["gap_y"]) for r in closing.radii_in_cells(scenes, 0.05).collect()}
    assert set(got) == {"g", "m"}
    assert got["g"] == pytest.approx((5.0, 2.5))
    assert got["m"] == pytest.approx((0.05 * 111319.49 / 100, 0.05 * 111319.49 / 100 / np.cos(np.radians(60))), rel=1e-3)


def test_components_of_a_path_and_a_hub(spark):
    path = [("p", n, n + 1) for n in range(0, 60)]
    hub = [("h", 1000, n) for n in range(0, 300)]
    frame = spark.createDataFrame(path + hub, "k string, u bigint, v bigint").withColumnRenamed("k", "scene_key")
    got = components.connected_components(frame, "scene_key").collect()
    assert {(r["scene_key"], r["u"], r["root"]) for r in got} == (
        {("p", n, 0) for n in range(1, 61)} | {("h", n, 0) for n in range(1, 300)} | {("h", 1000, 0)})


@pytest.mark.parametrize("seed", range(6))
def test_rings_enclose_their_cells(seed):
    mask = np.random.default_rng(seed).random((15, 18)) < 0.3 + 0.1 * seed
    runs = np.array(runs_of(mask), dtype=np.int64)
    labels = components.label_runs(*runs.T)
    for name in set(labels):
        own = runs[labels == name]
        traced = rings.trace_rings(*own.T)
        areas = []
        for ring in traced:
            points = list(zip(ring[::2], ring[1::2]))
            assert points[0] == points[-1] and len(set(points[:-1])) >= 4
            turns = [(a[0] == b[0]) != (b[0] == c[0]) for a, b, c in zip(points, points[1:], points[2:])]
            assert all(turns)
            areas.append(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:])) / 2)
        assert sum(areas) == (own[:, 2] - own[:, 1] + 1).sum()
        assert sum(a > 0 for a in areas) == 1


def in_polygon(x, y, edges):
    inside = False
    for x1, y1, x2, y2 in edges:
        if min(y1, y2) <= y < max(y1, y2) and x1 + (y - y1) * (x2 - x1) / (y2 - y1) > x:
            inside = not inside
    return inside


def meets_box(edge, w, s, e, n):
    x1, y1, x2, y2 = edge
    if min(x1, x2) > e or max(x1, x2) < w or min(y1, y2) > n or max(y1, y2) < s:
        return False
    sides = [(x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) for x in (w, e) for y in (s, n)]
    return min(sides) <= 0 <= max(sides)


def polygons():
    """A large star with a hole, a small triangle, and a shape that covers whole tiles."""
    star = []
    for k in range(11):
        r = 0.9 if k % 2 else 0.35
        star.append((1.0 + r * np.cos(2 * np.pi * k / 11), 1.0 + r * np.sin(2 * np.pi * k / 11)))
    hole = [(0.9, 0.9), (1.1, 0.92), (1.05, 1.13)]
    triangle = [(0.31, 1.71), (0.37, 1.77), (0.29, 1.79)]
    broad = [(1.33, -0.5), (2.7, -0.4), (2.6, 0.61), (1.21, 0.43)]
    return {1: [star, hole], 2: [triangle], 3: [broad]}


def land_frame(spark):
    data = []
    for poly, parts in polygons().items():
        for ring, points in enumerate(parts):
            data += [(poly, ring, n, float(x), float(y)) for n, (x, y) in enumerate(points + points[:1])]
    data += [(9, 0, n, 0.5, 0.5) for n in range(3)] + [(10, 0, n, None, 0.5) for n in range(5)]
    return spark.createDataFrame(data, "poly_id int, ring int, seq int, lon double, lat double")


def edge_lists():
    return {poly: [(*a, *b) for points in parts for a, b in zip(points, points[1:] + points[:1])]
            for poly, parts in polygons().items()}


def land_tiles(spark, slant=0.0):
    """A 5 by 5 grid of tiles over 0..2 degrees; corners slanted when asked."""
    data = []
    side = 0.4
    for row in range(5):
        for col in range(5):
            x, y = col * side, 2.0 - row * side
            corners = []
            for cx, cy in ((x, y), (x + side, y), (x + side, y - side), (x, y - side)):
                corners += [cx + slant * (2 - cy), cy + slant * cx]
            lon, lat = corners[::2], corners[1::2]
            data.append(("s", col * 9, row * 7, 9, 7, *map(float, corners), float(min(lon)), float(min(lat)), float(max(lon)), float(max(lat))))
    names = ", ".join(f"{c}_{a} double" for c in ("top_left", "top_right", "bottom_right", "bottom_left") for a in ("lon", "lat"))
    return spark.createDataFrame(data, f"{TILE}, {names}, west double, south double, east double, north double")


@pytest.mark.parametrize("bin_degrees", [0.07, 0.5, 3.0])
def test_land_raster_equals_brute_force(spark, bin_degrees):
    tiles, edges = land_tiles(spark), land.load_land(None, land_frame(spark))
    got = {(r["tile_x"], r["tile_y"], r["row"], c) for r in land.rasterize_land(tiles, edges, bin_degrees).collect()
           for c in range(r["c0"], r["c1"] + 1)}
    expected = set()
    for t in tiles.collect():
        dx, dy = (t["east"] - t["west"]) / 9, (t["north"] - t["south"]) / 7
        for row in range(7):
            for col in range(9):
                w, n = t["west"] + col * dx, t["north"] - row * dy
                for own in edge_lists().values():
                    if in_polygon(w + dx / 2, n - dy / 2, own) or any(meets_box(e, w, n - dy, w + dx, n) for e in own):
                        expected.add((t["tile_x"], t["tile_y"], row, col))
    assert got == expected and len(got) > 300


@pytest.mark.parametrize("slant", [0.0, 0.13, -0.4])
def test_centre_land_equals_brute_force(spark, slant):
    tiles, edges = land_tiles(spark, slant), land.load_land(land_frame(spark))
    got = {(r["tile_x"], r["tile_y"], r["row"], c) for r in land.centre_land_spans(tiles, edges, 0.3).collect()
           for c in range(r["c0"], r["c1"] + 1)}
    expected = set()
    for t in tiles.collect():
        lx, ly = (t["top_right_lon"] - t["top_left_lon"]) / 9, (t["bottom_left_lon"] - t["top_left_lon"]) / 7
        ax, ay = (t["top_right_lat"] - t["top_left_lat"]) / 9, (t["bottom_left_lat"] - t["top_left_lat"]) / 7
        for row in range(7):
            for col in range(9):
                x = t["top_left_lon"] + lx * (col + 0.5) + ly * (row + 0.5)
                y = t["top_left_lat"] + ax * (col + 0.5) + ay * (row + 0.5)
                if any(in_polygon(x, y, own) for own in edge_lists().values()):
                    expected.add((t["tile_x"], t["tile_y"], row, col))
    assert got == expected and len(got) > 100


def test_land_candidates(spark):
    tiles, edges = land_tiles(spark), land.load_land(land_frame(spark))
    got = {(r["tile_x"], r["tile_y"], r["poly_id"]) for r in land.land_candidates(tiles, edges, 0.3).collect()}
    expected = {
        (t["tile_x"], t["tile_y"], poly) for t in tiles.collect() for poly, own in edge_lists().items()
        if in_polygon(t["west"], t["north"], own) or any(meets_box(e, t["west"], t["south"], t["east"], t["north"]) for e in own)}
    assert got == expected


def point_frame(spark, points):
    rows = [("s", n, 0, 1, 1, float(x), float(y)) for n, (x, y) in enumerate(points)]
    return spark.createDataFrame(rows, f"{TILE}, at_x double, at_y double")


def edge_frame(spark, edges):
    return spark.createDataFrame([(p, *map(float, e)) for p, e in edges], "poly_id int, x1 double, y1 double, x2 double, y2 double")


@pytest.mark.parametrize("size", [0.07, 0.5, 40.0])
@pytest.mark.parametrize("step", [0.25, 0.0])
def test_points_in_polygons_equal_brute_force(spark, size, step):
    """Random rings; with a step, corners and points lie on one lattice, on edges and on the lines of cells."""
    rng = np.random.default_rng(4)
    snap = lambda v: np.round(v / step) * step if step else v
    rings = {p: snap(rng.uniform(-3, 3, (1, 2)) + rng.uniform(-2, 2, (rng.integers(3, 30), 2))) for p in range(12)}
    edges = [(p, (*a, *b)) for p, ring in rings.items() for a, b in zip(ring, np.roll(ring, -1, 0)) if tuple(a) != tuple(b)]
    points = snap(rng.uniform(-5, 5, (150, 2)))
    got = {(r["tile_x"], r["poly_id"]) for r in land._enclosing(point_frame(spark, points), edge_frame(spark, edges), size).collect()}
    expected = {(n, p) for n, (x, y) in enumerate(points) for p in rings if in_polygon(x, y, [e for q, e in edges if q == p])}
    assert got == expected and len(got) > 50


def test_edges_are_spread_over_the_cells_they_pass(spark):
    cells = land.edge_cells(edge_frame(spark, [(1, (0.0, 0.0, 20.0, 20.0)), (2, (3.0, 1.01, 3.0, 4.0)), (3, (-7.01, 2.0, -2.0, 2.0))]), 0.05)
    counts = {r["poly_id"]: r["count"] for r in cells.groupBy("poly_id").count().collect()}
    assert 400 <= counts[1] <= 1300 and counts[2] <= 130 and 100 <= counts[3] <= 102


def test_a_coast_in_one_band_meets_few_tiles(spark):
    """A million edges and all tiles in one band of latitude: what is joined follows the tiles."""
    n, size = 1_000_000, land.LAND_BIN
    x = lambda k: k / n * 300 - 150
    y = lambda k: F.when(k % 2 == 0, 10.02).otherwise(10.03)
    k = F.col("id")
    coast = spark.range(n).select(F.lit(1).alias("poly_id"), x(k).alias("x1"), y(k).alias("y1"), x(k + 1).alias("x2"), y(k + 1).alias("y2"))
    rest = edge_frame(spark, [(1, (150.0, 10.02, 150.0, -40.0)), (1, (150.0, -40.0, -150.0, -40.0)), (1, (-150.0, -40.0, -150.0, 10.02))])
    edges = coast.unionByName(rest)
    for tiles in (50, 200):
        points = [(-149.9 + 298 * m / tiles, 10.01) for m in range(tiles)]
        placed = land._in_cells(point_frame(spark, points), size)
        assert land._inside_cells(placed, edges, size).count() <= tiles
        assert land._local_edges(placed, edges, size).count() <= tiles * 400  # a cell of the coast has 167 edges
        assert land._enclosing(point_frame(spark, points), edges, size).count() == tiles


def test_wholly_inside_tiles_need_no_row_events(spark):
    big = edge_frame(spark, [(1, e) for e in ((-9, -9, 9, -9), (9, -9, 9, 9), (9, 9, -9, 9), (-9, 9, -9, -9))])
    rows = land.rasterize_land(land_tiles(spark), big, 0.3).collect()
    assert sorted((r["tile_x"], r["tile_y"], r["row"], r["c0"], r["c1"]) for r in rows) == [
        (9 * c, 7 * t, row, 0, 8) for c in range(5) for t in range(5) for row in range(7)]


def test_no_land_clips_nothing(spark):
    frame = masked_frame(spark, {("s", 0, 0): np.ones((3, 3), dtype=bool)})
    assert land.load_land(None, None) is None
    assert land.clip_mask_to_water(frame, None, None) is frame


def tile_rows(spark, cells, side=4, shift=None):
    """Tiles table of grid cells; `shift` moves the bottom left latitude of some tiles."""
    data = []
    for n, (col, row) in enumerate(cells):
        x, y = col * side, row * side
        corner = lambda px, py: (70 + 0.01 * px, 75 - 0.01 * py)
        c = [*corner(x, y), *corner(x + side, y), *corner(x + side, y + side), *corner(x, y + side)]
        c[7] += (shift or {}).get((col, row), 0.0)
        data.append((f"t{n}", "s", *map(float, c), x, y, side, side))
    names = ", ".join(f"{c}_{a} double" for c in ("top_left", "top_right", "bottom_right", "bottom_left") for a in ("lon", "lat"))
    return spark.createDataFrame(data, f"filename string, source_object_key string, {names}, tile_x int, tile_y int, tile_width int, tile_height int")


def test_corner_checks(spark):
    cells = [(0, 0), (1, 0), (0, 1), (5, 5)]
    good = grid.validate_corners(tile_rows(spark, cells)).first()
    assert (good["checked"], good["mismatches"], good["consistent"]) == (4, 0, True)
    moved = tile_rows(spark, cells, shift={(0, 0): 1e-9})
    bad = grid.validate_corners(moved).first()
    assert (bad["checked"], bad["mismatches"], bad["consistent"]) == (4, 1, False)
    named = grid.with_examples(grid.validate_corners(moved), moved).first()["examples"]
    assert [e.rsplit(": ", 1)[0] for e in named] == ["t0 / t2 (left)"]
    alone = grid.validate_corners(tile_rows(spark, [(0, 0)])).first()
    assert (alone["checked"], alone["consistent"]) == (0, True)


def test_footprint_with_hole_and_touching_corner(spark):
    block = [(c, r) for c in range(3) for r in range(3) if (c, r) != (1, 1)] + [(3, 3)]
    ordered = grid.scene_footprint(tile_rows(spark, block)).collect()
    by_ring = {}
    for r in sorted(ordered, key=lambda r: r["seq"]):
        by_ring.setdefault(r["ring"], []).append((r["ax"], r["ay"]))
    areas = sorted(
        sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1])) / 2 for p in by_ring.values())
    assert areas == [-16, 16, 144]
    assert all(abs(a[0] - b[0]) + abs(a[1] - b[1]) == 4 for p in by_ring.values() for a, b in zip(p, p[1:] + p[:1]))


@pytest.mark.parametrize("density", [0.35, 0.55, 0.75])
def test_scene_outlines_enclose_their_components(spark, density):
    image = scene_image(11, density=density)
    scenes = spark.createDataFrame(
        [("s", 31, 23, 4326, 0.1, 0.0, 70.0, 0.0, -0.1, 75.0)],
        "scene_key string, width int, height int, epsg int, a double, b double, c double, d double, e double, f double")
    merged = components.merge_masks(masked_frame(spark, cut(image, 7)), scenes.select("scene_key", "width", "height"), 7)
    rows = rings.located_outlines(rings.scene_outlines(merged), scenes).collect()
    label = flood(image)
    area, by_ring = {}, {}
    for r in sorted(rows, key=lambda r: r["seq"]):
        by_ring.setdefault((r["component"], r["ring"]), []).append((r["x"], r["y"]))
        assert (r["lon"], r["lat"]) == pytest.approx((70 + 0.1 * r["x"], 75 - 0.1 * r["y"]))
    for (component, _), p in by_ring.items():
        steps = list(zip(p, p[1:] + p[:1]))
        assert all((a[0] == b[0]) != (a[1] == b[1]) for a, b in steps)
        assert all((a[0] == b[0]) != (b[0] == c[0]) for (a, b), (_, c) in zip(steps, steps[1:] + steps[:1]))
        area[component] = area.get(component, 0) + sum(a[0] * b[1] - b[0] * a[1] for a, b in steps) // 2
    assert area == {n: int((label == n).sum()) for n in np.unique(label) if n >= 0}
    outer = [c for (c, _), p in by_ring.items() if sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1])) > 0]
    assert sorted(outer) == sorted(area)


def test_footprints_with_old_rows_parts_and_holes(spark):
    """A ring of tiles around a hole, a tile apart, one of them of the old layout: outlines are valid."""
    cells = [(x, y) for x in range(3) for y in range(3) if (x, y) != (1, 1)] + [(5, 0)]

    def frame(old):
        rows = []
        for n, (x, y) in enumerate(cells):
            at = lambda dx, dy: (70 + (x + dx) * 0.01 + (y + dy) * 0.001, 75 + (x + dx) * 0.0005 - (y + dy) * 0.01)  # noqa: B023, E731
            corners = dict(zip(("top_left", "top_right", "bottom_right", "bottom_left"), (at(0, 0), at(1, 0), at(1, 1), at(0, 1))))
            row = {"filename": f"t{n}", "source_object_key": "s", "tile_x": 8 * x, "tile_y": 8 * y, "tile_width": 8, "tile_height": 8}
            for name, (lon, lat) in corners.items():
                row[f"{name}_lon"], row[f"{name}_lat"] = lon, lat
            if n in old:
                row.update({k: None for k in row if k.startswith(("tile_", "top_right", "bottom_left"))})
            rows.append(row)
        names = ", ".join(f"{c}_{a} double" for c in ("top_left", "top_right", "bottom_right", "bottom_left") for a in ("lon", "lat"))
        columns = ["filename", "source_object_key", "tile_x", "tile_y", "tile_width", "tile_height", *(c.split()[0] for c in names.split(", "))]
        schema = "filename string, source_object_key string, tile_x int, tile_y int, tile_width int, tile_height int, " + names
        return spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], schema)

    for old in ((), (1, 4), range(2, 8)):
        body = json.loads(grid.footprint_features(frame(old)).first()["feature"])["geometry"]
        assert body["type"] == "MultiPolygon"
        assert sorted((len(p), [len(r) for r in p]) for p in body["coordinates"]) == [(1, [5]), (2, [5, 5])]
    alone = json.loads(grid.footprint_features(frame(range(9)).where("filename = 't8'")).first()["feature"])["geometry"]
    assert alone["type"] == "Polygon" and len(alone["coordinates"][0]) == 5


def test_rings_of_a_noisy_tile_are_fast():
    mask = np.random.default_rng(9).random((1000, 1000)) < 0.45
    runs = np.array(runs_of(mask), dtype=np.int64)
    label = components.label_runs(*runs.T)
    order = np.argsort(label, kind="stable")
    part = np.unique(label[order], return_inverse=True)[1]
    started = time.perf_counter()
    parts, lengths, flat = rings.trace_parts(part, *runs[order].T)
    assert time.perf_counter() - started < 5
    x, y = flat[::2], flat[1::2]
    twice = x[:-1] * y[1:] - x[1:] * y[:-1]
    ends = np.cumsum(lengths)
    inside = np.ones(len(twice), bool)
    inside[ends[:-1] - 1] = False  # from one ring to the next
    assert (twice * inside).sum() == 2 * mask.sum()


def test_components_of_equal_scenes_do_not_cancel(spark):
    path = [(k, n, n + 1) for k in ("one", "two") for n in range(0, 70)]
    frame = spark.createDataFrame(path, "scene_key string, u bigint, v bigint")
    got = components.connected_components(frame, "scene_key").collect()
    assert {(r["scene_key"], r["u"], r["root"]) for r in got} == {(k, n, 0) for k in ("one", "two") for n in range(1, 71)}
