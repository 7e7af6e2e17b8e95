"""Outlines: of mask components inside a tile, and of arbitrary directed edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from rastertables.functions.crs import is_supported, pixel_to_wgs84
from rastertables.operators.blocks import computed_once
from rastertables.operators.closing import joined_runs
from rastertables.operators.land import tile_affine
from rastertables.shipping import ship_package
from rastertables.storage import broadcast_if_small, materialize

# Directions in scan order of a right turn, y growing downwards.
EAST, SOUTH, WEST, NORTH = range(4)
STEP_X = np.array([1, 0, -1, 0])
STEP_Y = np.array([0, 1, 0, -1])


def boundary_edges(
    part: np.ndarray, row: np.ndarray, c0: np.ndarray, c1: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit edges (part, x, y, direction) around the cells of runs, with the cells on the right."""
    length = c1 - c0 + 1
    y, of = np.repeat(row, length), np.repeat(part, length)
    x = np.repeat(c0, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    stride, rows = int(c1.max()) + 2, int(row.max()) + 3
    cell = (of * rows + y + 1) * stride + x
    held = np.sort(cell)

    def free(other: np.ndarray) -> np.ndarray:
        return held[np.minimum(np.searchsorted(held, other), len(held) - 1)] != other

    top, bottom = free(cell - stride), free(cell + stride)
    parts = [
        (of[top], x[top], y[top], EAST), (part, c1 + 1, row, SOUTH),
        (of[bottom], x[bottom] + 1, y[bottom] + 1, WEST), (part, c0, row + 1, NORTH),
    ]
    ps, xs, ys = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 2))
    return ps, xs, ys, np.repeat(np.arange(4), [len(p[0]) for p in parts])


def trace_parts(part: np.ndarray, row: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Closed rings of many components at once: their parts, their lengths, and their flat points.

    A ring is x0, y0, x1, y1, ...; corners only, first point repeated. At a point where two cells touch by
    their corners it turns right, which keeps the cells apart. The outer ring runs clockwise on the
    screen, holes run the other way. Successors come from a sorted search, ring names and
    places from pointer doubling, so no edge is visited alone.
    """
    ps, xs, ys, ds = boundary_edges(part, row, c0, c1)
    width, height = int(xs.max()) + 1, int(ys.max()) + 1

    def key(p: np.ndarray, x: np.ndarray, y: np.ndarray, d: np.ndarray) -> np.ndarray:
        return ((p * height + y) * width + x) * 4 + d

    order = np.argsort(key(ps, xs, ys, ds), kind="stable")
    ps, xs, ys, ds = ps[order], xs[order], ys[order], ds[order]
    known, n = key(ps, xs, ys, ds), len(ps)
    ahead = np.full(n, -1)
    for turn in (3, 0, 1):  # the last one found wins: right before straight before left
        wanted = key(ps, xs + STEP_X[ds], ys + STEP_Y[ds], (ds + turn) % 4)
        at = np.minimum(np.searchsorted(known, wanted), n - 1)
        ahead = np.where(known[at] == wanted, at, ahead)
    low, hops, jump, span = np.arange(n), np.zeros(n, np.int64), ahead, 1
    while True:  # low: smallest edge among the span from here on; hops: the way to it
        other = low[jump]
        nearer = other < low
        if not nearer.any():
            break
        low, hops = np.where(nearer, other, low), np.where(nearer, hops[jump] + span, hops)
        jump, span = jump[jump], span * 2
    size = np.bincount(low, minlength=n)[low]
    place = (size - hops) % size
    came = np.empty(n, np.int64)
    came[ahead] = ds
    kept = np.lexsort((place, low))
    kept = kept[ds[kept] != came[kept]]
    name, first, count = np.unique(low[kept], return_index=True, return_counts=True)
    closed = np.insert(kept, first + count, kept[first])
    return ps[name], count + 1, np.column_stack([xs[closed], ys[closed]]).ravel()


def trace_rings(row: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> list[list[int]]:
    """Rings of one component."""
    _, lengths, flat = trace_parts(np.zeros(len(row), np.int64), row, c0, c1)
    return [ring.tolist() for ring in np.split(flat, 2 * np.cumsum(lengths)[:-1])]


def _outlines(rows: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    """Rings of every component of a batch, traced in slices of whole components."""
    sizes = rows.value_lengths().to_numpy()
    row, c0, c1 = (v.flatten().to_numpy().astype(np.int64) for v in (rows, starts, ends))
    ends_at = np.concatenate([[0], np.cumsum(sizes)])
    rings, lengths, flats = np.zeros(len(sizes), np.int64), [], []
    low = 0
    while low < len(sizes):
        high = max(low + 1, int(np.searchsorted(ends_at, ends_at[low] + 500_000, "right")) - 1)
        one = slice(ends_at[low], ends_at[high])
        if one.stop > one.start:
            part, length, flat = trace_parts(np.repeat(np.arange(high - low), sizes[low:high]), row[one], c0[one], c1[one])
            rings[low:high] = np.bincount(part, minlength=high - low)
            lengths.append(2 * length)
            flats.append(flat)
        low = high
    offsets = lambda counts: pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    none = [np.zeros(0, np.int64)]
    points = pa.ListArray.from_arrays(offsets(np.concatenate(lengths or none)), pa.array(np.concatenate(flats or none).astype(np.int32)))
    return pa.ListArray.from_arrays(offsets(rings), points)


_outlines.__annotations__ = {"rows": pa.Array, "starts": pa.Array, "ends": pa.Array, "return": pa.Array}


def component_rings(polygons: DataFrame) -> DataFrame:
    """Polygons (with runs) plus `outlines` array<array<int>> in cell corners of the tile."""
    ship_package(polygons.sparkSession)
    outlines = F.arrow_udf(_outlines, "array<array<int>>").asNondeterministic()("runs.row", "runs.c0", "runs.c1")
    return polygons.withColumn("outlines", outlines)


def _points(ring: Column) -> Column:
    """Flat x, y, x, y, ... as structs."""
    return F.transform(
        F.sequence(F.lit(0), F.floor(F.size(ring) / 2).cast("int") - 1),
        lambda k: F.struct(F.get(ring, k * 2).alias("x"), F.get(ring, k * 2 + 1).alias("y")))


def shoelace(points: Column) -> Column:
    """Twice the signed area of a closed ring of (x, y) structs; positive when clockwise on screen."""
    return F.aggregate(
        F.sequence(F.lit(0), F.size(points) - 2), F.lit(0).cast("bigint"),
        lambda total, k: total + F.get(points, k)["x"] * F.get(points, k + 1)["y"]
        - F.get(points, k + 1)["x"] * F.get(points, k)["y"])


def ring_points(outlined: DataFrame) -> DataFrame:
    """One row per ring: its points in cell corners and twice its signed area."""
    kept = [c for c in outlined.columns if c not in ("outlines", "runs")]
    ringed = outlined.select(*kept, F.posexplode("outlines").alias("ring", "flat"))
    return ringed.withColumn("points", _points(F.col("flat"))).withColumn(
        "double_area", shoelace(F.col("points"))).drop("flat")


def located_rings(outlined: DataFrame) -> DataFrame:
    """Outlined polygons with `rings` array<array<struct<lon,lat>>> by the tile's real corners."""
    m = tile_affine()

    def located(p: Column) -> Column:
        return F.struct(
            (m["lx"] * p["x"] + m["ly"] * p["y"] + F.col("top_left_lon")).alias("lon"),
            (m["ax"] * p["x"] + m["ay"] * p["y"] + F.col("top_left_lat")).alias("lat"))

    rings = F.transform("outlines", lambda flat: F.transform(_points(flat), located))
    return outlined.withColumn("rings", rings)


def chained(edges: DataFrame, key: str) -> DataFrame:
    """Order directed edges into closed rings, with no group gathered anywhere.

    `edges`: key, id (bigint, unique in key), ax, ay, bx, by, direction (0..3, right turns
    count up). Each edge finds its successor by join; pointer doubling then spreads the
    smallest edge id of the ring and the distance to it in log2(length) rounds. Adds
    ring (that id), seq (position from that edge on) and corner (the ring turns where the
    edge starts).
    """
    edges = materialize(edges, "ring-edges")
    ahead = edges.select(key, F.col("id").alias("next"), F.col("ax").alias("bx"), F.col("ay").alias("by"),
                         F.col("direction").alias("turned"))
    turn = F.pmod(F.col("turned") - F.col("direction") + 2, F.lit(4))  # right 3, ahead 2, left 1
    followed = materialize(
        edges.join(ahead, [key, "bx", "by"]).groupBy(key, "id", "direction").agg(F.max_by("next", turn).alias("next")),
        "ring-successors")
    state = materialize(
        followed.select(key, "id", "next", F.least("id", "next").alias("low"),
                        F.when(F.col("next") < F.col("id"), 1).otherwise(0).cast("bigint").alias("hops")),
        "ring-state")
    # `low` is the smallest id among the 2 * span edges from this one on, `hops` the way to it
    span, changed = 2, True
    while changed:
        other = state.select(key, F.col("id").alias("next"), F.col("next").alias("far"),
                             F.col("low").alias("far_low"), F.col("hops").alias("far_hops"))
        # the window of `next` starts where ours ends after `reach` steps
        reach = span // 2
        doubled = state.join(other, [key, "next"])
        lower = F.col("far_low") < F.col("low")
        state = materialize(doubled.select(
            key, "id", F.col("far").alias("next"),
            F.least("low", "far_low").alias("low"),
            F.when(lower, F.col("far_hops") + reach).otherwise(F.col("hops")).alias("hops"),
            lower.alias("changed")), "ring-state", replaces=state)
        span *= 2
        changed = not state.where("changed").isEmpty()
    lengths = state.groupBy(key, "low").agg(F.count(F.lit(1)).alias("length"))
    placed = state.join(lengths, [key, "low"]).select(
        key, "id", F.col("low").alias("ring"), F.pmod(F.col("length") - F.col("hops"), F.col("length")).alias("seq"))
    came = followed.select(key, F.col("next").alias("id"), F.col("direction").alias("came"))
    joined = edges.join(placed, [key, "id"]).join(came, [key, "id"])
    return joined.withColumn("corner", F.col("direction") != F.col("came")).drop("came")


def outline_edges(runs: DataFrame) -> DataFrame:
    """Directed boundary edges of scene runs (scene_key, component, row, c0, c1; no two touch in a row).

    Every run has its two upright ends. The level parts come from a sweep along each line
    between two rows: where only one of the rows is covered. A sweep sees one line of a scene.
    """
    row, left, right = F.col("row"), F.col("c0"), F.col("c1") + 1

    def edge(ax: Column, ay: Column, bx: Column, by: Column, direction: int) -> Column:
        return F.struct(ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"), F.lit(direction).alias("direction"))

    upright = runs.select("scene_key", "component", F.inline(F.array(
        edge(right, row, right, row + 1, SOUTH), edge(left, row + 1, left, row, NORTH))))

    def event(line: Column, at: Column, below: int, above: int, component: Column) -> Column:
        return F.struct(line.alias("line"), at.alias("x"), F.lit(below).alias("below"), F.lit(above).alias("above"),
                        component.alias("component"))

    component = F.col("component")
    events = runs.select("scene_key", F.inline(F.array(
        event(row, left, 1, 0, component), event(row, right, -1, 0, component),
        event(row + 1, left, 0, 1, component), event(row + 1, right, 0, -1, component))))
    # a run opening below or above names the component that owns the part to its right
    opened = lambda side: F.max(F.when(F.col(side) == 1, F.col("component")))
    met = events.groupBy("scene_key", "line", "x").agg(
        F.sum("below").alias("below"), F.sum("above").alias("above"),
        opened("below").alias("owner_below"), opened("above").alias("owner_above"))
    along = Window.partitionBy("scene_key", "line").orderBy("x")
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    swept = met.select(
        "scene_key", "line", "x", F.lead("x").over(along).alias("stop"),
        F.sum("below").over(so_far).alias("below"), F.sum("above").over(so_far).alias("above"),
        F.last("owner_below", ignorenulls=True).over(so_far).alias("owner_below"),
        F.last("owner_above", ignorenulls=True).over(so_far).alias("owner_above"))
    top = (F.col("below") == 1) & (F.col("above") == 0)
    bottom = (F.col("below") == 0) & (F.col("above") == 1)
    level = swept.where(top | bottom).select(
        "scene_key", F.when(top, F.col("owner_below")).otherwise(F.col("owner_above")).alias("component"),
        F.when(top, F.col("x")).otherwise(F.col("stop")).alias("ax"), F.col("line").alias("ay"),
        F.when(top, F.col("stop")).otherwise(F.col("x")).alias("bx"), F.col("line").alias("by"),
        F.when(top, EAST).otherwise(WEST).alias("direction"))
    return upright.unionByName(level)


def scene_outlines(runs: DataFrame) -> DataFrame:
    """Corner rows of the outlines of scene components: component, ring, seq, x, y.

    Rings of any length are put in order by joins; outer rings and holes run in opposite
    directions.
    """
    whole = joined_runs(runs, "component")
    ident = F.col("ay").cast("bigint") * 2**31 + F.col("ax").cast("bigint") * 4 + F.col("direction")
    ordered = chained(outline_edges(whole).withColumn("id", ident), "scene_key")
    return ordered.where("corner").select(
        "scene_key", "component", "ring", "seq", F.col("ax").alias("x"), F.col("ay").alias("y"))


def located_outlines(outlines: DataFrame, scenes: DataFrame) -> DataFrame:
    """Outline corners in degrees, by the scene's own grid."""
    frame = scenes.where(is_supported(F.col("epsg"))).select("scene_key", "epsg", *"abcdef")
    placed = outlines.join(broadcast_if_small(frame), "scene_key")
    point = computed_once(placed, {"point": pixel_to_wgs84(F.col("x"), F.col("y"))})
    return point.select("scene_key", "component", "ring", "seq", "x", "y", "point.lon", "point.lat")
