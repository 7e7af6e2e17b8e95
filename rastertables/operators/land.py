"""Land polygons against tiles: candidates, rasterisation and clipping.

Edges are rows: poly_id, x1, y1, x2, y2 in degrees. A polygon may have several rings; the
even-odd rule runs over all of its edges.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from rastertables.functions.bbox import Box, bounds_intersect
from rastertables.operators.binning import degree_bin, in_bins
from rastertables.operators.blocks import SIZED_TILE, TILE
from rastertables.operators.masks import subtract_spans
from rastertables.storage import materialize

LAND_BIN = 0.05
#: Degrees by which an edge's place in a row of cells is widened against rounding.
ROUNDING = 1e-9


def land_edges(vertices: DataFrame) -> DataFrame:
    """Edges of closed rings given as vertex rows (poly_id, [ring,] seq, lon, lat).

    Polygons with a missing coordinate or a ring of fewer than four vertices are no geometry
    and are dropped. Vertices meet their successor by join, so a long ring is never gathered.
    """
    ringed = vertices if "ring" in vertices.columns else vertices.withColumn("ring", F.lit(0))
    rings = ringed.groupBy("poly_id", "ring").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("lon").isNull() | F.col("lat").isNull()).alias("missing"),
    )
    usable = rings.where((F.col("n") >= 4) & (F.col("missing") == 0)).select("poly_id", "ring")
    kept = ringed.join(usable, ["poly_id", "ring"], "left_semi")
    start = kept.select("poly_id", "ring", "seq", F.col("lon").alias("x1"), F.col("lat").alias("y1"))
    stop = kept.select("poly_id", "ring", (F.col("seq") - 1).alias("seq"), F.col("lon").alias("x2"), F.col("lat").alias("y2"))
    return start.join(stop, ["poly_id", "ring", "seq"]).select("poly_id", "x1", "y1", "x2", "y2")


def load_land(primary: DataFrame | None, fallback: DataFrame | None = None) -> DataFrame | None:
    """Edges of the first data set there is, written once; None means nothing is clipped."""
    vertices = primary if primary is not None else fallback
    return None if vertices is None else materialize(land_edges(vertices), "land-edges")


def _edge_boxes(edges: DataFrame) -> DataFrame:
    return edges.withColumns({
        "west": F.least("x1", "x2"), "south": F.least("y1", "y2"),
        "east": F.greatest("x1", "x2"), "north": F.greatest("y1", "y2"),
    })


def _touches(box: Box) -> Column:
    """Segment meets closed box, given that their boxes meet: the corners are not all on one side."""
    side = lambda x, y: (
        (F.col("x2") - F.col("x1")) * (y - F.col("y1")) - (F.col("y2") - F.col("y1")) * (x - F.col("x1")))
    sides = [side(x, y) for x in (box.west, box.east) for y in (box.south, box.north)]
    return (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)


def _edge_crossing(y: Column, x1="x1", y1="y1", x2="x2", y2="y2") -> Column:
    """Where an edge meets a horizontal line, NULL if it does not. Half-open in y."""
    a, b, c, d = (F.col(n) for n in (x1, y1, x2, y2))
    meets = (F.least(b, d) <= y) & (y < F.greatest(b, d))
    return F.when(meets, a + (y - b) * (c - a) / (d - b))


def edge_cells(edges: DataFrame, size: float) -> DataFrame:
    """One row per degree cell (bin_x, bin_y) an edge passes, not per cell of its box.

    Adds the cells e_lo..e_hi it passes in that row of cells and p_lo..p_hi in the row below, if any.
    """
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = edges.withColumn("bin_y", F.explode(F.sequence(degree_bin(low, size), degree_bin(high, size))))

    def passed(row: Column) -> tuple[Column, Column]:
        at = lambda y: F.when(F.col("y1") == F.col("y2"), F.col("x1")).otherwise(
            F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))
        level = F.col("y1") == F.col("y2")
        enter, leave = at(F.greatest(low, row * size)), at(F.least(high, (row + 1) * size))
        west, east = F.least("x1", "x2"), F.greatest("x1", "x2")
        first = F.greatest(west, F.when(level, west).otherwise(F.least(enter, leave) - ROUNDING))
        last = F.least(east, F.when(level, east).otherwise(F.greatest(enter, leave) + ROUNDING))
        return degree_bin(first, size), degree_bin(F.greatest(first, last), size)

    here, below = passed(F.col("bin_y")), passed(F.col("bin_y") - 1)
    has_below = F.col("bin_y") > degree_bin(low, size)
    placed = rows.select(
        "*", here[0].alias("e_lo"), here[1].alias("e_hi"), F.when(has_below, below[0]).alias("p_lo"), F.when(has_below, below[1]).alias("p_hi"))
    return placed.withColumn("bin_x", F.explode(F.sequence("e_lo", "e_hi")))


def _near_edges(tiles: DataFrame, edges: DataFrame, bin_degrees: float) -> DataFrame:
    """Edges that touch the box of a tile, joined by degree cell; once per pair, in the first cell both have.

    Written, because the scan reads them several times.
    """
    spread = in_bins(tiles.select(*TILE, *Box.of().columns()), bin_degrees).withColumn("last_x", degree_bin(F.col("east"), bin_degrees))
    spread = spread.withColumnsRenamed({c: f"_l_{c}" for c in ("west", "south", "east", "north")})
    near = spread.join(_edge_boxes(edge_cells(edges, bin_degrees)), ["bin_x", "bin_y"])
    # the rows of cells in which an edge passes a tile's columns follow one another
    first = (F.col("bin_x") == F.greatest("first_x", "e_lo")) & (
        (F.col("bin_y") == F.col("first_y")) | F.col("p_lo").isNull() | (F.col("p_hi") < F.col("first_x")) | (F.col("p_lo") > F.col("last_x")))
    close = near.where(first & bounds_intersect(Box.of("_l_"), Box.of())).where(_touches(Box.of("_l_")))
    return materialize(close.select(*TILE, "poly_id", "x1", "y1", "x2", "y2"), "near-edges")


def parity_table(edges: DataFrame, size: float) -> DataFrame:
    """(poly_id, level, bin_y, block): where a polygon has an odd number of crossings further east.

    For the line along the south of each row of cells, crossings are counted by cell; the sums from the east are odd in runs
    of cells. A run is stored as blocks of 16**level cells, so that a cell finds all runs that hold it
    under one key a level. A polygon and line have at most one count a cell.
    """
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    first, last = degree_bin(low, size), degree_bin(high, size) + 1
    lines = edges.withColumn("bin_y", F.explode(F.sequence(first, last)))
    crossed = lines.withColumn("x", _edge_crossing(F.col("bin_y") * size)).where(F.col("x").isNotNull())
    odd = crossed.groupBy("poly_id", "bin_y", degree_bin(F.col("x"), size).alias("bin_x")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") % 2 == 1)
    from_east = Window.partitionBy("poly_id", "bin_y").orderBy(F.desc("bin_x"))
    runs = odd.select(
        "poly_id", "bin_y", (F.lead("bin_x").over(from_east) + _offset(size)).alias("a"), (F.col("bin_x") - 1 + _offset(size)).alias("b"),
        F.row_number().over(from_east).alias("at")).where(F.col("at") % 2 == 1).where(F.col("a").isNotNull())
    levels = _levels(size)
    for level in range(levels):
        a, b = F.col("a"), F.col("b")
        if level == levels - 1:
            blocks = F.when(a <= b, F.sequence(a, b))
            runs = runs.withColumn(f"blocks_{level}", blocks)
            break
        up, down = F.ceil(a / 16), F.floor((b + 1) / 16) - 1
        whole = up <= down
        ends = F.concat(
            F.when(a < up * 16, F.sequence(a, up * 16 - 1)).otherwise(F.array().cast("array<bigint>")),
            F.when((down + 1) * 16 <= b, F.sequence((down + 1) * 16, b)).otherwise(F.array().cast("array<bigint>")))
        blocks = F.when(a > b, F.array().cast("array<bigint>")).when(whole, ends).otherwise(F.sequence(a, b))
        runs = runs.select(
            "poly_id", "bin_y", *(f"blocks_{k}" for k in range(level)), blocks.alias(f"blocks_{level}"),
            F.when(whole & (a <= b), up).otherwise(F.lit(1)).alias("a"), F.when(whole & (a <= b), down).otherwise(F.lit(0)).alias("b"))
    def at_level(level: int) -> Column:
        blocks = F.coalesce(f"blocks_{level}", F.array().cast("array<bigint>"))
        return F.transform(blocks, lambda k: F.struct(F.lit(level).alias("level"), k.alias("block")))

    parts = F.concat(*(at_level(level) for level in range(levels)))
    return runs.select("poly_id", "bin_y", F.explode(parts).alias("e")).select("poly_id", "e.level", "bin_y", "e.block")


def _offset(size: float) -> int:
    """Makes cell numbers from longitude -720 on positive."""
    return math.ceil(720 / size) + 1


def _levels(size: float) -> int:
    return max(1, math.ceil(math.log(2 * _offset(size), 16)))


def _local_edges(points: DataFrame, edges: DataFrame, size: float) -> DataFrame:
    """Points with the edges that pass their cell."""
    return points.join(edge_cells(edges, size).select("bin_x", "bin_y", "poly_id", "x1", "y1", "x2", "y2"), ["bin_x", "bin_y"])


def _local_flips(points: DataFrame, edges: DataFrame, size: float) -> DataFrame:
    """(tile, poly_id, n) for edges met between the south of the point's cell and the point.

    Crossings of the line along the south of the cell, east of the point in the cell, and edges crossed going up from the
    line to the point. A point on an edge counts as east of it.
    """
    met = _local_edges(points, edges, size)
    south, x, y = F.col("bin_y") * size, F.col("at_x"), F.col("at_y")
    crossing = _edge_crossing(south)
    along = (crossing > x) & (degree_bin(crossing, size) == F.col("bin_x"))
    height = F.when((F.least("x1", "x2") <= x) & (x < F.greatest("x1", "x2")),
                    F.col("y1") + (x - F.col("x1")) * (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1")))
    rises = (F.col("y2") > F.col("y1")) == (F.col("x2") > F.col("x1"))
    level = F.col("y1") == F.col("y2")
    above = (height > south) | ((height == south) & rises & ~level)
    below = (height < y) | ((height == y) & (~rises | level))
    flips = F.coalesce(along.cast("int"), F.lit(0)) + F.coalesce((above & below).cast("int"), F.lit(0))
    return met.select(*TILE, "poly_id", flips.alias("n")).where("n > 0")


def _inside_cells(points: DataFrame, edges: DataFrame, size: float) -> DataFrame:
    """(tile, poly_id) of points whose cell has odd crossings further east, one key a level."""
    number = F.col("bin_x") + _offset(size)
    keys = F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright(number, 4 * k).alias("block")) for k in range(_levels(size))))
    asked = points.select(*TILE, "bin_y", F.explode(keys).alias("e")).select(*TILE, "bin_y", "e.level", "e.block")
    return asked.join(parity_table(edges, size), ["level", "bin_y", "block"]).select(*TILE, "poly_id")


def _in_cells(points: DataFrame, size: float) -> DataFrame:
    return points.withColumns({"bin_x": degree_bin(F.col("at_x"), size), "bin_y": degree_bin(F.col("at_y"), size)})


def _enclosing(points: DataFrame, edges: DataFrame, bin_degrees: float) -> DataFrame:
    """(tile, poly_id) where the tile's point (at_x, at_y) is inside the polygon.

    The parity of the crossings east of the point: the parity table knows it for the point's cell, and
    only edges in that cell can differ. Rows joined grow with the points and the edges of one cell.
    """
    placed = _in_cells(points, bin_degrees)
    known = _inside_cells(placed, edges, bin_degrees).withColumn("n", F.lit(1))
    counted = known.unionByName(_local_flips(placed, edges, bin_degrees)).groupBy(*TILE, "poly_id").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") % 2 == 1).select(*TILE, "poly_id")


def _box_corner(tiles: DataFrame) -> DataFrame:
    return tiles.select(*TILE, F.col("west").alias("at_x"), F.col("north").alias("at_y"))


def land_candidates(tiles: DataFrame, edges: DataFrame, bin_degrees: float = LAND_BIN) -> DataFrame:
    """(tile, poly_id) for polygons that meet a tile box; tiles carry west..north.

    Either an edge touches the box, or the whole box lies inside the polygon.
    """
    touching = _near_edges(tiles, edges, bin_degrees).select(*TILE, "poly_id")
    return touching.unionByName(_enclosing(_box_corner(tiles), edges, bin_degrees)).distinct()


def _merged(spans: DataFrame) -> DataFrame:
    """Union of spans per tile row: overlapping and adjacent ones become one."""
    keys = [*TILE, "row"]
    in_order = Window.partitionBy(*keys).orderBy("c0", "c1")
    reach = F.max("c1").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("opens", F.when(reach >= F.col("c0") - 1, 0).otherwise(1))
    numbered = opened.withColumn("island", F.sum("opens").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "island").agg(F.min("c0").alias("c0"), F.max("c1").alias("c1")).drop("island")


def _scan_lines(placed: DataFrame) -> DataFrame:
    """One row per edge and raster row it touches.

    `placed` has edges in grid coordinates (gx1..gy2). Adds the column range the edge covers
    in that row and its crossing with the row centre.
    """
    low, high = F.least("gy1", "gy2"), F.greatest("gy1", "gy2")
    first = F.greatest(F.ceil(low) - 1, F.lit(0)).cast("int")
    last = F.least(F.floor(high), F.col("tile_height") - 1).cast("int")
    lined = placed.where(first <= last).withColumn("row", F.explode(F.sequence(first, last)))
    x_at = lambda y: F.col("gx1") + (y - F.col("gy1")) * (F.col("gx2") - F.col("gx1")) / (F.col("gy2") - F.col("gy1"))
    level = F.col("gy1") == F.col("gy2")
    enter = F.when(level, F.col("gx1")).otherwise(x_at(F.greatest(low, F.col("row").cast("double"))))
    leave = F.when(level, F.col("gx2")).otherwise(x_at(F.least(high, F.col("row") + 1.0)))
    return lined.withColumns({
        "touch_lo": F.ceil(F.least(enter, leave)) - 1,
        "touch_hi": F.floor(F.greatest(enter, leave)),
        "crossing": _edge_crossing(F.col("row") + 0.5, "gx1", "gy1", "gx2", "gy2"),
    })


def _clipped(spans: DataFrame) -> DataFrame:
    lo, hi = F.greatest("c0", F.lit(0)).cast("int"), F.least("c1", F.col("tile_width") - 1).cast("int")
    return spans.withColumns({"c0": lo, "c1": hi}).where(F.col("c0") <= F.col("c1"))


def _inside_spans(tiles: DataFrame, placed: DataFrame, starts: DataFrame) -> DataFrame:
    """Spans of the cells whose centre is inside a polygon, from edges near the tile only.

    `starts` are the pairs whose grid origin is inside. Going down the left side of the tile,
    every edge met flips the state; going right along a row, the crossings do. Only rows that
    meet an edge are looked at; the rows between two of them are all inside or all outside.
    """
    pair, line = [*TILE, "poly_id"], [*TILE, "poly_id", "row"]
    no_x = F.lit(None).cast("double").alias("x")
    origin = starts.select(*pair, F.lit(-1).alias("row"), F.lit(1).alias("flip"), no_x)
    met = placed.withColumn("at", _edge_crossing(F.lit(0.0), "gy1", "gx1", "gy2", "gx2")).where(F.col("at") >= 0)
    flips = met.select(*pair, "tile_height", F.ceil(F.col("at") - 0.5).cast("int").alias("row"), F.lit(1).alias("flip"), no_x)
    flips = flips.where(F.col("row") < F.col("tile_height")).drop("tile_height")
    crossings = _scan_lines(placed).where(F.col("crossing") > 0).select(
        *line, F.lit(0).alias("flip"), F.col("crossing").alias("x"))
    events = origin.unionByName(flips).unionByName(crossings).groupBy(*line).agg(
        F.sum("flip").alias("flip"), F.array_sort(F.collect_list("x")).alias("x"))

    down = Window.partitionBy(*pair).orderBy("row")
    walked = events.withColumns({
        "starts_inside": F.sum("flip").over(down.rowsBetween(Window.unboundedPreceding, 0)) % 2 == 1,
        "next_row": F.lead("row").over(down),
    }).join(tiles.select(*SIZED_TILE), TILE)
    bounds = F.concat(
        F.when(F.col("starts_inside"), F.array(F.lit(0.0))).otherwise(F.array().cast("array<double>")), F.col("x"),
        F.array(F.col("tile_width").cast("double") + 1),
    )
    column = lambda x: F.ceil(x - 0.5)
    inside = F.transform(
        F.filter(F.sequence(F.lit(0), F.size("b") - 2), lambda k: k % 2 == 0),
        lambda k: F.struct(F.col("row"), column(F.get("b", k)).alias("c0"), (column(F.get("b", k + 1)) - 1).alias("c1")),
    )
    crossed = F.when((F.col("row") >= 0) & (F.size("b") >= 2), inside)
    until = F.coalesce("next_row", "tile_height") - 1
    between = F.when(F.col("starts_inside") & (F.col("row") < until), F.transform(
        F.sequence(F.col("row") + 1, until), lambda r: F.struct(r.alias("row"), F.lit(0).cast("long").alias("c0"), F.col("tile_width").cast("long").alias("c1"))))
    nothing = F.array().cast("array<struct<row:int,c0:bigint,c1:bigint>>")
    listed = walked.withColumn("b", bounds).withColumn("s", F.explode(F.concat(F.coalesce(crossed, nothing), F.coalesce(between, nothing))))
    return _clipped(listed.select(*SIZED_TILE, "s.row", "s.c0", "s.c1"))


def _on_box_grid(placed: DataFrame) -> DataFrame:
    """Edges in the axis-aligned grid of the tile box; row 0 is north."""
    x = lambda c: (F.col(c) - F.col("west")) / (F.col("east") - F.col("west")) * F.col("tile_width")
    y = lambda c: (F.col("north") - F.col(c)) / (F.col("north") - F.col("south")) * F.col("tile_height")
    return placed.withColumns({"gx1": x("x1"), "gy1": y("y1"), "gx2": x("x2"), "gy2": y("y2")})


def land_spans(tiles: DataFrame, edges: DataFrame, bin_degrees: float = LAND_BIN) -> DataFrame:
    """Column spans of the cells whose closed box meets land, per polygon and not merged.

    `tiles` carries SIZED_TILE and west..north. Tiles with an empty box have no land.
    """
    usable = tiles.where((F.col("east") > F.col("west")) & (F.col("north") > F.col("south")))
    usable = usable.select(*SIZED_TILE, *Box.of().columns())
    placed = _on_box_grid(_near_edges(usable, edges, bin_degrees).join(usable, TILE))
    touched = _scan_lines(placed).select(
        *SIZED_TILE, "row", F.col("touch_lo").alias("c0"), F.col("touch_hi").alias("c1"))
    starts = _enclosing(_box_corner(usable), edges, bin_degrees)
    return _clipped(touched).unionByName(_inside_spans(usable, placed, starts))


def rasterize_land(tiles: DataFrame, edges: DataFrame, bin_degrees: float = LAND_BIN) -> DataFrame:
    """Merged spans of land cells per tile row."""
    return union_land(land_spans(tiles, edges, bin_degrees))


def union_land(spans: DataFrame) -> DataFrame:
    """All land of a tile as one set of disjoint spans."""
    return _merged(spans.select(*TILE, "row", "c0", "c1"))


def clip_mask_to_water(
    masked: DataFrame, tiles: DataFrame, edges: DataFrame | None, bin_degrees: float = LAND_BIN
) -> DataFrame:
    """Masked tiles without cells that touch land."""
    if edges is None:
        return masked
    return subtract_spans(masked, rasterize_land(tiles, edges, bin_degrees))


def tile_affine(prefix: str = "") -> dict[str, Column]:
    """Cell to degrees by the real tile corners: lon = lx*col + ly*row + lon0, same for lat."""
    c = lambda n: F.col(prefix + n)
    return {
        "lx": (c("top_right_lon") - c("top_left_lon")) / c("tile_width"),
        "ly": (c("bottom_left_lon") - c("top_left_lon")) / c("tile_height"),
        "ax": (c("top_right_lat") - c("top_left_lat")) / c("tile_width"),
        "ay": (c("bottom_left_lat") - c("top_left_lat")) / c("tile_height"),
    }


def _on_corner_grid(placed: DataFrame) -> DataFrame:
    """Edges in the cell coordinates of the slanted tile; even-odd parity survives the mapping."""
    m = placed.withColumns(tile_affine())
    det = F.col("lx") * F.col("ay") - F.col("ly") * F.col("ax")
    dx = lambda c: F.col(c) - F.col("top_left_lon")
    dy = lambda c: F.col(c) - F.col("top_left_lat")
    col = lambda x, y: (F.col("ay") * dx(x) - F.col("ly") * dy(y)) / det
    row = lambda x, y: (F.col("lx") * dy(y) - F.col("ax") * dx(x)) / det
    return m.withColumns({
        "gx1": col("x1", "y1"), "gy1": row("x1", "y1"), "gx2": col("x2", "y2"), "gy2": row("x2", "y2"),
    })


def centre_land_spans(tiles: DataFrame, edges: DataFrame, bin_degrees: float = LAND_BIN) -> DataFrame:
    """Merged spans of cells whose centre, by the real corners, is on land.

    `tiles` carries the corners and west..north.
    """
    placed = _on_corner_grid(_near_edges(tiles, edges, bin_degrees).join(tiles, TILE))
    corner = tiles.select(*TILE, F.col("top_left_lon").alias("at_x"), F.col("top_left_lat").alias("at_y"))
    spans = _inside_spans(tiles, placed, _enclosing(corner, edges, bin_degrees))
    return _merged(spans.select(*TILE, "row", "c0", "c1"))


def clip_polygons_to_water(
    masked: DataFrame, tiles: DataFrame, edges: DataFrame | None, bin_degrees: float = LAND_BIN
) -> DataFrame:
    """Masked tiles without cells whose centre is on land; polygonise the result again."""
    if edges is None:
        return masked
    return subtract_spans(masked, centre_land_spans(tiles, edges, bin_degrees))
