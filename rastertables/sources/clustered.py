"""Tiles stored along a space-filling curve, with the box of every file, so that a view reads the files it meets.

Rows are dealt to files by ranges of the Z-order key of their middle, so a file covers a compact area and its
row groups again parts of it. A manifest names the files of each layer with their boxes; it is written
last, so that a layer is there as a whole or not at all. Writing a layer again replaces it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rastertables.functions import bbox
from rastertables.functions.bbox import Box, bounds_intersect
from rastertables.storage import path_exists, remove, replace_groups

#: Rows of a file, and files that a view names singly; a view that meets more reads all of them through its filter.
FILE_ROWS, NAMED_FILES = 1_000_000, 10_000
_BITS = 20
#: Masks that spread the bits of a number to every other place.
_SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))
_BOX = ("box_west", "box_south", "box_east", "box_north")


def curve_key(lon: Column, lat: Column) -> Column:
    """Z-order key of a point: the bits of its column and row on a grid of 2^20 each, by turns. NULL stays NULL."""
    def cell(value: Column, low: float, span: float) -> Column:
        at = F.floor((value - low) / span * float(1 << _BITS))
        held = F.when(value.isNotNull(), F.greatest(F.lit(0), F.least(at, F.lit((1 << _BITS) - 1)))).cast("long")
        for shift, mask in _SPREAD:
            held = held.bitwiseOR(F.shiftleft(held, shift)).bitwiseAND(F.lit(mask))
        return held

    return cell(lon, -180.0, 360.0).bitwiseOR(F.shiftleft(cell(lat, -90.0, 180.0), 1))


def store_clustered(tiles: DataFrame, path: str, layer: str, file_rows: int = FILE_ROWS) -> None:
    """Write tiles, with any further columns, as one layer of the store at `path`.

    Rows without a box are stored too; no view meets them. Places where very many tiles lie are dealt over several files.
    """
    spark = tiles.sparkSession
    box = bbox.tile_bbox()
    keyed = tiles.withColumns(dict(zip(_BOX, (box.west, box.south, box.east, box.north))))
    keyed = keyed.withColumn("curve", curve_key((F.col("box_west") + F.col("box_east")) / 2, (F.col("box_south") + F.col("box_north")) / 2))
    n = tiles.count()
    files = max(1, -(-n // file_rows))
    folder = f"{layer}-{uuid.uuid4().hex}"
    order = ("curve", F.xxhash64("source_object_key", "filename"))
    keyed.repartitionByRange(files, *order).sortWithinPartitions("curve").write.parquet(f"{path}/rows/{folder}")
    former = [r["folder"] for r in _manifest(spark, path).where(F.col("layer") == layer).select("folder").distinct().collect()] if path_exists(spark, f"{path}/manifest") else []
    stored = spark.read.schema(keyed.schema).parquet(f"{path}/rows/{folder}")
    boxes = stored.groupBy(F.col("_metadata.file_name").alias("file")).agg(
        *(f(name).alias(side) for f, name, side in zip((F.min, F.min, F.max, F.max), _BOX, ("west", "south", "east", "north"))),
        F.count(F.lit(1)).alias("tiles"))
    if not n:  # a row without a file, so that an empty layer replaces a full one
        boxes = spark.createDataFrame([("", None, None, None, None, 0)], boxes.schema)
    replace_groups(boxes.withColumns({"folder": F.lit(folder), "layer": F.lit(layer)}), "layer").parquet(f"{path}/manifest")
    for old in former:
        remove(spark, f"{path}/rows/{old}")


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    schema = "file string, west double, south double, east double, north double, tiles long, folder string, layer string"
    return spark.read.schema(schema).parquet(f"{path}/manifest")


def read_clustered(spark: SparkSession, path: str, schema, view: Iterable[float] | None = None, named_files: int = NAMED_FILES) -> DataFrame:
    """Rows of all layers, with the columns of `schema`; with a view (west, south, east, north) those whose box meets it.

    Only files whose box meets the view are opened, and in them only row groups that may hold such rows.
    """
    files = _manifest(spark, path).where("tiles > 0")
    shown = spark.createDataFrame([], schema)
    inside = F.lit(True)
    if view is not None:
        asked = Box(*(bbox.normalize_bbox(F.lit(float(v))) for v in view))
        files = files.where(bounds_intersect(Box.of(), asked))
        inside = bounds_intersect(Box.of("box_"), asked)
    stored = spark.createDataFrame([], shown.schema).withColumns({name: F.lit(0.0) for name in _BOX}).schema
    found = files.select("folder", "file").limit(named_files + 1).collect()
    if not found:
        return shown
    if len(found) > named_files:
        paths = [f"{path}/rows/{r['folder']}" for r in files.select("folder").distinct().collect()]  # one a layer
    else:
        paths = [f"{path}/rows/{r['folder']}/{r['file']}" for r in found]
    return spark.read.schema(stored).parquet(*paths).where(inside).select(shown.columns)
