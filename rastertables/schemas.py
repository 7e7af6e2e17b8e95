"""Schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_S, _I, _D, _TS = T.StringType(), T.IntegerType(), T.DoubleType(), T.TimestampType()

TILES = _struct(
    ("filename", _S), ("source_object_key", _S),
    ("top_left_lon", _D), ("top_left_lat", _D),
    ("top_right_lon", _D), ("top_right_lat", _D),
    ("bottom_right_lon", _D), ("bottom_right_lat", _D),
    ("bottom_left_lon", _D), ("bottom_left_lat", _D),
    ("tile_x", _I), ("tile_y", _I), ("tile_width", _I), ("tile_height", _I),
    ("mask_name", _S), ("created_at", _TS),
)

TASKS = _struct(
    ("object_key", _S), ("status", _S), ("processor_name", _S), ("stage", _S),
    ("worker_name", _S), ("progress_current", _I), ("progress_total", _I),
    ("result_path", _S), ("details", _S), ("created_at", _TS), ("updated_at", _TS),
)

LOGS = _struct(
    ("object_key", _S), ("worker_name", _S), ("stage", _S), ("level", _S),
    ("message", _S), ("progress_current", _I), ("progress_total", _I), ("created_at", _TS),
)

NOTIFICATION = _struct(("bucket", _S), ("object_key", _S), ("filename", _S))

MARKER = T.StructType([
    T.StructField("object_key", _S), T.StructField("status", _S),
    T.StructField("shapefile_keys", T.ArrayType(_S)), T.StructField("processed_at", _S),
])
