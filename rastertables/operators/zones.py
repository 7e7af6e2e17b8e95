"""Zone maps of storage chunks: what is known of the cells without reading them.

Chunks are stored once with the count, range and extent of their valid cells beside the cells, as columns of their own, and
apart by whether they have any. A scan that asks for the zone columns reads no cells; a run over the filled chunks
opens no file of empty ones, which are most of a tilted scene's rectangle.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rastertables import params as P
from rastertables.operators import raster
from rastertables.operators.kernels import annotated, arrow_column, error_text, shaped, tile_arrays, valid_cells
from rastertables.shipping import ship_package

CHUNK = ["scene_key", "chunk_x", "chunk_y", "chunk_width", "chunk_height"]
ZONE = "struct<valid_count:int,value_min:double,value_max:double,min_col:int,min_row:int,max_col:int,max_row:int,error:string>"
ZONE_COLUMNS = ["valid_count", "value_min", "value_max", "min_col", "min_row", "max_col", "max_row", "error"]
STORED = ("scene_key string, chunk_x int, chunk_y int, chunk_width int, chunk_height int, band array<double>, valid_count int, value_min double, "
          "value_max double, min_col int, min_row int, max_col int, max_row int, error string, filled boolean")


def zone_kernel(epsilon: float) -> Callable[[pa.Array, pa.Array, pa.Array], pa.Array]:
    """Count, range and extent of the valid cells; a band that cannot be read has an error."""
    def one(cells: np.ndarray | None, w: int, h: int) -> dict:
        grid = shaped(cells, w, h)
        valid = valid_cells(grid, epsilon)
        cols, rows = np.flatnonzero(valid.any(0)), np.flatnonzero(valid.any(1))
        if not len(rows):
            return {"valid_count": 0}
        return {
            "valid_count": int(valid.sum()), "value_min": float(np.min(grid, where=valid, initial=np.inf)),
            "value_max": float(np.max(grid, where=valid, initial=-np.inf)),
            "min_col": int(cols[0]), "min_row": int(rows[0]), "max_col": int(cols[-1]), "max_row": int(rows[-1]),
        }

    def kernel(bands: pa.Array, widths: pa.Array, heights: pa.Array) -> pa.Array:
        found = []
        for cells, w, h in zip(tile_arrays(bands), widths.to_pylist(), heights.to_pylist()):
            try:
                found.append(one(cells, w, h))
            except Exception as failure:  # a bad chunk is kept for its scene's report
                found.append({"valid_count": 0, "error": error_text(failure)})
        kinds = [pa.int32(), pa.float64(), pa.float64(), *[pa.int32()] * 4, pa.string()]
        return pa.array(found, pa.struct(list(zip(ZONE_COLUMNS, kinds))))

    return kernel


def store_chunks(chunks: DataFrame, path: str, epsilon: float = P.BACKGROUND_EPSILON) -> None:
    """Write chunks with their zones, filled and empty ones apart. Chunks that cannot be read count as filled."""
    ship_package(chunks.sparkSession)
    kernel = annotated(zone_kernel(epsilon), "bands", "widths", "heights")
    zoned = chunks.select(*CHUNK, "band", arrow_column(kernel, ZONE, "band", "chunk_width", "chunk_height").alias("z")).select(*CHUNK, "band", "z.*")
    filled = (F.col("valid_count") > 0) | F.col("error").isNotNull()
    zoned.withColumn("filled", filled).write.partitionBy("filled").parquet(path)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(T._parse_datatype_string(STORED)).parquet(path)


def all_chunks(spark: SparkSession, path: str) -> DataFrame:
    return _stored(spark, path).select(*CHUNK, "band")


def filled_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks a run has to read. Where others lie, tiles have no valid cell."""
    return _stored(spark, path).where("filled").select(*CHUNK, "band")


def chunk_zones(spark: SparkSession, path: str) -> DataFrame:
    """Zones of the filled chunks; no cell is read."""
    return _stored(spark, path).where("filled").select(*CHUNK, *ZONE_COLUMNS)


def zone_window(zones: DataFrame, scenes: DataFrame, params: P.SceneParams) -> DataFrame:
    """The data window of each scene, from the zones of its chunks."""
    return raster.data_window(zones.withColumnsRenamed({"chunk_x": "tile_x", "chunk_y": "tile_y"}), scenes, params)
