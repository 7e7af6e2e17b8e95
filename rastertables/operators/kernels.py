"""Per-tile numpy kernels behind Arrow UDFs.

A tile of a million cells is worth a vectorised pass: the array functions of the SQL engine
visit cell by cell. Each kernel takes whole tiles and returns small results, so the cells go
to Python once per pass and never come back.
"""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from rastertables import params as P
from rastertables.operators.blocks import SIZED_TILE
from rastertables.shipping import ship_package

Predictor = Callable[[np.ndarray], np.ndarray]
#: A loader without arguments, or with one named `device`.
Loader = Callable[..., Predictor]

SUMMARY = ("struct<valid_count:int,value_min:double,value_max:double,min_col:int,min_row:int,max_col:int,max_row:int,"
           "buckets:array<struct<bucket:int,n:bigint>>,error:string>")
CUT = ("struct<valid_count:int,grey_max:int,runs:array<struct<row:int,c0:int,c1:int>>,error:string,"
       "model_missing:boolean>")
COUNTED = "array<struct<bucket:int,value:double,n:bigint>>"
#: Leading bits of a double that name a bucket: sign, exponent and eight bits of the fraction.
BUCKET_BITS = 20
RUN = pa.struct([("row", pa.int32()), ("c0", pa.int32()), ("c1", pa.int32())])


def tile_arrays(bands: pa.Array) -> Iterator[np.ndarray | None]:
    """Cells of each tile; absent cells are NaN, an absent band is None."""
    for band in bands:
        yield band.values.to_numpy(zero_copy_only=False) if band.is_valid else None


def shaped(cells: np.ndarray | None, width: int, height: int) -> np.ndarray:
    """Cells as rows and columns; a band of another length is an error of its tile."""
    if cells is None or len(cells) != width * height:
        raise ValueError(f"band has {0 if cells is None else len(cells)} cells, tile has {width}x{height}")
    return cells.reshape(height, width)


def error_text(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"[:500]


def valid_cells(cells: np.ndarray, epsilon: float) -> np.ndarray:
    return np.isfinite(cells) & (np.abs(cells) > epsilon)


def bucket_of(values: np.ndarray) -> np.ndarray:
    """Bucket of each double; larger values never have a smaller bucket."""
    bits = (np.asarray(values, np.float64) + 0.0).view(np.int64)
    ordered = np.where(bits < 0, ~bits ^ np.int64(-(2**63)), bits)
    return (ordered >> (64 - BUCKET_BITS)).astype(np.int32)


def counted_buckets(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that occur and how often: counted over their range where that is short, sorted otherwise."""
    found = bucket_of(values)
    least, spread = int(found.min()), int(found.max()) - int(found.min())
    if spread > 4 * len(found):
        return np.unique(found, return_counts=True)
    counts = np.bincount(found - least, minlength=spread + 1)
    at = np.flatnonzero(counts)
    return (at + least).astype(np.int32), counts[at]


def grey_cells(cells: np.ndarray, valid: np.ndarray, low: float, high: float) -> np.ndarray:
    scaled = np.clip(255.0 * ((np.where(valid, cells, low) - low) / (high - low)), 0.0, 255.0)
    return np.where(valid, scaled, 0.0).astype(np.uint8)


def mask_runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of the maximal runs, in scan order."""
    framed = np.zeros((mask.shape[0], mask.shape[1] + 2), dtype=np.int8)
    framed[:, 1:-1] = mask
    step = np.diff(framed, axis=1)
    row, c0 = np.nonzero(step == 1)
    _, after = np.nonzero(step == -1)
    return row, c0, after - 1


def nearest(scores: np.ndarray, height: int, width: int) -> np.ndarray:
    """Nearest-neighbour resize by index."""
    rows = np.arange(height) * scores.shape[0] // height
    cols = np.arange(width) * scores.shape[1] // width
    return scores[rows[:, None], cols[None, :]]


def choose_device(requested: str = "auto", cuda_available: bool = False) -> str:
    """A CUDA request without CUDA falls back to the processor."""
    wanted = requested.lower()
    if wanted == "cpu" or not cuda_available:
        return "cpu"
    return wanted if wanted.startswith("cuda") else "cuda"


def task_devices() -> list[str]:
    """Addresses of the GPUs that Spark has given this task, see spark.task.resource.gpu.amount."""
    context = TaskContext.get()
    held = context.resources().get("gpu") if context is not None else None
    return list(held.addresses) if held is not None else []


def task_device(requested: str = "auto") -> str:
    """Device of this task: its own first GPU unless one is named or none is wanted or held."""
    own = task_devices()
    chosen = choose_device(requested, bool(own))
    return f"cuda:{own[0]}" if chosen == "cuda" else chosen


def threshold_model(threshold: int) -> Callable[[], Predictor]:
    """Model that sets the cells brighter than a grey level."""
    return lambda: lambda image: image.astype(np.float32) - (threshold + 0.5)


_loaded: dict[tuple[str, str], Predictor] = {}


def loader_digest(load: Loader) -> str:
    """Identity of a loader: its code and everything it holds, under whatever name it goes."""
    return hashlib.sha256(cloudpickle.dumps(load)).hexdigest()


def load_once(digest: str, load: Loader, device: str = "cpu") -> Predictor | None:
    """Load a model once per Python worker and device; None if it cannot be loaded, which is tried again.

    A loader with an argument named `device` gets it; if it fails there, the processor is tried.
    """
    if "device" not in inspect.signature(load).parameters:
        tries, device = [{}], ""
    else:
        tries = [{"device": d} for d in dict.fromkeys((device, "cpu"))]
    key = digest, device
    for arguments in tries if key not in _loaded else ():
        try:
            _loaded[key] = load(**arguments)
            break
        except Exception:  # any failure of user code means: no model there
            continue
    return _loaded.get(key)


def predicted(model: Predictor | None, grey: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Cells whose logit has a sigmoid above one half, within the valid cells."""
    if model is None:
        return np.zeros(grey.shape, dtype=bool)
    return (nearest(np.asarray(model(grey)), *grey.shape) > 0) & valid


def _nested(lists: list[np.ndarray], values: pa.Array) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in lists])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def summarise(params: P.SceneParams) -> Callable[[pa.Array, pa.Array, pa.Array], pa.Array]:
    """Statistics of a tile: counts, range, extent of the valid cells and their buckets."""
    kinds = [pa.int32(), pa.float64(), pa.float64()] + [pa.int32()] * 4

    def one(cells: np.ndarray, w: int, h: int) -> tuple:
        grid = shaped(cells, w, h)
        valid = valid_cells(grid, params.background_epsilon)
        if not valid.any():
            return (0,) + (None,) * 6, np.zeros(0, np.int32), np.zeros(0, np.int64)
        values, cols, rows = grid[valid], np.flatnonzero(valid.any(0)), np.flatnonzero(valid.any(1))
        buckets, counts = counted_buckets(values)
        extent = (cols[0], rows[0], cols[-1], rows[-1])
        return (len(values), float(values.min()), float(values.max()), *map(int, extent)), buckets, counts

    def kernel(bands: pa.Array, widths: pa.Array, heights: pa.Array) -> pa.Array:
        stats, buckets, counts, errors = [], [], [], []
        for cells, w, h in zip(tile_arrays(bands), widths.to_pylist(), heights.to_pylist()):
            try:
                found, error = one(cells, w, h), None
            except Exception as failure:  # a bad tile is reported, the others go on
                found, error = ((0,) + (None,) * 6, np.zeros(0, np.int32), np.zeros(0, np.int64)), error_text(failure)
            for kept, part in zip((stats, buckets, counts, errors), (*found, error)):
                kept.append(part)
        flat = pa.StructArray.from_arrays(
            [pa.array(np.concatenate(buckets), pa.int32()), pa.array(np.concatenate(counts), pa.int64())], names=["bucket", "n"])
        columns = [pa.array(c, k) for c, k in zip(zip(*stats), kinds)]
        return pa.StructArray.from_arrays(
            [*columns, _nested(buckets, flat), pa.array(errors, pa.string())],
            names=["valid_count", "value_min", "value_max", "min_col", "min_row", "max_col", "max_row", "buckets", "error"])

    return kernel


def count_values(params: P.SceneParams) -> Callable[[pa.Array, pa.Array], pa.Array]:
    """Distinct valid values of a tile that lie in the wanted buckets, with their numbers."""
    def kernel(bands: pa.Array, wanted: pa.Array) -> pa.Array:
        values, counts = [], []
        for cells, buckets in zip(tile_arrays(bands), wanted.to_pylist()):
            chosen = cells[valid_cells(cells, params.background_epsilon)]
            value, n = np.unique(chosen[np.isin(bucket_of(chosen), buckets)], return_counts=True)
            values.append(value)
            counts.append(n)
        value = np.concatenate(values)
        flat = pa.StructArray.from_arrays(
            [pa.array(bucket_of(value), pa.int32()), pa.array(value, pa.float64()), pa.array(np.concatenate(counts), pa.int64())],
            names=["bucket", "value", "n"])
        return _nested(values, flat)

    return kernel


def cut_and_segment(params: P.SceneParams, load: Loader):
    """Mask runs of a tile. A tile whose cells or predictor fail has `error` and no runs."""
    digest = loader_digest(load)

    def one(cells: np.ndarray, w: int, h: int, low: float, high: float, model: Predictor | None) -> tuple:
        grid = shaped(cells, w, h)
        valid = valid_cells(grid, params.background_epsilon)
        count, top, runs = int(valid.sum()), 0, (np.zeros(0, dtype=np.int64),) * 3
        if count and count / (w * h) >= params.min_valid_ratio and np.ptp(grid[valid]) != 0:
            grey = grey_cells(grid, valid, low, high)
            top = int(grey.max())
            if top:
                runs = mask_runs(predicted(model, grey, valid))
        return count, top, *runs

    def kernel(bands: pa.Array, widths: pa.Array, heights: pa.Array, lows: pa.Array, highs: pa.Array) -> pa.Array:
        model = load_once(digest, load, task_device(params.device))
        counts, tops, rows, starts, ends, errors = [], [], [], [], [], []
        for cells, *shape in zip(
            tile_arrays(bands), widths.to_pylist(), heights.to_pylist(), lows.to_pylist(), highs.to_pylist()
        ):
            try:
                found, error = one(cells, *shape, model), None
            except Exception as failure:  # the predictor is user code: its failure is the tile's
                found, error = (0, 0, *(np.zeros(0, dtype=np.int64),) * 3), error_text(failure)
            for kept, part in zip((counts, tops, rows, starts, ends, errors), (*found, error)):
                kept.append(part)
        flat = [pa.array(np.concatenate(part).astype(np.int32)) for part in (rows, starts, ends)]
        return pa.StructArray.from_arrays(
            [pa.array(counts, pa.int32()), pa.array(tops, pa.int32()),
             _nested(rows, pa.StructArray.from_arrays(flat, fields=list(RUN))),
             pa.array(errors, pa.string()), pa.array([model is None] * len(counts), pa.bool_())],
            names=["valid_count", "grey_max", "runs", "error", "model_missing"])

    return kernel


def arrow_column(kernel: Callable, kind: str, *columns: str) -> Column:
    # not deterministic for the optimiser: a filter on the result must not run the kernel again
    return F.arrow_udf(kernel, kind).asNondeterministic()(*columns)


def tile_summaries(tiles: DataFrame, params: P.SceneParams) -> DataFrame:
    """Tiles without cells: statistics, extent and value buckets. First pass, small rows.

    `error` tells what is wrong with a tile that could not be read.
    """
    ship_package(tiles.sparkSession)
    kernel = annotated(summarise(params), "bands", "widths", "heights")
    summed = tiles.select(*SIZED_TILE, arrow_column(kernel, SUMMARY, "band", "tile_width", "tile_height").alias("s"))
    total = F.col("tile_width") * F.col("tile_height")
    return summed.select(*SIZED_TILE, total.alias("total_count"), "s.*")


def good_summaries(summaries: DataFrame, params: P.SceneParams) -> DataFrame:
    """Summaries that pass the quality gate."""
    return summaries.where(
        (F.col("valid_count") > 0) & (F.col("valid_count") / F.col("total_count") >= F.lit(params.min_valid_ratio))
        & (F.col("value_max") - F.col("value_min") != 0))


def wanted_values(tiles: DataFrame, params: P.SceneParams) -> DataFrame:
    """(scene_key, bucket, value, n) of the valid cells in the buckets named by the column `wanted`."""
    ship_package(tiles.sparkSession)
    kernel = annotated(count_values(params), "bands", "wanted")
    counted = tiles.select("scene_key", arrow_column(kernel, COUNTED, "band", "wanted").alias("v"))
    return counted.select("scene_key", F.inline("v"))


def masked_tiles(tiles: DataFrame, params: P.SceneParams, load: Loader) -> DataFrame:
    """Surviving tiles as mask runs, and tiles with an `error`. Tiles carry the scene's low and high.

    `load` returns a function from a (height, width) byte image to logits of any size. With an argument named `device` it
    is told where to run: `params.device`, or the GPU Spark has given the task, or the processor. If it fails,
    masks are empty and `model_missing` is true.
    """
    ship_package(tiles.sparkSession)
    kernel = annotated(cut_and_segment(params, load), "bands", "widths", "heights", "lows", "highs")
    cut = tiles.select(*SIZED_TILE, arrow_column(kernel, CUT, "band", "tile_width", "tile_height", "low", "high").alias("c"))
    total = F.col("tile_width") * F.col("tile_height")
    return cut.select(*SIZED_TILE, total.alias("total_count"), "c.*").where((F.col("grey_max") > 0) | F.col("error").isNotNull())


def annotated(kernel: Callable, *names: str) -> Callable:
    """A kernel with real type hints, which Spark reads to tell the kind of UDF."""
    kernel.__annotations__ = {n: pa.Array for n in (*names, "return")}
    return kernel
