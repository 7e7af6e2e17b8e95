"""Vector columns of Arrow batches as numpy matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def id_and_vector(table: DataFrame) -> DataFrame:
    """(vec_id long, embedding array<double>) of all rows, without other columns."""
    return table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def whole_vectors(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each length of the vectors that are not null and hold finite numbers only."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    there = column.is_valid().to_numpy(zero_copy_only=False)
    lengths = np.where(there, np.nan_to_num(lengths.astype(float)), 0).astype(np.int64)
    flat = column.flatten()  # without what null rows may hide
    values = flat.to_numpy(zero_copy_only=False).astype(float)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    ends = np.cumsum(lengths)
    usable = there & (bad[ends] == bad[ends - lengths])
    for length in np.unique(lengths[usable]):
        rows = np.flatnonzero(usable & (lengths == length))
        yield rows, values[(ends - lengths)[rows][:, None] + np.arange(length)]


def stack(vectors: list[bytes], kind: str = "<f8") -> np.ndarray:
    """Rows of equal length from their bytes."""
    return np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1) if vectors and vectors[0] else np.zeros((len(vectors), 0))


def rows_as_bytes(matrix: np.ndarray) -> pa.Array:
    matrix = np.ascontiguousarray(matrix)
    size = matrix.shape[1] * matrix.itemsize
    ends = np.arange(len(matrix) + 1, dtype=np.int64) * size
    return pa.Array.from_buffers(pa.large_binary(), len(matrix), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(matrix.tobytes())]).cast(pa.binary())


def packed(matrix: np.ndarray) -> pa.Array:
    """Rows as bytes, 4 a component where that loses nothing and 8 otherwise; equal rows have equal bytes."""
    with np.errstate(over="ignore"):
        narrow = matrix.astype("<f4")
    exact = (narrow == matrix).all(1)
    order = np.argsort(np.concatenate([np.flatnonzero(exact), np.flatnonzero(~exact)]), kind="stable")
    return pa.concat_arrays([rows_as_bytes(narrow[exact]), rows_as_bytes(matrix[~exact])]).take(pa.array(order))


def unpacked(vectors: list[bytes], dim: int) -> np.ndarray:
    out = np.empty((len(vectors), dim))
    wide = np.array([len(v) == 8 * dim for v in vectors], bool)
    for chosen, kind in ((~wide, "<f4"), (wide, "<f8")):
        if chosen.any():
            out[chosen] = stack([v for v, c in zip(vectors, chosen) if c], kind)
    return out


def directions(vectors: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors of packed rows, none of which is zero."""
    x = unpacked(vectors, dim)
    x /= np.abs(x).max(1, keepdims=True)  # squares of huge or tiny components stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)
