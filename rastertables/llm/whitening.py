"""Whitening of embeddings by FEAST contour integration.

Components become integers, x = floor(256 c). The fit list holds each distinct x vector once; its sums and
its centred covariance V are added up over Spark tasks, so only d numbers a task and d rows of d numbers
travel. The leading eigenpairs of V come from the spectral projector onto an interval [a, c],

    P = 1 / (2 pi i) * contour integral of (z I - V)^-1 dz  ~  sum of w_j (z_j I - V)^-1,

a Gauss-Legendre rule on a circle through a and c: complex shifted systems are solved for a block of vectors,
Rayleigh-Ritz extracts the pairs from the projected block, and that is repeated until their
residuals are of rounding size. Inertia counts (the signs of the pivots of V - s I, by a tridiagonal
form) place a in a gap of the spectrum and say how many pairs must lie in the interval; if pairs are missing, the block is enlarged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from ..storage import materialize, remove
from .common import arrow_pass
from .vectors import id_and_vector, rows_as_bytes, stack, whole_vectors

COMPONENTS, SCALE = 4, 256.0
#: Quadrature nodes on the upper half circle, rounds of projection, relative residual of a pair.
NODES, ROUNDS, RESIDUAL = 8, 40, 1e-13
#: Eigenvalues closer than this share of the largest are not parted by an interval's end.
GAP = 1e-7
#: An eigenvalue below this share of the largest is rounding; nothing is whitened by it.
ZERO = 1e-12
#: Bytes of models that one pass hands to its tasks; further vector lengths take further passes.
MODEL_BYTES = 64 << 20


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of an orthogonally similar tridiagonal matrix (Householder)."""
    a = v.astype(float).copy()
    n = len(a)
    for k in range(n - 2):
        x = a[k + 1:, k].copy()
        length = np.linalg.norm(x)
        if length == 0:
            continue
        x[0] += np.copysign(length, x[0])
        x /= np.linalg.norm(x)
        below = a[k + 1:, k + 1:]
        p = below @ x
        w = p - (x @ p) * x
        below -= 2 * np.outer(x, w) + 2 * np.outer(w, x)
        a[k + 1:, k] -= 2 * x * (x @ a[k + 1:, k])
    return np.diag(a).copy(), np.diag(a, -1).copy()


def count_above(diagonal: np.ndarray, off: np.ndarray, s: float) -> int:
    """Inertia: how many eigenvalues exceed s, the positive pivots of the shifted tridiagonal form."""
    tiny = np.finfo(float).tiny ** 0.5
    positive, pivot = 0, 1.0
    for d, b in zip(diagonal.tolist(), [0.0, *off.tolist()]):
        pivot = d - s - b * b / pivot
        if pivot == 0:
            pivot = -tiny
        positive += pivot > 0
    return positive


def interval(v: np.ndarray, wanted: int) -> tuple[float, float, int]:
    """(a, c, m): an interval with the m >= wanted largest eigenvalues, whose ends lie in gaps."""
    diagonal, off = tridiagonal(v)
    n = len(v)
    sums = np.abs(v).sum(1)
    top, bottom = float(sums.max()) * (1 + 1e-9), float((2 * np.diag(v) - sums).min()) - float(sums.max()) * 1e-9

    def eigenvalue(k: int) -> float:
        low, high = bottom, top
        while high - low > GAP / 8 * top:
            middle = (low + high) / 2
            low, high = (middle, high) if count_above(diagonal, off, middle) >= k else (low, middle)
        return (low + high) / 2

    m, own = wanted, eigenvalue(wanted)
    while m < n:
        following = eigenvalue(m + 1)
        if own - following > GAP * top:
            break
        m, own = m + 1, following
    a = (own + following) / 2 if m < n else bottom
    largest = eigenvalue(1)
    return a, largest + max(GAP * top, 0.1 * (largest - a)), m


def feast(v: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest eigenvalues of a symmetric matrix, falling, and unit eigenvectors as rows.

    The entry of largest size of an eigenvector is positive. A matrix of zeros has the first unit vectors.
    """
    n = len(v)
    wanted = min(wanted, n)
    size = float(np.abs(v).sum(1).max(initial=0))
    if size == 0:
        return np.zeros(wanted), np.eye(n)[:wanted]
    v = (v + v.T) / 2
    a, c, m = interval(v, wanted)
    centre, radius = (a + c) / 2, (c - a) / 2
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    angles = np.pi / 2 * (nodes + 1)
    shifts = centre + radius * np.exp(1j * angles)
    factors = weights / 2 * radius * np.exp(1j * angles)
    block = min(n, max(2 * m, m + 8))
    while True:
        y = np.random.default_rng(n).normal(size=(n, block))
        best = np.inf
        for _ in range(ROUNDS):
            projected = sum((f * np.linalg.solve(z * np.eye(n) - v, y)).real for z, f in zip(shifts, factors))
            q, _ = np.linalg.qr(projected)
            values, small = np.linalg.eigh(q.T @ v @ q)  # Rayleigh-Ritz
            y = q @ small
            inside = np.flatnonzero((values > a) & (values < c))
            residual = np.linalg.norm(v @ y[:, inside] - y[:, inside] * values[inside], axis=0).max(initial=0) / size
            if len(inside) == m and (residual <= RESIDUAL or residual >= best / 2 and residual <= 1e3 * RESIDUAL):
                order = inside[::-1][:wanted]
                vectors = y[:, order].T
                signs = np.sign(vectors[np.arange(wanted), np.abs(vectors).argmax(1)])
                return values[order], vectors * signs[:, None]
            best = min(best, residual) if len(inside) == m else np.inf
        if block == n:
            raise ArithmeticError(f"{len(inside)} of {m} eigenpairs found, residual {residual:.1e}")
        block = min(n, 2 * block)


def integers(column: pa.ListArray, scale: float = SCALE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, x) for each length; a component beyond 64 bits counts as not finite."""
    for rows, c in whole_vectors(column):
        x = np.floor(c * scale)
        fits = (np.abs(x) < 2.0**63).all(1)
        if x.shape[1] and fits.any():
            yield rows[fits], x[fits].astype(np.int64)


def fit_list(vectors: DataFrame) -> DataFrame:
    """Stored (dim, width, x): each distinct x vector once, in the least of 2 or 8 bytes a component."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in integers(batch["embedding"]):
                small = (np.abs(x) < 1 << 15).all(1) & (x > -(1 << 15)).all(1)
                for width, chosen in ((2, x[small]), (8, x[~small])):
                    if len(chosen):
                        chosen = np.unique(chosen, axis=0)
                        n = len(chosen)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([x.shape[1]] * n, pa.int32()), pa.array([width] * n, pa.int32()), rows_as_bytes(chosen.astype(f"<i{width}"))], ["dim", "width", "x"])

    return materialize(arrow_pass(vectors.select("embedding"), run, "dim int, width int, x binary").distinct(), "whitening-fit")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Matrices of x vectors of one length."""
    for batch in batches:
        dims, widths, x = batch["dim"].to_numpy(), batch["width"].to_numpy(), batch["x"]
        for dim, width in {*zip(dims.tolist(), widths.tolist())}:
            yield stack(x.filter(pa.array((dims == dim) & (widths == width))).to_pylist(), f"<i{width}").astype(np.int64)


def _passes(spark: SparkSession, df: DataFrame, models: list[Row], run: Callable[[dict, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, dim: str) -> DataFrame:
    """`run` over the rows with the models of their vector lengths, by passes with models of bounded size."""
    def one(held: list[Row]) -> DataFrame:
        known = {row["dim"]: row for row in held}
        return arrow_pass(df, lambda batches: run(known, batches), schema)

    out, held, size = None, [], 0
    for row in sorted(models, key=lambda r: r["dim"]):
        if held and size + 64 * row["dim"] > MODEL_BYTES:
            out = one(held) if out is None else out.union(one(held))
            held, size = [], 0
        held.append(row)
        size += 64 * row["dim"]
    return one(held) if out is None else out.union(one(held))


def sums(fit: DataFrame) -> DataFrame:
    """Stored (dim, n, s): size of the fit list and exact sums by dimension, for each vector length."""
    number = pa.decimal128(38, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list] = {}
        for x in _parts(batches):
            exact = x.sum(0).tolist() if float(np.abs(x.astype(float)).sum(0).max()) < 2.0**62 else x.astype(object).sum(0).tolist()
            n, total = totals.get(x.shape[1], (0, [0] * x.shape[1]))
            totals[x.shape[1]] = (n + len(x), [a + b for a, b in zip(total, exact)])
        for dim, (n, total) in totals.items():
            yield pa.RecordBatch.from_arrays([
                pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()),
                pa.array([Decimal(t) for t in total], number)], ["dim", "i", "n", "s"])

    added = arrow_pass(fit, run, "dim int, i int, n long, s decimal(38,0)").groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col("i"), F.col("s").cast("string").alias("s")))), lambda e: e["s"])  # d entries
    return materialize(added.groupBy("dim").agg(F.max("n").alias("n"), listed.alias("s")), "whitening-sums")


def _mean(model: Row) -> np.ndarray:
    return np.array([int(s) / model["n"] for s in model["s"]])


def covariances(fit: DataFrame, models: list[Row]) -> DataFrame:
    """(dim, i, row): rows of the covariance of each vector length, centred before multiplying."""
    def run(known: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for x in _parts(batches):
            dim = x.shape[1]
            if dim in known:
                away = x - _mean(known[dim])
                totals[dim] = totals.get(dim, 0.0) + away.T @ away / known[dim]["n"]
        for dim, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), rows_as_bytes(total)], ["dim", "i", "row"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(int(frame["dim"].iloc[0]))
        for row in frame["row"]:
            total += np.frombuffer(row, "<f8")
        return pd.DataFrame({"dim": frame["dim"].iloc[:1], "i": frame["i"].iloc[:1], "row": [total.tobytes()]})

    schema = "dim int, i int, row binary"
    parts = _passes(fit.sparkSession, fit, models, run, schema, "dim")
    return parts.groupBy("dim", "i").applyInPandas(add, schema)  # one row a task


def eigenpairs(covariance: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Stored (dim, trace, values, vectors): the leading eigenpairs of each covariance, a d x d matrix a task."""
    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        v = stack(frame.sort_values("i")["row"].tolist())
        values, vectors = feast(v, components)
        return pd.DataFrame({"dim": frame["dim"].iloc[:1], "trace": [float(np.trace(v))], "values": [values.tobytes()], "vectors": [vectors.tobytes()]})

    return materialize(covariance.groupBy("dim").applyInPandas(solve, "dim int, trace double, values binary, vectors binary"), "whitening-model")


def _whitener(model: Row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, whitening matrix (dimensions x components) and which components have a variance."""
    values = np.frombuffer(model["values"], "<f8")
    vectors = np.frombuffer(model["vectors"], "<f8").reshape(len(values), -1)
    real = values > ZERO * max(float(values[0]), model["trace"])
    return _mean(model), (vectors / np.sqrt(np.where(real, values, 1.0))[:, None]).T, real


def identity_error(fit: DataFrame, models: list[Row]) -> float:
    """Largest entry of |covariance of the whitened fit lists - identity| over all vector lengths."""
    def run(known: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for x in _parts(batches):
            if x.shape[1] in known:
                mean, matrix, real = _whitener(known[x.shape[1]])
                w = np.column_stack([((x - mean) @ matrix)[:, real], np.ones(len(x))])
                totals[x.shape[1]] = totals.get(x.shape[1], 0.0) + w.T @ w / known[x.shape[1]]["n"]
        for dim, total in totals.items():
            n = total.size
            yield pa.RecordBatch.from_arrays([pa.array([dim] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(total.ravel())], ["dim", "at", "part"])

    parts = _passes(fit.sparkSession, fit, models, run, "dim int, at int, part double", "dim")
    entries = parts.groupBy("dim", "at").agg(F.sum("part").alias("part"))
    worst = 0.0
    listed = entries.groupBy("dim").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("m"))  # components squared
    for row in listed.toLocalIterator():
        m = np.array([e["part"] for e in row["m"]])
        m = m.reshape(int(np.sqrt(len(m))), -1)
        covariance = m[:-1, :-1] - np.outer(m[:-1, -1], m[-1, :-1])
        worst = max(worst, float(np.abs(covariance - np.eye(len(covariance))).max(initial=0)))
    return worst


def deviations(x: np.ndarray, n: int, totals: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exactly; None where a long cannot hold it."""
    wide = n * x.astype(float) - np.array([float(t) for t in totals])
    most = (wide * wide).sum(1)
    if most.max(initial=0) < 2.0**61 and n * float(np.abs(x).max(initial=0)) < 2.0**62 and all(abs(t) < 1 << 62 for t in totals):
        away = n * x - np.array(totals, np.int64)
        return (away * away).sum(1).tolist()
    exact = [sum((n * a - s) ** 2 for a, s in zip(row, totals)) for row in x.tolist()]
    return [e if e < 1 << 63 else None for e in exact]


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for every row and component.

    `vectors` has vec_id and embedding. Rows whose vector is null, empty, or holds a null, a component that is not
    finite or one beyond 64 bits have no rows here; a null vec_id stays null, repeated rows repeat, of equal vectors one is
    fitted. Vectors of different lengths are fitted apart, with as many components as dimensions if those are
    fewer; identity_error is the largest over all lengths. A component without variance has whitened null
    (explained null if nothing varies); a deviation that a long cannot hold is null. Other columns are not read,
    whatever their names; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = id_and_vector(vectors)
    fit = fit_list(rows)
    added = sums(fit)
    counted = added.collect()  # a model a vector length
    if not counted:
        return spark.createDataFrame([], schema)
    solved = eigenpairs(covariances(fit, counted), components)
    models = added.join(solved, "dim").collect()
    error = identity_error(fit, models)
    for stored in (fit, added, solved):
        remove(spark, stored._stored_at)

    def run(known: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = {dim: (*_whitener(m), np.frombuffer(m["values"], "<f8"), [int(s) for s in m["s"]]) for dim, m in known.items()}
        for batch in batches:
            for at, x in integers(batch["embedding"]):
                if x.shape[1] not in ready:
                    continue
                model, (mean, matrix, real, values, totals) = known[x.shape[1]], ready[x.shape[1]]
                k, count = len(values), len(x)
                whitened = ((x - mean) @ matrix).ravel()
                share = values / model["trace"] if model["trace"] else np.full(k, np.nan)
                each = lambda column: pa.array(column).take(pa.array(np.repeat(np.arange(count), k)))
                yield pa.RecordBatch.from_arrays([
                    batch["vec_id"].take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), count)),
                    pa.array(np.full(k * count, model["n"], np.int64)), each(pa.array(deviations(x, model["n"], totals), pa.int64())),
                    pa.array(whitened, mask=np.tile(~real, count)), pa.array(np.tile(share, count), mask=np.isnan(np.tile(share, count))),
                    pa.array(np.full(k * count, error)),
                ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return _passes(spark, rows, models, run, schema, "dim")
