"""Exact inner-product search by M-trees and best-first search.

Components become integers, so scores are exact. With M the greatest length, (x, sqrt(M^2 - |x|^2))
against (q, 0) has the distance sqrt(|q|^2 + M^2 - 2 q.x): the nearest vector in this metric space is the
one with the largest inner product. Vectors are dealt to the nearest of some pivots; a share becomes
an M-tree of paged nodes (trees, where it is large): a routing object, a covering radius, the distance to the
parent's routing object. Pages are stored one by one and decoded when they are opened.

A directory with the pivot, radius and size of every share is the upper level of the tree. In the first
round a query goes to the share of its nearest pivot, whose k-th best score bounds the others; in the second it goes
only to shares that can still reach that score. Queries that go to one share travel together. A block
of queries opens nodes in the order of the best score any of them can still find there, each node once, and
only with the queries that reach it; the triangle inequality on stored distances saves most distances.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..storage import broadcast_if_small, materialize
from .common import arrow_pass

#: Pivots of all lengths together, lengths that have pivots, rows a pivot stands for at least.
PIVOTS, LENGTHS, PIVOT_ROWS = 1024, 16, 512
#: Vectors in one tree and in one page, children of a node, queries that travel together.
TREE_ROWS, PAGE_ROWS, FANOUT, QUERY_BLOCK = 4096, 64, 16, 1024
#: Below every score: squared lengths stay under it.
LOWEST = -(1 << 1000)


def integer_vectors(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, dim, vector, square) of vectors that take part: floor(scale * x) as doubles in bytes, squared length.

    Rows with a null id, a null or empty vector, or a component that is null or not finite take no
    part, nor do vectors with a squared length beyond 2^1000. Vectors of different lengths are searched apart.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for vec_id, vector in zip(batch["vec_id"].to_pylist(), batch["embedding"]):
                values = vector.values if vector.is_valid else None
                if vec_id is None or values is None or not len(values) or values.null_count:
                    continue
                with np.errstate(over="ignore", invalid="ignore"):
                    x = np.floor(values.to_numpy(zero_copy_only=False).astype(float) * scale) + 0.0
                    square = float(x @ x)
                if square < 2.0**1000:
                    rows.append((vec_id, len(x), x.astype("<f8").tobytes(), square))
            names = ("vec_id", "dim", "vector", "square")
            types = (pa.int64(), pa.int32(), pa.binary(), pa.float64())
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], pa.schema(list(zip(names, types))))

    chosen = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return arrow_pass(chosen, run, "vec_id long, dim int, vector binary, square double")


def matrix(vectors: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), "<f8").reshape(len(vectors), -1) if vectors else np.zeros((0, 0))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of integers, as longs or, where these may not hold them, as Python's integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[-1]
    if most < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if most < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = np.vectorize(int, otypes=[object])
    return whole(a) @ whole(b).T


@dataclass
class MTree:
    """Nodes in arrays; node 0 is the root. Leaves are pages with rows first..last of `ids` and `points`."""

    ids: np.ndarray
    points: np.ndarray
    routing: np.ndarray
    radius: np.ndarray
    to_parent: np.ndarray
    first: np.ndarray
    last: np.ndarray
    children: list[list[int]]

    def page(self, node: int) -> tuple[np.ndarray, np.ndarray]:
        rows = slice(self.first[node], self.last[node])
        return self.ids[rows], self.points[rows]

    def stored(self) -> tuple[bytes, list[bytes]]:
        """The nodes without their rows, and a page for every node (empty where it has children)."""
        nodes = pickle.dumps((self.routing, self.radius, self.to_parent, self.children))
        own = [self.page(node) for node in range(len(self.radius))]
        return nodes, [ids.astype("<i8").tobytes() + points.astype("<f8").tobytes() for ids, points in own]


class StoredTree:
    """A tree read from storage; a page is decoded when a search opens it."""

    def __init__(self, nodes: bytes, pages: pa.Array, dim: int):
        self.routing, self.radius, self.to_parent, self.children = pickle.loads(nodes)
        self.pages, self.dim = pages, dim

    def page(self, node: int) -> tuple[np.ndarray, np.ndarray]:
        held = self.pages[node].as_buffer()
        n = held.size // (8 + 8 * self.dim)
        return np.frombuffer(held, "<i8", n), np.frombuffer(held, "<f8", n * self.dim, 8 * n).reshape(n, self.dim)


def lift(x: np.ndarray, greatest: float) -> np.ndarray:
    """Points whose distances order inner products; `greatest` bounds the squared lengths."""
    x = x.astype(float)
    return np.column_stack([x, np.sqrt(np.maximum(greatest - (x * x).sum(1), 0))])


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    squares = (points * points).sum(1)[:, None] + (centres * centres).sum(1) - 2 * points @ centres.T
    return np.sqrt(np.maximum(squares, 0))


def build(ids: np.ndarray, x: np.ndarray, greatest: float, page: int = PAGE_ROWS, fanout: int = FANOUT) -> MTree:
    """Bulk load: rows go to the nearest of `fanout` routing objects, again and again down to pages."""
    lifted = lift(x, greatest)
    order, routing, radius, to_parent, first, last, children = [], [], [], [], [], [], []

    def add(rows: np.ndarray, centre: np.ndarray, above: np.ndarray | None) -> int:
        node = len(routing)
        away = np.linalg.norm(lifted[rows] - centre, axis=1)
        routing.append(centre)
        radius.append(float(away.max(initial=0.0)))
        to_parent.append(0.0 if above is None else float(np.linalg.norm(centre - above)))
        first.append(0)
        last.append(0)
        children.append([])
        if len(rows) > page and radius[node] > 0:
            seeds = lifted[rows[np.linspace(0, len(rows) - 1, min(fanout, -(-len(rows) // page))).astype(int)]]
            seeds = np.unique(np.vstack([seeds, lifted[rows[away.argmax()]]]), axis=0)
            near = ((seeds * seeds).sum(1) - 2 * lifted[rows] @ seeds.T).argmin(1)
            parts = [(rows[near == k], seeds[k]) for k in range(len(seeds)) if (near == k).any()]
            if len(parts) > 1:
                for part, seed in parts:
                    children[node].append(add(part, seed, centre))
                return node
        first[node] = len(order)
        order.extend(rows.tolist())
        last[node] = len(order)
        return node

    add(np.argsort(ids, kind="stable"), lifted.mean(0), None)
    at = np.array(order, np.int64)
    return MTree(ids[at], x[at], np.array(routing), np.array(radius), np.array(to_parent), np.array(first), np.array(last), children)


def reach(square: np.ndarray, greatest: float, away: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """The best score that queries can find within `radius` of centres at distances `away`, rounding included."""
    gap = np.maximum(0.0, away - radius)
    total = (square + greatest)[:, None]
    return (total - gap * gap) / 2 + 1e-9 * total + 1e-6


def search_block(
    tree: MTree | StoredTree, own: np.ndarray, x: np.ndarray, k: int, floors: list[int | None], greatest: float,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the block, score, vec_id) of up to k largest scores a query, of at least its floor; ties to smaller ids.

    Rows with the query's own id are no candidates.
    """
    points = np.column_stack([x.astype(float), np.zeros(len(x))])
    square = (points * points).sum(1)
    kind, low = (np.int64, int(np.iinfo(np.int64).min)) if greatest < 2**62 else (object, LOWEST)
    best = np.full((len(x), k), low, kind)  # scores only: they raise the floors
    least = np.array([low if f is None else f for f in floors], kind)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    rows = np.arange(len(x))
    away = distances(points, tree.routing[:1])[:, 0]
    top = reach(square, greatest, away[:, None], tree.radius[:1])[:, 0]
    frontier = [(-float(top.max(initial=-np.inf)), 0, rows, away, top)]
    while frontier:
        _, node, rows, away, top = heapq.heappop(frontier)
        live = top >= least[rows].astype(float)
        if not live.any():
            continue
        rows, away = rows[live], away[live]
        if tree.children[node]:
            inside = np.array(tree.children[node])
            floor = least[rows].astype(float)[:, None]
            # |d(query, parent) - d(parent, child)| bounds the distance to a child before it is computed
            may = reach(square[rows], greatest, np.abs(away[:, None] - tree.to_parent[inside]), tree.radius[inside]) >= floor
            met = may.any(0)
            inside, may = inside[met], may[:, met]
            nearer = distances(points[rows], tree.routing[inside])
            tops = reach(square[rows], greatest, nearer, tree.radius[inside])
            may &= tops >= floor
            for at, child in enumerate(inside.tolist()):
                mine = may[:, at]
                if mine.any():
                    heapq.heappush(frontier, (-float(tops[mine, at].max()), child, rows[mine], nearer[mine, at], tops[mine, at]))
            continue
        ids, held = tree.page(node)
        scores = products(x[rows], held).astype(kind)
        other = own[rows, None] != ids
        hits = other & (scores >= least[rows, None])
        some = hits.any(1)
        if not some.any():
            continue
        rows, hits, scores = rows[some], hits[some], scores[some]
        q, at = np.nonzero(hits)
        found.append((rows[q], scores[q, at], ids[at]))
        best[rows] = np.sort(np.column_stack([best[rows], np.where(hits, scores, low)]), axis=1)[:, -k:]
        least[rows] = np.maximum(least[rows], best[rows, 0])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, kind), np.zeros(0, np.int64)
    q, scores, ids = (np.concatenate(c) for c in zip(*found))
    kept = scores >= least[q]
    q, scores, ids = q[kept], scores[kept], ids[kept]
    order = np.array(sorted(range(len(q)), key=lambda i: (q[i], -scores[i], ids[i])), np.int64) if kind is object else np.lexsort((ids, -scores, q))
    q, scores, ids = q[order], scores[order], ids[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    return q[rank < k], scores[rank < k], ids[rank < k]


def search(tree: MTree | StoredTree, query: np.ndarray, query_id: int, k: int, floor: int | None, greatest: float) -> list[tuple[int, int]]:
    """Up to k (score, vec_id) of one query."""
    _, scores, ids = search_block(tree, np.array([query_id]), query[None], k, [floor], greatest)
    return [(int(s), int(i)) for s, i in zip(scores, ids)]


def deal(vectors: DataFrame, pivots: dict[int, np.ndarray], greatest: float, lifted: bool) -> DataFrame:
    """The columns of `vectors` with near, the nearest pivot, and its distance; -1 for lengths without pivots.

    Queries are not lifted: their further component is 0.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
    centres = {dim: lift(x, greatest) for dim, x in pivots.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, away = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
            dims = batch["dim"].to_numpy()
            for dim in np.unique(dims).tolist():
                if dim in centres:
                    rows = np.flatnonzero(dims == dim)
                    x = matrix([batch["vector"][int(r)].as_py() for r in rows])
                    far = distances(lift(x, greatest) if lifted else np.column_stack([x, np.zeros(len(x))]), centres[dim])
                    near[rows], away[rows] = far.argmin(1), far.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near), pa.array(away)], [*batch.schema.names, "near", "away"])

    return arrow_pass(vectors, run, f"{schema}, near int, away double")


def build_trees(dealt: DataFrame, shares: DataFrame, greatest: float) -> DataFrame:
    """Stored trees (dim, near, salt, nodes, pages); `shares` says into how many trees a share is split."""
    salted = dealt.join(broadcast_if_small(shares.select("dim", "near", "salts")), ["dim", "near"]).withColumn("salt", F.pmod(F.xxhash64("vec_id"), "salts").cast("int"))

    def plant(frame: pd.DataFrame) -> pd.DataFrame:
        nodes, pages = build(frame["vec_id"].to_numpy(), matrix(frame["vector"].tolist()), greatest).stored()
        return pd.DataFrame({"dim": frame["dim"].iloc[:1], "near": frame["near"].iloc[:1], "salt": frame["salt"].iloc[:1], "nodes": [nodes], "pages": [pages]})

    grown = salted.select("dim", "near", "salt", "vec_id", "vector").groupBy("dim", "near", "salt")
    return materialize(grown.applyInPandas(plant, "dim int, near int, salt int, nodes binary, pages array<binary>"), "mtrees")


def answers(queries: DataFrame, choose: Callable[[int, np.ndarray, np.ndarray, list], dict[int, np.ndarray]], trees: DataFrame, shares: DataFrame, k: int, greatest: float) -> DataFrame:
    """(query_id, copy, vec_id, score, wide) from the trees of the shares that `choose` names for a block of queries.

    `choose` has the length, the nearest pivots, the vectors and the floors; it gives rows of the block by share.
    """
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, near = batch["dim"].to_numpy(), batch["near"].to_numpy()
            for dim in np.unique(dims).tolist():
                chosen = np.flatnonzero(dims == dim)
                for start in range(0, len(chosen), QUERY_BLOCK):
                    part = chosen[start:start + QUERY_BLOCK]
                    taken = batch.take(pa.array(part))
                    ids, copies = taken["query_id"].to_numpy(), taken["copy"].to_numpy()
                    x = matrix(taken["vector"].to_pylist())
                    floors = [
                        s if w is None else int.from_bytes(w, "big") + LOWEST for s, w in zip(taken["floor"].to_pylist(), taken["wide_floor"].to_pylist())
                    ]
                    for share, rows in choose(dim, near[part], x, floors).items():
                        packed = pickle.dumps((ids[rows], copies[rows], x[rows], [floors[r] for r in rows]))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([dim], pa.int32()), pa.array([share], pa.int32()), pa.array([packed], pa.binary())], ["dim", "near", "queries"],
                        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own, copies, x, floors = pickle.loads(batch["queries"][i].as_py())
                tree = StoredTree(batch["nodes"][i].as_py(), batch["pages"][i].values, x.shape[1])
                q, scores, ids = search_block(tree, own, x, k, floors, greatest)
                if scores.dtype == object:
                    score = [int(s) if abs(s) < 2**63 else None for s in scores]
                    wide = [(int(s) - LOWEST).to_bytes(126, "big") for s in scores]
                else:
                    score, wide = scores, [None] * len(scores)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[q]), pa.array(copies[q]), pa.array(ids), pa.array(score, pa.int64()), pa.array(wide, pa.binary())],
                    ["query_id", "copy", "vec_id", "score", "wide"],
                )

    blocks = arrow_pass(queries, gather, "dim int, near int, queries binary")
    to_trees = blocks.join(broadcast_if_small(shares.select("dim", "near", "salts")), ["dim", "near"])
    meetings = to_trees.select("dim", "near", "queries", F.explode(F.sequence(F.lit(0), (F.col("salts") - 1).cast("int"))).alias("salt")).join(trees, ["dim", "near", "salt"])
    return arrow_pass(meetings.select("nodes", "pages", "queries"), run, "query_id long, copy int, vec_id long, score long, wide binary")


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "copy").orderBy(F.desc("wide"), F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, pivot_rows: int = PIVOTS, tree_rows: int = TREE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest scores, ties to smaller vec_id.

    `vectors` has vec_id and embedding (further columns may have any name), `is_query` chooses the queries by vec_id.
    A query never meets rows with its own id; with fewer candidates it has fewer rows. Empty tables give no rows;
    for nulls see `integer_vectors`. Rows that share id and vector are one query; rows that share the id
    only are queries of their own, each with ranks from 1. Candidates count as often as they are
    repeated. A score that a long cannot hold is null; its rank is right. Vectors may have any number of
    lengths: the most frequent ones have pivots, in the others all vectors of one length are searched.
    """
    spark = vectors.sparkSession
    rows = materialize(integer_vectors(vectors), "integer-vectors")
    n, greatest = rows.agg(F.count("*"), F.max("square")).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    greatest = float(greatest) * (1 + 1e-12)
    # of equal vectors only those with the k + 1 smallest ids can be among the k best of a query
    equal = F.dense_rank().over(Window.partitionBy("dim", "vector").orderBy("vec_id"))
    candidates = rows.withColumn("place", equal).filter(F.col("place") <= k + 1).select("vec_id", "dim", "vector")

    common = {r["dim"]: r["count"] for r in rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(LENGTHS).collect()}
    most = max(1, min(pivot_rows // len(common), -(-max(common.values()) // min(PIVOT_ROWS, tree_rows))))
    place = F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("vec_id"), "vec_id"))
    sample: dict[int, list[bytes]] = {}
    for r in rows.filter(F.col("dim").isin(list(common))).withColumn("place", place).filter(F.col("place") <= most).orderBy("dim", "place").collect():
        sample.setdefault(r["dim"], []).append(bytes(r["vector"]))
    pivots = {dim: np.unique(matrix(own), axis=0) for dim, own in sample.items()}

    dealt = materialize(deal(candidates, pivots, greatest, True), "mtree-shares")
    salts = F.ceil(F.count("*") / tree_rows).alias("salts")
    shares = materialize(dealt.groupBy("dim", "near").agg(F.max("away").alias("radius"), salts), "mtree-directory")
    trees = build_trees(dealt, shares, greatest)
    radii = {dim: np.full(len(x), -np.inf) for dim, x in pivots.items()}  # the upper level: at most one row a pivot
    for r in shares.filter("near >= 0").collect():
        radii[r["dim"]][r["near"]] = r["radius"]
    centres = {dim: lift(x, greatest) for dim, x in pivots.items()}

    def own_share(dim: int, near: np.ndarray, x: np.ndarray, floors: list) -> dict[int, np.ndarray]:
        return {int(share): np.flatnonzero(near == share) for share in np.unique(near)}

    def other_shares(dim: int, near: np.ndarray, x: np.ndarray, floors: list) -> dict[int, np.ndarray]:
        if dim not in centres:
            return {}
        points = np.column_stack([x, np.zeros(len(x))])
        floor = np.array([LOWEST if f is None else f for f in floors], object).astype(float)
        tops = reach((points * points).sum(1), greatest, distances(points, centres[dim]), radii[dim])
        may = (tops >= floor[:, None]) & (radii[dim] >= 0) & (near[:, None] != np.arange(len(radii[dim])))
        return {int(share): np.flatnonzero(may[:, share]) for share in np.flatnonzero(may.any(0))}

    asked = rows.filter(is_query).select(F.col("vec_id").alias("query_id"), "dim", "vector").distinct()
    copy = F.row_number().over(Window.partitionBy("query_id").orderBy("dim", "vector"))
    queries = materialize(deal(asked.withColumn("copy", copy), pivots, greatest, False).drop("away"), "mtree-queries")
    none = queries.withColumns({"floor": F.lit(None).cast("long"), "wide_floor": F.lit(None).cast("binary")})
    tasks = max(1, min(spark.sparkContext.defaultParallelism, queries.count() // QUERY_BLOCK))
    nearby = materialize(ranked(answers(none.coalesce(tasks), own_share, trees, shares, k, greatest), k), "mtree-first-round")
    floors = nearby.filter(F.col("rank") == k).select("query_id", "copy", F.col("score").alias("floor"), F.col("wide").alias("wide_floor"))
    again = queries.join(broadcast_if_small(floors), ["query_id", "copy"], "left").select(none.columns)
    far = answers(again.coalesce(tasks), other_shares, trees, shares, k, greatest)
    return ranked(nearby.drop("rank").unionByName(far), k).select("query_id", "rank", "vec_id", "score")
