"""Near duplicates of embeddings by a pivot-permutation index.

Reference points (pivots) are a bounded sample of the vectors, no two of them linked. A vector is
described by its nearest pivots in order. Inverted lists name for each pivot the vectors that have it among their
nearest; vectors that share at least SHARED pivots are candidates, counted inside the lists and kept in the list of the
least pivot they share. Candidates are verified by a rounded copy with a certified error, and then by their cosine
in double precision.

Equal vectors are one node. Nodes with the same nearest pivot are first gathered in balls: a leader and the nodes within
half the linking angle of it. All nodes of a ball are linked with one another, so nobody compares them. Two balls
whose centres' angle and radii say that all their pairs are linked, or none, are settled as a whole; only
pairs of balls in between compare members, in blocks of bounded size. A group of copies of any size
thus costs about its size. Lists are worked in blocks of bounded size, too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..storage import broadcast_if_small, materialize
from .common import arrow_pass
from .components import components
from .vectors import directions, id_and_vector, packed, whole_vectors

THRESHOLD = 0.9
#: Pivots in a description, and how many of them candidates share. At a cosine of 0.9 random vectors meet so in 999 of 1000 cases.
NEAREST, SHARED = 12, 2
#: Pivots are four times the root of the number of nodes (a power of two), at least so many, and at most so many bytes.
LEAST_PIVOTS, PIVOT_BYTES = 64, 32 << 20
#: Leaders of balls that a group of nodes with one nearest pivot may have, and nodes of such a group that one task reads.
LEADERS, GROUP_ROWS = 256, 1 << 16
#: Entries of a list, or members of a ball, that one comparison holds.
BLOCK = 1024
#: Rows of at most some hundred bytes that are broadcast.
FEW = 50_000
#: What angles near zero may be off by.
EPSILON = 1e-6


def angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def vector_rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, vec) of all rows; vec is null where the row links with nothing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = batch["vec_id"].is_valid().to_numpy(zero_copy_only=False)
            left = np.ones(batch.num_rows, bool)
            for rows, c in whole_vectors(batch["embedding"]):
                own = named[rows] & (c != 0).any(1)
                rows, c = rows[own], c[own] + 0.0
                if len(rows):
                    left[rows] = False
                    yield pa.RecordBatch.from_arrays([batch["vec_id"].take(pa.array(rows)), pa.array([c.shape[1]] * len(rows), pa.int32()), packed(c)], ["vec_id", "dim", "vec"])
            rows = np.flatnonzero(left)
            yield pa.RecordBatch.from_arrays([batch["vec_id"].take(pa.array(rows)), pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.binary())], ["vec_id", "dim", "vec"])

    return materialize(arrow_pass(id_and_vector(vectors), run, "vec_id long, dim int, vec binary"), "cosine-rows")


def pivots(nodes: DataFrame, threshold: float = THRESHOLD, most: int | None = None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Numbers and directions of the pivots of each vector length, from a sample that follows a hash."""
    n, dim = nodes.agg(F.count("*"), F.max("dim")).first()
    wanted = max(LEAST_PIVOTS, 1 << int(np.ceil(np.log2(4 * np.sqrt(max(n, 1))))))
    wanted = max(1, min(wanted if most is None else most, PIVOT_BYTES // (8 * (dim or 1))))
    sample = nodes.select("dim", "vec", "node").orderBy(F.xxhash64("vec"), "node").limit(2 * wanted).collect()
    by_dim: dict[int, list[bytes]] = {}
    for row in sample:
        by_dim.setdefault(row["dim"], []).append(bytes(row["vec"]))
    chosen, used = {}, 0
    for dim, own in sorted(by_dim.items()):
        room, held = max(1, wanted * len(own) // len(sample)), np.zeros((0, dim))
        for low in range(0, len(own), BLOCK):
            part = directions(own[low:low + BLOCK], dim)
            part = part[(part @ held.T).max(1, initial=-1) < threshold]
            close = part @ part.T >= threshold
            free = np.ones(len(part), bool)
            for i in range(len(part)):
                if free[i]:
                    free[i + 1:] &= ~close[i, i + 1:]
            held = np.concatenate([held, part[free]])
            if len(held) >= room:
                break
        held = held[:room]
        chosen[dim] = (np.arange(used, used + len(held)), held)
        used += len(held)
    return chosen


def describe(nodes: DataFrame, points: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Stored nodes with `near`, their nearest pivots in order, and `need`, the shared ones that make a candidate.

    Vectors of a length without pivots share one list of their own, so they are all compared.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["dim"].to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                for low in range(0, part.num_rows, BLOCK):
                    rows = part.slice(low, BLOCK)
                    if dim in points:
                        numbers, own = points[dim]
                        k = min(NEAREST, len(numbers))
                        cosines = directions(rows["vec"].to_pylist(), dim) @ own.T
                        top = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
                        order = np.argsort(-np.take_along_axis(cosines, top, 1), axis=1, kind="stable")
                        near = numbers[np.take_along_axis(top, order, 1)]
                    else:
                        near = np.full((rows.num_rows, 1), -dim)
                    k = near.shape[1]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1, dtype=np.int32) * k), pa.array(near.ravel().astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([*rows.columns, lists, pa.array([min(SHARED, k)] * len(near), pa.int32())], [*rows.schema.names, "near", "need"])

    return materialize(arrow_pass(nodes.select("node", "dim", "vec", "copies", "label"), run, "node long, dim int, vec binary, copies long, label long, near array<int>, need int"), "described-vectors")


def gather(described: DataFrame, radius: float) -> DataFrame:
    """Stored nodes with `ball`, the leader whose ball they are in (themselves if alone), and `away`, the angle to it.

    Groups of one nearest pivot are read in the order of a hash, large ones in parts; a node that no leader covers
    becomes one while there is room. Which nodes are leaders changes the work, not the result.
    """
    first = F.col("near")[0]
    sizes = described.groupBy(first.alias("first")).agg(F.ceil(F.count("*") / GROUP_ROWS).cast("int").alias("parts"))
    dealt = described.withColumn("first", first).join(broadcast_if_small(sizes), "first")
    dealt = dealt.withColumn("mixed", F.xxhash64("vec", "node")).withColumn("part", F.pmod("mixed", "parts"))
    ordered = dealt.repartition("first", "part").sortWithinPartitions("first", "part", "mixed")
    columns = ["node", "dim", "vec", "copies", "label", "near", "need"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, leaders, names = None, None, []
        for batch in batches:
            keys = np.column_stack([batch["first"].to_numpy(), batch["part"].to_numpy()])
            cuts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])) if len(keys) else []
            for low, high in zip(cuts, [*cuts[1:], len(keys)]):
                part = batch.slice(low, high - low)
                dim, ids = part["dim"][0].as_py(), part["node"].to_numpy()
                if group != (key := tuple(keys[low].tolist())):
                    group, leaders, names = key, np.zeros((0, dim)), []
                x = directions(part["vec"].to_pylist(), dim)
                ball, away = ids.copy(), np.zeros(len(ids))
                open_rows = np.arange(len(ids))
                if names:
                    angles = angle(x @ leaders.T)
                    best = angles.argmin(1)
                    least = angles[open_rows, best]
                    covered = least <= radius
                    ball[covered], away[covered] = np.array(names)[best[covered]], least[covered]
                    open_rows = open_rows[~covered]
                while len(open_rows) and len(names) < LEADERS:
                    centre = x[open_rows[0]]
                    leaders, names = np.concatenate([leaders, centre[None]]), [*names, int(ids[open_rows[0]])]
                    others = open_rows[1:]
                    angles = angle(x[others] @ centre)
                    inside = angles <= radius
                    ball[others[inside]], away[others[inside]] = names[-1], angles[inside]
                    open_rows = others[~inside]
                yield pa.RecordBatch.from_arrays([*(part[c] for c in columns), pa.array(ball), pa.array(away)], [*columns, "ball", "away"])

    schema = "node long, dim int, vec binary, copies long, label long, near array<int>, need int, ball long, away double"
    return materialize(arrow_pass(ordered.select(*columns, "first", F.col("part").cast("int").alias("part")), run, schema), "balled-vectors")


def ball_table(nodes: DataFrame) -> DataFrame:
    """Stored (ball, dim, vec, radius, members, copies, label, pivots, need): a ball has all pivots of its members."""
    others = nodes.filter("ball <> node")
    stats = others.groupBy("ball").agg(
        F.max("away").alias("radius"), F.count("*").alias("more"), F.sum("copies").alias("more_copies"), F.min("label").alias("more_label"))
    sets = others.select("ball", F.explode("near").alias("pivot")).distinct().groupBy("ball").agg(F.collect_list("pivot").alias("more_pivots"))  # at most all pivots
    more = stats.join(sets, "ball")
    joined = nodes.filter("ball = node").drop("ball").withColumnRenamed("node", "ball").join(broadcast_if_small(more, limit=FEW // 10), "ball", "left")
    return materialize(joined.select(
        "ball", "dim", "vec", F.coalesce("radius", F.lit(0.0)).alias("radius"), (F.coalesce("more", F.lit(0)) + 1).alias("members"),
        (F.col("copies") + F.coalesce("more_copies", F.lit(0))).alias("copies"), F.least("label", F.coalesce("more_label", "label")).alias("label"),
        F.array_sort(F.array_union("near", F.coalesce("more_pivots", F.array().cast("array<int>")))).alias("pivots"), "need"), "balls")


def rounded(balls: DataFrame) -> DataFrame:
    """(ball, dim, radius, pivots, need, rough, error): directions by one byte a component and how far off they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["dim"].to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                x = directions(part["vec"].to_pylist(), dim)
                scale = 127 / np.abs(x).max(1, keepdims=True)
                rough = np.rint(x * scale).astype(np.int8)
                error = np.linalg.norm(x - rough / scale, axis=1)
                size = pa.array([r.tobytes() for r in rough], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*(part[c] for c in ("ball", "dim", "radius", "pivots", "need")), size, pa.array(scale[:, 0]), pa.array(error)],
                    ["ball", "dim", "radius", "pivots", "need", "rough", "scale", "error"])

    schema = "ball long, dim int, radius double, pivots array<int>, need int, rough binary, scale double, error double"
    return arrow_pass(balls.select("ball", "dim", "radius", "pivots", "need", "vec"), run, schema)


def list_candidates(frame: pd.DataFrame, threshold: float = THRESHOLD) -> pd.DataFrame:
    """Pairs (u, v) of a list's blocks `a` and `b` that share enough pivots, none below the list's own, and may be linked."""
    pivot, a, b = (int(frame[c].iloc[0]) for c in ("pivot", "a", "b"))
    frame = frame.sort_values("ball", kind="stable")
    sizes = frame["pivots"].map(len).to_numpy()
    flat = np.concatenate(frame["pivots"].to_numpy())
    names, column, often = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(frame)), sizes)
    shared = often[column] > 1
    names, column = names[often > 1], (np.cumsum(often > 1) - 1)[column]
    has = np.zeros((len(frame), len(names)), np.float32)
    has[row[shared], column[shared]] = 1
    x = np.frombuffer(b"".join(frame["rough"]), np.int8).reshape(len(frame), -1).astype(np.float32) / frame["scale"].to_numpy()[:, None].astype(np.float32)
    error, radius, ball, block = (frame[c].to_numpy() for c in ("error", "radius", "ball", "block"))
    left, right = np.flatnonzero(block == a), np.flatnonzero(block == b)
    low = names < pivot
    count = has[left] @ has[right].T
    wanted = (count >= float(frame["need"].iloc[0])) & (has[left][:, low] @ has[right][:, low].T == 0)
    if a == b:
        wanted &= left[:, None] < right[None]
    i, j = np.nonzero(wanted)
    i, j = left[i], right[j]
    reach = np.minimum(np.arccos(threshold) + radius[i] + radius[j] + EPSILON, np.pi)
    cosine = np.einsum("ij,ij->i", x[i], x[j])
    close = cosine >= np.cos(reach) - (error[i] + error[j] + error[i] * error[j]) - 1e-5
    i, j = i[close], j[close]
    return pd.DataFrame({"u": np.minimum(ball[i], ball[j]), "v": np.maximum(ball[i], ball[j])})


def candidates(balls: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Stored (u, v): candidate pairs of balls, each once.

    Of s pivots the s - need + 1 least are enough to meet in the list of the least shared one.
    """
    posted = rounded(balls).withColumn("pivot", F.explode(F.slice("pivots", F.lit(1), F.size("pivots") - F.col("need") + 1)))
    posted = materialize(posted, "pivot-lists")
    sizes = posted.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("n")).filter("n > 1").drop("n")
    dealt = posted.join(broadcast_if_small(sizes), "pivot").withColumn("block", F.pmod(F.xxhash64("ball"), "blocks").cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("block", k).alias("a"), F.greatest("block", k).alias("b")))
    placed = dealt.select("*", F.explode(meets).alias("m")).select("pivot", "m.a", "m.b", "block", "ball", "pivots", "need", "radius", "rough", "scale", "error")
    found = placed.groupBy("pivot", "a", "b").applyInPandas(lambda frame: list_candidates(frame, threshold), "u long, v long")
    return materialize(found, "ball-candidates")


def verify(pairs: DataFrame, balls: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Stored (u, v, u_members, v_members, u_copies, v_copies, whole) of candidates with linked members, or perhaps so.

    `whole` is true where all pairs of members are linked.
    """
    limit = np.arccos(threshold)

    def side(name: str) -> DataFrame:
        return balls.select(F.col("ball").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("dim", "vec", "radius", "members", "copies")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["u_dim"].to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                cosine = np.einsum("ij,ij->i", directions(part["u_vec"].to_pylist(), dim), directions(part["v_vec"].to_pylist(), dim))
                radii = part["u_radius"].to_numpy() + part["v_radius"].to_numpy()
                between = angle(cosine)
                single = (part["u_members"].to_numpy() == 1) & (part["v_members"].to_numpy() == 1)
                whole = np.where(single, cosine >= threshold, between + radii <= limit - EPSILON)
                perhaps = np.where(single, whole, between - radii <= limit + EPSILON)
                kept = ["u", "v", "u_members", "v_members", "u_copies", "v_copies"]
                out = pa.RecordBatch.from_arrays([*(part[c] for c in kept), pa.array(whole)], [*kept, "whole"])
                yield out.filter(pa.array(perhaps))

    joined = pairs.join(side("u"), "u").join(side("v"), "v")
    schema = "u long, v long, u_members long, v_members long, u_copies long, v_copies long, whole boolean"
    return materialize(arrow_pass(joined.drop("v_dim"), run, schema), "ball-links")


def member_links(pairs: DataFrame, nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Stored (node, n, u, v): vectors that members of the pairs' balls are linked with; node is null on one row for each linked pair's blocks."""
    def blocks(of: str) -> Column:
        return F.explode(F.sequence(F.lit(0), (F.ceil(F.col(of) / BLOCK) - 1).cast("int")))

    met = pairs.select("u", "v", "v_members", blocks("u_members").alias("a")).select("u", "v", "a", blocks("v_members").alias("b"))
    used = pairs.select(F.col("u").alias("ball"), F.col("u_members").alias("members")).union(pairs.select("v", "v_members")).distinct()
    mine = nodes.join(used, "ball").withColumn("block", F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / BLOCK)).cast("int"))
    # a block has about BLOCK members
    held = materialize(mine.groupBy("ball", "block").agg(F.max("dim").alias("dim"), F.collect_list(F.struct("node", "copies", "vec")).alias("held")), "ball-blocks")

    def side(ball: str, block: str) -> DataFrame:
        return held.select(F.col("ball").alias(ball), F.col("block").alias(block), F.col("dim").alias(f"{ball}_dim"), F.col("held").alias(f"{ball}_held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                sides = []
                for name in ("u", "v"):
                    own = row[f"{name}_held"]
                    sides.append((np.array([m["node"] for m in own]), np.array([m["copies"] for m in own]), directions([m["vec"] for m in own], row["u_dim"])))
                (u_node, u_copies, x), (v_node, v_copies, y) = sides
                linked = x @ y.T >= threshold
                if not linked.any():
                    continue
                node, n = np.concatenate([u_node, v_node]), np.concatenate([linked @ v_copies, u_copies @ linked])
                node, n = node[n > 0], n[n > 0]
                some = len(node) + 1
                yield pa.RecordBatch.from_arrays([
                    pa.array([*node.tolist(), None], pa.int64()), pa.array([*n.tolist(), 0], pa.int64()),
                    pa.array([row["u"]] * some, pa.int64()), pa.array([row["v"]] * some, pa.int64())], ["node", "n", "u", "v"])

    joined = met.join(side("u", "a"), ["u", "a"]).join(side("v", "b"), ["v", "b"])
    return materialize(arrow_pass(joined.select("u", "v", "u_dim", "u_held", "v_held"), run, "node long, n long, u long, v long"), "member-links")


def embedding_links(vectors: DataFrame, threshold: float = THRESHOLD, most_pivots: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Two rows are linked if their vectors' cosine is at least `threshold`: n_links counts the other rows directly
    linked, component_id is the smallest vec_id that links lead to, its own included, and that vector is kept.
    The index may miss a link (about 1 of 1000 at the threshold itself, fewer above); none is invented.

    Rows with a null vec_id, and vectors that are null, empty, zero, or hold a null or a component that is not
    finite link with nothing: n_links 0, component_id their vec_id, kept (also with a null vec_id). Vectors of different lengths
    don't link. Rows that repeat a vec_id are vectors of their own; equal vectors are linked. Other columns
    are not read, whatever their names; an empty table gives no rows.
    """
    rows = vector_rows(vectors)
    grouped = rows.filter("vec is not null").groupBy("dim", "vec").agg(F.count("*").alias("copies"), F.min("vec_id").alias("label"))
    nodes = materialize(grouped.withColumn("node", F.monotonically_increasing_id()), "distinct-vectors")
    described = describe(nodes, pivots(nodes, threshold, most_pivots))
    members = gather(described, np.arccos(threshold) / 2 - EPSILON)
    balls = ball_table(members)
    pairs = verify(candidates(balls, threshold), balls, threshold)
    inner = member_links(pairs.filter("not whole"), members, threshold)

    whole = pairs.filter("whole")
    added = whole.select(F.col("u").alias("ball"), F.col("v_copies").alias("n")).union(whole.select("v", "u_copies"))
    added = added.groupBy("ball").agg(F.sum("n").alias("whole_n"))
    single = inner.filter("node is not null").groupBy("node").agg(F.sum("n").alias("member_n"))
    links = whole.select("u", "v").union(inner.filter("node is null").select("u", "v").distinct())
    joint = materialize(components(links), "ball-components").withColumnRenamed("node", "ball")
    placed = balls.select("ball", "copies", "label").join(broadcast_if_small(joint), "ball", "left").withColumn("component", F.coalesce("component", "ball"))
    placed = placed.join(placed.groupBy("component").agg(F.min("label").alias("component_id")), "component")
    placed = placed.join(broadcast_if_small(added), "ball", "left")
    counted = members.select("node", "ball").join(placed, "ball").join(broadcast_if_small(single), "node", "left").select(
        "node", "component_id", (F.col("copies") - 1 + F.coalesce("whole_n", F.lit(0)) + F.coalesce("member_n", F.lit(0))).alias("n_links"))
    linked = materialize(counted.filter("n_links > 0"), "linked-nodes")
    linked = members.select("node", "dim", "vec").join(broadcast_if_small(linked), "node").drop("node")
    joined = rows.join(broadcast_if_small(linked, limit=FEW), ["dim", "vec"], "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
