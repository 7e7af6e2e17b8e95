import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rastertables.llm import mtree


def brute(rows, k, every):
    held = []
    for vec_id, v in rows:
        if vec_id is not None and v and all(x is not None and math.isfinite(x) for x in v):
            held.append((vec_id, [math.floor(256 * x) for x in v]))
    out = []
    for q, v in held:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in held if i != q and len(w) == len(v))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    return [[float(x) for x in np.float32(centres[rng.integers(5)] + rng.normal(size=dim) * 0.2)] for _ in range(n)]


def test_equals_brute_force_with_ties_and_odd_rows(spark):
    rows = list(enumerate(vectors(300, 6, 1)))
    rows += [(300 + i, rows[50][1]) for i in range(60)]  # many equal vectors
    rows += [(None, rows[0][1]), (1000, None), (1010, [1.0, None]), (1020, [float("nan")] * 6), (1030, [float("inf")] * 6), (1040, [])]
    rows += [(2000 + i, v) for i, v in enumerate(vectors(3, 2, 2))] + [(-50, rows[3][1]), (3000, [0.0] * 6)]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, tree string")
    got = mtree.top_k(frame, F.col("vec_id") % 10 == 0, k=5, pivot_rows=8, tree_rows=64)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == brute(rows, 5, 10)


def test_few_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert mtree.top_k(spark.createDataFrame([], schema), F.lit(True)).count() == 0
    assert mtree.top_k(spark.createDataFrame([(0, [1.0])], schema), F.lit(True)).count() == 0
    two = spark.createDataFrame([(0, [1.0]), (50, [2.0])], schema)
    assert sorted(map(tuple, mtree.top_k(two, F.col("vec_id") % 50 == 0).collect())) == [(0, 1, 50, 131072), (50, 1, 0, 131072)]


def test_search_opens_few_pages():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 8)) * 2000
    x = np.floor(centres[rng.integers(40, size=4000)] + rng.normal(size=(4000, 8)) * 20).astype(np.int64)
    greatest = float((x * x).sum(1).max())
    tree = mtree.build(np.arange(4000), x, greatest)
    opened = []
    whole = mtree.products
    mtree.products = lambda a, b: opened.append(len(b)) or whole(a, b)
    try:
        got = mtree.search(tree, x[0], 0, 5, None, greatest)
    finally:
        mtree.products = whole
    scores = x @ x[0]
    order = [i for i in np.lexsort((np.arange(4000), -scores)) if i != 0][:5]
    assert sorted(got, key=lambda r: (-r[0], r[1])) == [(int(scores[i]), int(i)) for i in order]
    assert sum(opened) < 2000


def test_radii_cover_the_pages():
    x = np.random.default_rng(5).integers(-50, 50, (500, 4))
    greatest = float((x * x).sum(1).max())
    tree = mtree.build(np.arange(500), x, greatest, page=16, fanout=4)
    points = mtree.lift(tree.points, greatest)

    def rows(node):
        return [r for c in tree.children[node] for r in rows(c)] or list(range(tree.first[node], tree.last[node]))

    assert sorted(tree.ids.tolist()) == list(range(500))
    for node in range(len(tree.radius)):
        assert (np.linalg.norm(points[rows(node)] - tree.routing[node], axis=1) <= tree.radius[node] + 1e-9).all()
        for child in tree.children[node]:
            assert abs(np.linalg.norm(tree.routing[node] - tree.routing[child]) - tree.to_parent[child]) < 1e-9


def test_query_rows_with_one_id_are_queries_of_their_own(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (2, [0.0, 2.0]), (3, [0.5, 0.5])]
    got = mtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 50, k=2)
    one, half = 65536, 32768
    assert sorted(map(tuple, got.collect())) == [(50, 1, 1, one), (50, 1, 2, 2 * one), (50, 2, 2, 2 * one), (50, 2, 3, half)]


def test_scores_beyond_a_long_keep_their_order(spark):
    rows = [(0, [1e17, 1.0]), (1, [1e17, 0.0]), (2, [1e17, 1.0]), (3, [-1e17, 0.0]), (4, [0.0, 1.0]), (5, [1e200, 0.0])]
    got = mtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id").isin(0, 4), k=5, pivot_rows=2, tree_rows=2)
    found = sorted(map(tuple, got.collect()))
    assert [r[2] for r in found if r[0] == 0] == [2, 1, 4, 3]
    assert [r[3] for r in found if r[0] == 0] == [None, None, 65536, None]
    assert found[4:] == [(4, 1, 0, 65536), (4, 2, 2, 65536), (4, 3, 1, 0), (4, 4, 3, 0)]


def test_any_number_of_lengths(spark):
    rows = [(2 * i + j, [1.0] * (i + 1)) for i in range(1100) for j in range(2)]
    got = mtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == [(q, 1, q + 1, 65536 * (q // 2 + 1)) for q in range(0, 2200, 50)]


def test_blocks_of_queries_equal_brute_force():
    rng = np.random.default_rng(8)
    for seed in range(10):
        x = rng.integers(-9, 9, (400, 3)) * (10**12 if seed == 9 else 1)
        ids = rng.permutation(400)
        greatest = float((x.astype(float) ** 2).sum(1).max()) * (1 + 1e-12)
        tree = mtree.build(ids, x.astype(float), greatest, page=8, fanout=3)
        nodes, pages = tree.stored()
        stored = mtree.StoredTree(nodes, pa.array(pages, pa.binary()), 3)
        q, scores, found = mtree.search_block(stored, ids[:50], x[:50].astype(float), 4, [None] * 50, greatest)
        for row in range(50):
            right = sorted((-sum(int(a) * int(b) for a, b in zip(x[row], w)), int(i)) for i, w in zip(ids, x) if i != ids[row])[:4]
            assert [(-int(s), int(i)) for s, i in zip(scores[q == row], found[q == row])] == right
