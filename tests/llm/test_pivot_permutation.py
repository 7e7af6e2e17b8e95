import math

import numpy as np
import pandas as pd
import pytest

from rastertables.llm import pivot_permutation as index

SCHEMA = "vec_id long, embedding array<double>, ball long, node string, near int, dim string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 7, "clash", 1, "d") for i, v in rows], SCHEMA)


def brute(rows, threshold=0.9):
    """(vec_id, n_links, component_id, kept) by all pairs."""
    use = [k for k, (i, v) in enumerate(rows) if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    count, parent = [0] * len(rows), list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for length in {len(rows[k][1]) for k in use}:
        own = [k for k in use if len(rows[k][1]) == length]
        x = np.array([np.array(rows[k][1]) / max(map(abs, rows[k][1])) for k in own])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = x @ x.T >= threshold
        np.fill_diagonal(near, False)
        for a, k in enumerate(own):
            count[k] = int(near[a].sum())
            for b in np.flatnonzero(near[a]):
                parent[find(k)] = find(own[b])
    least = {}
    for k in use:
        least[find(k)] = min(least.get(find(k), rows[k][0]), rows[k][0])
    out = []
    for k, (i, _) in enumerate(rows):
        component = least[find(k)] if k in use else i
        out.append((i, count[k], component, i == component))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def groups(seed, dim=32, alone=200, sizes=(2, 2, 3, 10, 150), spread=0.1):
    """Vectors in all directions and groups around some, their cosines well above the threshold."""
    rng = np.random.default_rng(seed)
    parts = [rng.normal(size=(alone, dim))]
    for size in sizes:
        parts.append(unit(rng.normal(size=(1, dim))) + rng.normal(size=(size, dim)) * spread / np.sqrt(dim))
    x = np.concatenate(parts)
    x *= rng.random((len(x), 1)) * 3 + 0.1
    return [(int(i), list(map(float, v))) for i, v in zip(rng.permutation(len(x)) * 3, x)]


def test_groups_equal_brute_force(spark):
    rows = groups(1)
    wanted = brute(rows)
    assert max(r[1] for r in wanted) == 149
    assert got(index.embedding_links(frame(spark, rows))) == wanted


@pytest.mark.parametrize("block, leaders, group", [(16, 3, 40), (1024, 256, 1 << 16)])
def test_wide_groups_in_small_blocks(spark, monkeypatch, block, leaders, group):
    """Groups wider than a ball: balls meet in part, members are compared, links form chains."""
    monkeypatch.setattr(index, "BLOCK", block)
    monkeypatch.setattr(index, "LEADERS", leaders)
    monkeypatch.setattr(index, "GROUP_ROWS", group)
    rows = groups(2, dim=6, alone=50, sizes=(60, 90), spread=0.7)
    wanted = brute(rows)
    assert len({r[1] for r in wanted}) > 15
    assert got(index.embedding_links(frame(spark, rows), most_pivots=8)) == wanted


def test_odd_rows(spark):
    rows = groups(3, dim=8, alone=30, sizes=(5,))
    rows += [(1000 + i, rows[2][1]) for i in range(40)] + [(2000, [2.0 * c for c in rows[2][1]]), (rows[3][0], rows[3][1]), (rows[4][0], rows[5][1])]
    rows += [(None, rows[2][1]), (None, None), (3000, None), (3001, []), (3002, [0.0] * 8), (3003, [-0.0] * 8), (3004, [None] * 8), (3005, [math.nan] * 8)]
    rows += [(3006, [math.inf, *[0.0] * 7]), (3007, [1.0, 0.0]), (3008, [1.0, 0.1]), (3009, [-1.0, 0.0]), (3010, [5.0]), (3011, [-5.0]), (3012, [7.0])]
    rows += [(3013, [1e300] * 8), (3014, [1e-300] * 8), (-5, [1e300] * 7 + [9e299])]
    assert got(index.embedding_links(frame(spark, rows))) == brute(rows)


def test_empty_tables(spark):
    assert index.embedding_links(frame(spark, [])).count() == 0
    assert got(index.embedding_links(frame(spark, [(1, None), (2, [0.0])]))) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert got(index.embedding_links(frame(spark, [(4, [1.0, 2.0])]))) == [(4, 0, 4, True)]


def test_many_lengths(spark):
    rows = [(10 * d + i, [1.0 + (i == 1) * 0.01 * k for k in range(d)]) for d in range(1, 200) for i in range(3)]
    assert got(index.embedding_links(frame(spark, rows), most_pivots=16)) == brute(rows)


def test_recall_at_the_threshold(spark):
    """Pairs whose cosine is just 0.9 are the hardest."""
    rng = np.random.default_rng(5)
    u = unit(rng.normal(size=(1500, 64)))
    w = rng.normal(size=u.shape)
    w = unit(w - (w * u).sum(1, keepdims=True) * u)
    v = 0.9001 * u + math.sqrt(1 - 0.9001**2) * w
    rows = [(i, x.tolist()) for i, x in enumerate(np.concatenate([u, v]))]
    found = sum(r["n_links"] for r in index.embedding_links(frame(spark, rows)).collect())
    assert 0.99 * 3000 <= found <= 3000


def test_lists_count_shared_pivots():
    sets = [[1, 2, 3], [1, 3, 9], [1, 4, 5], [0, 1, 2]]
    made = pd.DataFrame({
        "pivot": 1, "a": 0, "b": 0, "block": 0, "ball": range(4), "pivots": [np.array(s) for s in sets], "need": 2,
        "radius": 0.0, "rough": [np.array([127, 0], np.int8).tobytes()] * 4, "scale": 127.0, "error": 0.0})
    assert sorted(map(tuple, index.list_candidates(made).to_numpy().tolist())) == [(0, 1), (0, 3)]
    apart = made.assign(rough=[np.array([127, 0] if i else [0, 127], np.int8).tobytes() for i in range(4)])
    assert len(index.list_candidates(apart)) == 0
    below = pd.concat([made, made.assign(ball=range(4, 8), pivots=[np.array([0, 1, 2, 3])] * 4)])
    assert (0, 1) in set(map(tuple, index.list_candidates(below).to_numpy().tolist()))
    assert not {(3, 4), (4, 5)} & set(map(tuple, index.list_candidates(below).to_numpy().tolist()))  # they share pivot 0, whose list has them


def test_pivots_are_not_linked(spark):
    rows = groups(6, dim=16, alone=100, sizes=(200,), spread=0.05)
    nodes = index.vector_rows(frame(spark, rows)).withColumnRenamed("vec_id", "node")
    (_, points), = index.pivots(nodes).values()
    cosines = points @ points.T
    assert len(points) > 30 and (cosines - np.eye(len(points)) < 0.9).all()
