import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from rastertables.llm import whitening
from rastertables.llm.common import table

SCHEMA = "vec_id long, embedding array<double>, n long, x string, dim int, s string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 5, "clash", 1, None) for i, v in rows], SCHEMA)


def usable(rows):
    return [(i, np.floor(256 * np.array(v, float)).astype(object)) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]


def brute(rows, components=4):
    """{(vec_id, component): (n, deviation, whitened up to a sign, explained)} of vectors of one length."""
    held = [(i, [int(c) for c in x]) for i, x in usable(rows)]
    fit = sorted({tuple(x) for _, x in held})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    mean = np.array([s / n for s in sums])
    away = np.array(fit, float) - mean
    v = away.T @ away / n
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values)[:components]
    out = {}
    for i, x in held:
        for k, at in enumerate(order):
            score = (np.array(x, float) - mean) @ vectors[:, at]
            scaled = score / math.sqrt(values[at]) if values[at] > 1e-9 * max(1.0, values.max()) else None
            out.setdefault((i, k + 1), []).append((n, sum((n * a - s) ** 2 for a, s in zip(x, sums)), scaled, values[at] / v.trace() if v.trace() else None))
    return out


def same(df, expected, part=lambda vec_id: 0):
    got = {}
    for r in df.collect():
        got.setdefault((r["vec_id"], r["component"]), []).append(r)
        assert r["identity_error"] <= 1e-9
    assert set(got) == set(expected)
    signs = {}
    for key, rows in got.items():
        wanted = expected[key]
        assert len(rows) == len(wanted)
        order = lambda t: (t[1], abs(t[2] or 0))
        for r, (n, deviation, scaled, explained) in zip(sorted(rows, key=lambda r: (r["deviation"], abs(r["whitened"] or 0))), sorted(wanted, key=order)):
            assert (r["n"], r["deviation"]) == (n, deviation)
            assert r["explained"] == (pytest.approx(explained, rel=1e-9, abs=1e-12) if explained is not None else None)
            if scaled is None:
                assert r["whitened"] is None
            else:
                if abs(scaled) > 1e-3:
                    assert signs.setdefault((key[1], part(key[0])), np.sign(scaled * r["whitened"])) == np.sign(scaled * r["whitened"])
                assert abs(r["whitened"]) == pytest.approx(abs(scaled), rel=1e-6, abs=1e-6)


def test_equals_brute_force_on_the_table(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    same(whitening.whiten(vectors), brute([(r["vec_id"], r["embedding"]) for r in vectors.collect()]))


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, list(map(float, v))) for i, v in enumerate(rng.normal(size=(60, 6)) * [5, 3, 2, 1, 0.5, 0.1])]
    rows += [(i + 100, rows[3][1]) for i in range(30)] + [(3, rows[3][1]), (None, rows[4][1]), (None, None)]
    rows += [(200, None), (201, []), (202, [None] * 6), (203, [math.nan] * 6), (204, [math.inf] + [0.0] * 5), (205, [0.0] * 5 + [None])]
    same(whitening.whiten(frame(spark, rows)), brute(rows))


def test_lengths_are_fitted_apart(spark):
    rng = np.random.default_rng(2)
    parts = [[(100 * d + i, list(map(float, rng.normal(size=d)))) for i in range(20)] for d in (1, 3, 8)]
    expected = {}
    for part in parts:
        expected |= brute(part)
    same(whitening.whiten(frame(spark, sum(parts, []))), expected, lambda vec_id: vec_id // 100)


def test_many_lengths_take_more_passes(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MODEL_BYTES", 64 * 10)
    rows = [(10 * d + i, [float(i == k) for k in range(d)]) for d in range(1, 9) for i in range(3)]
    expected = {}
    for d in range(1, 9):
        expected |= brute([r for r in rows if len(r[1]) == d])
    got = whitening.whiten(frame(spark, rows)).collect()
    assert sorted((r["vec_id"], r["component"], r["deviation"]) for r in got) == sorted((*key, v[0][1]) for key, v in expected.items())


def test_without_variance(spark):
    got = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"]) for r in sorted(got)] == [
        (i, k, 1, 0, None, None) for i in (1, 2) for k in (1, 2)]
    flat = whitening.whiten(frame(spark, [(1, [1.0, 2.0, 0.0]), (2, [3.0, 2.0, 0.0])])).collect()
    assert sorted((r["vec_id"], r["component"], None if r["whitened"] is None else round(abs(r["whitened"]), 9)) for r in flat) == [
        (1, 1, 1.0), (1, 2, None), (1, 3, None), (2, 1, 1.0), (2, 2, None), (2, 3, None)]


def test_empty_and_huge(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, None)])).count() == 0
    huge = whitening.whiten(frame(spark, [(1, [1e12, 0.0]), (2, [-1e12, 1.0]), (3, [1e300, 0.0])])).collect()
    assert {r["vec_id"] for r in huge} == {1, 2} and {r["deviation"] for r in huge} == {None}
    assert whitening.deviations(np.array([[3, -1]]), 2, [1, 1]) == [34]
    assert whitening.deviations(np.array([[2**40, 0]]), 3, [2**35, 0]) == [None]
    assert whitening.deviations(np.array([[1 << 30, 0]]), 2, [2**30, 5]) == [2**60 + 25]


def symmetric(values, seed):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    return q @ np.diag(values) @ q.T


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 6), st.integers(0, 10**6), st.floats(1e-6, 1e9))
def test_feast_finds_the_leading_pairs(n, wanted, seed, scale):
    v = symmetric(np.random.default_rng(seed).random(n) * scale, seed)
    values, vectors = whitening.feast(v, wanted)
    assert np.allclose(values, np.sort(np.linalg.eigvalsh(v))[::-1][:wanted], rtol=1e-10, atol=1e-12 * scale)
    assert np.abs(v @ vectors.T - vectors.T * values).max() <= 1e-10 * scale
    assert np.allclose(vectors @ vectors.T, np.eye(len(values)), atol=1e-10)


@pytest.mark.parametrize("values", [
    [3, 3, 3, 3, 3, 3, 1, 1], [5, 4, 3, 2, 2, 2, 2, 1], [1, 0, 0, 0, 0, 0, 0, 0], [2, 2 - 1e-9, 2 - 2e-9, 1, 1 - 1e-9, 0.5, 0.1, 0], [7] * 8,
    [1e9, 1, 1e-3, 1e-6, 0, 0, 0, 0]])
def test_feast_with_repeated_and_close_eigenvalues(values):
    v = symmetric(np.array(values, float), 5)
    got, vectors = whitening.feast(v, 4)
    assert np.allclose(got, sorted(values, reverse=True)[:4], rtol=1e-9, atol=1e-12 * max(values))
    assert np.allclose(vectors @ vectors.T, np.eye(4), atol=1e-9)
    assert np.abs(v @ vectors.T - vectors.T * got).max() <= 1e-9 * max(values)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 20), st.integers(0, 10**6), st.floats(-0.2, 1.2))
def test_inertia_counts_eigenvalues(n, seed, s):
    v = symmetric(np.random.default_rng(seed).random(n), seed)
    diagonal, off = whitening.tridiagonal(v)
    assert whitening.count_above(diagonal, off, s) == int((np.linalg.eigvalsh(v) > s).sum())
