import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from rastertables.llm import spelling_variants as variants

from .helpers import empty, frame, odd_rows, prose


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute(rows, min_chars=5, min_count=3, lead=2):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(variants.UPPER, variants.LOWER))
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= min_chars and n >= min_count}
    beside = {w: [v for v in words if abs(len(v) - len(w)) < 2 and near(v, w)] for w in words}
    form = {}
    for w, own in beside.items():
        best = min(own, key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= lead * words[w]:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(beside[w]), words[form[w]] if w in form else None))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def misspelt():
    """Many short words over few letters, with frequencies that make chains of forms."""
    rng = np.random.default_rng(3)
    stems = ["".join(rng.choice(list("abÀÿ"), size=rng.integers(5, 8))) for _ in range(40)]
    rows = []
    for doc in range(120):
        words = []
        for _ in range(60):
            w = stems[int(rng.zipf(1.5)) % len(stems)]
            if rng.random() < 0.4:
                k = rng.integers(len(w))
                w = w[:k] + rng.choice(["", "a", "b", "é"]) + w[k + rng.integers(2):]
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((doc, " 1,".join(words)))
    return rows


@pytest.mark.parametrize("segment_words", [7, 4096])
def test_equals_brute_force(spark, segment_words):
    rows = misspelt()
    assert len(brute(rows)) > 150
    assert got(variants.spelling_groups(frame(spark, rows), segment_words=segment_words)) == brute(rows)


def test_odd_rows(spark):
    words = "abcde " * 9 + "abcdf " * 4 + "bcdf×÷ " * 3 + "abcd " * 9 + "z" * 300 + " " + "z" * 301 + " "
    rows = [*odd_rows(), (20, words), (20, words), (None, words), (21, words + "y" * 70_000)]
    assert got(variants.spelling_groups(frame(spark, rows))) == brute(rows)


def test_empty_table(spark):
    assert variants.spelling_groups(empty(spark)).count() == 0
    assert variants.spelling_groups(frame(spark, [(1, None), (2, "one two")])).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 7), st.booleans(), st.integers(0, 7), st.integers(0, 10**6))
def test_walk_equals_all_pairs(m, longer, start, seed):
    rng, start = np.random.default_rng(seed), min(start, m)
    made = lambda n, size: np.unique(rng.integers(97, 97 + rng.integers(2, 4), (n, size), dtype=np.uint8), axis=0)
    queries, words = made(30, m), made(50, m + longer)
    i, j = variants.walk(queries, words, start)
    wanted = [(x, y) for x, q in enumerate(queries) for y, w in enumerate(words) if near(bytes(q), bytes(w)) and bytes(q[:start]) == bytes(w[:start])]
    assert sorted(zip(i.tolist(), j.tolist())) == wanted


@settings(max_examples=200, deadline=None)
@given(st.text("ab", min_size=5, max_size=8), st.text("ab", min_size=5, max_size=9), st.integers(0, 8), st.integers(0, 8))
def test_segments_that_hold_near_words_meet(a, b, i, j):
    if len(b) - len(a) in (0, 1) and near(a, b):
        assert variants.may_meet(a[:i].encode(), b[:j].encode(), len(b) > len(a))


def test_walk_skips_ranges():
    """Rows of the edit matrix are computed for few of the prefixes."""
    rng = np.random.default_rng(1)
    words = np.unique(rng.integers(97, 123, (4000, 8), dtype=np.uint8), axis=0)
    looked = []
    whole = variants.ragged
    variants.ragged = lambda starts, lengths: looked.append(int(lengths.sum()) + len(lengths)) or whole(starts, lengths)
    try:
        variants.walk(words, words, 4)
    finally:
        variants.ragged = whole
    assert sum(looked) < 10 * len(words)


def test_chains_end(spark):
    pairs = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 5), (8, 9), (20, 21)]
    ends = variants.roots(spark.createDataFrame(pairs, "id long, form long"))
    assert sorted(map(tuple, ends.collect())) == [(1, 5), (2, 5), (3, 5), (4, 5), (8, 5), (9, 5), (20, 21)]


def test_prose_is_not_capped(spark):
    rows = [(i, prose(i % 7, 300)) for i in range(40)]
    assert got(variants.spelling_groups(frame(spark, rows), segment_words=64)) == brute(rows)
