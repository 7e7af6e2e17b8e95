import collections

import numpy as np
import pyarrow as pa

from rastertables.llm import prob_minhash as p
from rastertables.llm.components import components
from rastertables.llm.words import word_slices

from .helpers import empty, frame, odd_rows, prose
from .test_words import morse


def shingles(text):
    w = (text or "").split()
    return collections.Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def exact(x, y):
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in {*x, *y}) for i in x if i in y)


def brute(rows):
    sets = [shingles(t) if d is not None else {} for d, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and exact(sets[i], sets[j]) >= 0.8:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    out = []
    for i, (doc, _) in enumerate(rows):
        members = [rows[j][0] for j in range(len(rows)) if label[j] == label[i]]
        least = min((m for m in members if m is not None), default=None)
        out.append((doc, least, len(members), doc == least))
    return sorted(out, key=str)


def variants():
    """A base with many near copies that are less alike among themselves, and chains of copies."""
    base = prose(11, 64).split()
    rows = [(500, " ".join(base))]
    for i in range(40):
        rows.append((501 + i, " ".join([*base[:i + 5], f"new{i}", *base[i + 6:]])))
    for i in range(6):
        rows.append((600 + i, " ".join([*base[:-4 * i or None], *(f"end{i}x{k}" for k in range(4 * i))])))
    return rows + [(700, "say " * 50), (701, "say " * 90), (702, "say say"), (703, "one two"), (704, "two one")]


def test_classes_equal_brute_force(spark):
    rows = odd_rows() + variants()
    rows = [(d, t if not t or len(t) < 20_000 else t[:6000]) for d, t in rows]
    got = p.near_classes(frame(spark, rows)).select("doc_id", "class_id", "class_size", "kept")
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_words_that_look_alike_to_weak_hashes_are_told_apart(spark):
    one, two = morse(1024)
    rows = [(1, f"a b {one} c"), (2, f"a b {two} c"), (3, f"a b {two} c")]
    got = p.near_classes(frame(spark, rows)).select("doc_id", "class_id", "class_size", "kept")
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows) == [(1, 1, 1, True), (2, 2, 2, True), (3, 2, 2, False)]


def test_a_block_returns_fewer_links_than_nodes():
    rng = np.random.default_rng(1)
    for n, rows, share in ((500, 500, 1.0), (60, 20, 0.1), (60, 60, 0.02), (5, 5, 0.0), (40, 0, 1.0)):
        linked = np.triu(rng.random((n, n)) < share, 1)[:rows]
        i, j = p.spanning_forest(linked)

        def labels(pairs):
            label = np.arange(n)
            for a, b in pairs:
                label[label == label[b]] = label[a]
            return [np.flatnonzero(label == x).tolist() for x in label]

        assert len(i) < max(n, 1) and labels(zip(i, j)) == labels(zip(*np.nonzero(linked)))


def test_empty_table(spark):
    assert p.near_classes(empty(spark)).count() == 0


def test_registers_estimate_the_similarity():
    texts = [prose(1, 400), " ".join(prose(1, 400).split()[:350] + prose(2, 50).split()), "again " * 3 + prose(3, 40), prose(3, 40), "x"]
    _, _, own = next(word_slices(pa.array(texts)))
    row, code, weight = p.weighted_shingles(own)
    sign = p.signatures(row, code, weight, 5, 2000)
    assert (sign != 0).all()
    for i, j in ((0, 1), (2, 3), (0, 4)):
        true = exact(shingles(texts[i]), shingles(texts[j]))
        assert abs((sign[i] == sign[j]).mean() - true) < 0.05
        parts = [(code[row == k], weight[row == k]) for k in (i, j)]
        assert abs(p.similarity(*parts[0], *parts[1]) - true) < 1e-9


def test_early_termination_changes_nothing():
    """A signature equals the one of its row alone, whatever shares the slice."""
    texts = [prose(i, n) for i, n in enumerate((3, 30, 300, 2000))]
    for text, whole in zip(texts, _signs(texts)):
        assert (_signs([text])[0] == whole).all()


def _signs(texts):
    _, _, own = next(word_slices(pa.array(texts)))
    return p.signatures(*p.weighted_shingles(own), len(texts), 64)


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 120, (80, 2))] + [(200 + i, 201 + i) for i in range(40)] + [(7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "u long, v long")).collect()))
    label = {x: x for pair in links for x in pair}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {n: c for n, c in label.items() if n != c}
