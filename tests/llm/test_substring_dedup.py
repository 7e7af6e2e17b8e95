import random
import re

from rastertables.llm import substring_dedup

from .helpers import empty, frame, odd_rows, prose
from .test_words import morse

WORD = re.compile("[^\x20\x09-\x0D]+")


def brute(rows, window):
    least = {}
    split = [(d, WORD.findall(t or "")) for d, t in rows]
    for doc, words in split:
        for i in range(len(words) - window + 1):
            if doc is not None:
                key = tuple(words[i:i + window])
                least[key] = min(doc, least.get(key, doc))
    out = []
    for doc, words in split:
        covered = [False] * len(words)
        for i in range(len(words) - window + 1):
            if doc is not None and least[tuple(words[i:i + window])] < doc:
                covered[i:i + window] = [True] * window
        out.append((doc, len(words), sum(covered), " ".join(w for w, c in zip(words, covered) if not c)))
    return sorted(out, key=str)


def passages(seed, n):
    """Documents that share passages of many lengths at any place, some within one document."""
    rnd = random.Random(seed)
    pool = [prose(100 + i, rnd.choice([20, 49, 50, 51, 60, 130])).split() for i in range(12)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rnd.randint(0, 5)):
            words += prose(1000 + i * 9 + len(words), rnd.randint(0, 40)).split() if rnd.random() < 0.5 else rnd.choice(pool)[rnd.randint(0, 3):]
        rows.append((rnd.randint(0, 10**6), rnd.choice([" ", "\n", " \t\x0b"]).join(words)))
    return rows


def test_equals_brute_force(spark):
    rows = odd_rows() + passages(1, 120) + [(10**7 + i, prose(100, 130)) for i in range(30)]
    got = substring_dedup.remove_repeats(frame(spark, rows)).select("doc_id", "n_words", "n_removed", "kept")
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 50)


def test_even_window_of_other_size(spark):
    rows = passages(2, 60)
    got = substring_dedup.remove_repeats(frame(spark, rows), window=20).select("doc_id", "n_words", "n_removed", "kept")
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 20)


def test_words_that_look_alike_to_weak_hashes_are_told_apart(spark):
    one, two = morse(1024)
    words = prose(7, 60).split()
    rows = [(1, " ".join([*words[:30], one, *words[31:]])), (2, " ".join([*words[:30], two, *words[31:]])), (3, " ".join([*words[:30], two, *words[31:]]))]
    got = substring_dedup.remove_repeats(frame(spark, rows)).select("doc_id", "n_words", "n_removed", "kept")
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 50)
    assert [r["n_removed"] for r in got.orderBy("doc_id").collect()] == [0, 0, 60]


def test_empty_table(spark):
    assert substring_dedup.remove_repeats(empty(spark)).count() == 0
