import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rastertables.llm import quality_gam, queries, toxicity
from rastertables.llm.common import labelled_sample
from rastertables.llm.words import word_slices

from .helpers import empty, frame, odd_rows

MEDIUM = "/root/testdata/sf0.01"


def accuracy(spark, rows, label):
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    return sum(a == b for a, b in held) / len(held), len(held)


def test_quality_of_held_out_rows(spark):
    rows = queries.quality_query(spark, MEDIUM).collect()
    good, n = accuracy(spark, rows, "quality")
    assert n > 40 and good > 0.97 and len(rows) == 1000
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_toxicity_of_held_out_rows(spark):
    rows = queries.toxicity_query(spark, MEDIUM).collect()
    good, n = accuracy(spark, rows, "toxic")
    assert n > 40 and good > 0.88 and len(rows) == 1000
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_odd_rows_and_empty_tables(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, 0, 1), (None, 1, 1), (8, None, None), (12, 1, 0)], "doc_id long, quality int, toxic int")
    docs = frame(spark, odd_rows())
    for run in (quality_gam.quality_scores, toxicity.toxicity_scores):
        assert run(docs, labels).count() == len(odd_rows())
        assert run(docs, labels.limit(0)).filter("score between 0 and 1").count() == len(odd_rows())
        assert run(empty(spark), labels).count() == 0
    kept = quality_gam.score(docs, quality_gam.train(docs, labels))
    assert kept.filter(F.col("text").isNull()).count() == 2 and "lang" in kept.columns


def test_features_match_a_plain_count():
    text = "The the cat, sat!\nOn 12 MATS | é the the"
    x = dict(zip(quality_gam.FEATURES, quality_gam.features(pa.array([None, text]))[1]))
    words, size = text.split(), len(text.encode())
    assert abs(x["upper_share"] - sum(c.isascii() and c.isupper() for c in text) / size) < 1e-12
    assert abs(x["mean_length"] - sum(len(w.encode()) for w in words) / len(words)) < 1e-12
    assert abs(x["distinct_share"] - len(set(words)) / len(words)) < 1e-12
    assert abs(x["adjacent_repeats"] - sum(a == b for a, b in zip(words, words[1:])) / len(words)) < 1e-12
    assert abs(x["top_share"] - 3 / len(words)) < 1e-12


def test_additive_model_learns_a_pair():
    rng = np.random.default_rng(0)
    x = np.zeros((4000, len(quality_gam.FEATURES)))
    x[:, :2] = rng.random((4000, 2))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.fit(x, y, rounds=60, pairs=1)
    assert {model.pairs[0][0], model.pairs[0][1]} == {0, 1}
    assert ((model.score(x) > 0.5) == y).mean() > 0.95


def test_word_features_are_words_pairs_and_skips():
    _, _, own = next(word_slices(pa.array(["You idiot, you.", "IDIOT you you"])))
    row, place = toxicity.word_features(own)
    assert len(row) == 6 + 4 + 2
    first, second = place[row == 0], place[row == 1]
    assert first[1] == second[0] and len(set(first) & set(second)) == 3  # idiot, you, (idiot you)


def test_ftrl_is_sparse_and_separates():
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["aa", "bb", "cc", "dd", "ee"], 12)) + (" scum" if i % 4 == 0 else "") for i in range(400)]
    y = np.array([i % 4 == 0 for i in range(400)], float)
    model = toxicity.fit([(pa.array(texts), y)])
    assert 0 < len(model.places) < 200
    _, place = toxicity.word_features(next(word_slices(pa.array(["scum"])))[2])
    assert model.table()[place[0]] > 1


def test_the_sample_keeps_its_bounds(spark):
    """Repeated ids, in documents and labels, and long texts don't widen the sample."""
    docs = spark.createDataFrame([(n % 20, f"text {n} " + "x" * (n % 20) * 10) for n in range(4000)], "doc_id long, text string")
    labels = spark.createDataFrame([(n % 20, n % 2) for n in range(400)], "doc_id long, quality int")
    few = labelled_sample(docs, labels, "quality", F.lit(True), 2).collect()
    assert len(few) == 2
    some = labelled_sample(docs, labels, "quality", F.lit(True), 100, size=500).collect()
    assert 1 < len(some) < 20 and sum(len(r["text"]) for r in some) <= 500 and len({r["doc_id"] for r in some}) == len(some)
    assert len(labelled_sample(docs, labels, "quality", F.lit(True), 100).collect()) == 20
    assert labelled_sample(docs.limit(0), labels, "quality", F.lit(True), 100).count() == 0
