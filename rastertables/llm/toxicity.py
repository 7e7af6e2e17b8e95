"""Toxicity by logistic regression with FTRL-proximal updates over hashed word features.

Features are words, word pairs and skip-grams (two words with one between them), in lower case and
without closing punctuation, hashed to 2**20 places; a feature counts once in a document. Every
coordinate has its own learning rate, and the L1 term leaves most weights at exactly zero, so the
model is a short list of places and weights. It is fitted in one pass order on a bounded sample; scoring
is one pass over whole texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..shipping import ship_package
from .common import crc_bucket, labelled_sample, text_score, texts
from .words import Words, mix, word_slices

#: At most so many labelled documents are used for fitting.
SAMPLE_ROWS = 24_000
PLACE_BITS = 20
MINI_BATCH, EPOCHS = 32, 4

_CLOSING = np.zeros(256, bool)
_CLOSING[list(b".,;:!?\"')]}#$%&*|")] = True
_PAIR, _SKIP = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def word_features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of every word, pair and skip-gram, with repetitions."""
    ends = words.ends.copy()
    for _ in range(4):
        ends -= _CLOSING[words.data[ends - 1]] & (ends - 1 > words.starts)
    trimmed = Words(words.data, words.starts, ends, words.rows)
    h, row = trimmed.hashes(lower=True), words.row_of()
    rows, codes = [row], [h]
    for gap, salt in ((1, _PAIR), (2, _SKIP)):
        together = np.flatnonzero(row[gap:] == row[:-gap]) if len(row) > gap else np.zeros(0, np.int64)
        rows.append(row[together])
        codes.append(mix(h[together] * salt + h[together + gap]))
    return np.concatenate(rows), (np.concatenate(codes) >> np.uint64(64 - PLACE_BITS)).astype(np.int32)


def distinct_features(row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.unique(row.astype(np.int64) << PLACE_BITS | place)
    return pairs >> PLACE_BITS, (pairs & (1 << PLACE_BITS) - 1).astype(np.int32)


@dataclass
class SparseModel:
    """Places in ascending order with their weights other than zero; bias of every score."""

    places: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        dense = np.zeros(1 << PLACE_BITS, np.float32)
        dense[self.places] = self.weights
        return dense


class FtrlProximal:
    """Per-coordinate FTRL-proximal state of a logistic regression; updated by small batches."""

    def __init__(self, alpha: float = 1.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << PLACE_BITS), np.zeros(1 << PLACE_BITS)
        self.bias_z, self.bias_n = 0.0, 0.0

    def weights(self, places: np.ndarray) -> np.ndarray:
        z = self.z[places]
        rate = (self.beta + np.sqrt(self.n[places])) / self.alpha + self.l2
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / rate)

    def bias(self) -> float:
        return -self.bias_z / ((self.beta + np.sqrt(self.bias_n)) / self.alpha)

    def update(self, row: np.ndarray, place: np.ndarray, y: np.ndarray) -> None:
        """One step on a batch: `row` and `place` are its documents' distinct features."""
        places, at = np.unique(place, return_inverse=True)
        w, bias = self.weights(places), self.bias()
        error = 1 / (1 + np.exp(-(np.bincount(row, w[at], len(y)) + bias))) - y
        g = np.bincount(at, error[row], len(places))
        n = self.n[places]
        squares = np.bincount(at, error[row] ** 2, len(places))
        self.z[places] += g - (np.sqrt(n + squares) - np.sqrt(n)) / self.alpha * w
        self.n[places] = n + squares
        g, squares = error.sum(), (error**2).sum()
        self.bias_z += g - (np.sqrt(self.bias_n + squares) - np.sqrt(self.bias_n)) / self.alpha * bias
        self.bias_n += squares

    def sparse(self) -> SparseModel:
        used = np.flatnonzero(np.abs(self.z) > self.l1)
        return SparseModel(used.astype(np.int32), self.weights(used).astype(np.float32), float(self.bias()))


def fit(columns: Iterator[tuple[pa.Array, np.ndarray]], epochs: int = EPOCHS) -> SparseModel:
    """Model of labelled texts given in chunks; the features of all of them are held."""
    batches = []
    for text, y in columns:
        for low, high, words in word_slices(text):
            row, place = distinct_features(*word_features(words))
            for start in range(0, high - low, MINI_BATCH):
                part = slice(*np.searchsorted(row, [start, start + MINI_BATCH]))
                batches.append(((row[part] - start).astype(np.uint8), place[part], y[low + start:min(high, low + start + MINI_BATCH)]))
    learner = FtrlProximal()
    for _ in range(epochs):
        for batch in batches:
            learner.update(*batch)
    return learner.sparse()


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, rows: int = SAMPLE_ROWS) -> SparseModel:
    """Model from labelled documents whose id's CRC-32 modulo `folds` is not `held_out`.

    The sample, at most `rows` documents shuffled by a hash of their id, is one task's work; the
    weights that are not zero come back.
    """
    usable = crc_bucket("doc_id", folds) != held_out
    sample = labelled_sample(docs, labels, "toxic", usable, rows)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["place", "doc_id", "text"])
        chunks = [frame[i:i + 1000] for i in range(0, len(frame), 1000)]
        model = fit((pa.array(c["text"], pa.large_string()), c["y"].to_numpy(float)) for c in chunks)
        return pd.DataFrame({"place": np.append(model.places, -1), "weight": np.append(model.weights, model.bias)})

    ship_package(docs.sparkSession)
    ordered = sample.withColumn("place", F.xxhash64("doc_id"))
    fitted = ordered.groupBy().applyInPandas(run, "place int, weight double").toPandas()
    fitted = fitted.sort_values("place")
    bias = float(fitted["weight"].iloc[0]) if len(fitted) else 0.0
    return SparseModel(fitted["place"].to_numpy()[1:], fitted["weight"].to_numpy()[1:], bias)


def score(docs: DataFrame, model: SparseModel, threshold: float = 0.7) -> DataFrame:
    """All columns of docs and (score, predicted); columns of these names are replaced.

    A null or empty text has the score of the bias alone. `predicted` is 1 from the threshold.
    """
    table: list[np.ndarray] = []

    def run(text: pa.Array) -> pa.Array:
        if not table:
            table.append(model.table())
        total = np.full(len(text), model.bias)
        for low, high, words in word_slices(text):
            row, place = word_features(words)
            found = np.flatnonzero(table[0][place])
            row, place = distinct_features(row[found], place[found])
            total[low:high] += np.bincount(row, table[0][place], high - low)
        return pa.array(1 / (1 + np.exp(-total)))

    return docs.withColumn("score", text_score(docs.sparkSession, run)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    model = train(docs, labels)
    return score(texts(docs), model, threshold).select("doc_id", (crc_bucket("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
