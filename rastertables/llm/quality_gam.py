"""Document quality by a generalised additive model with pairwise interactions.

Each text is described by some twenty numbers (shares of character classes, word lengths, repetition).
Features are cut into quantile bins. Cyclic boosting visits one feature after the other and adds a small
tree over its bins, so that every feature ends as a look-up table; then the pairs with the largest
remaining gain get two-dimensional tables the same way. A score is the logistic function of the
looked-up values' sum. The model is fitted on a bounded sample; scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import arrow_pass, crc_bucket, labelled_sample, text_score, texts
from .words import Words, split_words, text_buffer, row_slices

#: At most so many labelled documents are used for fitting.
SAMPLE_ROWS = 20_000
BINS, ROUNDS, PAIRS, RATE = 32, 150, 6, 0.15

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789",
    "stop": b".,;:", "shout": b"!?", "symbol": b"#$%&*+=<>@^_~/\\", "bar": b"|", "line": b"\n", "wide": bytes(range(128, 256)),
}
FEATURES = (
    *(f"{name}_share" for name in _CLASSES), "log_words", "mean_length", "length_spread", "short_share", "long_share",
    "capital_share", "distinct_share", "top_share", "repeated_pairs", "adjacent_repeats", "words_per_line",
)


def _grouped(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of a word-level array over each row."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[rows[1:]] - total[rows[:-1]]


def _distinct(row: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of different values of each row, and the count of its commonest."""
    order = np.lexsort((hashes, row))
    r, h = row[order], hashes[order]
    first = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (h[1:] != h[:-1])])) if len(r) else np.zeros(0, np.int64)
    counts, most = np.diff(np.append(first, len(r))), np.zeros(n, np.int64)
    np.maximum.at(most, r[first], counts)
    return np.bincount(r[first], minlength=n), most


def _describe(words: Words, offsets: np.ndarray) -> np.ndarray:
    n, data, rows = len(offsets) - 1, words.data, words.rows
    size = np.maximum(np.diff(offsets), 1)
    columns = []
    for members in _CLASSES.values():
        chosen = np.zeros(256, np.int64)
        chosen[list(members)] = 1
        columns.append(_grouped(chosen[data], offsets) / size)
    count = np.diff(rows)
    some = np.maximum(count, 1)
    length = words.ends - words.starts
    mean = _grouped(length, rows) / some
    hashes, row = words.hashes(), words.row_of()
    kinds, most = _distinct(row, hashes, n)
    firsts, pairs = words.windows(hashes, 2)
    pair_kinds, _ = _distinct(row[firsts], pairs, n)
    repeats = np.zeros(len(words), np.int64)
    repeats[firsts] = hashes[firsts] == hashes[firsts + 1]
    head = data[words.starts]
    columns += [
        np.log1p(count), mean, np.sqrt(np.maximum(_grouped(length * length, rows) / some - mean * mean, 0)),
        _grouped(length <= 3, rows) / some, _grouped(length > 12, rows) / some, _grouped((head >= 65) & (head <= 90), rows) / some,
        kinds / some, most / some, 1 - pair_kinds / np.maximum(count - 1, 1), _grouped(repeats, rows) / some,
        count / (columns[list(_CLASSES).index("line")] * size + 1),
    ]
    return np.stack(columns, 1)


def features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text, over the whole text; a null text is empty."""
    data, offsets = text_buffer(column)
    parts = [np.zeros((0, len(FEATURES)))]
    for low, high in row_slices(offsets):
        own = offsets[low:high + 1] - offsets[low]
        parts.append(_describe(split_words(data[offsets[low]:offsets[high]], own), own))
    return np.concatenate(parts)


@dataclass
class AdditiveModel:
    """Bin edges, a table of values for each feature, and tables for some pairs."""

    edges: list[np.ndarray]
    base: float
    tables: np.ndarray
    pairs: list[tuple[int, int, np.ndarray]]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], "right") for i, e in enumerate(self.edges)], 1)

    def decision(self, bins: np.ndarray) -> np.ndarray:
        total = self.base + self.tables[np.arange(bins.shape[1]), bins].sum(1)
        for i, j, values in self.pairs:
            total += values[bins[:, i], bins[:, j]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.decision(self.bins(x))))


def _best_cut(g: np.ndarray, h: np.ndarray, smooth: float = 1.0) -> tuple[float, int]:
    """Gain and place of the best cut of ordered bins by their gradient and curvature sums."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = left_g**2 / (left_h + smooth) + right_g**2 / (right_h + smooth) - g.sum() ** 2 / (h.sum() + smooth)
    gain[(left_h < 0.5) | (right_h < 0.5)] = -1
    best = int(gain.argmax()) if len(gain) else -1
    return (float(gain[best]), best + 1) if best >= 0 else (-1.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Values over ordered bins of a tree of the given depth."""
    gain, cut = _best_cut(g, h) if depth else (-1.0, 0)
    if gain <= 1e-6:
        return np.full(len(g), g.sum() / (h.sum() + 1.0))
    return np.concatenate([_tree(g[:cut], h[:cut], depth - 1), _tree(g[cut:], h[cut:], depth - 1)])


def _cut_scores(g: np.ndarray, h: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """For each row of bins the best sum of G^2 / H over the two sides of a cut."""
    left_g, left_h = np.cumsum(g, 1), np.cumsum(h, 1)
    right_g, right_h = left_g[:, -1:] - left_g, left_h[:, -1:] - left_h
    return (left_g**2 / (left_h + smooth) + right_g**2 / (right_h + smooth)).max(1)


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut along one axis with a cut along the other axis on either side; gain and values."""
    best = (-np.inf, 0, False)
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        top_g, top_h = np.cumsum(a, 0)[:-1], np.cumsum(b, 0)[:-1]
        scores = _cut_scores(top_g, top_h) + _cut_scores(a.sum(0) - top_g, b.sum(0) - top_h)
        best = max(best, (float(scores.max()), int(scores.argmax()) + 1, turned))
    score, cut, turned = best
    a, b = (g.T, h.T) if turned else (g, h)
    values = np.vstack([np.tile(_tree(a[s].sum(0), b[s].sum(0), 1), (a[s].shape[0], 1)) for s in (slice(0, cut), slice(cut, None))])
    return score - float(g.sum() ** 2 / (h.sum() + 1.0)), values.T if turned else values


def fit(x: np.ndarray, y: np.ndarray, bins: int = BINS, rounds: int = ROUNDS, pairs: int = PAIRS, rate: float = RATE) -> AdditiveModel:
    """Cyclic boosting of feature tables, then of the strongest pairs' tables.

    Without rows, or with one class only, every score is near the smoothed share of that class.
    """
    n, k = x.shape[0], len(FEATURES)
    edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for i in range(k)]
    share = (y.sum() + 0.5) / (n + 1)
    model = AdditiveModel(edges, float(np.log(share / (1 - share))), np.zeros((k, bins)), [])
    if not 0 < y.sum() < n:
        return model
    b = model.bins(x)
    total = np.full(n, model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for i in range(k):
            used = len(edges[i]) + 1
            g, h = (np.bincount(b[:, i], v, used) for v in slopes())
            step = rate * _tree(g, h)
            model.tables[i, :used] += step
            total += step[b[:, i]]
    cells = [b[:, i] * bins + b[:, j] for i in range(k) for j in range(i)]
    names = [(i, j) for i in range(k) for j in range(i)]
    slope = slopes()
    gains = [_pair_tree(*(np.bincount(c, v, bins * bins).reshape(bins, bins) for v in slope))[0] for c in cells]
    chosen = np.argsort(gains)[::-1][:pairs]
    model.pairs = [(*names[c], np.zeros((bins, bins))) for c in chosen]
    for _ in range(rounds // 3):
        for c, (_, _, values) in zip(chosen, model.pairs):
            _, step = _pair_tree(*(np.bincount(cells[c], v, bins * bins).reshape(bins, bins) for v in slopes()))
            values += rate * step
            total += rate * step.ravel()[cells[c]]
    return model


def _with_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = features(batch["text"])
        yield pa.RecordBatch.from_arrays([batch["y"], *(pa.array(c) for c in x.T)], ["y", *FEATURES])


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, rows: int = SAMPLE_ROWS) -> AdditiveModel:
    """Model from labelled documents whose id's CRC-32 modulo `folds` is not `held_out`.

    Only features and labels of at most `rows` documents come to the driver.
    """
    usable = crc_bucket("doc_id", folds) != held_out
    sample = labelled_sample(docs, labels, "quality", usable, rows)
    frame = arrow_pass(sample.select("text", "y"), _with_features, "y int, " + ", ".join(f"{f} double" for f in FEATURES)).toPandas()
    frame = frame.sort_values(list(frame.columns))  # the order of rows must not matter
    return fit(frame[list(FEATURES)].to_numpy(float), frame["y"].to_numpy(float))


def score(docs: DataFrame, model: AdditiveModel, threshold: float = 0.3) -> DataFrame:
    """All columns of docs and (score, predicted); columns of these names are replaced.

    Nulls count as empty texts, which are scored like any other. `predicted` is 1 from the threshold.
    """
    def run(text: pa.Array) -> pa.Array:
        return pa.array(model.score(features(text)))

    return docs.withColumn("score", text_score(docs.sparkSession, run)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    model = train(docs, labels)
    return score(texts(docs), model, threshold).select("doc_id", (crc_bucket("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
