"""Repeated passages by fixed-block anchors.

A window of 50 words contains at least one whole block of 25 words whose place is a multiple of 25. So:

1. the index holds the hash of every such block of every document;
2. every rolling window of 25 words probes it: what another document's block answers is an anchor;
3. around each anchor the 50-word windows that contain it are compared by 96 bits of hash, and a window
   that also starts in a document with a smaller id is repeated. The union of a document's repeated
   windows is its maximal exact repeats.

Probes first pass a bit filter of a fixed size made from the index, so that few of them travel; what the
filter lets through in error finds no partner later. At any size of input the result is the same: a
fuller filter only lets more probes travel, at most one a word. Rows of one popular passage share
keys; they are combined before they travel, and the joins are ones that adaptive execution splits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..storage import BROADCAST_ROWS, materialize
from .common import arrow_pass, texts
from .words import Words, mix, word_slices

WINDOW = 50
#: Bits of the filter: 2**11 segments of 2**16; its size does not depend on the data.
SEGMENT_BITS, SEGMENTS = 16, 11


def _bits(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bit places in the filter, both in the segment of the leading bits."""
    segment = (hashes >> np.uint64(64 - SEGMENTS)) << np.uint64(SEGMENT_BITS)
    low = np.uint64((1 << SEGMENT_BITS) - 1)
    return segment | (hashes >> np.uint64(32)) & low, segment | (hashes >> np.uint64(16)) & low


def _inside(filled: np.ndarray, places: np.ndarray) -> np.ndarray:
    return filled[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8) & 1 > 0


def bit_filter(hashes: DataFrame) -> np.ndarray:
    """Filter of the column `hash`: at most 2**SEGMENTS rows of 2**SEGMENT_BITS bits come to the driver."""
    size = 1 << SEGMENT_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            values = batch["hash"].to_numpy().view(np.uint64)
            for places in _bits(values):
                places = np.unique(places)
                segments = places >> np.uint64(SEGMENT_BITS)
                for segment in np.unique(segments):
                    bits = parts.setdefault(int(segment), np.zeros(size, bool))
                    bits[places[segments == segment] & np.uint64(size - 1)] = True
        packed = [np.packbits(b, bitorder="little").tobytes() for b in parts.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array(packed, pa.binary())], ["segment", "bits"])

    dealt = hashes.select("hash", F.shiftrightunsigned("hash", 64 - SEGMENTS).alias("segment")).repartition("segment").select("hash")
    filled = np.zeros(size << SEGMENTS >> 3, np.uint8)
    for segment, bits in arrow_pass(dealt, run, "segment int, bits binary").toLocalIterator():
        at = segment * size >> 3
        filled[at:at + (size >> 3)] |= np.frombuffer(bits, np.uint8)
    return filled


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def _long_rows(batch: pa.RecordBatch, window: int) -> Iterator[tuple[Words, np.ndarray, np.ndarray]]:
    """(words, word hashes, ids) of slices; rows with fewer words than a window are left without words."""
    ids = batch["doc_id"].to_numpy(zero_copy_only=False)
    for low, high, words in word_slices(batch["text"]):
        if len(words) >= window and (np.diff(words.rows) >= window).any():
            yield words, words.hashes(), ids[low:high].astype(np.int64)


def _blocks(words: Words, hashes: np.ndarray, block: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First words, hashes, rows and alignment of all rolling blocks in rows that hold a window."""
    first, code = words.windows(hashes, block)
    row = words.row_of()[first]
    long = (np.diff(words.rows) >= window)[row]
    first, code, row = first[long], code[long], row[long]
    return first, code, row, (first - words.rows[row]) % block == 0


def anchor_index(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(hash) of the non-overlapping blocks of half a window of every document, each hash once."""
    block = window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for words, hashes, _ in _long_rows(batch, window):
                _, code, _, aligned = _blocks(words, hashes, block, window)
                found.append(code[aligned])
            yield pa.RecordBatch.from_arrays([_signed(np.unique(np.concatenate(found)))], ["hash"])

    return arrow_pass(docs, run, "hash long").distinct()


def shared_anchors(docs: DataFrame, index_filter, window: int = WINDOW) -> DataFrame:
    """(hash) of the blocks that some rolling window of a document with a larger id repeats."""
    block = window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = index_filter.value
        for batch in batches:
            parts = []
            for words, hashes, ids in _long_rows(batch, window):
                _, code, row, aligned = _blocks(words, hashes, block, window)
                one, two = _bits(code)
                passed = np.flatnonzero(_inside(filled, one))
                passed = passed[_inside(filled, two[passed])]
                parts.append((code[passed], ids[row[passed]], aligned[passed]))
            code, ids, aligned = map(np.concatenate, zip(*parts)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool))
            # of equal blocks of a batch only the smallest indexed and the largest probing id count
            order = np.lexsort((ids, code))
            code, ids, aligned = code[order], ids[order], aligned[order]
            heads = np.flatnonzero(np.diff(code, prepend=~code[:1]) != 0) if len(code) else np.zeros(0, np.int64)
            most = np.iinfo(np.int64).max
            low = np.minimum.reduceat(np.where(aligned, ids, most), heads) if len(heads) else np.zeros(0, np.int64)
            high = np.maximum.reduceat(ids, heads) if len(heads) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([_signed(code[heads]), pa.array(low, mask=low == most), pa.array(high)], ["hash", "low", "high"])

    met = arrow_pass(docs, run, "hash long, low long, high long")
    return met.groupBy("hash").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low < high").select("hash")


def anchored_windows(docs: DataFrame, shared_filter, window: int = WINDOW) -> DataFrame:
    """(hash, tail, doc_id) of all windows that contain an anchor.

    `tail` has 32 further bits of hash above the window's first word in its document.
    """
    block = window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = shared_filter.value
        for batch in batches:
            for words, hashes, ids in _long_rows(batch, window):
                first, code, _, _ = _blocks(words, hashes, block, window)
                one, two = _bits(code)
                passed = np.flatnonzero(_inside(filled, one))
                first = first[passed[_inside(filled, two[passed])]]
                if not len(first):
                    continue
                starts, code, tail = _window_codes(words, hashes, window)
                # a window of this start holds a block that begins between it and window - block later
                before = np.concatenate([[0], np.cumsum(np.bincount(first, minlength=len(words)))])
                chosen = before[starts + window - block + 1] > before[starts]
                row = words.row_of()[starts[chosen]]
                yield pa.RecordBatch.from_arrays([_signed(code[chosen]), _signed(tail[chosen]), pa.array(ids[row])], ["hash", "tail", "doc_id"])

    return arrow_pass(docs, run, "hash long, tail long, doc_id long")


def _window_codes(words: Words, hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, code = words.windows(hashes, window)
    _, other = words.windows(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), window)
    place = (starts - words.rows[words.row_of()[starts]]).astype(np.uint64)
    return starts, code, other >> np.uint64(32) << np.uint64(32) | place


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, tails): for each document with repeated windows the `tail`s of all of them.

    A window is repeated if its words also start in a document with a smaller id. Rows with a null id
    neither repeat nor are repeated.
    """
    spark = docs.sparkSession
    rows = texts(docs).filter("doc_id is not null")
    index = spark.sparkContext.broadcast(bit_filter(anchor_index(rows, window)))
    shared = spark.sparkContext.broadcast(bit_filter(shared_anchors(rows, index, window)))
    windows = anchored_windows(rows, shared, window).withColumn("more", F.shiftright("tail", 32).cast("int"))
    firsts = windows.groupBy("hash", "more").agg(F.min("doc_id").alias("first"))
    found = windows.join(firsts, ["hash", "more"]).filter("doc_id > first")
    return found.groupBy("doc_id").agg(F.collect_list("tail").alias("tails"))


def _with_tails(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """Rows with their `tails`, or null.

    While the ids of documents with repeats can be broadcast, only these documents' texts are shuffled;
    beyond that all are.
    """
    ids = repeated.select("doc_id")
    if ids.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return rows.join(repeated, "doc_id", "left")
    few = F.broadcast(ids)
    return rows.join(few, "doc_id", "left_semi").join(repeated, "doc_id").unionByName(
        rows.join(few, "doc_id", "left_anti").withColumn("tails", F.lit(None).cast("array<long>")))


def _keep(text: str, tails: np.ndarray | None, window: int) -> tuple[int, list[bytes]]:
    """Number of words, and the words that stay."""
    words = text.encode().split()  # at the six bytes that separate words
    if tails is None:
        return len(words), words
    covered = np.zeros(len(words) + 1, np.int64)
    for _, _, own in word_slices(pa.array([text], pa.large_string())):
        _, _, mine = _window_codes(own, own.hashes(), window)
        starts = (mine[np.isin(mine, tails)] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        np.add.at(covered, starts, 1)
        np.add.at(covered, starts + window, -1)
    return len(words), list(compress(words, (np.cumsum(covered)[:-1] == 0).tolist()))


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row; `kept` joins the words that stay by a space.

    Every word in a repeated window goes, whatever goes elsewhere. Null texts have no words. Rows that
    share a doc_id do not remove one another's words.
    """
    marked = _with_tails(texts(docs), materialize(repeated_windows(docs, window), "repeated-windows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, kept = [], [], []
            for text, tails in zip(batch["text"], batch["tails"]):
                n, words = _keep(text.as_py(), tails.values.to_numpy().view(np.uint64) if tails.is_valid else None, window)
                counts.append(n)
                removed.append(n - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return arrow_pass(marked, run, "doc_id long, n_words long, n_removed long, kept string")
