"""Exact duplicates by an extendible-hash index on shared files.

The 64-bit hash of a text is its key. The directory has 2**g slots for the leading g bits; each slot
names a bucket, which is a range of keys. A bucket of more than `capacity` bytes is split by its next
bit, and the directory doubles when that bit is not yet one of its own. Texts of one bucket go to one
owner task, sorted by key; texts with equal keys are chained and compared byte by byte. The owners
write the index to the shared folder; every document then looks its own text up.

Copies are combined by the task that reads them and again by the owner, so a text that fills a third of
the rows reaches its owner once a batch and is never held twice. Rows of a hot text meet their one
index row in an ordinary join, which adaptive execution splits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..storage import materialize
from .common import arrow_pass, texts

BUCKET_BYTES = 1 << 20
#: Bounds the directory to 2**16 slots; a bucket at this depth may exceed the capacity, it is streamed.
MAX_DEPTH = 16


def split_buckets(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Directory for the bytes found under each slot of the deepest directory.

    Returns the bucket number of each of 2**g slots, with g as small as the splits allow.
    """
    deepest = (len(sizes) - 1).bit_length()
    below = np.concatenate([[0], np.cumsum(sizes)])
    directory, depth = np.zeros(1, np.int32), 0
    buckets, open_buckets = [(0, 0)], [0]
    while open_buckets:
        bucket = open_buckets.pop()
        low, local = buckets[bucket]
        width = 1 << (deepest - local)
        if local == deepest or below[low + width] - below[low] <= capacity:
            continue
        if local == depth:
            directory, depth = np.repeat(directory, 2), depth + 1
        middle, scale = low + width // 2, deepest - depth
        buckets[bucket] = (low, local + 1)
        buckets.append((middle, local + 1))
        directory[middle >> scale:(low + width) >> scale] = len(buckets) - 1
        open_buckets += [bucket, len(buckets) - 1]
    return directory


def _slot(depth: int):
    return F.shiftrightunsigned(F.xxhash64("text"), 64 - depth).cast("int") if depth else F.lit(0)


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One entry for each different text of a batch."""
    for batch in batches:
        entries = pa.Table.from_batches([batch]).group_by(["key", "slot", "text"]).aggregate([("doc_id", "max"), ("doc_id", "count", pc.CountOptions("all"))])
        entries = entries.select(["key", "slot", "text", "doc_id_max", "doc_id_count"]).rename_columns(["key", "slot", "text", "top", "copies"])
        yield from entries.combine_chunks().to_batches()


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index rows from a bucket's entries in key order; holds the chain of one key."""
    fields = [("bucket", pa.int32()), ("key", pa.int64()), ("chain", pa.int32()), ("text_sha256", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64())]

    def rows(done: list) -> Iterator[pa.RecordBatch]:
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*done), fields)], [n for n, _ in fields])

    def close(key, bucket, chain: list) -> list:
        return [(bucket, key, i, hashlib.sha256(text).hexdigest(), top, copies) for i, (text, top, copies) in enumerate(chain)]

    key, bucket, chain = None, None, []
    for batch in batches:
        done = []
        entries = zip(batch["bucket"].to_pylist(), batch["key"].to_pylist(), batch["text"].cast(pa.binary()), batch["top"].to_pylist(), batch["copies"].to_pylist())
        for its_bucket, its_key, text, top, copies in entries:
            if its_key != key:
                done += close(key, bucket, chain)
                key, bucket, chain = its_key, its_bucket, []
            text = text.as_py()
            for link in chain:
                if link[0] == text:
                    link[1] = top if link[1] is None else link[1] if top is None else max(link[1], top)
                    link[2] += copies
                    break
            else:
                chain.append([text, top, copies])
        yield from rows(done)
    yield from rows(close(key, bucket, chain))


def build_index(docs: DataFrame, capacity: int = BUCKET_BYTES, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Writes and returns (bucket, key, chain, text_sha256, keep_id, group_size), one row per different text.

    `keep_id` is the largest doc_id of the text's rows (null if all are null), `group_size` the
    number of its rows, `chain` its place among texts with the same key.
    """
    rows = texts(docs)
    found = (
        rows.select(F.xxhash64("text").alias("key"), _slot(max_depth).alias("slot"), F.octet_length("text").alias("size"))
        .groupBy("key", "slot").agg(F.max("size").alias("size")).groupBy("slot").agg(F.sum("size").alias("size")).collect()
    )  # at most 2**max_depth rows
    sizes = np.zeros(1 << max_depth, np.int64)
    for slot, size in found:
        sizes[slot] = size
    directory = split_buckets(sizes, capacity)
    depth = (len(directory) - 1).bit_length()
    slots = docs.sparkSession.createDataFrame(list(enumerate(directory.tolist())), "slot int, bucket int")
    entries = arrow_pass(
        rows.select("doc_id", "text", F.xxhash64("text").alias("key"), _slot(depth).alias("slot")),
        _combine, "key long, slot int, text string, top long, copies long",
    )
    owned = entries.join(F.broadcast(slots), "slot").repartition("bucket").sortWithinPartitions("bucket", "key")
    index = arrow_pass(owned.select("bucket", "key", "text", "top", "copies"), _own, "bucket int, key long, chain int, text_sha256 string, keep_id long, group_size long")
    return materialize(index, "extendible-index")


def exact_groups(docs: DataFrame, capacity: int = BUCKET_BYTES, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, bucket, chain, text_key) for every row.

    Texts are compared unchanged; null counts as empty, and empty texts form one group. The row with
    the largest doc_id stays; rows that repeat this id stay together, a null id stays only in a
    group without other ids. Other columns are not read. An empty table gives no rows.
    """
    index = build_index(docs, capacity, max_depth)
    rows = texts(docs).select("doc_id", F.xxhash64("text").alias("key"), F.sha2("text", 256).alias("text_sha256"))
    return rows.join(index, ["key", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "bucket", "chain", F.col("key").alias("text_key"),
    )
