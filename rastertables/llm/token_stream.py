"""Documents' ids of a word vocabulary as one stream in doc_id order, stored in blocks.

The stream is range-partitioned by doc_id and each part is cut into blocks of whole documents, so any
block can be worked on alone. Only the number of ids of each part is needed to place all blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..storage import materialize
from .common import arrow_pass, texts
from .tokens import CACHE, END_ID, WORD_VOCABULARY, EncoderMemory, public_path, word_encoder
from .words import row_slices

#: Pieces in which the counts of all ids are added up.
COUNT_PIECES = 32
BLOCK_SCHEMA = "part int, block int, part_start long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, ids binary, counts binary"


def _blocks(batches: Iterator[pa.RecordBatch], path: str, block_tokens: int, end_id: int, memory: EncoderMemory) -> Iterator[pa.RecordBatch]:
    encoder, part = word_encoder(path, memory.pieces), TaskContext.get().partitionId()
    names = ["part", "block", "part_start", "n_tokens", "doc_ids", "doc_tokens", "ids", "counts"]
    block, start, docs, lengths, held = 0, 0, [], [], []
    counts = np.zeros(1 << 16, np.int64)

    def row(ids: np.ndarray) -> pa.RecordBatch:
        columns = [
            pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()), pa.array([len(ids)], pa.int64()),
            pa.array([docs], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([ids.astype("<u2").tobytes()], pa.binary()),
            pa.array([None], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names)

    size = 0
    for batch in batches:
        offsets = np.concatenate([[0], np.cumsum(pc.binary_length(batch["text"]).to_numpy())])
        slices = (
            (low + a, low + b, ids, ends) for low, high in row_slices(offsets, memory.looked_up_bytes)
            for a, b, ids, ends in encoder.slices(batch["text"].slice(low, high - low), memory.slice_bytes)
        )
        for low, high, ids, ends in slices:
            ids = np.insert(ids, ends[1:], end_id)
            counts += np.bincount(ids, minlength=1 << 16)
            ends = ends + np.arange(len(ends))
            for doc, begin, end in zip(batch["doc_id"].slice(low, high - low).to_pylist(), ends, ends[1:]):
                docs.append(doc)
                lengths.append(int(end - begin))
                held.append(ids[begin:end])
                size += lengths[-1]
                if size >= block_tokens:
                    yield row(np.concatenate(held))
                    block, start, docs, lengths, held, size = block + 1, start + size, [], [], [], 0
    if docs:
        yield row(np.concatenate(held))
    if counts.any():
        nothing = [pa.array([None], t) for t in (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())]
        yield pa.RecordBatch.from_arrays([
            pa.array([part], pa.int32()), pa.array([None], pa.int32()), *nothing, pa.array([counts.astype("<i8").tobytes()], pa.binary())], names)


def stored_blocks(
    docs: DataFrame, block_tokens: int, path: str | None = None, end_id: int = END_ID, memory: EncoderMemory = EncoderMemory(),
) -> DataFrame:
    """The stream as a stored table: one row per block, and one row per part with its id counts.

    Each document's ids are followed by `end_id`. A block closes at `block_tokens` ids or more. A null
    text has only its end id; rows with the same doc_id stand in the order of their texts, null ids
    come first.
    """
    path = path or public_path(WORD_VOCABULARY)
    ordered = texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(arrow_pass(ordered, lambda batches: _blocks(batches, path, block_tokens, end_id, memory), BLOCK_SCHEMA, CACHE), "token-blocks")


def placed_blocks(stored: DataFrame) -> DataFrame:
    """Blocks with `start`, the ids before them in the stream.

    `part` and `block` give a block's place, `doc_ids` and `doc_tokens` its documents with their
    numbers of ids, `ids` little-endian unsigned 16-bit integers.
    """
    blocks = stored.filter("block is not null").drop("counts")
    # one row a part: their number is that of the shuffle partitions, whatever the input
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return blocks.join(F.broadcast(parts), "part").withColumn("start", F.col("before") + F.col("part_start")).drop("before", "part_start")


def id_counts(stored: DataFrame) -> np.ndarray:
    """How often each id occurs; as many rows as a count has pieces come to the driver."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for counts in batch["counts"]:
                total += np.frombuffer(counts.as_py(), "<i8")
        pieces = [p.astype("<i8").tobytes() for p in total.reshape(COUNT_PIECES, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(range(COUNT_PIECES), pa.int32()), pa.array(pieces, pa.binary())], ["piece", "counts"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, "<i8") for c in frame["counts"])
        return pd.DataFrame({"piece": [frame["piece"].iloc[0]], "counts": [total.astype("<i8").tobytes()]})

    held = arrow_pass(stored.filter("counts is not null").select("counts"), split, "piece int, counts binary")
    total = np.zeros((COUNT_PIECES, (1 << 16) // COUNT_PIECES), np.int64)
    for piece, counts in held.groupBy("piece").applyInPandas(add, "piece int, counts binary").collect():
        total[piece] = np.frombuffer(counts, "<i8")
    return total.ravel()


def block_ids(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2")
