"""Packing of the token stream into sequences, in order, by dynamic programming.

Cuts may fall where a document ends (free), where a sentence ends (a small penalty), and inside
stretches without sentence ends (a large one). A sequence of `size` ids, or of a power of two, has no
padding; any other is padded to `size`. With f the least cost up to a place,

    f(j) = penalty(j) + min(f(i) + size - (j - i)  for j - size <= i < j,  f(j - 2**k)),

whose first part is a window minimum of f(i) + i, kept in a monotone queue, so every place costs a
constant number of steps. Blocks of the stream are packed independently of one another.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_pass
from .token_stream import block_ids, placed_blocks, stored_blocks
from .tokens import WORD_VOCABULARY, EncoderMemory, public_path

SIZE = 2048
BLOCK_TOKENS = 1 << 19
SENTENCE_PENALTY, INNER_PENALTY = 4.0, 64.0
#: Without a sentence end for so many ids, cuts are allowed this far apart.
LONGEST_STRETCH, INNER_STEP = 256, 64
SENTENCE_ENDS = (".</w>", "!</w>", "?</w>")


def cut_places(ids: np.ndarray, doc_ends: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where a sequence may end, ascending from 0, and their penalties.

    `sentence` tells for each id whether it ends a sentence.
    """
    marks = np.union1d(np.flatnonzero(sentence[ids]) + 1, doc_ends)
    gaps = np.diff(marks, prepend=0)
    wide = np.flatnonzero(gaps > LONGEST_STRETCH)
    inner = [np.arange(marks[i] - gaps[i] + INNER_STEP, marks[i], INNER_STEP) for i in wide]
    places = np.concatenate([[0], *inner, marks])
    penalties = np.concatenate([[0.0], *(np.full(len(i), INNER_PENALTY) for i in inner), np.where(np.isin(marks, doc_ends), 0.0, SENTENCE_PENALTY)])
    order = np.argsort(places, kind="stable")
    return places[order], penalties[order]


def best_cuts(places: np.ndarray, penalties: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Ends of the sequences with the least padding and penalties; no step is over `size`."""
    n = len(places)
    at = np.full(int(places[-1]) + 1, -1, np.int32)
    at[places] = np.arange(n)
    halves = [1 << k for k in range(size.bit_length() - 2, -1, -1)]
    jumps = np.stack([np.where(places >= h, at[np.maximum(places - h, 0)], -1) for h in halves], 1) if halves else np.zeros((n, 0), int)
    exact = (jumps >= 0).any(1).tolist()
    place, penalty, cost, before = places.tolist(), penalties.tolist(), [0.0] * n, [0] * n
    queue = deque([(0.0, 0, 0)])
    for j in range(1, n):
        p = place[j]
        while queue[0][1] < p - size:
            queue.popleft()
        key, _, i = queue[0]
        least = key + size - p
        if exact[j]:
            for k in jumps[j].tolist():
                if k >= 0 and cost[k] < least:
                    least, i = cost[k], k
        least += penalty[j]
        cost[j], before[j] = least, i
        key = least + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, p, j))
    cuts, j = [], n - 1
    while j:
        cuts.append(place[j])
        j = before[j]
    return np.array(cuts[::-1], np.int64)


def pieces_of(ids: np.ndarray, lengths: np.ndarray, sentence: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, ...]:
    """(document number, place in the block, length, place of the sequence) of each piece."""
    doc_ends = np.cumsum(lengths)
    cuts = best_cuts(*cut_places(ids, doc_ends, sentence), size)
    ends = np.union1d(cuts, doc_ends)
    starts = np.concatenate([[0], ends[:-1]])
    heads = np.concatenate([[0], cuts[:-1]])
    return np.searchsorted(doc_ends, starts, "right"), starts, ends - starts, heads[np.searchsorted(cuts, starts, "right")]


def pack(
    docs: DataFrame, size: int = SIZE, path: str | None = None, block_tokens: int = BLOCK_TOKENS, with_ids: bool = False,
    memory: EncoderMemory = EncoderMemory(),
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids].

    `start` counts the document's ids before the piece, `offset` the ids before it in its sequence,
    and `sequence_id` is the place of the sequence's first id in the whole stream. Null and empty texts
    are pieces of one id. `ids` are little-endian unsigned 32-bit. Rows that share a doc_id are documents of their own,
    in the order of their texts, null ids first; long texts are cut like others; other columns are not read; an empty table
    gives no rows.
    """
    from tokenizers import Tokenizer

    path = path or public_path(WORD_VOCABULARY)
    ends = [i for i in map(Tokenizer.from_file(path).token_to_id, SENTENCE_ENDS) if i is not None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sentence = np.zeros(1 << 16, bool)
        sentence[ends] = True
        for batch in batches:
            for data, doc_ids, lengths, begin in zip(*(batch[c].to_pylist() for c in ("ids", "doc_ids", "doc_tokens", "start"))):
                ids, lengths = block_ids(data), np.array(lengths)
                doc, place, length, head = pieces_of(ids, lengths, sentence, size)
                wide = ids.astype("<u4")
                parts = [wide[a:a + n].tobytes() for a, n in zip(place, length)]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                columns = [
                    pa.array(doc_ids, pa.int64()).take(pa.array(doc)), pa.array(place - (np.cumsum(lengths) - lengths)[doc]), pa.array(length),
                    pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array(lengths[doc]), pa.array(begin + head), pa.array(place - head),
                ]
                if with_ids:
                    names, columns = [*names, "ids"], [*columns, pa.array(parts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)

    blocks = placed_blocks(stored_blocks(docs, block_tokens, path, memory=memory)).select("ids", "doc_ids", "doc_tokens", "start")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return arrow_pass(blocks, run, schema + ", ids binary" * with_ids)
