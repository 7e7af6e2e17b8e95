"""Token ids in files of independent blocks, coded by a range asymmetric numeral system.

One static table of frequencies, made from all ids, serves every block. A block holds whole documents.
Its ids are dealt to lanes in turn (id i goes to lane i mod lanes) and all lanes are coded in step by
numpy. Every `every` steps a checkpoint keeps the lanes' states and the place in the words, so a block
can be decoded from the middle or in parallel; CRC-32 sums guard the header, each stretch between
checkpoints, and each document.

States are 64-bit and stay at or above 2**31; renormalisation moves one 32-bit word.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..storage import shared_folder
from .common import arrow_pass
from .token_stream import block_ids, id_counts, placed_blocks, stored_blocks

SCALE = 20
LANES, EVERY = 2048, 128
BLOCK_TOKENS = 1 << 19
_LOW = 1 << 31
_MAGIC = b"ILB1"
#: magic, table CRC, lanes, steps between checkpoints, ids, documents, words, header CRC
_HEADER = struct.Struct("<4sIIIQQQI")


@dataclass
class FrequencyTable:
    """Frequencies of sum 2**SCALE: every symbol that occurs has at least one slot."""

    frequency: np.ndarray
    below: np.ndarray
    symbol: np.ndarray
    crc: int

    @classmethod
    def of(cls, frequency: np.ndarray) -> "FrequencyTable":
        f = frequency.astype(np.uint64)
        below = np.concatenate([[0], np.cumsum(f)])[:-1].astype(np.uint64)
        return cls(f, below, np.repeat(np.arange(len(f), dtype=np.uint16), f.astype(np.int64)), zlib.crc32(f.astype("<u4").tobytes()))


def quantise(counts: np.ndarray) -> np.ndarray:
    """Slots for each symbol, in proportion to its count and one at least if it occurs."""
    total, used = counts.sum(), counts > 0
    if not total:
        return counts.astype(np.int64)
    slots = np.where(used, np.maximum(1, np.floor(counts / total * (1 << SCALE))), 0).astype(np.int64)
    order = np.argsort(-counts, kind="stable")
    rest = (1 << SCALE) - int(slots.sum())
    if rest >= 0:
        slots[order[0]] += rest
    while rest < 0:  # rare symbols were rounded up: the frequent ones give slots back
        spare = np.minimum(slots[order] - 1, np.maximum(1, slots[order] * -rest // (1 << SCALE)))
        spare[spare < 0] = 0
        give = np.minimum(spare, np.maximum(0, -rest - np.concatenate([[0], np.cumsum(spare)[:-1]])))
        slots[order] -= give
        rest += int(give.sum())
    return slots


def encode_block(ids: np.ndarray, docs: list, lengths: np.ndarray, table: FrequencyTable, lanes: int = LANES, every: int = EVERY) -> bytes:
    """One block with its documents. A null document id is kept as such."""
    n, steps = len(ids), -(-len(ids) // lanes)
    f, c = table.frequency[ids], table.below[ids]
    limit = f << np.uint64(63 - SCALE)
    x = np.full(lanes, _LOW, np.uint64)
    words, sizes, states = [], np.zeros(steps + 1, np.int64), []
    for t in range(steps - 1, -1, -1):
        part = slice(t * lanes, min(n, (t + 1) * lanes))
        own = x[:part.stop - part.start]
        full = own >= limit[part]
        words.append((own[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
        sizes[t + 1] = len(words[-1])
        own[full] >>= np.uint64(32)
        quotient, remainder = np.divmod(own, f[part])
        own[:] = (quotient << np.uint64(SCALE)) + remainder + c[part]
        if t % every == 0:
            states.append(x.astype("<u8").tobytes())
    at = np.cumsum(sizes)[:-1][::every].astype("<u8") if steps else np.zeros(0, "<u8")
    stretches = [zlib.crc32(ids[i:i + lanes * every].astype("<u4").tobytes()) for i in range(0, n, lanes * every)]
    body = b"".join([
        np.array([0 if d is None else d for d in docs], "<i8").tobytes(), np.array([d is None for d in docs], "<u1").tobytes(),
        np.asarray(lengths, "<u8").tobytes(), at.tobytes(), np.array(stretches, "<u4").tobytes(), b"".join(reversed(states)),
    ])
    stream = b"".join(w.tobytes() for w in reversed(words))
    header = (_MAGIC, table.crc, lanes, every, n, len(docs), len(stream) // 4)
    return _HEADER.pack(*header, zlib.crc32(body, zlib.crc32(repr(header[1:]).encode()))) + body + stream


class Block:
    """An encoded block; its stretches decode independently of one another."""

    def __init__(self, data: bytes, table: FrequencyTable):
        magic, crc, self.lanes, self.every, self.n, docs, words, check = _HEADER.unpack_from(data)
        if magic != _MAGIC or crc != table.crc:
            raise ValueError("not a block of this frequency table")
        self.table = table
        stretches = -(-self.n // (self.lanes * self.every))
        parts = (("<i8", docs), ("<u1", docs), ("<u8", docs), ("<u8", stretches), ("<u4", stretches), ("<u8", stretches * self.lanes), ("<u4", words))
        at, found = _HEADER.size, []
        for kind, size in parts:
            found.append(np.frombuffer(data, kind, size, at))
            at += found[-1].nbytes
        header = (crc, self.lanes, self.every, self.n, docs, words)
        if zlib.crc32(data[_HEADER.size:at - words * 4], zlib.crc32(repr(header).encode())) != check or at != len(data):
            raise ValueError("damaged block header")
        doc_ids, null, self.lengths, self.at, self.sums, states, self.words = found
        self.docs = [None if z else d for d, z in zip(doc_ids.tolist(), null.tolist())]
        self.states = states.reshape(stretches, self.lanes)

    def stretch(self, k: int) -> np.ndarray:
        """Ids between checkpoint k and the next."""
        t = self.table
        x, at = self.states[k].astype(np.uint64), int(self.at[k])
        begin = k * self.lanes * self.every
        out = np.empty(min(self.n, begin + self.lanes * self.every) - begin, np.uint16)
        for i in range(0, len(out), self.lanes):
            own = x[:min(self.lanes, len(out) - i)]
            slot = own & np.uint64((1 << SCALE) - 1)
            symbol = t.symbol[slot]
            out[i:i + self.lanes] = symbol
            own[:] = t.frequency[symbol] * (own >> np.uint64(SCALE)) + slot - t.below[symbol]
            short = np.flatnonzero(own < np.uint64(_LOW))
            own[short] = own[short] << np.uint64(32) | self.words[at:at + len(short)]
            at += len(short)
        if zlib.crc32(out.astype("<u4").tobytes()) != self.sums[k]:
            raise ValueError(f"damaged ids after checkpoint {k}")
        return out

    def ids(self) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint16), *map(self.stretch, range(len(self.at)))])


def write_ids(docs: DataFrame, folder: str | None = None, path: str | None = None, block_tokens: int = BLOCK_TOKENS) -> str:
    """Writes all documents' ids, in doc_id order, and returns the folder.

    `folder/table` has the frequencies, `folder/blocks` one encoded block a row with the number of ids
    before it. The default is a new folder in the shared one.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/token-file-{uuid.uuid4().hex}"
    stored = stored_blocks(docs, block_tokens, path)
    blocks = placed_blocks(stored)
    frequency = quantise(id_counts(stored))
    used = np.flatnonzero(frequency)
    spark.createDataFrame(list(zip(used.tolist(), frequency[used].tolist())), "symbol int, frequency long").coalesce(1).write.parquet(f"{folder}/table")
    shared = spark.sparkContext.broadcast(frequency.astype(np.uint32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = FrequencyTable.of(shared.value)
        for batch in batches:
            for ids, docs, lengths, start in zip(*(batch[c].to_pylist() for c in ("ids", "doc_ids", "doc_tokens", "start"))):
                data = encode_block(block_ids(ids), docs, np.array(lengths), table)
                yield pa.RecordBatch.from_arrays([pa.array([start], pa.int64()), pa.array([data], pa.binary())], ["start", "data"])

    arrow_pass(blocks.select("ids", "doc_ids", "doc_tokens", "start"), run, "start long, data binary").write.parquet(f"{folder}/blocks")
    return folder


def read_ids(spark, folder: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, decoded from the files.

    `start` counts the ids of all documents before it, `ids` are little-endian unsigned 32-bit.
    """
    frequency = np.zeros(1 << 16, np.uint32)
    for symbol, n in spark.read.parquet(f"{folder}/table").collect():
        frequency[symbol] = n
    shared = spark.sparkContext.broadcast(frequency)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = FrequencyTable.of(shared.value)
        for batch in batches:
            for start, data in zip(batch["start"].to_pylist(), batch["data"].to_pylist()):
                block = Block(data, table)
                ids = block.ids().astype("<u4")
                ends = np.concatenate([[0], np.cumsum(block.lengths.astype(np.int64))])
                parts = [ids[a:b].tobytes() for a, b in zip(ends, ends[1:])]
                columns = [pa.array(block.docs, pa.int64()), pa.array(start + ends[:-1]), pa.array(np.diff(ends)), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(parts, pa.binary())] * with_ids)], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][:4 + with_ids])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return arrow_pass(spark.read.schema("start long, data binary").parquet(f"{folder}/blocks"), run, schema)
