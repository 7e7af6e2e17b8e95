"""Byte-level BPE from a file of ranks, with the tokenizers library over Arrow batches.

Ranks name byte strings. The library wants characters, so every byte has a character of its own
(the usual printable table); merges are all ways to put a token together from two others, in rank
order. Texts are cut where the splitting pattern always cuts, and each distinct piece is encoded
once while a worker remembers it. Decoding goes back through the byte table, so a character whose
bytes lie in two tokens comes out whole.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import arrow_pass, texts, worker_cache
from .tokens import PieceEncoder, public_path
from .words import ragged, row_slices, text_buffer

RANK_FILE = "byte_bpe_multi_50k.tiktoken"

#: Pieces begin at white space after another character. Only these four characters count as such
#: here; texts with others that the pattern takes for white space are encoded in one piece.
_PIECE = re.compile("[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
_OTHER_SPACE = re.compile("[\x0b\x0c\x85\xa0  -     　]")


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable, else one from 256 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def build_tokenizer(ranks: dict[bytes, int], pattern: str):
    """A tokenizer of the library that merges by the ranks."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    table = byte_characters()

    def shown(token: bytes) -> str:
        return "".join(table[b] for b in token)

    merges = [
        (shown(token[:cut]), shown(token[cut:]))
        for token in sorted(ranks, key=ranks.get) for cut in range(1, len(token))
        if token[:cut] in ranks and token[cut:] in ranks
    ]
    tokenizer = Tokenizer(models.BPE(vocab={shown(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
    ])
    return tokenizer


class ByteCodec:
    """Encodes texts to ids and ids to bytes by one rank file."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ranks = read_ranks(path)
        tokenizer = build_tokenizer(ranks, pattern)

        def encode(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
            ids = [e.ids for e in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
            return np.concatenate([np.asarray(i, np.uint32) for i in ids]), np.fromiter(map(len, ids), np.int64, len(ids))

        self._encoder = PieceEncoder(self._pieces, encode, np.uint32, 300_000)
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        back = {c: b for b, c in enumerate(byte_characters())}
        for i in range(size):
            tokens[i] = bytes(back[c] for c in tokenizer.id_to_token(i) or "")
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.lengths = np.fromiter(map(len, tokens), np.int64, size)
        self.starts = np.cumsum(self.lengths) - self.lengths

    @staticmethod
    def _pieces(text: str) -> list[str]:
        if not text:
            return []
        return [text] if _OTHER_SPACE.search(text) else _PIECE.findall(text)

    def encode(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and row offsets of consecutive slices of a text column without nulls."""
        _, offsets = text_buffer(column)
        for low, high in row_slices(offsets):
            yield self._encoder(column.slice(low, high - low).to_pylist())

    def decode(self, ids: np.ndarray) -> np.ndarray:
        lengths = self.lengths[ids]
        return self.bytes[ragged(self.starts[ids], lengths)]

    def character_offsets(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each id the number of its row's characters that begin before it.

        A token that begins inside a character has this character counted as begun.
        """
        lengths = self.lengths[ids]
        heads = (self.decode(ids) & 0xC0) != 0x80
        begun = np.concatenate([[0], np.cumsum(heads)])[np.concatenate([[0], np.cumsum(lengths)])]
        return begun[:-1] - np.repeat(begun[ends[:-1]], np.diff(ends))


CACHE = "byte-pieces"


def codec(path: str, pattern: str) -> ByteCodec:
    """One per worker and file."""
    codecs = worker_cache(CACHE)
    if (path, pattern) not in codecs:
        codecs[path, pattern] = ByteCodec(path, pattern)
    return codecs[path, pattern]


def _settings(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or public_path(RANK_FILE), pattern or public_tokenizers.PATTERN


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Rows of little-endian bytes; `ends` counts values."""
    data = np.ascontiguousarray(values).view(np.uint8)
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer((ends * values.itemsize).astype(np.int64)), pa.py_buffer(data)])


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, offsets: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids[, char_starts]) of every row.

    `ids` holds little-endian unsigned 32-bit integers; `char_starts`, on request, the character
    at which each token begins, in the same form. Null and empty texts have no tokens. Special
    tokens are ordinary text. `path` must name the rank file on every executor.
    """
    path, pattern = _settings(path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            done = 0
            for ids, ends in own.encode(batch["text"]):
                n = len(ends) - 1
                columns = [batch["doc_id"].slice(done, n), pa.array(np.diff(ends)), _binary(ids, ends).cast(pa.binary())]
                if offsets:
                    columns.append(_binary(own.character_offsets(ids, ends).astype(np.uint32), ends).cast(pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "char_starts"][:len(columns)])
                done += n

    return arrow_pass(texts(docs), run, "doc_id long, n_tokens long, ids binary" + ", char_starts binary" * offsets, CACHE)


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """All columns of an encoded table and `decoded`, the bytes of its `ids`; null ids have none."""
    path, pattern = _settings(path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            data, offsets = text_buffer(batch["ids"].cast(pa.large_binary()).view(pa.large_string()))
            for low, high in row_slices(offsets):
                ends = (offsets[low:high + 1] - offsets[low]) // 4
                ids = data[offsets[low]:offsets[high]].copy().view("<u4")
                sizes = np.concatenate([[0], np.cumsum(own.lengths[ids])])[ends]
                decoded = _binary(own.decode(ids), sizes).cast(pa.binary())
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([*part.columns, decoded], [*part.schema.names, "decoded"])

    schema = ", ".join(f"`{n}` {t}" for n, t in encoded.dtypes)
    return arrow_pass(encoded, run, f"{schema}, decoded binary", CACHE)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row."""
    done = decode(encode(docs, path), path)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
