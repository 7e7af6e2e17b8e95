"""Tokenising text columns with each distinct piece of text encoded once per worker."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import worker_cache
from .words import ragged, row_slices

WORD_VOCABULARY = "word_bpe_49k.json"
END_ID = 1
_TOGETHER = 2000
#: Units that go to the tokenizer as one string.
_ENCODED_TOGETHER = 200


@dataclass(frozen=True)
class EncoderMemory:
    """What a worker may hold: remembered words, bytes of text whose words are looked up together, bytes of a slice of rows."""

    pieces: int = 500_000
    looked_up_bytes: int = 1 << 23
    slice_bytes: int = 1 << 21


class PieceEncoder:
    """Encodes texts piece by piece; equal pieces are encoded once while they are remembered.

    `split` cuts a text into pieces whose ids, one after the other, are the text's ids. `encode`
    gives the ids of a list of pieces, one after the other, and how many each has. About `limit`
    pieces and those of one call are held; beyond that only those seen more often stay.
    """

    def __init__(self, split: Callable[[str], list[str]], encode: Callable, dtype, limit: int = EncoderMemory.pieces):
        self.split, self.encode, self.dtype, self.limit = split, encode, dtype, limit
        self.codes: dict[str, int] = {}
        self.seen = np.zeros(0, np.int32)
        self.flat = np.zeros(1 << 16, dtype)
        self.starts = np.zeros(1, np.int64)

    def _forget(self) -> None:
        often = 2
        while (self.seen >= often).sum() > self.limit // 2:
            often *= 2
        stay = np.flatnonzero(self.seen >= often)
        kept = dict(zip(compress(self.codes, (self.seen >= often).tolist()), range(len(stay))))
        lengths = np.diff(self.starts)[stay]
        self.flat = np.append(self.flat[ragged(self.starts[stay], lengths)], np.zeros(1 << 16, self.dtype))
        self.codes, self.starts, self.seen = kept, np.concatenate([[0], np.cumsum(lengths)]), np.ones(len(stay), np.int32)

    def _learn(self, fresh: list[str]) -> None:
        self.codes.update(zip(fresh, range(len(self.codes), len(self.codes) + len(fresh))))
        ids, counts = self.encode(fresh)
        used = int(self.starts[-1])
        ends = used + np.cumsum(counts)
        if ends[-1] > len(self.flat):
            self.flat = np.concatenate([self.flat[:used], np.zeros(2 * int(ends[-1]) - used, self.dtype)])
        self.flat[used:ends[-1]] = ids
        self.starts = np.concatenate([self.starts, ends])

    def look_up(self, pieces: list[str], distinct: bool = False) -> np.ndarray:
        """Numbers of pieces, the new ones encoded; good until the next call. `distinct`: no piece occurs twice."""
        if len(self.codes) > self.limit:
            self._forget()
        codes = np.fromiter(map(self.codes.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(codes < 0)
        if len(new):
            found = [pieces[i] for i in new.tolist()]
            if distinct:
                codes[new] = np.arange(len(self.codes), len(self.codes) + len(found))
                self._learn(found)
            else:
                self._learn(list(dict.fromkeys(found)))
                codes[new] = np.fromiter(map(self.codes.__getitem__, found), np.int64, len(found))
        return codes

    def ids(self, codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts one after the other, of `counts` pieces each, and where each text's begin."""
        seen = np.bincount(codes, minlength=len(self.codes))
        seen[:len(self.seen)] += self.seen
        self.seen = seen
        lengths = self.starts[codes + 1] - self.starts[codes]
        ids = self.flat[ragged(self.starts[codes], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return ids, ends[np.concatenate([[0], np.cumsum(counts)])]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's ids begin (texts + 1 values)."""
        found = [self.split(t) for t in texts]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return self.ids(self.look_up(list(chain.from_iterable(found))), counts)


class WordEncoder(PieceEncoder):
    """Pieces are what stands between ASCII white space; each is looked up once in a column."""

    def slices(self, texts: pa.Array, size: int = EncoderMemory.slice_bytes) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, row after the last, ids, where each row's ids begin) of rows of about `size` bytes."""
        found = pc.ascii_split_whitespace(texts)
        counts = found.value_lengths().to_numpy()
        words = found.flatten().dictionary_encode()
        codes = self.look_up(words.dictionary.to_numpy(zero_copy_only=False).tolist(), distinct=True)[words.indices.to_numpy()]
        places = np.concatenate([[0], np.cumsum(counts)])
        offsets = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy())])
        for low, high in row_slices(offsets, size):
            yield low, high, *self.ids(codes[places[low]:places[high]], counts[low:high])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts = list(self.slices(texts))
        lengths = [np.diff(ends) for *_, ends in parts]
        return np.concatenate([np.zeros(0, self.dtype), *(ids for _, _, ids, _ in parts)]), np.cumsum(np.concatenate([[0], *lengths]))


#: Texts of these characters, without a special token's opening, are cut into the vocabulary's own
#: units here, in lower case. In this range normalisation leaves characters as they are.
_LATIN = re.compile("[\x00-\x1b\x20-\u012f\u0131-\u024f]*")
_LETTERS = "a-zA-Z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_NUMBERS = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_SPACE = "\t-\r \u0085\u00a0"
_UNIT = re.compile(f"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{_NUMBERS}]|[^{_SPACE}{_LETTERS}{_NUMBERS}]+")
_ASCII_UNIT = re.compile("[a-z]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\\t-\\r a-z0-9]+")
_UNIT_OR_LINE = re.compile(f"\\n|{_UNIT.pattern}")
#: Characters that str.split() takes for white space and the vocabulary's own pattern does not.
_ODD_SPACE = "\x1c\x1d\x1e\x1f"
CACHE = "word-pieces"


def _units(piece: str) -> list[str]:
    """Parts of a piece that encode independently: units, else what stands between white space."""
    if "<|" not in piece and _LATIN.fullmatch(piece):
        return (_ASCII_UNIT if piece.isascii() else _UNIT).findall(piece.lower())
    return [piece] if any(c in piece for c in _ODD_SPACE) else piece.split()


def _units_of_all(pieces: list[str]) -> tuple[list[str], np.ndarray]:
    """Parts of all pieces one after the other, and their numbers; pieces hold no line feed."""
    joined = "\n".join(pieces)
    if "<|" in joined or not _LATIN.fullmatch(joined):
        parts = [_units(p) for p in pieces]
        return list(chain.from_iterable(parts)), np.fromiter(map(len, parts), np.int64, len(parts))
    found = _UNIT_OR_LINE.findall(joined.lower())
    lines = np.flatnonzero(np.fromiter(map("\n".__eq__, found), bool, len(found)))
    counts = np.diff(np.concatenate([[-1], lines, [len(found)]])) - 1
    return [u for u in found if u != "\n"], counts


#: What a tokenizer must do before its model sees a piece for units to go to the model as they are.
_STEPS = {
    "normalizer": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    "pre_tokenizer": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def _for_units(tokenizer):
    """A tokenizer with the same model for lower-case units between blanks, which need no normalising and no cutting.

    None if the tokenizer takes other steps before its model.
    """
    from tokenizers import Tokenizer, pre_tokenizers as pre

    told = json.loads(tokenizer.to_str())
    if any(list((told[step] or {}).values())[1:] != [wanted] for step, wanted in _STEPS.items()):
        return None
    plain = Tokenizer(tokenizer.model)
    plain.pre_tokenizer = pre.Sequence([pre.WhitespaceSplit(), pre.ByteLevel(add_prefix_space=False, use_regex=False)])
    return plain


def word_encoder(path: str, limit: int = EncoderMemory.pieces) -> WordEncoder:
    """Encoder of a word vocabulary that drops white space, for Arrow columns without nulls.

    One per worker, file and limit of remembered words. Words are remembered as they stand in texts, and so are the units, in
    lower case and without punctuation, that new words are made of.
    """
    encoders = worker_cache(CACHE)
    if (path, limit) not in encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        size = max(tokenizer.get_vocab().values()) + 1
        last = np.array([(tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])

        plain = _for_units(tokenizer)

        def encode(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
            parts = [encode_some(pieces[i:i + _ENCODED_TOGETHER]) for i in range(0, len(pieces), _ENCODED_TOGETHER)]
            return tuple(np.concatenate(p) for p in zip(*parts))

        def encode_some(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
            """Units are encoded together: each ends with its only id that closes a word."""
            joined = " ".join(pieces)
            if "<|" not in joined and _LATIN.fullmatch(joined) and _UNIT.findall(joined) == pieces:
                ids = np.array((plain or tokenizer).encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint16)
                return ids, np.diff(np.flatnonzero(last[ids]), prepend=-1)
            found = [np.array(e.ids, np.uint16) for e in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
            return np.concatenate(found), np.fromiter(map(len, found), np.int64, len(found))

        units = PieceEncoder(_units, encode, np.uint16, limit)  # a forgotten unit costs more than a forgotten word

        def encode_words(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            some = [_units_of_all(words[i:i + _TOGETHER]) for i in range(0, len(words), _TOGETHER)]
            counts = np.concatenate([c for _, c in some])
            codes = units.look_up(list(chain.from_iterable(p for p, _ in some)))
            ids, ends = units.ids(codes, counts)
            return ids, np.diff(ends)

        encoders[path, limit] = WordEncoder(str.split, encode_words, np.uint16, limit)
    return encoders[path, limit]


def public_path(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
