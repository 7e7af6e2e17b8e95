import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from rastertables.llm import byte_bpe

from .helpers import empty, frame, odd_rows

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")
PATH = P.path(byte_bpe.RANK_FILE)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


ODD = ["a  b\n\n c\t\td  ", "é ́ \xa0x  y\x0bz", "日本語 😀😀 👨‍👩‍👧", "don't I'LL  \r\n  x\x1cy <|endoftext|>", "a" * 60, "Привет мир नमस्ते", "  ", "　 x"]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(ODD), st.text(max_size=40)), min_size=1, max_size=5))
def test_ids_and_bytes(reference, texts):
    codec = byte_bpe.codec(PATH, P.PATTERN)
    for ids, ends in codec.encode(pa.array(texts)):
        for a, b, text in zip(ends, ends[1:], texts):
            assert ids[a:b].tolist() == reference.encode_ordinary(text)
            assert codec.decode(ids[a:b]).tobytes() == text.encode()


def test_every_byte_has_its_character():
    table = byte_bpe.byte_characters()
    assert len(set(table)) == 256 and all(c.isprintable() and not c.isspace() for c in table)


def test_round_trip_of_odd_rows(spark, reference):
    rows = odd_rows()
    got = sorted(map(tuple, byte_bpe.round_trip(frame(spark, rows)).collect()), key=str)
    expected = []
    for doc, text in rows:
        ids = np.array(reference.encode_ordinary(text or ""), "<u4")
        expected.append((doc, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(expected, key=str)
    assert byte_bpe.round_trip(empty(spark)).count() == 0


def test_offsets_name_the_character(spark, reference):
    text = "né 日本 😀!"
    row = byte_bpe.encode(frame(spark, [(1, text)]), offsets=True).first()
    starts = np.frombuffer(row.char_starts, "<u4").tolist()
    done, expected = b"", []
    for token in reference.encode_ordinary(text):
        expected.append(sum((b & 0xC0) != 0x80 for b in done))
        done += reference.decode_single_token_bytes(token)
    assert starts == expected and row.n_tokens == len(expected)
