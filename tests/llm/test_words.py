import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from rastertables.llm import tokens, words

WORD = re.compile("[^\x20\x09-\x0D]+")
TEXT = st.text(st.sampled_from("abÉ日 \t\n\x0b\x0c\r.,'\xa0"), max_size=30)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8))
def test_words_and_hashes(texts):
    seen = {}
    for low, high, own in words.word_slices(pa.array(texts, pa.string())):
        found = [own.data[a:b].tobytes().decode() for a, b in zip(own.starts, own.ends)]
        assert found == [w for t in texts[low:high] for w in WORD.findall(t or "")]
        for word, code in zip(found, own.hashes().tolist()):
            assert seen.setdefault(word, code) == code
    assert len(set(seen.values())) == len(seen)


def morse(n, a="a", b="b"):
    """Texts that hashes by powers of a base modulo 2**64 cannot tell apart, whatever the base."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


def test_hashes_of_words_do_not_collide_by_construction():
    one, two = morse(1024)
    own = next(words.word_slices(pa.array([f" {one} {two} {one}", two, "x" * 63, "x" * 64, "x" * 65, "X" * 65])))[2]
    codes = own.hashes().tolist()
    assert codes[0] == codes[2] and codes[1] == codes[3] and len(set(codes)) == 6
    assert own.hashes(lower=True)[6] == own.hashes(lower=True)[7]


def test_slices_cover_rows_and_long_rows():
    texts = ["a b"] * 50 + ["c " * 5000] + [None, ""] + ["d"]
    _, offsets = words.text_buffer(pa.array(texts))
    ranges = list(words.row_slices(offsets, 100))
    assert [r for a, b in ranges for r in range(a, b)] == list(range(len(texts)))


def test_windows_stay_in_rows():
    own = next(words.word_slices(pa.array(["a b c", None, "x y", "a b c d"])))[2]
    first, code = own.windows(own.hashes(), 3)
    assert first.tolist() == [0, 5, 6] and code[0] == code[1] != code[2]


def test_ragged():
    assert words.ragged(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(tokens.public_path(tokens.WORD_VOCABULARY))


ODD = ["", " ", "Don't STOP!! 12ab", "a\x1cb c", "é ́ İ Σ ΑΣ ſ", "<|endoftext|>x <|startoftext|>", "日本語 x\xa0y", "µ ª ²½ ʼn", "x" * 500, "'s 'sx it's '"]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(ODD), st.text(max_size=30), TEXT), min_size=1, max_size=6))
def test_word_encoder_equals_library(library, texts):
    ids, ends = tokens.word_encoder(tokens.public_path(tokens.WORD_VOCABULARY))(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_encoder_forgets_and_stays_right():
    encoder = tokens.PieceEncoder(str.split, lambda p: (np.array([int(x) for x in p]), np.ones(len(p), int)), np.uint32, limit=4)
    for i in range(20):
        ids, ends = encoder([f"{i} {i + 1}", "", f"{i % 3} 0"])
        assert ids.tolist() == [i, i + 1, i % 3, 0] and ends.tolist() == [0, 2, 2, 4]
        assert len(encoder.codes) <= 4 + 4


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.sampled_from("abzé'sñßÿ019.,!µŉȷ"), min_size=1, max_size=12), min_size=1, max_size=8))
def test_units_need_no_other_step_than_the_model(library, pieces):
    plain = tokens._for_units(library)
    units = [u for p in pieces for u in tokens._units(p)]
    assert plain.encode_batch_fast([" ".join(units)], add_special_tokens=False)[0].ids == [i for u in units for i in library.encode(u, add_special_tokens=False).ids]


def test_other_vocabularies_take_all_their_steps():
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(tokens.public_path(tokens.WORD_VOCABULARY))
    library.normalizer = tokenizers.normalizers.Lowercase()
    assert tokens._for_units(library) is None
    library = tokenizers.Tokenizer.from_file(tokens.public_path(tokens.WORD_VOCABULARY))
    library.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    assert tokens._for_units(library) is None


def test_distinct_pieces_are_numbered_as_others():
    def encoder():
        return tokens.PieceEncoder(str.split, lambda p: (np.array([int(x) for x in p]), np.ones(len(p), int)), np.uint32, limit=4)

    one, other = encoder(), encoder()
    for i in range(20):
        pieces = [str(i), str(i + 1), str(i % 3 + 50)]
        codes = one.look_up(pieces, distinct=True)
        assert codes.tolist() == other.look_up(pieces).tolist()
        counts = np.array([len(codes)])
        assert one.ids(codes, counts)[0].tolist() == other.ids(codes, counts)[0].tolist() == [int(p) for p in pieces]


def test_a_unit_is_encoded_once_while_as_many_are_remembered(monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    from rastertables.llm import common

    monkeypatch.setattr(common, "_caches", {})
    calls = []
    look_up = tokens.PieceEncoder._learn
    monkeypatch.setattr(tokens.PieceEncoder, "_learn", lambda self, fresh: (calls.append((self, len(fresh))), look_up(self, fresh))[1])
    encoder = tokens.word_encoder(tokens.public_path(tokens.WORD_VOCABULARY), limit=300)
    words_of = ["".join("abcdefghij"[int(c)] for c in str(1000 + i)) for i in range(250)]
    for mark in ",.;:!":  # new words each time, of the same units
        encoder(pa.array([" ".join(w + mark for w in words_of)]))
    assert sum(n for own, n in calls if own is not encoder) == 250 + 5
