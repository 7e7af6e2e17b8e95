import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from rastertables.llm import packing, rans
from rastertables.llm.tokens import WORD_VOCABULARY, public_path

from .helpers import empty, frame, odd_rows


@pytest.fixture(scope="module")
def ids_of():
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(public_path(WORD_VOCABULARY))
    return lambda text: np.array(library.encode(text or "", add_special_tokens=False).ids + [1], "<u4")


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))


def test_files_give_back_all_ids(spark, ids_of):
    rows, at, expected = ordered(odd_rows()), 0, []
    for doc, text in rows:
        ids = ids_of(text)
        expected.append((doc, at, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes()))
        at += len(ids)
    folder = rans.write_ids(frame(spark, odd_rows()), block_tokens=500)
    got = [(*r[:4], bytes(r[4])) for r in rans.read_ids(spark, folder, with_ids=True).collect()]
    assert sorted(got, key=lambda r: r[1]) == expected
    assert spark.read.parquet(f"{folder}/blocks").count() > 3


def test_empty_tables(spark):
    assert rans.read_ids(spark, rans.write_ids(empty(spark))).count() == 0
    assert packing.pack(empty(spark)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=300), st.integers(1, 9), st.integers(1, 5))
def test_blocks_round_trip(ids, lanes, every):
    ids = np.array(ids, np.uint16)
    table = rans.FrequencyTable.of(rans.quantise(np.bincount(ids, minlength=1 << 16)))
    data = rans.encode_block(ids, [3, None], np.array([1, len(ids) - 1]), table, lanes, every)
    block = rans.Block(data, table)
    assert (block.ids() == ids).all() and block.docs == [3, None] and block.lengths.tolist() == [1, len(ids) - 1]
    for k in reversed(range(len(block.at))):  # any checkpoint alone
        assert (block.stretch(k) == ids[k * lanes * every:(k + 1) * lanes * every]).all()


def test_damage_is_seen():
    ids = np.arange(3000, dtype=np.uint16) % 700
    table = rans.FrequencyTable.of(rans.quantise(np.bincount(ids, minlength=1 << 16)))
    data = rans.encode_block(ids, [1], np.array([3000]), table, 16, 20)
    for at in (10, rans._HEADER.size + 3, len(data) - 2):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            rans.Block(bytes(broken), table).ids()


def test_frequencies_use_all_slots():
    counts = np.zeros(1 << 16, np.int64)
    counts[:40_000] = 1
    counts[5] = 10**12
    for c in (counts, counts[::-1], np.bincount([3], minlength=9)):
        f = rans.quantise(c)
        assert f.sum() == 1 << rans.SCALE and ((f > 0) == (c > 0)).all()


def test_coding_is_near_the_entropy():
    ids = np.random.default_rng(1).geometric(0.05, 200_000).astype(np.uint16)
    counts = np.bincount(ids, minlength=1 << 16)
    table = rans.FrequencyTable.of(rans.quantise(counts))
    share = counts[counts > 0] / len(ids)
    bits = -(share * np.log2(share)).sum() * len(ids)
    assert 8 * len(rans.encode_block(ids, [1], np.array([len(ids)]), table)) < 1.12 * bits


def test_pieces_cover_documents_and_sequences(spark, ids_of):
    rows = odd_rows()
    got = packing.pack(frame(spark, rows), size=256, block_tokens=4000, with_ids=True).collect()
    by_sequence, by_doc = {}, {}
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by_sequence.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    stream = b"".join(ids_of(t).tobytes() for _, t in ordered(rows))
    for first, parts in by_sequence.items():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == [sum(q.length for q in parts[:i]) for i in range(len(parts))]
        joined = b"".join(r.ids for r in parts)
        assert len(joined) <= 4 * 256 and stream[4 * first:4 * first + len(joined)] == joined
    assert sum(r.length for r in got) * 4 == len(stream)
    assert sum(len(ids_of(t)) for _, t in rows) == sum(r.length for r in got)


def cost(places, penalties, cuts, size):
    penalty = dict(zip(places.tolist(), penalties.tolist()))
    total, last = 0.0, 0
    for cut in cuts:
        n = cut - last
        assert 0 < n <= size
        total += penalty[cut] + (0 if n == size or n & (n - 1) == 0 else size - n)
        last = cut
    return total


def test_short_powers_of_two_need_no_padding():
    places = np.arange(0, 2081, 16)
    assert packing.best_cuts(places, np.zeros(len(places)), 2048).tolist() in ([32, 2080], [2048, 2080])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 90), st.sampled_from([0.0, 4.0, 64.0])), min_size=1, max_size=12))
def test_cuts_are_the_best(steps):
    size = 256
    places = np.concatenate([[0], np.cumsum([s for s, _ in steps])])
    penalties = np.array([0.0, *(p for _, p in steps)])
    got = packing.best_cuts(places, penalties, size)
    best, n = {0: 0.0}, len(places)
    for j in range(1, n):
        best[j] = penalties[j] + min(
            best[i] + cost(places, np.zeros(n), [places[j]], size) if i == 0 else best[i] + (0 if (d := places[j] - places[i]) == size or d & (d - 1) == 0 else size - d)
            for i in range(j) if places[j] - places[i] <= size)
    assert got[-1] == places[-1] and abs(cost(places, penalties, got.tolist(), size) - best[n - 1]) < 1e-9
