import hashlib

import numpy as np
from hypothesis import given, settings, strategies as st

from rastertables.llm import exact_dedup

from .helpers import empty, frame, odd_rows


def brute(rows):
    groups = {}
    for doc, text in rows:
        groups.setdefault(text or "", []).append(doc)
    out = []
    for doc, text in rows:
        ids = groups[text or ""]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((doc, keep, len(ids), doc == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_odd_rows_with_small_buckets(spark):
    rows = odd_rows() + [(100 + i, f"text {i}") for i in range(200)]
    got = exact_dedup.exact_groups(frame(spark, rows), capacity=300, max_depth=6)
    assert sorted(map(tuple, got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str) == brute(rows)
    assert got.select("bucket").distinct().count() > 8


def test_empty_table(spark):
    assert exact_dedup.exact_groups(empty(spark)).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=16, max_size=16), st.integers(1, 80))
def test_directory_doubles_until_buckets_fit(sizes, capacity):
    sizes = np.array(sizes)
    directory = exact_dedup.split_buckets(sizes, capacity)
    per_slot = np.repeat(directory, 16 // len(directory))
    for bucket in np.unique(directory):
        held = sizes[per_slot == bucket]
        assert held.sum() <= capacity or len(held) == 1
        places = np.flatnonzero(per_slot == bucket)
        assert len(places) == places[-1] - places[0] + 1  # a bucket is a range of keys


def test_equal_keys_are_chained():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({
        "bucket": pa.array([0] * 4, pa.int32()), "key": pa.array([7, 7, 7, 8], pa.int64()), "text": ["a", "b", "a", "c"],
        "top": pa.array([1, 5, None, 2], pa.int64()), "copies": pa.array([1, 2, 3, 1], pa.int64())})
    rows = [r for b in exact_dedup._own(iter([batch.slice(0, 2), batch.slice(2)])) for r in b.to_pylist()]
    assert [(r["key"], r["chain"], r["keep_id"], r["group_size"]) for r in rows] == [(7, 0, 1, 4), (7, 1, 5, 2), (8, 0, 2, 1)]
