import hashlib
import re

import pytest
from pyspark.sql import functions as F

from rastertables.llm import queries, secret_scan as s
from rastertables.llm.common import drop_rows

from .helpers import empty, frame, odd_rows

ROWS = odd_rows() + [
    (20, "API_KEY='abc/def+123' and apikey=short passwd: 12345 é😀 secret=\"x.y-z_9=\""), (21, "AKIA" + "A1" * 12 + " AKIA123 akia" + "B" * 20),
    (22, "deadbeef" * 3 + " " + "0" * 23 + " " + "f" * 24), (23, "ghp_" + "a" * 40 + " xoxb-12345678901 -----BEGIN RSA PRIVATE KEY-----"),
    (24, "TOKEN   :   " + "t" * 100_000), (25, "token=token=secret=abcdefgh"), (26, "the passwor d and se cret toke n"),
]


def spans(text, rules=s.RULES):
    text, found = text or "", []
    for i, rule in enumerate(rules):
        found += [(m.start(), i, m.end()) for m in re.finditer(rule.pattern, text, re.ASCII) if len(m[rule.group]) >= rule.least]
    return [(rules[i].kind, a, b) for a, i, b in sorted(found)]


def test_scan_equals_plain_search(spark):
    got = sorted(((r.doc_id, [tuple(x) for x in r.spans]) for r in s.scan(frame(spark, ROWS)).collect()), key=str)
    assert got == sorted(((d, spans(t)) for d, t in ROWS), key=str)
    assert any(k == "forge" for _, found in got for k, _, _ in found)


def test_other_columns_stay_and_empty_tables(spark):
    assert {r.lang for r in s.scan(frame(spark, ROWS)).collect()} == {None}
    assert s.scan(empty(spark)).count() == 0


def test_candidates_hold_every_match(spark):
    docs = frame(spark, ROWS)
    found = dict(map(tuple, s.candidates(s.build_index(docs, s.trigrams(s.RULES), segment_rows=5)).collect()))
    for doc, text in ROWS:
        if doc is not None:
            for kind, _, _ in spans(text):
                i = [r.kind for r in s.RULES].index(kind)
                assert s.trigram_query(s.RULES[i].pattern) == s.EVERYTHING or found.get(doc, 0) >> i & 1
    assert found.get(1, 0) == 0


@pytest.mark.parametrize("pattern, clauses", [
    ("abcd", [{"abc", "bcd"}]), ("(abc|xyz)1?", [{"abc"}, {"xyz"}]), ("[0-9a-f]+", [set()]), ("ab?cd", [{"abc", "bcd"}, {"acd"}]),
    ("foo.*bar", [{"foo", "bar"}]), ("(?:abc)+", [{"abc"}]), ("(?:abc)*", [set()]), ("a{3}bcd", [{"bcd"}]), ("ab|abc", [set()]),
])
def test_trigram_queries(pattern, clauses):
    assert s.trigram_query(pattern) == frozenset(map(frozenset, clauses))


def test_redaction_removes_all_spans(spark):
    got = {(r.doc_id, r.redacted): r.text for r in s.redact(frame(spark, ROWS)).collect()}
    assert got[4, False] is None and got[20, True].count("[REDACTED]") == 2
    assert not any(spans(t, s.BASE_RULES) for t in got.values())


def test_query_columns(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = queries.secret_query(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(texts) and sum(r.n_hex for r in rows)
    for r in rows:
        base = spans(texts[r.doc_id], s.BASE_RULES)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for k, _, _ in base) for kind in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert r.spans == ",".join(f"{k}:{a}:{b}" for k, a, b in spans(texts[r.doc_id]))


def test_own_columns_of_any_name_stay(spark):
    rows = [(1, "password = hunter22", 5, "mine", 7, 8), (2, None, 6, None, 9, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _mask int, _found string, dropped_id int, dropped_key int")
    got = s.redact(docs)
    assert got.columns == [*docs.columns, "redacted"]
    assert sorted(tuple(r)[2:] for r in got.collect()) == [(5, "mine", 7, 8, True), (6, None, 9, 10, False)]
    assert sorted(r["_mask"] for r in s.scan(docs).collect()) == [5, 6]
    gone = spark.createDataFrame([(2,)], "doc_id long").select("doc_id", F.xxhash64(F.lit("")).alias("text_key"))
    assert [tuple(r) for r in drop_rows(docs, gone).collect()] == rows[:1]
