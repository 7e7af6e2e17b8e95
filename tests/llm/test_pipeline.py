import re

import pyarrow as pa
import pytest

import corpus_pipeline
from rastertables.llm import common, prob_minhash, secret_scan
from rastertables.storage import materialize

from .helpers import odd_rows


def test_stages_take_effect(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), "stage")
        assert docs.columns == columns and docs.dtypes == before.dtypes
        assert docs.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
        counts.append(docs.count())
        rows = docs.collect()
        if name == "exact dedup":
            assert len({r.text or "" for r in rows}) == len(rows)
            largest = {}
            for r in before.collect():
                largest[r.text or ""] = max(largest.get(r.text or "", r.doc_id), r.doc_id)
            assert {r.doc_id for r in rows} == set(largest.values())
        if name == "near dedup":
            assert prob_minhash.near_classes(docs).filter("not kept").count() == 0
        if name == "secret scan":
            assert counts[-1] == counts[-2] and any("[REDACTED]" in r.text for r in rows)
            for rule in secret_scan.BASE_RULES:
                assert not any(len(m[rule.group]) >= rule.least for r in rows for m in re.finditer(rule.pattern, r.text or "", re.ASCII))
            assert all(r.n_chars == len(r.text) for r in rows if "[REDACTED]" in (r.text or ""))
    assert counts[0] > counts[1] > counts[2] >= counts[3]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == counts[-1]


def test_odd_rows_go_through(spark, sf_dir):
    rows = [(d, t, None, "s", None) for d, t in odd_rows()]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES:
            if docs.columns == schema.replace(" long", "").replace(" string", "").split(", "):
                docs = materialize(stage(spark, docs, sf_dir), "odd")
        assert "sequence_id" in docs.columns


def test_run_equals_the_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "again")
    assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect()))


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_bound_the_batches_of_their_tasks(spark, sf_dir, name, stage):
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(setting)
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    stage(spark, docs, sf_dir)
    rows = spark.range(0, 5000, 1, 1).selectExpr("id", "repeat('x', 3000) as text")
    got = [n for n, in rows.mapInArrow(sizes, "n long").collect()]
    assert sum(got) >= 15_000_000 and max(got) < 1.5 * common.BATCH_BYTES
    spark.conf.set(setting, "1m")
    stage(spark, docs, sf_dir)
    assert spark.conf.get(setting) == "1m"  # a smaller bound stays
    spark.conf.unset(setting)


def test_results_of_a_pass_leave_in_bounded_batches():
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(["x" * 3000] * 2999 + ["y" * 9_000_000])], ["a", "t"])
    parts = list(common.bounded(batch))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert all(p.nbytes <= common.BATCH_BYTES or p.num_rows == 1 for p in parts) and len(parts) > 4
    assert list(common.bounded(batch.slice(0, 0))) == [batch.slice(0, 0)]
