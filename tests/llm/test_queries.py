"""Registered corpus queries beside their SQL on the small tables."""

import pytest

from rastertables.llm.queries import ORACLES, REGISTRY
from tools.check_queries import compare, database


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in REGISTRY) == list(range(1, 14))
    assert set(ORACLES) <= set(REGISTRY)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    assert compare(REGISTRY[name](spark, sf_dir), database(sf_dir), ORACLES[name]) == ""


def test_entry_registers_them():
    import __spark_entry__

    assert {*REGISTRY, "pipeline"} <= set(__spark_entry__.queries())
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql())
