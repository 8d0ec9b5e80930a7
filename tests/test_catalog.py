"""Every query of the catalog against its SQL twin, and the driver's contract."""

import pytest

import __spark_entry__ as driver
from atomloom import catalog
from helpers import SF, in_duckdb, rows_of


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    df = driver.queries()[name](spark, SF)
    got = df.toPandas()
    assert len(got)
    if name in catalog.ORACLE_SQL:
        assert rows_of(got) == rows_of(in_duckdb(catalog.ORACLE_SQL[name]))


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_contract():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_plans_push_columns_down_and_join_by_key(spark):
    plan = catalog.QUERIES["pair_covariance"](spark, SF)._jdf.queryExecution().toString()
    scan = next(x for x in plan.split("\n") if "FileScan" in x)
    assert "l_shipdate" not in scan and "l_linestatus" not in scan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_nothing_else_imports_the_corpus_operators():
    import os
    import re

    root = os.path.dirname(os.path.abspath(driver.__file__))
    for folder, dirs, names in os.walk(os.path.join(root, "atomloom")):
        dirs[:] = [d for d in dirs if d != "llm"]
        for n in names:
            if n.endswith(".py"):
                assert not re.search(r"^\s*(from|import) .*\bllm\b", open(os.path.join(folder, n)).read(), re.M)
