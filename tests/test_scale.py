"""What a larger input changes: the number of tasks, and shuffles that AQE coalesces."""

import pytest

import __spark_entry__ as driver
from atomloom import catalog
from atomloom.plans import adapters, session
from helpers import SF, in_duckdb, rows_of


@pytest.fixture
def conf(spark):
    """Set values of the session for one test."""
    old = {}

    def put(**values):
        for k, v in values.items():
            k = k.replace("__", ".")
            old.setdefault(k, spark.conf.get(k, None))
            spark.conf.set(k, v)

    yield put
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def same_as_sql(spark, name, folder=SF):
    got = driver.queries()[name](spark, folder).toPandas()
    assert rows_of(got) == rows_of(in_duckdb(catalog.ORACLE_SQL[name], folder))


def test_fit_with_shuffles_coalesced_differently(spark, conf):
    """Observations and pairs are alike by structure, but their shuffles have different numbers of tasks."""
    conf(spark__sql__shuffle__partitions="32", spark__sql__autoBroadcastJoinThreshold="300k", spark__sql__adaptive__advisoryPartitionSizeInBytes="100k", spark__sql__adaptive__coalescePartitions__minPartitionSize="1k")
    same_as_sql(spark, "fit_solve", "/root/testdata/sf0.01")


def test_tasks_follow_the_bytes(spark, monkeypatch):
    """A task's rows don't grow with the input."""
    n = []
    for part in (1 << 20, 12_000, 6_000):
        monkeypatch.setattr(session, "PART_BYTES", part)
        n.append([f(spark, SF).rdd.getNumPartitions() for f in (adapters.order_atoms, adapters.order_structures)])
    assert n[0][0] <= 4 and n[1][0] >= 8 and n[2][0] >= 2 * n[1][0] - 1
    assert all(a == b for a, b in n[1:])


def test_supercell_holds_no_row_per_atom_in_a_hash_table(spark):
    plan = driver.queries()["supercell_repeat"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "atom_id" not in "".join(x for x in plan.split("\n") if "HashAggregate(keys" in x).replace("collect_set(atom_id", "")


@pytest.mark.parametrize("name", ["supercell_repeat", "fit_solve", "normal_matrix", "eam_covariance", "xyz_predict", "composite_fit"])
def test_many_tasks(spark, monkeypatch, name):
    monkeypatch.setattr(session, "PART_BYTES", 8_000)
    same_as_sql(spark, name)


def plan(spark, name):
    return driver.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_matrix_meets_no_other_row(spark):
    joins = [x for x in plan(spark, "normal_matrix").split("\n") if "Join" in x]
    assert not [x for x in joins if "obs#" in x]


def test_energies_of_densities_need_no_forces(spark):
    text = plan(spark, "eam_covariance")
    assert text.count("parquet") <= 2 and "Join LeftOuter" not in text


def test_files_are_parsed_once(spark):
    """What is read of the written files is Parquet."""
    assert "extxyz" not in plan(spark, "xyz_round_trip")
