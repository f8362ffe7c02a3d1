"""Every query of the panel library against its SQL counterpart on the smallest tables."""

import os

import pytest

import __spark_entry__ as contract
from oracle import compare, duck

from tallypanel.plans import catalog, panels

SF_DIR = os.environ.get("TALLYPANEL_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")

# Operators of the plan that pair every row of one side with every row of the other.
PAIRING = ("CartesianProduct", "BroadcastNestedLoopJoin")
PYTHON = ("PythonUDF", "ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas")


@pytest.fixture(scope="module")
def tables():
    return duck(SF_DIR)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)
    assert set(catalog.QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, tables, name):
    df = contract.queries()[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [op for op in (*PAIRING, *PYTHON) if op in plan]
    assert compare(tables, contract.oracle_sql()[name], df) is None


def test_declared_schemas(spark):
    for name, declared in panels.SCHEMAS.items():
        found = spark.read.parquet(f"{SF_DIR}/{name}.parquet")
        assert found.dtypes == panels.table(spark, SF_DIR, name).dtypes, (name, declared)


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns[:2] == ["country", "timestamp"] and df.limit(1).count() == 1
