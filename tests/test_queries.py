"""Every library query against its SQL twin on the smallest data."""

import importlib
import os

import duckdb
import pytest

from threadlens import registry

DATA = "/root/testdata/sf0.001"
#: Queries that SQL can't express, and the tests of what they compute.
TESTED = {
    "an.recall": ("test_operators", "test_recall_of_the_index"), "chk.judge_parts": ("test_operators", "test_judge_inputs"), "chk.plan": ("test_chunking", "test_plan"), "chk.overlap": ("test_chunking", "test_plan"),
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, oracle, tmp_path, name):
    out = f"{tmp_path}/out"
    registry.queries()[name](spark, DATA).write.parquet(out)
    sql = registry.oracle_sql().get(name)
    if sql is None:  # beyond SQL: a test of its own holds it against a plain version
        module, test = TESTED[name]
        assert callable(getattr(importlib.import_module(module), test))
        return
    want, got = oracle.sql(sql), oracle.sql(f"select * from '{out}/*.parquet'")
    assert sorted(want.columns) == sorted(got.columns)
    columns = ", ".join(sorted(want.columns))
    for a, b in ((sql, f"select * from '{out}/*.parquet'"), (f"select * from '{out}/*.parquet'", sql)):
        extra = oracle.sql(f"with a as (select {columns} from ({a})), b as (select {columns} from ({b})) select * from (select * from a except all select * from b) limit 3").fetchall()
        assert extra == []


def test_inventory_is_covered():
    kinds = {name.split(".")[0] for name in registry.queries()}
    assert kinds >= {"src", "snk", "flt", "prj", "jn", "agg", "win", "top", "set", "str", "chk", "stm", "rt", "ex", "vw", "rq", "dc", "gn", "em", "cj", "ct", "an", "mt", "ev", "ln", "ad", "au", "sp"}


def test_flagship(spark):
    assert registry.flagship(spark, DATA).count() > 0
