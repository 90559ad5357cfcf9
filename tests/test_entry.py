"""Every query of the filter engine against its SQL in DuckDB, on the smallest driver tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from quillsift.plans.queries import QUERIES, SPECS, SQL
from quillsift.plans.queries import TABLES as TABLES_OF

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not there")
#: Queries whose result is no or all rows by their nature.
IDENTITIES = {"group_empty_and", "group_empty_or", "assoc_has_all_missing_id", "assoc_empty_has_any", "assoc_empty_only_has_all"}
TABLES = "region nation customer supplier part orders lineitem events documents labels conversations".split()


def test_queries_agree_with_sql(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    wrong = []
    for name, query in QUERIES.items():
        df = query(spark, SF)
        found = con.execute(SQL[name])
        columns = [d[0] for d in found.description]
        if sorted(map(tuple, df.select(*columns).collect())) != sorted(found.fetchall()):
            wrong.append(name)
    assert not wrong


def test_queries_discriminate():
    """A query that gives no or all rows shows little."""
    con, empty = duckdb.connect(), []
    for t in TABLES:
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.01/{t}.parquet'")
    for name, (model, _, _) in SPECS.items():
        rows, all_ = (con.execute(q).fetchone()[0] for q in (f"SELECT count(*) FROM ({SQL[name]})", f"SELECT count(*) FROM {TABLES_OF.get(model, model)} t"))
        if rows in (0, all_) and name not in IDENTITIES:
            empty.append((name, rows))
    assert not empty


def test_entry(spark):
    assert entry.entry(spark).columns == ["c_custkey"]
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_use_joins_and_pushdown(spark):
    plan = QUERIES["assoc_has_any"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "CartesianProduct" not in plan
    plan = QUERIES["prop_eq"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_mktsegment,BUILDING)" in plan
