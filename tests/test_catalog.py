"""Every query with SQL gives the SQL's rows; plans keep their shape."""

from __future__ import annotations

import datetime
import os
from pathlib import Path

import pytest

from tessera.plans import catalog

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}{'/*.parquet' if f.is_dir() else ''}'")
    return c


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return v.isoformat() if isinstance(v, datetime.datetime) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    want = con.execute(catalog.ORACLE_SQL[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    rows = sorted(tuple(plain(r[cols.index(c)]) for c in order) for r in want.fetchall())
    assert sorted(tuple(plain(r[c]) for c in order) for r in df.collect()) == rows


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(catalog.QUERIES) <= set(e.queries())
    if Path("/root/testdata/sf0.001").exists():
        assert e.entry(spark).count() > 0


def test_scans_read_only_what_they_need(spark):
    plan = catalog.QUERIES["market_map"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "l_shipdate" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["canonical_urls", "gate_pass", "repeat_verdict", "snapshot_diff", "entity_match", "html_text"])
def test_no_python_in_the_plan(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
