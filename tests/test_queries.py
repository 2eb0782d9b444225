"""Every registered engine query against DuckDB, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from weirflow.plans.catalogue import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.9g}"
        return str(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else str(v)

    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    assert name in SQL
    rel = duck.sql(SQL[name])
    assert got == canonical(rel.fetchall(), rel.columns)


@pytest.mark.parametrize("name", ["datediff_boundaries", "flatten"])
def test_all_events(spark, name):
    """Every event is in the result."""
    d = SF.replace("0.001", "0.01")
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{d}/events.parquet'")
    df = QUERIES[name](spark, d)
    rows = [tuple(r) for r in df.collect()]
    assert {r[0] for r in rows} == {i for (i,) in con.sql("SELECT event_id FROM events").fetchall()}
    rel = con.sql(SQL[name])
    assert canonical(rows, df.columns) == canonical(rel.fetchall(), rel.columns)


def test_agent_templates():
    """All ten templates in their mix, each routed as expected; not all go to the lake."""
    from weirflow.plans import engine_queries as e

    got = e.agent_statements()
    assert len(got) == 200 and {n for n, _ in got} == set(e.AGENT_TEMPLATES) and len(e.AGENT_TEMPLATES) == 10
    assert all(e.agent_route(sql).route == e.AGENT_TEMPLATES[n][2] for n, sql in got)
    assert sum(e.agent_route(sql).route == "lake" for _, sql in got) == 177


def test_pushdown(spark):
    """Filters and columns reach the scan."""
    plan = QUERIES["filter_project_limit"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_type)" in plan and "props" not in plan.split("ReadSchema")[1]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
