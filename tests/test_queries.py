"""Every query with SQL against DuckDB on the smallest tables; the others give rows."""

import os

import __spark_entry__ as entry
import pytest

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
CORE = {k: v for plan in entry.PLANS for k, v in plan.Q.items()}
SQL = {k: v for plan in entry.PLANS for k, v in plan.O.items()}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows):
    norm = lambda v: round(float(v), 4) + 0.0 if isinstance(v, int | float) and not isinstance(v, bool) else str(v)
    return sorted(([norm(v) for v in r] for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    got = CORE[name](spark, SF)
    cols = sorted(got.columns)
    want = con.sql(SQL[name])
    assert sorted(want.columns) == cols
    at = [list(want.columns).index(c) for c in cols]
    assert plain(map(tuple, got.select(*cols).collect())) == plain(tuple(r[i] for i in at) for r in want.fetchall())


def test_views_keep_scales_and_sessions_apart(spark):
    """Two scales in one session, a new session, and names that the user has taken: views read their own files alone."""
    from pavewise.sources.fixtures import TABLES as RAW
    from pavewise.sources.fixtures import VIEWS, view

    larger = SF.replace("0.001", "0.01")
    spark.range(3).createOrReplaceTempView("orders")
    for name in VIEWS:
        small, large = view(spark, SF, name).count(), view(spark, larger, name).count()
        assert small == view(spark.newSession(), SF, name).count() and (small < large or name in ("tracts", "stops", "plots", "acs_rows"))
    assert spark.table("orders").count() == 3 and {t.name for t in spark.catalog.listTables()} & set(RAW) == {"orders"}
    spark.catalog.dropTempView("orders")


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
