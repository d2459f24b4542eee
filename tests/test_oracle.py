"""Every registered query equals its DuckDB oracle on the test tables."""

import datetime as dt
import math

import duckdb
import pytest

import __spark_entry__ as E
from flowmetrics.plans import registry
from flowmetrics.sources.tables import TABLES

SF_CHECK = "/root/testdata/sf0.01"

NAMES = sorted(E.oracle_sql())


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(repr(_norm(r[i])) for i in order) for r in rows))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF_CHECK}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    # of the catalogue; queries of the add-on that SQL cannot express are tested in tests/llm
    missing = set(registry.queries()) - set(registry.oracle_sql())
    assert not missing, f"queries without oracle: {sorted(missing)}"


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    sql = E.oracle_sql()[name]
    df = E.queries()[name](spark, SF_CHECK)
    got_cols, got = df.columns, [tuple(r) for r in df.collect()]
    res = duck.execute(sql)
    exp_cols = [d[0] for d in res.description]
    exp = res.fetchall()
    assert sorted(got_cols) == sorted(exp_cols)
    assert len(got) == len(exp)
    assert _rows(got_cols, got) == _rows(exp_cols, exp)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["category", "contacts", "pct"]
    assert len(rows) >= 1


SPARK_TO_DUCK = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
    "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN",
}


def test_column_types_match_oracle(spark, duck):
    """Exact types (incl. decimal precision/scale) agree for every query."""
    bad = []
    for name in NAMES:
        st = {f.name: f.dataType.simpleString() for f in E.queries()[name](spark, SF_CHECK).schema.fields}
        dt_ = {d[0]: str(d[1]) for d in duck.execute(f"select * from ({E.oracle_sql()[name]}) q limit 0").description}
        for c, t in st.items():
            if dt_.get(c) != SPARK_TO_DUCK.get(t, t.upper()):
                bad.append((name, c, t, dt_.get(c)))
    assert not bad, bad


@pytest.mark.parametrize("name", ["voice_contact_funnel", "containment_by_outcome", "post_deflection_funnel", "feed_health"])
def test_results_do_not_depend_on_session_time_zone(spark, duck, name):
    """Wall-clock (timestamp_ntz) data and literals give the same answer in any session zone."""
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        df = E.queries()[name](spark, SF_CHECK)
        got_cols, got = df.columns, [tuple(r) for r in df.collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    res = duck.execute(E.oracle_sql()[name])
    assert _rows(got_cols, got) == _rows([d[0] for d in res.description], res.fetchall())
