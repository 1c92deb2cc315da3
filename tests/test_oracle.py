"""Registered queries against their DuckDB oracle on the small tables."""

import duckdb
import pytest

import __spark_entry__ as E
from checks.compare import TABLES, _rows
from tests.conftest import SF_SMALL

NAMES = [
    "category_severity", "parse_stats", "events_page", "daily_summary", "processing_time_stats",
    "notification_metrics", "recent_suspicious", "top_recommendations",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    assert set(E.queries()) - set(E.oracle_sql()) <= E.NO_ORACLE


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    res = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(srows, df.columns) == _rows(res.fetchall(), dcols)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["category", "severity_score", "n"]
    assert df.count() > 0
