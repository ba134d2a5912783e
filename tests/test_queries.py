"""Registered queries: contract, and agreement with SQL on the small folder."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = [
    "entity_days_at_risk", "daily_rich", "dashboard_kpis", "to_sales_uci", "insert_new", "set_overlap", "concentration", "causal_percentile",
    "one_step_backtest", "rank_drivers", "sweep_threshold_fusion", "frontier",
]


def test_every_oracle_has_a_query():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert len(queries) >= 200


@pytest.fixture(scope="module")
def duck():
    if not Path(FOLDER).exists():
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    mine = Counter(repr(tuple(r[c] for c in cols)) for r in df.collect())
    cur = duck.execute(entry.oracle_sql()[name])
    order = [d[0] for d in cur.description]
    theirs = Counter(repr(tuple(r[order.index(c)] for c in cols)) for r in cur.fetchall())
    assert sorted(order) == cols
    assert mine == theirs


def test_entry_has_rows(spark, duck):
    assert entry.entry(spark).columns == ["entity", "date", "ratio", "label", "at_risk"]
