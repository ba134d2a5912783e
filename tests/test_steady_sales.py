"""Queries on sales without a single decline, where labels have one class."""

from collections import Counter
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ebbtide.operators import ml, selection

TABLES = {
    "region": ("r_regionkey int, r_name string", [(0, "ASIA")]),
    "nation": ("n_nationkey int, n_regionkey int", [(0, 0)]),
    "supplier": ("s_suppkey bigint, s_nationkey int", [(1, 0)]),
    "customer": ("c_custkey bigint, c_mktsegment string", [(1, "BUILDING")]),
    "part": ("p_partkey bigint, p_type string, p_brand string, p_name string", [(1, "PROMO", "b", "x"), (2, "SMALL", "b", "y")]),
}
LINE = (
    "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
)
ORDER = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string"
DAYS = 1100


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("steady")
    lines = []
    for d in range(DAYS):
        day = datetime(1995, 1, 2) + timedelta(days=d)
        lines += [(2 * d + p, p, 1, 1, 1.0, 100.0 + d * 7 % 5 + p, 0.0, 0.0, "N", "O", day) for p in (1, 2)]
        if d % 10 == 0:
            lines.append((2 * d + 1, 1, 1, 2, 1.0, 1.0, 0.0, 0.0, "R", "O", day))
    rows = {**TABLES, "lineitem": (LINE, lines), "orders": (ORDER, [(k, 1, "F", "1-URGENT") for k in sorted({r[0] for r in lines})])}
    for name, (schema, data) in rows.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{at}/{name}.parquet")
    return str(at)


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in [*TABLES, "lineitem", "orders"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    return con


@pytest.mark.parametrize("name", ["conformal_alphas", "sector_day_panel", "percentile_stream"])
def test_matches_sql(spark, folder, duck, name):
    """Nothing is left out, the newest days of a stream neither."""
    df = entry.queries()[name](spark, folder)
    cols = sorted(df.columns)
    mine = Counter(repr(tuple(r[c] for c in cols)) for r in df.collect())
    cur = duck.execute(entry.oracle_sql()[name])
    order = [d[0] for d in cur.description]
    assert sorted(order) == cols
    assert mine == Counter(repr(tuple(r[order.index(c)] for c in cols)) for r in cur.fetchall())


def test_percentile_stream_scores_every_row(spark, folder):
    queries = entry.queries()
    assert queries["percentile_stream"](spark, folder).count() == queries["delayed_label_stream"](spark, folder).count()


def rows(spark, label):
    return spark.range(120).select(
        F.concat(F.lit("e"), F.col("id") % 2).alias("entity"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("date"),
        (F.col("id") % 7).cast("double").alias("a"), F.lit(label).alias("y"),
    )


@pytest.mark.parametrize("kind", ["logistic", "forest", "boosted"])
@pytest.mark.parametrize("label", [0, 1])
def test_classifier_of_one_class(spark, kind, label):
    d = rows(spark, label)
    scored = ml.classify(ml.fit_classifier(d, ["a"], "y", kind), d, "p").agg(F.min("p"), F.max("p"), F.count("p")).first()
    assert scored[2] == 120 and abs(scored[0] - label) < 0.1 and abs(scored[1] - label) < 0.1


def test_snapshots_without_any_model(spark):
    got = ml.monthly_snapshot_scores(rows(spark, 0), "date", "y", ["a"], min_rows=5)
    assert got.count() == 120 and got.where("snapshot_risk is not null or train_rows is not null").count() == 0
    assert {"snapshot_risk", "train_rows", "label_cutoff", "exposed_from"} <= set(got.columns)


def test_a_steady_label_goes_with_no_feature(spark):
    got = selection.stable_top(rows(spark, 0).withColumn("b", F.lit(1.0)), "date", "y", ["a", "b"], 2).collect()
    assert [(r["feature"], r["stability"], r["position"]) for r in got] == [("b", 0.0, 1), ("a", 0.0, 2)]
