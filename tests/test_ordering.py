"""Distributed ordered work against plain Python, with one hot value."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbtide.operators import history, ordering, policy
from ebbtide.operators.cleaning import quota_assign, stable_int


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    out = []
    for i in range(900):
        score = 0.5 if i % 3 == 0 else round(rnd.random(), 3)
        out.append((i % 2, f"e{i % 7}", i, score, int(rnd.random() < score)))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "g int, entity string, d int, score double, y int").withColumn(
        "date", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("d") / 3).cast("int"))
    )


def test_exact_quantiles_per_group(df, rows):
    qs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: r for r in ordering.exact_quantiles(df, "score", qs, ["g"]).collect()}
    for g in (0, 1):
        values = [r[3] for r in rows if r[0] == g]
        for q in qs:
            assert got[g][ordering.quantile_name(q)] == pytest.approx(np.quantile(values, q))


def test_quantile_grid(df, rows):
    qs = policy.even(0.02, 0.98, 31)
    assert ordering.quantile_grid(df, "score", qs) == pytest.approx(sorted(set(np.quantile([r[3] for r in rows], qs))))


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(df, rows, descending):
    got = ordering.running_totals(df, "score", {"n": F.lit(1), "pos": F.col("y")}, ["g"], descending).collect()
    for r in got:
        same = [x for x in rows if x[0] == r["g"]]
        upto = [x for x in same if (x[3] >= r["score"] if descending else x[3] <= r["score"])]
        assert r["cum_n"] == len(upto) and r["cum_pos"] == sum(x[4] for x in upto)
        assert r["total_n"] == len(same)


def test_positions_are_a_permutation(df):
    got = history.row_positions(df, "score", "date", "entity", ["g"]).orderBy("g", "position").collect()
    for g in (0, 1):
        part = [r for r in got if r["g"] == g]
        assert [r["position"] for r in part] == list(range(1, len(part) + 1))
        assert [r["score"] for r in part] == sorted(r["score"] for r in part)


def test_range_bucket_counts_cuts(spark):
    cuts = [0.1, 0.2, 0.5]
    d = spark.createDataFrame([(v,) for v in (0.05, 0.1, 0.15, 0.5, 0.9)], "v double")
    got = d.select(ordering.range_bucket(F.col("v"), cuts).alias("a"), ordering.range_bucket(F.col("v"), cuts, True).alias("b")).collect()
    assert [r["a"] for r in got] == [0, 1, 1, 3, 3]
    assert [r["b"] for r in got] == [0, 0, 1, 2, 3]


def test_quota_is_exact_and_in_hash_order(spark):
    keys = spark.range(1001).select((F.col("id") % 2).alias("year"), F.col("id").cast("string").alias("invoice"))
    got = quota_assign(keys, "invoice", "year", F.lit(0.62), "payment").withColumn(
        "h", stable_int(F.concat(F.lit("payment:"), "year", F.lit(":"), "invoice"), 10**15)
    )
    for year in (0, 1):
        part = sorted(got.where(f"year = {year}").collect(), key=lambda r: r["h"])
        chosen = [r["in_quota"] for r in part]
        assert sum(chosen) == round(0.62 * len(part))
        assert chosen == sorted(chosen, reverse=True)


def test_sweep_and_auc(df, rows):
    grid = policy.even(0.0, 1.0, 21)
    got = {round(r["threshold"], 6): r for r in policy.sweep(df, "y", "score", grid).collect()}
    for t in grid:
        r = got[round(t, 6)]
        assert r["tp"] == sum(1 for x in rows if x[4] == 1 and x[3] >= t)
        assert r["tn"] == sum(1 for x in rows if x[4] == 0 and x[3] < t)
    pos, neg = [x[3] for x in rows if x[4]], [x[3] for x in rows if not x[4]]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert policy.roc_auc(df, "y", "score").first()["roc_auc"] == pytest.approx(wins / (len(pos) * len(neg)))
    one_class = df.where("y = 1")
    assert policy.roc_auc(one_class, "y", "score").first()["roc_auc"] is None


def test_bootstrap_is_repeatable(df):
    a = policy.bootstrap_ci(df, "y", "score", F.col("score") >= 0.5, 50).orderBy("metric").collect()
    b = policy.bootstrap_ci(df.repartition(7), "y", "score", F.col("score") >= 0.5, 50).orderBy("metric").collect()
    assert a == b
    assert all(r["low"] <= r["high"] for r in a)


def test_each_large_group_has_its_own_ranges(spark, monkeypatch):
    """Features of very different magnitude are cut as evenly as one alone."""
    monkeypatch.setattr(ordering, "GROUP_VALUES", 200)
    d = spark.range(600).select(F.explode(F.array(*[F.struct(F.lit(f"f{k}").alias("feature"), (F.col("id") * 10.0**k).alias("value")) for k in (-6, 0, 6)])).alias("x")).select("x.*")
    small = spark.range(150).select(F.lit("small").alias("feature"), F.col("id").cast("double").alias("value"))
    nameless = spark.range(300).select(F.lit(None).cast("string").alias("feature"), F.col("id").cast("double").alias("value"))
    ranged = ordering.own_ranges(d.unionByName(small).unionByName(nameless), "value", ["feature"], 64)
    per = {r["feature"]: (r["k"], r["most"]) for r in ranged.groupBy("feature", "_range").count().groupBy("feature").agg(F.count("*").alias("k"), F.max("count").alias("most")).collect()}
    assert per["small"] == (1, 150)
    assert per["f-6"] == per["f0"] == per["f6"] and per["f0"][0] == 64 and per["f0"][1] <= 20
    assert per[None][0] > 60
    q = {r["feature"]: (r["n"], r["q50"]) for r in ordering.exact_quantiles(d.unionByName(small), "value", [0.5], ["feature"]).collect()}
    assert q["f0"] == (600, 299.5) and q["f6"] == (600, 299.5e6) and q["small"] == (150, 74.5)


def test_positions_when_most_scores_tie(spark):
    """Ties are numbered over several ranges, by day and entity."""
    d = spark.range(2000).select(
        F.when(F.col("id") % 10 == 0, F.col("id") / 2000).otherwise(0.5).alias("score"), F.lit("2024-01-01").cast("date").alias("day"),
        F.format_string("e%05d", F.pmod(F.col("id") * 7919, F.lit(2000))).alias("entity"), (F.col("id") % 2).alias("fold"),
    )
    got = history.row_positions(d, "score", "day", "entity", ["fold"]).collect()
    for fold in (0, 1):
        rows = sorted((r["score"], r["entity"], r["position"], r["group_rows"]) for r in got if r["fold"] == fold)
        assert [r[2] for r in rows] == list(range(1, 1001)) and {r[3] for r in rows} == {1000}
