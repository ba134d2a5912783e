"""Calibration counts, choice of levels, resampling and the weekly forecaster against plain versions."""

import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbtide.operators import ml, policy


def week_rows(seed, n, weeks=30, scores=40):
    r = random.Random(seed)
    start = date(2020, 1, 5)
    return [(r.choice("abc"), start + timedelta(days=7 * r.randrange(weeks)), r.choice([0, 1, 1]) if r.random() < 0.9 else 0, r.randrange(scores) / scores) for _ in range(n)]


@pytest.mark.parametrize("scores", [1, 2, 13])
def test_past_counts(spark, scores):
    rows = week_rows(scores, 150, 12, scores)
    df = spark.createDataFrame([*rows, ("a", date(2020, 1, 5), 1, None)], "entity string, week date, y int, score double")
    y = F.col("y") == 1
    for by in ([], ["entity"]):
        got = policy._past_counts(df, "week", "score", by, 4, {"neg": (~y, True), "pos": (y, False)}).collect()
        assert len(got) == len({(*[x[0]] * len(by), x[1], x[3]) for x in rows})
        for g in got:
            for ever in ("", "_ever"):
                past = [x for x in rows if x[1] < g["week"] and (not by or x[0] == g["entity"]) and (ever or x[1] >= g["week"] - timedelta(days=28))]
                neg, pos = [x[3] for x in past if x[2] == 0], [x[3] for x in past if x[2] == 1]
                assert (g[f"neg_n{ever}"], g[f"pos_n{ever}"]) == (len(neg), len(pos))
                assert g[f"neg_extreme{ever}"] == sum(v >= g["score"] for v in neg)
                assert g[f"pos_extreme{ever}"] == sum(v <= g["score"] for v in pos)


def test_conformal_falls_back_to_all_history(spark):
    start = date(2020, 1, 5)
    rows = [(f"e{i % 3}", start + timedelta(days=7 * (i // 10)), i % 4 == 0, (i * 7 % 10) / 10) for i in range(100)]
    rows += [("e0", start + timedelta(days=7 * 60), False, 0.9), ("e1", start + timedelta(days=7 * 60), False, None)]
    df = spark.createDataFrame([(e, w, int(y), s) for e, w, y, s in rows], "entity string, week date, y int, score double")
    got = policy.conformal_state(df, "entity", "week", "y", "score", weeks=8, min_negatives=20, min_positives=5)
    kinds = {r["week"]: r["calibration"] for r in got.where("score is not null").collect()}
    assert kinds[start] == "none" and kinds[start + timedelta(days=7 * 5)] == "window" and kinds[start + timedelta(days=7 * 60)] == "all"
    late = {r["entity"]: r for r in got.where(F.col("week") == F.lit(start + timedelta(days=7 * 60))).collect()}
    neg = [s for _, w, y, s in rows[:100] if not y]
    assert late["e0"]["p_market"] == pytest.approx((1 + sum(s >= 0.9 for s in neg)) / (1 + len(neg)))
    assert (late["e1"]["state"], late["e1"]["calibration"], late["e1"]["p_market"]) == ("AMBER", "none", None)
    with pytest.raises(ValueError, match="too little history"):
        policy.require_calibration(got, "week", "2020-01-05")
    assert policy.require_calibration(got.where("score is not null"), "week", "2020-02-23").count() == 31


def test_conformal_alphas(spark):
    r = random.Random(2)
    rows = [(r.random() ** 2, r.random(), r.random(), int(r.random() < 0.3)) for _ in range(300)] + [(None, None, None, 1)]
    df = spark.createDataFrame(rows, "p_market double, p_entity double, p_decline double, y int")
    got = policy.conformal_alphas(df, "y", 0.2, 0.2, 0.5, 0.6).orderBy("rank").collect()
    assert len(got) == 7 * 6 * 14 and [g["rank"] for g in got] == list(range(1, len(got) + 1))
    for g in got[:5] + got[-5:]:
        red = [x for x in rows if x[0] is not None and x[0] <= g["red_market"] and x[1] <= g["red_entity"]]
        green = [x for x in rows if x not in red and x[2] is not None and x[2] <= g["green"]]
        assert (g["rows"], g["red"], g["red_hits"], g["green_rows"], g["green_misses"]) == (301, len(red), sum(x[3] for x in red), len(green), sum(x[3] for x in green))
    passing = [g for g in got if g["passes"]]
    assert passing and got[: len(passing)] == passing
    assert passing[0]["red_recall"] == max(g["red_recall"] for g in passing)


def test_resampled_metrics_equal_repeated_rows():
    r = np.random.default_rng(5)
    s, p = np.sort(np.repeat(np.arange(6.0), 4)), np.tile([True, True, False, False], 6)
    a = np.tile([True, False], 12)
    w = r.poisson(3, 24)
    got = dict(zip(policy.BOOTSTRAP_METRICS, policy.resampled_metrics(s, p, a, w), strict=True))
    S, P, A = (np.repeat(x, w) for x in (s, p, a))
    wins = sum((x > v) + 0.5 * (x == v) for x in S[P] for v in S[~P])
    assert got["roc_auc"] == pytest.approx(wins / (P.sum() * (~P).sum()))
    ap = sum(P[S >= x].mean() for x in S[P]) / P.sum()
    assert got["pr_auc"] == pytest.approx(ap)
    assert got["precision"] == pytest.approx((P & A).sum() / A.sum()) and got["npv"] == pytest.approx((~P & ~A).sum() / (~A).sum())
    assert np.isnan(policy.resampled_metrics(s, p, a, np.zeros(24))[5:]).all()


def test_bootstrap_interval_width(spark):
    df = spark.range(4000).select((F.col("id") % 4 == 0).cast("int").alias("y"), (F.col("id") % 100 / 100).alias("score"))
    got = {r["metric"]: r for r in policy.bootstrap_ci(df, "y", "score", F.col("score") >= 0.5, 400).collect()}
    assert set(got) == set(policy.BOOTSTRAP_METRICS) and all(r["n"] == 400 for r in got.values())
    spread = (got["alert_rate"]["high"] - got["alert_rate"]["low"]) / (2 * 1.96)
    assert spread == pytest.approx((0.25 / 4000) ** 0.5, rel=0.25)
    wide = spark.range(4000).select((F.col("id") % 4 == 0).cast("int").alias("y"), (F.col("id") / 4000).alias("score"))
    assert policy.bootstrap_ci(wide, "y", "score", F.col("score") >= 0.5, 40, ranges=50).count() == 7
    none = policy.bootstrap_ci(df.limit(0), "y", "score", F.col("score") >= 0.5, 10).collect()
    assert {r["metric"] for r in none} == set(policy.BOOTSTRAP_METRICS[:5])


def test_weekly_forecaster_equals_direct_solves(spark):
    r = np.random.default_rng(1)
    start, inputs, targets = date(2020, 1, 5), ("a", "b", "c", "flat"), ("value_h1", "count_h2")
    rows = []
    for e in "xyz":
        for i in range(40):
            a, b = r.normal(5, 1), r.normal(100, 0.1)
            rows.append((e, start + timedelta(days=7 * i), a, b, a + r.normal(), 2.0, float(a + 3 * b + r.normal()) if i < 39 else None, float(b - a) if i < 38 else None))
    rows.append(("x", start, None, 1.0, 1.0, 1.0, 1.0, 1.0))
    df = spark.createDataFrame(rows, "entity string, week date, a double, b double, c double, flat double, value_h1 double, count_h2 double").repartition(5)
    got = ml.walk_forward_market_forecast(df, "week", alpha=0.5, min_rows=20, inputs=inputs, targets=targets).collect()
    assert len(got) == 120
    full = [x for x in rows if x[2] is not None]
    for g in got:
        for k, (t, h) in enumerate((("value_h1", 1), ("count_h2", 2))):
            known = [x for x in full if x[6 + k] is not None and x[1] + timedelta(days=7 * h) <= g["week"]]
            assert g[f"train_h{h}"] == len(known)
            if len(known) < 20:
                assert g[f"predicted_{t}"] is None
                continue
            if g["week"].day > 10:
                continue
            x, y = np.array([q[2:6] for q in known], float), np.array([q[6 + k] for q in known])
            mean, scale = x.mean(0), x.std(0)
            z = (x - mean) / np.where(scale > 0, scale, 1)
            w = np.linalg.solve(z.T @ z + 0.5 * np.eye(4), z.T @ (y - y.mean()))
            want = y.mean() + ((np.array([g[c] for c in inputs]) - mean) / np.where(scale > 0, scale, 1)) @ w
            assert np.log1p(g[f"predicted_{t}"]) == pytest.approx(max(want, 0), rel=1e-6)
