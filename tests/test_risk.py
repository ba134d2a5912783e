"""The merchant risk engine against plain lists of one merchant's days."""

import math
import statistics
from datetime import date, timedelta

import pytest

from ebbtide.operators import risk

START = date(2023, 1, 1)


def merchant(spark, n, name="a", zero=range(0), customers=5):
    rows = []
    for i in range(n):
        sales = 0.0 if i in zero else 100.0 + 10 * math.sin(i) + (i % 7) * 5
        gross = sales + 3
        rows.append((name, START + timedelta(days=i), sales, gross, float(3 + i % 4), float(customers), 4.0, 6.0 + i % 5, sales / (3 + i % 4), 0.02 * (i % 3), 9.0))
    names = "entity string, date date, sales double, gross double, invoices double, customers double, products double, units double, avg_invoice double, return_rate double, transaction_rows double"
    return spark.createDataFrame(rows, names)


def artifact(spark):
    trees = [{"feature": [0, -1, -1], "threshold": [1.0, 0.0, 0.0], "left": [1, -1, -1], "right": [2, -1, -1], "p1": [0.0, 0.75, 0.25]}]
    bounds = spark.createDataFrame([("ma7_ma28", 0.5, 1.0, 1.5), ("market", 0.0, 5.0, 9.0)], "feature string, low double, median double, high double")
    return risk.forest_from(trees, spark), bounds


def test_features_of_a_day(spark):
    d = merchant(spark, 70)
    market = spark.createDataFrame([(START + timedelta(days=7 * k), 10.0 + k) for k in range(6)], "week_start date, market double")
    days = {r["date"]: r for r in risk.risk_features(d, market, "entity", "date").collect()}
    rows = sorted(d.collect(), key=lambda r: r["date"])
    r = days[START + timedelta(days=60)]
    sales = [x["sales"] for x in rows[:61]]
    for w in (7, 14, 28, 56):
        assert r[f"sales_ratio_{w}"] == pytest.approx(sales[-1] / statistics.mean(sales[-w:]))
        assert r[f"sales_z_{w}"] == pytest.approx((sales[-1] - statistics.mean(sales[-w:])) / statistics.stdev(sales[-w:]))
    assert r["customers_z_7"] is None  # no deviation
    assert r["sales_change_28"] == pytest.approx((sales[-1] - sales[-29]) / abs(sales[-29]))
    assert r["vol7_vol28"] == pytest.approx(statistics.stdev(sales[-7:]) / statistics.stdev(sales[-28:]))
    assert r["drawdown28"] == pytest.approx(sales[-1] / max(sales[-28:]) - 1)
    # Sunday 2023-02-26 is day 56; day 40 sees the week that began on day 28
    assert days[START + timedelta(days=40)]["market"] == 14.0 and r["market"] is None
    assert days[START + timedelta(days=42)]["market_change_1"] == pytest.approx(1 / 14)
    assert days[START + timedelta(days=27)]["salary_period"] == 1.0 and days[START + timedelta(days=50)]["founding_day_window"] == 1.0
    assert (days[START]["sales_ratio_7"], days[START]["history_days"]) == (None, 1)


def test_a_window_without_sales_has_full_drawdown(spark):
    days = {r["date"]: r for r in risk.risk_features(merchant(spark, 60, zero=range(20, 60)), None, "entity", "date").collect()}
    r = days[START + timedelta(days=59)]
    assert (r["drawdown28"], r["ma7_ma28"], r["market"]) == (-1.0, None, None)
    assert days[START + timedelta(days=20)]["drawdown28"] is None


def test_gate_and_assessment(spark):
    trees, bounds = artifact(spark)
    d = merchant(spark, 90).unionByName(merchant(spark, 55, "short")).unionByName(merchant(spark, 80, "anonymous", customers=0))
    days = risk.assess_days(d, None, trees, bounds, features=["ma7_ma28", "market"], warmup=10, lookback=20)
    got = {r["entity"]: r for r in risk.assess_risk(days).collect()}
    assert got["a"]["available"] and got["a"]["policy_mode"] == "causal_percentile" and not got["a"]["market_available"]
    assert not got["short"]["available"] and "found 55" in got["short"]["reason"] and got["short"]["score"] is None
    assert not got["anonymous"]["available"] and "identifiers" in got["anonymous"]["reason"]
    rows = sorted((r for r in days.where("entity = 'a'").collect()), key=lambda r: r["date"])
    assert [r["score"] is None for r in rows] == [True] * 55 + [False] * 35
    scores = [r["score"] for r in rows[55:]]
    for i, r in enumerate(rows[55:]):
        past = scores[max(0, i - 20) : i]
        if len(past) < 10:
            assert (r["policy_mode"], r["alert"], r["decision_threshold"]) == ("static", r["score"] >= 0.5, 0.5)
        else:
            pct = (sum(p < r["score"] for p in past) + 0.5 * sum(p == r["score"] for p in past)) / len(past)
            assert r["percentile"] == pytest.approx(pct) and r["alert"] == (pct >= 0.7)
    assert set(scores) == {0.25, 0.75}
