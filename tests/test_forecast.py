"""Forecasting against known values and series worked by hand."""

import math
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from ebbtide.operators import forecast as fc


def series(spark, named, start=date(2024, 1, 1)):
    rows = [(k, start + timedelta(days=i), float(v)) for k, vs in named.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "entity string, day date, v double")


WEEK = [70.0, 80.0, 90.0, 100.0, 110.0, 120.0, 130.0]
# worked by hand: the next value after four equal weeks, and after three and a doubled one
NEXT_FLAT = {
    "seasonal_naive_7": 70, "moving_average_7": 100, "moving_average_14": 100, "median_7": 100, "median_14": 100,
    "weekday_mean_8w": 70, "weekday_median_8w": 70, "weekly_trend_7": 70, "seasonal_level_blend": 82,
}
NEXT_DOUBLED = {
    "seasonal_naive_7": 140, "moving_average_7": 200, "moving_average_14": 150, "median_7": 200, "median_14": 135,
    "weekday_mean_8w": 87.5, "weekday_median_8w": 70, "weekly_trend_7": 166.95, "seasonal_level_blend": 138,
}


def wave(n, seed):
    return [abs(100 + 40 * math.sin(i * 2 * math.pi / 7 + seed) + ((i * 37 + seed * 11) % 29) - 10) for i in range(n)]


def states_of(spark, named):
    return fc.recent_states(fc.running_state(series(spark, named), ["entity"], "day", "v"), ["entity"], 7)


def test_next_values(spark):
    last = states_of(spark, {"flat": WEEK * 4, "doubled": WEEK * 3 + [2 * v for v in WEEK]}).where("n = length")
    assert set(fc.CANDIDATES) == set(NEXT_FLAT)
    for model in fc.CANDIDATES:
        path = fc.simulate(F.col("values"), F.col("top"), F.col("total"), F.col("n"), model, 1)
        got = {r["entity"]: r["p"][0] for r in last.select("entity", path.alias("p")).collect()}
        assert got == pytest.approx({"flat": NEXT_FLAT[model], "doubled": NEXT_DOUBLED[model]}), model


def test_a_naive_path_repeats_the_week(spark):
    path = fc.simulate(F.col("values"), F.col("top"), F.col("total"), F.col("n"), "seasonal_naive_7", 7)
    row = states_of(spark, {"a": WEEK * 4}).where("n = length").select(path.alias("p")).first()
    assert row["p"] == pytest.approx(WEEK)


def test_horizon_backtest_of_equal_weeks(spark):
    got = {r["model"]: r for r in fc.horizon_backtest(states_of(spark, {"a": (WEEK * 12)[:80]}), ["entity"], 7).collect()}
    # origins 28, 35, ..., 70
    for model in ("seasonal_naive_7", "weekday_mean_8w", "weekly_trend_7"):
        assert got[model]["folds"] == 7 and got[model]["total_wape"] == pytest.approx(0), model


def test_one_step_backtest_of_equal_weeks(spark):
    got = {r["model"]: r for r in fc.one_step_backtest(states_of(spark, {"a": WEEK * 10}), ["entity"]).collect()}
    assert got["seasonal_naive_7"]["mae"] == pytest.approx(0) and got["seasonal_naive_7"]["interval_error"] == pytest.approx(1)
    # distances from the mean 100: 30, 20, 10, 0, 10, 20, 30
    mean = got["moving_average_7"]
    assert mean["points"] == 42 and mean["mae"] == pytest.approx(120 / 7) and mean["interval_error"] == pytest.approx(30)


def test_known_series(spark):
    weekly = [80, 100, 120, 140, 160, 110, 90] * 12
    rising = [v * 1.01**w for w in range(10) for v in [100, 120, 140, 160, 180, 150, 130]]
    spike = [1000.0] * 63 + [10000.0] + [1000.0] * 6
    flat = [2500.0] * 70
    df = series(spark, {"weekly": weekly, "rising": rising, "spike": spike, "flat": flat, "short": [1.0] * 27})
    seven = fc.adaptive_forecast(df, ["entity"], "day", "v", 7).collect()
    assert {r["entity"] for r in seven} == {"weekly", "rising", "spike", "flat"}
    by = {}
    for r in seven:
        by.setdefault(r["entity"], []).append(r)
    assert all(len(v) == 7 for v in by.values())
    assert all(r["predicted"] == pytest.approx(2500) and r["wape"] == pytest.approx(0) for r in by["flat"])
    assert all(r["predicted"] >= 0 and r["lower"] >= 0 for r in seven)
    assert by["spike"][0]["points"] == 42
    assert 0 <= by["rising"][0]["wape"] < 1
    thirty = fc.adaptive_forecast(df.where("entity = 'weekly'"), ["entity"], "day", "v", 30).collect()
    assert len(thirty) == 30
    assert thirty[0]["model"] in {"seasonal_naive_7", "weekday_mean_8w", "weekday_median_8w", "weekly_trend_7"}
    assert thirty[0]["wape"] == pytest.approx(0) and thirty[0]["total_wape"] == pytest.approx(0)


def test_horizon_is_checked(spark):
    with pytest.raises(ValueError):
        fc.adaptive_forecast(series(spark, {"a": wave(40, 1)}), ["entity"], "day", "v", 14)


def test_local_calibration_known_values(spark):
    arrays = fc.history_arrays(series(spark, {"a": list(range(1, 41))}), ["entity"], "day", "v", 7)
    rows = fc.calibrate_to_local(arrays, ["entity"], fc.baseline_path("seasonal_naive_7", 7), 7).orderBy("date").collect()
    assert len(rows) == 7
    assert round(rows[0]["predicted"], 2) == 38.76
    assert round(rows[0]["lower"], 2) == 27.28
    assert round(rows[0]["upper"], 2) == 50.24


def test_thirty_day_calibration_has_all_days(spark):
    arrays = fc.history_arrays(series(spark, {"a": wave(90, 1)}), ["entity"], "day", "v", 30)
    rows = fc.calibrate_to_local(arrays, ["entity"], fc.baseline_path("moving_average_7", 30), 30).collect()
    assert len({r["date"] for r in rows}) == 30


def test_ridge_path(spark):
    values = wave(60, 5)
    model = fc.Ridge(["lag_1", "rolling_7", "std_7"], [0.0, 10.0, 0.0], [1.0, 2.0, 0.0], [0.4, 1.0, 0.1], 5.0)
    arrays = fc.history_arrays(series(spark, {"a": values}), ["entity"], "day", "v", 3)
    got = arrays.select(fc.baseline_path(model, 3).alias("p")).first()["p"]
    grown = list(values)
    for _ in range(3):
        week = grown[-7:]
        mean = sum(week) / 7
        std = math.sqrt(sum((x - mean) ** 2 for x in week) / 7)
        raw = 5.0 + 0.4 * grown[-1] + (mean - 10.0) / 2.0 + 0.1 * std
        ordered = sorted(grown)
        cap = max(4 * ordered[int((len(grown) - 1) * 0.995)], 10 * sum(grown) / len(grown), 1.0)
        grown.append(min(max(raw, 0.0), cap))
    assert got == pytest.approx(grown[-3:])


def test_walk_forward_equals_single_origins(spark):
    values = wave(84, 6)
    df = series(spark, {"a": values})
    daily, summary = fc.walk_forward(df, ["entity"], "day", "v", 7, step=7)
    rows = daily.collect()
    assert {r["origin"] for r in rows} == {56, 63, 70, 77}
    alone = fc.adaptive_forecast(df.where("day < date'2024-01-01' + 63"), ["entity"], "day", "v", 7).orderBy("date").collect()
    same = sorted((r for r in rows if r["origin"] == 63), key=lambda r: r["date"])
    assert [r["predicted"] for r in same] == pytest.approx([r["predicted"] for r in alone])
    assert summary.first()["origins"] == 4


def test_recent_change_needs_two_windows(spark):
    df = series(spark, {"a": [5.0] * 7 + [2.0] * 7, "b": [1.0] * 10})
    got = {r["entity"]: r for r in fc.recent_change(df, ["entity"], "day", "v").collect()}
    assert got["a"]["change_pct"] == pytest.approx(-60.0)
    assert got["b"]["previous_sales"] == 0 and got["b"]["change_pct"] == 0


def test_ridge_query_has_all_features():
    from ebbtide.plans import forecast_queries as queries

    lags, means = (1, 2, 3, 7, 14, 21, 28), (7, 14, 28)
    names = {*(f"lag_{k}" for k in lags), *(f"rolling_{k}" for k in means), "std_7", "std_14", "weekday_sin", "weekday_cos", "month_sin", "month_cos", "trend"}
    assert set(queries.RIDGE.features) == names and len(queries.RIDGE.features) == 17
    assert len(queries.RIDGE.mean) == len(queries.RIDGE.scale) == len(queries.RIDGE.coefficients) == 17


def test_walk_forward_query_has_both_horizons(spark, monkeypatch):
    from ebbtide.plans import base, forecast_queries as queries

    rows = [("a", date(2024, 1, 1) + timedelta(days=i), 100.0 + 10 * (i % 7)) for i in range(150)]
    df = spark.createDataFrame(rows, "entity string, date date, gross double")
    monkeypatch.setattr(base, "gross_days", lambda t: df)
    got = {x["horizon"]: x["origins"] for x in queries.walk_forward(None).collect()}
    assert set(got) == {7, 30} and got[7] > got[30] > 0
