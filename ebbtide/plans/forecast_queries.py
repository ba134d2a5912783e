"""Forecasting per category or channel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbtide.operators import analysis, forecast, policy
from ebbtide.operators.ordering import settle
from ebbtide.plans import base
from ebbtide.plans.base import panel_sql
from ebbtide.plans.registry import query
from ebbtide.plans.window_queries import frame, lag

KEY = ["entity"]


def states(t, horizon=7):
    running = forecast.running_state(base.gross_days(t), KEY, "date", "gross")
    return settle(forecast.recent_states(running, KEY, horizon))


_P7, _P14, _PAST = frame(-7, -1), frame(-14, -1), "(PARTITION BY entity ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_SAME = "list_filter([" + ", ".join(lag("v", k) for k in range(7, 57, 7)) + "], lambda x: x IS NOT NULL)"
_MODELS = {
    "seasonal_naive_7": "s7",
    "moving_average_7": "m7",
    "moving_average_14": "m14",
    "median_7": "d7",
    "median_14": "d14",
    "weekday_mean_8w": "list_avg(same)",
    "weekday_median_8w": "list_median(same)",
    "seasonal_level_blend": "0.6 * s7 + 0.4 * d14",
    "weekly_trend_7": "s7 * least(1.2, greatest(0.8, CASE WHEN p7 <= 0 THEN 1 ELSE 1 + 0.55 * (least(1.35, greatest(0.65, r7 / p7)) - 1) END))",
}
ONE_STEP = f"""{panel_sql()}, h AS (SELECT entity, date, greatest(gross, 0) AS v FROM panel),
 x AS (SELECT entity, date, v, row_number() OVER (PARTITION BY entity ORDER BY date) AS i, count(*) OVER (PARTITION BY entity) AS len, {lag('v', 7)} AS s7, avg(v) OVER {_P7} AS m7, avg(v) OVER {_P14} AS m14,
   quantile_cont(v, 0.5) OVER {_P7} AS d7, quantile_cont(v, 0.5) OVER {_P14} AS d14, {_SAME} AS same, sum(v) OVER {_P7} AS r7, sum(v) OVER {frame(-14, -8)} AS p7,
   greatest(3 * max(v) OVER {_PAST}, 8 * avg(v) OVER {_PAST}, 1) AS cap FROM h),
 o AS (SELECT * FROM x WHERE len >= 28 AND i - 1 >= greatest(14, len - 42)),
 e AS ({' UNION ALL '.join(f"SELECT entity, date, '{m}' AS model, v AS actual, least(greatest({q}, 0), cap) AS predicted FROM o" for m, q in _MODELS.items())}),
 m AS (SELECT entity, model, count(*) AS points, avg(abs(actual - predicted)) AS mae, sqrt(avg((actual - predicted) * (actual - predicted))) AS rmse,
   sum(abs(actual - predicted)) / greatest(sum(abs(actual)), 1e-9) AS wape, avg(CASE WHEN abs(actual) + abs(predicted) > 0 THEN 2 * abs(actual - predicted) / (abs(actual) + abs(predicted)) ELSE 0 END) AS smape FROM e GROUP BY 1, 2)"""


@query(
    "one_step_errors",
    "entity:s day:d model:s actual:f4 predicted:f1",
    f"WITH {ONE_STEP} SELECT entity, date - 1 AS day, model, actual, predicted FROM e",
)
def one_step_errors(t):
    return forecast.one_step_errors(states(t), KEY)


@query(
    "forecast_metrics",
    "entity:s model:s points:i mae:f1 rmse:f1 wape:f smape:f",
    f"WITH {ONE_STEP} SELECT * FROM m",
)
def forecast_metrics(t):
    return forecast.forecast_metrics(forecast.one_step_errors(states(t), KEY), "actual", "predicted", [*KEY, "model"])


@query(
    "one_step_backtest",
    "entity:s model:s points:i wape:f interval_error:f1",
    f"""WITH {ONE_STEP}, r AS (SELECT entity, model, list_sort(list(abs(actual - predicted))) AS l FROM e GROUP BY 1, 2), k AS (SELECT *, (len(l) - 1) * 0.9 AS x FROM r)
 SELECT entity, model, points, wape, greatest(1, l[CAST(CASE WHEN x - floor(x) = 0.5 THEN 2 * round(x / 2) ELSE round(x) END AS INTEGER) + 1]) AS interval_error FROM m JOIN k USING (entity, model)""",
)
def one_step_backtest(t):
    return forecast.one_step_backtest(states(t), KEY)


@query(
    "select_model",
    "entity:s model:s wape:f mae:f1",
    f"WITH {ONE_STEP}, k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY wape, mae, model) AS k FROM m) SELECT entity, model, wape, mae FROM k WHERE k = 1",
)
def select_model(t):
    one = forecast.one_step_backtest(states(t), KEY)
    return forecast.select_model(one.withColumn("total_wape", F.lit(None).cast("double")), KEY)


@query("horizon_backtest", "entity:s model:s total_wape:f folds:i")
def horizon_backtest(t):
    return forecast.horizon_backtest(states(t), KEY, 7)


_COLS = "entity:s date:d model:s predicted:f1 lower:f1 upper:f1 baseline:f1 decline_percent:f"


@query("adaptive_forecast_7", _COLS)
def adaptive_forecast_7(t):
    return forecast.adaptive_forecast(base.gross_days(t), KEY, "date", "gross", 7)


@query("adaptive_forecast_30", _COLS)
def adaptive_forecast_30(t):
    return forecast.adaptive_forecast(base.gross_days(t), KEY, "date", "gross", 30)


@query(
    "naive_path",
    "entity:s step:i predicted:f4",
    f"""WITH {panel_sql()}, r AS (SELECT entity, gross, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS k FROM panel)
 SELECT entity, w * 7 + 8 - k AS step, gross AS predicted FROM r, (SELECT unnest([0, 1, 2]) AS w) WHERE k <= 7""",
)
def naive_path(t):
    last = states(t).where("n = length")
    path = forecast.simulate(F.col("values"), F.col("top"), F.col("total"), F.col("n"), "seasonal_naive_7", 21)
    return last.select("entity", F.posexplode(path).alias("i", "predicted")).withColumn("step", F.col("i") + 1)


@query("baseline_forecast", "model:s entity:s step:i predicted:f1")
def baseline_forecast(t):
    arrays = settle(forecast.history_arrays(base.gross_days(t), KEY, "date", "gross", 30))
    out = None
    for model in ("seasonal_naive_7", "moving_average_7", "moving_average_14", "median_7"):
        path = arrays.select("entity", F.posexplode(forecast.baseline_path(model, 30)).alias("i", "predicted"))
        one = path.select(F.lit(model).alias("model"), "entity", (F.col("i") + 1).alias("step"), "predicted")
        out = one if out is None else out.union(one)
    return out


RIDGE = forecast.Ridge(
    features=["lag_1", "lag_2", "lag_3", "lag_7", "lag_14", "lag_21", "lag_28", "rolling_7", "rolling_14", "rolling_28", "std_7", "std_14",
              "weekday_sin", "weekday_cos", "month_sin", "month_cos", "trend"],
    mean=[1e5, 1e5, 1e5, 1e5, 1e5, 1e5, 1e5, 1e5, 1e5, 1e5, 5e4, 5e4, 0.0, 0.0, 0.0, 0.0, 1000.0],
    scale=[5e4, 5e4, 5e4, 5e4, 5e4, 5e4, 5e4, 2e4, 1.5e4, 1e4, 2e4, 2e4, 0.7, 0.7, 0.7, 0.7, 700.0],
    coefficients=[2e3, 1e3, 1e3, 6e3, 3e3, 2e3, 2e3, 4e3, 3e3, 6e3, -5e2, -3e2, 1e3, 1e3, 5e2, 5e2, 1e2],
    intercept=1e5,
)


@query("ridge_forecast", "entity:s step:i predicted:f1")
def ridge_forecast(t):
    arrays = forecast.history_arrays(base.gross_days(t), KEY, "date", "gross", 30)
    return arrays.select("entity", F.posexplode(forecast.baseline_path(RIDGE, 30)).alias("i", "predicted")).withColumn("step", F.col("i") + 1)


_A, _B = "(array_slice(v, len - 6, len))", "(array_slice(v, len - 13, len - 7))"


@query(
    "calibrate_to_local",
    "entity:s date:d predicted:f1 lower:f1 upper:f1 baseline:f1 decline_probability:f",
    f"""WITH {panel_sql()}, g AS (SELECT entity, list(gross ORDER BY date) AS v, count(*) AS len, max(date) AS d FROM panel GROUP BY 1),
 s AS (SELECT *, list_sum({_A}) AS r7, list_sum({_B}) AS p7, list_avg(array_slice(v, len - 27, len)) AS baseline, list_transform(range(28), lambda k: v[len - k] - v[len - k - 7]) AS df FROM g),
 c AS (SELECT *, CASE WHEN p7 <= 0 THEN 1 ELSE least(1.24, greatest(0.76, 1 + 0.6 * (least(1.4, greatest(0.6, r7 / p7)) - 1))) END AS tf,
   greatest(list_stddev_pop(df), list_avg(list_transform(df, lambda x: abs(x))), 1) AS err FROM s),
 w AS (SELECT *, unnest([0, 1, 2, 3, 4]) AS wk FROM c), z AS (SELECT *, CASE WHEN wk = 4 THEN 2 ELSE 7 END AS sz, least(1.12, greatest(0.88, 1 + 0.35 * (tf - 1))) AS gr FROM w),
 y AS (SELECT *, unnest(range(1, sz + 1)) AS i FROM z),
 q AS (SELECT entity, d + CAST(wk * 7 + i AS INTEGER) AS date, r7 * tf * pow(gr, wk) * sz / 7.0 * v[len - 7 + i] / list_sum(array_slice(v, len - 6, len - 7 + sz)) AS predicted, err, baseline FROM y)
 SELECT entity, date, predicted, greatest(0, predicted - 1.64 * err) AS lower, predicted + 1.64 * err AS upper, baseline, 1 / (1 + exp(-greatest(-20, least(20, (baseline - predicted) / err)))) AS decline_probability FROM q""",
)
def calibrate_to_local(t):
    arrays = forecast.history_arrays(base.gross_days(t), KEY, "date", "gross", 30)
    return forecast.calibrate_to_local(arrays, KEY, forecast.baseline_path("seasonal_naive_7", 30), 30)


@query("walk_forward", "horizon:i origins:i daily_wape:f naive_daily_wape:f total_wape:f naive_total_wape:f interval_coverage:f wins:i losses:i")
def walk_forward(t):
    week, month = (forecast.walk_forward(base.gross_days(t), KEY, "date", "gross", h)[1].withColumn("horizon", F.lit(h)) for h in (7, 30))
    return week.unionByName(month)


@query(
    "recent_change",
    "entity:s current_sales:f4 previous_sales:f4 change_pct:f decline_pct:f",
    f"""WITH {panel_sql()}, l AS (SELECT *, max(date) OVER (PARTITION BY entity) AS d FROM panel),
 s AS (SELECT entity, sum(sales) FILTER (date > d - 7) AS current_sales, sum(sales) FILTER (date > d - 14 AND date <= d - 7) AS previous_sales FROM l GROUP BY 1)
 SELECT *, (current_sales - previous_sales) / abs(previous_sales) * 100 AS change_pct, greatest(0, -(current_sales - previous_sales) / abs(previous_sales) * 100) AS decline_pct FROM s""",
)
def recent_change(t):
    return forecast.recent_change(base.day_panel(t, measures=("sales",)), KEY, "date", "sales")


@query(
    "horizon_change",
    "entity:s forecast_mean:f1 baseline:f1 predicted_change_pct:f predicted_decline_pct:f",
    f"""WITH {panel_sql()}, l AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS k FROM panel),
 s AS (SELECT entity, avg(gross) FILTER (k <= 7) AS forecast_mean, avg(gross) FILTER (k <= 28) AS baseline FROM l GROUP BY 1), c AS (SELECT *, (forecast_mean - baseline) / abs(baseline) * 100 AS predicted_change_pct FROM s)
 SELECT *, greatest(0, -predicted_change_pct) AS predicted_decline_pct FROM c""",
)
def horizon_change(t):
    last = states(t).where("n = length")
    path = forecast.simulate(F.col("values"), F.col("top"), F.col("total"), F.col("n"), "seasonal_naive_7", 7)
    base28 = F.aggregate(F.slice("values", -28, 28), F.lit(0.0), lambda a, x: a + x) / 28.0
    rows = last.select("entity", base28.alias("baseline"), F.explode(path).alias("predicted"))
    return forecast.horizon_change(rows, KEY)


@query(
    "quality_summary",
    "entity:s model:s accuracy_proxy_pct:f4 error_wape_pct:f4 daily_wape_pct:f4 horizon_total_wape_pct:f4",
    f"WITH {ONE_STEP} SELECT entity, model, greatest(0, least(100, (1 - wape) * 100)) AS accuracy_proxy_pct, greatest(0, wape * 100) AS error_wape_pct, greatest(0, wape * 100) AS daily_wape_pct, NULL AS horizon_total_wape_pct FROM m",
)
def quality_summary(t):
    one = forecast.one_step_backtest(states(t), KEY)
    return forecast.quality_summary(one.withColumn("total_wape", F.lit(None).cast("double")))


@query(
    "decline_quality",
    "entity:s correct_count:i wrong_count:i sample_size:i accuracy_pct:f error_pct:f",
    f"""WITH {base.scores_sql()}, c AS (SELECT entity, count(*) FILTER ((score >= 0.55) = (y = 1)) AS ok, count(*) AS n FROM scores GROUP BY 1)
 SELECT entity, ok AS correct_count, n - ok AS wrong_count, n AS sample_size, ok * 100.0 / n AS accuracy_pct, (n - ok) * 100.0 / n AS error_pct FROM c""",
)
def decline_quality(t):
    return forecast.decline_quality(policy.binary_metrics(base.scores(t), "y", F.col("score") >= 0.55, KEY))


def analysis_tables(t):
    sales = t.sales(
        "sale_date", "transaction_number", "transaction_type", "customer_key", "quantity", "net_sales", "discount_amount",
        "channel", "product_name", "category",
    )
    scored = policy.percentile_policy(base.scores(t), "entity", "date", "score", 0.55)
    risk = analysis.latest_risk(scored, "entity", "date", "score", "alert")
    return analysis.instant_analysis(sales, "category", risk, 7)


@query("instant_analysis", "table_name:s rows:i")
def instant_analysis(t):
    return analysis.row_counts(analysis_tables(t))


@query(
    "instant_analysis_runs",
    "entity:s horizon_days:i data_start:d data_end:d sample_size:i data_mode:s",
    f"""WITH {base.SALES} SELECT category AS entity, 7 AS horizon_days, min(sale_date) AS data_start, max(sale_date) AS data_end, max(sale_date) - min(sale_date) + 1 AS sample_size, 'transaction_level' AS data_mode FROM sales GROUP BY 1""",
)
def instant_analysis_runs(t):
    runs = analysis_tables(t)["model_runs"]
    return runs.withColumn("data_mode", F.get_json_object("filters_json", "$.data_mode"))
