"""Explanation, rankings, options and the result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbtide.operators import explain
from ebbtide.plans.base import SALES
from ebbtide.plans.join_queries import run_table
from ebbtide.plans.policy_queries import REG, regimes
from ebbtide.plans.registry import query
from ebbtide.sources import sinks

COLS = ("sale_date", "transaction_number", "transaction_type", "customer_key", "quantity", "net_sales", "discount_amount", "channel", "product_name")


def tagged(t, by=()):
    return explain.with_period(t.sales(*COLS, *by), 7, by, t.sales("sale_date", "transaction_type"))


TAGGED = f"""{SALES}, tg AS (SELECT *, CASE WHEN sale_date > l - 7 THEN 'current' WHEN sale_date > l - 14 THEN 'previous' END AS period
   FROM (SELECT *, max(sale_date) OVER (PARTITION BY region) AS l FROM sales)), tp AS (SELECT * FROM tg WHERE period IS NOT NULL)"""
TOTALS = """tt AS (SELECT region, period, sum(net_sales) AS sales, sum(quantity) AS quantity, count(DISTINCT transaction_number) AS transactions, sum(abs(discount_amount)) AS discounts,
   count(DISTINCT customer_key) AS customers, CAST(sum(net_sales) AS DOUBLE) / count(DISTINCT transaction_number) AS basket FROM tp GROUP BY 1, 2)"""
DIMS = """dm AS (SELECT region, 'channel' AS dim, channel AS name, sum(net_sales) FILTER (period = 'current') AS c, sum(net_sales) FILTER (period = 'previous') AS p FROM tp GROUP BY 1, 2, 3
   UNION ALL SELECT region, 'product', product_name, sum(net_sales) FILTER (period = 'current'), sum(net_sales) FILTER (period = 'previous') FROM tp GROUP BY 1, 2, 3),
 dz AS (SELECT region, dim, name, coalesce(c, 0) AS current, coalesce(p, 0) AS previous FROM dm),
 td AS (SELECT *, previous - current AS drop_amount, CAST(current - previous AS DOUBLE) / abs(CAST(previous AS DOUBLE)) * 100 AS change_pct,
   row_number() OVER (PARTITION BY region, dim ORDER BY previous - current DESC, name) AS k FROM dz WHERE previous > 0 AND previous - current > 0)"""


@query(
    "period_totals",
    "region:s period:s sales:f4 quantity:f4 transactions:i discounts:f4 customers:i basket:f4",
    f"WITH {TAGGED}, {TOTALS} SELECT * FROM tt",
)
def period_totals(t):
    return explain.period_totals(tagged(t, ["region"]), ["region"])


@query(
    "period_by_dimension",
    "region:s name:s current:f4 previous:f4",
    f"WITH {TAGGED}, {DIMS} SELECT region, name, current, previous FROM dz WHERE dim = 'channel'",
)
def period_by_dimension(t):
    return explain.period_by_dimension(tagged(t, ["region"]), "channel", ["region"])


@query(
    "top_decliner",
    "region:s name:s current:f4 previous:f4 drop_amount:f4 change_pct:f",
    f"WITH {TAGGED}, {DIMS} SELECT region, name, current, previous, drop_amount, change_pct FROM td WHERE dim = 'product' AND k = 1",
)
def top_decliner(t):
    return explain.top_decliner(explain.period_by_dimension(tagged(t, ["region"]), "product_name", ["region"]), ["region"])


DRIVERS = f"""{TAGGED}, {TOTALS}, {DIMS}, w AS (SELECT region, max(CAST(quantity AS DOUBLE)) FILTER (period = 'current') AS qc, max(CAST(quantity AS DOUBLE)) FILTER (period = 'previous') AS qp,
   max(CAST(customers AS DOUBLE)) FILTER (period = 'current') AS uc, max(CAST(customers AS DOUBLE)) FILTER (period = 'previous') AS up, max(CAST(transactions AS DOUBLE)) FILTER (period = 'current') AS tc,
   max(CAST(transactions AS DOUBLE)) FILTER (period = 'previous') AS tpv, max(basket) FILTER (period = 'current') AS bc, max(basket) FILTER (period = 'previous') AS bp FROM tt GROUP BY 1),
 sg AS (SELECT region, 'quantity_decline' AS code, qc AS current, qp AS previous, 1.15 AS wt, 1e9 AS cap FROM w UNION ALL SELECT region, 'active_customer_decline', uc, up, 1.10, 1e9 FROM w WHERE up > 0
   UNION ALL SELECT region, 'transaction_decline', tc, tpv, 1.0, 1e9 FROM w WHERE tc > 0 UNION ALL SELECT region, 'basket_decline', bc, bp, 1.05, 1e9 FROM w WHERE bp > 0
   UNION ALL SELECT region, dim || '_decline', CAST(current AS DOUBLE), CAST(previous AS DOUBLE), CASE dim WHEN 'channel' THEN 0.92 ELSE 0.88 END, 100 FROM td WHERE k = 1),
 ch AS (SELECT *, CASE WHEN abs(previous) < 1e-9 THEN 0 ELSE (current - previous) / abs(previous) * 100 END AS change_pct FROM sg),
 sc AS (SELECT *, CAST(least(cap, abs(change_pct)) * wt AS DOUBLE) AS score FROM ch WHERE change_pct <= -2), rk AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY score DESC, code) AS driver_rank FROM sc),
 kp AS (SELECT *, score / sum(score) OVER (PARTITION BY region) * 100 AS strength FROM rk WHERE driver_rank <= 4)"""


@query(
    "rank_drivers",
    "region:s code:s driver_rank:i current:f4 previous:f4 change_pct:f score:f strength_pct:f1 severity:s",
    f"""WITH {DRIVERS} SELECT region, code, driver_rank, current, previous, change_pct, score, round(strength, 1) AS strength_pct,
   CASE WHEN -change_pct >= 25 THEN 'high' WHEN -change_pct >= 10 THEN 'medium' ELSE 'low' END AS severity FROM kp""",
)
def rank_drivers(t):
    return explain.rank_drivers(explain.decline_signals(tagged(t, ["region"]), ["region"]), ["region"])


_SUMMARIES = {
    "quantity_decline": "printf('Sold units fell from %.0f to %.0f.', previous, current)",
    "active_customer_decline": "printf('Active customers fell from %.0f to %.0f.', previous, current)",
    "transaction_decline": "printf('Transactions fell from %.0f to %.0f.', previous, current)",
    "basket_decline": "printf('Average transaction value fell from %.2f to %.2f.', previous, current)",
    "channel_decline": "cn.name || printf(' had the largest channel-value drop: %.2f → %.2f.', previous, current)",
    "product_decline": "printf('This product had the largest value decline: %.2f → %.2f.', previous, current)",
}


def _by_code(texts: dict[str, str]) -> str:
    return "CASE code " + " ".join(f"WHEN '{code}' THEN {sql}" for code, sql in texts.items()) + " END"


@query(
    "driver_text",
    "region:s code:s driver_rank:i summary:s action:s",
    f"""WITH {DRIVERS}, cn AS (SELECT region, name FROM td WHERE dim = 'channel' AND k = 1)
 SELECT kp.region, code, driver_rank, {_by_code(_SUMMARIES)} AS summary, {_by_code({k: "'" + v + "'" for k, v in explain.ACTIONS.items()})} AS action FROM kp LEFT JOIN cn ON cn.region = kp.region""",
)
def driver_text(t):
    ranked = explain.rank_drivers(explain.decline_signals(tagged(t, ["region"]), ["region"]), ["region"])
    return explain.driver_text(ranked)


@query(
    "filter_options",
    "option:s value:s",
    f"WITH {SALES} SELECT DISTINCT 'channel' AS option, channel AS value FROM sales UNION SELECT DISTINCT 'category', category FROM sales UNION SELECT DISTINCT 'product_name', product_name FROM sales",
)
def filter_options(t):
    d = explain.filter_options(t.sales("channel", "category", "product_name"), ["channel", "category", "product_name"])
    return d.withColumnRenamed("filter", "option")


ALERTS = """al AS (SELECT o_orderkey AS alert_id, o_orderstatus = 'F' AS is_resolved, o_orderdate AS created_at, o_custkey AS run_id, o_totalprice AS risk FROM orders)"""


def alert_table(t):
    """Orders read as an alert log: status F is resolved, the customer is the run."""
    return t.read("orders").select(
        F.col("o_orderkey").alias("alert_id"),
        F.col("o_orderkey").alias("forecast_id"),
        (F.col("o_orderstatus") == "F").alias("is_resolved"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_custkey").alias("run_id"),
        F.col("o_totalprice").alias("risk"),
    )


@query(
    "recent_active_alerts",
    "alert_id:i risk:f2",
    f"WITH {ALERTS} SELECT alert_id, risk FROM al WHERE NOT is_resolved ORDER BY created_at DESC, alert_id DESC LIMIT 100",
)
def recent_active_alerts(t):
    return explain.recent(alert_table(t), "created_at", 100, ~F.col("is_resolved"), "alert_id")


@query(
    "recent_runs",
    "run_id:i status:s",
    """SELECT o_orderkey AS run_id, CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'completed' END AS status FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 30""",
)
def recent_runs(t):
    return explain.recent(run_table(t), "completed_at", 30, tie="run_id")


def _run_parts(t):
    a = alert_table(t)
    return a.drop("run_id"), a.select("forecast_id", "run_id")


@query(
    "open_alert_count",
    "active_alerts:i",
    f"WITH {ALERTS} SELECT count(*) AS active_alerts FROM al WHERE run_id = 7 AND NOT is_resolved",
)
def open_alert_count(t):
    return explain.latest_state_summary(*_run_parts(t), 7)[0]


@query(
    "newest_alerts_of_run",
    "alert_id:i",
    f"WITH {ALERTS} SELECT alert_id FROM al WHERE run_id = 7 AND NOT is_resolved ORDER BY created_at DESC, alert_id DESC LIMIT 5",
)
def newest_alerts_of_run(t):
    return explain.latest_state_summary(*_run_parts(t), 7)[1]


_FEATURES = ("score", "score_b", "score_c", "r", "merchant_mean", "merchant_disagreement", "market_p90")


@query(
    "stable_top",
    "feature:s stability:f position:i",
    f"""WITH {REG}, n AS (SELECT *, CASE WHEN date >= (SELECT quantile_disc(date, 0.45) FROM rf) THEN 1 ELSE 0 END AS late FROM rf), l AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature, {f} AS v, y, late FROM n" for f in _FEATURES)}),
 c AS (SELECT feature, 0.65 * coalesce(abs(corr(v, y)), 0) + 0.35 * coalesce(abs(corr(v, y) FILTER (late = 1)), 0) AS stability FROM l GROUP BY 1)
 SELECT *, row_number() OVER (ORDER BY stability DESC, feature DESC) AS position FROM c ORDER BY position LIMIT 5""",
)
def stable_top(t):
    from ebbtide.operators.selection import stable_top as build

    return build(regimes(t), "date", "y", _FEATURES, 5)


@query(
    "export_forecast",
    "date:d predicted_sales:f2 lower_bound:f2 upper_bound:f2 decline_probability:f",
    f"""WITH {SALES} SELECT sale_date AS date, sum(list_amount) AS predicted_sales, min(list_amount) AS lower_bound, max(list_amount) AS upper_bound, 0.25 AS decline_probability FROM sales WHERE category = 'PROMO' GROUP BY 1""",
)
def export_forecast(t):
    days = t.sales("sale_date", "category", "list_amount").groupBy(F.col("category").alias("run_id"), F.col("sale_date").alias("forecast_date")).agg(
        F.sum("list_amount").alias("predicted_sales"), F.min("list_amount").alias("lower_bound"), F.max("list_amount").alias("upper_bound")
    )
    return sinks.export_forecast(days.withColumn("decline_probability", F.lit(0.25)), "PROMO")
