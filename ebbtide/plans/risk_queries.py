"""The merchant risk engine over the categories of the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbtide.operators import analysis, panels, policy, risk
from ebbtide.operators.ordering import settle
from ebbtide.plans import base
from ebbtide.plans.base import SALES
from ebbtide.plans.registry import query
from ebbtide.plans.window_queries import change, lag, roll

DAILY = f"""{SALES}, dr AS (SELECT category AS entity, sale_date AS date, CAST(sum(net_sales) AS DOUBLE) AS sales, CAST(sum(gross_sales) AS DOUBLE) AS gross,
   count(DISTINCT transaction_number) AS invoices, count(DISTINCT customer_key) AS customers, count(DISTINCT product_id) AS products, CAST(sum(abs(quantity)) AS DOUBLE) AS units,
   count(*) AS transaction_rows, CAST(abs(sum(least(net_sales, 0))) AS DOUBLE) AS return_value FROM sales GROUP BY 1, 2),
 dg AS (SELECT entity, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM dr GROUP BY 1),
 dz AS (SELECT entity, date, {', '.join(f"CAST(coalesce({c}, 0) AS DOUBLE) AS {c}" for c in ('sales', 'gross', 'invoices', 'customers', 'products', 'units', 'transaction_rows', 'return_value'))} FROM dg LEFT JOIN dr USING (entity, date)),
 mk AS (SELECT sale_date - CAST(dayofweek(sale_date) AS INTEGER) AS week_start, CAST(sum(list_amount) AS DOUBLE) / 1000000 AS market FROM sales WHERE (CAST(datediff('day', DATE '1990-01-07', sale_date) AS BIGINT) // 7) % 10 <> 3 GROUP BY 1),
 dm AS (SELECT dz.*, sales / greatest(invoices, 1.0) AS avg_invoice, return_value / greatest(gross, 1e-9) AS return_rate, market FROM dz LEFT JOIN mk ON mk.week_start = date - CAST(dayofweek(date) AS INTEGER) - 7)"""


def _feature_sql() -> dict[str, str]:
    out = {}
    for m in risk.MEASURES:
        for w in risk.WINDOWS:
            out[f"{m}_ratio_{w}"] = f"{m} / nullif({roll('avg', m, w)}, 0)"
            if m in risk.SCORED:
                out[f"{m}_z_{w}"] = f"({m} - {roll('avg', m, w)}) / nullif({roll('stddev_samp', m, w)}, 0)"
        out.update({f"{m}_change_{k}": change(m, k) for k in risk.LAGS})
    out["ma7_ma28"] = f"{roll('avg', 'sales', 7)} / nullif({roll('avg', 'sales', 28)}, 0)"
    out["ma14_ma56"] = f"{roll('avg', 'sales', 14)} / nullif({roll('avg', 'sales', 56)}, 0)"
    out["vol7_vol28"] = f"{roll('stddev_samp', 'sales', 7)} / nullif({roll('stddev_samp', 'sales', 28)}, 0)"
    top = roll("max", "sales", 28)
    out["drawdown28"] = f"CASE WHEN {top} IS NOT NULL THEN coalesce(sales / nullif({top}, 0), 0) - 1 END"
    out["market"] = "market"
    out.update({f"market_change_{k}": f"(market - {lag('market', k)}) / nullif(abs({lag('market', k)}), 0)" for k in (1, 7)})
    out["dow_sin"], out["dow_cos"] = (f"{f}(2 * pi() * (isodow(date) - 1) / 7)" for f in ("sin", "cos"))
    out["salary_period"] = "CAST(day(date) BETWEEN 24 AND 31 AS DOUBLE)"
    out["national_day_window"] = "CAST(month(date) = 9 AND day(date) BETWEEN 16 AND 30 AS DOUBLE)"
    out["founding_day_window"] = "CAST(month(date) = 2 AND day(date) BETWEEN 15 AND 29 AS DOUBLE)"
    return {name: out[name] for name in risk.RISK_FEATURES}


_COUNTED = """row_number() OVER o AS history_days, sum(CAST(customers > 0 AS INTEGER)) OVER r AS customer_days, sum(CAST(products > 0 AS INTEGER)) OVER r AS product_days"""
_WINDOWS = """WINDOW o AS (PARTITION BY entity ORDER BY date), r AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 55 PRECEDING AND CURRENT ROW)"""


def rich_days(t):
    """The rich daily panel of every category; NULL ones are no entity."""
    sales = t.sales("category", "sale_date", "transaction_number", "transaction_type", "customer_key", "product_id", "quantity", "net_sales", "gross_sales")
    return panels.daily_rich(sales.withColumnRenamed("category", "entity").withColumnRenamed("sale_date", "date"), "date", ["entity"])


def market_index(t):
    """A weekly index of all lines; one week in ten was never published."""
    lines = t.sales("sale_date", "list_amount").where("(datediff(sale_date, date'1990-01-07') div 7) % 10 <> 3")
    weekly = base.with_week(lines, "sale_date").groupBy("week_start")
    return weekly.agg((panels.double(F.sum("list_amount")) / 1_000_000).alias("market"))


@query(
    "risk_features",
    "entity:s date:d history_days:i customer_days:i product_days:i " + " ".join(f"{n}:f4" for n in risk.RISK_FEATURES),
    f"WITH {DAILY} SELECT entity, date, {_COUNTED}, {', '.join(f'{sql} AS {n}' for n, sql in _feature_sql().items())} FROM dm {_WINDOWS}",
)
def risk_features(t):
    return risk.risk_features(rich_days(t), market_index(t), "entity", "date")


#: The stored artifact of these queries: bounds (feature, low, median, high) and a small forest over them.
BOUNDS = (("ma7_ma28", 0.6, 1.0, 1.4), ("sales_change_7", -0.8, 0.0, 2.0), ("drawdown28", -0.9, -0.35, 0.0), ("market_change_7", -0.3, 0.0, 0.3))
TREES = (
    {"feature": [0, 2, -1, -1, -1], "threshold": [0.95, -0.5, 0.0, 0.0, 0.0], "left": [1, 2, -1, -1, -1], "right": [4, 3, -1, -1, -1], "p1": [0.0, 0.0, 0.875, 0.625, 0.1875]},
    {"feature": [1, -1, 3, -1, -1], "threshold": [-0.1, 0.0, 0.01, 0.0, 0.0], "left": [1, -1, 3, -1, -1], "right": [2, -1, 4, -1, -1], "p1": [0.0, 0.6875, 0.0, 0.40625, 0.09375]},
    {"feature": [2, -1, -1], "threshold": [-0.6, 0.0, 0.0], "left": [1, -1, -1], "right": [2, -1, -1], "p1": [0.0, 0.5625, 0.25]},
)


def assessed_days(t):
    bounds = t.spark.createDataFrame(BOUNDS, "feature string, low double, median double, high double")
    names = [name for name, *_ in BOUNDS]
    return risk.assess_days(rich_days(t), market_index(t), risk.forest_from(TREES, t.spark), bounds, static=0.5, features=names)


_INPUTS = ", ".join(f"greatest({lo}, least({hi}, coalesce({_feature_sql()[name]}, {mid}))) AS {name}" for name, lo, mid, hi in BOUNDS)
_JUDGED = f"""{DAILY}, rf AS (SELECT entity, date, {_COUNTED}, count(market) OVER (PARTITION BY entity ORDER BY date) > 0 AS market_available, {_INPUTS} FROM dm {_WINDOWS}),
 rr AS (SELECT *, CASE WHEN history_days < 56 THEN 'at least 56 calendar days of transactions are needed, found ' || history_days
   WHEN customer_days < 7 OR product_days < 7 THEN 'transactions need customer and product identifiers; daily totals run in minimal mode' END AS reason FROM rf),
 rs AS (SELECT *, (CASE WHEN ma7_ma28 <= 0.95 THEN CASE WHEN drawdown28 <= -0.5 THEN 0.875 ELSE 0.625 END ELSE 0.1875 END
   + CASE WHEN sales_change_7 <= -0.1 THEN 0.6875 WHEN market_change_7 <= 0.01 THEN 0.40625 ELSE 0.09375 END + CASE WHEN drawdown28 <= -0.6 THEN 0.5625 ELSE 0.25 END)::DOUBLE / 3 AS raw FROM rr WHERE reason IS NULL),
 rn AS (SELECT *, round(raw, 9) AS score, row_number() OVER (PARTITION BY entity ORDER BY date) AS i FROM rs),
 rp AS (SELECT a.entity, a.date, count(b.i) AS n, sum(CASE WHEN b.score < a.score THEN 1 WHEN b.score = a.score THEN 0.5 ELSE 0 END)::DOUBLE AS s
   FROM rn a LEFT JOIN rn b ON a.entity = b.entity AND b.i BETWEEN a.i - 126 AND a.i - 1 GROUP BY 1, 2),
 rq AS (SELECT rn.*, CASE WHEN n >= 20 THEN s / n END AS percentile FROM rn JOIN rp USING (entity, date)),
 days AS (SELECT rr.entity, rr.date, rr.history_days, rr.market_available, rr.reason, score, percentile,
   CASE WHEN rr.reason IS NULL THEN CASE WHEN percentile IS NULL THEN 'static' ELSE 'causal_percentile' END END AS policy_mode,
   CASE WHEN rr.reason IS NULL THEN CASE WHEN percentile IS NULL THEN 0.5 ELSE 0.7 END END AS decision_threshold,
   CASE WHEN rr.reason IS NULL THEN CASE WHEN percentile IS NULL THEN score >= 0.5 ELSE percentile >= 0.7 END END AS alert FROM rr LEFT JOIN rq USING (entity, date))"""
_DAYS = "entity:s date:d history_days:i market_available:b reason:s score:f percentile:f policy_mode:s decision_threshold:f alert:b"


@query("assess_days", _DAYS, f"WITH {_JUDGED} SELECT * FROM days")
def assess_days(t):
    return assessed_days(t)


@query("assess_risk", f"{_DAYS} available:b", f"WITH {_JUDGED} SELECT *, reason IS NULL AS available FROM days QUALIFY row_number() OVER (PARTITION BY entity ORDER BY date DESC) = 1")
def assess_risk(t):
    return risk.assess_risk(settle(assessed_days(t)))


def engine_tables(t):
    """The whole analysis with the engine's own assessment."""
    sales = t.sales(
        "sale_date", "transaction_number", "transaction_type", "customer_key", "quantity", "net_sales", "discount_amount",
        "channel", "product_name", "category",
    )
    found = risk.assess_risk(settle(assessed_days(t))).where("available")
    return analysis.instant_analysis(sales, "category", found.select("entity", F.col("score").alias("risk"), "alert"), 7)


@query(
    "instant_analysis_alerts",
    "entity:s horizon_days:i data_end:d risk:f alert:b severity:s",
    f"""WITH {_JUDGED}, newest AS (SELECT entity, score, alert FROM days WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY entity ORDER BY date DESC) = 1),
 ends AS (SELECT category AS entity, max(sale_date) AS data_end FROM sales GROUP BY 1)
 SELECT entity, 7 AS horizon_days, data_end, score AS risk, alert, 'raised' AS severity FROM ends JOIN newest USING (entity) WHERE alert""",
)
def instant_analysis_alerts(t):
    """Alerts of the stored runs: only those of the engine."""
    tables = engine_tables(t)
    runs = tables["model_runs"].select("run_id", "entity", "horizon_days", "data_end")
    alerts = tables["alerts"].select("run_id", "risk", F.lit(True).alias("alert"), F.lit("raised").alias("severity"))
    return runs.join(alerts, "run_id")


@query(
    "decline_quality_full",
    "entity:s correct_count:i sample_size:i accuracy_pct:f error_pct:f precision_pct:f recall_pct:f f1_pct:f roc_auc_pct:f",
    f"""WITH {base.scores_sql()}, c AS (SELECT entity, count(*) FILTER (y = 1 AND score >= 0.55) AS tp, count(*) FILTER (y = 0 AND score >= 0.55) AS fp,
   count(*) FILTER (y = 1 AND score < 0.55) AS fn, count(*) FILTER (y = 0 AND score < 0.55) AS tn FROM scores GROUP BY 1),
 k AS (SELECT entity, y, rank() OVER (PARTITION BY entity ORDER BY score) AS lo, count(*) OVER (PARTITION BY entity, score) AS ties FROM scores),
 a AS (SELECT entity, sum(lo + (ties - 1) / 2.0) FILTER (y = 1) AS rs, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS q FROM k GROUP BY 1)
 SELECT entity, tp + tn AS correct_count, tp + fp + fn + tn AS sample_size, (tp + tn) * 100.0 / (tp + fp + fn + tn) AS accuracy_pct, (fp + fn) * 100.0 / (tp + fp + fn + tn) AS error_pct,
   CASE WHEN tp + fp > 0 THEN tp * 100.0 / (tp + fp) ELSE 0 END AS precision_pct, CASE WHEN tp + fn > 0 THEN tp * 100.0 / (tp + fn) ELSE 0 END AS recall_pct,
   CASE WHEN 2 * tp + fp + fn > 0 THEN 200.0 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1_pct, (rs - p * (p + 1) / 2.0) / nullif(p * q, 0) * 100 AS roc_auc_pct FROM c JOIN a USING (entity)""",
)
def decline_quality_full(t):
    from ebbtide.operators import forecast

    scored = settle(base.scores(t))
    counts = policy.binary_metrics(scored, "y", F.col("score") >= 0.55, ["entity"])
    return forecast.decline_quality(counts.join(policy.roc_auc(scored, "y", "score", ["entity"]), "entity"))
