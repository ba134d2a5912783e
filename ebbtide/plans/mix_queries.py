"""Concentration, churn, cross-sections, market calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbtide.functions.scalars import clip
from ebbtide.operators import evidence, mix
from ebbtide.operators.ordering import settle
from ebbtide.operators.panels import double
from ebbtide.operators.windows import Series
from ebbtide.plans import base
from ebbtide.plans.base import SALES, panel_sql
from ebbtide.plans.calendar_queries import _SIGNALS, count_sql, weekly_signals
from ebbtide.plans.join_queries import OVERLAP, SUNDAY
from ebbtide.plans.registry import query
from ebbtide.plans.window_queries import change, lag, roll

DAY = Series("entity", "date")


def weekly_tx(t, *cols):
    return base.with_week(t.sales("sale_date", *cols), "sale_date")


@query(
    "concentration",
    "category:s week_start:d hhi:f top1_share:f top5_share:f",
    f"""WITH {SALES}, i AS (SELECT category, {SUNDAY} AS week_start, product_id, greatest(CAST(sum(net_sales) AS DOUBLE), 0) AS v FROM sales GROUP BY 1, 2, 3),
 r AS (SELECT *, row_number() OVER (PARTITION BY category, week_start ORDER BY v DESC) AS rn FROM i)
 SELECT category, week_start, coalesce(sum(v * v) / nullif(sum(v) * sum(v), 0), 0) AS hhi, coalesce(max(v) / nullif(sum(v), 0), 0) AS top1_share,
   coalesce(sum(v) FILTER (rn <= 5) / nullif(sum(v), 0), 0) AS top5_share FROM r GROUP BY 1, 2""",
)
def concentration(t):
    return mix.concentration(weekly_tx(t, "category", "product_id", "net_sales"), ["category", "week_start"], "product_id", "net_sales")


@query(
    "price_change_index",
    "category:s week_start:d price_change:f increase_share:f decrease_share:f",
    f"""WITH {SALES}, i AS (SELECT category, {SUNDAY} AS week_start, brand, sum(list_amount) AS a, sum(quantity) AS q FROM sales GROUP BY 1, 2, 3),
 p AS (SELECT x.category, x.week_start, x.brand, CAST(any_value(x.a) AS DOUBLE) / CAST(any_value(x.q) AS DOUBLE) AS price, CAST(any_value(x.q) AS DOUBLE) AS q,
   CAST(sum(y.a) AS DOUBLE) / CAST(sum(y.q) AS DOUBLE) AS prev FROM i x LEFT JOIN i y ON x.category = y.category AND x.brand = y.brand
   AND y.week_start BETWEEN x.week_start - 28 AND x.week_start - 7 GROUP BY 1, 2, 3),
 c AS (SELECT *, price / prev - 1 AS c FROM p)
 SELECT category, week_start, coalesce(sum(c * q) / sum(CASE WHEN c IS NOT NULL THEN q END), 0) AS price_change,
   coalesce(sum(CASE WHEN c > 0.05 THEN q WHEN c IS NOT NULL THEN 0 END) / sum(CASE WHEN c IS NOT NULL THEN q END), 0) AS increase_share,
   coalesce(sum(CASE WHEN c < -0.05 THEN q WHEN c IS NOT NULL THEN 0 END) / sum(CASE WHEN c IS NOT NULL THEN q END), 0) AS decrease_share FROM c GROUP BY 1, 2""",
)
def price_change_index(t):
    tx = weekly_tx(t, "category", "brand", "list_amount", "quantity")
    return mix.price_change_index(tx, ["category"], "week_start", "brand", "list_amount", "quantity")


@query(
    "churn_rates",
    "category:s week_start:d retention:f dropout:f new_rate:f",
    f"""WITH {OVERLAP % 'customer_key'} SELECT category, week_start, kept / greatest(previous_items, 1.0) AS retention,
   dropped / greatest(previous_items, 1.0) AS dropout, new / greatest(current_items, 1.0) AS new_rate FROM ov""",
)
def churn_rates(t):
    return mix.churn_rates(weekly_tx(t, "category", "customer_key"), ["category"], "week_start", "customer_key")


@query(
    "items_per_invoice",
    "region:s week_start:d items_per_invoice:f",
    f"""WITH {SALES}, i AS (SELECT region, {SUNDAY} AS week_start, transaction_number, count(DISTINCT product_id) AS n FROM sales GROUP BY 1, 2, 3)
 SELECT region, week_start, avg(n) AS items_per_invoice FROM i GROUP BY 1, 2""",
)
def items_per_invoice(t):
    tx = weekly_tx(t, "region", "transaction_number", "product_id")
    return mix.items_per_invoice(tx, ["region", "week_start"], "transaction_number", "product_id")


_CAT = f"""{panel_sql()}, c AS (SELECT entity, date, gross, gross / nullif({roll('avg', 'gross', 7)}, 0) AS ratio7, {change('gross', 7)} AS change7 FROM panel)"""


def category_signals(t):
    return base.gross_days(t).select(
        "entity", "date", "gross", DAY.ratio_to_mean("gross", 7).alias("ratio7"), DAY.change("gross", 7).alias("change7")
    )


@query(
    "cross_section_stats",
    "date:d signal:s mean:f std:f p10:f p90:f weighted_mean:f",
    f"""WITH {_CAT}, l AS (SELECT date, gross, 'ratio7' AS signal, ratio7 AS v FROM c WHERE ratio7 IS NOT NULL UNION ALL SELECT date, gross, 'change7', change7 FROM c WHERE change7 IS NOT NULL)
 SELECT date, signal, avg(v) AS mean, stddev_pop(v) AS std, quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.9) AS p90, sum(gross * v) / nullif(sum(gross), 0) AS weighted_mean FROM l GROUP BY 1, 2""",
)
def cross_section_stats(t):
    return mix.cross_section_stats(category_signals(t), "date", ["ratio7", "change7"], "gross")


_SHARES = ("below_090", "below_100", "above_110", "negative", "severe")


@query(
    "breadth",
    "date:d " + " ".join(f"{s}:f {s}_delta7:f {s}_delta28:f" for s in _SHARES),
    f"""WITH {_CAT}, b AS (SELECT date, {', '.join(f"avg(CAST(coalesce({e}, false) AS DOUBLE)) AS {n}" for n, e in zip(_SHARES, ('ratio7 < 0.9', 'ratio7 < 1', 'ratio7 > 1.1', 'change7 < 0', 'change7 < -0.15')))} FROM c GROUP BY 1)
 SELECT date, {', '.join(f"{s}, {s} - {lag(s, 7, part='')} AS {s}_delta7, {s} - {lag(s, 28, part='')} AS {s}_delta28" for s in _SHARES)} FROM b""",
)
def breadth(t):
    return mix.breadth(category_signals(t), "date", "ratio7", "change7")


@query(
    "pivot_features",
    "date:d PROMO_ratio7:f PROMO_change7:f SMALL_ratio7:f SMALL_change7:f",
    f"""WITH {_CAT} SELECT date, {', '.join(f"max(CASE WHEN entity = '{e}' THEN {f} END) AS {e}_{f}" for e in ('PROMO', 'SMALL') for f in ('ratio7', 'change7'))} FROM c GROUP BY 1""",
)
def pivot_features(t):
    return mix.pivot_features(category_signals(t), "date", "entity", ["PROMO", "SMALL"], ["ratio7", "change7"])


@query(
    "value_weighted_share",
    "sale_date:d online_share:f loyal_share:f ordinal_mean:f avg_invoice:f1 median_invoice:f1",
    f"""WITH {SALES}, s AS (SELECT sale_date, CAST(sum(CASE WHEN channel = 'MACHINERY' THEN gross_sales ELSE 0 END) AS DOUBLE) / nullif(CAST(sum(gross_sales) AS DOUBLE), 0) AS o,
   CAST(sum(CASE WHEN order_status = 'F' THEN gross_sales ELSE 0 END) AS DOUBLE) / nullif(CAST(sum(gross_sales) AS DOUBLE), 0) AS l, avg(quantity) AS ordinal_mean FROM sales GROUP BY 1),
 i AS (SELECT sale_date, transaction_number, CAST(sum(net_sales) AS DOUBLE) AS v FROM sales GROUP BY 1, 2),
 j AS (SELECT sale_date, avg(v) AS avg_invoice, quantile_cont(v, 0.5) AS median_invoice FROM i GROUP BY 1)
 SELECT sale_date, coalesce(o, 0) AS online_share, coalesce(l, 0) AS loyal_share, ordinal_mean, avg_invoice, median_invoice FROM s JOIN j USING (sale_date)""",
)
def value_weighted_share(t):
    tx = t.sales("sale_date", "transaction_number", "channel", "order_status", "quantity", "net_sales", spread=True)
    flags = {"online_share": "channel = 'MACHINERY'", "loyal_share": "order_status = 'F'"}
    return mix.value_weighted_share(tx, "sale_date", "transaction_number", "net_sales", flags, "quantity")


@query(
    "customer_mix_day",
    "sale_date:d unique_customers:i new_customers:i returning_customers:i new_share:f returning_share:f",
    f"""WITH {SALES}, d AS (SELECT DISTINCT customer_key, sale_date FROM sales), f AS (SELECT *, sale_date = min(sale_date) OVER (PARTITION BY customer_key) AS is_new FROM d),
 g AS (SELECT sale_date, count(*) AS unique_customers, count(*) FILTER (is_new) AS new_customers, count(*) FILTER (NOT is_new) AS returning_customers FROM f GROUP BY 1)
 SELECT *, new_customers / CAST(unique_customers AS DOUBLE) AS new_share, returning_customers / CAST(unique_customers AS DOUBLE) AS returning_share FROM g""",
)
def customer_mix_day(t):
    return mix.customer_mix_day(t.sales("sale_date", "customer_key"))


@query(
    "weekly_risk_summary",
    "merchant_week_start:d risk_mean:f risk_max:f risk_p75:f risk_p90:f risk_share_25:f risk_share_50:f precursor_mean:f precursor_share_2:f",
    f"""WITH {_SIGNALS}, r AS (SELECT week_start, round(greatest(0.0, least(1.0, 1 - value_ratio_mean_4 / 2)), 4) AS risk, {count_sql(evidence.PRECURSORS)} AS p FROM sig WHERE value_ratio_mean_4 IS NOT NULL)
 SELECT week_start + 7 AS merchant_week_start, avg(risk) AS risk_mean, max(risk) AS risk_max, quantile_cont(risk, 0.75) AS risk_p75, quantile_cont(risk, 0.9) AS risk_p90,
   avg(CAST(risk >= 0.25 AS DOUBLE)) AS risk_share_25, avg(CAST(risk >= 0.5 AS DOUBLE)) AS risk_share_50, avg(p) AS precursor_mean, avg(CAST(p >= 2 AS DOUBLE)) AS precursor_share_2 FROM r GROUP BY 1""",
)
def weekly_risk_summary(t):
    d = weekly_signals(t).where("value_ratio_mean_4 is not null")
    d = d.withColumns(
        {
            "risk": F.round(clip(1.0 - F.col("value_ratio_mean_4") / 2.0, 0.0, 1.0), 4),
            "precursors": evidence.signal_count(evidence.PRECURSORS),
        }
    )
    return mix.weekly_risk_summary(d, "week_start", "risk", "precursors")


@query(
    "sector_to_merchant_ratio",
    "date:d predicted_total_ratio:f sector_risk:f sectors_scored:i",
    f"""WITH {panel_sql()}, p AS (SELECT entity, date, {roll('avg', 'gross', 7)} / nullif({roll('avg', 'gross', 28)}, 0) AS ratio, {roll('avg', 'gross', 28)} AS b FROM panel),
 g AS (SELECT date, sum(greatest(0.15, least(3.0, ratio)) * b) / nullif(sum(b), 0) AS predicted_total_ratio, count(DISTINCT entity) AS sectors_scored FROM p WHERE b IS NOT NULL AND ratio IS NOT NULL GROUP BY 1)
 SELECT *, 1 / (1 + exp(greatest(-30, least(30, (predicted_total_ratio - 0.85) / 0.08)))) AS sector_risk FROM g""",
)
def sector_to_merchant_ratio(t):
    pred = base.gross_days(t).select(
        "entity", "date", DAY.ma_ratio("gross", 7, 28).alias("ratio"), DAY.rolling("gross", 28).alias("b")
    ).where("b is not null and ratio is not null")
    return mix.sector_to_merchant_ratio(pred, "date", "entity", "ratio", "b")


def calibration_frames(t):
    """Base cells, a market series (supplier-side list amounts) and its shares."""
    tx = weekly_tx(t, "category", "net_sales", "gross_sales", "list_amount")
    # one row per category and day, written once: everything below is small
    tx = settle(tx.groupBy("week_start", "category", "sale_date").agg(*[F.sum(c).alias(c) for c in ("net_sales", "gross_sales", "list_amount")]))
    days = tx.groupBy("week_start").agg(F.countDistinct("sale_date").alias("days"))
    cells = tx.groupBy("week_start", "category").agg(
        double(F.sum("net_sales")).alias("net"), double(F.sum("gross_sales")).alias("gross"), double(F.sum("list_amount")).alias("m")
    )
    market = cells.groupBy("week_start").agg(F.sum("m").alias("value"))
    shares = cells.join(market, "week_start").select("week_start", "category", (F.col("m") / F.col("value")).alias("share"))
    return cells.drop("m").join(days, "week_start"), market, shares


_CAL = f"""{SALES}, cells AS (SELECT {SUNDAY} AS week_start, category, CAST(sum(net_sales) AS DOUBLE) AS net, CAST(sum(gross_sales) AS DOUBLE) AS gross, CAST(sum(list_amount) AS DOUBLE) AS m FROM sales GROUP BY 1, 2),
 dd AS (SELECT {SUNDAY} AS week_start, count(DISTINCT sale_date) AS days FROM sales GROUP BY 1),
 wk AS (SELECT week_start, sum(net) AS week_net, sum(gross) AS week_gross, sum(m) AS value, any_value(days) AS days FROM cells JOIN dd USING (week_start) GROUP BY 1),
 med AS (SELECT quantile_cont(week_net, 0.5) AS nm, quantile_cont(value, 0.5) AS mm FROM wk WHERE days = 7),
 wf AS (SELECT week_start, week_gross, value, value / mm AS market_index, nm * value / mm * days / 7 AS week_target, nm * value / mm * days / 7 / nullif(week_net, 0) AS week_factor FROM wk, med),
 pf AS (SELECT week_start, category, net, market_index, week_target, week_factor,
   week_factor * greatest(0.8, least(1.25, pow(greatest((m / value) / greatest(gross / greatest(week_gross, 1e-9), 1e-6), 1e-6), 0.15))) AS pre_factor FROM cells JOIN wf USING (week_start)),
 cal AS (SELECT *, pre_factor * week_target / greatest(sum(net * pre_factor) OVER (PARTITION BY week_start), 1e-9) AS factor FROM pf)"""


@query(
    "market_calibration",
    "week_start:d category:s market_index:f week_factor:f pre_factor:f factor:f",
    f"WITH {_CAL} SELECT * FROM cal",
)
def market_calibration(t):
    return mix.market_calibration(*calibration_frames(t))


def calibrated_lines(t):
    factors = settle(mix.market_calibration(*calibration_frames(t)).where("category <> 'PROMO'"))
    tx = weekly_tx(t, "category", "transaction_number", "line_number", "priority", "order_status", "net_sales")
    return mix.apply_calibration(tx.withColumn("eligible", F.col("order_status") != "P"), factors)


_LINES = f"""{_CAL}, w AS (SELECT week_start, max(week_factor) AS wfac, max(market_index) AS market_index FROM cal WHERE category <> 'PROMO' GROUP BY 1),
 ln AS (SELECT s.sale_date, s.net_sales, s.transaction_number, s.line_number, s.priority, order_status <> 'P' AS eligible, w.market_index,
   CAST(net_sales AS DOUBLE) * CASE WHEN order_status <> 'P' THEN coalesce(c.factor, w.wfac, 1) ELSE 1 END AS calibrated_net
   FROM (SELECT *, {SUNDAY} AS ws FROM sales) s LEFT JOIN w ON w.week_start = s.ws LEFT JOIN cal c ON c.week_start = s.ws AND c.category = s.category AND c.category <> 'PROMO')"""


@query(
    "apply_calibration",
    "sale_date:d calibrated_net:f1 calibrated_gross:f1 calibrated_returns:f1 base_net:f4 market_index:f",
    f"""WITH {_LINES} SELECT sale_date, sum(calibrated_net) AS calibrated_net, sum(greatest(calibrated_net, 0)) AS calibrated_gross, sum(greatest(-calibrated_net, 0)) AS calibrated_returns,
   sum(net_sales) AS base_net, sum(market_index * abs(CAST(net_sales AS DOUBLE))) / greatest(sum(abs(CAST(net_sales AS DOUBLE))), 1e-9) AS market_index FROM ln WHERE eligible GROUP BY 1""",
)
def apply_calibration(t):
    return mix.calibrated_daily(calibrated_lines(t))


@query(
    "calibration_audit",
    "missing_week_lines:i lines:i duplicate_line_ids:i mixed_payment_invoices:i",
    f"""WITH {_LINES} SELECT count(*) FILTER (market_index IS NULL) AS missing_week_lines, count(*) AS lines,
   count(*) - count(DISTINCT transaction_number || '-' || line_number) AS duplicate_line_ids,
   (SELECT count(*) FROM (SELECT transaction_number FROM ln GROUP BY 1 HAVING count(DISTINCT priority) > 1)) AS mixed_payment_invoices FROM ln""",
)
def calibration_audit(t):
    lines = calibrated_lines(t)
    return mix.calibration_audit(lines, ["transaction_number", "line_number"], lines.select("transaction_number", "priority"))


@query(
    "residual_entity",
    "week_start:d region:s value:f4",
    f"""WITH {SALES}, p AS (SELECT {SUNDAY} AS week_start, region, sum(list_amount) AS value FROM sales WHERE region <> 'ASIA' GROUP BY 1, 2),
 t AS (SELECT {SUNDAY} AS week_start, sum(list_amount) AS total FROM sales WHERE {SUNDAY} >= DATE '1995-01-08' AND {SUNDAY} < DATE '2001-10-28' GROUP BY 1), n AS (SELECT week_start, sum(value) AS named FROM p GROUP BY 1)
 SELECT * FROM p UNION ALL SELECT week_start, 'OTHER', total - named FROM t JOIN n USING (week_start)""",
)
def residual_entity(t):
    tx = weekly_tx(t, "region", "list_amount")
    named = tx.where("region <> 'ASIA'").groupBy("week_start", "region").agg(F.sum("list_amount").alias("value"))
    inside = tx.where("week_start >= date'1995-01-08' and week_start < date'2001-10-28'")
    total = inside.groupBy("week_start").agg(F.sum("list_amount").alias("value"))
    return mix.residual_entity(named, total, "week_start", "region", "value", strict=False)
