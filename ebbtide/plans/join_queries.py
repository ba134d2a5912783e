"""Lookups, calendar joins, overlaps and alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbtide.operators import joins, panels
from ebbtide.operators.ordering import dealt, settle
from ebbtide.operators.windows import Series
from ebbtide.plans import base
from ebbtide.plans.base import COMPANY, SALES, panel_sql, scores_sql, week_panel_sql
from ebbtide.plans.registry import query

SUNDAY = "sale_date - CAST(dayofweek(sale_date) AS INTEGER)"


@query(
    "star_join",
    "category_id:s n:i net:f4",
    f"WITH {SALES} SELECT category AS category_id, count(*) AS n, sum(net_sales) AS net FROM sales GROUP BY 1",
)
def star_join(t):
    products = t.read("part").select(F.col("p_partkey").alias("product_id"), F.col("p_type").alias("category_id"))
    joined = joins.star_join(t.sales("product_id", "net_sales"), products, products.select("category_id").distinct())
    return joined.groupBy("category_id").agg(F.count(F.lit(1)).alias("n"), F.sum("net_sales").alias("net"))


@query(
    "enrich",
    "transaction_number:i priority:s net:f4",
    f"""WITH {SALES}, g AS (SELECT transaction_number, sum(net_sales) AS net FROM sales GROUP BY 1)
 SELECT transaction_number, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS priority, net FROM g LEFT JOIN orders ON transaction_number = o_orderkey""",
)
def enrich(t):
    totals = t.sales("transaction_number", "net_sales").groupBy("transaction_number").agg(F.sum("net_sales").alias("net"))
    dim = t.read("orders").where("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("transaction_number"), F.col("o_orderpriority").alias("priority")
    )
    return joins.enrich(totals, dim, ["transaction_number"], "one_to_one")


@query(
    "prior_week_lookup",
    "date:d week_start:d value:f4",
    f"""WITH {COMPANY}, w AS (SELECT date - CAST(dayofweek(date) AS INTEGER) AS ws, sum(sales) AS value FROM company GROUP BY 1),
 d AS (SELECT date, date - CAST(dayofweek(date) AS INTEGER) AS week_start FROM company)
 SELECT d.date, d.week_start, value FROM d LEFT JOIN w ON w.ws = d.week_start - 7""",
)
def prior_week_lookup(t):
    days = base.company_day(t)
    weekly = base.with_week(days).groupBy("week_start").agg(F.sum("sales").alias("value"))
    return joins.prior_week_lookup(days, weekly, "date", ["value"])


@query(
    "forecast_origin_join",
    "entity:s date:d origin_week:d expected_next7:f1 expected_change:f",
    f"""WITH {panel_sql()}, w AS (SELECT entity, date - CAST(dayofweek(date) AS INTEGER) AS ws, sum(gross) AS g FROM panel GROUP BY 1, 2),
 f AS (SELECT entity, ws AS origin_week, 0.7 * g + 0.3 * lag(g) OVER o AS h1, 0.5 * g + 0.5 * lag(g, 2) OVER o AS h2 FROM w WINDOW o AS (PARTITION BY entity ORDER BY ws)),
 d AS (SELECT entity, date, date - CAST(dayofweek(date) AS INTEGER) - 7 AS origin_week, CAST(6 - dayofweek(date) AS DOUBLE) AS s FROM panel)
 SELECT entity, date, origin_week, (s * h1 + (7 - s) * h2) / 7 AS expected_next7, h2 / nullif(h1, 0) - 1 AS expected_change FROM d LEFT JOIN f USING (entity, origin_week)""",
)
def forecast_origin_join(t):
    panel = base.gross_days(t).select("entity", "date", "gross")
    weekly = base.with_week(panel).groupBy("entity", "week_start").agg(F.sum("gross").alias("g"))
    s = Series("entity", "week_start")
    forecasts = weekly.select(
        "entity",
        F.col("week_start").alias("origin_week"),
        (0.7 * F.col("g") + 0.3 * s.lag("g", 1)).alias("h1"),
        (0.5 * F.col("g") + 0.5 * s.lag("g", 2)).alias("h2"),
    )
    return joins.forecast_origin_join(panel.select("entity", "date"), forecasts, "date", "entity")


WINDOWS = [("fast", "1997-01-10", "1997-02-08"), ("fast", "1998-12-30", "1999-01-28"), ("feast", "1997-02-08", "1997-02-12")]


@query(
    "calendar_window_join",
    "entity:s date:d in_window:i window_names:a",
    f"""WITH {panel_sql()}, w(name, s, e) AS (VALUES {', '.join(f"('{n}', DATE '{s}', DATE '{e}')" for n, s, e in WINDOWS)}),
 m AS (SELECT p.entity, p.date, list_sort(list(DISTINCT w.name)) AS names FROM panel p JOIN w ON p.date BETWEEN w.s AND w.e GROUP BY 1, 2)
 SELECT p.entity, p.date, CASE WHEN names IS NULL THEN 0 ELSE 1 END AS in_window, names AS window_names FROM panel p LEFT JOIN m USING (entity, date)""",
)
def calendar_window_join(t):
    windows = t.spark.createDataFrame(WINDOWS, "name string, start string, end string").select(
        "name", F.col("start").cast("date").alias("start"), F.col("end").cast("date").alias("end")
    )
    return joins.calendar_window_join(base.gross_days(t).select("entity", "date"), windows, "date")


@query(
    "week_window_join",
    "week_start:d hit:i flag:i",
    f"""WITH {week_panel_sql()}, w(name, s, e) AS (VALUES {', '.join(f"('{n}', DATE '{s}', DATE '{e}')" for n, s, e in WINDOWS)}),
 k AS (SELECT DISTINCT week_start FROM wpanel)
 SELECT week_start, CAST(EXISTS (SELECT 1 FROM w WHERE week_start <= e AND week_start + 6 >= s) AS INTEGER) AS hit,
   CAST(EXISTS (SELECT 1 FROM w WHERE week_start <= e AND week_start + 6 >= s) AS INTEGER) AS flag FROM k""",
)
def week_window_join(t):
    from ebbtide.functions.calendar import week_overlaps

    windows = t.spark.createDataFrame(WINDOWS, "name string, start string, end string").select(
        "name", F.col("start").cast("date").alias("start"), F.col("end").cast("date").alias("end")
    )
    weeks = base.week_panel(t, measures=("gross",)).select("week_start").distinct()
    d = joins.calendar_window_join(weeks, windows, "week_start", span_days=6)
    flag = week_overlaps(F.col("week_start"), [(s, e) for _, s, e in WINDOWS]).cast("int")
    return d.select("week_start", F.col("in_window").alias("hit"), flag.alias("flag"))


@query(
    "carry_forward_join",
    "entity:s date:d value:f4",
    f"""WITH {panel_sql()}, w AS (SELECT entity, date - CAST(dayofweek(date) AS INTEGER) AS ws, sum(gross) AS value FROM panel GROUP BY 1, 2 HAVING (CAST(datediff('day', DATE '1990-01-01', ws) AS BIGINT) // 7 * 31 + length(entity)) % 9 < 6),
 j AS (SELECT p.entity, p.date, w.value FROM panel p LEFT JOIN w ON p.entity = w.entity AND w.ws = p.date - CAST(dayofweek(p.date) AS INTEGER))
 SELECT entity, date, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY entity ORDER BY date ROWS UNBOUNDED PRECEDING),
   first_value(value IGNORE NULLS) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS value FROM j""",
)
def carry_forward_join(t):
    days = base.gross_days(t).select("entity", "date", "gross")
    weekly = (
        base.with_week(days)
        .groupBy("entity", "week_start")
        .agg(F.sum("gross").alias("value"))
        .where("(datediff(week_start, date'1990-01-01') div 7 * 31 + length(entity)) % 9 < 6")
    )
    return joins.carry_forward_join(days, weekly, "date", ["value"], ["entity"])


@query(
    "complete_grid",
    "branch:i category:s week_start:d net:f4 structural_zero:i",
    f"""WITH {SALES}, r AS (SELECT branch, category, {SUNDAY} AS week_start, sum(net_sales) AS net FROM sales GROUP BY 1, 2, 3),
 g AS (SELECT branch, category, week_start FROM (SELECT DISTINCT branch, category FROM r),
   (SELECT CAST(unnest(generate_series(min(week_start), max(week_start), INTERVAL 7 DAY)) AS DATE) AS week_start FROM r))
 SELECT branch, category, week_start, coalesce(net, 0) AS net, CASE WHEN net IS NULL THEN 1 ELSE 0 END AS structural_zero FROM g LEFT JOIN r USING (branch, category, week_start)""",
)
def complete_grid(t):
    s = base.with_week(t.sales("branch", "category", "sale_date", "net_sales"), "sale_date")
    weekly = s.groupBy("branch", "category", "week_start").agg(F.sum("net_sales").alias("net"))
    return panels.complete_grid(weekly, ["branch", "category"], "week_start", ["net"], 7)


@query(
    "stable_mapping",
    "branch:i region:s",
    f"WITH {SALES} SELECT DISTINCT branch, region FROM sales",
)
def stable_mapping(t):
    return joins.stable_mapping(t.sales("branch", "region"), "branch", "region")


@query(
    "unstable_keys",
    "brand:s targets:i",
    f"WITH {SALES} SELECT brand, count(DISTINCT category) AS targets FROM sales GROUP BY 1 HAVING count(DISTINCT category) > 1",
)
def unstable_keys(t):
    return joins.unstable_keys(t.sales("brand", "category"), "brand", "category")


@query(
    "keep_keys",
    "product_id:i sale_date:d net:f4",
    f"""WITH {SALES}, k AS (SELECT product_id FROM sales GROUP BY 1 HAVING count(DISTINCT sale_date) >= 35 AND sum(gross_sales) >= 900000)
 SELECT product_id, sale_date, sum(net_sales) AS net FROM sales WHERE product_id IN (SELECT product_id FROM k) GROUP BY 1, 2""",
)
def keep_keys(t):
    s = t.sales("product_id", "sale_date", "net_sales", "gross_sales")
    # few lines share a product and day: they are dealt by both before they are summed, and written once
    lines = dealt(s, t.read("lineitem").count(), "product_id", "sale_date")
    daily = settle(lines.groupBy("product_id", "sale_date").agg(F.sum("net_sales").alias("net"), F.sum("gross_sales").alias("gross")))
    daily = dealt(daily, daily.count(), "product_id")
    robust = joins.robust_entities(daily, "product_id", "sale_date", "gross", 35, 900000)
    return joins.keep_keys(daily, robust.select("product_id"))


@query(
    "align_scores",
    "entity:s date:d fold_id:i y:i score_a:f score_b:f score_c:f",
    f"WITH {scores_sql()} SELECT entity, date, fold_id, y, score AS score_a, score_b, score_c FROM scores",
)
def align_scores(t):
    s = base.scores(t)
    keys = ["entity", "date", "fold_id"]
    tables = {
        "a": s.select(*keys, "y", "score"),
        "b": s.select(*keys, "y", F.col("score_b").alias("score")),
        "c": s.select(*keys, "y", F.col("score_c").alias("score")),
    }
    return joins.align_scores(tables, keys)


@query(
    "first_seen",
    "customer_key:i sale_date:d first_date:d is_new:b lines:i",
    f"""WITH {SALES}, d AS (SELECT customer_key, sale_date, count(*) AS lines FROM sales GROUP BY 1, 2)
 SELECT *, min(sale_date) OVER (PARTITION BY customer_key) AS first_date, sale_date = min(sale_date) OVER (PARTITION BY customer_key) AS is_new FROM d""",
)
def first_seen(t):
    return joins.first_seen(t.sales("customer_key", "sale_date"), "customer_key", "sale_date")


def run_table(t):
    """Orders read as a run log: 7- and 30-day runs over all or some branches."""
    o = t.read("orders")
    p = F.col("o_orderpriority")
    return o.select(
        F.col("o_orderkey").alias("run_id"),
        F.when(F.col("o_orderstatus") == "P", "failed").otherwise("completed").alias("status"),
        F.to_date(F.trunc("o_orderdate", "year")).alias("data_end"),
        F.when(p == "5-LOW", 30).otherwise(7).alias("horizon_days"),
        F.when(p == "1-URGENT", F.to_json(F.struct(F.lit("all").alias("branch_scope"))))
        .when(p == "2-HIGH", F.to_json(F.struct(F.array(F.lit(2), F.lit(5)).alias("branch_scope"))))
        .when(p == "3-MEDIUM", F.to_json(F.struct(F.array(F.lit(1)).alias("branch_scope"))))
        .otherwise("{}")
        .alias("filters_json"),
        F.col("o_orderdate").alias("completed_at"),
        F.col("o_totalprice").alias("risk_base"),
    )


RUNS = """runs AS (SELECT o_orderkey AS run_id, CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'completed' END AS status,
   CAST(date_trunc('year', o_orderdate) AS DATE) AS data_end, CASE WHEN o_orderpriority = '5-LOW' THEN 30 ELSE 7 END AS horizon_days,
   CASE o_orderpriority WHEN '1-URGENT' THEN 'all' WHEN '2-HIGH' THEN '[2,5]' WHEN '3-MEDIUM' THEN '[1]' END AS branch_scope, o_orderdate AS completed_at FROM orders)"""


@query(
    "latest_run_all_branches",
    "run_id:i data_end:d horizon_days:i",
    f"""WITH {RUNS} SELECT run_id, data_end, horizon_days FROM runs WHERE status = 'completed' AND data_end = DATE '1997-01-01' AND horizon_days = 7
   AND (branch_scope IS NULL OR branch_scope = 'all') ORDER BY completed_at DESC, run_id DESC LIMIT 1""",
)
def latest_run_all_branches(t):
    return joins.latest_run_for_scope(run_table(t), F.lit("1997-01-01").cast("date"), 7, None)


@query(
    "latest_run_for_scope",
    "run_id:i data_end:d horizon_days:i",
    f"""WITH {RUNS} SELECT run_id, data_end, horizon_days FROM runs WHERE status = 'completed' AND data_end = DATE '1997-01-01' AND horizon_days = 7
   AND branch_scope = '[2,5]' ORDER BY completed_at DESC, run_id DESC LIMIT 1""",
)
def latest_run_for_scope(t):
    return joins.latest_run_for_scope(run_table(t), F.lit("1997-01-01").cast("date"), 7, [5, 2])


@query(
    "compare_periods",
    "product_id:i current:f4 previous:f4",
    f"""WITH {SALES}, c AS (SELECT product_id, sum(net_sales) AS v FROM sales WHERE sale_date BETWEEN DATE '1998-03-01' AND DATE '1998-03-31' GROUP BY 1),
 p AS (SELECT product_id, sum(net_sales) AS v FROM sales WHERE sale_date BETWEEN DATE '1998-02-01' AND DATE '1998-02-28' GROUP BY 1)
 SELECT product_id, coalesce(c.v, 0) AS current, coalesce(p.v, 0) AS previous FROM c FULL JOIN p USING (product_id)""",
)
def compare_periods(t):
    s = t.sales("product_id", "sale_date", "net_sales")

    def month(a, b):
        rows = s.where(F.col("sale_date").between(F.lit(a).cast("date"), F.lit(b).cast("date")))
        return rows.groupBy("product_id").agg(F.sum("net_sales").alias("v"))

    return joins.compare_periods(month("1998-03-01", "1998-03-31"), month("1998-02-01", "1998-02-28"), ["product_id"], "v")


OVERLAP = f"""{SALES}, b AS (SELECT DISTINCT category, {SUNDAY} AS week_start, %s AS item FROM sales),
 f AS (SELECT DISTINCT category, CAST(week_start + 7 * i AS DATE) AS week_start, item FROM b, (SELECT unnest([1, 2, 3, 4]) AS i)),
 m AS (SELECT category, week_start, item, max(n) AS n, max(p) AS p FROM (SELECT *, 1 AS n, 0 AS p FROM b UNION ALL SELECT *, 0, 1 FROM f) GROUP BY 1, 2, 3),
 ov AS (SELECT category, week_start, sum(n) AS current_items, sum(p) AS previous_items, sum(n * p) AS kept, sum(n * (1 - p)) AS new, sum((1 - n) * p) AS dropped
   FROM m WHERE week_start IN (SELECT week_start FROM b) GROUP BY 1, 2)"""


@query(
    "set_overlap",
    "category:s week_start:d current_items:i previous_items:i kept:i new:i dropped:i",
    f"WITH {OVERLAP % 'product_id'} SELECT * FROM ov",
)
def set_overlap(t):
    s = base.with_week(t.sales("category", "product_id", "sale_date"), "sale_date")
    return joins.set_overlap(s, ["category"], "week_start", "product_id")


@query(
    "reconcile",
    "week_start:d parts_sum:f4 published:f4 relative_gap:f passed:b",
    f"""WITH {SALES}, r AS (SELECT {SUNDAY} AS week_start, region, sum(list_amount) AS v FROM sales GROUP BY 1, 2),
 t AS (SELECT {SUNDAY} AS week_start, sum(list_amount) * CASE WHEN year({SUNDAY}) = 1999 THEN 1.01 ELSE 1 END AS published FROM sales GROUP BY {SUNDAY}),
 s AS (SELECT week_start, sum(v) AS parts_sum FROM r GROUP BY 1)
 SELECT week_start, parts_sum, published, abs(parts_sum - published) / CAST(published AS DOUBLE) AS relative_gap, abs(parts_sum - published) / CAST(published AS DOUBLE) < 0.0001 AS passed FROM s JOIN t USING (week_start)""",
)
def reconcile(t):
    s = base.with_week(t.sales("region", "sale_date", "list_amount"), "sale_date")
    parts = s.groupBy("week_start", "region").agg(F.sum("list_amount").alias("v"))
    total = s.groupBy("week_start").agg(F.sum("list_amount").alias("v"))
    off = F.when(F.year("week_start") == 1999, F.lit("1.01").cast("decimal(3,2)")).otherwise(F.lit(1).cast("decimal(3,2)"))
    return joins.reconcile(parts, total.withColumn("v", F.col("v") * off), "week_start", "v")
