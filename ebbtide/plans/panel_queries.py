"""Daily and weekly panels, KPIs and the flagship query."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbtide.operators import panels
from ebbtide.operators.windows import Series, below
from ebbtide.plans import base
from ebbtide.plans.base import COMPANY, SALES, panel_sql, week_panel_sql
from ebbtide.plans.registry import query


@query(
    "entity_days_at_risk",
    "entity:s date:d ratio:f label:i at_risk:i",
    f"""WITH {SALES}, raw AS (SELECT category AS entity, sale_date AS date, sum(net_sales) AS s FROM sales GROUP BY 1, 2),
 grid AS (SELECT entity, date FROM (SELECT DISTINCT entity FROM raw),
   (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM raw)),
 p AS (SELECT entity, date, CAST(coalesce(s, 0) AS DOUBLE) AS v FROM grid LEFT JOIN raw USING (entity, date)),
 f AS (SELECT entity, date,
   CASE WHEN count(*) OVER w7 = 7 THEN avg(v) OVER w7 END AS m7,
   CASE WHEN count(*) OVER w28 = 28 THEN avg(v) OVER w28 END AS m28,
   CASE WHEN count(*) OVER f7 = 7 THEN sum(v) OVER f7 END AS n7 FROM p
   WINDOW w7 AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
   w28 AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 27 PRECEDING AND CURRENT ROW),
   f7 AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING))
 SELECT entity, date, m7 / nullif(m28, 0) AS ratio, CAST(n7 / nullif(7 * m28, 0) < 0.85 AS INTEGER) AS label,
   CAST(m7 / nullif(m28, 0) < 0.9 AS INTEGER) AS at_risk
 FROM f WHERE m28 IS NOT NULL""",
)
def entity_days_at_risk(t):
    tx = t.sales("category", "sale_date", "net_sales")
    daily = tx.groupBy(F.col("category").alias("entity"), F.col("sale_date").alias("date")).agg(
        F.sum("net_sales").alias("sales")
    )
    grid = panels.complete_grid(daily, "entity", "date", ["sales"]).withColumn("v", panels.double("sales"))
    s = Series("entity", "date")
    return (
        grid.select(
            "entity",
            "date",
            s.rolling("v", 28).alias("m28"),
            s.ma_ratio("v", 7, 28).alias("ratio"),
            below(s.forward_ratio("v", 7, 28), 0.85).alias("label"),
        )
        .where("m28 is not null")
        .withColumn("at_risk", below(F.col("ratio"), 0.9))
    )


@query(
    "daily_rich",
    "date:d sales:f4 gross:f4 invoices:i customers:i products:i units:f4 transaction_rows:i return_value:f4 avg_invoice:f4 return_rate:f",
    f"""WITH {SALES}, g AS (SELECT sale_date AS date, sum(net_sales) AS sales, sum(gross_sales) AS gross,
   count(DISTINCT transaction_number) AS invoices, count(DISTINCT customer_key) AS customers,
   count(DISTINCT product_id) AS products, sum(abs(quantity)) AS units, count(*) AS transaction_rows,
   abs(sum(CASE WHEN net_sales < 0 THEN net_sales ELSE 0 END)) AS return_value
   FROM sales WHERE transaction_type NOT IN ('DAILY_AGGREGATE', 'DAILY_IMPORT') GROUP BY 1),
 c AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM g),
 f AS (SELECT c.date, CAST(coalesce(sales, 0) AS DOUBLE) AS sales, CAST(coalesce(gross, 0) AS DOUBLE) AS gross,
   coalesce(invoices, 0) AS invoices, coalesce(customers, 0) AS customers, coalesce(products, 0) AS products,
   coalesce(units, 0) AS units, coalesce(transaction_rows, 0) AS transaction_rows,
   CAST(coalesce(return_value, 0) AS DOUBLE) AS return_value FROM c LEFT JOIN g USING (date))
 SELECT *, sales / greatest(invoices, 1) AS avg_invoice, return_value / greatest(gross, 1e-9) AS return_rate FROM f""",
)
def daily_rich(t):
    sales = t.sales(
        "sale_date", "transaction_number", "transaction_type", "customer_key", "product_id", "quantity",
        "net_sales", "gross_sales",
    )
    return panels.daily_rich(sales).withColumnRenamed("sale_date", "date")


@query("daily_series", "date:d sales:f4", f"WITH {COMPANY} SELECT date, sales FROM company")
def daily_series(t):
    return base.company_day(t)


@query(
    "daily_series_by_region",
    "region:s sale_date:d net_sales:f4",
    f"""WITH {SALES}, g AS (SELECT region, sale_date, sum(net_sales) AS s FROM sales GROUP BY 1, 2),
 c AS (SELECT region, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS sale_date FROM
   (SELECT region, min(sale_date) AS lo, max(sale_date) AS hi FROM g GROUP BY 1))
 SELECT region, sale_date, coalesce(s, 0) AS net_sales FROM c LEFT JOIN g USING (region, sale_date)""",
)
def daily_series_by_region(t):
    return panels.daily_series(t.sales("region", "sale_date", "net_sales"), by=["region"])


@query(
    "daily_retail",
    "sale_date:d gross_sales:f4 returns:f4 transactions:i customers:i quantity:f4 net_sales:f4 observed_day:i weekday:i month:i",
    f"""WITH {SALES},
 g AS (SELECT sale_date, sum(gross_sales) AS gross_sales, sum(return_value) AS returns,
   count(DISTINCT transaction_number) AS transactions, count(DISTINCT customer_key) AS customers,
   sum(CASE WHEN quantity > 0 THEN quantity ELSE 0 END) AS quantity FROM sales GROUP BY 1),
 c AS (SELECT CAST(unnest(generate_series(min(sale_date), max(sale_date), INTERVAL 1 DAY)) AS DATE) AS sale_date FROM g)
 SELECT c.sale_date, coalesce(gross_sales, 0) AS gross_sales, coalesce(returns, 0) AS returns,
   coalesce(transactions, 0) AS transactions, coalesce(customers, 0) AS customers, coalesce(quantity, 0) AS quantity,
   coalesce(gross_sales - returns, 0) AS net_sales, CASE WHEN g.sale_date IS NULL THEN 0 ELSE 1 END AS observed_day,
   isodow(c.sale_date) - 1 AS weekday, month(c.sale_date) AS month FROM c LEFT JOIN g USING (sale_date)""",
)
def daily_retail(t):
    return panels.daily_retail(
        t.sales("sale_date", "transaction_number", "customer_key", "quantity", "net_sales")
    )


@query(
    "retail_audit",
    "raw_rows:i duplicate_rows:i invalid_rows:i negative_price_rows:i clean_rows:i clean_amount:f4",
    f"""WITH {SALES}, raw AS (SELECT transaction_number, net_sales, quantity <> 7 AS parsed_ok, net_sales AS unit_price FROM sales
   UNION ALL SELECT transaction_number, net_sales, quantity <> 7, net_sales FROM sales WHERE transaction_type = 'RETURN'),
 c AS (SELECT *, count(*) AS n FROM raw GROUP BY ALL)
 SELECT sum(n) AS raw_rows, sum(n - 1) AS duplicate_rows, count(*) FILTER (NOT parsed_ok) AS invalid_rows,
   count(*) FILTER (parsed_ok AND unit_price < 0) AS negative_price_rows,
   count(*) FILTER (parsed_ok AND unit_price >= 0) AS clean_rows,
   sum(net_sales) FILTER (parsed_ok AND unit_price >= 0) AS clean_amount FROM c""",
)
def retail_audit(t):
    lines = t.sales("transaction_number", "transaction_type", "quantity", "net_sales").select(
        "transaction_number", "transaction_type", "net_sales",
        (F.col("quantity") != 7).alias("parsed_ok"), F.col("net_sales").alias("unit_price"),
    )
    raw = lines.drop("transaction_type").unionByName(
        lines.where("transaction_type = 'RETURN'").drop("transaction_type")
    )
    return panels.retail_audit(raw)


_EXPLORER_WHERE = "sale_date >= DATE '1996-01-01' AND channel = 'BUILDING'"


@query(
    "sales_explorer",
    "sale_date:d net_sales:f4 total_amount:f4 quantity:f4 transactions:i returns:f4 discounts:f4",
    f"""WITH {SALES} SELECT sale_date, sum(net_sales) AS net_sales, sum(gross_sales) AS total_amount, sum(quantity) AS quantity,
   count(DISTINCT transaction_number) AS transactions,
   sum(CASE WHEN gross_sales > net_sales THEN gross_sales - net_sales ELSE 0 END) AS returns,
   sum(abs(discount_amount)) AS discounts FROM sales WHERE {_EXPLORER_WHERE}
 GROUP BY 1 ORDER BY 1 DESC LIMIT 180""",
)
def sales_explorer(t):
    return panels.sales_explorer(
        t.sales("sale_date", "transaction_number", "channel", "quantity", "net_sales", "gross_sales", "discount_amount"),
        start="1996-01-01",
        channel="BUILDING",
    )


@query(
    "sales_explorer_by_branch_product",
    "sale_date:d net_sales:f4 transactions:i",
    f"""WITH {SALES} SELECT sale_date, sum(net_sales) AS net_sales, count(DISTINCT transaction_number) AS transactions
 FROM sales WHERE branch IN (1, 2, 3) AND category = 'PROMO' AND sale_date <= DATE '2001-06-30' GROUP BY 1 ORDER BY 1 DESC LIMIT 180""",
)
def sales_explorer_by_branch_product(t):
    return panels.sales_explorer(
        t.sales(
            "sale_date", "transaction_number", "branch", "category", "quantity", "net_sales", "gross_sales",
            "discount_amount",
        ),
        end="2001-06-30",
        category="PROMO",
        branches=[1, 2, 3],
    )


@query(
    "dashboard_kpis",
    "data_end:d current_sales:f4 previous_sales:f4 transactions:i products:i channels:i active_customers:i returns:f4 discounts:f4 change_percent:f avg_transaction:f4",
    f"""WITH {SALES}, b AS (SELECT *, max(sale_date) OVER () AS last_day FROM sales),
 p AS (SELECT *, sale_date >= last_day - 29 AS cur FROM b WHERE sale_date > last_day - 60),
 k AS (SELECT max(last_day) AS data_end, sum(net_sales) FILTER (cur) AS current_sales, sum(net_sales) FILTER (NOT cur) AS previous_sales,
   count(DISTINCT transaction_number) FILTER (cur) AS transactions, count(DISTINCT product_id) FILTER (cur) AS products,
   count(DISTINCT channel) FILTER (cur) AS channels, count(DISTINCT customer_key) FILTER (cur) AS active_customers,
   sum(gross_sales - net_sales) FILTER (cur AND gross_sales > net_sales) AS returns,
   abs(sum(discount_amount) FILTER (cur)) AS discounts FROM p)
 SELECT *, (CAST(current_sales AS DOUBLE) - CAST(previous_sales AS DOUBLE)) / CAST(previous_sales AS DOUBLE) * 100 AS change_percent,
   CAST(current_sales AS DOUBLE) / transactions AS avg_transaction FROM k""",
)
def dashboard_kpis(t):
    return panels.dashboard_kpis(
        t.sales(
            "sale_date", "transaction_number", "product_id", "customer_key", "channel", "net_sales", "gross_sales",
            "discount_amount",
        ),
        t.sales("sale_date"),
    )


@query(
    "dashboard_series",
    "sale_date:d net_sales:f4",
    f"""WITH {SALES} SELECT sale_date, sum(net_sales) AS net_sales FROM sales
 WHERE sale_date >= (SELECT max(sale_date) FROM sales) - 89 GROUP BY 1""",
)
def dashboard_series(t):
    return panels.recent_series(t.sales("sale_date", "net_sales"))


_PANEL_COLS = (
    "sales:f4 gross:f4 returns:f4 units:f4 lines:i invoices:i electronic_invoices:i customers:i products:i "
    "structural_zero:i basket:f4 avg_unit_value:f4 return_rate:f electronic_share:f"
)


@query("category_day_panel", "entity:s date:d " + _PANEL_COLS, f"WITH {panel_sql()} SELECT * FROM panel")
def category_day_panel(t):
    return base.day_panel(t)


@query("category_week_panel", "entity:s week_start:d " + _PANEL_COLS, f"WITH {week_panel_sql()} SELECT * FROM wpanel")
def category_week_panel(t):
    return base.week_panel(t)


@query(
    "region_sector_day_panel",
    "region:s sector:s sale_date:d sales:f4 invoices:i lines:i electronic_share:f avg_invoice:f4 customers:i",
    f"""WITH {SALES}, inv AS (SELECT region, category AS sector, sale_date, transaction_number, sum(net_sales) AS net,
   max(CAST(electronic AS INTEGER)) AS e, count(*) AS lines FROM sales GROUP BY 1, 2, 3, 4),
 d AS (SELECT region, sector, sale_date, sum(net) AS sales, count(*) AS invoices, sum(lines) AS lines,
   avg(CAST(e AS DOUBLE)) AS electronic_share, CAST(sum(net) AS DOUBLE) / count(*) AS avg_invoice FROM inv GROUP BY 1, 2, 3),
 c AS (SELECT region, category AS sector, sale_date, count(DISTINCT customer_key) AS customers FROM sales GROUP BY 1, 2, 3)
 SELECT * FROM d JOIN c USING (region, sector, sale_date)""",
)
def region_sector_day_panel(t):
    tx = base.panel_tx(t, "region", "category").withColumnRenamed("category", "sector")
    return panels.entity_day_exact(tx, ["region", "sector"])


_WEEKLY_MARKET = """wk AS (SELECT category AS entity, sale_date - CAST(dayofweek(sale_date) AS INTEGER) AS week_start,
   CAST(sum(list_amount) AS DOUBLE) AS market_value FROM sales GROUP BY 1, 2)"""


@query(
    "sector_day_panel",
    "entity:s date:d sales:f4 basket:f4 return_rate:f structural_zero:i week_start:d market_value:f4",
    f"""WITH {panel_sql()}, {_WEEKLY_MARKET}, m AS (SELECT *, date - CAST(dayofweek(date) AS INTEGER) AS ws FROM panel)
 SELECT m.entity, m.date, sales, basket, return_rate, structural_zero, m.ws AS week_start, market_value
 FROM m LEFT JOIN wk ON m.entity = wk.entity AND wk.week_start = m.ws - 7""",
)
def sector_day_panel(t):
    from ebbtide.operators.joins import prior_week_lookup

    weekly = (
        base.with_week(t.sales("category", "sale_date", "list_amount"), "sale_date")
        .groupBy(F.col("category").alias("entity"), "week_start")
        .agg(panels.double(F.sum("list_amount")).alias("market_value"))
    )
    days = base.day_panel(t, measures=("sales", "gross", "returns", "invoices"))
    return prior_week_lookup(days, weekly, "date", ["market_value"], by=["entity"])


@query(
    "merchant_rollup",
    "date:d sales:f4 gross:f4 returns:f4 units:f4 invoices:i basket:f1 return_rate:f",
    f"""WITH {panel_sql()}, g AS (SELECT date, sum(sales) AS sales, sum(gross) AS gross, sum(returns) AS returns, sum(units) AS units,
   sum(invoices) AS invoices FROM panel GROUP BY 1)
 SELECT *, sales / greatest(invoices, 1.0) AS basket, returns / greatest(gross, 1.0) AS return_rate FROM g""",
)
def merchant_rollup(t):
    return panels.merchant_rollup(base.day_panel(t), "date")


@query(
    "market_rollup",
    "week_start:d gross:f4 lines:i entities:i avg_ticket:f1",
    f"""WITH {week_panel_sql('region')} SELECT week_start, sum(gross) AS gross, sum(lines) AS lines, count(*) AS entities,
   sum(gross) / nullif(sum(lines), 0) AS avg_ticket FROM wpanel GROUP BY 1""",
)
def market_rollup(t):
    return panels.market_rollup(base.week_panel(t, "region", ("gross", "lines")), "week_start", "gross", "lines")
