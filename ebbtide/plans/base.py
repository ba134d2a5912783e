"""Frames that many queries start from, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.calendar import week_start_sunday
from ebbtide.functions.scalars import clip
from ebbtide.operators import panels
from ebbtide.operators.ordering import settle
from ebbtide.operators.windows import Series, below
from ebbtide.sources.tables import Tables

ELECTRONIC = ("1-URGENT", "2-HIGH")

SALES = """sales AS (
 SELECT CAST(l_shipdate AS DATE) AS sale_date, l_orderkey AS transaction_number, l_partkey AS product_id,
   l_suppkey AS supplier_id, l_linestatus AS line_status, l_linenumber AS line_number,
   o_custkey AS customer_key, o_orderpriority AS priority, o_orderstatus AS order_status,
   o_orderpriority IN ('1-URGENT', '2-HIGH') AS electronic,
   CASE WHEN l_returnflag = 'R' THEN 'RETURN' ELSE 'INV' END AS transaction_type,
   c_mktsegment AS channel, p_type AS category, p_brand AS brand, p_name AS product_name,
   s_nationkey AS branch, r_name AS region,
   CAST(l_quantity AS DECIMAL(14,2)) AS quantity,
   CAST(l_extendedprice AS DECIMAL(14,2)) AS list_amount,
   CAST(CAST(l_extendedprice AS DECIMAL(14,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS discount_amount,
   n.net AS net_sales, greatest(n.net, 0) AS gross_sales, greatest(-n.net, 0) AS return_value,
   n.net * CAST(l_tax AS DECIMAL(4,2)) AS vat_amount
 FROM lineitem
 JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
 JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
 JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey,
 LATERAL (SELECT CAST((CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END) * CAST(l_extendedprice AS DECIMAL(14,2))
   * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS net) n
)"""

#: Columns of the lines behind each panel measure.
PANEL_COLUMNS = {
    "sales": ("net_sales",),
    "gross": ("net_sales",),
    "returns": ("net_sales",),
    "units": ("quantity",),
    "lines": (),
    "invoices": ("transaction_number",),
    "electronic_invoices": ("transaction_number", "priority"),
    "customers": ("customer_key",),
    "products": ("product_id",),
}


def panel_tx(t: Tables, *entity: str, measures: Sequence[str] = panels.PANEL) -> DataFrame:
    """Lines with what a panel needs, `electronic` taken from the order; tables
    that no measure reads are not joined."""
    wanted = dict.fromkeys(["sale_date", *(c for m in measures for c in PANEL_COLUMNS[m])])
    tx = t.sales(*entity, *[c for c in wanted if c not in entity])
    return tx.withColumn("electronic", F.col("priority").isin(*ELECTRONIC)) if "priority" in wanted else tx


def day_panel(t: Tables, entity: str = "category", measures: Sequence[str] = panels.PANEL) -> DataFrame:
    tx = panel_tx(t, entity, measures=measures).withColumnRenamed(entity, "entity").withColumnRenamed("sale_date", "date")
    return panels.category_day_panel(tx, ("entity",), "date", measures)


def gross_days(t: Tables) -> DataFrame:
    """The daily panel of categories with gross sales alone."""
    return day_panel(t, measures=("gross",))


def _group_sql(keys: str) -> str:
    return f"""SELECT {keys}, sum(net_sales) AS sales, sum(gross_sales) AS gross, sum(return_value) AS returns,
   sum(abs(quantity)) AS units, count(*) AS lines, count(DISTINCT transaction_number) AS invoices,
   count(DISTINCT CASE WHEN electronic THEN transaction_number END) AS electronic_invoices,
   count(DISTINCT customer_key) AS customers, count(DISTINCT product_id) AS products"""


_FILL = ", ".join(
    f"CAST(coalesce({m}, 0) AS DOUBLE) AS {m}" for m in panels.PANEL
)
_RATIOS = """sales / greatest(invoices, 1.0) AS basket, gross / greatest(units, 1.0) AS avg_unit_value,
   returns / greatest(gross, 1.0) AS return_rate, electronic_invoices / greatest(invoices, 1.0) AS electronic_share"""


def panel_sql(entity: str = "category") -> str:
    """CTEs up to `panel(entity, date, ...)`."""
    return f"""{SALES}, raw AS ({_group_sql(entity + ' AS entity, sale_date AS date')} FROM sales GROUP BY 1, 2),
 grid AS (SELECT entity, date FROM (SELECT DISTINCT entity FROM raw),
   (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM raw)),
 filled AS (SELECT g.entity, g.date, {_FILL}, CASE WHEN r.entity IS NULL THEN 1 ELSE 0 END AS structural_zero
   FROM grid g LEFT JOIN raw r ON g.entity = r.entity AND g.date = r.date),
 panel AS (SELECT *, {_RATIOS} FROM filled)"""


def week_panel_sql(entity: str = "category") -> str:
    """CTEs up to `wpanel(entity, week_start, ...)`."""
    return f"""{SALES}, wsales AS (SELECT *, sale_date - CAST(dayofweek(sale_date) AS INTEGER) AS week_start,
   min(sale_date) OVER () AS first_day, max(sale_date) OVER () AS last_day FROM sales),
 wraw AS ({_group_sql(entity + ' AS entity, week_start')} FROM wsales
   WHERE week_start + 6 <= last_day AND week_start >= first_day GROUP BY 1, 2),
 wgrid AS (SELECT entity, week_start FROM (SELECT DISTINCT entity FROM wraw),
   (SELECT CAST(unnest(generate_series(min(week_start), max(week_start), INTERVAL 7 DAY)) AS DATE) AS week_start FROM wraw)),
 wfilled AS (SELECT g.entity, g.week_start, {_FILL}, CASE WHEN r.entity IS NULL THEN 1 ELSE 0 END AS structural_zero
   FROM wgrid g LEFT JOIN wraw r ON g.entity = r.entity AND g.week_start = r.week_start),
 wpanel AS (SELECT *, {_RATIOS} FROM wfilled)"""


def week_panel(t: Tables, entity: str = "category", measures: Sequence[str] = panels.PANEL) -> DataFrame:
    tx = panel_tx(t, entity, measures=measures).withColumnRenamed(entity, "entity")
    return panels.category_week_panel(tx, ("entity",), "sale_date", measures, t.sales("sale_date"))


def company_day(t: Tables) -> DataFrame:
    """Net sales of the whole company, one row per calendar day."""
    return panels.daily_series(t.sales("sale_date", "net_sales")).withColumnsRenamed(
        {"sale_date": "date", "net_sales": "sales"}
    )


COMPANY = f"""{SALES}, cday AS (SELECT sale_date AS date, sum(net_sales) AS s FROM sales GROUP BY 1),
 company AS (SELECT c.date, CAST(coalesce(s, 0) AS DOUBLE) AS sales FROM
   (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM cday) c
   LEFT JOIN cday USING (date))"""


def scores(t: Tables, entity: str = "category") -> DataFrame:
    """scores(entity, date, fold_id, y, future_ratio, score, score_b, score_c).

    Scores come from the trailing ratio, the drawdown and the weekly change;
    the label is the canonical next-7-day drop below 85%. They are rounded,
    so ties occur.
    """
    s = Series("entity", "date")
    gross = panels.double("gross")
    f = day_panel(t, entity, ("gross",)).select(
        "entity",
        "date",
        s.ma_ratio(gross, 7, 28).alias("r"),
        s.drawdown(gross, 28).alias("dd"),
        s.change(gross, 7).alias("ch7"),
        s.forward_ratio(gross, 7, 28).alias("future_ratio"),
    )
    return f.where("r is not null and dd is not null and ch7 is not null and future_ratio is not null").select(
        "entity",
        "date",
        (F.year("date") - 1995).alias("fold_id"),
        below(F.col("future_ratio"), 0.85).alias("y"),
        "future_ratio",
        "r",
        F.round(clip(1.0 - F.col("r") / 2.0, 0.0, 1.0), 4).alias("score"),
        F.round(clip(-F.col("dd"), 0.0, 1.0), 4).alias("score_b"),
        F.round(clip(0.5 - F.col("ch7") / 4.0, 0.0, 1.0), 4).alias("score_c"),
    )


def scores_sql(entity: str = "category") -> str:
    """CTEs up to `scores`."""
    return f"""{panel_sql(entity)}, feat AS (SELECT entity, date, gross,
   CASE WHEN count(gross) OVER w7 = 7 THEN avg(gross) OVER w7 END AS ma7,
   CASE WHEN count(gross) OVER w28 = 28 THEN avg(gross) OVER w28 END AS ma28,
   CASE WHEN count(gross) OVER w28 = 28 THEN max(gross) OVER w28 END AS mx28,
   lag(gross, 7) OVER o AS p7,
   CASE WHEN count(gross) OVER f7 = 7 THEN sum(gross) OVER f7 END AS next7
   FROM panel WINDOW o AS (PARTITION BY entity ORDER BY date),
   w7 AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
   w28 AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 27 PRECEDING AND CURRENT ROW),
   f7 AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING)),
 ratios AS (SELECT entity, date, ma7 / nullif(ma28, 0) AS r, gross / nullif(mx28, 0) - 1 AS dd,
   (gross - p7) / nullif(abs(p7), 0) AS ch7, next7 / nullif(7 * ma28, 0) AS future_ratio FROM feat),
 scores AS (SELECT entity, date, year(date) - 1995 AS fold_id, CAST(future_ratio < 0.85 AS INTEGER) AS y, future_ratio, r,
   round(greatest(0.0, least(1.0, 1 - r / 2)), 4) AS score,
   round(greatest(0.0, least(1.0, -dd)), 4) AS score_b,
   round(greatest(0.0, least(1.0, 0.5 - ch7 / 4)), 4) AS score_c
   FROM ratios WHERE r IS NOT NULL AND dd IS NOT NULL AND ch7 IS NOT NULL AND future_ratio IS NOT NULL)"""


def with_week(df: DataFrame, day: str = "date") -> DataFrame:
    return df.withColumn("week_start", week_start_sunday(F.col(day)))


def settled_scores(t: Tables, entity: str = "category") -> DataFrame:
    """Scores written once, for queries that read them several times."""
    return settle(scores(t, entity))
