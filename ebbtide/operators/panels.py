"""Transactions to daily and weekly panels on a complete calendar."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.calendar import week_start_sunday
from ebbtide.functions.scalars import safe_ratio
from ebbtide.operators.ordering import settle

DAILY_ONLY_TYPES = ("DAILY_AGGREGATE", "DAILY_IMPORT")


def double(col) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("double")


def calendar(df: DataFrame, day: str, by: Sequence[str] = (), step_days: int = 1) -> DataFrame:
    """Every day from the first to the last one, overall or per group."""
    span = df.groupBy(*by).agg(F.min(day).alias("_lo"), F.max(day).alias("_hi")).where("_lo is not null")
    days = F.sequence(F.col("_lo"), F.col("_hi"), F.make_dt_interval(F.lit(step_days)))
    return span.select(*by, F.explode(days).alias(day))


def complete_grid(
    panel: DataFrame, entity: Sequence[str] | str, day: str, measures: Sequence[str], step_days: int = 1
) -> DataFrame:
    """Entities x calendar with measures zero-filled and `structural_zero` set
    on the cells that had no row.

    The panel is written once, as entities, calendar and cells all read it.
    Filter the entities (`keep_keys`) before this step, never after it.
    """
    panel = settle(panel)
    keys = [entity] if isinstance(entity, str) else list(entity)
    entities = panel.select(*keys).distinct()
    # the calendar is a one-row span exploded after the join: no row product
    span = panel.agg(F.min(day).alias("_lo"), F.max(day).alias("_hi"))
    grid = entities.join(F.broadcast(span)).select(
        *keys,
        F.explode(F.sequence(F.col("_lo"), F.col("_hi"), F.make_dt_interval(F.lit(step_days)))).alias(day),
    )
    facts = panel.withColumn("_seen", F.lit(1))
    out = grid.join(facts, [*keys, day], "left")
    filled = {m: F.coalesce(F.col(m), F.lit(0).cast(panel.schema[m].dataType)) for m in measures}
    return out.withColumns(filled).withColumn(
        "structural_zero", F.col("_seen").isNull().cast("int")
    ).drop("_seen")


def transaction_level(sales: DataFrame) -> DataFrame:
    """Drop rows that are daily totals rather than transactions."""
    return sales.where(~F.col("transaction_type").isin(*DAILY_ONLY_TYPES))


def observed_customer(col: str = "customer_key") -> Column:
    """The key when present and not blank."""
    c = F.col(col)
    return F.when(F.trim(c.cast("string")) != "", c)


#: A column and the counts of its distinct values: all of them (None) or those with a line that meets the condition.
Distinct = tuple[Column, dict[str, Column | None]]


def grouped(lines: DataFrame, keys: Sequence[str], sums: dict[str, Column], distinct: Sequence[Distinct]) -> DataFrame:
    """Aggregates and exact distinct counts per group.

    One aggregation with several distinct counts copies every line, with the
    buffers of all sums, once per count. Here the lines are written once and
    each counted column takes only its own (group, value) pairs.
    """
    names = [n for _, counts in distinct for n in counts]
    plain = [c.alias(n) for n, c in sums.items()]
    if len(names) < 2:
        single = [F.countDistinct(v if c is None else F.when(c, v)).alias(n) for v, counts in distinct for n, c in counts.items()]
        return lines.groupBy(*keys).agg(*plain, *single)
    lines = settle(lines)
    whole = lines.groupBy(*keys).agg(*plain) if plain else lines.select(*keys).distinct()
    for value, counts in distinct:
        met = [F.max(F.lit(True) if c is None else F.coalesce(c, F.lit(False))).alias(n) for n, c in counts.items()]
        pairs = lines.withColumn("_value", value).where("_value is not null").groupBy(*keys, "_value").agg(*met)
        part = pairs.groupBy(*keys).agg(*[F.count_if(F.col(n)).alias(n) for n in counts])
        whole = whole.unionByName(part, allowMissingColumns=True)
    # one row per part and group: NULL keys meet here as well
    return whole.groupBy(*keys).agg(
        *[F.max(n).alias(n) for n in sums], *[F.coalesce(F.max(n), F.lit(0)).alias(n) for n in names]
    )


def rich_measures() -> tuple[dict[str, Column], list[Distinct]]:
    """Aggregates, and the columns whose values are counted."""
    return {
        "sales": F.sum("net_sales"),
        "gross": F.sum(F.when(F.col("gross_sales") > 0, F.col("gross_sales")).otherwise(0)),
        "units": F.sum(F.abs("quantity")),
        "transaction_rows": F.count(F.lit(1)),
        "return_value": F.abs(F.sum(F.when(F.col("net_sales") < 0, F.col("net_sales")).otherwise(0))),
    }, [
        (F.col("transaction_number"), {"invoices": None}),
        (observed_customer(), {"customers": None}),
        (F.col("product_id"), {"products": None}),
    ]


RICH = ("sales", "gross", "invoices", "customers", "products", "units", "transaction_rows", "return_value")


def daily_rich(sales: DataFrame, day: str = "sale_date", by: Sequence[str] = ()) -> DataFrame:
    """Ten daily measures of transaction-level sales on a gap-free calendar."""
    per_day = grouped(transaction_level(sales), [*by, day], *rich_measures())
    per_day = settle(per_day.select(*by, day, *[double(m).alias(m) for m in RICH]))
    dates = calendar(per_day, day, by)
    daily = dates.join(per_day, [*by, day], "left").na.fill(0.0, list(RICH))
    return daily.withColumns(
        {
            "avg_invoice": F.col("sales") / F.greatest(F.col("invoices"), F.lit(1.0)),
            "return_rate": F.col("return_value") / F.greatest(F.col("gross"), F.lit(1e-9)),
        }
    )


def daily_series(sales: DataFrame, day: str = "sale_date", value: str = "net_sales", by: Sequence[str] = ()) -> DataFrame:
    """Net sales per day; a day without rows is a zero-sales day."""
    per_day = settle(sales.groupBy(*by, day).agg(F.sum(value).alias(value)))
    dates = calendar(per_day, day, by)
    return dates.join(per_day, [*by, day], "left").withColumn(
        value, F.coalesce(double(value), F.lit(0.0))
    )


def daily_retail(lines: DataFrame) -> DataFrame:
    """Gross, returns, transactions, customers, quantity and net per day, with
    the observed-day flag and the calendar position."""
    grouped = lines.groupBy("sale_date").agg(
        F.sum(F.when(F.col("net_sales") > 0, F.col("net_sales")).otherwise(0)).alias("gross_sales"),
        F.abs(F.sum(F.when(F.col("net_sales") < 0, F.col("net_sales")).otherwise(0))).alias("returns"),
        F.countDistinct("transaction_number").alias("transactions"),
        F.countDistinct(observed_customer()).alias("customers"),
        F.sum(F.when(F.col("quantity") > 0, F.col("quantity")).otherwise(0)).alias("quantity"),
    )
    grouped = grouped.withColumn("net_sales", F.col("gross_sales") - F.col("returns"))
    measures = [c for c in grouped.columns if c != "sale_date"]
    daily = calendar(grouped, "sale_date").join(
        grouped.withColumn("_seen", F.lit(1)), "sale_date", "left"
    )
    return daily.select(
        "sale_date",
        *[F.coalesce(double(m), F.lit(0.0)).alias(m) for m in measures],
        F.coalesce(F.col("_seen"), F.lit(0)).alias("observed_day"),
        F.weekday("sale_date").alias("weekday"),
        F.month("sale_date").alias("month"),
    )


def retail_audit(raw: DataFrame, amount: str = "net_sales") -> DataFrame:
    """How many rows cleaning removes: duplicates, invalid, negative price.

    `raw` carries `parsed_ok` and `unit_price`. Identical rows are counted by
    grouping, so a row repeated very often collapses before the shuffle.
    """
    columns = raw.columns
    counted = raw.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    return counted.agg(
        F.sum("_n").alias("raw_rows"),
        F.sum(F.col("_n") - 1).alias("duplicate_rows"),
        F.sum((~F.col("parsed_ok")).cast("int")).alias("invalid_rows"),
        F.sum((F.col("parsed_ok") & (F.col("unit_price") < 0)).cast("int")).alias("negative_price_rows"),
        F.sum((F.col("parsed_ok") & (F.col("unit_price") >= 0)).cast("int")).alias("clean_rows"),
        F.sum(
            F.when(F.col("parsed_ok") & (F.col("unit_price") >= 0), F.col(amount))
        ).alias("clean_amount"),
    )


PANEL = ("sales", "gross", "returns", "units", "lines", "invoices", "electronic_invoices", "customers", "products")


def panel_measures() -> tuple[dict[str, Column], list[Distinct]]:
    """Aggregates behind the PANEL names, and the columns whose values are
    counted. `electronic` is a property of the invoice: an invoice counts once."""
    zero = F.lit(0).cast("decimal(18,4)")
    return {
        "sales": F.sum("net_sales"),
        "gross": F.sum(F.greatest(F.col("net_sales"), zero)),
        "returns": F.sum(F.greatest(-F.col("net_sales"), zero)),
        "units": F.sum(F.abs("quantity")),
        "lines": F.count(F.lit(1)),
    }, [
        (F.col("transaction_number"), {"invoices": None, "electronic_invoices": F.col("electronic")}),
        (observed_customer(), {"customers": None}),
        (F.col("product_id"), {"products": None}),
    ]


def group_panel(tx: DataFrame, keys: Sequence[str], measures: Sequence[str] = PANEL) -> DataFrame:
    """Additive measures and exact distinct counts per group. Ask only for
    what is read: each counted column is one more pass over the lines."""
    sums, distinct = panel_measures()
    sums = {n: c for n, c in sums.items() if n in measures}
    asked = [(value, {n: c for n, c in counts.items() if n in measures}) for value, counts in distinct]
    return grouped(tx, keys, sums, [(value, counts) for value, counts in asked if counts]).select(*keys, *[double(m).alias(m) for m in measures])


#: name -> (numerator, denominator)
PANEL_RATIOS = {
    "basket": ("sales", "invoices"),
    "avg_unit_value": ("gross", "units"),
    "return_rate": ("returns", "gross"),
    "electronic_share": ("electronic_invoices", "invoices"),
}


def panel_ratios(panel: DataFrame) -> DataFrame:
    """Ratios recomputed from the sums at hand; safe on zero cells."""
    return panel.withColumns(
        {
            name: F.col(top) / F.greatest(F.col(bottom), F.lit(1.0))
            for name, (top, bottom) in PANEL_RATIOS.items()
            if {top, bottom} <= set(panel.columns)
        }
    )


def category_day_panel(
    tx: DataFrame, entity: Sequence[str] = ("category",), day: str = "sale_date", measures: Sequence[str] = PANEL
) -> DataFrame:
    """One row per (entity, day) on the full grid, with the measures asked for."""
    return panel_ratios(complete_grid(group_panel(tx, [*entity, day], measures), entity, day, measures))


def category_week_panel(
    tx: DataFrame,
    entity: Sequence[str] = ("category",),
    day: str = "sale_date",
    measures: Sequence[str] = PANEL,
    dates: DataFrame | None = None,
) -> DataFrame:
    """By Sunday week, only weeks the data covers to their last day. `dates`
    has the same dates as `tx` and is cheaper to read; the two bounds are read
    first, as values, so that the filter on them reaches the scan."""
    first, last = (tx if dates is None else dates).agg(F.min(day), F.max(day)).first()
    week = week_start_sunday(F.col(day))
    whole = (F.date_add(week, 6) <= F.lit(last).cast("date")) & (week >= F.lit(first).cast("date"))
    weekly = tx.where(whole).withColumn("week_start", week)
    panel = group_panel(weekly, [*entity, "week_start"], measures)
    return panel_ratios(complete_grid(panel, entity, "week_start", measures, 7))


def entity_day_exact(tx: DataFrame, entity: Sequence[str], day: str = "sale_date") -> DataFrame:
    """Region x sector days with invoice-level figures.

    Lines are reduced to one row per (entity, day, invoice) first; the invoice
    total, its electronic flag and its distinct sets come from that level, so
    nothing is counted twice.
    """
    keys = [*entity, day]
    per_invoice = tx.groupBy(*keys, "transaction_number").agg(
        F.sum("net_sales").alias("net"),
        F.max(F.col("electronic").cast("int")).alias("electronic"),
        F.count(F.lit(1)).alias("lines"),
    )
    per_day = per_invoice.groupBy(*keys).agg(
        F.sum("net").alias("sales"),
        F.count(F.lit(1)).alias("invoices"),
        F.sum("lines").alias("lines"),
        F.avg(F.col("electronic").cast("double")).alias("electronic_share"),
    ).withColumn("avg_invoice", double("sales") / F.col("invoices"))
    people = (
        tx.select(*keys, observed_customer().alias("_c")).where("_c is not null").distinct()
        .groupBy(*keys).agg(F.count(F.lit(1)).alias("customers"))
    )
    return per_day.join(people, keys, "left").na.fill(0, ["customers"])


def merchant_rollup(panel: DataFrame, day: str, measures: Sequence[str] = PANEL) -> DataFrame:
    """All entities to one row per day; ratios recomputed from the sums."""
    return panel_ratios(panel.groupBy(day).agg(*[F.sum(m).alias(m) for m in measures]))


def market_rollup(panel: DataFrame, week: str, value: str, count: str) -> DataFrame:
    return panel.groupBy(week).agg(
        F.sum(value).alias(value), F.sum(count).alias(count), F.count(F.lit(1)).alias("entities")
    ).withColumn("avg_ticket", safe_ratio(F.col(value), F.col(count)))


def sales_explorer(
    sales: DataFrame,
    start: str | None = None,
    end: str | None = None,
    channel: str | None = None,
    product_id: int | None = None,
    category: str | None = None,
    branches: Sequence[int] | None = None,
    days: int = 180,
) -> DataFrame:
    """Daily figures under optional filters, newest days first."""
    conditions = [
        None if start is None else F.col("sale_date") >= F.lit(start).cast("date"),
        None if end is None else F.col("sale_date") <= F.lit(end).cast("date"),
        None if channel is None else F.col("channel") == channel,
        None if product_id is None else F.col("product_id") == product_id,
        None if category is None else F.col("category") == category,
        None if branches is None else F.col("branch").isin(*branches) if branches else F.lit(False),
    ]
    for c in conditions:
        if c is not None:
            sales = sales.where(c)
    return (
        sales.groupBy("sale_date")
        .agg(
            F.sum("net_sales").alias("net_sales"),
            F.sum("gross_sales").alias("total_amount"),
            F.sum("quantity").alias("quantity"),
            F.countDistinct("transaction_number").alias("transactions"),
            F.sum(
                F.when(F.col("gross_sales") > F.col("net_sales"), F.col("gross_sales") - F.col("net_sales")).otherwise(0)
            ).alias("returns"),
            F.sum(F.abs("discount_amount")).alias("discounts"),
        )
        .orderBy(F.col("sale_date").desc())
        .limit(days)
    )


def with_last_day(sales: DataFrame, day: str = "sale_date", dates: DataFrame | None = None) -> DataFrame:
    """Attach the newest date as `last_day`. It is read first, as one value, so
    that filters on it reach the scan. `dates` has the same dates as `sales`
    and is cheaper to read, such as the lines without their dimensions."""
    newest = (sales if dates is None else dates).agg(F.max(day)).first()[0]
    return sales.withColumn("last_day", F.lit(newest).cast("date"))


def dashboard_kpis(sales: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """The last 30 days against the 30 before, in one pass over 60 days."""
    d, last = F.col("sale_date"), F.col("last_day")
    scoped = with_last_day(sales, dates=dates).where(d > F.date_sub(last, 60)).withColumn(
        "_cur", d >= F.date_sub(last, 29)
    )
    cur = F.col("_cur")
    net, gross = F.col("net_sales"), F.col("gross_sales")
    out = scoped.agg(
        F.max("last_day").alias("data_end"),
        F.sum(F.when(cur, net)).alias("current_sales"),
        F.sum(F.when(~cur, net)).alias("previous_sales"),
        F.countDistinct(F.when(cur, F.col("transaction_number"))).alias("transactions"),
        F.countDistinct(F.when(cur, F.col("product_id"))).alias("products"),
        F.countDistinct(F.when(cur, F.col("channel"))).alias("channels"),
        F.countDistinct(F.when(cur, observed_customer())).alias("active_customers"),
        F.sum(F.when(cur & (gross > net), gross - net).otherwise(0)).alias("returns"),
        F.abs(F.sum(F.when(cur, F.col("discount_amount")))).alias("discounts"),
    )
    cs, ps = F.coalesce(double("current_sales"), F.lit(0.0)), F.coalesce(double("previous_sales"), F.lit(0.0))
    return out.withColumns(
        {
            "change_percent": F.when(ps != 0, (cs - ps) / ps * 100).otherwise(0.0),
            "avg_transaction": F.when(F.col("transactions") > 0, cs / F.col("transactions")).otherwise(0.0),
        }
    )


def recent_series(sales: DataFrame, days: int = 90) -> DataFrame:
    """Net sales of the last `days` days that have rows."""
    return (
        with_last_day(sales)
        .where(F.col("sale_date") >= F.date_sub("last_day", days - 1))
        .groupBy("sale_date")
        .agg(F.sum("net_sales").alias("net_sales"))
    )
