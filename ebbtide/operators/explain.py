"""What changed between two adjacent windows, and which signal fell most."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.functions.scalars import pct_points, severity
from ebbtide.operators.ordering import settle
from ebbtide.operators.panels import double, observed_customer, transaction_level

MIN_SIGNAL_PCT = 2.0

# Signal weights, units and English texts.
WEIGHTS = {
    "quantity_decline": 1.15,
    "active_customer_decline": 1.10,
    "transaction_decline": 1.00,
    "basket_decline": 1.05,
    "channel_decline": 0.92,
    "product_decline": 0.88,
}
ACTIONS = {
    "quantity_decline": "Review inventory availability and demand for top-selling products, then check whether the drop is driven by stock-outs or weaker demand.",
    "active_customer_decline": "Review customers who stopped purchasing in the latest 7 days and prioritize reactivation of high-value customers.",
    "transaction_decline": "Review visits, conversion and orders by channel to identify why transaction count declined.",
    "basket_decline": "Review product mix, pricing and discounts, then consider bundles or offers that raise average transaction value.",
    "channel_decline": "Inspect the declining channel first: orders, conversion, availability and pricing versus the previous period.",
    "product_decline": "Start with the most-declining product and review its availability, price, demand and channel performance before acting.",
}
NO_SIGNAL_ACTION = "Continue monitoring and review products, customers and channels if the downward trend persists."


def with_period(sales: DataFrame, window: int = 7, by: Sequence[str] = (), dates: DataFrame | None = None) -> DataFrame:
    """Rows of the newest window and the one before it, tagged `current` or
    `previous`; per entity with `by`. Overall, the newest date is read first;
    `dates` (sale_date, transaction_type) may stand for `sales` there."""
    rows = transaction_level(sales)
    by = list(by)
    if by:
        # written once, so its size is known and the lines are not dealt by group
        newest = settle(rows.groupBy(*by).agg(F.max("sale_date").alias("_last")))
        first = newest.agg(F.min("_last")).first()[0]
        joined = rows.where(F.col("sale_date") > F.date_sub(F.lit(first).cast("date"), 2 * window)).join(newest, by)
    else:
        newest = (rows if dates is None else transaction_level(dates)).agg(F.max("sale_date")).first()[0]
        joined = rows.withColumn("_last", F.lit(newest).cast("date"))
    d, end = F.col("sale_date"), F.col("_last")
    period = F.when(d > F.date_sub(end, window), "current").when(d > F.date_sub(end, 2 * window), "previous")
    return joined.withColumn("period", period).where("period is not null").drop("_last")


def period_totals(tagged: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sales, quantity, transactions, discounts, customers and basket of each
    window."""
    out = tagged.groupBy(*by, "period").agg(
        F.coalesce(F.sum("net_sales"), F.lit(0)).alias("sales"),
        F.coalesce(F.sum("quantity"), F.lit(0)).alias("quantity"),
        F.countDistinct("transaction_number").alias("transactions"),
        F.coalesce(F.sum(F.abs("discount_amount")), F.lit(0)).alias("discounts"),
        F.countDistinct(observed_customer()).alias("customers"),
    )
    return out.withColumn(
        "basket", F.when(F.col("transactions") > 0, double("sales") / F.col("transactions")).otherwise(0.0)
    )


def period_by_dimension(tagged: DataFrame, dimension: str, by: Sequence[str] = ()) -> DataFrame:
    """Net sales of both windows per dimension value; no value reads "Unknown"."""
    name = F.coalesce(F.nullif(F.col(dimension).cast("string"), F.lit("")), F.lit("Unknown")).alias("name")

    def side(p: str) -> Column:
        return F.sum(F.when(F.col("period") == p, F.col("net_sales")).otherwise(0)).alias(p)

    return tagged.groupBy(*by, name).agg(side("current"), side("previous"))


def top_decliner(periods: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The name with the largest drop; equal drops go to the first name."""
    drop = F.col("previous") - F.col("current")
    falling = periods.where((F.col("previous") > 0) & (drop > 0)).withColumn("drop_amount", drop)
    best = Window.partitionBy(*by).orderBy(F.col("drop_amount").desc(), F.col("name").asc())
    if by:
        # pruned to one row per group on the map side
        chosen = falling.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")
    else:
        chosen = falling.orderBy(F.col("drop_amount").desc(), F.col("name")).limit(1)
    return chosen.withColumn("change_pct", pct_points(F.col("current"), F.col("previous")))


def _signal(totals: DataFrame, by: Sequence[str], code: str, measure: str, guard: str | None) -> DataFrame:
    def side(p: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("period") == p, double(measure))), F.lit(0.0)).alias(p)

    rows = totals.groupBy(*by).agg(side("current"), side("previous"))
    if guard:
        rows = rows.where(F.col(guard) > 0)
    return rows.select(
        *by, F.lit(code).alias("code"), F.lit(None).cast("string").alias("entity_name"), "current", "previous",
        pct_points(F.col("current"), F.col("previous")).alias("change_pct"),
    )


def decline_signals(tagged: DataFrame, by: Sequence[str] = (), channel: str = "channel", product: str = "product_name") -> DataFrame:
    """One row per signal with its two window values."""
    by = list(by)
    # two short windows of rows, read by six signals
    tagged = settle(tagged)
    totals = period_totals(tagged, by)
    rows = _signal(totals, by, "quantity_decline", "quantity", None)
    rows = rows.unionByName(_signal(totals, by, "active_customer_decline", "customers", "previous"))
    rows = rows.unionByName(_signal(totals, by, "transaction_decline", "transactions", "current"))
    rows = rows.unionByName(_signal(totals, by, "basket_decline", "basket", "previous"))
    for code, dim in (("channel_decline", channel), ("product_decline", product)):
        worst = top_decliner(period_by_dimension(tagged, dim, by), by)
        rows = rows.unionByName(
            worst.select(
                *by, F.lit(code).alias("code"), F.col("name").alias("entity_name"), double("current").alias("current"),
                double("previous").alias("previous"), "change_pct",
            )
        )
    return rows


def rank_drivers(signals: DataFrame, by: Sequence[str] = (), keep: int = 4) -> DataFrame:
    """The strongest falling signals with their share of the kept total.

    Six rows per entity at most, so the ranking windows are tiny.
    """
    by = list(by)
    weight, size = F.lit(None).cast("double"), F.abs("change_pct")
    for code, w in WEIGHTS.items():
        scaled = F.least(F.lit(100.0), size) if code in ("channel_decline", "product_decline") else size
        weight = F.when(F.col("code") == code, scaled * w).otherwise(weight)
    falling = signals.where(F.col("change_pct") <= -MIN_SIGNAL_PCT).withColumn("score", weight)
    best = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("code"))
    ranked = falling.withColumn("driver_rank", F.row_number().over(best)).where(F.col("driver_rank") <= keep)
    total = F.sum("score").over(Window.partitionBy(*by))
    return ranked.withColumns(
        {
            "strength_pct": F.bround(F.col("score") / F.nullif(total, F.lit(0.0)) * 100.0, 1),
            "severity": severity(F.col("change_pct")),
        }
    )


def driver_text(drivers: DataFrame) -> DataFrame:
    """English summary and action of each driver."""
    c, p, n = F.col("current"), F.col("previous"), F.col("entity_name")
    code = F.col("code")
    summary = (
        F.when(code == "quantity_decline", F.format_string("Sold units fell from %.0f to %.0f.", p, c))
        .when(code == "active_customer_decline", F.format_string("Active customers fell from %.0f to %.0f.", p, c))
        .when(code == "transaction_decline", F.format_string("Transactions fell from %.0f to %.0f.", p, c))
        .when(code == "basket_decline", F.format_string("Average transaction value fell from %.2f to %.2f.", p, c))
        .when(code == "channel_decline", F.format_string("%s had the largest channel-value drop: %.2f → %.2f.", n, p, c))
        .when(code == "product_decline", F.format_string("This product had the largest value decline: %.2f → %.2f.", p, c))
    )
    action = F.lit(NO_SIGNAL_ACTION)
    for k, text in ACTIONS.items():
        action = F.when(code == k, text).otherwise(action)
    return drivers.withColumns({"summary": summary, "action": action})


def filter_options(sales: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values in scope per filter column.

    Unpivoted first: one pass collects the values of every column.
    """
    long = sales.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "filter", "value")
    return long.where("value is not null").distinct().orderBy("filter", "value")


def recent(df: DataFrame, order: str, n: int, status: Column | None = None, tie: str | None = None) -> DataFrame:
    """The newest n rows, optionally of one status."""
    rows = df if status is None else df.where(status)
    keys = [F.col(order).desc()] + ([F.col(tie).desc()] if tie else [])
    return rows.orderBy(*keys).limit(n)


def latest_state_summary(alerts: DataFrame, forecasts: DataFrame, run_id, n: int = 5) -> tuple[DataFrame, DataFrame]:
    """Open alerts of a run: their number and the newest few."""
    mine = alerts.join(forecasts.where(F.col("run_id") == run_id).select("forecast_id"), "forecast_id").where(
        ~F.col("is_resolved")
    )
    count = mine.agg(F.count(F.lit(1)).alias("active_alerts"))
    return count, mine.orderBy(F.col("created_at").desc(), F.col("alert_id").desc()).limit(n)


def changed_alerts(a: DataFrame, b: DataFrame, keys: Sequence[str], decision: str) -> DataFrame:
    """Rows decided differently by two policies."""
    left = a.select(*keys, F.col(decision).alias("before"))
    right = b.select(*keys, F.col(decision).alias("after"))
    return left.join(right, list(keys)).where(~F.col("before").eqNullSafe(F.col("after")))
