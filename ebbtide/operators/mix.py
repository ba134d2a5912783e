"""Composition of sales: concentration, churn, prices, cross-sections, and
calibration to a market series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.functions.scalars import clip, ratio_to_risk, safe_ratio
from ebbtide.operators.joins import set_overlap
from ebbtide.operators.ordering import dealt, exact_quantiles, melt, settle
from ebbtide.operators.panels import double, observed_customer
from ebbtide.operators.windows import Series


def concentration(df: DataFrame, group: Sequence[str], item: str, value: str) -> DataFrame:
    """HHI, largest share and top-5 share of non-negative item values.

    The sum of squares and the sum are plain aggregates; the top five are
    found with a pruned ranking, so large groups are not sorted whole.
    """
    group = list(group)
    items = df.groupBy(*group, item).agg(F.sum(value).alias("_v")).withColumn(
        "_v", F.greatest(double("_v"), F.lit(0.0))
    )
    totals = items.groupBy(*group).agg(
        F.sum("_v").alias("_total"), F.sum(F.col("_v") * F.col("_v")).alias("_squares"), F.max("_v").alias("_top1")
    )
    best = Window.partitionBy(*group).orderBy(F.col("_v").desc())
    top5 = (
        items.withColumn("_rank", F.row_number().over(best)).where("_rank <= 5")
        .groupBy(*group).agg(F.sum("_v").alias("_top5"))
    )
    some = F.col("_total") > 0
    return totals.join(top5, group).select(
        *group,
        F.when(some, F.col("_squares") / (F.col("_total") * F.col("_total"))).otherwise(0.0).alias("hhi"),
        F.when(some, F.col("_top1") / F.col("_total")).otherwise(0.0).alias("top1_share"),
        F.when(some, F.col("_top5") / F.col("_total")).otherwise(0.0).alias("top5_share"),
    )


def price_change_index(
    tx: DataFrame, group: Sequence[str], week: str, item: str, amount: str, quantity: str
) -> DataFrame:
    """Quantity-weighted price move of each group and week against the item's
    own average price over the four weeks before."""
    group = list(group)
    priced = tx.groupBy(*group, week, item).agg(F.sum(amount).alias("_a"), F.sum(quantity).alias("_q"))
    priced = priced.withColumn("_t", F.datediff(week, F.lit("1970-01-01").cast("date")))
    before = Window.partitionBy(*group, item).orderBy("_t").rangeBetween(-28, -7)
    d = priced.withColumns(
        {
            "_price": safe_ratio(F.col("_a"), F.col("_q")),
            "_prev": safe_ratio(F.sum("_a").over(before), F.sum("_q").over(before)),
        }
    )
    known = F.col("_price").isNotNull() & (F.col("_prev") > 0) & (F.col("_q") > 0)
    move = F.when(known, F.col("_price") / F.col("_prev") - 1.0)
    weight = F.when(known, double("_q"))
    d = d.withColumns({"_move": move, "_w": weight})
    out = d.groupBy(*group, week).agg(
        F.sum(F.col("_move") * F.col("_w")).alias("_mw"),
        F.sum(F.when(F.col("_move") > 0.05, F.col("_w")).otherwise(0.0)).alias("_up"),
        F.sum(F.when(F.col("_move") < -0.05, F.col("_w")).otherwise(0.0)).alias("_down"),
        F.sum("_w").alias("_weight"),
    )
    return out.select(
        *group,
        week,
        *[
            F.coalesce(safe_ratio(F.col(c), F.col("_weight")), F.lit(0.0)).alias(n)
            for c, n in (("_mw", "price_change"), ("_up", "increase_share"), ("_down", "decrease_share"))
        ],
    )


def churn_rates(tx: DataFrame, group: Sequence[str], week: str, item: str) -> DataFrame:
    """Retention, dropout and newcomer rates against the last four weeks."""
    counts = set_overlap(tx, group, week, item)
    prev = F.greatest(F.col("previous_items"), F.lit(1)).cast("double")
    cur = F.greatest(F.col("current_items"), F.lit(1)).cast("double")
    return counts.withColumns(
        {
            "retention": F.col("kept") / prev,
            "dropout": F.col("dropped") / prev,
            "new_rate": F.col("new") / cur,
        }
    )


def items_per_invoice(tx: DataFrame, group: Sequence[str], invoice: str, item: str) -> DataFrame:
    per_invoice = (
        tx.select(*group, invoice, item).distinct().groupBy(*group, invoice).agg(F.count(F.lit(1)).alias("_n"))
    )
    return per_invoice.groupBy(*group).agg(F.avg("_n").alias("items_per_invoice"))


def cross_section_stats(panel: DataFrame, day: str, signals: Sequence[str], weight: str | None = None) -> DataFrame:
    """Per day and signal over all entities: mean, population std, p10, p90
    and the mean weighted by non-negative `weight`. One row per (day, signal)."""
    keys = [day] if weight is None else [day, weight]
    long = melt(panel, keys, signals, "signal", "value").where("value is not null")
    aggs = [F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")]
    if weight is not None:
        w = F.greatest(F.coalesce(double(weight), F.lit(0.0)), F.lit(0.0))
        aggs.append(safe_ratio(F.sum(w * F.col("value")), F.sum(w)).alias("weighted_mean"))
    stats = long.groupBy(day, "signal").agg(*aggs)
    spread = exact_quantiles(long, "value", [0.10, 0.90], [day, "signal"]).select(
        day, "signal", F.col("q10").alias("p10"), F.col("q90").alias("p90")
    )
    return stats.join(spread, [day, "signal"])


def breadth(panel: DataFrame, day: str, ratio: str, change: str, deltas: Sequence[int] = (7, 28)) -> DataFrame:
    """Share of entities below / above their level per day, and how these
    shares moved. A missing signal counts as not met."""

    def share(condition):
        return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))

    r, c = F.col(ratio), F.col(change)
    shares = {
        "below_090": share(r < 0.90),
        "below_100": share(r < 1.00),
        "above_110": share(r > 1.10),
        "negative": share(c < 0.0),
        "severe": share(c < -0.15),
    }
    daily = panel.groupBy(day).agg(*[v.alias(k) for k, v in shares.items()])
    s = Series([], day)
    return daily.withColumns(
        {f"{k}_delta{d}": F.col(k) - s.lag(k, d) for k in shares for d in deltas}
    )


def pivot_features(panel: DataFrame, day: str, entity: str, entities: Sequence[str], features: Sequence[str]) -> DataFrame:
    """One row per day with entity x feature columns; the entity list is given,
    so no extra pass looks for it."""
    wide = panel.groupBy(day).pivot(entity, list(entities)).agg(
        *[F.first(f, ignorenulls=True).alias(f) for f in features]
    )
    if len(features) == 1:
        wide = wide.select(day, *[F.col(f"`{e}`").alias(f"{e}_{features[0]}") for e in entities])
    return wide


def value_weighted_share(tx: DataFrame, day: str, invoice: str, value: str, flags: dict[str, str], ordinal: str) -> DataFrame:
    """Value-weighted shares of row flags, mean and median invoice total and
    the mean of an ordinal score per day.

    The lines are written once; an invoice has few of them, so they are dealt
    by day and invoice before they are summed.
    """
    tx = settle(tx)
    rows = tx.count()
    v = F.greatest(double(value), F.lit(0.0))
    shares = tx.groupBy(day).agg(
        *[
            F.coalesce(safe_ratio(F.sum(v * F.expr(cond).cast("double")), F.sum(v)), F.lit(0.0)).alias(name)
            for name, cond in flags.items()
        ],
        F.avg(ordinal).alias("ordinal_mean"),
    )
    lines = dealt(tx.select(day, invoice, value), rows, day, invoice)
    invoices = settle(lines.groupBy(day, invoice).agg(double(F.sum(value)).alias("_total")))
    totals = invoices.groupBy(day).agg(F.avg("_total").alias("avg_invoice"))
    medians = exact_quantiles(invoices, "_total", [0.5], [day], rows).select(day, F.col("q50").alias("median_invoice"))
    return shares.join(totals, day).join(medians, day)


def customer_mix_day(tx: DataFrame, day: str = "sale_date", customer: str = "customer_key") -> DataFrame:
    """Unique, new and returning customers per day. Lines collapse to one row
    per customer and day before anything is compared."""
    from ebbtide.operators.joins import first_seen

    seen = first_seen(tx.select(day, observed_customer(customer).alias(customer)), customer, day)
    out = seen.groupBy(day).agg(
        F.count(F.lit(1)).alias("unique_customers"),
        F.sum(F.col("is_new").cast("long")).alias("new_customers"),
        F.sum((~F.col("is_new")).cast("long")).alias("returning_customers"),
    )
    n = F.greatest(F.col("unique_customers"), F.lit(1))
    return out.withColumns(
        {"new_share": F.col("new_customers") / n, "returning_share": F.col("returning_customers") / n}
    )


def weekly_risk_summary(scores: DataFrame, week: str, risk: str, precursors: str) -> DataFrame:
    """Risk of all entities per week, exposed to the week after it."""
    r, p = F.col(risk), F.col(precursors)
    out = scores.groupBy(week).agg(
        F.avg(r).alias("risk_mean"),
        F.max(r).alias("risk_max"),
        F.avg((r >= 0.25).cast("double")).alias("risk_share_25"),
        F.avg((r >= 0.50).cast("double")).alias("risk_share_50"),
        F.avg(p).alias("precursor_mean"),
        F.avg((p >= 2).cast("double")).alias("precursor_share_2"),
    )
    q = exact_quantiles(scores, risk, [0.75, 0.90], [week]).select(
        week, F.col("q75").alias("risk_p75"), F.col("q90").alias("risk_p90")
    )
    return out.join(q, week).withColumn("merchant_week_start", F.date_add(week, 7)).drop(week)


def sector_to_merchant_ratio(pred: DataFrame, day: str, sector: str, ratio: str, baseline: str) -> DataFrame:
    """Sector forecasts weighted by their baselines to one merchant ratio and
    risk. A sector without a forecast has no weight."""
    clipped = clip(F.col(ratio).cast("double"), 0.15, 3.0)
    out = pred.groupBy(day).agg(
        F.sum(clipped * F.col(baseline)).alias("_future"),
        F.sum(F.when(F.col(ratio).isNotNull(), F.col(baseline))).alias("_base"),
        F.countDistinct(sector).alias("sectors_scored"),
    )
    out = out.withColumn("predicted_total_ratio", safe_ratio(F.col("_future"), F.col("_base")))
    return out.withColumn("sector_risk", ratio_to_risk(F.col("predicted_total_ratio"))).drop("_future", "_base")


# How strongly and how far a category share may tilt.
TILT_POWER, TILT_MIN, TILT_MAX = 0.15, 0.80, 1.25


def market_calibration(
    base: DataFrame, market: DataFrame, market_shares: DataFrame,
    power: float = TILT_POWER, low: float = TILT_MIN, high: float = TILT_MAX,
) -> DataFrame:
    """Factor per (week, category) that moves sales to the market's level and
    gently toward its mix, keeping each week's total on target.

    `base`: week_start, category, net, gross, days (observed days of the
    week). `market`: week_start, value. `market_shares`: week_start, category,
    share. Medians are over full weeks: one row each, from a weekly table.
    """
    weekly = base.groupBy("week_start").agg(
        F.sum("net").alias("week_net"), F.sum("gross").alias("week_gross"), F.max("days").alias("days")
    ).join(market, "week_start")
    medians = weekly.where("days = 7").agg(
        F.percentile("week_net", F.lit(0.5)).alias("_net_median"), F.percentile("value", F.lit(0.5)).alias("_market_median")
    )
    weekly = weekly.join(F.broadcast(medians)).withColumn("market_index", F.col("value") / F.col("_market_median"))
    weekly = weekly.withColumn(
        "week_target", F.col("_net_median") * F.col("market_index") * F.col("days") / 7.0
    ).withColumn("week_factor", safe_ratio(F.col("week_target"), F.col("week_net")))
    d = base.drop("days").join(
        weekly.select("week_start", "week_gross", "market_index", "week_target", "week_factor"), "week_start"
    ).join(market_shares, ["week_start", "category"])
    own_share = F.col("gross") / F.greatest(F.col("week_gross"), F.lit(1e-9))
    ratio = F.col("share") / F.greatest(own_share, F.lit(1e-6))
    tilt = F.greatest(F.lit(low), F.least(F.lit(high), F.pow(F.greatest(ratio, F.lit(1e-6)), F.lit(power))))
    d = d.withColumn("pre_factor", F.col("week_factor") * tilt)
    pre = d.groupBy("week_start").agg(F.sum(F.col("net") * F.col("pre_factor")).alias("_pre_sum"))
    return d.join(pre, "week_start").withColumn(
        "factor", F.col("pre_factor") * F.col("week_target") / F.greatest(F.col("_pre_sum"), F.lit(1e-9))
    ).drop("_pre_sum")


def apply_calibration(tx: DataFrame, factors: DataFrame) -> DataFrame:
    """Calibrated net per line: the (week, category) factor, the week's factor
    when the category has none, 1 when the line is not eligible.

    `tx` has week_start, category, net_sales, eligible. The weekly side is
    derived from the same table; both sides are a weeks x categories table.
    """
    weekly = factors.groupBy("week_start").agg(
        F.max("week_factor").alias("_week_factor"), F.max("market_index").alias("market_index")
    )
    cells = factors.select("week_start", "category", F.col("factor").alias("_cell_factor"))
    d = tx.join(weekly, "week_start", "left").join(cells, ["week_start", "category"], "left")
    factor = F.when(
        F.col("eligible"), F.coalesce("_cell_factor", "_week_factor", F.lit(1.0))
    ).otherwise(1.0)
    return d.withColumn("calibration_factor", factor).withColumn(
        "calibrated_net", double("net_sales") * F.col("calibration_factor")
    ).drop("_cell_factor", "_week_factor")


def calibrated_daily(lines: DataFrame, day: str = "sale_date") -> DataFrame:
    e = F.col("eligible")
    net, base = F.col("calibrated_net"), F.abs(double("net_sales"))
    out = lines.where(e).groupBy(day).agg(
        F.sum(net).alias("calibrated_net"),
        F.sum(F.greatest(net, F.lit(0.0))).alias("calibrated_gross"),
        F.sum(F.greatest(-net, F.lit(0.0))).alias("calibrated_returns"),
        F.sum("net_sales").alias("base_net"),
        F.sum(F.col("market_index") * base).alias("_mi"),
        F.sum(base).alias("_mw"),
    )
    return out.withColumn("market_index", F.col("_mi") / F.greatest(F.col("_mw"), F.lit(1e-9))).drop("_mi", "_mw")


def calibration_audit(lines: DataFrame, line_id: Sequence[str], payments: DataFrame) -> DataFrame:
    """Repeated line ids, lines without a market week, invoices with more than
    one payment kind (`payments`: invoice, kind)."""
    repeated = lines.groupBy(*line_id).agg((F.count(F.lit(1)) - 1).alias("_n")).agg(
        F.sum("_n").alias("duplicate_line_ids")
    )
    missing = lines.agg(
        F.count_if(F.col("market_index").isNull()).alias("missing_week_lines"), F.count(F.lit(1)).alias("lines")
    )
    invoice, kind = payments.columns
    mixed = payments.distinct().groupBy(invoice).agg(F.count(F.lit(1)).alias("_k")).agg(
        F.count_if(F.col("_k") > 1).alias("mixed_payment_invoices")
    )
    return missing.join(F.broadcast(repeated)).join(F.broadcast(mixed))


def residual_entity(parts: DataFrame, total: DataFrame, period: str, entity: str, value: str, name: str = "OTHER", strict: bool = True) -> DataFrame:
    """Add the entity that makes the named ones sum to the published total.

    A strict call refuses periods in which nothing positive is left.
    """
    named = parts.groupBy(period).agg(F.sum(value).alias("_named"))
    rest = total.select(period, F.col(value).alias("_total")).join(named, period).select(
        period, F.lit(name).alias(entity), (F.col("_total") - F.col("_named")).alias(value)
    )
    if strict and rest.where(F.col(value) <= 0).limit(1).count():
        raise ValueError("a residual is not positive")
    return parts.select(period, entity, value).unionByName(rest)
