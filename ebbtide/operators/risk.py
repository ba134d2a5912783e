"""Decline risk of merchants: gate, features, stored forest, percentile policy.

All entities and days are assessed in one window pass over the rich daily
panel; the newest day of each entity is its assessment. The forest and the
preprocessing bounds are a model artifact and travel to the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.scalars import safe_change, safe_ratio
from ebbtide.operators import ml, policy
from ebbtide.operators.joins import prior_week_lookup
from ebbtide.operators.windows import Series

# The measures, windows and calendar marks the engine knows.
MEASURES = ("sales", "gross", "invoices", "customers", "products", "units", "avg_invoice", "return_rate", "transaction_rows")
SCORED = ("sales", "invoices", "customers")
WINDOWS, LAGS = (7, 14, 28, 56), (1, 7, 14, 28)
HISTORY_DAYS, IDENTIFIER_DAYS = 56, 7
CALENDAR = ("dow_sin", "dow_cos", "salary_period", "national_day_window", "founding_day_window")

RISK_FEATURES = tuple(
    [f"{m}_ratio_{w}" for m in MEASURES for w in WINDOWS]
    + [f"{m}_z_{w}" for m in SCORED for w in WINDOWS]
    + [f"{m}_change_{k}" for m in MEASURES for k in LAGS]
    + ["ma7_ma28", "ma14_ma56", "vol7_vol28", "drawdown28", "market", "market_change_1", "market_change_7"]
    + list(CALENDAR)
)


def risk_features(daily: DataFrame, market: DataFrame | None, entity: str, day: str) -> DataFrame:
    """`daily` with `history_days`, identifier days and RISK_FEATURES.

    `daily` is gap-free and has MEASURES. `market` has (week_start, market):
    each day sees the week before its own. A window that is not full, a zero
    base and a zero deviation give NULL; a window without sales has the
    drawdown -1.
    """
    s = Series(entity, day)
    if market is None:
        daily = daily.withColumn("market", F.lit(None).cast("double"))
    else:
        daily = prior_week_lookup(daily, market, day, ["market"]).drop("week_start")
    out: dict[str, Column] = {}
    for m in MEASURES:
        for w in WINDOWS:
            mean = s.rolling(m, w)
            out[f"{m}_ratio_{w}"] = safe_ratio(F.col(m), mean)
            if m in SCORED:
                deviation = s.rolling(m, w, "std")
                out[f"{m}_z_{w}"] = F.when(deviation != 0, (F.col(m) - mean) / deviation)
        out.update({f"{m}_change_{k}": s.change(m, k) for k in LAGS})
    full = F.count("sales").over(s.frame(-27, 0)) >= 28
    out |= {
        "ma7_ma28": s.ma_ratio("sales", 7, 28),
        "ma14_ma56": s.ma_ratio("sales", 14, 56),
        "vol7_vol28": safe_ratio(s.rolling("sales", 7, "std"), s.rolling("sales", 28, "std")),
        "drawdown28": F.when(full, F.coalesce(safe_ratio(F.col("sales"), s.rolling("sales", 28, "max")), F.lit(0.0)) - 1.0),
        **{f"market_change_{k}": safe_change(F.col("market"), s.lag("market", k)) for k in (1, 7)},
    }
    angle, month, date = 2 * math.pi * F.weekday(day) / 7, F.month(day), F.dayofmonth(day)
    out |= {
        "dow_sin": F.sin(angle),
        "dow_cos": F.cos(angle),
        "salary_period": date.between(24, 31).cast("double"),
        "national_day_window": ((month == 9) & date.between(16, 30)).cast("double"),
        "founding_day_window": ((month == 2) & date.between(15, 29)).cast("double"),
    }
    recent = s.frame(-HISTORY_DAYS + 1, 0)
    counts = {
        "history_days": s.row_no(),
        "customer_days": F.sum((F.col("customers") > 0).cast("int")).over(recent),
        "product_days": F.sum((F.col("products") > 0).cast("int")).over(recent),
        "market_days": F.count("market").over(s.frame(-(2**31) + 1, 0)),
    }
    return daily.withColumns({**out, **counts})


def gate_reason() -> Column:
    """Why a day cannot be assessed, or NULL."""
    return F.when(
        F.col("history_days") < HISTORY_DAYS,
        F.concat(F.lit(f"at least {HISTORY_DAYS} calendar days of transactions are needed, found "), F.col("history_days").cast("string")),
    ).when(
        (F.col("customer_days") < IDENTIFIER_DAYS) | (F.col("product_days") < IDENTIFIER_DAYS),
        "transactions need customer and product identifiers; daily totals run in minimal mode",
    )


def assess_days(
    daily: DataFrame,
    market: DataFrame | None,
    trees: DataFrame,
    bounds: DataFrame,
    entity: str = "entity",
    day: str = "date",
    static: float = 0.5,
    budget: float = 0.30,
    lookback: int = 126,
    warmup: int = 20,
    features: Sequence[str] = RISK_FEATURES,
) -> DataFrame:
    """Score, percentile among the entity's earlier assessed days, and alert of
    every day that passes the gate; other days carry the reason alone.

    `bounds` (feature, low, median, high) fills and clips the `features` in
    the order the trees know them; `trees` is the ensemble of `ml.forest_score`.
    """
    d = risk_features(daily, market, entity, day).withColumn("reason", gate_reason())
    kept = [entity, day, "history_days", "customer_days", "product_days", F.col("market_days").cast("boolean").alias("market_available"), "reason"]
    ready = d.where(F.col("reason").isNull())
    scored = ml.forest_score(ml.apply_clip(ready, bounds, features), trees, list(features), "score")
    judged = policy.percentile_policy(scored, entity, day, "score", static, budget, lookback, warmup)
    threshold = F.when(F.col("policy_mode") == "static", F.lit(static)).otherwise(F.lit(1.0 - budget))
    judged = judged.withColumn("decision_threshold", threshold).select(*kept, "score", "percentile", "policy_mode", "decision_threshold", "alert")
    return judged.unionByName(d.where(F.col("reason").isNotNull()).select(*kept), allowMissingColumns=True)


def assess_risk(days: DataFrame, entity: str = "entity", day: str = "date") -> DataFrame:
    """The newest day of each entity in `assess_days`: `available` says whether
    the engine could judge it."""
    columns = [c for c in days.columns if c != entity]
    newest = days.groupBy(entity).agg(F.max_by(F.struct(*columns), day).alias("n")).select(entity, "n.*")
    return newest.withColumn("available", F.col("reason").isNull())


def feature_bounds(days: DataFrame, features: Sequence[str] = RISK_FEATURES) -> DataFrame:
    """Median and 1% / 99% bounds of training days, as the artifact stores them."""
    return ml.fit_clip(days, features)


def forest_from(rows: Sequence[Mapping[str, Sequence]], spark) -> DataFrame:
    """An ensemble from its stored trees (feature, threshold, left, right, p1)."""
    names = ("feature", "threshold", "left", "right", "p1")
    schema = "feature array<int>, threshold array<double>, left array<int>, right array<int>, p1 array<double>"
    return spark.createDataFrame([tuple(list(r[n]) for n in names) for r in rows], schema)
