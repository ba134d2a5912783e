"""Features that remember past labels, forecasts and cross-sections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.functions.scalars import clip, ratio_to_risk, safe_ratio
from ebbtide.operators.ordering import exact_quantiles, running_totals, settle
from ebbtide.operators.windows import Series


def panel_zscore(df: DataFrame, group: Sequence[str], col: str) -> DataFrame:
    """Mean, median, z-score and falling share of each cross-section.

    Cross-sections are aggregated and joined back, never windowed, so their
    size does not matter.
    """
    stats = df.groupBy(*group).agg(
        F.avg(col).alias("panel_mean"),
        F.stddev_samp(col).alias("_std"),
        F.avg((F.coalesce(F.col(col), F.lit(0.0)) < 0).cast("double")).alias("breadth_down"),
    )
    medians = exact_quantiles(df, col, [0.5], group).select(*group, F.col("q50").alias("panel_median"))
    return (
        df.join(stats, list(group))
        .join(medians, list(group), "left")
        .withColumn("panel_z", (F.col(col) - F.col("panel_mean")) / F.nullif(F.col("_std"), F.lit(0.0)))
        .drop("_std")
    )


def prior_prevalence(
    df: DataFrame, entity: str, time: str, label: str,
    windows: Sequence[int] = (13, 26, 52, 104), market_windows: Sequence[int] = (4, 13, 26, 52),
) -> DataFrame:
    """Past-only mean of the label per entity and of the whole market's rate."""
    s = Series(entity, time)
    y = F.col(label).cast("double")
    own = {
        f"decline_rate_{w}": s.rolling(y, w, past=True, min_rows=max(6, min(w, 13))) for w in windows
    }
    m = Series([], time)
    weekly = df.groupBy(time).agg(F.avg(y).alias("_rate"))
    weekly = weekly.select(
        time,
        *[
            m.rolling("_rate", w, past=True, min_rows=max(3, min(w, 8))).alias(f"market_decline_rate_{w}")
            for w in market_windows
        ],
    )
    return df.withColumns(own).join(weekly, time)


def momentum(df: DataFrame, s: Series, col: str) -> DataFrame:
    """Weekly year-on-year log ratio, momentum and acceleration."""
    x = F.col(col)
    yoy = safe_ratio(x, s.lag(col, 52))
    c1, c4, c13 = (s.pct_change(col, k) for k in (1, 4, 13))
    return df.withColumns(
        {
            "yoy_ratio": yoy,
            "yoy_log": F.when(yoy > 0, F.ln(yoy)),
            "momentum_4_13": c4 - c13,
            "acceleration": c1 - c4 / 4.0,
        }
    )


def row_positions(df: DataFrame, value: str, day: str, entity: str, by: Sequence[str]) -> DataFrame:
    """Position (1..n) and n inside each group, ordered by value, day, entity.

    Rows are cut into ranges of (group, value, day, entity), numbered inside
    them and moved by the rows of the ranges before, so that no tie is one
    task. Rows without a value have no position and are left out.
    """
    by = list(by)
    order = [value, day, entity]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.where(F.col(value).isNotNull()).repartitionByRange(parts, *by, *order)
    ranged = settle(ranged.withColumn("_part", F.spark_partition_id()))  # written, so the cut stays as it is
    sizes = ranged.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*by)  # a row per range
    sizes = sizes.select(
        *by, "_part", (F.sum("_n").over(group.orderBy("_part")) - F.col("_n")).alias("_start"), F.sum("_n").over(group).alias("group_rows")
    )
    inside = Window.partitionBy(*by, "_part").orderBy(*order)
    numbered = ranged.withColumn("_row", F.row_number().over(inside)).join(sizes, [*by, "_part"])
    return numbered.withColumn("position", F.col("_start") + F.col("_row")).drop("_part", "_start", "_row")


def rank_in_fold(df: DataFrame, score: str, day: str, entity: str, fold: str) -> DataFrame:
    """Position inside the fold divided by its size."""
    return row_positions(df, score, day, entity, [fold]).withColumn(
        "fold_rank", F.col("position") / F.col("group_rows")
    ).drop("position", "group_rows")


def rank_against(df: DataFrame, reference: DataFrame, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of reference scores at or below each score."""
    by = list(by)
    both = df.select(*by, score, F.lit(0).alias("_ref")).unionByName(
        reference.select(*by, score, F.lit(1).alias("_ref"))
    )
    table = running_totals(both, score, {"ref": F.col("_ref")}, by).select(
        *by, score, safe_ratio(F.col("cum_ref"), F.greatest(F.col("total_ref"), F.lit(1))).alias("train_rank")
    )
    return df.join(table, [*by, score])


def error_memory(df: DataFrame, entity: str, time: str, actual: str, predicted: str, base: str) -> DataFrame:
    """Corrects and bounds a forecast by its own past log errors.

    `actual` is the value the forecast of that row aimed at; only rows before
    the current one enter.
    """
    s = Series(entity, time)
    err = safe_ratio(F.col(actual), F.col(predicted))
    d = df.withColumn("_log_error", F.when(err > 0, F.ln(err)))
    d = d.withColumns(
        {
            "error_median8": s.quantile("_log_error", 8, 0.5, past=True, min_rows=4),
            "error_q10_13": s.quantile("_log_error", 13, 0.10, past=True, min_rows=6),
            "error_q90_13": s.quantile("_log_error", 13, 0.90, past=True, min_rows=6),
        }
    )

    def scaled(e):
        return safe_ratio(F.col(predicted) * F.exp(e), F.col(base))

    d = d.withColumns(
        {
            "corrected_ratio": scaled(F.col("error_median8")),
            "lower_ratio": scaled(F.col("error_q10_13")),
            "upper_ratio": scaled(F.col("error_q90_13")),
        }
    )
    return d.withColumns(
        {
            "corrected_risk": ratio_to_risk(F.col("corrected_ratio"), 0.85, 0.055),
            "upper_risk": ratio_to_risk(F.col("upper_ratio"), 0.85, 0.055),
        }
    ).drop("_log_error")


def scale_to_median(df: DataFrame, s: Series, value: str, forecast: str, w: int = 52) -> DataFrame:
    """Forecast against the trailing median (whatever rows exist, up to w)
    and against the last value."""
    return df.withColumns(
        {
            "forecast_index": safe_ratio(F.col(forecast), s.rolling(value, w, "median", min_rows=1)),
            "forecast_change": safe_ratio(F.col(forecast), F.col(value)) - 1.0,
        }
    )


def local_prior(
    df: DataFrame, entity: str, week: str, label: str, reference: float = 0.08,
    global_weeks: int = 52, entity_weeks: int = 104, min_rows: int = 100, strength: float = 26.0,
    floor: float = 0.003, ceiling: float = 0.20,
) -> DataFrame:
    """Base rate expected now: the market's recent rate and the entity's own
    rate shrunk toward it, combined by the geometric mean.

    Known labels of earlier weeks only. The market side is one row per week.
    """
    stepped = df.groupBy(entity, week).agg(
        F.sum(F.col(label).cast("double")).alias("_pos"), F.count(label).alias("_n")
    ).withColumn("_t", F.datediff(week, F.lit("1970-01-01").cast("date")))
    market = stepped.groupBy(week, "_t").agg(F.sum("_pos").alias("_pos"), F.sum("_n").alias("_n"))
    by_time = Window.partitionBy().orderBy("_t")
    recent = by_time.rangeBetween(-7 * global_weeks, -1)
    ever = by_time.rangeBetween(Window.unboundedPreceding, -1)
    enough = F.coalesce(F.sum("_n").over(recent), F.lit(0)) >= min_rows
    rate = F.when(enough, F.sum("_pos").over(recent) / F.sum("_n").over(recent)).otherwise(
        F.sum("_pos").over(ever) / F.sum("_n").over(ever)
    )
    market = market.select(week, rate.alias("_rate"))
    own = Window.partitionBy(entity).orderBy("_t").rangeBetween(-7 * entity_weeks, -1)
    entity_side = stepped.select(
        entity,
        week,
        F.coalesce(F.sum("_pos").over(own), F.lit(0.0)).alias("_own_pos"),
        F.coalesce(F.sum("_n").over(own), F.lit(0)).alias("_own_n"),
    )
    known = F.col("_rate").isNotNull()
    market_prior = clip(F.col("_rate"), floor, ceiling)
    out = entity_side.join(market, week).withColumn(
        "market_prior", F.when(known, market_prior).otherwise(F.lit(reference))
    )
    shrunk = (F.col("_own_pos") + strength * F.col("market_prior")) / (F.col("_own_n") + strength)
    out = out.withColumn(
        "entity_prior", F.when(known, clip(shrunk, floor, ceiling)).otherwise(F.lit(reference))
    ).withColumn("effective_prior", F.sqrt(F.col("market_prior") * F.col("entity_prior")))
    return out.drop("_own_pos", "_own_n", "_rate")


def forecast_ratios(df: DataFrame, entity: str, time: str, value: str, count: str) -> DataFrame:
    """Features of a one-step forecast made at each row.

    Needs `predicted_value` and `predicted_count` for the next row. The
    absolute percentage error enters only once its outcome is known.
    """
    s = Series(entity, time)
    out = {}
    for w in (4, 8, 13):
        out[f"pred_value_ratio{w}"] = safe_ratio(F.col("predicted_value"), s.rolling(value, w))
        out[f"pred_count_ratio{w}"] = safe_ratio(F.col("predicted_count"), s.rolling(count, w))
        out[f"value_cv{w}"] = safe_ratio(s.rolling(value, w, "std"), s.rolling(value, w))
    out["pred_value_change"] = safe_ratio(F.col("predicted_value"), F.col(value)) - 1.0
    out["pred_count_change"] = safe_ratio(F.col("predicted_count"), F.col(count)) - 1.0
    out["value_count_gap"] = out["pred_value_change"] - out["pred_count_change"]
    nxt = s.lead(value, 1)
    d = df.withColumn("_ape", safe_ratio(F.abs(nxt - F.col("predicted_value")), nxt)).withColumns(out)
    return d.withColumn("value_ape8_known", s.rolling("_ape", 8, past=True, min_rows=4)).drop("_ape")


def label_conventions(df: DataFrame, day: str, value: str, stored: str) -> DataFrame:
    """How well each baseline / future convention reproduces a stored ratio:
    rows, mean absolute and root mean square error, correlation."""
    s = Series([], day)
    x = F.col(value)
    parts = {}
    for base, past in (("today", False), ("before", True)):
        for ahead, (lo, hi) in (("after", (1, 1)), ("with_today", (0, 0))):
            for h in (3, 7, 14):
                end = h if lo == 1 else h - 1
                frame = s.frame(lo, end)
                future = F.when(F.count(x).over(frame) == h, F.sum(x).over(frame))
                parts[f"{base}__{ahead}__{h}"] = safe_ratio(future, h * s.rolling(x, 28, past=past))
    ratios = df.select(day, stored, *[c.alias(n) for n, c in parts.items()])
    long = ratios.unpivot([day, stored], list(parts), "convention", "ratio").where(
        F.col("ratio").isNotNull() & F.col(stored).isNotNull()
    )
    gap = F.col("ratio") - F.col(stored)
    return long.groupBy("convention").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(gap)).alias("mae"),
        F.sqrt(F.avg(gap * gap)).alias("rmse"),
        F.corr("ratio", stored).alias("correlation"),
    )
