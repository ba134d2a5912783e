"""The whole path from sales to stored runs, for many entities at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.scalars import alert_severity
from ebbtide.operators import explain, forecast
from ebbtide.operators.cleaning import choose_history
from ebbtide.operators.ordering import settle
from ebbtide.operators.panels import daily_series
from ebbtide.sources.sinks import persist_run


def instant_analysis(sales: DataFrame, entity: str, risk: DataFrame | None, horizon: int = 7) -> dict[str, DataFrame]:
    """History choice, forecast, drivers, risk and the five result tables.

    `sales` holds transaction and daily rows of many entities; `risk` has
    (entity, risk, alert) from the risk engine. Only the engine raises
    alerts, and only for the 7-day horizon.
    """
    chosen = settle(choose_history(sales, by=[entity]).withColumnRenamed(entity, "entity"))
    modes = chosen.groupBy("entity").agg(F.first("data_mode").alias("data_mode"), F.min("sale_date").alias("data_start"))
    daily = daily_series(chosen, "sale_date", "net_sales", ["entity"])
    path = settle(forecast.adaptive_forecast(daily, ["entity"], "sale_date", "net_sales", horizon))
    rich = chosen.where(F.col("data_mode").startswith("transaction_level"))
    drivers = settle(explain.rank_drivers(explain.decline_signals(explain.with_period(rich, 7, ["entity"]), ["entity"]), ["entity"]))
    change = forecast.recent_change(daily, ["entity"], "sale_date", "net_sales")
    ahead = forecast.horizon_change(path, ["entity"]).select("entity", "predicted_change_pct", "predicted_decline_pct")
    head = path.groupBy("entity").agg(
        *[F.first(c).alias(c) for c in ("model", "wape", "mae", "total_wape", "folds", "data_end", "history_days")]
    )
    quality = forecast.quality_summary(head)
    runs = quality.join(modes, "entity").join(change, "entity").join(ahead, "entity")
    if risk is not None and horizon == 7:
        runs = runs.join(risk.select("entity", "risk", "alert"), "entity", "left")
    else:
        runs = runs.withColumns({"risk": F.lit(None).cast("double"), "alert": F.lit(False)})
    runs = runs.withColumn("alert", F.coalesce("alert", F.lit(False))).select(
        "entity",
        F.col("model").alias("model_name"),
        F.lit(horizon).alias("horizon_days"),
        "data_start",
        "data_end",
        F.col("history_days").alias("sample_size"),
        "risk",
        "alert",
        alert_severity(F.col("alert"), F.coalesce("risk", F.lit(0.0))).alias("severity"),
        F.to_json(F.struct("data_mode", F.col("risk").isNotNull().alias("decline_engine_available"))).alias("filters_json"),
        F.to_json(
            F.struct(
                "change_pct", "decline_pct", "predicted_change_pct", "predicted_decline_pct", "accuracy_proxy_pct",
                "error_wape_pct", "daily_wape_pct", "horizon_total_wape_pct", "folds",
            )
        ).alias("metrics_json"),
    )
    return persist_run(path, settle(runs), drivers)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("rows")).withColumn("table_name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def latest_risk(scored: DataFrame, entity: str, day: str, risk: str, alert: str) -> DataFrame:
    """Risk and alert of each entity's newest row."""
    newest = scored.groupBy(entity).agg(F.max_by(F.struct(risk, alert), day).alias("_n"))
    return newest.select(F.col(entity).alias("entity"), F.col(f"_n.{risk}").alias("risk"), F.col(f"_n.{alert}").alias("alert"))

