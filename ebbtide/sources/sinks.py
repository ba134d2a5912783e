"""Writing panels, forecasts, runs and the import ledger."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_panel(df: DataFrame, path: str, keys: Sequence[str], month_of: str | None = None, mode: str = "overwrite") -> None:
    """Parquet sorted inside each file by the keys.

    With `month_of` the files are laid out by that date's month, so a date
    filter skips folders. Rows are spread by the keys as well as the month:
    one busy month is written by many tasks.
    """
    if month_of:
        df = df.withColumn("month", F.date_format(month_of, "yyyy-MM"))
        ordered = df.repartition("month", *keys).sortWithinPartitions("month", *keys)
        ordered.write.mode(mode).partitionBy("month").parquet(path)
    else:
        df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys).write.mode(mode).parquet(path)


def export_forecast(forecasts: DataFrame, run_id: str) -> DataFrame:
    """The rows of one run in date order, as the CSV shows them."""
    return (
        forecasts.where(F.col("run_id") == run_id)
        .select(
            F.col("forecast_date").alias("date"),
            "predicted_sales",
            "lower_bound",
            "upper_bound",
            "decline_probability",
        )
        .orderBy("date")
    )


def write_forecast_csv(forecasts: DataFrame, run_id: str, path: str) -> None:
    export_forecast(forecasts, run_id).write.mode("overwrite").option("header", True).csv(path)


def run_key(*parts: Column) -> Column:
    """A surrogate id that is the same whenever a run is repeated."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def persist_run(forecast: DataFrame, runs: DataFrame, drivers: DataFrame | None = None) -> dict[str, DataFrame]:
    """The five result tables of an analysis.

    `runs` has one row per entity: entity, model_name, horizon_days,
    data_start, data_end, sample_size, risk, alert, severity, filters_json,
    metrics_json. `forecast` has entity, date and the path. Alerts, factors
    and recommendations exist only for runs that raised an alert.
    """
    keyed = runs.withColumn("run_id", run_key(F.col("entity"), F.col("data_end"), F.col("horizon_days")))
    ids = keyed.select("entity", "run_id", "risk", "alert", "severity")
    model_runs = keyed.select(
        "run_id", "entity", "model_name", F.lit("completed").alias("status"), "horizon_days",
        "data_start", "data_end", "sample_size", "filters_json", "metrics_json",
    )
    forecasts = forecast.join(ids, "entity").select(
        run_key(F.col("run_id"), F.col("date")).alias("forecast_id"),
        "run_id",
        F.col("date").alias("forecast_date"),
        F.col("predicted").alias("predicted_sales"),
        F.col("lower").alias("lower_bound"),
        F.col("upper").alias("upper_bound"),
        F.col("baseline").alias("baseline_sales"),
        F.coalesce("risk", F.lit(0.0)).alias("decline_probability"),
        "decline_percent",
    )
    raised = ids.where(F.col("alert"))
    first_day = forecast.groupBy("entity").agg(F.min("date").alias("date"))
    alerts = raised.join(first_day, "entity").select(
        run_key(F.lit("alert"), F.col("run_id")).alias("alert_id"),
        "entity",
        "run_id",
        run_key(F.col("run_id"), F.col("date")).alias("forecast_id"),
        "severity",
        F.lit(False).alias("is_resolved"),
        "risk",
    )
    factors = alerts.select(
        "forecast_id", F.lit("decline_risk").alias("factor_code"), F.col("risk").alias("impact_value"),
        F.lit("risk_score").alias("method"),
    )
    primary = alerts.select("entity", "alert_id", F.lit("decline_risk").alias("factor_code"))
    if drivers is not None:
        factors = factors.unionByName(
            drivers.join(alerts.select("entity", "forecast_id"), "entity").select(
                "forecast_id",
                F.col("code").alias("factor_code"),
                (F.col("strength_pct") / 100.0).alias("impact_value"),
                F.lit("recent_window_explanation").alias("method"),
            )
        )
        top = drivers.where(F.col("driver_rank") == 1).select("entity", F.col("code").alias("_top"))
        primary = primary.join(top, "entity", "left").select(
            "entity", "alert_id", F.coalesce("_top", "factor_code").alias("factor_code")
        )
    recommendations = primary.select("alert_id", "factor_code", F.lit(1).alias("priority"))
    return {
        "model_runs": model_runs,
        "forecasts": forecasts,
        "alerts": alerts.drop("entity"),
        "decline_factors": factors,
        "recommendations": recommendations,
    }


def append_run(tables: Mapping[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("append").parquet(f"{folder.rstrip('/')}/{name}")


def import_ledger(rows: DataFrame, inserted: DataFrame) -> DataFrame:
    """One job row: totals, status and the first rejection messages.

    `rows` carries `reject_reason` and `row_no`; `inserted` is what was new.
    """
    counts = rows.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col("reject_reason").isNull()).alias("accepted_rows"),
        F.count_if(F.col("reject_reason").isNotNull()).alias("rejected_rows"),
    )
    new = inserted.agg(F.count(F.lit(1)).alias("inserted_rows"))
    errors = (
        rows.where(F.col("reject_reason").isNotNull())
        .orderBy("row_no")
        .limit(100)
        .agg(F.array_sort(F.collect_list(F.struct("row_no", "reject_reason"))).alias("_e"))
        .select(F.transform("_e", lambda e: F.concat(F.lit("row "), e["row_no"], F.lit(": "), e["reject_reason"])).alias("errors"))
    )
    status = (
        F.when(F.col("accepted_rows") == 0, "failed")
        .when(F.col("inserted_rows") == 0, "imported_no_new_rows")
        .otherwise("imported")
    )
    return (
        counts.join(F.broadcast(new)).join(F.broadcast(errors))
        .withColumns(
            {
                "duplicate_rows": F.greatest(F.col("accepted_rows") - F.col("inserted_rows"), F.lit(0)),
                "status": status,
            }
        )
    )
