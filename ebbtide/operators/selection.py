"""Choosing features by how steadily they go with the label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.functions.scalars import correlation
from ebbtide.operators.ordering import melt


def recent_part(df: DataFrame, day: str, share: float = 0.55) -> DataFrame:
    """`_late` marks the newest `share` of the rows, cut at a whole day.

    The cut comes from rows per day, which a calendar bounds.
    """
    per = df.groupBy(day).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy().orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    ranked = per.select(F.col(day).alias("_day"), F.sum("_n").over(upto).alias("_cum"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    cut = ranked.where(F.col("_cum") >= F.ceil(F.col("_all") * (1.0 - share))).agg(F.min("_day").alias("_cut"))
    return df.join(F.broadcast(cut)).withColumn("_late", F.col(day) >= F.col("_cut")).drop("_cut")


def stable_top(df: DataFrame, day: str, label: str, features: Sequence[str], n: int, share: float = 0.55) -> DataFrame:
    """Features by 0.65 |correlation| + 0.35 |correlation on recent rows|;
    equal ones by name, last name first. One row per feature after one pass."""
    d = recent_part(df, day, share).withColumn("_y", F.col(label).cast("double"))
    long = melt(d, ["_y", "_late"], features)

    def strength(x: Column, y: Column) -> Column:
        return F.coalesce(F.abs(F.nanvl(correlation(x, y), F.lit(None).cast("double"))), F.lit(0.0))

    late = F.col("_late")
    scored = long.groupBy("feature").agg(
        (
            0.65 * strength(F.col("value"), F.col("_y"))
            + 0.35 * strength(F.when(late, F.col("value")), F.when(late, F.col("_y")))
        ).alias("stability")
    )
    best = scored.orderBy(F.col("stability").desc(), F.col("feature").desc()).limit(n)
    return best.withColumn(
        "position", F.row_number().over(Window.partitionBy().orderBy(F.col("stability").desc(), F.col("feature").desc()))
    )
