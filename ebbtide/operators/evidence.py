"""Counted and combined deterioration signals, and training weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.scalars import count_true
from ebbtide.operators.ordering import exact_quantiles, melt, quantile_name
from ebbtide.operators.windows import Series, share_of_total

# Fixed values: (feature, cut); a signal holds when the feature is below its cut.
PRECURSORS = (
    ("value_ratio_mean_4", 0.97),
    ("count_ratio_mean_4", 0.97),
    ("value_slope_4", -0.012),
    ("count_slope_4", -0.012),
    ("value_change_2", -0.045),
    ("count_change_2", -0.045),
    ("value_share_change_4", -0.025),
)
EVIDENCE = (
    ("value_ratio_mean_4", 0.99),
    ("count_ratio_mean_4", 0.99),
    ("value_change_1", -0.015),
    ("count_change_1", -0.015),
    ("value_change_2", -0.03),
    ("count_change_2", -0.03),
    ("value_slope_4", -0.006),
    ("count_slope_4", -0.006),
    ("value_share_change_4", -0.012),
    ("count_share_change_4", -0.012),
)


def weekly_signals(panel: DataFrame, entity: str, week: str, value: str, count: str) -> DataFrame:
    """The weekly features the signal counts read."""
    d = share_of_total(panel, [week], value, "value_share")
    d = share_of_total(d, [week], count, "count_share")
    s = Series(entity, week)
    out = {}
    for name, col in (("value", value), ("count", count)):
        out[f"{name}_ratio_mean_4"] = s.ratio_to_mean(col, 4)
        out[f"{name}_slope_4"] = s.slope(col, 4)
        out[f"{name}_change_1"] = s.pct_change(col, 1)
        out[f"{name}_change_2"] = s.pct_change(col, 2)
        out[f"{name}_share_change_4"] = s.pct_change(f"{name}_share", 4)
    return d.withColumns(out)


def signal_count(signals: Sequence[tuple[str, float]]) -> Column:
    return count_true(*[F.col(name) < cut for name, cut in signals])


def hard_negative_features(df: DataFrame) -> DataFrame:
    """Eighteen gaps, products and signs that tell a lasting fall from a dip.

    Reads change_1/7/14/28, ratio_7/14/28, z_7/28, market_7, invoices_7,
    customers_7, products_7, returns_7 and the breadth shares.
    """
    c = F.col

    def drop(col: Column) -> Column:
        return F.greatest(-col, F.lit(0.0))

    def unit(col: Column) -> Column:
        return F.signum(-col)

    s1, s7, s14, s28 = c("change_1"), c("change_7"), c("change_14"), c("change_28")
    wide = c("negative_sales")
    return df.withColumns(
        {
            "short_long_change_gap": s7 - s28,
            "day_week_gap": s1 - s7,
            "week_fortnight_gap": s7 - s14,
            "ratio_7_28_gap": c("ratio_7") - c("ratio_28"),
            "ratio_7_14_gap": c("ratio_7") - c("ratio_14"),
            "z_7_28_gap": c("z_7") - c("z_28"),
            "vs_market": s7 - c("market_7"),
            "vs_invoices": s7 - c("invoices_7"),
            "vs_customers": s7 - c("customers_7"),
            "vs_products": s7 - c("products_7"),
            "breadth_mean": (wide + c("negative_invoices") + c("negative_customers")) / 3.0,
            "breadth_strength": (wide + c("severe_sales") + c("below_090")) / 3.0,
            "breadth_minus_shock": wide - drop(s7),
            "rebound": drop(s1) * F.greatest(s7 - s1, F.lit(0.0)),
            "persistent": drop(s7) * drop(s14) * (0.5 + wide),
            "temporary": drop(s7) * F.least(F.lit(2.0), F.greatest(F.lit(0.0), c("above_110") + (1.0 - wide))),
            "return_distortion": F.abs(c("returns_7")) * drop(s7),
            "consensus": (unit(s7) + unit(c("invoices_7")) + unit(c("customers_7")) + unit(c("products_7"))) / 4.0,
        }
    )


def _confidence(profile: str, y: Column, r: Column) -> Column:
    """How much a training row is trusted, by its distance from the cut-off."""

    def times(*pairs: tuple[Column, float]) -> Column:
        out = F.lit(1.0)
        for condition, factor in pairs:
            out = out * F.when(condition, F.lit(factor)).otherwise(1.0)
        return out

    if profile == "none":
        return F.lit(1.0)
    if profile == "baseline":
        return F.greatest(F.lit(0.55), F.least(F.lit(1.65), 0.55 + F.abs(r - 0.85) / 0.12))
    if profile == "soft_band":
        return times(((r > 0.82) & (r < 0.90), 0.35), (r <= 0.78, 1.25), (r >= 0.94, 1.10))
    if profile == "strong_band":
        return times(((r > 0.80) & (r < 0.90), 0.20), (r <= 0.78, 1.40), (r >= 0.95, 1.15))
    if profile == "asymmetric":
        near_negative = (y == 0) & (r >= 0.85) & (r < 0.92)
        near_positive = (y == 1) & (r > 0.80)
        return times((near_negative, 0.28), (near_positive, 0.45), (r <= 0.78, 1.35), (r >= 0.95, 1.10))
    raise ValueError(f"unknown profile {profile}")


def sample_weight(df: DataFrame, label: str, ratio: str, profile: str, out: str = "weight") -> DataFrame:
    """Class balance times confidence; the class counts are one row."""
    counts = df.agg(
        F.greatest(F.count_if(F.col(label) == 1), F.lit(1)).alias("_pos"),
        F.greatest(F.count_if(F.col(label) == 0), F.lit(1)).alias("_neg"),
    )
    y, r = F.col(label), F.col(ratio)
    balance = F.when(y == 1, F.col("_neg") / F.col("_pos")).otherwise(1.0)
    if profile == "none":
        balance = F.lit(1.0)
    return df.join(F.broadcast(counts)).withColumn(out, balance * _confidence(profile, y, r)).drop("_pos", "_neg")


def class_weights(df: DataFrame, cls: str) -> DataFrame:
    """n / (classes * count) per class."""
    counts = df.groupBy(cls).agg(F.count(F.lit(1)).alias("_n"))
    whole = counts.agg(F.sum("_n").alias("_total"), F.count(F.lit(1)).alias("_k"))
    return counts.join(F.broadcast(whole)).select(cls, (F.col("_total") / (F.col("_k") * F.col("_n"))).alias("class_weight"))


def operational_reference(train: DataFrame, columns: Sequence[str], q: float = 0.80) -> DataFrame:
    """One row with the training quantile of each column."""
    quantiles = exact_quantiles(melt(train, [], columns), "value", [q], ["feature"])
    return quantiles.agg(
        *[F.max(F.when(F.col("feature") == c, F.col(quantile_name(q)))).alias(f"ref_{c}") for c in columns]
    )


def _mean_of(conditions: Sequence[Column]) -> Column:
    if not conditions:
        return F.lit(0.0)
    return count_true(*conditions) / F.lit(float(len(conditions)))


def operational_score(
    df: DataFrame, reference: DataFrame, merchant_ratio: Sequence[str], merchant_change: Sequence[str],
    category_ratio: Sequence[str], category_change: Sequence[str], rich_ratio: Sequence[str], rich_high: Sequence[str],
) -> DataFrame:
    """0.45 merchant evidence + 0.35 category breadth + 0.20 rich evidence."""
    merchant = _mean_of([F.col(c) < 0.95 for c in merchant_ratio] + [F.col(c) < -0.05 for c in merchant_change])
    category = _mean_of([F.col(c) < 0.92 for c in category_ratio] + [F.col(c) < -0.08 for c in category_change])
    rich = _mean_of([F.col(c) < 0.90 for c in rich_ratio] + [F.col(c) > F.col(f"ref_{c}") for c in rich_high])
    d = df.join(F.broadcast(reference)).withColumns(
        {"merchant_evidence": merchant, "category_breadth": category, "rich_evidence": rich}
    )
    return d.withColumn(
        "operational_score",
        0.45 * F.col("merchant_evidence") + 0.35 * F.col("category_breadth") + 0.20 * F.col("rich_evidence"),
    ).drop(*[f"ref_{c}" for c in rich_high])
