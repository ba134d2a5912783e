"""Row-level formulas shared by the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b in double; NULL when b is 0 or NULL."""
    d = b.cast("double")
    return a.cast("double") / F.nullif(d, F.lit(0.0))


def safe_change(current: Column, previous: Column) -> Column:
    """(x - prev) / |prev|; NULL when prev is 0 or NULL."""
    p = previous.cast("double")
    return (current.cast("double") - p) / F.nullif(F.abs(p), F.lit(0.0))


def signed_change(current: Column, previous: Column) -> Column:
    """x / prev - 1 with the sign of prev kept."""
    return safe_ratio(current, previous) - 1.0


def pct_points(current: Column, previous: Column) -> Column:
    """Percent change against |prev|; 0 when prev is practically 0."""
    c, p = current.cast("double"), previous.cast("double")
    return F.when(F.abs(p) < 1e-9, F.lit(0.0)).otherwise((c - p) / F.abs(p) * 100.0)


def ratio_to_risk(ratio: Column, center: float = 0.85, width: float = 0.08) -> Column:
    """Falling logistic in the predicted ratio, exponent limited to +-30."""
    z = (ratio.cast("double") - center) / width
    z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))
    return F.when(ratio.isNotNull(), 1.0 / (1.0 + F.exp(z)))


def severity(change_pct: Column) -> Column:
    drop = F.abs(F.least(change_pct.cast("double"), F.lit(0.0)))
    return F.when(drop >= 25, "high").when(drop >= 10, "medium").otherwise("low")


def alert_severity(alert: Column, risk: Column) -> Column:
    return F.when(alert & (risk >= 0.70), "high").when(alert, "medium").otherwise("low")


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Two-sided Wilson score interval; (0, 1) for n = 0."""
    size = F.nullif(n.cast("double"), F.lit(0.0))
    p = k.cast("double") / size
    denom = 1.0 + z * z / size
    center = (p + z * z / (2.0 * size)) / denom
    half = z * F.sqrt(p * (1.0 - p) / size + z * z / (4.0 * size * size)) / denom
    return F.greatest(F.lit(0.0), center - half), F.least(F.lit(1.0), center + half)


def count_true(*conditions: Column) -> Column:
    """Number of conditions that hold; NULL counts as false."""
    total = F.lit(0)
    for c in conditions:
        total = total + F.coalesce(c.cast("int"), F.lit(0))
    return total


def ordinal(col: Column, scale: Mapping[str, int], default: int = 3) -> Column:
    value = F.lit(None).cast("int")
    for text, rank in scale.items():
        value = F.when(F.lower(F.trim(col)) == text.lower(), F.lit(rank)).otherwise(value)
    return F.coalesce(value, F.lit(default))


def one_hot(df: DataFrame, col: str, values: Sequence[str], prefix: str) -> DataFrame:
    """One double column per known value, in sorted order."""
    return df.withColumns(
        {f"{prefix}_{v}": (F.col(col) == v).cast("double") for v in sorted(values)}
    )


def odds_shift(p: Column, prior_from: Column, prior_to: Column) -> Column:
    """Move a probability from one base rate to another; NULL stays NULL."""
    eps = 1e-6
    q = clip(p.cast("double"), eps, 1 - eps)
    odds = (
        q / (1.0 - q)
        * (prior_to / (1.0 - prior_to))
        / (prior_from / (1.0 - prior_from))
    )
    return odds / (1.0 + odds)


def severity_class(ratio: Column, bounds: Sequence[float] = (0.70, 0.85, 1.0)) -> Column:
    """0 for ratios at or above the last bound, one more per bound undercut."""
    cls = F.lit(0)
    for b in bounds:
        cls = cls + (ratio < b).cast("int")
    return F.when(ratio.isNotNull(), cls)


def clip(col: Column, low: float, high: float) -> Column:
    return F.when(col.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), col)))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r as an aggregate; NULL where one side is steady, which `corr`
    answers with a division by zero."""
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.try_divide(F.covar_pop(x, y), spread)
