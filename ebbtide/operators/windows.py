"""Series features over gap-free panels.

Frames count rows, so the calendar must be complete. A result is NULL until
the frame is full unless `min_rows` says otherwise. `past=True` ends the frame
before the current row; otherwise today is included. All columns built from
one `Series` share its partitioning and sort.

A `Series` without keys is for a company total, which has one row per day.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.functions.scalars import safe_change, safe_ratio, signed_change


class Series:
    """Windows of one panel: `keys` name the entity, `time` orders its rows."""

    def __init__(self, keys: Sequence[str] | str, time: str):
        self.keys = [keys] if isinstance(keys, str) else list(keys)
        self.time = time

    @property
    def order(self):
        return Window.partitionBy(*self.keys).orderBy(self.time)

    def frame(self, start: int, end: int):
        return self.order.rowsBetween(start, end)

    def lag(self, col, k: int) -> Column:
        return F.lag(col, k).over(self.order)

    def lead(self, col, k: int) -> Column:
        return F.lead(col, k).over(self.order)

    def rolling(self, col, w: int, fn: str = "mean", past: bool = False, min_rows: int | None = None) -> Column:
        value = _col(col)
        frame = self.frame(-w, -1) if past else self.frame(-(w - 1), 0)
        aggregate = {
            "mean": F.avg,
            "sum": F.sum,
            "std": F.stddev_samp,
            "pstd": F.stddev_pop,
            "max": F.max,
            "min": F.min,
            "median": lambda c: F.percentile(c, F.lit(0.5)),
        }[fn]
        need = w if min_rows is None else min_rows
        return F.when(F.count(value).over(frame) >= need, aggregate(value).over(frame))

    def quantile(self, col, w: int, q: float, past: bool = False, min_rows: int | None = None) -> Column:
        value = _col(col)
        frame = self.frame(-w, -1) if past else self.frame(-(w - 1), 0)
        need = w if min_rows is None else min_rows
        return F.when(F.count(value).over(frame) >= need, F.percentile(value, F.lit(q)).over(frame))

    def change(self, col, k: int) -> Column:
        """(x - lag) / |lag|."""
        return safe_change(_col(col), self.lag(col, k))

    def pct_change(self, col, k: int) -> Column:
        """x / lag - 1, sign of lag kept."""
        return signed_change(_col(col), self.lag(col, k))

    def ratio_to_mean(self, col, w: int, past: bool = False) -> Column:
        return safe_ratio(_col(col), self.rolling(col, w, past=past))

    def zscore(self, col, w: int, past: bool = False) -> Column:
        return (_col(col) - self.rolling(col, w, past=past)) / F.nullif(
            self.rolling(col, w, "std", past=past), F.lit(0.0)
        )

    def variation(self, col, w: int, past: bool = False) -> Column:
        """Coefficient of variation: std / |mean|."""
        return safe_ratio(self.rolling(col, w, "std", past), F.abs(self.rolling(col, w, past=past)))

    def ma_ratio(self, col, short: int, long: int) -> Column:
        return safe_ratio(self.rolling(col, short), self.rolling(col, long))

    def vol_ratio(self, col, short: int, long: int) -> Column:
        return safe_ratio(self.rolling(col, short, "std"), self.rolling(col, long, "std"))

    def drawdown(self, col, w: int) -> Column:
        return safe_ratio(_col(col), self.rolling(col, w, "max")) - 1.0

    def slope(self, col, w: int) -> Column:
        """Least-squares slope per step over w rows, relative to |mean|.

        With positions 0..w-1 the slope is a weighted sum of lags, which
        avoids a regression aggregate per row.
        """
        mid = (w - 1) / 2.0
        spread = sum((i - mid) ** 2 for i in range(w))
        total = F.lit(0.0)
        for i in range(w):
            k = w - 1 - i
            value = _col(col) if k == 0 else self.lag(col, k)
            total = total + F.lit((i - mid) / spread) * value
        mean = self.rolling(col, w)
        return F.when(F.abs(mean) > 1e-9, total / F.abs(mean))

    def same_weekday_mean(self, col, ks: Sequence[int] = (7, 14, 21, 28)) -> Column:
        """Mean of the available values k rows ago."""
        total, n = F.lit(0.0), F.lit(0)
        for k in ks:
            past = self.lag(col, k)
            total = total + F.coalesce(past, F.lit(0.0))
            n = n + past.isNotNull().cast("int")
        return total / F.nullif(n, F.lit(0))

    def row_no(self) -> Column:
        return F.row_number().over(self.order)

    def forward_ratio(self, col, horizon: int = 7, base: int = 28, past_base: bool = False) -> Column:
        """Next `horizon` days against the trailing daily mean.

        NULL while the future is incomplete or the base is not full.
        """
        value = _col(col)
        ahead = self.frame(1, horizon)
        future = F.when(F.count(value).over(ahead) == horizon, F.sum(value).over(ahead))
        return safe_ratio(future, horizon * self.rolling(col, base, past=past_base))

    def next_ratio(self, col, base: int = 4) -> Column:
        """The next row against the trailing mean, today included."""
        return safe_ratio(self.lead(col, 1), self.rolling(col, base))

    def worst_of_next(self, col, horizon: int, base: int = 4) -> Column:
        value = _col(col)
        ahead = self.frame(1, horizon)
        worst = F.when(F.count(value).over(ahead) == horizon, F.min(value).over(ahead))
        return safe_ratio(worst, self.rolling(col, base))

    def causal_percentile(self, col, lookback: int, warmup: int, early: float | None = None) -> Column:
        """Mid-rank of the current score among the `lookback` scores before it."""
        value = _col(col)
        earlier = F.collect_list(value).over(self.frame(-lookback, -1))
        less = F.size(F.filter(earlier, lambda e: e < value))
        equal = F.size(F.filter(earlier, lambda e: e == value))
        n = F.size(earlier)
        return F.when(n >= warmup, (less + 0.5 * equal) / n).otherwise(F.lit(early).cast("double"))

    def forward_fill(self, col) -> Column:
        return F.last(_col(col), ignorenulls=True).over(self.frame(Window.unboundedPreceding, 0))

    def backward_fill(self, col) -> Column:
        """Reads the future: for filling references, never for features."""
        return F.first(_col(col), ignorenulls=True).over(self.frame(0, Window.unboundedFollowing))


def _col(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def below(ratio: Column, cut: float) -> Column:
    """0/1 label; NULL ratio gives NULL."""
    return (ratio < cut).cast("int")


def lags(df: DataFrame, s: Series, cols: Sequence[str], ks: Sequence[int]) -> DataFrame:
    return df.withColumns({f"{c}_lag_{k}": s.lag(c, k) for c in cols for k in ks})


def rolling(
    df: DataFrame, s: Series, cols: Sequence[str], ws: Sequence[int], fn: str, past: bool = False,
    min_rows: Mapping[int, int] | None = None,
) -> DataFrame:
    """`{col}_{fn}_{w}`; `min_rows` maps a window to the rows it needs."""
    tag = f"past_{fn}" if past else fn
    return df.withColumns(
        {
            f"{c}_{tag}_{w}": s.rolling(c, w, fn, past, (min_rows or {}).get(w))
            for c in cols
            for w in ws
        }
    )


def store_min_rows(w: int) -> int:
    """The looser warm-up of the store panel."""
    return max(3, w // 2)


def sector_min_rows(w: int) -> int:
    """4 of 7 and 14 of 28."""
    return (w + 1) // 2


def share_of_total(df: DataFrame, period: Sequence[str], col: str, out: str) -> DataFrame:
    """x / total of its period. The totals are aggregated and joined back, so a
    period with very many entities is not gathered in one window."""
    totals = df.groupBy(*period).agg(F.sum(col).alias("_total"))
    return df.join(totals, list(period)).withColumn(
        out, safe_ratio(F.col(col), F.col("_total"))
    ).drop("_total")


def relative_growth(df: DataFrame, entity: str, time: str, col: str, k: int, out: str) -> DataFrame:
    """Entity change minus the change of all entities together."""
    market = df.groupBy(time).agg(F.sum(col).alias("_market"))
    m = Series([], time)
    market = market.select(time, m.change("_market", k).alias("_market_change"))
    s = Series(entity, time)
    return (
        df.withColumn("_own", s.change(col, k))
        .join(market, time)
        .withColumn(out, F.col("_own") - F.col("_market_change"))
        .drop("_own", "_market_change")
    )


def compress_calendar(df: DataFrame, day: str, start: str) -> DataFrame:
    """The k-th distinct source date becomes start + k days; `gap_days` keeps
    what was removed before it. Dates are one row each, a calendar's length."""
    dates = df.select(F.col(day)).distinct()
    order = Window.partitionBy().orderBy(day)
    mapping = dates.select(
        day,
        F.date_add(F.lit(start).cast("date"), F.row_number().over(order) - 1).alias("training_date"),
        F.coalesce(F.datediff(F.col(day), F.lag(day).over(order)) - 1, F.lit(0)).alias("gap_days"),
    )
    return df.join(mapping, day)


def consecutive_only(df: DataFrame, s: Series, step: int = 7) -> DataFrame:
    """Rows whose neighbours are exactly one step away on both sides."""
    t = F.col(s.time)
    return (
        df.withColumns(
            {
                "_back": F.datediff(t, s.lag(s.time, 1)),
                "_ahead": F.datediff(s.lead(s.time, 1), t),
            }
        )
        .where((F.col("_back") == step) & (F.col("_ahead") == step))
        .drop("_back", "_ahead")
    )
