"""Per-entity forecasting: candidates, backtests, model choice, paths.

A series at a point in time is a small state: its last 56 values, the running
maximum, sum and length. States come from window functions, so every entity,
backtest origin and candidate model is an independent row; forecasting feeds
predictions back into the state with `aggregate`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.functions.scalars import safe_ratio
from ebbtide.operators.ordering import settle
from ebbtide.operators.windows import Series

BUFFER = 56
MIN_HISTORY = 28
HORIZONS = (7, 30)

CANDIDATES = (
    "seasonal_naive_7",
    "moving_average_7",
    "moving_average_14",
    "median_7",
    "median_14",
    "weekday_mean_8w",
    "weekday_median_8w",
    "seasonal_level_blend",
    "weekly_trend_7",
)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Bind a value to a name inside an expression, so it is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _mean(values: Column) -> Column:
    return _total(values) / F.size(values)


def _median(values: Column) -> Column:
    def middle(v: Column) -> Column:
        n = F.size(v)
        lower = F.element_at(v, F.floor((n + 1) / 2).cast("int"))
        upper = F.element_at(v, (F.floor(n / 2) + 1).cast("int"))
        return (lower + upper) / 2.0

    return let(F.array_sort(values), middle)


def _last(values: Column, k: int) -> Column:
    """The newest k values; all of them when there are fewer."""
    return F.when(F.size(values) >= k, F.slice(values, -k, k)).otherwise(values)


def _between(values: Column, back: int, k: int) -> Column:
    return F.slice(values, -back, k)


def _same_weekday(values: Column) -> Column:
    weeks = F.filter(F.sequence(F.lit(1), F.lit(8)), lambda k: k * 7 <= F.size(values))
    return F.transform(weeks, lambda k: F.element_at(values, (-7 * k).cast("int")))


def _trend(values: Column) -> Column:
    recent, previous = _total(_last(values, 7)), _total(_between(values, 14, 7))
    move = F.least(F.lit(1.35), F.greatest(F.lit(0.65), recent / previous)) - 1.0
    factor = F.when(previous <= 0, F.lit(1.0)).otherwise(1.0 + 0.55 * move)
    return F.element_at(values, -7) * F.least(F.lit(1.20), F.greatest(F.lit(0.80), factor))


def _rule(model: str, values: Column) -> Column:
    return {
        "seasonal_naive_7": lambda: F.element_at(values, -7),
        "moving_average_7": lambda: _mean(_last(values, 7)),
        "moving_average_14": lambda: _mean(_last(values, 14)),
        "median_7": lambda: _median(_last(values, 7)),
        "median_14": lambda: _median(_last(values, 14)),
        "weekday_mean_8w": lambda: _mean(_same_weekday(values)),
        "weekday_median_8w": lambda: _median(_same_weekday(values)),
        "seasonal_level_blend": lambda: 0.60 * F.element_at(values, -7) + 0.40 * _median(_last(values, 14)),
        "weekly_trend_7": lambda: _trend(values),
    }[model]()


def candidate_forecast(values: Column, top: Column, total: Column, n: Column, model: str | Column) -> Column:
    """The next value under a model, kept within 0 and the history's cap.
    NULL before 14 observations. `model` is a name or a column of names."""
    cap = F.greatest(3.0 * top, 8.0 * total / n, F.lit(1.0))
    if isinstance(model, str):
        raw = _rule(model, values)
    else:
        raw = F.lit(None).cast("double")
        for name in CANDIDATES:
            raw = F.when(model == name, _rule(name, values)).otherwise(raw)
    return F.when(n >= 14, F.least(F.greatest(F.lit(0.0), raw), cap))


def simulate(values: Column, top: Column, total: Column, n: Column, model: str | Column, horizon: Column | int) -> Column:
    """The path of `horizon` predictions, each one fed back as history."""
    steps = F.sequence(F.lit(1), F.lit(horizon) if isinstance(horizon, int) else horizon)
    start = F.struct(
        values.alias("values"), top.cast("double").alias("top"), total.cast("double").alias("total"),
        n.cast("long").alias("n"), F.array().cast("array<double>").alias("path"),
    )

    def step(state: Column, _: Column) -> Column:
        nxt = candidate_forecast(state["values"], state["top"], state["total"], state["n"], model)
        return let(
            nxt,
            lambda p: F.struct(
                _last(F.concat(state["values"], F.array(p)), BUFFER).alias("values"),
                F.greatest(state["top"], p).alias("top"),
                (state["total"] + p).alias("total"),
                (state["n"] + 1).alias("n"),
                F.concat(state["path"], F.array(p)).alias("path"),
            ),
        )

    return F.aggregate(steps, start, step, lambda s: s["path"])


def running_state(df: DataFrame, keys: Sequence[str], day: str, value: str) -> DataFrame:
    """Clipped value `v`, position `n`, running maximum and sum of each row."""
    d = df.select(*keys, F.col(day).alias("day"), F.greatest(F.col(value).cast("double"), F.lit(0.0)).alias("v"))
    s = Series(list(keys), "day")
    sofar = s.frame(Window.unboundedPreceding, 0)
    return d.withColumns(
        {
            "n": F.row_number().over(s.order).cast("long"),
            "top": F.max("v").over(sofar),
            "total": F.sum("v").over(sofar),
        }
    )


def recent_states(running: DataFrame, keys: Sequence[str], horizon: int) -> DataFrame:
    """States of the rows the backtests and the final forecast need, with the
    next values beside them. Series shorter than 28 days drop out."""
    keys = list(keys)
    length = running.groupBy(*keys).agg(F.max("n").alias("length")).where(F.col("length") >= MIN_HISTORY)
    tail = running.join(length, keys).where(F.col("n") > F.col("length") - (horizon + 2 * BUFFER))
    s = Series(keys, "day")
    ahead = s.frame(1, horizon)
    return tail.withColumns(
        {
            "values": F.collect_list("v").over(s.frame(-(BUFFER - 1), 0)),
            "next_value": s.lead("v", 1),
            "next_total": F.when(F.count("v").over(ahead) == horizon, F.sum("v").over(ahead)),
        }
    )


def one_step_errors(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Actual and predicted next value per model for up to 42 origins."""
    start = F.greatest(F.lit(14), F.col("length") - 42)
    origins = states.where((F.col("n") >= start) & F.col("next_value").isNotNull())
    options = F.array(
        *[
            F.struct(
                F.lit(m).alias("model"),
                candidate_forecast(F.col("values"), F.col("top"), F.col("total"), F.col("n"), m).alias("predicted"),
            )
            for m in CANDIDATES
        ]
    )
    return origins.select(*keys, "day", F.col("next_value").alias("actual"), F.explode(options).alias("_m")).select(
        *keys, "day", "actual", F.col("_m.model").alias("model"), F.col("_m.predicted").alias("predicted")
    )


def forecast_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE, WAPE and symmetric percentage error."""
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    gap = F.abs(a - p)
    size = F.abs(a) + F.abs(p)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("points"),
        F.avg(gap).alias("mae"),
        F.sqrt(F.avg(gap * gap)).alias("rmse"),
        (F.sum(gap) / F.greatest(F.sum(F.abs(a)), F.lit(1e-9))).alias("wape"),
        F.avg(F.when(size > 0, 2.0 * gap / size).otherwise(0.0)).alias("smape"),
    )


def one_step_backtest(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Errors and the interval half-width per model: the nearest-rank 90% of
    the absolute residuals, at least 1. At most 42 residuals per series."""
    errors = one_step_errors(states, keys)
    metrics = forecast_metrics(errors, "actual", "predicted", [*keys, "model"])
    widths = errors.groupBy(*keys, "model").agg(
        F.array_sort(F.collect_list(F.abs(F.col("actual") - F.col("predicted")))).alias("_r")
    )
    index = F.bround((F.size("_r") - 1) * F.lit(0.90)).cast("int") + 1
    widths = widths.select(*keys, "model", F.greatest(F.element_at("_r", index), F.lit(1.0)).alias("interval_error"))
    return metrics.join(widths, [*keys, "model"])


def horizon_backtest(states: DataFrame, keys: Sequence[str], horizon: int) -> DataFrame:
    """Total error over the horizon from weekly origins.

    Each (series, origin, model) becomes its own row and rows are spread out
    before the recursion, so a few long series do not hold up a few tasks.
    """
    latest = F.col("length") - horizon
    start = F.greatest(F.lit(MIN_HISTORY), latest - 56)
    origins = states.where(
        (F.col("n") >= start) & (F.col("n") <= latest) & ((F.col("n") - start) % 7 == 0) & F.col("next_total").isNotNull()
    )
    rows = origins.select(
        *keys, "n", "values", "top", "total", "next_total", F.explode(F.array(*[F.lit(m) for m in CANDIDATES])).alias("model")
    ).repartition(*[F.col(k) for k in keys], F.col("n"), F.col("model"))
    path = simulate(F.col("values"), F.col("top"), F.col("total"), F.col("n"), F.col("model"), horizon)
    totals = rows.select(*keys, "model", "next_total", _total(path).alias("_p"))
    return totals.groupBy(*keys, "model").agg(
        (F.sum(F.abs(F.col("next_total") - F.col("_p"))) / F.greatest(F.sum("next_total"), F.lit(1e-9))).alias("total_wape"),
        F.count(F.lit(1)).alias("folds"),
    )


def select_model(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The model with the least total error; daily error where there was no
    room for a horizon backtest; then daily error, MAE and name."""
    order = F.struct(F.coalesce("total_wape", "wape"), F.col("wape"), F.col("mae"), F.col("model"))
    kept = [c for c in metrics.columns if c not in keys]
    best = metrics.groupBy(*keys).agg(F.min_by(F.struct(*kept), order).alias("_b"))
    return best.select(*keys, *[F.col("_b")[c].alias(c) for c in kept])


def model_metrics(states: DataFrame, keys: Sequence[str], horizon: int) -> DataFrame:
    one = one_step_backtest(states, keys)
    many = horizon_backtest(states, keys, horizon)
    return one.join(many, [*keys, "model"], "left")


def forecast_from_states(states: DataFrame, keys: Sequence[str], horizon: int) -> DataFrame:
    """Path of the chosen model with interval, baseline and decline share."""
    keys = list(keys)
    chosen = select_model(model_metrics(states, keys, horizon), keys)
    last = states.where(F.col("n") == F.col("length")).select(*keys, "day", "values", "top", "total", "n")
    d = last.join(chosen, keys)
    d = d.withColumns(
        {
            "_path": simulate(F.col("values"), F.col("top"), F.col("total"), F.col("n"), F.col("model"), horizon),
            "baseline": _mean(_last(F.col("values"), 28)),
        }
    )
    carried = ["model", "wape", "mae", "rmse", "points", "total_wape", "folds", "interval_error"]
    d = d.select(*keys, "day", "n", "baseline", *carried, F.posexplode("_path").alias("_i", "predicted"))
    base, p = F.col("baseline"), F.col("predicted")
    return d.select(
        *keys,
        F.date_add("day", F.col("_i") + 1).alias("date"),
        "predicted",
        F.greatest(F.lit(0.0), p - F.col("interval_error")).alias("lower"),
        (p + F.col("interval_error")).alias("upper"),
        "baseline",
        F.greatest(F.lit(0.0), (base - p) / F.greatest(F.abs(base), F.lit(1.0))).alias("decline_percent"),
        F.col("day").alias("data_end"),
        F.col("n").alias("history_days"),
        *carried,
    )


def adaptive_forecast(df: DataFrame, keys: Sequence[str], day: str, value: str, horizon: int) -> DataFrame:
    """Forecast every series with the model that did best on it. Series with
    fewer than 28 days give no rows."""
    if horizon not in HORIZONS:
        raise ValueError("only 7-day and 30-day horizons are supported")
    states = settle(recent_states(running_state(df, keys, day, value), keys, horizon))
    return forecast_from_states(states, keys, horizon)


def walk_forward(
    df: DataFrame, keys: Sequence[str], day: str, value: str, horizon: int, step: int = 7, first: int = 56
) -> tuple[DataFrame, DataFrame]:
    """Repeat the whole choice-and-forecast at past origins and compare with
    the value of the same weekday a week earlier.

    Every origin becomes a series of its own made of the rows its backtests
    read, a fixed number; running totals come from the full series. Origins
    stand at `first`, `first + step`, ... while their future is complete.
    Returns (daily rows, summary per series).
    """
    keys = list(keys)
    running = running_state(df, keys, day, value)
    length = running.groupBy(*keys).agg(F.max("n").alias("_len"))
    full = running.join(length, keys)
    last = F.col("_len") - horizon
    reach = horizon + 2 * BUFFER
    lo = F.greatest(F.col("n"), F.lit(first))
    hi = F.least(last, F.col("n") + reach - 1)
    options = F.when(lo <= hi, F.filter(F.sequence(lo, hi), lambda o: (o - first) % step == 0))
    parts = full.withColumn("origin", F.explode(options)).drop("_len")
    pkeys = [*keys, "origin"]
    states = settle(recent_states(parts, pkeys, horizon))
    path = forecast_from_states(states, pkeys, horizon)
    ends = states.where(F.col("n") == F.col("length"))
    naive = ends.select(
        *pkeys, F.col("day").alias("_d"),
        F.posexplode(simulate(F.col("values"), F.col("top"), F.col("total"), F.col("n"), "seasonal_naive_7", horizon)).alias("_i", "naive"),
    ).select(*pkeys, F.date_add("_d", F.col("_i") + 1).alias("date"), "naive")
    actual = running.select(*keys, F.col("day").alias("date"), F.col("v").alias("actual"))
    daily = path.select(*pkeys, "date", "predicted", "lower", "upper", "model").join(naive, [*pkeys, "date"]).join(
        actual, [*keys, "date"]
    )
    inside = F.col("actual").between(F.col("lower"), F.col("upper"))
    per = daily.groupBy(*pkeys).agg(
        F.sum("actual").alias("a"), F.sum("predicted").alias("p"), F.sum("naive").alias("q"),
        F.sum(F.abs(F.col("actual") - F.col("predicted"))).alias("dp"), F.sum(F.abs(F.col("actual") - F.col("naive"))).alias("dq"),
        F.avg(inside.cast("double")).alias("coverage"),
    )
    floor = F.greatest(F.sum("a"), F.lit(1e-9))
    ep, eq = F.abs(F.col("a") - F.col("p")), F.abs(F.col("a") - F.col("q"))
    summary = per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("origins"),
        (F.sum("dp") / floor).alias("daily_wape"),
        (F.sum("dq") / floor).alias("naive_daily_wape"),
        (F.sum(ep) / floor).alias("total_wape"),
        (F.sum(eq) / floor).alias("naive_total_wape"),
        F.avg("coverage").alias("interval_coverage"),
        F.count_if(ep < eq).alias("wins"),
        F.count_if(ep > eq).alias("losses"),
    )
    return daily, summary


# --- the older engine ---------------------------------------------------------------


@dataclass(frozen=True)
class Ridge:
    """A fitted linear model over the 17 series features."""

    features: Sequence[str]
    mean: Sequence[float]
    scale: Sequence[float]
    coefficients: Sequence[float]
    intercept: float
    log_target: bool = False
    prediction_cap: float = 0.0


def series_features(values: Column, day: Column, trend: Column) -> dict[str, Column]:
    """Lags, rolling means, population std, calendar position and trend."""

    def std(k: int) -> Column:
        part = _last(values, k)
        return let(_mean(part), lambda m: F.sqrt(_mean(F.transform(part, lambda x: (x - m) * (x - m)))))

    dow, month = F.weekday(day).cast("double"), (F.month(day) - 1).cast("double")
    out = {f"lag_{k}": F.element_at(values, -k) for k in (1, 2, 3, 7, 14, 21, 28)}
    out.update({f"rolling_{k}": _mean(_last(values, k)) for k in (7, 14, 28)})
    out.update({f"std_{k}": std(k) for k in (7, 14)})
    out["weekday_sin"], out["weekday_cos"] = F.sin(2 * F.pi() * dow / 7), F.cos(2 * F.pi() * dow / 7)
    out["month_sin"], out["month_cos"] = F.sin(2 * F.pi() * month / 12), F.cos(2 * F.pi() * month / 12)
    out["trend"] = trend.cast("double")
    return out


def _history_cap(high: Column, n: Column, total: Column) -> Column:
    """max(4 x the 99.5% value, 10 x the mean, 1); `high` holds the largest
    values in falling order, enough to reach the quantile."""
    from_top = n - 1 - F.floor((n - 1) * F.lit(0.995))
    return F.greatest(4.0 * F.element_at(high, (from_top + 1).cast("int")), 10.0 * total / n, F.lit(1.0))


def history_arrays(df: DataFrame, keys: Sequence[str], day: str, value: str, horizon: int) -> DataFrame:
    """One row per series: last values, largest values, length, sum, last day.

    A series has one value per calendar day, which bounds the arrays.
    """
    running = running_state(df, keys, day, value)
    whole = running.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("day", "v"))).alias("_s"), F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"), F.max("day").alias("day")
    )
    keep = F.ceil((F.col("n") + horizon) * F.lit(0.005)).cast("int") + 2
    series = F.transform("_s", lambda x: x["v"])
    return whole.where(F.col("n") >= MIN_HISTORY).select(
        *keys, "n", "total", "day", series.alias("history"), _last(series, BUFFER).alias("values"),
        F.slice(F.sort_array(series, asc=False), F.lit(1), keep).alias("high"),
    )


def baseline_path(model: str | Ridge, horizon: int) -> Column:
    """Recursive path of naive-7, mean-7, median-7, mean-14 or a ridge model
    over the columns of `history_arrays`."""
    size = F.size("high")
    start = F.struct(
        F.col("values"), F.col("high"), F.col("total"), F.col("n"), F.array().cast("array<double>").alias("path")
    )

    def predict(state: Column, i: Column) -> Column:
        values = state["values"]
        cap = _history_cap(state["high"], state["n"], state["total"])
        if isinstance(model, Ridge):
            feats = series_features(values, F.date_add(F.col("day"), i), state["n"])
            total = F.lit(float(model.intercept))
            for name, m, s, c in zip(model.features, model.mean, model.scale, model.coefficients):
                total = total + F.lit(float(c)) * (feats[name] - F.lit(float(m))) / F.lit(float(s) or 1.0)
            cap = F.greatest(F.lit(float(model.prediction_cap)), cap)
            if model.log_target:
                total = F.expm1(F.least(F.greatest(total, F.lit(-20.0)), F.log1p(cap)))
            raw = total
        else:
            raw = {
                "seasonal_naive_7": lambda: F.element_at(values, -7),
                "moving_average_7": lambda: _mean(_last(values, 7)),
                "median_7": lambda: F.element_at(F.array_sort(_last(values, 7)), 4),
                "moving_average_14": lambda: _mean(_last(values, 14)),
            }[model]()
        return F.least(F.greatest(F.lit(0.0), raw), cap)

    def step(state: Column, i: Column) -> Column:
        return let(
            predict(state, i),
            lambda p: F.struct(
                _last(F.concat(state["values"], F.array(p)), BUFFER).alias("values"),
                F.slice(F.sort_array(F.concat(state["high"], F.array(p)), asc=False), F.lit(1), size).alias("high"),
                (state["total"] + p).alias("total"),
                (state["n"] + 1).alias("n"),
                F.concat(state["path"], F.array(p)).alias("path"),
            ),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, step, lambda s: s["path"])


def _share(values: Column) -> Column:
    """Values as shares of their sum; equal shares when it is not positive."""
    return let(
        _total(values),
        lambda t: F.transform(values, lambda x: F.when(t > 0, x / t).otherwise(1.0 / F.size(values))),
    )


def calibrate_to_local(arrays: DataFrame, keys: Sequence[str], path: Column, horizon: int) -> DataFrame:
    """Bring a path to the merchant's own level week by week.

    Week totals follow the last week times a damped trend; days follow 0.35
    of the path's shape and 0.65 of the last week's. Bounds are 1.64 local
    errors wide and the probability is logistic in the distance to baseline.
    """
    v = F.col("values")
    recent, previous = _total(_last(v, 7)), _total(_between(v, 14, 7))
    damped = 1.0 + 0.60 * (F.least(F.lit(1.40), F.greatest(F.lit(0.60), recent / previous)) - 1.0)
    trend = F.when(previous <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.24), F.greatest(F.lit(0.76), damped)))
    # the last 28 week-over-week differences: at most 35 values are needed
    pairs = F.sequence(F.lit(1), F.least(F.lit(28), F.size(v) - 7))
    diffs = F.transform(pairs, lambda i: F.element_at(v, (-i).cast("int")) - F.element_at(v, (-i - 7).cast("int")))
    spread = let(
        diffs,
        lambda r: let(
            _mean(r),
            lambda m: F.greatest(
                F.sqrt(_mean(F.transform(r, lambda x: (x - m) * (x - m)))), _mean(F.transform(r, lambda x: F.abs(x))), F.lit(1.0)
            ),
        ),
    )
    d = arrays.select(
        *keys, "day", "values", path.alias("_path"), recent.alias("_recent"), trend.alias("_trend"), spread.alias("local_error"),
        _mean(_last(v, 28)).alias("baseline"),
    )
    d = d.withColumn("_growth", F.least(F.lit(1.12), F.greatest(F.lit(0.88), 1.0 + 0.35 * (F.col("_trend") - 1.0))))
    weeks = -(-horizon // 7)
    d = d.select("*", F.explode(F.sequence(F.lit(0), F.lit(weeks - 1))).alias("_w"))
    segment = F.slice(F.col("_path"), F.col("_w") * 7 + 1, F.least(F.lit(7), F.lit(horizon) - F.col("_w") * 7))
    last_week = F.when(F.col("_recent") > 0, _last(F.col("values"), 7)).otherwise(F.array_repeat(F.lit(1.0), 7))
    d = d.withColumn("_seg", segment)
    d = d.withColumn("_local", F.slice(last_week, F.lit(1), F.size("_seg")))
    total = F.col("_recent") * F.col("_trend") * F.pow(F.col("_growth"), F.col("_w")) * F.size("_seg") / 7.0
    blend = F.zip_with(_share(F.col("_seg")), _share(F.col("_local")), lambda a, b: 0.35 * a + 0.65 * b)
    d = d.withColumns({"_target": total, "_blend": blend})
    d = d.select(
        *keys, "day", "baseline", "local_error", "_w",
        F.posexplode(F.transform(_share(F.col("_blend")), lambda s: F.greatest(F.lit(0.0), F.col("_target") * s))).alias("_i", "predicted"),
    )
    err = F.greatest(F.col("local_error"), F.lit(1.0))
    z = F.greatest(F.lit(-20.0), F.least(F.lit(20.0), (F.col("baseline") - F.col("predicted")) / err))
    p, base = F.col("predicted"), F.col("baseline")
    return d.select(
        *keys,
        F.date_add("day", F.col("_w") * 7 + F.col("_i") + 1).alias("date"),
        "predicted",
        F.greatest(F.lit(0.0), p - 1.64 * err).alias("lower"),
        F.greatest(F.lit(0.0), p + 1.64 * err).alias("upper"),
        "baseline",
        F.greatest(F.lit(0.0), (base - p) / F.greatest(F.abs(base), F.lit(1.0))).alias("decline_percent"),
        (1.0 / (1.0 + F.exp(-z))).alias("decline_probability"),
    )


# --- summaries ------------------------------------------------------------------------


def recent_change(df: DataFrame, keys: Sequence[str], day: str, value: str, window: int = 7) -> DataFrame:
    """The last days against the ones before; no change below two windows."""
    keys = list(keys)
    span = df.groupBy(*keys).agg(F.max(day).alias("_last"), F.count(F.lit(1)).alias("_n"))
    d = df.join(span, keys) if keys else df.join(F.broadcast(span))
    x, t = F.col(value).cast("double"), F.col(day)
    cur = t > F.date_sub("_last", window)
    prev = (t > F.date_sub("_last", 2 * window)) & ~cur
    out = d.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(cur, x)), F.lit(0.0)).alias("current_sales"),
        F.when(F.max("_n") >= 2 * window, F.coalesce(F.sum(F.when(prev, x)), F.lit(0.0))).otherwise(0.0).alias("previous_sales"),
    )
    c, p = F.col("current_sales"), F.col("previous_sales")
    return out.withColumn("change_pct", F.when(p != 0, (c - p) / F.abs(p) * 100.0).otherwise(0.0)).withColumn(
        "decline_pct", F.greatest(F.lit(0.0), -F.col("change_pct"))
    )


def horizon_change(path: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean of the forecast against the 28-day baseline."""
    g = path.groupBy(*keys).agg(F.avg("predicted").alias("forecast_mean"), F.max("baseline").alias("baseline"))
    change = F.when(F.col("baseline") != 0, (F.col("forecast_mean") - F.col("baseline")) / F.abs("baseline") * 100.0).otherwise(0.0)
    return g.withColumn("predicted_change_pct", change).withColumn(
        "predicted_decline_pct", F.greatest(F.lit(0.0), -F.col("predicted_change_pct"))
    )


def quality_summary(metrics: DataFrame) -> DataFrame:
    """WAPE as percent and as a 0-100 quality figure; total error first."""
    main = F.coalesce("total_wape", "wape")

    def pct(c: Column) -> Column:
        return F.when(c.isNotNull(), F.greatest(F.lit(0.0), c * 100.0))

    return metrics.withColumns(
        {
            "accuracy_proxy_pct": F.when(main.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), (1.0 - main) * 100.0))),
            "error_wape_pct": pct(main),
            "daily_wape_pct": pct(F.col("wape")),
            "horizon_total_wape_pct": pct(F.col("total_wape")),
        }
    )


def decline_quality(counts: DataFrame) -> DataFrame:
    """Correct and wrong decisions as counts and percent from tp, fp, fn, tn,
    with the rates that `counts` has: precision, recall, f1, roc_auc."""
    percent = {f"{c}_pct": F.col(c) * 100.0 for c in ("precision", "recall", "f1", "roc_auc") if c in counts.columns}
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    ok = F.col("tp") + F.col("tn")
    return counts.withColumns(
        {
            "correct_count": ok,
            "wrong_count": n - ok,
            "sample_size": n,
            "accuracy_pct": safe_ratio(ok, n) * 100.0,
            "error_pct": safe_ratio(n - ok, n) * 100.0,
            **percent,
        }
    )
