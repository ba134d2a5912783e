"""Evaluation and alert policies over scores(entity, date, fold_id, y, score).

Threshold work reduces all rows to counts per (fold, threshold range) in one
pass; everything after that handles a few hundred rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.functions.scalars import odds_shift, safe_ratio
from ebbtide.operators.history import local_prior
from ebbtide.operators.ordering import cut_points, exact_quantiles, quantile_grid, range_bucket, running_totals, settle
from ebbtide.operators.windows import Series


def even(lo: float, hi: float, n: int) -> list[float]:
    """n evenly spaced values from lo to hi."""
    step = (hi - lo) / (n - 1)
    return [lo + i * step for i in range(n - 1)] + [hi]


# --- confusion counts and rates -------------------------------------------------


def rates() -> dict[str, Column]:
    """Rates from the columns tp, fp, fn, tn; a zero denominator gives 0."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))

    def share(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    recall, precision = share(tp, tp + fn), share(tp, tp + fp)
    return {
        "accuracy": share(tp + tn, tp + fp + fn + tn),
        "balanced_accuracy": (recall + share(tn, tn + fp)) / 2.0,
        "precision": precision,
        "recall": recall,
        "f1": share(2.0 * tp, 2.0 * tp + fp + fn),
        "npv": share(tn, tn + fn),
        "fpr": share(fp, fp + tn),
        "alert_rate": share(tp + fp, tp + fp + fn + tn),
    }


def confusion(label: str, alert: Column) -> list[Column]:
    y = F.col(label) == 1
    return [
        F.count_if(y & alert).alias("tp"),
        F.count_if(~y & alert).alias("fp"),
        F.count_if(y & ~alert).alias("fn"),
        F.count_if(~y & ~alert).alias("tn"),
    ]


def binary_metrics(df: DataFrame, label: str, alert: Column, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*confusion(label, alert)).withColumns(rates())


def fold_summary(df: DataFrame, label: str, alert: Column, fold: str, min_positives: int = 4) -> DataFrame:
    """Pooled metrics with the worst recall of the folds that have enough
    positives and the highest alert rate of any fold."""
    per = binary_metrics(df, label, alert, [fold])
    usable = (F.col("tp") + F.col("fn")) >= min_positives
    pooled = per.agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")],
        F.min(F.when(usable, F.col("recall"))).alias("_worst"),
        F.max("alert_rate").alias("max_fold_alert_rate"),
    ).withColumns(rates())
    return pooled.withColumn("worst_fold_recall", F.coalesce("_worst", "recall")).drop("_worst")


def _class_totals(df: DataFrame, label: str, score: str, by: Sequence[str], descending: bool) -> DataFrame:
    y = F.col(label).cast("long")
    return running_totals(df, score, {"pos": y, "neg": 1 - y}, by, descending)


def roc_auc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Mann-Whitney statistic, ties counted half; NULL with one class only."""
    t = _class_totals(df, label, score, by, False)
    below = F.col("cum_neg") - F.col("neg") / 2.0
    pairs = F.max("total_pos").cast("double") * F.max("total_neg")
    return t.groupBy(*by).agg(safe_ratio(F.sum(F.col("pos") * below), pairs).alias("roc_auc"))


def average_precision(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Precision at each distinct score weighted by the recall it adds."""
    t = _class_totals(df, label, score, by, True)
    precision = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    return t.groupBy(*by).agg(
        safe_ratio(F.sum(F.col("pos") * precision), F.max("total_pos")).alias("pr_auc")
    )


def calibration_metrics(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """Brier score and expected calibration error over equal bins."""
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(score).cast("double")))
    edges = [i * (1.0 / bins) for i in range(1, bins)]
    d = df.select(F.col(label).cast("double").alias("_y"), p.alias("_p")).withColumn(
        "_bin", range_bucket(F.col("_p"), edges)
    )
    per = d.groupBy("_bin").agg(
        F.count(F.lit(1)).alias("_n"),
        F.abs(F.avg("_p") - F.avg("_y")).alias("_gap"),
        F.sum(F.pow(F.col("_p") - F.col("_y"), 2)).alias("_se"),
    )
    return per.agg(
        (F.sum("_se") / F.sum("_n")).alias("brier"),
        (F.sum(F.col("_n") * F.col("_gap")) / F.sum("_n")).alias("ece"),
    )


# --- threshold sweeps -----------------------------------------------------------


def threshold_grid(df: DataFrame, score: str, evenly: Sequence[float], quantiles: Sequence[float]) -> list[float]:
    """Candidate thresholds: an even grid and score quantiles, a few hundred
    at most."""
    found = quantile_grid(df, score, quantiles) if quantiles else []
    return sorted(set(evenly) | set(found))


def _threshold_table(df: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    rows = [(i, float(v)) for i, v in enumerate(thresholds)]
    return df.sparkSession.createDataFrame(rows, "threshold_no int, threshold double")


def sweep(df: DataFrame, label: str, score: str, thresholds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts at every threshold (alert when score >= threshold).

    Rows fall into threshold ranges and are counted there; the counts are then
    accumulated from the highest range down. `by` must be short, like folds.
    """
    by = list(by)
    y = F.col(label) == 1
    counted = df.select(*by, y.alias("_y"), range_bucket(F.col(score), thresholds).alias("_r")).groupBy(*by, "_r").agg(
        F.count_if(F.col("_y")).alias("pos"), F.count_if(~F.col("_y")).alias("neg")
    )
    # every range below a row's own is a threshold the row passes
    marks = _threshold_table(df, thresholds).withColumn("_r", F.col("threshold_no") + 1)
    groups = counted.select(*by).distinct() if by else None
    grid = groups.join(F.broadcast(marks)) if by else marks
    full = grid.join(counted, [*by, "_r"], "left").na.fill(0, ["pos", "neg"])
    down = Window.partitionBy(*by).orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, 0)
    totals = counted.groupBy(*by).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    acc = full.withColumns({"tp": F.sum("pos").over(down), "fp": F.sum("neg").over(down)})
    acc = acc.join(totals, by) if by else acc.join(F.broadcast(totals))
    return acc.select(
        *by, "threshold_no", "threshold", "tp", "fp", (F.col("_p") - F.col("tp")).alias("fn"), (F.col("_n") - F.col("fp")).alias("tn")
    )


def _bonus(name: str, weight: float) -> Column:
    return weight * F.col(name)


# The grids, limits and objective weights of the three sweeps.
SWEEPS = {
    "resolution": {
        "even": (0.03, 0.97, 189),
        "quantiles": (0.02, 0.98, 121),
        "min_positives": 4,
        "limits": {"recall": 0.78, "precision": 0.30, "npv": 0.93, "worst_fold_recall": 0.45},
        "caps": {"alert_rate": 0.45, "max_fold_alert_rate": 0.65},
        "weights": {"f1": 1.35, "balanced_accuracy": 0.70, "worst_fold_recall": 0.35, "npv": 0.20, "alert_rate": -0.30},
        "shortfalls": {},
        "excesses": {},
        "ties": ("f1", "recall", "precision"),
    },
    "fusion": {
        "even": (0.05, 0.95, 181),
        "quantiles": (0.02, 0.98, 121),
        "min_positives": 5,
        "limits": {"recall": 0.78, "precision": 0.30, "f1": 0.44, "npv": 0.94, "worst_fold_recall": 0.45},
        "caps": {"alert_rate": 0.45, "max_fold_alert_rate": 0.65},
        "weights": {"f1": 1.35, "balanced_accuracy": 0.65, "precision": 0.35, "recall": 0.30, "npv": 0.20, "alert_rate": -0.30},
        "shortfalls": {},
        "excesses": {},
        "ties": ("f1", "precision", "recall"),
    },
    "signals": {
        "even": (0.05, 0.90, 171),
        "quantiles": (0.03, 0.97, 95),
        "min_positives": 4,
        "limits": {"recall": 0.75, "npv": 0.93},
        "caps": {"alert_rate": 0.45},
        "weights": {"f1": 0.40, "balanced_accuracy": 0.20, "recall": 0.20, "precision": 0.20},
        "shortfalls": {"recall": (0.75, 0.55), "npv": (0.93, 0.25)},
        "excesses": {"alert_rate": (0.45, 0.45)},
        "ties": ("f1", "balanced_accuracy"),
    },
}


def sweep_table(df: DataFrame, label: str, score: str, fold: str, profile: str) -> DataFrame:
    """Every candidate threshold with pooled metrics, fold limits, feasibility
    and objective."""
    spec = SWEEPS[profile]
    grid = threshold_grid(df, score, even(*spec["even"]), even(*spec["quantiles"]))
    per = sweep(df, label, score, grid, [fold]).withColumns(rates())
    usable = (F.col("tp") + F.col("fn")) >= spec["min_positives"]
    pooled = per.groupBy("threshold_no", "threshold").agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")],
        F.min(F.when(usable, F.col("recall"))).alias("_worst"),
        F.max("alert_rate").alias("max_fold_alert_rate"),
    ).withColumns(rates())
    pooled = pooled.withColumn("worst_fold_recall", F.coalesce("_worst", "recall")).drop("_worst")
    feasible = F.lit(True)
    for name, floor in spec["limits"].items():
        feasible = feasible & (F.col(name) >= floor)
    for name, cap in spec["caps"].items():
        feasible = feasible & (F.col(name) <= cap)
    objective = F.lit(0.0)
    for name, weight in spec["weights"].items():
        objective = objective + _bonus(name, weight)
    for name, (floor, weight) in spec["shortfalls"].items():
        objective = objective - weight * F.greatest(floor - F.col(name), F.lit(0.0))
    for name, (cap, weight) in spec["excesses"].items():
        objective = objective - weight * F.greatest(F.col(name) - cap, F.lit(0.0))
    return pooled.withColumns({"feasible": feasible, "objective": F.round(objective, 9)})


def sweep_threshold(df: DataFrame, label: str, score: str, fold: str, profile: str = "resolution") -> DataFrame:
    """The best threshold: feasible ones first, then by objective; equal ones
    go to the lowest threshold."""
    table = sweep_table(df, label, score, fold, profile)
    ties = [F.col(c).desc() for c in SWEEPS[profile]["ties"]]
    return table.orderBy(F.col("feasible").desc(), F.col("objective").desc(), *ties, F.col("threshold")).limit(1)


def watch_red(
    df: DataFrame, label: str, score: str, recall_min: float, npv_min: float, red_precision: float, red_fpr: float,
    red_alerts: int = 8, evenly: tuple = (0.01, 0.99, 197), quantiles: tuple = (0.0, 1.0, 101),
) -> DataFrame:
    """WATCH catches declines with few alerts; RED lies at or above it and is
    precise. When no threshold meets its contract the nearest one is taken and
    marked as a fallback."""
    grid = threshold_grid(df, score, even(*evenly), even(*quantiles))
    table = settle(sweep(df, label, score, grid).withColumns(rates()))
    near = F.least(F.col("recall"), F.lit(0.90)) + F.least(F.col("npv"), F.lit(0.98))
    met = (F.col("recall") >= recall_min) & (F.col("npv") >= npv_min)
    watch = table.withColumns(
        {"met": met, "_a": F.when(met, 0.0).otherwise(near), "_r": F.when(met, F.col("npv"))}
    ).orderBy(
        F.col("met").desc(), F.col("_a").desc(), F.col("precision").desc(), F.col("alert_rate").asc(), F.col("_r").desc(), "threshold"
    ).limit(1)
    watch = watch.select(
        F.col("threshold").alias("watch_threshold"), F.col("precision").alias("watch_precision"),
        F.col("recall").alias("watch_recall"), (~F.col("met")).alias("watch_fallback"),
    )
    ok = ((F.col("tp") + F.col("fp")) >= red_alerts) & (F.col("precision") >= red_precision) & (F.col("fpr") <= red_fpr)
    first = F.when(ok, F.col("recall")).otherwise(F.col("precision") - 2.0 * F.col("fpr"))
    second = F.when(ok, F.col("precision")).otherwise(F.col("recall"))
    red = (
        table.join(F.broadcast(watch)).where(F.col("threshold") >= F.col("watch_threshold"))
        .withColumns({"met": ok, "_a": first, "_b": second})
        .orderBy(F.col("met").desc(), F.col("_a").desc(), F.col("_b").desc(), F.col("fpr"), "threshold")
        .limit(1)
    )
    return red.select(
        "watch_threshold", "watch_precision", "watch_recall", "watch_fallback",
        F.col("threshold").alias("red_threshold"), F.col("precision").alias("red_precision"),
        F.col("recall").alias("red_recall"), (~F.col("met")).alias("red_fallback"),
    )


# --- states -----------------------------------------------------------------------


def triage(
    df: DataFrame, score: str, watch: float, red: float, votes: str | None = None, precursors: str | None = None,
    min_votes: int = 2, min_precursors: int = 2,
) -> DataFrame:
    """GREEN / AMBER / RED. With votes and precursors RED needs both, and two
    precursors alone raise AMBER."""
    s = F.col(score)
    is_red, is_alert = s >= red, s >= watch
    if votes is not None:
        is_red = is_red & (F.col(votes) >= min_votes)
    if precursors is not None:
        is_red = is_red & (F.col(precursors) >= min_precursors)
        is_alert = is_alert | (F.col(precursors) >= 2)
    return df.withColumn("state", F.when(is_red, "RED").when(is_alert | is_red, "AMBER").otherwise("GREEN"))


def state_metrics(df: DataFrame, label: str) -> DataFrame:
    """Coverage, positive rate and share of all declines per state."""
    y = F.col(label).cast("long")
    per = df.groupBy("state").agg(F.count(F.lit(1)).alias("rows"), F.sum(y).alias("positives"))
    whole = per.agg(F.sum("rows").alias("_rows"), F.sum("positives").alias("_pos"))
    return per.join(F.broadcast(whole)).select(
        "state",
        "rows",
        (F.col("rows") / F.col("_rows")).alias("coverage"),
        (F.col("positives") / F.col("rows")).alias("positive_rate"),
        (1.0 - F.col("positives") / F.col("rows")).alias("npv"),
        (F.col("positives") / F.greatest(F.col("_pos"), F.lit(1))).alias("share_of_declines"),
    )


def selective_bounds(
    df: DataFrame, label: str, score: str, precision: float = 0.80, npv: float = 0.95, min_alerts: int = 3, min_quiet: int = 10
) -> tuple[float, float]:
    """Bounds between which no decision is taken, covering as many rows as the
    required precision above and NPV below allow."""
    his, los = even(0.20, 0.99, 160), even(0.01, 0.80, 160)
    upper = sweep(df, label, score, his).withColumn("n", F.col("tp") + F.col("fp"))
    hi_row = (
        upper.where((F.col("n") >= min_alerts) & (F.col("tp") / F.col("n") >= precision))
        .orderBy(F.col("n").desc(), "threshold").first()
    )
    y = F.col(label) == 1
    counted = df.select(y.alias("_y"), range_bucket(F.col(score), los, strict=True).alias("_r")).groupBy("_r").agg(
        F.count_if(F.col("_y")).alias("pos"), F.count_if(~F.col("_y")).alias("neg")
    )
    marks = _threshold_table(df, los).withColumn("_r", F.col("threshold_no"))
    up = Window.partitionBy().orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)
    lower = marks.join(counted, "_r", "left").na.fill(0, ["pos", "neg"]).withColumns(
        {"fn": F.sum("pos").over(up), "tn": F.sum("neg").over(up)}
    )
    n = F.col("fn") + F.col("tn")
    lo_row = lower.where((n >= min_quiet) & (F.col("tn") / n >= npv)).orderBy(n.desc(), "threshold").first()
    hi = hi_row["threshold"] if hi_row else 1.01
    lo = lo_row["threshold"] if lo_row else -0.01
    return (min(lo, hi - 0.01) if lo >= hi else lo), hi


def selective(df: DataFrame, score: str, lo: float, hi: float) -> DataFrame:
    s = F.col(score)
    return df.withColumn("state", F.when(s >= hi, "AMBER").when(s <= lo, "GREEN").otherwise("WATCH"))


def selective_metrics(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    y, s = F.col(label) == 1, F.col("state")
    n = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(s == "AMBER").alias("amber"),
        F.count_if(s == "GREEN").alias("green"),
        F.count_if(y & (s == "AMBER")).alias("amber_hits"),
        F.count_if(~y & (s == "GREEN")).alias("green_hits"),
        F.count_if(y).alias("positives"),
    )
    decided = F.col("amber") + F.col("green")
    return n.withColumns(
        {
            "coverage": decided / F.col("rows"),
            "decision_accuracy": (F.col("amber_hits") + F.col("green_hits")) / F.greatest(decided, F.lit(1)),
            "amber_precision": safe_ratio(F.col("amber_hits"), F.col("amber")),
            "green_npv": safe_ratio(F.col("green_hits"), F.col("green")),
            "amber_recall": F.col("amber_hits") / F.greatest(F.col("positives"), F.lit(1)),
        }
    )


def _past_counts(df: DataFrame, week: str, score: str, by: Sequence[str], weeks: int, sides: Mapping[str, tuple[Column, bool]]) -> DataFrame:
    """For each (by, week, score) and side (condition, above): earlier rows of
    the side with score >= (above) or <= the own one, and all of them, within
    the last `weeks` weeks and ever.

    Distinct scores are numbered, and the numbers' bits form a binary tree. A
    row is counted once per level, under its node and branch; a score takes,
    per level, the branch beside its own where that lies beyond it, and at the
    last level the rows of its own number. So rows are copied as often as the
    numbers have bits, counts per node and week are accumulated over the weeks,
    and neither rows nor scores are paired. NULL scores are left out. Columns:
    {side}_extreme, {side}_n, both also with _ever.
    """
    by = list(by)
    counts = {name: F.count_if(cond).alias(f"_{name}") for name, (cond, _) in sides.items()}
    cells = settle(df.where(F.col(score).isNotNull()).groupBy(*by, week, score).agg(*counts.values()))
    ranks = settle(running_totals(cells.select(score).distinct(), score, {"n": F.lit(1)}).select(score, (F.col("cum_n") - 1).alias("_rank")))
    bits = max(1, (ranks.count() - 1).bit_length())
    rank, own = F.col("_rank"), 2
    nodes = [F.struct(F.lit(i).alias("level"), F.shiftright(rank, bits - i).alias("node"), F.shiftright(rank, bits - 1 - i).bitwiseAND(F.lit(1)).cast("int").alias("branch")) for i in range(bits)]
    nodes.append(F.struct(F.lit(bits).alias("level"), rank.alias("node"), F.lit(own).alias("branch")))
    placed = cells.join(ranks, score).withColumn("_p", F.explode(F.array(*nodes))).select(*by, week, score, *[f"_{n}" for n in sides], "_p.*")
    at = [*by, "level", "node", week]
    beyond = {name: F.col("branch").isin(int(above), own) for name, (_, above) in sides.items()}
    sums = placed.groupBy(*at).agg(
        *[F.sum(F.when(beyond[n], F.col(f"_{n}")).otherwise(0)).alias(f"_x_{n}") for n in sides], *[F.sum(f"_{n}").alias(f"_t_{n}") for n in sides]
    )
    order = Window.partitionBy(*by, "level", "node").orderBy(F.unix_date(week))
    frames = {"": order.rangeBetween(-7 * weeks, -7), "_ever": order.rangeBetween(Window.unboundedPreceding, -7)}
    past = sums.select(*at, *[F.coalesce(F.sum(f"_{k}_{n}").over(f), F.lit(0)).alias(f"_{k}_{n}{w}") for k in "xt" for n in sides for w, f in frames.items()])
    takes = {name: F.col("branch").isin(int(not above), own) for name, (_, above) in sides.items()}
    found = placed.select(*at, score, "branch").join(past, at)
    return found.groupBy(*by, week, score).agg(
        *[F.sum(F.when(takes[n], F.col(f"_x_{n}{w}")).otherwise(0)).alias(f"{n}_extreme{w}") for n in sides for w in frames],
        *[F.max(F.when(F.col("level") == 0, F.col(f"_t_{n}{w}"))).alias(f"{n}_n{w}") for n in sides for w in frames],
    )


def conformal_state(
    df: DataFrame, entity: str, week: str, label: str, score: str, weeks: int = 104, min_entity: int = 30,
    min_negatives: int = 30, min_positives: int = 10,
    red_market: float = 0.05, red_entity: float = 0.10, green: float = 0.10,
) -> DataFrame:
    """p-values of each score against earlier negatives (all entities, and its
    own when it has enough) and earlier positives; states from their levels.

    The last `weeks` weeks calibrate (`calibration` = window); where they hold
    too few rows of either class, all earlier weeks do (all). Until these are
    enough the state is AMBER with NULL p-values (none), as for NULL scores;
    `require_calibration` makes that an error.
    """
    y = F.col(label) == 1
    whole = _past_counts(df, week, score, [], weeks, {"neg": (~y, True), "pos": (y, False)})
    own = _past_counts(df, week, score, [entity], weeks, {"own": (~y, True)})
    d = df.join(whole, [week, score], "left").join(own, [entity, week, score], "left")

    def enough(when: str) -> Column:
        return (F.col(f"neg_n{when}") >= min_negatives) & (F.col(f"pos_n{when}") >= min_positives)

    d = d.withColumn("calibration", F.when(enough(""), "window").when(enough("_ever"), "all").otherwise("none"))
    recent = F.col("calibration") == "window"

    def p(kind: str) -> Column:
        extreme, n = (F.when(recent, F.col(f"{kind}_{x}")).otherwise(F.col(f"{kind}_{x}_ever")) for x in ("extreme", "n"))
        return F.when(F.col("calibration") != "none", (1 + extreme) / (n + 1))

    own_n = F.when(recent, F.col("own_n")).otherwise(F.col("own_n_ever"))
    d = d.withColumns(
        {"p_market": p("neg"), "p_entity": F.when(own_n >= min_entity, p("own")).otherwise(p("neg")), "p_decline": p("pos")}
    ).drop(*[f"{k}_{x}{w}" for k in ("neg", "own", "pos") for x in ("extreme", "n") for w in ("", "_ever")])
    return d.withColumn("state", conformal_levels(red_market, red_entity, green))


def conformal_levels(red_market: float | Column, red_entity: float | Column, green: float | Column) -> Column:
    """RED, GREEN or AMBER from p_market, p_entity and p_decline."""
    is_red = (F.col("p_market") <= red_market) & (F.col("p_entity") <= red_entity)
    return F.when(is_red, "RED").when(F.col("p_decline") <= green, "GREEN").otherwise("AMBER")


def require_calibration(states: DataFrame, week: str, first: str, strict: bool = True) -> DataFrame:
    """`states` from `first` on; an error if any of these rows has no
    calibration. Without `strict` such rows stay, AMBER as they are."""
    checked = states.where(F.col(week) >= F.lit(first).cast("date"))
    if not strict:
        return checked
    short = checked.where("calibration = 'none'").agg(F.count(F.lit(1)).alias("n"), F.min(week).alias("w")).first()
    if short["n"]:
        raise ValueError(f"too little history to calibrate {short['n']} rows from {short['w']} on")
    return checked


# The levels that are tried.
RED_MARKET_LEVELS = (0.005, 0.0075, 0.01, 0.015, 0.02, 0.03, 0.05)
RED_ENTITY_LEVELS = (0.03, 0.05, 0.08, 0.10, 0.15, 0.20)
GREEN_LEVELS = (0.005, 0.01, 0.015, 0.02, 0.025, 0.03, 0.04, 0.05, 0.08, 0.10, 0.12, 0.15, 0.20, 0.25)


def conformal_alphas(
    states: DataFrame,
    label: str,
    red_precision: float,
    red_fpr: float,
    alert_recall: float,
    green_npv: float,
    min_red: int = 3,
    levels: tuple[Sequence[float], Sequence[float], Sequence[float]] = (RED_MARKET_LEVELS, RED_ENTITY_LEVELS, GREEN_LEVELS),
) -> DataFrame:
    """Every choice of the three levels with its figures, gates and `rank`.

    Each p-value is first reduced to the number of levels below it, so all rows
    become counts of a few hundred cells; the choices are sums over those. A
    choice passes if RED is precise, rarely wrong and not rare, RED and AMBER
    together find enough declines, and GREEN is safe. Passing ones come first,
    by RED recall, GREEN rows, RED precision and fewer AMBER rows; of the others
    those with more gates passed.
    """
    y = F.col(label) == 1

    def place(p: str, steps: Sequence[float]) -> Column:
        """Levels that lie below the p-value; NULL lies above all."""
        return F.when(F.col(p).isNull(), F.lit(len(steps))).otherwise(sum((F.col(p) > F.lit(s)).cast("int") for s in steps))

    cells = states.where(F.col(label).isNotNull()).select(
        place("p_market", levels[0]).alias("m"), place("p_entity", levels[1]).alias("e"), place("p_decline", levels[2]).alias("g"), y.cast("int").alias("y")
    ).groupBy("m", "e", "g", "y").agg(F.count(F.lit(1)).alias("n"))
    i, j, k = (F.explode(F.array(*[F.struct(F.lit(at).alias("at"), F.lit(float(v)).alias("level")) for at, v in enumerate(steps)])) for steps in levels)
    choices = cells.select("m", "e", "g", "y", "n", i.alias("i")).select("*", j.alias("j")).select("*", k.alias("k"))
    red = (F.col("m") <= F.col("i.at")) & (F.col("e") <= F.col("j.at"))
    green = ~red & (F.col("g") <= F.col("k.at"))

    def total(c: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(name)

    pos = F.col("y") == 1
    per = choices.groupBy(F.col("i.level").alias("red_market"), F.col("j.level").alias("red_entity"), F.col("k.level").alias("green")).agg(
        F.sum("n").alias("rows"), total(pos, "declines"), total(red, "red"), total(red & pos, "red_hits"), total(green, "green_rows"), total(green & pos, "green_misses")
    )
    none = F.lit(1)
    per = per.withColumns(
        {
            "amber": F.col("rows") - F.col("red") - F.col("green_rows"),
            "red_precision": F.col("red_hits") / F.greatest("red", none),
            "red_fpr": (F.col("red") - F.col("red_hits")) / F.greatest(F.col("rows") - F.col("declines"), none),
            "red_recall": F.col("red_hits") / F.greatest("declines", none),
            "alert_recall": (F.col("declines") - F.col("green_misses")) / F.greatest("declines", none),
            "green_npv": (F.col("green_rows") - F.col("green_misses")) / F.greatest("green_rows", none),
        }
    )
    gates = [
        F.col("red_precision") >= red_precision, F.col("red_fpr") <= red_fpr, F.col("alert_recall") >= alert_recall, F.col("green_npv") >= green_npv, F.col("red") >= min_red,
    ]
    per = per.withColumn("gates", sum(g.cast("int") for g in gates)).withColumn("passes", F.col("gates") == len(gates))
    last = [F.col(c) for c in ("red_market", "red_entity", "green")]
    order = Window.orderBy(
        F.col("gates").desc(), *[F.when(F.col("passes"), F.col(c)).desc_nulls_last() for c in ("red_recall", "green_rows", "red_precision")],
        F.when(F.col("passes"), F.col("amber")).asc_nulls_last(), *[F.col(c).desc() for c in ("red_precision", "alert_recall", "green_npv")], *last,
    )
    return per.withColumn("rank", F.row_number().over(order))  # a row per choice


def prior_shift_state(
    df: DataFrame, entity: str, week: str, label: str, probability: str, reference: float, watch: float, red: float
) -> DataFrame:
    """Probability moved to the base rate expected now, then thresholds. Only
    labels of earlier weeks enter, so all weeks are scored in one pass."""
    prior = local_prior(df, entity, week, label, reference)
    d = df.join(prior, [entity, week]).withColumn(
        "adjusted", odds_shift(F.col(probability), F.lit(reference), F.col("effective_prior"))
    )
    a = F.col("adjusted")
    # an unknown probability is watched
    state = F.when(a.isNull(), "AMBER").when(a >= red, "RED").when(a >= watch, "AMBER").otherwise("GREEN")
    return d.withColumn("state", state)


def percentile_policy(
    df: DataFrame, entity: str, day: str, score: str, static: float, budget: float = 0.30, lookback: int = 126, warmup: int = 20
) -> DataFrame:
    """A fixed threshold while history is short, afterwards the score's own
    past percentile against the alert budget."""
    s = Series(entity, day)
    d = df.withColumn("percentile", s.causal_percentile(score, lookback, warmup))
    ready = F.col("percentile").isNotNull()
    return d.withColumns(
        {
            "policy_mode": F.when(ready, "causal_percentile").otherwise("static"),
            "alert": F.when(ready, F.col("percentile") >= 1.0 - budget).otherwise(F.col(score) >= static),
        }
    )


def regime_flags(df: DataFrame) -> DataFrame:
    """Three reasons to alert, from merchant_mean, merchant_logreg,
    merchant_extra, merchant_disagreement and market_p90; `base` is any."""
    mean, logreg, extra = F.col("merchant_mean"), F.col("merchant_logreg"), F.col("merchant_extra")
    apart, market = F.col("merchant_disagreement"), F.col("market_p90")
    return df.withColumns(
        {
            "strong": (mean >= 0.70) & (extra >= 0.60),
            "quiet": (market <= 0.05) & (logreg >= 0.45) & (apart >= 0.10) & (mean >= 0.35),
            "market": (market >= 0.20) & (mean >= 0.35),
        }
    ).withColumn("base", F.col("strong") | F.col("quiet") | F.col("market"))


def confirm_policy(df: DataFrame, low: float, high: float, agree: float, market: float, apart_max: float) -> DataFrame:
    """High scores alert; marginal ones need agreeing models or the market."""
    mean = F.col("merchant_mean")
    is_high = mean >= high
    marginal = (mean >= low) & ~is_high
    models = (F.least("merchant_logreg", "merchant_extra") >= agree) & (F.col("merchant_disagreement") <= apart_max)
    outside = (F.col("market_p90") >= market) | (
        (F.col("market_mean") >= market * 0.60) & (F.col("precursor_share_2") >= 0.20)
    )
    return df.withColumns({"is_high": is_high, "marginal": marginal, "alert": is_high | (marginal & (models | outside))})


def _scope(name: Column) -> Column:
    """Where a veto may act."""
    return (
        F.when(name == "quiet", F.col("quiet") & ~F.col("strong") & ~F.col("market"))
        .when(name == "market", F.col("market") & ~F.col("strong"))
        .when(name == "nonstrong", ~F.col("strong"))
        .when(name == "none", F.lit(False))
        .otherwise(F.lit(True))
    )


def _rescue_scope(name: Column) -> Column:
    """Where a rescue may act."""
    return (
        F.when(name == "near", F.col("merchant_mean") >= 0.28)
        .when(name == "market", F.col("market_p90") >= 0.10)
        .when(name == "none", F.lit(False))
        .otherwise(F.lit(True))
    )


def veto_rescue(score: Column, rule: Mapping[str, Column]) -> Column:
    """Base alerts minus weak ones in the veto scope, plus strong non-alerts in
    the rescue scope. `rule`: veto_scope, veto_below, rescue_scope, rescue_from."""
    base = F.col("base")
    veto = base & _scope(rule["veto_scope"]) & (score < rule["veto_below"])
    rescue = ~base & _rescue_scope(rule["rescue_scope"]) & (score >= rule["rescue_from"])
    return (base & ~veto) | rescue


def consensus_veto(df: DataFrame, scope: str, views: Mapping[str, float], ratio: str, ratio_min: float) -> DataFrame:
    """Drop base alerts that every view finds weak."""
    weak = F.col(ratio) > ratio_min
    for col, limit in views.items():
        weak = weak & (F.col(col) < limit)
    return df.withColumn("alert", F.col("base") & ~(_scope(F.lit(scope)) & weak))


NO_RULE = ("none", 0.0, "none", 1.01)


def prequential_rules(
    df: DataFrame, label: str, fold: str, score: str, rules: Sequence[tuple[str, float, str, float]],
    recall_slack: float = 0.02, npv_slack: float = 0.005, rate_slack: float = 0.01,
) -> tuple[DataFrame, DataFrame]:
    """For each fold the rule that did best on the folds before it, if it was
    not worse than the base policy; the first fold keeps the base.

    Rules are a short list, unrolled per row and counted at once; folds and
    rules together leave a small table. Returns (decisions, chosen rules).
    """
    numbered = [(i, *r) for i, r in enumerate([NO_RULE, *rules])]
    fields = ("rule_no", "veto_scope", "veto_below", "rescue_scope", "rescue_from")
    table = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(fields, r)]) for r in numbered])
    unrolled = df.withColumn("_rule", F.explode(table))
    rule = {n: F.col("_rule")[n] for n in fields}
    judged = unrolled.withColumn("_alert", veto_rescue(F.col(score), rule))
    per = judged.groupBy(rule["rule_no"].alias("rule_no"), fold).agg(*confusion(label, F.col("_alert")))
    before = Window.partitionBy("rule_no").orderBy(fold).rowsBetween(Window.unboundedPreceding, -1)
    past = per.select("rule_no", fold, *[F.sum(c).over(before).alias(c) for c in ("tp", "fp", "fn", "tn")])
    past = settle(past.where("tp is not null").withColumns(rates()))
    base = past.where("rule_no = 0").select(
        fold, *[F.col(c).alias(f"b_{c}") for c in ("recall", "npv", "alert_rate", "fp", "f1")]
    )
    ok = (
        (F.col("recall") >= F.col("b_recall") - recall_slack)
        & (F.col("npv") >= F.col("b_npv") - npv_slack)
        & (F.col("alert_rate") <= F.col("b_alert_rate") + rate_slack)
        & (F.col("fp") <= F.col("b_fp"))
        & (F.col("f1") >= F.col("b_f1"))
    )
    best = Window.partitionBy(fold).orderBy(
        F.col("ok").desc(), F.col("f1").desc(), F.col("precision").desc(), F.col("fp"), F.col("recall").desc(), F.col("rule_no")
    )
    chosen = (
        past.join(base, fold).withColumn("ok", ok).withColumn("_r", F.row_number().over(best)).where("_r = 1")
        .select(fold, F.when(F.col("ok"), F.col("rule_no")).otherwise(0).alias("rule_no"), F.col("ok").alias("history_feasible"))
    )
    # one row per fold
    with_rule = df.join(F.broadcast(chosen), fold, "left").withColumn("rule_no", F.coalesce("rule_no", F.lit(0)))
    with_rule = with_rule.withColumn("_rule", F.element_at(table, F.col("rule_no") + 1))
    decided = with_rule.withColumn("alert", veto_rescue(F.col(score), {n: F.col("_rule")[n] for n in fields}))
    return decided.drop("_rule", "history_feasible"), chosen


def alert_verifier(
    df: DataFrame, label: str, fold: str, probability: str, views: Mapping[str, float], scope: str = "nonstrong",
    quantile: float = 0.10, margin: float = 0.02, min_alerts: int = 20,
) -> DataFrame:
    """Veto base alerts that look weaker than past true alerts.

    The limit for a fold is a low quantile of the true alerts of all folds
    before it. Alerts are carried to the later folds they inform; folds are few.
    """
    folds = df.agg(F.max(fold).alias("_last"))
    past = (
        df.where(F.col("base")).join(F.broadcast(folds)).where(F.col(fold) < F.col("_last"))
        .select(F.explode(F.sequence(F.col(fold) + 1, F.col("_last"))).alias(fold), F.col(label).alias("_y"), F.col(probability).alias("_p"))
    )
    counts = past.groupBy(fold).agg(F.count(F.lit(1)).alias("_alerts"), F.sum("_y").alias("_hits"))
    true_alerts = exact_quantiles(past.where("_y = 1"), "_p", [quantile], [fold])
    name = [c for c in true_alerts.columns if c.startswith("q")][0]
    limits = counts.join(true_alerts.select(fold, F.col(name).alias("_q")), fold, "left").select(
        fold,
        F.when(
            (F.col("_alerts") >= min_alerts) & (F.col("_hits") > 0) & (F.col("_hits") < F.col("_alerts")),
            F.greatest(F.lit(0.0), F.col("_q") - margin),
        ).alias("limit"),
    )
    d = df.join(F.broadcast(limits), fold, "left")
    weak = F.col(probability) < F.col("limit")
    for col, guard in views.items():
        weak = weak & (F.col(col) < guard)
    veto = F.coalesce(F.col("base") & _scope(F.lit(scope)) & weak, F.lit(False))
    return d.withColumn("veto", veto).withColumn("alert", F.col("base") & ~F.col("veto"))


def frontier(df: DataFrame, label: str, score: str) -> DataFrame:
    """Best precision at recall >= 0.8, best recall at precision >= 0.8 and
    best F1 over every threshold; ties go to the lowest threshold."""
    y = F.col(label).cast("long")
    grid = df.sparkSession.createDataFrame([(float(v),) for v in even(0.0, 1.0, 501)], f"{score} double")
    rows = df.select(F.col(score).cast("double").alias(score), y.alias("_p"), (1 - y).alias("_n"))
    rows = rows.unionByName(grid.withColumns({"_p": F.lit(0).cast("long"), "_n": F.lit(0).cast("long")}))
    t = running_totals(rows, score, {"pos": F.col("_p"), "neg": F.col("_n")}, descending=True)
    t = t.select(
        F.col(score).alias("threshold"), F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"),
        (F.col("total_pos") - F.col("cum_pos")).alias("fn"), (F.col("total_neg") - F.col("cum_neg")).alias("tn"),
    ).withColumns(rates())
    found = F.struct("precision", "recall", "f1", "threshold")

    def best(name: str, measure: str, where: Column | None) -> Column:
        value = F.when(where & (F.col(measure) > 0), F.struct(F.col(measure), -F.col("threshold"))) if where is not None else F.struct(
            F.col(measure), -F.col("threshold")
        )
        return F.max_by(found, value).alias(name)

    wide = t.agg(
        best("precision_at_recall_80", "precision", F.col("recall") >= 0.80),
        best("recall_at_precision_80", "recall", F.col("precision") >= 0.80),
        best("best_f1", "f1", None),
    )
    names = ("precision_at_recall_80", "recall_at_precision_80", "best_f1")
    one = wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("point"), F.col(n).alias("v")) for n in names])).alias("e"))
    return one.select(F.col("e.point").alias("point"), "e.v.precision", "e.v.recall", "e.v.f1", "e.v.threshold").where("threshold is not null")


BOOTSTRAP_METRICS = ("precision", "recall", "f1", "npv", "alert_rate", "roc_auc", "pr_auc")


def resampled_metrics(s: np.ndarray, p: np.ndarray, a: np.ndarray, w: np.ndarray) -> np.ndarray:
    """BOOTSTRAP_METRICS of weighted cells (score ascending, label, alert); NaN where undefined for the areas."""

    def share(top: float, bottom: float, empty: float = 0.0) -> float:
        return float(top / bottom) if bottom else empty

    tp, fp, fn, tn = (float(w[m].sum()) for m in (p & a, ~p & a, p & ~a, ~p & ~a))
    _, place = np.unique(s, return_inverse=True)
    pos = np.bincount(place, np.where(p, w, 0))[::-1]  # per distinct score, high ones first
    neg = np.bincount(place, np.where(p, 0, w))[::-1]
    hits, seen = np.cumsum(pos), np.cumsum(pos + neg)
    above = float((neg * (hits - pos / 2)).sum())
    ap = float((pos * hits / np.maximum(seen, 1)).sum())
    return np.array(
        [share(tp, tp + fp), share(tp, tp + fn), share(2 * tp, 2 * tp + fp + fn), share(tn, tn + fn), share(tp + fp, tp + fp + fn + tn),
         share(above, pos.sum() * neg.sum(), np.nan), share(ap, pos.sum(), np.nan)]
    )


def bootstrap_ci(df: DataFrame, label: str, score: str, alert: Column, replicates: int = 2000, seed: int = 20240817, ranges: int = 512) -> DataFrame:
    """95% intervals of five rates and of both areas from resampled rows.

    A resampled row has a Poisson(1) weight, and equal rows are drawn together:
    the sum of their weights is Poisson with their number. Rows are counted by
    (score, label, alert), scores beyond `ranges` distinct ones by range (within
    which all tie); these cells, at most 4 x `ranges`, go to the tasks that
    share the replicates. A replicate draws one count per cell, from its own
    number alone, so the cost does not grow with the rows and the draws repeat
    on any partitioning. Rows without label or score are left out.
    """
    spark = df.sparkSession
    known = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    cell = F.col(score).cast("double")
    if known.select(score).distinct().limit(ranges + 1).count() > ranges:
        cell = range_bucket(F.col(score), cut_points(known, score, ranges)).cast("double")
    counted = known.groupBy(cell.alias("s"), (F.col(label) == 1).alias("p"), F.coalesce(alert, F.lit(False)).alias("a")).agg(F.count(F.lit(1)).alias("n"))
    cells = spark.sparkContext.broadcast(np.array(sorted(map(tuple, counted.collect())), float).reshape(-1, 4))

    def draw(batches):
        s, p, a, n = cells.value.T
        for batch in batches:
            numbers = batch["id"].tolist()
            rows = [resampled_metrics(s, p > 0, a > 0, np.random.Generator(np.random.Philox([seed, b])).poisson(n)) for b in numbers]
            yield pd.DataFrame(np.array(rows).reshape(-1, len(BOOTSTRAP_METRICS)), columns=list(BOOTSTRAP_METRICS))

    shape = ", ".join(f"{m} double" for m in BOOTSTRAP_METRICS)
    long = spark.range(replicates).mapInPandas(draw, shape).unpivot([], list(BOOTSTRAP_METRICS), "metric", "value")
    long = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return long.groupBy("metric").agg(
        F.percentile("value", F.lit(0.025)).alias("low"), F.percentile("value", F.lit(0.975)).alias("high"), F.count("value").alias("n")
    )


# --- folds, gates, comparisons ------------------------------------------------------


def purged_folds(df: DataFrame, day: str, windows: Sequence[tuple[int, str, str]], horizon: int = 7) -> DataFrame:
    """Each row once per fold it serves, with `role` train or validate.

    Training stops horizon + 1 days before the window opens. Windows are a
    short list, unrolled per row.
    """
    d = F.col(day)
    options = []
    for fid, start, end in windows:
        s, e = F.lit(start).cast("date"), F.lit(end).cast("date")
        role = F.when(d <= F.date_sub(s, horizon + 1), "train").when(d.between(s, e), "validate")
        options.append(F.when(role.isNotNull(), F.struct(F.lit(fid).alias("fold_id"), role.alias("role"))))
    served = F.filter(F.array(*options), lambda x: x.isNotNull())
    return df.drop("fold_id").withColumn("_f", F.explode(served)).withColumns(
        {"fold_id": F.col("_f.fold_id"), "role": F.col("_f.role")}
    ).drop("_f")


def fold_checks(folds: DataFrame, label: str, min_train: int = 100, min_validate: int = 35) -> DataFrame:
    """Sizes and classes of each fold."""
    t, v = F.col("role") == "train", F.col("role") == "validate"
    y = F.col(label)
    out = folds.groupBy("fold_id").agg(
        F.count_if(t).alias("train_rows"),
        F.count_if(v).alias("validate_rows"),
        F.countDistinct(F.when(t, y)).alias("_tc"),
        F.countDistinct(F.when(v, y)).alias("_vc"),
    )
    ok = (F.col("train_rows") >= min_train) & (F.col("validate_rows") >= min_validate) & (F.col("_tc") == 2) & (F.col("_vc") == 2)
    return out.withColumn("valid", ok).drop("_tc", "_vc")


def fold_overlap_audit(folds: DataFrame, day: str, keys: Sequence[str], min_gap: int = 8) -> DataFrame:
    """Rows used on both sides of a fold and the days between the sides."""
    both = folds.groupBy("fold_id", *keys).agg(F.countDistinct("role").alias("_r")).where("_r > 1")
    shared = both.groupBy("fold_id").agg(F.count(F.lit(1)).alias("_shared"))
    edges = folds.groupBy("fold_id").agg(
        F.max(F.when(F.col("role") == "train", F.col(day))).alias("train_end"),
        F.min(F.when(F.col("role") == "validate", F.col(day))).alias("validate_start"),
    )
    out = edges.join(shared, "fold_id", "left").withColumns(
        {"shared_rows": F.coalesce("_shared", F.lit(0)), "gap_days": F.datediff("validate_start", "train_end")}
    ).drop("_shared")
    return out.withColumn("passed", (F.col("shared_rows") == 0) & (F.col("gap_days") >= min_gap))


def source_gate(
    panel: DataFrame, entity: str, week: str, values: Sequence[str], expected: Sequence[str], min_weeks: int = 104,
    features: Sequence[str] = (),
) -> DataFrame:
    """One row: may the newest week be scored? Fails closed as NO_DECISION /
    AMBER with the first reason found."""
    missing = [c for c in (entity, week, *values, *features) if c not in panel.columns]
    spark = panel.sparkSession
    if missing:
        reason = f"MISSING_SOURCE_COLUMNS:{sorted(missing)}"
        return spark.createDataFrame([("NO_DECISION", "AMBER", reason)], "status string, state string, reason string")
    latest = panel.agg(F.max(week).alias("_latest"))
    d = panel.join(F.broadcast(latest)).withColumn("_now", F.col(week) == F.col("_latest"))
    bad_value = F.lit(False)
    for v in values:
        bad_value = bad_value | F.coalesce(F.col(v) <= 0, F.lit(True))
    bad_feature = F.lit(False)
    for f in features:
        bad_feature = bad_feature | F.col(f).isNull()
    per = d.groupBy(entity, week).agg(
        F.count(F.lit(1)).alias("_n"), F.max("_now").alias("_now"), F.max(bad_value).alias("_bv"), F.max(bad_feature).alias("_bf")
    )
    ent = per.groupBy(entity).agg(
        F.count(F.lit(1)).alias("_weeks"), F.max(F.col("_n")).alias("_n"), F.max("_now").alias("_now"),
        F.max(F.col("_now") & F.col("_bv")).alias("_bv"), F.max(F.col("_now") & F.col("_bf")).alias("_bf"),
    )
    known = ent.withColumn("_exp", F.col(entity).isin(*expected))
    s = known.agg(
        F.max("_n").alias("n"),
        F.min(F.when(F.col("_now"), F.col("_weeks"))).alias("weeks"),
        F.count_if(F.col("_now") & F.col("_exp")).alias("present"),
        F.count_if(F.col("_now") & ~F.col("_exp")).alias("unexpected"),
        F.max(F.col("_bv")).alias("bv"),
        F.max(F.col("_bf")).alias("bf"),
    )
    reason = (
        F.when(F.coalesce(F.col("n"), F.lit(0)) == 0, "EMPTY_SOURCE")
        .when(F.col("n") > 1, "DUPLICATE_ENTITY_WEEK")
        .when((F.col("present") != len(set(expected))) | (F.col("unexpected") > 0), "ENTITY_CONTRACT_MISMATCH")
        .when(F.col("weeks") < min_weeks, f"INSUFFICIENT_HISTORY_LT_{min_weeks}_WEEKS")
        .when(F.col("bv"), "NONPOSITIVE_LATEST_SOURCE")
        .when(F.col("bf"), "NULL_LATEST_FEATURES")
    )
    return s.select(
        F.when(reason.isNull(), "OK").otherwise("NO_DECISION").alias("status"),
        F.when(reason.isNotNull(), "AMBER").alias("state"),
        reason.alias("reason"),
    )


def future_difference(features: DataFrame, without_future: DataFrame) -> DataFrame:
    """Rows that differ when the future is cut off or altered; must be empty."""
    return features.exceptAll(without_future).unionByName(without_future.exceptAll(features))


def blend_weights(n: int, units: int = 4) -> list[tuple[float, ...]]:
    """All convex weights in steps of 1 / units."""
    if n == 1:
        return [(1.0,)]

    def fill(left: int, slots: int):
        if slots == 1:
            yield (left,)
            return
        for u in range(left + 1):
            for rest in fill(left - u, slots - 1):
                yield (u, *rest)

    return [tuple(u / units for u in w) for w in fill(units, n)]


def blends(df: DataFrame, scores: Sequence[str], units: int = 4) -> DataFrame:
    """Every convex blend of the score columns, one row per blend."""
    options = []
    for i, weights in enumerate(blend_weights(len(scores), units)):
        total = F.lit(0.0)
        for w, c in zip(weights, scores):
            total = total + F.lit(w) * F.col(c)
        options.append(F.struct(F.lit(i).alias("blend_no"), total.alias("blend_score")))
    return df.withColumn("_b", F.explode(F.array(*options))).withColumns(
        {"blend_no": F.col("_b.blend_no"), "blend_score": F.col("_b.blend_score")}
    ).drop("_b")


def consensus(df: DataFrame, scores: Sequence[str], vote_from: float = 0.5) -> DataFrame:
    """Mean, median, votes and disagreement of the score columns."""
    arr = F.array(*[F.col(c).cast("double") for c in scores])
    ordered = F.array_sort(arr)
    n = len(scores)
    middle = F.element_at(ordered, n // 2 + 1) if n % 2 else (
        F.element_at(ordered, n // 2) + F.element_at(ordered, n // 2 + 1)
    ) / 2.0
    mean = F.aggregate(arr, F.lit(0.0), lambda a, x: a + x) / F.lit(float(n))
    return df.withColumns(
        {
            "mean_score": mean,
            "median_score": middle,
            "votes": F.size(F.filter(arr, lambda x: x >= vote_from)),
            "disagreement": F.array_max(arr) - F.array_min(arr),
        }
    )


def not_worse_than(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """Does the candidate keep recall, NPV and the worst fold, raise precision
    and F1, cut false alerts and not alert more often? One-row inputs."""
    names = ("recall", "npv", "precision", "f1", "fp", "worst_fold_recall", "alert_rate")
    b = base.select(*[F.col(n).alias(f"b_{n}") for n in names])
    d = candidate.select(*names).join(F.broadcast(b))
    ok = (
        (F.col("recall") >= F.col("b_recall"))
        & (F.col("npv") >= F.col("b_npv"))
        & (F.col("precision") > F.col("b_precision"))
        & (F.col("f1") > F.col("b_f1"))
        & (F.col("fp") < F.col("b_fp"))
        & (F.col("worst_fold_recall") >= F.col("b_worst_fold_recall"))
        & (F.col("alert_rate") <= F.col("b_alert_rate"))
    )
    return d.withColumn("passed", ok)


def incremental_watch(
    df: DataFrame, label: str, base: Column, signals: str, score: str, min_signals: int, score_floor: float,
    ratio: str, ratio_max: float, evidence: str, min_evidence: int,
) -> DataFrame:
    """What structural and forecast branches add to a base alert: metrics of
    the union and the alert rate they add among quiet negatives."""
    structural = (F.col(signals) >= min_signals) & (F.col(score) >= score_floor)
    falling = (F.col(ratio) <= ratio_max) & (F.col(evidence) >= min_evidence)
    d = df.withColumns({"_base": base, "_alert": base | structural | falling, "_added": (structural | falling) & ~base})
    neg = F.col(label) == 0
    out = d.agg(
        *confusion(label, F.col("_alert")),
        F.count_if(F.col("_added")).alias("added_alerts"),
        F.count_if(F.col("_added") & neg).alias("_an"),
        F.count_if(~F.col("_base") & neg).alias("_qn"),
    ).withColumns(rates())
    return out.withColumn("added_rate_negatives", F.col("_an") / F.greatest(F.col("_qn"), F.lit(1))).drop("_an", "_qn")


def average_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """Rank of each row's value among all rows, equal values sharing their mean."""
    t = running_totals(df, value, {"n": F.lit(1)})
    return df.join(t.select(value, (F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2.0).alias(out)), value)


def ratio_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """MAE, RMSE, R2 and rank correlation."""
    d = average_rank(average_rank(df.select(actual, predicted), actual, "_ra"), predicted, "_rp")
    gap = F.col(actual) - F.col(predicted)
    return d.agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.abs(gap)).alias("mae"),
        F.sqrt(F.avg(gap * gap)).alias("rmse"),
        (1.0 - F.avg(gap * gap) / F.var_pop(actual)).alias("r2"),
        F.corr("_ra", "_rp").alias("spearman"),
    )


def replay(decisions: DataFrame, outcomes: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Decisions of every past origin with the outcome that came later.

    Features read only the past, so one pass over the panel gives the same
    decisions as standing at each origin; origins without outcome drop out.
    """
    return decisions.join(outcomes.where(F.col(label).isNotNull()).select(*keys, label), list(keys))


def signal_distribution(df: DataFrame, label: str, signals: str) -> DataFrame:
    return df.groupBy(label, signals).agg(F.count(F.lit(1)).alias("n"))


def signal_trade_off(
    df: DataFrame, label: str, score: str, signals: str, caps: Sequence[float] = (0.15, 0.25, 0.35, 0.50), max_signals: int = 3
) -> DataFrame:
    """For each cap on the alert rate the threshold and minimum signal count
    with the best recall, then precision."""
    grid = threshold_grid(df, score, [], even(0.02, 0.98, 60))
    d = df.withColumn("_k", F.least(F.col(signals), F.lit(max_signals)))
    per = sweep(d, label, score, grid, ["_k"])
    # rows with more signals also meet every smaller minimum
    served = per.withColumn("min_signals", F.explode(F.sequence(F.lit(0), F.col("_k"))))
    hits = served.groupBy("min_signals", "threshold").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))
    whole = d.agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_n"))
    table = hits.join(F.broadcast(whole)).withColumns(
        {"fn": F.col("_p") - F.col("tp"), "tn": F.col("_n") - F.col("fp")}
    ).withColumns(rates())
    options = F.array(*[F.lit(float(c)) for c in caps])
    capped = table.withColumn("alert_cap", F.explode(F.filter(options, lambda c: F.col("alert_rate") <= c)))
    best = Window.partitionBy("alert_cap").orderBy(
        F.col("recall").desc(), F.col("precision").desc(), F.col("threshold"), F.col("min_signals")
    )
    return capped.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(
        "alert_cap", "threshold", "min_signals", "recall", "precision", "alert_rate"
    )
