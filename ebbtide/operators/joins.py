"""Lookups, calendar joins, overlaps and alignment checks.

Small tables of a fixed size (windows, folds, rules, one-row aggregates) are
broadcast; every other join leaves the choice to the size-checked optimizer,
with adaptive skew handling for hot keys.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.functions.calendar import week_start_sunday
from ebbtide.functions.scalars import safe_ratio
from ebbtide.operators.ordering import dealt, settle
from ebbtide.operators.windows import Series


def star_join(sales: DataFrame, products: DataFrame, categories: DataFrame) -> DataFrame:
    """Sales with product and category; rows without a match drop out."""
    return sales.join(products, "product_id").join(categories, "category_id")


def duplicate_keys(dim: DataFrame, on: Sequence[str]) -> DataFrame:
    return dim.groupBy(*on).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def enrich(
    df: DataFrame, dim: DataFrame, on: Sequence[str], cardinality: str = "many_to_one"
) -> DataFrame:
    """Left join that refuses a right side with repeated keys.

    `one_to_one` also checks the left side. Each check is an aggregate with
    an early limit of one row.
    """
    if cardinality not in ("many_to_one", "one_to_one"):
        raise ValueError(f"unknown cardinality {cardinality}")
    sides = {"right": dim} if cardinality == "many_to_one" else {"right": dim, "left": df}
    for side, frame in sides.items():
        if duplicate_keys(frame, on).limit(1).count():
            raise ValueError(f"{side} side is not unique on {list(on)}")
    return df.join(dim, list(on), "left")


def prior_week_lookup(
    days: DataFrame, weekly: DataFrame, day: str, values: Sequence[str], by: Sequence[str] = (), weeks_back: int = 1
) -> DataFrame:
    """Values of the week that ended before the day's own Sunday week.

    NULL when that week is absent; the running week is never used.
    """
    current = week_start_sunday(F.col(day))
    left = days.withColumns({"week_start": current, "_origin": F.date_sub(current, 7 * weeks_back)})
    right = weekly.select(*by, F.col("week_start").alias("_origin"), *values)
    return left.join(right, [*by, "_origin"], "left").drop("_origin")


def forecast_origin_join(panel: DataFrame, forecasts: DataFrame, day: str, by: str) -> DataFrame:
    """Attach the forecast made at the last completed week.

    `forecasts` holds (origin_week, by, h1, h2): one and two weeks after the
    origin. The expected level of the next seven days takes h1 for days of
    the running week and h2 for days of the following one. Columns with
    observed outcomes are refused.
    """
    leaked = [c for c in forecasts.columns if c.startswith("actual_")]
    if leaked:
        raise ValueError(f"forecast table carries outcomes: {leaked}")
    week = week_start_sunday(F.col(day))
    left = panel.withColumn("_origin", F.date_sub(week, 7))
    right = forecasts.withColumnRenamed("origin_week", "_origin")
    # days d+1 .. d+7 that still lie in the running Sunday week
    same_week = (7 - F.dayofweek(F.col(day))).cast("double")
    return (
        left.join(right, ["_origin", by], "left")
        .withColumns(
            {
                "expected_next7": (same_week * F.col("h1") + (7.0 - same_week) * F.col("h2")) / 7.0,
                "expected_change": safe_ratio(F.col("h2"), F.col("h1")) - 1.0,
            }
        )
        .withColumnRenamed("_origin", "origin_week")
    )


def calendar_window_join(df: DataFrame, windows: DataFrame, day: str, span_days: int = 0) -> DataFrame:
    """Names of the windows touched by [day, day + span]; a window table has
    (name, start, end) and is a short calendar list.

    Each window is unrolled to its days, so the join is an equality on the
    date instead of a comparison of every row with every window.
    """
    unrolled = windows.select(
        F.col("name"),
        F.explode(F.sequence(F.date_sub("start", span_days), F.col("end"))).alias(day),
    ).groupBy(day).agg(F.array_sort(F.collect_set("name")).alias("window_names"))
    return df.join(unrolled, day, "left").withColumn("in_window", F.col("window_names").isNotNull().cast("int"))


def carry_forward_join(
    days: DataFrame, weekly: DataFrame, day: str, values: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Weekly values per day, gaps filled from the past, a leading gap from
    the first known value."""
    left = days.withColumn("week_start", week_start_sunday(F.col(day)))
    joined = left.join(weekly, [*by, "week_start"], "left")
    s = Series(list(by), day)
    whole = s.frame(-(2**31) + 1, 2**31 - 1)
    return joined.withColumns(
        {
            v: F.coalesce(s.forward_fill(v), F.first(F.col(v), ignorenulls=True).over(whole))
            for v in values
        }
    )


def unstable_keys(df: DataFrame, a: str, b: str) -> DataFrame:
    """Keys of `a` that go with more than one `b`."""
    pairs = df.select(a, b).distinct()
    return pairs.groupBy(a).agg(F.count(F.lit(1)).alias("targets")).where("targets > 1")


def stable_mapping(df: DataFrame, a: str, b: str) -> DataFrame:
    """The a -> b dimension; an error when it is not a function."""
    if unstable_keys(df, a, b).limit(1).count():
        raise ValueError(f"{a} does not determine {b}")
    return df.select(a, b).distinct()


def robust_entities(
    panel: DataFrame, entity: str, day: str, volume: str, min_days: int, min_volume: float
) -> DataFrame:
    """Entities with enough observed days and volume; apply before zero-filling."""
    return (
        panel.groupBy(entity)
        .agg(
            F.countDistinct(day).alias("observed_days"),
            F.sum(volume).alias("total_volume"),
        )
        .where((F.col("observed_days") >= min_days) & (F.col("total_volume") >= min_volume))
    )


def keep_keys(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key occurs in the key table."""
    return df.join(keys, keys.columns, "left_semi")


def align_scores(tables: Mapping[str, DataFrame], keys: Sequence[str], label: str = "y") -> DataFrame:
    """Several score tables side by side; they must hold the same keys with
    the same labels.

    Every table has keys, label and `score`. One grouped pass checks and
    pivots: a key is complete when each table contributes exactly one row.
    """
    names = sorted(tables)
    stacked = None
    for name in names:
        part = tables[name].select(*keys, label, "score", F.lit(name).alias("_table"))
        stacked = part if stacked is None else stacked.unionByName(part)
    joined = stacked.groupBy(*keys).agg(
        F.min(label).alias(label),
        F.max(label).alias("_label_max"),
        F.count(F.lit(1)).alias("_rows"),
        F.countDistinct("_table").alias("_tables"),
        *[F.max(F.when(F.col("_table") == n, F.col("score"))).alias(f"score_{n}") for n in names],
    )
    broken = (
        (F.col("_rows") != len(names))
        | (F.col("_tables") != len(names))
        | ~F.col(label).eqNullSafe(F.col("_label_max"))
    )
    if joined.where(broken).limit(1).count():
        raise ValueError("score tables differ in keys or labels")
    return joined.drop("_label_max", "_rows", "_tables")


def first_seen(tx: DataFrame, customer: str, day: str) -> DataFrame:
    """(customer, day) pairs with the customer's first date and new/returning.

    Lines collapse to customer-days first, so even one customer with a huge
    share of the lines is at most one row per day.
    """
    days = tx.where(F.col(customer).isNotNull()).groupBy(customer, day).agg(F.count(F.lit(1)).alias("lines"))
    s = Series(customer, day)
    return days.withColumn("first_date", F.min(day).over(s.frame(-(2**31) + 1, 0))).withColumn(
        "is_new", F.col(day) == F.col("first_date")
    )


def latest_run_for_scope(runs: DataFrame, data_end: Column, horizon: int, scope: Sequence[int] | None) -> DataFrame:
    """The newest completed run made for the same data end and branch scope.

    Without a scope only runs over all branches match: none recorded or "all".
    """
    recorded = F.get_json_object("filters_json", "$.branch_scope")
    if scope is None:
        fits = recorded.isNull() | (recorded == "all")
    else:
        fits = recorded == F.lit("[" + ",".join(str(b) for b in sorted(scope)) + "]")
    return (
        runs.where(
            (F.col("status") == "completed")
            & (F.col("data_end") == data_end)
            & (F.col("horizon_days") == horizon)
            & fits
        )
        .orderBy(F.col("completed_at").desc(), F.col("run_id").desc())
        .limit(1)
    )


def compare_periods(current: DataFrame, previous: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Keys of either period; a missing side counts as zero."""
    c = current.select(*key, F.col(value).alias("current"))
    p = previous.select(*key, F.col(value).alias("previous"))
    zero = F.lit(0)
    return c.join(p, list(key), "full_outer").withColumns(
        {
            "current": F.coalesce("current", zero),
            "previous": F.coalesce("previous", zero),
        }
    )


def set_overlap(
    members: DataFrame, group: Sequence[str], period: str, item: str, back: int = 4, step_days: int = 7
) -> DataFrame:
    """Items kept, new and dropped per group and period against the union of
    the `back` periods before.

    Of each item only the neighbouring memberships are compared: one counts as
    kept when the one before it is near enough, and stands in the history of
    the periods after it up to the next one. These counts, not the members,
    are added up per period; no group is joined with itself. Periods present
    in the data get a row each.
    """
    members = members.select(*group, F.col(period).cast("date").alias(period), item)
    members = settle(members.where(F.col(period).isNotNull()))
    rows = members.count()
    seen = dealt(members, rows, *group, period, item).distinct()
    # periods that are no whole number of steps apart never meet
    seen = seen.withColumn("_phase", F.pmod(F.datediff(period, F.lit("1970-01-01").cast("date")), F.lit(step_days)))
    w = Window.partitionBy(*group, item, "_phase").orderBy(period)
    seen = dealt(seen, rows, *group, item).withColumns({"_last": F.lag(period).over(w), "_next": F.lead(period).over(w)})
    kept = F.coalesce(F.datediff(period, "_last") <= back * step_days, F.lit(False))
    at = F.transform(F.sequence(F.lit(0), F.lit(back)), lambda i: F.date_add(F.col(period), i * step_days))
    spread = seen.select(*group, item, period, "_next", kept.alias("_kept"), F.explode(at).alias("_at"))
    spread = spread.where((F.col("_at") <= F.col("_next")) | F.col("_next").isNull())
    now = F.col("_at") == F.col(period)
    counts = spread.groupBy(*group, F.col("_at").alias("_period")).agg(
        F.sum(now.cast("int")).alias("current_items"),
        F.sum((~now).cast("int")).alias("previous_items"),
        F.sum((now & F.col("_kept")).cast("int")).alias("kept"),
    )
    counts = settle(
        counts.select(
            *group,
            F.col("_period").alias(period),
            "current_items",
            "previous_items",
            "kept",
            (F.col("current_items") - F.col("kept")).alias("new"),
            (F.col("previous_items") - F.col("kept")).alias("dropped"),
        )
    )
    present = counts.where("current_items > 0").select(period).distinct()
    return counts.join(present, period, "left_semi")


def reconcile(parts: DataFrame, total: DataFrame, period: str, value: str, tolerance: float = 1e-4) -> DataFrame:
    """Sum of the parts against the published total per period."""
    summed = parts.groupBy(period).agg(F.sum(value).alias("parts_sum"))
    gap = safe_ratio(F.abs(F.col("parts_sum") - F.col("published")), F.abs("published"))
    return (
        summed.join(total.select(period, F.col(value).alias("published")), period)
        .withColumn("relative_gap", gap)
        .withColumn("passed", F.col("relative_gap") < tolerance)
    )


def value_count_panel(
    long: DataFrame, keys: Sequence[str], kind: str, value: str, names: Mapping[str, str]
) -> DataFrame:
    """Rows of several kinds to one row per key; keys lacking a kind drop out."""
    wide = long.groupBy(*keys).agg(
        *[F.max(F.when(F.col(kind) == k, F.col(value))).alias(n) for k, n in names.items()]
    )
    return wide.na.drop(how="any", subset=list(names.values()))
