"""Audits, gates and profiles: each one aggregate over the data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.functions.scalars import safe_ratio
from ebbtide.operators.ordering import exact_quantiles, melt
from ebbtide.operators.windows import Series


def prevalence(df: DataFrame, day: str, unit: str, label: str, value: str) -> DataFrame:
    """Rows, positives, rate and the value's mean and std by month or year."""
    y = F.col(label).cast("double")
    return df.groupBy(F.trunc(day, unit).alias("period")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(y).alias("positives"),
        F.avg(y).alias("rate"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
    )


def latest_revision(df: DataFrame, key: Sequence[str], version: str, value: str) -> DataFrame:
    """The newest version per key and how far versions disagreed.

    The newest row is picked inside the aggregate, so a key with very many
    versions collapses before the shuffle.
    """
    rest = [c for c in df.columns if c not in key]
    out = df.groupBy(*key).agg(
        F.max_by(F.struct(*rest), F.struct(version, value)).alias("_row"),
        F.count(F.lit(1)).alias("versions"),
        F.min(value).alias("_lo"),
        F.max(value).alias("_hi"),
    )
    return out.select(
        *key,
        *[F.col("_row")[c].alias(c) for c in rest],
        "versions",
        safe_ratio(F.col("_hi") - F.col("_lo"), F.col("_hi")).alias("relative_spread"),
    )


def gap_histogram(df: DataFrame, entity: str, day: str) -> DataFrame:
    """How often each distance in days between neighbouring rows occurs."""
    s = Series(entity, day)
    steps = df.select(entity, day).distinct().withColumn("gap_days", F.datediff(F.col(day), s.lag(day, 1)))
    return steps.where("gap_days is not null").groupBy("gap_days").agg(F.count(F.lit(1)).alias("n"))


def continuity_audit(df: DataFrame, entity: str, day: str) -> DataFrame:
    """Largest gap, coverage per entity and whether all share one day set.

    Two day sets are equal when their counts and hash sums agree.
    """
    days = df.select(entity, day).distinct()
    s = Series(entity, day)
    gaps = days.withColumn("_gap", F.datediff(F.col(day), s.lag(day, 1)))
    mark = F.pmod(F.xxhash64(F.col(day).cast("string")), F.lit(1_000_000_007))
    per = gaps.groupBy(entity).agg(
        F.count(F.lit(1)).alias("_n"), F.max("_gap").alias("_gap"), F.sum(mark).alias("_mark")
    )
    coverage = per.agg(
        F.count(F.lit(1)).alias("entities"),
        F.max("_gap").alias("max_gap_days"),
        F.min("_n").alias("coverage_min"),
        F.max("_n").alias("coverage_max"),
        ((F.min("_n") == F.max("_n")) & (F.min("_mark") == F.max("_mark"))).alias("same_days"),
    )
    middle = exact_quantiles(per, "_n", [0.5]).select(F.col("q50").alias("coverage_median"))
    return coverage.join(F.broadcast(middle))


def profile_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls, distinct values and normalised entropy of each column.

    Columns are unpivoted and counted by value: one shuffle for all of them,
    pre-aggregated on the map side.
    """
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column", "value")
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    # sum n ln n gives the entropy without a second pass for the total
    stats = counts.groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("nulls"),
        F.count("value").alias("distinct_values"),
        F.count(F.lit(1)).alias("_k"),
        F.sum(F.col("n") * F.ln("n")).alias("_nln"),
    )
    entropy = F.ln("rows") - F.col("_nln") / F.col("rows")
    return stats.select(
        "column", "rows", "nulls", "distinct_values",
        F.when(F.col("_k") > 1, entropy / F.ln("_k")).otherwise(0.0).alias("entropy"),
    )


def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    return (
        df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), F.col("value"))
        .limit(n)
    )


def profile_table(df: DataFrame, day: Column, invoice: str, product: str, columns: Sequence[str]) -> DataFrame:
    """Whole-table figures with risk flags as an array."""
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.sum("_n").alias("rows"), F.sum(F.col("_n") - 1).alias("duplicate_rows")
    )
    nulls = df.agg(
        F.sum(sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))).alias("null_cells"),
        F.avg(day.isNotNull().cast("double")).alias("parse_rate"),
        F.min(day).alias("first_day"),
        F.max(day).alias("last_day"),
        F.countDistinct(day).alias("days"),
        F.countDistinct(invoice).alias("invoices"),
        F.countDistinct(product).alias("products"),
    )
    d = counted.join(F.broadcast(nulls))
    span = F.datediff("last_day", "first_day")
    flags = [
        F.when(F.col("rows") < 5000, "small_row_count"),
        F.when(F.col("days") < 180, "short_or_sparse_date_history"),
        F.when(span < 365, "less_than_one_year_history"),
        F.when(F.col("invoices") == F.col("rows"), "exactly_one_row_per_invoice"),
        F.when(F.col("duplicate_rows") == 0, "no_exact_duplicates"),
        F.when(F.col("null_cells") == 0, "no_nulls"),
        F.when(F.col("products") <= 20, "very_small_product_catalog"),
    ]
    return d.withColumn("flags", F.array_compact(F.array(*flags)))


def autocorrelation(df: DataFrame, day: str, value: str, lags: Sequence[int]) -> DataFrame:
    s = Series([], day)
    lagged = df.select(F.col(value).alias("_x"), *[s.lag(value, k).alias(f"_l{k}") for k in lags])
    wide = lagged.agg(*[F.corr(F.when(F.col(f"_l{k}").isNotNull(), F.col("_x")), F.col(f"_l{k}")).alias(str(k)) for k in lags])
    return wide.unpivot([], [str(k) for k in lags], "lag", "autocorrelation").withColumn("lag", F.col("lag").cast("int"))


def variance_explained(df: DataFrame, value: str, groups: Mapping[str, Column]) -> DataFrame:
    """Between-group share of the total variation for each grouping."""
    named = df.select(F.col(value).cast("double").alias("_x"), *[g.cast("string").alias(n) for n, g in groups.items()])
    long = named.unpivot(["_x"], list(groups), "grouping", "level")
    per = long.groupBy("grouping", "level").agg(
        F.count(F.lit(1)).alias("_n"), F.avg("_x").alias("_m"), F.sum(F.col("_x")).alias("_s"), F.var_pop("_x").alias("_v")
    )
    total = per.groupBy("grouping").agg((F.sum("_s") / F.sum("_n")).alias("_mu"))
    d = per.join(total, "grouping").withColumn("_b", F.col("_n") * F.pow(F.col("_m") - F.col("_mu"), 2))
    return d.groupBy("grouping").agg(
        safe_ratio(F.sum("_b"), F.sum("_b") + F.sum(F.col("_n") * F.col("_v"))).alias("explained")
    )


def entity_outcomes(scores: DataFrame, entity: str, label: str, score: str, watch: float, red: float) -> DataFrame:
    """State counts and score quantiles by class for each entity."""
    y, p = F.col(label) == 1, F.col(score)
    state = F.when(p >= red, "RED").when(p >= watch, "AMBER").otherwise("GREEN")
    d = scores.withColumn("_s", state)
    counts = d.groupBy(entity).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(y).alias("declines"),
        F.avg(y.cast("double")).alias("decline_rate"),
        *[F.count_if((F.col("_s") == s) & hit).alias(f"{s.lower()}_{tag}")
          for s, pairs in {"RED": (("tp", y), ("fp", ~y)), "AMBER": (("tp", y), ("fp", ~y)), "GREEN": (("fn", y), ("tn", ~y))}.items()
          for tag, hit in pairs],
        F.min(F.when(y, p)).alias("positive_min"),
    )
    neg = exact_quantiles(d.where(~y), score, [0.95, 0.99], [entity]).select(
        entity, F.col("q95").alias("negative_p95"), F.col("q99").alias("negative_p99")
    )
    pos = exact_quantiles(d.where(y), score, [0.5], [entity]).select(entity, F.col("q50").alias("positive_median"))
    return counts.join(neg, entity, "left").join(pos, entity, "left")


def external_gate(
    df: DataFrame, day: Column, transaction: Column, has_customer: bool, has_product: bool, by: Sequence[str] = (),
    min_span: int = 365, min_days: int = 300, min_transactions: int = 1000, max_missing: float = 0.10,
) -> DataFrame:
    """Is a merchant's file long and dense enough for a blind evaluation?

    One verdict row, or one per merchant with `by`.
    """
    by = list(by)
    known = F.when(F.trim(transaction.cast("string")) != "", F.trim(transaction.cast("string")))
    m = df.select(*by, day.alias("_d"), known.alias("_t")).groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col("_d").isNull()).alias("invalid_date_rows"),
        F.min("_d").alias("date_start"),
        F.max("_d").alias("date_end"),
        F.countDistinct("_d").alias("distinct_days"),
        F.countDistinct("_t").alias("transactions"),
    )
    m = m.withColumn("span_days", F.coalesce(F.datediff("date_end", "date_start") + 1, F.lit(0)))
    m = m.withColumn("missing_days", F.greatest(F.col("span_days") - F.col("distinct_days"), F.lit(0)))
    m = m.withColumn(
        "missing_ratio", F.when(F.col("span_days") > 0, F.col("missing_days") / F.col("span_days")).otherwise(1.0)
    )
    invalid = F.col("invalid_date_rows") / F.greatest(F.col("row_count"), F.lit(1))
    empty, unparsed = F.col("row_count") == 0, F.col("date_start").isNull()
    reasons = F.array_compact(
        F.array(
            F.when(F.col("span_days") < min_span, "insufficient_time_span"),
            F.when(F.col("distinct_days") < min_days, "insufficient_distinct_calendar_days"),
            F.when(F.col("transactions") < min_transactions, "insufficient_unique_transactions"),
            F.when(F.col("missing_ratio") > max_missing, "excessive_calendar_gaps"),
            F.when(invalid > 0.01, "too_many_invalid_dates"),
        )
    )
    m = m.withColumn(
        "reasons",
        F.when(empty, F.array(F.lit("dataset_has_no_rows")))
        .when(unparsed, F.array(F.lit("no_parseable_dates")))
        .otherwise(reasons),
    )
    warnings = F.array_compact(
        F.array(
            F.when((F.col("invalid_date_rows") > 0) & (invalid <= 0.01), "some_invalid_dates"),
            F.lit(None if has_customer else "missing_customer_identifier").cast("string"),
            F.lit(None if has_product else "missing_product_identifier").cast("string"),
            F.lit("provenance_and_freshness_must_be_verified_separately"),
        )
    )
    eligible = F.size("reasons") == 0
    return m.withColumns(
        {
            "warnings": warnings,
            "eligible": eligible,
            "grade": F.when(eligible, "ELIGIBLE_FOR_BLIND_EVALUATION").otherwise("REJECT"),
        }
    )


def panel_gate(df: DataFrame, entity: str, day: str, core: Sequence[str], bounds: Mapping[str, float]) -> DataFrame:
    """Named checks on a panel, one row each.

    `bounds`: entities, min_days, min_rows, max_zero_rate.
    """
    keys = df.groupBy(entity, day).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(sum((F.col(c).isNull().cast("int") for c in core), F.lit(0))).alias("_nulls"),
        F.sum("structural_zero").alias("_zero"),
    )
    s = keys.agg(
        F.sum("_n").alias("rows"),
        F.sum(F.col("_n") - 1).alias("duplicates"),
        F.sum("_nulls").alias("nulls"),
        F.countDistinct(entity).alias("entities"),
        F.countDistinct(day).alias("days"),
        (F.sum("_zero") / F.sum("_n")).alias("zero_rate"),
    )
    checks = {
        "expected_entities": F.col("entities") == int(bounds["entities"]),
        "enough_days": F.col("days") >= int(bounds["min_days"]),
        "enough_rows": F.col("rows") >= int(bounds["min_rows"]),
        "no_duplicates": F.col("duplicates") == 0,
        "no_core_nulls": F.col("nulls") == 0,
        "few_structural_zeros": F.col("zero_rate") < float(bounds["max_zero_rate"]),
    }
    return s.select(*[c.alias(n) for n, c in checks.items()]).unpivot([], list(checks), "check", "passed")


def drift(a: DataFrame, b: DataFrame, features: Sequence[str], bounds: DataFrame | None = None) -> DataFrame:
    """Standardised mean difference per feature, largest first; with `bounds`
    (feature, low, high) also the share of `b` at or beyond them."""
    both = melt(a.withColumn("_side", F.lit(0)), ["_side"], features).unionByName(
        melt(b.withColumn("_side", F.lit(1)), ["_side"], features)
    )
    side = F.col("_side")
    stats = [
        F.avg(F.when(side == 0, F.col("value"))).alias("mean_a"),
        F.avg(F.when(side == 1, F.col("value"))).alias("mean_b"),
        F.var_pop(F.when(side == 0, F.col("value"))).alias("_va"),
        F.var_pop(F.when(side == 1, F.col("value"))).alias("_vb"),
    ]
    if bounds is not None:
        # one row per feature name
        both = both.join(F.broadcast(bounds.select("feature", "low", "high")), "feature", "left")
        edge = (F.col("value") <= F.col("low") + 1e-12) | (F.col("value") >= F.col("high") - 1e-12)
        stats.append(F.avg(F.when(side == 1, F.coalesce(edge, F.lit(False)).cast("double"))).alias("edge_share"))
    d = both.groupBy("feature").agg(*stats)
    pooled = F.sqrt((F.col("_va") + F.col("_vb")) / 2.0)
    d = d.withColumn(
        "smd", F.when(pooled > 1e-12, (F.col("mean_b") - F.col("mean_a")) / pooled).otherwise(0.0)
    ).withColumn("abs_smd", F.abs("smd"))
    return d.drop("_va", "_vb").orderBy(F.col("abs_smd").desc(), F.col("feature"))


def ood_profile(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per feature q01 - 0.75 IQR .. q99 + 0.75 IQR."""
    q = exact_quantiles(melt(train, [], features), "value", [0.01, 0.25, 0.5, 0.75, 0.99], ["feature"])
    iqr = F.greatest(F.col("q75") - F.col("q25"), F.lit(1e-9))
    return q.select(
        "feature",
        F.col("q50").alias("median"),
        (F.col("q1") - 0.75 * iqr).alias("low"),
        (F.col("q99") + 0.75 * iqr).alias("high"),
    )


def ood_fraction(df: DataFrame, keys: Sequence[str], features: Sequence[str], profile: DataFrame) -> DataFrame:
    """Share of features outside their bounds or missing, per row.

    The profile has one row per feature name; it becomes a map on one row.
    """
    packed = profile.where(F.col("feature").isin(*features)).agg(
        F.map_from_entries(F.collect_list(F.struct("feature", F.struct("low", "high")))).alias("_p")
    )
    joined = df.join(F.broadcast(packed))
    bad = F.lit(0)
    for f in features:
        x, b = F.col(f).cast("double"), F.col("_p")[f]
        bad = bad + (x.isNull() | (x < b["low"]) | (x > b["high"])).cast("int")
    return joined.select(*keys, (bad / F.lit(float(max(len(features), 1)))).alias("ood_fraction"))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
