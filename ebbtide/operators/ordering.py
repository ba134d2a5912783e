"""Ordered work on unbounded groups: running totals, ranks, exact quantiles.

A plain window over all scores would sort one group in one task. Here rows
are first reduced to one row per distinct value, then cut into value ranges;
each range is accumulated on its own and shifted by the totals of the ranges
before it. The cut points are a fixed, small number of values, for each large
group its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.session import work_folder

BUCKETS = 64
MOST_BUCKETS = 256


def settle(df: DataFrame) -> DataFrame:
    """Write a reused frame once as a table in the shared checkpoint folder.

    Its inputs are not computed again for every use, later stages survive the
    loss of executors, and the optimizer learns the table's size.
    """
    path = work_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that one task should hold when it sorts or groups them.
TASK_ROWS = 500_000


def dealt(df: DataFrame, rows: int, *by: str | Column) -> DataFrame:
    """`df` dealt by `by` into so many partitions that each holds about
    TASK_ROWS of its `rows`, whatever the session shuffles into.

    Grouping by `by` then happens after the shuffle alone. That is meant for
    keys with few rows each, where partial sums save nothing and hold a row
    of memory per line.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
    return df.repartition(parts, *by)


def bucket_count(df: DataFrame) -> int:
    """As many ranges as the session shuffles into, within fixed limits."""
    return min(MOST_BUCKETS, max(BUCKETS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def cut_points(df: DataFrame, col: str, buckets: int) -> list[float]:
    """At most `buckets - 1` values that split the column about evenly.

    Only this short list reaches the driver; as literals the cuts stay the
    same when a task is retried.
    """
    probs = [i / buckets for i in range(1, buckets)]
    row = df.agg(F.percentile_approx(F.col(col).cast("double"), probs, 1000).alias("cuts")).first()
    return sorted(set(row["cuts"] or []))


#: A group with more distinct values than this is cut into ranges of its own.
GROUP_VALUES = 10_000
#: Lists of cuts are broadcast up to this number.
MOST_LARGE_GROUPS = 10_000


def own_ranges(reduced: DataFrame, value: str, by: Sequence[str], buckets: int, rows: int | None = None) -> DataFrame:
    """`reduced` (one row per group and value) with its `_range`, cut by each
    large group's own quantiles; groups of up to GROUP_VALUES values are one range.

    There are at most rows / GROUP_VALUES large groups, each with a short list
    of cuts.
    """
    probs = [i / buckets for i in range(1, buckets)]
    cuts = F.percentile_approx(F.col(value).cast("double"), probs, 1000).alias("_cuts")
    # with few groups in a task their quantiles are gathered without a sort
    spread = reduced if rows is None else dealt(reduced, rows, *by, F.pmod(F.hash(value), F.lit(16)))
    large = settle(spread.groupBy(*by).agg(F.count(value).alias("_values"), cuts).where(F.col("_values") > GROUP_VALUES))
    n = large.count()
    if not n:
        return reduced.withColumn("_range", F.lit(0))
    large = large.select(*[F.col(c).alias(f"_g_{c}") for c in by], "_cuts")
    on = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in by]
    joined = reduced.join(F.broadcast(large) if n <= MOST_LARGE_GROUPS else large, on, "left")
    at = range_bucket(F.col(value), [F.col("_cuts")[i] for i in range(buckets - 1)])
    return joined.withColumn("_range", F.when(F.col("_cuts").isNull(), 0).otherwise(at)).select(*reduced.columns, "_range")


def range_bucket(value: Column, cuts: Sequence[float | Column], strict: bool = False) -> Column:
    """How many cuts are <= value (< value when strict), as a balanced decision."""

    def pick(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        left = value <= cuts[mid] if strict else value < cuts[mid]
        return F.when(left, pick(lo, mid)).otherwise(pick(mid + 1, hi))

    return pick(0, len(cuts))


def running_totals(
    df: DataFrame,
    value: str,
    measures: dict[str, Column],
    by: Sequence[str] = (),
    descending: bool = False,
    cuts: Sequence[float] | None = None,
    rows: int | None = None,
) -> DataFrame:
    """One row per (by, value) with its measures, `cum_*` up to and including
    it in value order, and `total_*` of the group. `cuts` may be given when
    the distribution is known; `rows`, the length of `df`, where most values
    are distinct: it is then dealt by value."""
    by = list(by)
    keys = [*by, value]
    if rows is not None:
        df = dealt(df.withColumn("_cell", F.pmod(F.hash(value), F.lit(1024))), rows, *by, "_cell")
        keys = [*by, "_cell", value]
    reduced = df.groupBy(*keys).agg(*[F.sum(m).alias(n) for n, m in measures.items()])
    reduced = settle(reduced.drop("_cell"))
    if by and cuts is None:
        reduced = own_ranges(reduced, value, by, BUCKETS, rows)
    else:
        cuts = cut_points(reduced, value, bucket_count(df)) if cuts is None else cuts
        reduced = reduced.withColumn("_range", range_bucket(F.col(value), cuts))
    if rows is not None:
        reduced = dealt(reduced, rows, *by, "_range")
    order = F.col(value).desc() if descending else F.col(value).asc()
    inside = Window.partitionBy(*by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    part = reduced.groupBy(*by, "_range").agg(*[F.sum(n).alias(f"_p_{n}") for n in measures])
    range_order = F.col("_range").desc() if descending else F.col("_range").asc()
    # at most `buckets` rows per group from here on
    before = Window.partitionBy(*by).orderBy(range_order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    part = part.select(
        *by,
        "_range",
        *[F.coalesce(F.sum(f"_p_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in measures],
        *[F.sum(f"_p_{n}").over(whole).alias(f"total_{n}") for n in measures],
    )
    rows = reduced.withColumns({f"_in_{n}": F.sum(n).over(inside) for n in measures})
    joined = rows.join(part, [*by, "_range"])
    return joined.select(
        *by,
        value,
        *measures,
        *[(F.col(f"_in_{n}") + F.col(f"_before_{n}")).alias(f"cum_{n}") for n in measures],
        *[f"total_{n}" for n in measures],
    )


def quantile_name(q: float) -> str:
    """0.5 -> q50, 0.995 -> q99_5."""
    return "q" + f"{q * 100:g}".replace(".", "_")


def exact_quantiles(
    df: DataFrame, value: str, qs: Sequence[float], by: Sequence[str] = (), rows: int | None = None
) -> DataFrame:
    """Linear-interpolation quantiles per group, NULLs ignored.

    Works by rank on the distinct values, so no group's values are ever held
    together. Columns: by, n, q.. (see `quantile_name`). `rows` as in
    `running_totals`.
    """
    by = list(by)
    ranked = running_totals(df.where(F.col(value).isNotNull()), value, {"n": F.lit(1)}, by, rows=rows)
    picks = []
    for i, q in enumerate(qs):
        pos = F.lit(float(q)) * (F.col("total_n") - 1)
        for side, index in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (F.col("cum_n") - F.col("n") <= index) & (index < F.col("cum_n"))
            picks.append(F.max(F.when(hit, F.col(value).cast("double"))).alias(f"_{side}{i}"))
    out = ranked.groupBy(*by).agg(F.max("total_n").alias("n"), *picks)
    cols = []
    for i, q in enumerate(qs):
        pos = F.lit(float(q)) * (F.col("n") - 1)
        frac = pos - F.floor(pos)
        cols.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * frac).alias(quantile_name(q)))
    return out.select(*by, "n", *cols)


def quantile_grid(df: DataFrame, value: str, qs: Sequence[float]) -> list[float]:
    """Many exact quantiles of one column, returned as a short list.

    Each distinct value emits only the grid positions that fall on it.
    """
    ranked = running_totals(df.where(F.col(value).isNotNull()), value, {"n": F.lit(1)})
    grid = F.array(*[F.lit(float(q)) for q in qs])
    first, last = F.col("cum_n") - F.col("n"), F.col("cum_n")

    def hits(index) -> Column:
        return F.filter(grid, lambda q: (index(q * (F.col("total_n") - 1)) >= first) & (index(q * (F.col("total_n") - 1)) < last))

    x = F.col(value).cast("double")
    lo = ranked.select(F.explode(hits(F.floor)).alias("q"), x.alias("lo"), F.lit(None).cast("double").alias("hi"), "total_n")
    hi = ranked.select(F.explode(hits(F.ceil)).alias("q"), F.lit(None).cast("double").alias("lo"), x.alias("hi"), "total_n")
    pos = F.col("q") * (F.col("n") - 1)
    rows = (
        lo.unionByName(hi)
        .groupBy("q")
        .agg(F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.max("total_n").alias("n"))
        .select("q", (F.col("lo") + (F.col("hi") - F.col("lo")) * (pos - F.floor(pos))).alias("v"))
        .collect()
    )
    return sorted({r["v"] for r in rows})


def melt(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    """Wide to long."""
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(keys), list(columns), name, value
    )
