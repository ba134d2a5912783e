"""Continuous ingest and scoring with Structured Streaming."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ebbtide.functions.scalars import safe_ratio
from ebbtide.operators.policy import confusion, rates

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def read_folder(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet", files: int | None = None) -> DataFrame:
    """A Parquet folder as a stream; `files` limits the files per batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(folder)


def run_to_table(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Process everything available into a Parquet table and read it.

    The checkpoint beside the table makes a restart continue exactly where it
    stopped.
    """
    spark = stream.sparkSession
    started = (
        stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True).start(f"{folder}/table")
    )
    started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/table")


def with_hash(events: DataFrame) -> DataFrame:
    payload = F.to_json(F.struct(*sorted(events.columns)), {"ignoreNullFields": "false"})
    return events.withColumn("row_hash", F.sha2(payload, 256))


def ingest_stream(events: DataFrame, delay: str = "2 days", time: str = "ts") -> DataFrame:
    """Each row once: repeats of its hash inside the watermark are dropped.

    State holds hashes only as long as the watermark allows, and rows later
    than that are dropped; `ingest_to_table` has no such bound.
    """
    return with_hash(events).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(
        ["row_hash"]
    )


def ingest_to_table(events: DataFrame, folder: str, prefix: int = 2) -> DataFrame:
    """Ingest everything available into a table that holds each row once,
    however late a row or its repeat comes.

    Every batch writes a folder of its own number, cut by the first `prefix`
    digits of the row hash, so a batch that runs again replaces what it wrote.
    Its rows are held against the hashes of earlier batches; only the prefixes
    that the batch touches, and of them only the hash column, are read.
    """
    spark = events.sparkSession
    stream = with_hash(events)
    table = f"{folder}/table"
    shape = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType()), T.StructField("prefix", T.StringType())])

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.dropDuplicates(["row_hash"]).withColumn("prefix", F.left("row_hash", F.lit(prefix))).persist()
        try:
            touched = [r["prefix"] for r in rows.select("prefix").distinct().collect()]  # at most 16 ** prefix
            if number and touched:
                known = spark.read.schema(shape).option("basePath", table).parquet(f"{table}/batch=*")
                known = known.where(F.col("prefix").isin(touched) & (F.col("batch") < number)).select("prefix", "row_hash")
                fresh = rows.join(known, ["prefix", "row_hash"], "left_anti").select(rows.columns)
            else:
                fresh = rows
            fresh.write.mode("overwrite").partitionBy("prefix").parquet(f"{table}/batch={number}")
        finally:
            rows.unpersist()

    started = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    started.awaitTermination()
    return spark.read.schema(shape).option("basePath", table).parquet(f"{table}/batch=*").select(stream.columns)


def daily_stream(events: DataFrame, delay: str = "1 day", time: str = "ts", value: str = "value") -> DataFrame:
    """Closed days with sum, count and approximate users; rows later than the
    watermark are dropped."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return (
        timed.groupBy(F.window(time, "1 day"))
        .agg(
            F.sum(F.col(value).cast("decimal(18,4)")).alias("total"),
            F.count(F.lit(1)).alias("n"),
            F.approx_count_distinct("user_id").alias("users"),
        )
        .select(F.col("window.start").cast("date").alias("day"), "total", "n", "users")
    )


def sliding_stream(events: DataFrame, delay: str = "1 day", time: str = "ts", value: str = "value") -> DataFrame:
    """Sums of closed 7-day windows that start every day."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return (
        timed.groupBy(F.window(time, "7 days", "1 day"))
        .agg(F.sum(F.col(value).cast("decimal(18,4)")).alias("total"), F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").cast("date").alias("start"), "total", "n")
    )


def sliding_change_stream(events: DataFrame, folder: str, **kwargs) -> DataFrame:
    """Weekly sums with the change against the week before.

    Each batch of closed windows is written once under its batch number; the
    change is a join of the finished table with itself on the earlier date.
    """
    spark = events.sparkSession
    windows = sliding_stream(events, **kwargs)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table/batch={number}")

    started = (
        windows.writeStream.foreachBatch(write).outputMode("append")
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    started.awaitTermination()
    table = spark.read.schema(windows.schema).option("basePath", f"{folder}/table").parquet(f"{folder}/table")
    table = table.select("start", "total", "n")
    earlier = table.select(F.date_add("start", 7).alias("start"), F.col("total").alias("previous"))
    change = safe_ratio(F.col("total") - F.col("previous"), F.abs(F.col("previous")))
    return table.join(earlier, "start", "left").withColumn("change", change)


#: Scores of the look-back in date order, rows that wait (days since 1970 and scores), last day scored.
STATE = "past array<double>, days array<int>, waiting array<double>, last int"
SCORED = "entity string, date date, score double, percentile double, policy_mode string, alert boolean"
_DAY_MS = 86_400_000
#: Days that a score waits for rows of earlier dates.
DELAY_DAYS = 7


class _LookBack:
    """The last `size` scores, in order of arrival and sorted."""

    def __init__(self, past: list[float], size: int) -> None:
        self.size, self.past, self.ordered = size, deque(past), sorted(past)

    def percentile(self, score: float) -> float:
        """Share of scores below, equal ones by half."""
        low, high = bisect_left(self.ordered, score), bisect_right(self.ordered, score)
        return (low + high) / 2 / len(self.ordered)

    def add(self, score: float) -> None:
        if len(self.past) == self.size:
            del self.ordered[bisect_left(self.ordered, self.past.popleft())]
        self.past.append(score)
        insort(self.ordered, score)


def percentile_stream(
    scores: DataFrame,
    static: float,
    budget: float = 0.30,
    lookback: int = 126,
    warmup: int = 20,
    delay_days: int = DELAY_DAYS,
    grace_days: int = 3650,
    idle_days: int = 730,
) -> DataFrame:
    """Alert policy with only the last scores of each entity in state.

    Rows may come in any order within `delay_days`: they wait in state until
    the newest date of the stream is that far ahead, and are then scored by
    date. A row that comes after later ones of its entity were scored is
    returned with the mode `late`, without percentile or alert; Spark itself
    drops rows only `grace_days` later still. An entity without rows for
    `idle_days` is forgotten and begins anew. Rows without a score or date are
    left out.

    A source that ends may send a last row whose column `closing` is true,
    dated more than `delay_days` after its newest one: it only moves time on,
    so that no row stays in state unscored, and is not returned.
    """
    grace = grace_days * _DAY_MS

    def advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past, days, waiting, last = state.get if state.exists else ([], [], [], None)
        mark = state.getCurrentWatermarkMs()
        # the watermark lags by the grace as well; before the first one nothing is closed
        closed = (mark + grace) / _DAY_MS if mark > 0 else float("-inf")
        rows, out = list(zip(days, waiting, strict=True)), []
        for part in parts:
            for day, score, end in zip(part["day"].tolist(), part["score"].tolist(), part["closing"].tolist(), strict=True):
                if end:
                    continue
                if last is not None and day <= last:
                    out.append((day, score, None, "late", None))
                else:
                    rows.append((day, score))
        if not rows and not out and not state.exists:
            return  # closing rows alone
        rows.sort(key=lambda r: r[0])
        ready = bisect_left(rows, closed, key=lambda r: r[0])
        known = _LookBack(list(past), lookback)
        for day, score in rows[:ready]:
            pct = known.percentile(score) if len(known.past) >= warmup else None
            mode, alert = ("static", score >= static) if pct is None else ("causal_percentile", pct >= 1.0 - budget)
            out.append((day, score, pct, mode, alert))
            known.add(score)
            last = day
        rest = rows[ready:]
        if rest or last is None or last + idle_days >= closed:
            state.update((list(known.past), [d for d, _ in rest], [v for _, v in rest], last))
            wake = rest[0][0] if rest else (last or 0) + idle_days
            state.setTimeoutTimestamp(max(wake * _DAY_MS - grace + 1, mark + 1))
        elif state.exists:
            state.remove()
        if out:
            d, v, pct, mode, alert = zip(*out, strict=True)
            yield pd.DataFrame(
                {
                    "entity": key[0],
                    "date": (pd.to_datetime(list(d), unit="D")).date,
                    "score": v,
                    "percentile": pd.array(pct, "Float64"),
                    "policy_mode": mode,
                    "alert": pd.array(alert, "boolean"),
                }
            )

    rows = scores.select(
        "entity",
        F.unix_date("date").alias("day"),
        F.col("score").cast("double").alias("score"),
        F.col("date").cast("timestamp").alias("at"),
        (F.coalesce("closing", F.lit(False)) if "closing" in scores.columns else F.lit(False)).alias("closing"),
    ).where("day is not null and (score is not null or closing)")
    timed = rows.withWatermark("at", f"{delay_days + grace_days} days")
    return timed.groupBy("entity").applyInPandasWithState(advance, SCORED, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def delayed_label_stream(scores: DataFrame, outcomes: DataFrame, days: int = 7) -> DataFrame:
    """Match a score made at d with the label that becomes known at d + days.

    Both sides carry watermarks and the interval bounds how long scores wait.
    `scores`: entity, scored_at, score; `outcomes`: entity, known_at, y.
    """
    s = scores.withWatermark("scored_at", "2 days").alias("s")
    o = outcomes.withWatermark("known_at", "2 days").alias("o")
    on = (
        (F.col("s.entity") == F.col("o.entity"))
        & (F.col("o.known_at") >= F.col("s.scored_at") + F.expr(f"interval {days} days"))
        & (F.col("o.known_at") < F.col("s.scored_at") + F.expr(f"interval {days + 1} days"))
    )
    return s.join(o, on).select(
        F.col("s.entity").alias("entity"), F.col("s.scored_at").alias("scored_at"), F.col("s.score").alias("score"), F.col("o.y").alias("y")
    )


def running_metrics(matched: DataFrame, threshold: float) -> DataFrame:
    """Rates over everything matched so far, from the sink table."""
    return matched.agg(*confusion("y", F.col("score") >= threshold)).withColumns(rates())
