"""Streams run over the given tables to their end, compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbtide.plans import base
from ebbtide.plans.base import scores_sql
from ebbtide.plans.policy_queries import RATES, conf
from ebbtide.plans.registry import query
from ebbtide.session import work_folder
from ebbtide.streaming import streams


def events(t):
    return streams.read_folder(t.spark, t.folder, streams.EVENTS, "events.parquet")


@query(
    "ingest_stream",
    "event_id:i user_id:i event_type:s value:f4",
    "SELECT event_id, user_id, event_type, value FROM events",
)
def ingest_stream(t):
    twice = events(t).unionByName(events(t))
    return streams.ingest_to_table(twice, work_folder(t.spark, "ingest"), prefix=1)


@query(
    "daily_stream",
    "day:d total:f4 n:i",
    """WITH b AS (SELECT max(ts) - INTERVAL 1 DAY AS wm FROM events)
 SELECT CAST(ts AS DATE) AS day, sum(CAST(value AS DECIMAL(18,4))) AS total, count(*) AS n FROM events, b GROUP BY 1, wm HAVING CAST(ts AS DATE) + 1 <= wm""",
)
def daily_stream(t):
    return streams.run_to_table(streams.daily_stream(events(t)), work_folder(t.spark, "daily"))


@query(
    "sliding_change_stream",
    "start:d total:f4 n:i previous:f4 change:f",
    """WITH b AS (SELECT max(ts) - INTERVAL 1 DAY AS wm FROM events), e AS (SELECT CAST(ts AS DATE) - CAST(k AS INTEGER) AS start, value FROM events, (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS k)),
 w AS (SELECT start, sum(CAST(value AS DECIMAL(18,4))) AS total, count(*) AS n FROM e, b GROUP BY 1, wm HAVING start + 7 <= wm)
 SELECT w.start, w.total, w.n, p.total AS previous, CAST(w.total - p.total AS DOUBLE) / abs(CAST(p.total AS DOUBLE)) AS change FROM w LEFT JOIN w p ON p.start = w.start - 7""",
)
def sliding_change_stream(t):
    return streams.sliding_change_stream(events(t), work_folder(t.spark, "sliding"))


def score_files(t):
    """Scores as a folder a stream can read."""
    folder = work_folder(t.spark, "scores")
    base.scores(t).select("entity", "date", "score", "y").write.parquet(folder)
    return folder


_SCORES = "entity string, date date, score double, y int"


@query(
    "percentile_stream",
    "entity:s date:d percentile:f policy_mode:s alert:b",
    f"""WITH {scores_sql()}, n AS (SELECT entity, date, score, row_number() OVER (PARTITION BY entity ORDER BY date) AS i FROM scores),
 j AS (SELECT a.entity, a.date, a.score, count(b.i) AS n, CAST(sum(CASE WHEN b.score < a.score THEN 1 WHEN b.score = a.score THEN 0.5 ELSE 0 END) AS DOUBLE) AS s
   FROM n a LEFT JOIN n b ON a.entity = b.entity AND b.i BETWEEN a.i - 126 AND a.i - 1 GROUP BY 1, 2, 3),
 p AS (SELECT *, CASE WHEN n >= 20 THEN s / n END AS percentile FROM j)
 SELECT entity, date, percentile, CASE WHEN percentile IS NULL THEN 'static' ELSE 'causal_percentile' END AS policy_mode,
   CASE WHEN percentile IS NULL THEN score >= 0.55 ELSE percentile >= 0.7 END AS alert FROM p""",
)
def percentile_stream(t):
    from pyspark.sql import types as T

    folder = score_files(t)
    # the tables end here: a closing row lets the last days be scored too
    last = t.spark.read.schema(_SCORES).parquet(folder).agg(F.max("date").alias("date"))
    closing = last.select(F.date_add("date", streams.DELAY_DAYS + 1).alias("date"), F.lit(True).alias("closing"))
    closing.write.mode("append").parquet(folder)
    source = streams.read_folder(t.spark, folder, T.StructType.fromDDL(f"{_SCORES}, closing boolean"))
    return streams.run_to_table(streams.percentile_stream(source, 0.55), work_folder(t.spark, "percentile"))


@query(
    "delayed_label_stream",
    "entity:s scored_on:d score:f y:i",
    f"WITH {scores_sql()} SELECT entity, date AS scored_on, score, y FROM scores",
)
def delayed_label_stream(t):
    return matched(t).withColumn("scored_on", F.to_date("scored_at"))


def matched(t):
    from pyspark.sql import types as T

    folder, schema = score_files(t), T.StructType.fromDDL(_SCORES)
    left = streams.read_folder(t.spark, folder, schema).select("entity", F.col("date").cast("timestamp").alias("scored_at"), "score")
    right = streams.read_folder(t.spark, folder, schema).select(
        "entity", F.date_add("date", 7).cast("timestamp").alias("known_at"), "y"
    )
    return streams.run_to_table(streams.delayed_label_stream(left, right), work_folder(t.spark, "labels"))


@query(
    "running_metrics",
    "tp:i fp:i fn:i tn:i precision:f recall:f",
    f"WITH {scores_sql()}, c AS (SELECT {conf('score >= 0.55')} FROM scores) SELECT *, {RATES} FROM c",
)
def running_metrics(t):
    return streams.running_metrics(matched(t), 0.55)
