"""Explanation, gates, causality of features, scoring and streams."""

import os
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.functions.calendar import cyclic, next7_counts
from ebbtide.operators import evidence, explain, history, ml, mix, policy, quality
from ebbtide.operators.panels import complete_grid
from ebbtide.operators.windows import Series
from ebbtide.streaming import streams


def panel(spark, days=120):
    start = date(2023, 1, 1)
    rows = [
        (e, start + timedelta(days=i), 100.0 + 17 * ((i * 7 + k * 3) % 11) + (50.0 if i % 13 == k else 0.0), float(5 + (i + k) % 4))
        for k, e in enumerate(["a", "b", "c"])
        for i in range(days)
    ]
    return spark.createDataFrame(rows, "entity string, date date, gross double, lines double")


def test_recent_drop_is_sixty_percent(spark):
    start = date(2024, 1, 1)
    rows = []
    for i in range(14):
        qty, net = (5, 500.0) if i < 7 else (2, 200.0)
        for c in range(3 if i < 7 else 2):
            rows.append((start + timedelta(days=i), f"T{i}-{c}", "INV", f"C{c}", qty / (3 if i < 7 else 2), net / (3 if i < 7 else 2), 0.0, "Store", "Mug"))
    s = spark.createDataFrame(
        rows, "sale_date date, transaction_number string, transaction_type string, customer_key string, quantity double, net_sales double, discount_amount double, channel string, product_name string"
    )
    tagged = explain.with_period(s)
    drivers = explain.rank_drivers(explain.decline_signals(tagged)).collect()
    totals = {r["period"]: r for r in explain.period_totals(tagged).collect()}
    assert float(totals["current"]["sales"]) / float(totals["previous"]["sales"]) - 1 == pytest.approx(-0.6)
    assert {"quantity_decline", "channel_decline"} <= {d["code"] for d in drivers}
    assert sum(d["strength_pct"] for d in drivers) == pytest.approx(100, abs=0.2)
    assert [d["driver_rank"] for d in sorted(drivers, key=lambda d: -d["score"])] == list(range(1, len(drivers) + 1))
    texts = explain.driver_text(explain.rank_drivers(explain.decline_signals(tagged))).collect()
    assert all(t["summary"] and t["action"] for t in texts)


def test_external_gate(spark):
    def gate(days, per_day, gap=0):
        start = date(2023, 1, 1)
        rows = [((start + timedelta(days=i)).isoformat(), f"{i}-{j}") for i in range(days) if not (gap and i % gap) for j in range(per_day)]
        d = spark.createDataFrame(rows, "d string, t string")
        return quality.external_gate(d, F.to_date("d"), F.col("t"), True, True).first()

    good = gate(370, 3)
    assert good["eligible"] and good["grade"] == "ELIGIBLE_FOR_BLIND_EVALUATION"
    assert gate(30, 3)["reasons"] == ["insufficient_time_span", "insufficient_distinct_calendar_days", "insufficient_unique_transactions"]
    assert "excessive_calendar_gaps" in gate(400, 9, 2)["reasons"]


FEATURES = {
    "rolling": lambda d, s: d.withColumns(
        {
            "a": s.rolling("gross", 14), "b": s.zscore("gross", 28), "c": s.drawdown("gross", 28), "e": s.slope("gross", 7),
            "f": s.same_weekday_mean("gross"), "g": s.rolling("gross", 14, past=True), "h": s.quantile("gross", 13, 0.9, past=True, min_rows=6),
        }
    ),
    "percentile": lambda d, s: d.withColumn("p", s.causal_percentile("gross", 30, 10)),
    "calendar": lambda d, s: next7_counts(cyclic(d, "date"), "date", {"x": [("2023-02-01", "2023-02-09")]}),
    "fill": lambda d, s: d.withColumn("x", s.forward_fill(F.when(F.col("gross") > 200, F.col("gross")))),
    "evidence": lambda d, s: evidence.weekly_signals(d, "entity", "date", "gross", "lines"),
    "zscore": lambda d, s: history.panel_zscore(d, ["date"], "gross"),
    "breadth": lambda d, s: mix.breadth(d.withColumns({"r": s.ratio_to_mean("gross", 7), "c": s.change("gross", 7)}), "date", "r", "c"),
}


@pytest.mark.parametrize("name", sorted(FEATURES))
def test_features_ignore_the_future(spark, name):
    d, s = panel(spark), Series("entity", "date")
    origin = F.lit("2023-03-31").cast("date")
    build = FEATURES[name]
    full = build(d, s).where(F.col("date") <= origin)
    cut = build(d.where(F.col("date") <= origin), s)
    broken = build(d.withColumn("gross", F.when(F.col("date") > origin, F.lit(1e7)).otherwise(F.col("gross"))), s).where(F.col("date") <= origin)

    def rounded(x):
        return x.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in x.dtypes])

    assert policy.future_difference(rounded(full), rounded(cut)).count() == 0
    assert policy.future_difference(rounded(full), rounded(broken)).count() == 0


def test_labels_stay_empty_without_a_future(spark):
    d, s = panel(spark, 60), Series("entity", "date")
    r = d.withColumns({"r": s.forward_ratio("gross", 7), "n": s.next_ratio("gross"), "w": s.worst_of_next("gross", 4)})
    last = date(2023, 1, 1) + timedelta(days=59)
    assert r.where("r is not null").agg(F.max("date")).first()[0] == last - timedelta(days=7)
    assert r.where("n is not null").agg(F.max("date")).first()[0] == last - timedelta(days=1)
    assert r.where("w is not null").agg(F.max("date")).first()[0] == last - timedelta(days=4)


def test_backward_fill_reads_the_future(spark):
    d, s = panel(spark, 40), Series("entity", "date")
    full = d.withColumn("x", s.backward_fill(F.when(F.col("gross") > 230, F.col("gross")))).where("date <= date'2023-01-20'")
    cut = d.where("date <= date'2023-01-20'").withColumn("x", s.backward_fill(F.when(F.col("gross") > 230, F.col("gross"))))
    assert policy.future_difference(full, cut).count() > 0


def test_grid_marks_missing_cells(spark):
    d = spark.createDataFrame([("a", date(2024, 1, 1), 1.0), ("b", date(2024, 1, 3), 2.0)], "e string, d date, v double")
    got = complete_grid(d, "e", "d", ["v"]).collect()
    assert len(got) == 6 and sum(r["structural_zero"] for r in got) == 4 and sum(r["v"] for r in got) == 3.0


@pytest.mark.parametrize(
    "change, reason",
    [
        (lambda d: d, None),
        (lambda d: d.unionByName(d.limit(1)), "DUPLICATE_ENTITY_WEEK"),
        (lambda d: d.where("entity <> 'c'"), "ENTITY_CONTRACT_MISMATCH"),
        (lambda d: d.where("date >= date'2023-03-01'"), "INSUFFICIENT_HISTORY_LT_104_WEEKS"),
        (lambda d: d.withColumn("gross", F.when(F.col("date") < "2023-04-30", F.col("gross")).otherwise(0.0)), "NONPOSITIVE_LATEST_SOURCE"),
        (lambda d: d.drop("lines"), "MISSING_SOURCE_COLUMNS:['lines']"),
    ],
)
def test_source_gate_fails_closed(spark, change, reason):
    got = policy.source_gate(change(panel(spark)), "entity", "date", ["gross", "lines"], ["a", "b", "c"]).first()
    assert got["reason"] == reason
    assert (got["status"], got["state"]) == (("OK", None) if reason is None else ("NO_DECISION", "AMBER"))


def test_forest_score(spark):
    trees = spark.createDataFrame(
        [([0, -1, -1], [1.5, 0.0, 0.0], [1, -1, -1], [2, -1, -1], [0.0, 0.2, 0.8]), ([-1], [0.0], [-1], [-1], [0.4])],
        "feature array<int>, threshold array<double>, left array<int>, right array<int>, p1 array<double>",
    )
    d = spark.createDataFrame([(1.0,), (1.5,), (2.0,)], "x double")
    got = [r["score"] for r in ml.forest_score(d, trees, ["x"]).orderBy("x").collect()]
    assert got == pytest.approx([0.3, 0.3, 0.6])


def test_clip_of_an_empty_feature_is_zero(spark):
    d = spark.createDataFrame([(1.0, None), (3.0, None)], "a double, b double")
    bounds = ml.fit_clip(d, ["a", "b"])
    got = ml.apply_clip(spark.createDataFrame([(9.0, 5.0), (None, None)], "a double, b double"), bounds, ["a", "b"]).collect()
    assert [tuple(r) for r in got] == [(pytest.approx(2.98), 0.0), (2.0, 0.0)]


def test_blend_weights():
    w = policy.blend_weights(3)
    assert len(w) == 15 and all(sum(x) == 1 for x in w) and len(set(w)) == 15


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0), (1, 2, 0)])
def test_percentile_stream_in_any_order_of_files(spark, tmp_path, order):
    s = panel(spark, 60).select("entity", "date", F.col("gross").alias("score"))
    later = spark.createDataFrame([("zz", 1.0)], "entity string, score double").select("entity", F.lit("2024-01-01").cast("date").alias("date"), "score")
    flat = tmp_path / "flat"
    flat.mkdir()
    for place, i in enumerate([*order, 3]):
        part = later if i == 3 else s.where(f"date >= date'2023-01-01' + {20 * i} and date < date'2023-01-01' + {20 * (i + 1)}")
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{place}"))
        (file,) = (tmp_path / f"in/{place}").glob("*.parquet")
        copy = flat / f"{place}.parquet"
        copy.write_bytes(file.read_bytes())
        os.utime(copy, (1_700_000_000 + place, 1_700_000_000 + place))
    read = streams.read_folder(spark, str(flat), s.schema, files=1)
    stream = streams.percentile_stream(read, 150.0, lookback=30, warmup=10, delay_days=60)
    got = streams.run_to_table(stream, str(tmp_path / "out"))
    want = policy.percentile_policy(s, "entity", "date", "score", 150.0, lookback=30, warmup=10)
    cols = ["entity", "date", "percentile", "policy_mode", "alert"]
    assert policy.future_difference(got.select(cols), want.select(cols)).count() == 0
    again = streams.run_to_table(stream, str(tmp_path / "out"))
    assert again.count() == got.count() == 180


def test_percentile_stream_reports_late_rows(spark, tmp_path):
    flat = tmp_path / "flat"
    flat.mkdir()
    days = [["2023-03-01", "2023-03-02", "2023-03-20"], ["2023-03-19"], ["2023-02-10"], ["2023-06-01"]]
    for i, part in enumerate(days):
        d = spark.createDataFrame([("a", x, float(len(x) + i)) for x in part], "entity string, day string, score double")
        d.select("entity", F.col("day").cast("date").alias("date"), "score").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        (file,) = (tmp_path / f"in/{i}").glob("*.parquet")
        (flat / f"{i}.parquet").write_bytes(file.read_bytes())
        os.utime(flat / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    read = streams.read_folder(spark, str(flat), T.StructType.fromDDL("entity string, date date, score double"), files=1)
    got = streams.run_to_table(streams.percentile_stream(read, 10.5, warmup=2), str(tmp_path / "out"))
    modes = {str(r["date"]): r["policy_mode"] for r in got.collect()}
    assert modes == {"2023-03-01": "static", "2023-03-02": "static", "2023-02-10": "late", "2023-03-19": "causal_percentile", "2023-03-20": "causal_percentile"}


def test_ingest_stream_drops_repeats(spark, tmp_path):
    d = spark.createDataFrame([(1, 2.0), (2, 3.0)], "event_id long, value double").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    d.unionByName(d).write.parquet(str(tmp_path / "in"))
    stream = streams.ingest_stream(streams.read_folder(spark, str(tmp_path / "in"), d.schema))
    assert streams.run_to_table(stream, str(tmp_path / "out")).count() == 2


def test_ingest_keeps_each_row_once_beyond_the_watermark(spark, tmp_path):
    flat = tmp_path / "flat"
    flat.mkdir()
    days = [["2024-01-01", "2024-01-01", "2024-01-02"], ["2024-02-01"], ["2024-03-01"], ["2024-01-01", "2024-03-01", "2023-12-31"]]
    for i, part in enumerate(days):
        d = spark.createDataFrame([(x, 1.0) for x in part], "day string, value double").select("value", F.col("day").cast("timestamp_ntz").alias("ts"))
        d.coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        (file,) = (tmp_path / f"in/{i}").glob("*.parquet")
        (flat / f"{i}.parquet").write_bytes(file.read_bytes())
        os.utime(flat / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))

    def ingest():
        read = streams.read_folder(spark, str(flat), d.schema, files=1)
        return streams.ingest_to_table(read, str(tmp_path / "out"), prefix=1)

    assert ingest().count() == 5
    # the last batch was written, but not committed: it runs again
    for name in ("3", ".3.crc"):
        (tmp_path / "out/checkpoint/commits" / name).rename(tmp_path / f"commit{name}")
    assert ingest().count() == 5
