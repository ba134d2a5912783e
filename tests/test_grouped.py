"""Distinct counts in passes of their own, and period windows per group."""

from pyspark.sql import functions as F

from ebbtide.operators import explain, panels


def lines(spark):
    rows = [(k, d, i % 5, i % 3, None if i % 4 == 0 else i % 2, i % 7 == 0) for k in ("a", None) for d in (1, 2) for i in range(40)]
    rows += [("b", 1, None, None, None, None)]
    return spark.createDataFrame(rows, "k string, d int, invoice int, customer int, product int, electronic boolean")


def test_grouped_equals_one_aggregation(spark):
    d = lines(spark)
    e = F.col("electronic")
    distinct = [(F.col("invoice"), {"n": None, "ne": e}), (F.col("customer"), {"c": None}), (F.col("product"), {"p": None})]
    got = panels.grouped(d, ["k", "d"], {"rows": F.count(F.lit(1)), "s": F.sum("customer")}, distinct)
    want = d.groupBy("k", "d").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("customer").alias("s"), F.countDistinct("invoice").alias("n"),
        F.countDistinct(F.when(e, F.col("invoice"))).alias("ne"), F.countDistinct("customer").alias("c"), F.countDistinct("product").alias("p"),
    )
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert len(got.collect()) == 5
    alone = panels.grouped(d, ["k", "d"], {}, distinct)
    assert sorted(map(str, alone.collect())) == sorted(map(str, want.drop("rows", "s").collect()))


def plan(df):
    return df._jdf.queryExecution().toString()


def test_lines_are_not_copied_per_distinct_count(spark):
    d = lines(spark)
    built = panels.grouped(d, ["k", "d"], {"s": F.sum("customer")}, [(F.col(c), {f"n_{c}": None}) for c in ("invoice", "product")])
    assert "Expand" not in plan(built)


def test_lines_are_not_dealt_by_group_for_periods(spark):
    rows = [("a", "2024-01-31", "INV"), ("a", "2024-01-20", "INV"), ("a", "2024-01-10", "INV"), ("b", "2024-03-31", "INV"), ("b", "2024-03-30", "DAILY_IMPORT"), ("b", "2024-03-18", "INV"), (None, "2024-03-31", "INV")]
    sales = spark.createDataFrame(rows, "k string, day string, transaction_type string").withColumn("sale_date", F.col("day").cast("date"))
    tagged = explain.with_period(sales, 7, ["k"])
    assert sorted((r["k"], r["day"], r["period"]) for r in tagged.collect()) == [("a", "2024-01-20", "previous"), ("a", "2024-01-31", "current"), ("b", "2024-03-18", "previous"), ("b", "2024-03-31", "current")]
    text = plan(tagged)
    assert "BroadcastHashJoin" in text and "hashpartitioning" not in text.split("== Physical Plan ==")[1]
