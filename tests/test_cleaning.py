"""Reading, parsing, identities and idempotent import."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from ebbtide.operators import cleaning, joins
from ebbtide.sources import readers, sinks

UCI = "InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country\n"


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_layouts():
    assert readers.detect_layout(["date", "net_sales", "x"]) == "daily"
    assert readers.detect_layout([*readers.LAYOUTS["redsea"], "date", "net_sales"]) == "redsea"
    assert readers.detect_layout([*readers.LAYOUTS["uci"], *readers.LAYOUTS["redsea"]]) == "uci"
    assert readers.detect_layout(["a"]) == "invalid"


def test_dates(spark):
    texts = ["12/1/2010 8:26", "25/12/2010", "12/25/2010", "2024-02-30", "2024-02-29", "2024-1-5 7:08:09", "2024-03-01T10:00:00+03:00", "20240102", "x", "", "31/11/2020", "2024-01-01 25:00:00"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = d.select("i", cleaning.parse_date(F.col("t")).alias("a"), cleaning.parse_date(F.col("t"), True).alias("b")).orderBy("i").collect()
    assert [r["b"] for r in got][:3] == [date(2010, 12, 1), date(2010, 12, 25), date(2010, 12, 25)]
    assert [r["a"] for r in got] == [
        date(2010, 1, 12), date(2010, 12, 25), date(2010, 12, 25), None, date(2024, 2, 29), date(2024, 1, 5), date(2024, 3, 1),
        date(2024, 1, 2), None, None, None, None,
    ]


def test_import_twice_inserts_once(spark, tmp_path):
    path = write(
        tmp_path / "u.csv",
        UCI + "1,A,Mug,2,12/1/2010 8:26,2.50,17,UK\n1,A,Mug,2,12/1/2010 8:26,2.50,17,UK\nC2,B,,1,12/2/2010 9:00,3,,UK\n3,,x,1,12/2/2010 9:00,3,,UK\n4,D,x,q,12/2/2010 9:00,3,,UK\n",
    )
    raw, layout = readers.load_transactions(spark, path)
    assert layout == "uci"
    rows = cleaning.row_hash(cleaning.split_valid(raw, layout), layout)
    reasons = [r["reject_reason"] for r in cleaning.first_rejections(rows).collect()]
    assert reasons == ["missing invoice or stock code", "invalid numeric value: q"]
    sales = cleaning.to_sales(rows.where("reject_reason is null"), layout)
    assert sales.where("transaction_type = 'RETURN'").count() == 1
    assert sales.where("sale_date = date'2010-12-01'").count() == 2
    first = cleaning.insert_new(sales.limit(0), sales)
    assert first.count() == 2
    again = cleaning.insert_new(first, sales)
    ledger = sinks.import_ledger(rows, again).first()
    assert (ledger["inserted_rows"], ledger["duplicate_rows"], ledger["status"]) == (0, 3, "imported_no_new_rows")
    assert len(ledger["errors"]) == 2


def test_daily_and_redsea_rows(spark):
    d = spark.createDataFrame([("2024-01-01", "12.5", "")], "date string, net_sales string, quantity string")
    r = cleaning.to_sales(d, "daily").first()
    assert (float(r["gross_sales"]), r["quantity"], r["transaction_type"]) == (12.5, 0, "DAILY_IMPORT")
    cols = [*sorted(readers.LAYOUTS["redsea"]), "Discount Amount(%)"]
    values = {"TRX DATE": "3/4/2024", "TRX NUMBER": "7", "SALES CHANNEL": "", "CUSTOMER NUMBER": "", "ITEM CODE": "X", "QUANTITY": "-2", "Unit Price": "5", "Net Amount": "-10", "TOTAL AMOUNT": "-11.5", "Discount Amount(%)": "150"}
    r = cleaning.to_sales(spark.createDataFrame([tuple(values[c] for c in cols)], cols), "redsea").first()
    assert r["sale_date"] == date(2024, 4, 3) and r["channel"] == "Store" and r["customer_key"] is None
    assert (float(r["vat_amount"]), r["discount_percent"], float(r["gross_sales"])) == (-1.5, 100.0, 0.0)


def test_delimiters_and_columns(spark, tmp_path):
    path = write(tmp_path / "s.csv", "a;B c;d;e;f\n1;2;3;4;5\n")
    df = readers.read_delimited(spark, path)
    got = readers.resolve_columns(df, {"first": ["A"], "second": ["b_c"]}, ["first"]).first()
    assert (got["first"], got["second"]) == ("1", "2")
    with pytest.raises(ValueError):
        readers.resolve_columns(df, {"q": ["zzz"]}, ["q"])


def test_panel_round_trip(spark, tmp_path):
    d = spark.range(50).select((F.col("id") % 5).alias("k"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("d"), "id")
    sinks.write_panel(d, str(tmp_path / "p"), ["k"], "d")
    back = readers.read_panel(spark, str(tmp_path / "p"), ["k", "d", "id"])
    assert back.count() == 50 and d.exceptAll(back).count() == 0


def test_scope_and_sources(spark):
    rows = [(1, "INV", "2024-01-01", 5.0, 1), (1, "DAILY_IMPORT", "2024-01-01", 7.0, None), (1, "DAILY_IMPORT", "2024-02-15", 7.0, None)]
    s = spark.createDataFrame(rows, "branch int, transaction_type string, day string, net_sales double, source_import_id int").withColumn("sale_date", F.to_date("day"))
    assert cleaning.scope_to_branches(s, []).count() == 0 and cleaning.scope_to_branches(s, None).count() == 3
    assert cleaning.preferred_scope(s).count() == 1
    assert cleaning.preferred_scope(s.where("source_import_id is null")).first()["data_mode"] == "seed"
    assert {r["data_mode"] for r in cleaning.choose_history(s).collect()} == {"daily_import"}


def test_feature_choice_refuses_outcomes(spark):
    d = spark.createDataFrame([(1.0, 2.0, 3.0, "a")], "ratio_7 double, future_ratio double, cal_x double, name string")
    assert cleaning.select_features(d) == ["ratio_7", "cal_x"]
    assert cleaning.select_features(d, allow_prefixes=["cal_"]) == ["cal_x"]
    with pytest.raises(ValueError):
        cleaning.select_features(d, allow=["future_ratio"])
    with pytest.raises(ValueError):
        cleaning.select_features(d, budget=1)


def test_cardinality_and_alignment(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    twice = spark.createDataFrame([(1, 1.0), (1, 2.0)], "k int, w double")
    with pytest.raises(ValueError):
        joins.enrich(left, twice, ["k"])
    with pytest.raises(ValueError):
        joins.stable_mapping(twice, "k", "w")
    a = spark.createDataFrame([(1, 0, 0.2), (2, 1, 0.4)], "k int, y int, score double")
    with pytest.raises(ValueError):
        joins.align_scores({"a": a, "b": a.where("k = 1")}, ["k"])
    with pytest.raises(ValueError):
        joins.forecast_origin_join(left, a.withColumn("actual_h1", F.lit(1)), "k", "v")
