"""Parsing, row rules, identities and the import path on derived text rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbtide.operators import cleaning
from ebbtide.operators.ordering import settle
from ebbtide.plans import base
from ebbtide.plans.base import COMPANY, SALES, panel_sql
from ebbtide.plans.registry import query
from ebbtide.sources import readers, sinks


def uci_rows(t):
    """Line items written as upload rows: dates in seven spellings, some
    invoices blank, some numbers broken."""
    li = t.read("lineitem")
    d, n = F.col("l_shipdate").cast("timestamp"), F.col("l_linenumber")
    date = (
        F.when(n == 1, F.date_format(d, "yyyy-MM-dd"))
        .when(n == 2, F.date_format(d, "yyyy-MM-dd HH:mm:ss"))
        .when(n == 3, F.date_format(d, "M/d/yyyy HH:mm"))
        .when(n == 4, F.date_format(d, "MM/dd/yyyy"))
        .when(n == 5, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(n == 6, F.date_format(d, "d/M/yyyy"))
        .otherwise(F.date_format(d, "yyyy.MM.dd"))
    )
    is_r = F.col("l_returnflag") == "R"
    qty = F.col("l_quantity").cast("decimal(10,0)")
    # written once, as an upload would lie in storage
    return settle(li.select(
        F.concat(F.when(is_r & (n < 4), F.lit("C")).otherwise(""), F.when(F.col("l_suppkey") == 5, "").otherwise(F.col("l_orderkey").cast("string"))).alias("InvoiceNo"),
        F.concat(F.lit(" "), F.col("l_partkey").cast("string")).alias("StockCode"),
        F.when(n == 1, "").otherwise(F.concat(F.lit("Item "), F.col("l_partkey"))).alias("Description"),
        F.when(is_r, -qty).otherwise(qty).cast("string").alias("Quantity"),
        date.alias("InvoiceDate"),
        F.when(F.col("l_tax") == 0, "").when(F.col("l_suppkey") == 7, "n/a").otherwise(F.col("l_extendedprice").cast("decimal(14,2)").cast("string")).alias("UnitPrice"),
        F.when(n == 2, "").otherwise(F.col("l_suppkey").cast("string")).alias("CustomerID"),
        F.when(n == 3, "").otherwise("Saudi Arabia").alias("Country"),
        (F.col("l_orderkey") * 10 + n).alias("row_no"),
    ))


UCI = """uci AS (SELECT
   (CASE WHEN l_returnflag = 'R' AND l_linenumber < 4 THEN 'C' ELSE '' END) || (CASE WHEN l_suppkey = 5 THEN '' ELSE CAST(l_orderkey AS VARCHAR) END) AS InvoiceNo,
   ' ' || l_partkey AS StockCode, CASE WHEN l_linenumber = 1 THEN '' ELSE 'Item ' || l_partkey END AS Description,
   CAST((CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END) * CAST(l_quantity AS INTEGER) AS VARCHAR) AS Quantity,
   CASE l_linenumber WHEN 1 THEN strftime(l_shipdate, '%Y-%m-%d') WHEN 2 THEN strftime(l_shipdate, '%Y-%m-%d %H:%M:%S')
     WHEN 3 THEN strftime(l_shipdate, '%-m/%-d/%Y %H:%M') WHEN 4 THEN strftime(l_shipdate, '%m/%d/%Y')
     WHEN 5 THEN strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') WHEN 6 THEN strftime(l_shipdate, '%-d/%-m/%Y') ELSE strftime(l_shipdate, '%Y.%m.%d') END AS InvoiceDate,
   CASE WHEN l_tax = 0 THEN '' WHEN l_suppkey = 7 THEN 'n/a' ELSE CAST(CAST(l_extendedprice AS DECIMAL(14,2)) AS VARCHAR) END AS UnitPrice,
   CASE WHEN l_linenumber = 2 THEN '' ELSE CAST(l_suppkey AS VARCHAR) END AS CustomerID,
   CASE WHEN l_linenumber = 3 THEN '' ELSE 'Saudi Arabia' END AS Country, l_orderkey * 10 + l_linenumber AS row_no FROM lineitem)"""


def parsed_sql(col: str, month_first: bool) -> str:
    day, month = ["%d/%m/%Y %H:%M", "%d/%m/%Y"], ["%m/%d/%Y %H:%M", "%m/%d/%Y"]
    formats = ["%Y-%m-%d", "%Y-%m-%d %H:%M:%S"] + (month + day if month_first else day + month)
    tries = ", ".join(f"try_strptime({col}, '{f}')" for f in formats)
    return f"CAST(coalesce({tries}, try_strptime({col}, '%Y-%m-%dT%H:%M:%S')) AS DATE)"


def decimal_sql(col: str) -> str:
    return f"(CASE WHEN {col} IS NULL OR {col} = '' THEN CAST(0 AS DECIMAL(18,4)) ELSE TRY_CAST(trim({col}) AS DECIMAL(18,4)) END)"


@query(
    "parse_date",
    "text:s day_first:d month_first:d n:i",
    f"""WITH {UCI} SELECT InvoiceDate AS text, {parsed_sql('InvoiceDate', False)} AS day_first, {parsed_sql('InvoiceDate', True)} AS month_first, count(*) AS n
 FROM uci GROUP BY ALL""",
)
def parse_date(t):
    texts = uci_rows(t).groupBy(F.col("InvoiceDate").alias("text")).agg(F.count(F.lit(1)).alias("n"))
    return texts.withColumns(
        {
            "day_first": cleaning.parse_date(F.col("text")),
            "month_first": cleaning.parse_date(F.col("text"), True),
        }
    )


@query(
    "parse_decimal",
    "text:s value:f4 rejected:b n:i",
    f"WITH {UCI} SELECT UnitPrice AS text, {decimal_sql('UnitPrice')} AS value, {decimal_sql('UnitPrice')} IS NULL AS rejected, count(*) AS n FROM uci GROUP BY ALL",
)
def parse_decimal(t):
    texts = uci_rows(t).groupBy(F.col("UnitPrice").alias("text")).agg(F.count(F.lit(1)).alias("n"))
    return texts.withColumn("value", cleaning.parse_decimal(F.col("text"))).withColumn(
        "rejected", F.col("value").isNull()
    )


VALID = f"""valid AS (SELECT *, CASE WHEN {parsed_sql('InvoiceDate', True)} IS NULL THEN 'invalid date: ' || InvoiceDate
   WHEN {decimal_sql('Quantity')} IS NULL THEN 'invalid numeric value: ' || Quantity
   WHEN {decimal_sql('UnitPrice')} IS NULL THEN 'invalid numeric value: ' || UnitPrice
   WHEN trim(InvoiceNo) = '' OR trim(StockCode) = '' THEN 'missing invoice or stock code' END AS reject_reason FROM uci)"""


@query(
    "split_valid",
    "reject_reason:s n:i",
    f"WITH {UCI}, {VALID} SELECT reject_reason, count(*) AS n FROM valid GROUP BY 1",
)
def split_valid(t):
    return cleaning.split_valid(uci_rows(t), "uci").groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "first_rejections",
    "row_no:i",
    f"WITH {UCI}, {VALID} SELECT row_no FROM valid WHERE reject_reason IS NOT NULL ORDER BY row_no LIMIT 100",
)
def first_rejections(t):
    return cleaning.first_rejections(cleaning.split_valid(uci_rows(t), "uci"))


_SALES_COLS = (
    "sale_date:d transaction_number:s transaction_type:s sku:s product_name:s customer_key:s channel:s franchise:s "
    "quantity:i unit_price:f4 discount_amount:f4 discount_percent:f2 gross_sales:f4 net_sales:f4 vat_amount:f4 total_amount:f4"
)


@query(
    "to_sales_uci",
    _SALES_COLS,
    f"""WITH {UCI}, {VALID}, p AS (SELECT *, {parsed_sql('InvoiceDate', True)} AS sale_date, CAST(Quantity AS BIGINT) AS q, {decimal_sql('UnitPrice')} AS unit_price FROM valid WHERE reject_reason IS NULL)
 SELECT sale_date, trim(InvoiceNo) AS transaction_number, CASE WHEN q < 0 OR InvoiceNo LIKE 'C%' THEN 'RETURN' ELSE 'INV' END AS transaction_type,
   trim(StockCode) AS sku, CASE WHEN Description = '' THEN trim(StockCode) ELSE Description END AS product_name, nullif(CustomerID, '') AS customer_key,
   'Online' AS channel, CASE WHEN Country = '' THEN 'UCI' ELSE Country END AS franchise, q AS quantity, unit_price, 0 AS discount_amount, 0 AS discount_percent,
   greatest(q * unit_price, 0) AS gross_sales, q * unit_price AS net_sales, 0 AS vat_amount, q * unit_price AS total_amount FROM p""",
)
def to_sales_uci(t):
    rows = cleaning.split_valid(uci_rows(t), "uci").where("reject_reason is null")
    return cleaning.to_sales(rows, "uci")


@query(
    "to_sales_redsea",
    _SALES_COLS,
    f"""WITH {SALES} SELECT sale_date, CAST(transaction_number AS VARCHAR) AS transaction_number, CASE WHEN transaction_type = 'RETURN' THEN 'RETURN' ELSE 'INV' END AS transaction_type,
   CAST(product_id AS VARCHAR) AS sku, product_name, CAST(customer_key AS VARCHAR) AS customer_key, channel, brand AS franchise,
   CAST(quantity AS BIGINT) AS quantity, list_amount AS unit_price, discount_amount, greatest(0, least(100, CAST(net_sales AS DOUBLE) / 1000)) AS discount_percent,
   gross_sales, net_sales, CAST(vat_amount AS DECIMAL(18,4)) AS vat_amount, net_sales + CAST(vat_amount AS DECIMAL(18,4)) AS total_amount FROM sales""",
)
def to_sales_redsea(t):
    s = t.sales(
        "sale_date", "transaction_number", "transaction_type", "product_id", "product_name", "customer_key", "channel",
        "brand", "quantity", "list_amount", "discount_amount", "net_sales", "vat_amount",
    )
    text = lambda c: F.col(c).cast("string")
    rows = s.select(
        F.date_format("sale_date", "d/M/yyyy").alias("TRX DATE"),
        text("transaction_number").alias("TRX NUMBER"),
        F.when(F.col("transaction_type") == "RETURN", "return").otherwise("").alias("Type"),
        F.col("channel").alias("SALES CHANNEL"),
        text("customer_key").alias("CUSTOMER NUMBER"),
        text("product_id").alias("ITEM CODE"),
        F.col("product_name").alias("ITEM DESC"),
        text("quantity").alias("QUANTITY"),
        text("list_amount").alias("Unit Price"),
        text("net_sales").alias("Net Amount"),
        (F.col("net_sales") + F.col("vat_amount").cast("decimal(18,4)")).cast("string").alias("TOTAL AMOUNT"),
        text("discount_amount").alias("Discount Amount"),
        (F.col("net_sales").cast("decimal(30,7)") / 1000).cast("string").alias("Discount Amount(%)"),
        F.col("brand").alias("FRANCHISE"),
    )
    return cleaning.to_sales(rows, "redsea")


@query(
    "to_sales_daily",
    _SALES_COLS,
    f"""WITH {COMPANY} SELECT date AS sale_date, 'DAILY-' || strftime(date, '%Y%m%d') AS transaction_number, 'DAILY_IMPORT' AS transaction_type,
   'DAILY-IMPORTED-AGGREGATE' AS sku, 'Imported daily aggregate' AS product_name, NULL AS customer_key, 'Aggregate' AS channel, 'Imported CSV' AS franchise,
   0 AS quantity, 1 AS unit_price, 0 AS discount_amount, 0 AS discount_percent, sales AS gross_sales, sales AS net_sales, 0 AS vat_amount, sales AS total_amount FROM company""",
)
def to_sales_daily(t):
    rows = base.company_day(t).select(
        F.col("date").cast("string").alias("date"), F.col("sales").cast("decimal(18,4)").cast("string").alias("net_sales")
    )
    return cleaning.to_sales(rows, "daily")


_JSON = " || ',' || ".join(
    f"""'"{c}":"' || {c} || '"'""" for c in sorted(["InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID", "Country"])
)


@query("row_hash", "row_no:i source_row_hash:s", f"WITH {UCI} SELECT row_no, sha256('uci:{{' || {_JSON} || '}}') AS source_row_hash FROM uci")
def row_hash(t):
    return cleaning.row_hash(uci_rows(t), "uci")


def _hashed(t):
    s = t.sales("transaction_number", "line_number", "product_id", "line_status", "net_sales")
    key = F.sha2(F.concat_ws("|", "transaction_number", "line_number"), 256)
    return s.withColumn("source_row_hash", key)


_HASHED = f"""{SALES}, h AS (SELECT *, sha256(transaction_number || '|' || line_number) AS hash FROM sales),
 fresh AS (SELECT DISTINCT hash FROM h WHERE hash NOT IN (SELECT hash FROM h WHERE line_status = 'F'))"""


@query(
    "insert_new",
    "source_row_hash:s",
    f"WITH {_HASHED} SELECT hash AS source_row_hash FROM fresh",
)
def insert_new(t):
    h = _hashed(t)
    return cleaning.insert_new(h.where("line_status = 'F'"), h)


@query(
    "insert_counts",
    "parsed_rows:i inserted_rows:i duplicate_rows:i",
    f"""WITH {_HASHED}, c AS (SELECT (SELECT count(*) FROM h) AS p, (SELECT count(*) FROM fresh) AS i)
 SELECT p AS parsed_rows, i AS inserted_rows, p - i AS duplicate_rows FROM c""",
)
def insert_counts(t):
    h = _hashed(t)
    return cleaning.insert_counts(h, cleaning.insert_new(h.where("line_status = 'F'"), h))


@query(
    "duplicate_effect",
    "rows:i clean_rows:i duplicate_rows:i duplicate_amount:f4",
    f"""WITH {SALES}, r AS (SELECT transaction_number, product_id, net_sales FROM sales UNION ALL
   SELECT transaction_number, product_id, net_sales FROM sales WHERE transaction_type = 'RETURN'),
 d AS (SELECT DISTINCT * FROM r) SELECT (SELECT count(*) FROM r) AS rows, (SELECT count(*) FROM d) AS clean_rows,
   (SELECT count(*) FROM r) - (SELECT count(*) FROM d) AS duplicate_rows,
   (SELECT sum(net_sales) FROM r) - (SELECT sum(net_sales) FROM d) AS duplicate_amount""",
)
def duplicate_effect(t):
    s = t.sales("transaction_number", "product_id", "net_sales", "transaction_type")
    r = s.drop("transaction_type").unionByName(s.where("transaction_type = 'RETURN'").drop("transaction_type"))
    return cleaning.duplicate_effect(r, "net_sales")


@query(
    "flag_returns",
    "is_return:b n:i amount:f4",
    f"""WITH {UCI}, r AS (SELECT InvoiceNo LIKE 'C%' OR CAST(Quantity AS INTEGER) < 0 AS is_return,
   abs(CAST(Quantity AS INTEGER)) * {decimal_sql('UnitPrice')} AS size FROM uci)
 SELECT is_return, count(*) AS n, sum(CASE WHEN is_return THEN -size ELSE size END) AS amount FROM r GROUP BY 1""",
)
def flag_returns(t):
    rows = uci_rows(t).withColumns(
        {"q": F.col("Quantity").cast("int"), "p": cleaning.parse_decimal(F.col("UnitPrice"))}
    )
    flagged = cleaning.flag_returns(rows, "InvoiceNo", "q", "p")
    return flagged.groupBy("is_return").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))


@query(
    "money_columns",
    "transaction_type:s n:i units:f2 subtotal:f2 vat:f2 total:f2",
    f"""WITH {SALES}, u AS (SELECT *, CAST(4.6 * list_amount AS DECIMAL(18,3)) AS raw FROM sales),
 a AS (SELECT *, floor(raw * 100) AS lo, raw * 100 - floor(raw * 100) AS frac FROM u),
 b AS (SELECT *, CAST((lo + CASE WHEN frac > 0.5 OR (frac = 0.5 AND lo % 2 = 1) THEN 1 ELSE 0 END) / 100 AS DECIMAL(16,2)) AS unit_sar FROM a),
 s AS (SELECT *, CAST(quantity AS INTEGER) * unit_sar AS size FROM b),
 w AS (SELECT *, CAST(size * 0.15 AS DECIMAL(18,4)) AS rv FROM s),
 x AS (SELECT *, floor(rv * 100) AS vlo, rv * 100 - floor(rv * 100) AS vfrac FROM w),
 y AS (SELECT *, CAST((vlo + CASE WHEN vfrac > 0.5 OR (vfrac = 0.5 AND vlo % 2 = 1) THEN 1 ELSE 0 END) / 100 AS DECIMAL(18,2)) AS v FROM x)
 SELECT transaction_type, count(*) AS n, sum(unit_sar) AS units, sum(CASE WHEN transaction_type = 'RETURN' THEN -size ELSE size END) AS subtotal,
   sum(CASE WHEN transaction_type = 'RETURN' THEN -v ELSE v END) AS vat,
   sum(CASE WHEN transaction_type = 'RETURN' THEN -(size + v) ELSE size + v END) AS total FROM y GROUP BY 1""",
)
def money_columns(t):
    s = t.sales("transaction_type", "quantity", "list_amount").withColumn(
        "is_return", F.col("transaction_type") == "RETURN"
    )
    m = cleaning.money_columns(s, "quantity", "list_amount", "is_return")
    return m.groupBy("transaction_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("unit_sar").alias("units"), F.sum("subtotal").alias("subtotal"),
        F.sum("vat").alias("vat"), F.sum("total").alias("total"),
    )


@query(
    "money_mismatch",
    "n:i",
    f"""WITH {SALES} SELECT count(*) AS n FROM sales WHERE
   abs(CAST(vat_amount AS DECIMAL(18,2)) - CAST(round(net_sales * 0.04, 2) AS DECIMAL(18,2))) > 0.011""",
)
def money_mismatch(t):
    s = t.sales("net_sales", "vat_amount").select(
        F.col("net_sales").cast("decimal(18,4)").alias("subtotal"),
        F.col("vat_amount").cast("decimal(18,2)").alias("vat"),
    )
    s = s.withColumn("total", F.col("subtotal") + F.col("vat"))
    return cleaning.money_mismatch(s, "subtotal", "vat", "total", "0.04").agg(F.count(F.lit(1)).alias("n"))


@query(
    "gross_return_split",
    "channel:s gross:f4 returns:f4",
    f"WITH {SALES} SELECT channel, sum(greatest(net_sales, 0)) AS gross, sum(greatest(-net_sales, 0)) AS returns FROM sales GROUP BY 1",
)
def gross_return_split(t):
    d = cleaning.gross_return_split(t.sales("channel", "net_sales"), "net_sales")
    return d.groupBy("channel").agg(F.sum("gross").alias("gross"), F.sum("returns").alias("returns"))


def _scoped(t, imported_only_when: str):
    s = t.sales("sale_date", "line_status", "order_status", "net_sales", "branch")
    return s.withColumn("source_import_id", F.when(F.expr(imported_only_when), F.lit(1)))


@query(
    "preferred_scope",
    "data_mode:s n:i net:f4",
    f"""WITH {SALES}, s AS (SELECT *, CASE WHEN order_status = 'F' THEN 1 END AS imp FROM sales)
 SELECT CASE WHEN (SELECT count(imp) FROM s) > 0 THEN 'imported' ELSE 'seed' END AS data_mode, count(*) AS n, sum(net_sales) AS net FROM s
 WHERE (imp IS NOT NULL) = ((SELECT count(imp) FROM s) > 0)""",
)
def preferred_scope(t):
    d = cleaning.preferred_scope(_scoped(t, "order_status = 'F'"))
    return d.groupBy("data_mode").agg(F.count(F.lit(1)).alias("n"), F.sum("net_sales").alias("net"))


@query(
    "choose_history",
    "branch:i data_mode:s n:i net:f4",
    f"""WITH {SALES}, s AS (SELECT branch, sale_date, net_sales, CASE WHEN branch > 12 AND sale_date >= DATE '1995-01-10' THEN 'DAILY_IMPORT'
   WHEN sale_date >= DATE '1996-01-01' AND branch > 4 THEN 'DAILY_AGGREGATE' ELSE transaction_type END AS tt FROM sales),
 c AS (SELECT *, CASE tt WHEN 'DAILY_IMPORT' THEN 'daily_import' WHEN 'DAILY_AGGREGATE' THEN 'seed_aggregate' ELSE 'transaction_level' END AS src FROM s),
 sp AS (SELECT branch, src, max(sale_date) - min(sale_date) + 1 AS span FROM c GROUP BY 1, 2),
 ch AS (SELECT branch, coalesce(max(span) FILTER (src = 'transaction_level'), 0) AS r, coalesce(max(span) FILTER (src = 'daily_import'), 0) AS d FROM sp GROUP BY 1),
 m AS (SELECT branch, CASE WHEN r >= 28 THEN 'transaction_level' WHEN d >= 28 THEN 'daily_import' WHEN r > 0 THEN 'transaction_level_insufficient'
   WHEN d > 0 THEN 'daily_import_insufficient' ELSE 'seed_aggregate' END AS data_mode FROM ch)
 SELECT branch, data_mode, count(*) AS n, sum(net_sales) AS net FROM c JOIN m USING (branch) WHERE src = replace(data_mode, '_insufficient', '') GROUP BY 1, 2""",
)
def choose_history(t):
    d = F.col("sale_date")
    s = t.sales("branch", "sale_date", "transaction_type", "net_sales").withColumn(
        "transaction_type",
        F.when((F.col("branch") > 12) & (d >= F.lit("1995-01-10").cast("date")), "DAILY_IMPORT")
        .when((d >= F.lit("1996-01-01").cast("date")) & (F.col("branch") > 4), "DAILY_AGGREGATE")
        .otherwise(F.col("transaction_type")),
    )
    chosen = cleaning.choose_history(s, by=["branch"])
    return chosen.groupBy("branch", "data_mode").agg(F.count(F.lit(1)).alias("n"), F.sum("net_sales").alias("net"))


@query(
    "scope_to_branches",
    "branch:i net:f4",
    f"WITH {SALES} SELECT branch, sum(net_sales) AS net FROM sales WHERE branch IN (2, 3, 5, 7) GROUP BY 1",
)
def scope_to_branches(t):
    s = cleaning.scope_to_branches(t.sales("branch", "net_sales"), [2, 3, 5, 7])
    return s.groupBy("branch").agg(F.sum("net_sales").alias("net"))


@query(
    "truthy",
    "flag:b n:i",
    """SELECT lower(trim(v)) IN ('true', '1', 'yes') AS flag, count(*) AS n FROM (
   SELECT CASE l_linenumber WHEN 1 THEN 'True' WHEN 2 THEN ' yes ' WHEN 3 THEN '1' WHEN 4 THEN 'no' WHEN 5 THEN '0' ELSE 'false' END AS v FROM lineitem) GROUP BY 1""",
)
def truthy(t):
    n = F.col("l_linenumber")
    v = F.when(n == 1, "True").when(n == 2, " yes ").when(n == 3, "1").when(n == 4, "no").when(n == 5, "0").otherwise("false")
    d = t.read("lineitem").select(cleaning.truthy(v).alias("flag"))
    return d.groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


RULES = (("Metal", r"\bring\b|bolt|gear"), ("Tools", r"widget|\bnut\b"), ("Colour", r"^red|blue"))


@query(
    "classify_text",
    "label:s n:i",
    r"""SELECT CASE WHEN regexp_matches(p_name, '(?i)\bring\b|bolt|gear') THEN 'Metal' WHEN regexp_matches(p_name, '(?i)widget|\bnut\b') THEN 'Tools'
   WHEN regexp_matches(p_name, '(?i)^red|blue') THEN 'Colour' ELSE 'Other' END AS label, count(*) AS n FROM part GROUP BY 1""",
)
def classify_text(t):
    d = t.read("part").select(cleaning.classify_text(F.col("p_name"), RULES, "Other").alias("label"))
    return d.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "admin_line",
    "admin:b n:i",
    r"""SELECT upper(trim(p_brand)) IN ('BRAND#7', 'BRAND#9') OR regexp_matches(upper(p_name), 'BOLT|SMALL R') AS admin, count(*) AS n FROM part GROUP BY 1""",
)
def admin_line(t):
    flag = cleaning.admin_line(F.col("p_brand"), F.col("p_name"), ("BRAND#7", "BRAND#9"), "BOLT|SMALL R")
    return t.read("part").select(flag.alias("admin")).groupBy("admin").agg(F.count(F.lit(1)).alias("n"))


@query(
    "effective_customer",
    "customer_source:s rows:i effective:i observed:i",
    f"""WITH {SALES}, c AS (SELECT transaction_number, CASE WHEN channel <> 'BUILDING' THEN customer_key END AS k FROM sales)
 SELECT CASE WHEN k IS NULL THEN 'invoice_fallback' ELSE 'observed' END AS customer_source, count(*) AS rows,
   count(DISTINCT coalesce(CAST(k AS VARCHAR), 'INV-' || transaction_number)) AS effective, count(DISTINCT k) AS observed FROM c GROUP BY 1""",
)
def effective_customer(t):
    s = t.sales("transaction_number", "customer_key", "channel").withColumn(
        "k", F.when(F.col("channel") != "BUILDING", F.col("customer_key"))
    )
    d = cleaning.effective_customer(s, "k", "transaction_number")
    return d.groupBy("customer_source").agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("effective_customer").alias("effective"),
        F.countDistinct("observed_customer").alias("observed"),
    )


def stable_sql(text: str, modulus: int) -> str:
    return f"CAST(CAST(('0x' || substr(sha256({text}), 1, 16)) AS UBIGINT) % {modulus} AS BIGINT)"


@query(
    "stable_id",
    "c_custkey:i stable:s",
    f"SELECT c_custkey, 'SA-C' || lpad(CAST({stable_sql('CAST(c_custkey AS VARCHAR)', 10**8)} AS VARCHAR), 8, '0') AS stable FROM customer",
)
def stable_id(t):
    return t.read("customer").select("c_custkey", cleaning.stable_id(F.col("c_custkey"), 10**8, "SA-C").alias("stable"))


@query(
    "id_collisions",
    "side:s value:s n:i",
    f"""WITH p AS (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS a, 'X' || lpad(CAST({stable_sql('CAST(c_custkey AS VARCHAR)', 10**5)} AS VARCHAR), 5, '0') AS b FROM customer)
 SELECT 'source' AS side, a AS value, count(*) AS n FROM p GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'target', b, count(*) FROM p GROUP BY 2 HAVING count(*) > 1""",
)
def id_collisions(t):
    d = t.read("customer").withColumn("stable", cleaning.stable_id(F.col("c_custkey"), 10**5, "X"))
    return cleaning.id_collisions(d, "c_custkey", "stable")


WEIGHTS = {"Riyadh": 8.6, "Makkah": 8.0, "Eastern": 5.1, "Madinah": 2.1, "Other": 8.4}


@query(
    "weighted_bucket",
    "c_custkey:i region:s",
    f"""WITH u AS (SELECT c_custkey, {stable_sql('CAST(c_custkey AS VARCHAR)', 10**12)} / 1e12 AS u FROM customer)
 SELECT c_custkey, CASE WHEN u < 8.6 / 32.2 THEN 'Riyadh' WHEN u < 16.6 / 32.2 THEN 'Makkah' WHEN u < 21.7 / 32.2 THEN 'Eastern' WHEN u < 23.8 / 32.2 THEN 'Madinah' ELSE 'Other' END AS region FROM u""",
)
def weighted_bucket(t):
    return t.read("customer").select(
        "c_custkey", cleaning.weighted_bucket(F.col("c_custkey"), WEIGHTS).alias("region")
    )


@query(
    "quota_assign",
    "year:i transaction_number:i in_quota:b",
    f"""WITH {SALES}, k AS (SELECT DISTINCT year(sale_date) AS year, transaction_number FROM sales),
 h AS (SELECT *, {stable_sql("'payment:' || year || ':' || transaction_number", 10**15)} AS h FROM k),
 r AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY h, transaction_number) AS p, count(*) OVER (PARTITION BY year) AS n FROM h),
 q AS (SELECT *, (CASE WHEN year < 1998 THEN 0.62 ELSE 0.85 END) * n AS x FROM r)
 SELECT year, transaction_number, p <= CASE WHEN x - floor(x) = 0.5 THEN 2 * round(x / 2) ELSE round(x) END AS in_quota FROM q""",
)
def quota_assign(t):
    keys = t.sales("sale_date", "transaction_number").select(F.year("sale_date").alias("year"), "transaction_number")
    share = F.when(F.col("year") < 1998, 0.62).otherwise(0.85)
    return cleaning.quota_assign(keys, "transaction_number", "year", share, "payment")


def _long_indicators(t):
    """(week, city, sector, indicator, value) with totals, as published tables are."""
    w = base.with_week(t.sales("sale_date", "region", "category", "list_amount"), "sale_date")
    cells = w.groupBy("week_start", F.col("region").alias("city"), F.col("category").alias("sector")).agg(
        F.sum("list_amount").alias("v"), F.count(F.lit(1)).alias("n")
    )
    totals = cells.groupBy("week_start", "sector").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).withColumn("city", F.lit(" Total"))
    both = cells.unionByName(totals)
    kinds = [("Value of Transactions", F.col("v")), ("Number of Transactions", F.col("n")), ("Change in value of transactions", F.col("v") * 0)]
    parts = [
        both.select("week_start", "city", "sector", F.lit(k).alias("indicator"), v.cast("double").alias("value")) for k, v in kinds
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


LONG = f"""{SALES}, cells AS (SELECT sale_date - CAST(dayofweek(sale_date) AS INTEGER) AS week_start, region AS city, category AS sector, sum(list_amount) AS v, count(*) AS n FROM sales GROUP BY 1, 2, 3),
 bothc AS (SELECT * FROM cells UNION ALL SELECT week_start, ' Total', sector, sum(v), sum(n) FROM cells GROUP BY 1, 3),
 long AS (SELECT week_start, city, sector, 'Value of Transactions' AS indicator, CAST(v AS DOUBLE) AS value FROM bothc
   UNION ALL SELECT week_start, city, sector, 'Number of Transactions', n FROM bothc
   UNION ALL SELECT week_start, city, sector, 'Change in value of transactions', 0 FROM bothc)"""


@query(
    "select_indicator",
    "week_start:d sector:s value:f2",
    f"""WITH {LONG} SELECT week_start, sector, value FROM long WHERE lower(indicator) LIKE '%value%' AND lower(indicator) LIKE '%transaction%'
   AND lower(indicator) NOT LIKE '%change%' AND lower(trim(city)) = 'total'""",
)
def select_indicator(t):
    return cleaning.select_indicator(_long_indicators(t), ["value", "transaction"], city_total=True, sector_total=False)


@query(
    "value_count_panel",
    "week_start:d city:s sector:s value:f2 count:i",
    f"""WITH {LONG} SELECT a.week_start, a.city, a.sector, a.value, b.value AS count FROM long a JOIN long b USING (week_start, city, sector)
 WHERE a.indicator = 'Value of Transactions' AND b.indicator = 'Number of Transactions' AND trim(a.city) <> 'Total' """,
)
def value_count_panel(t):
    from ebbtide.operators.joins import value_count_panel as build

    rows = cleaning.select_indicator(_long_indicators(t), ["transaction"], city_total=False)
    return build(
        rows, ["week_start", "city", "sector"], "indicator", "value",
        {"Value of Transactions": "value", "Number of Transactions": "count"},
    )


ALIASES = {"Clothing": ["Économy & Co", "Small and co."], "Travel": ["LARGE  &CO", "Promo & Co"]}


@query(
    "canonical_labels",
    "canonical:s n:i",
    """WITH l AS (SELECT CASE p_type WHEN 'ECONOMY' THEN 'économy & Co' ELSE p_type || ' & Co' END AS label FROM part),
 n AS (SELECT lower(trim(regexp_replace(replace(strip_accents(label), '&', ' and '), '[^a-zA-Z0-9]+', ' ', 'g'))) AS k FROM l)
 SELECT CASE WHEN k IN ('economy and co', 'small and co') THEN 'Clothing' ELSE 'Travel' END AS canonical, count(*) AS n FROM n
 WHERE k IN ('economy and co', 'small and co', 'large and co', 'promo and co') GROUP BY 1""",
)
def canonical_labels(t):
    label = F.when(F.col("p_type") == "ECONOMY", "économy & Co").otherwise(F.concat(F.col("p_type"), F.lit(" & Co")))
    d = cleaning.canonical_labels(t.read("part").select(label.alias("label")), "label", ALIASES)
    return d.groupBy("canonical").agg(F.count(F.lit(1)).alias("n"))


@query(
    "rule_multipliers",
    "sale_date:d category:s region:s multiplier:f modeled:f2",
    f"""WITH {SALES}, g AS (SELECT sale_date, category, region, CAST(sum(net_sales) AS DOUBLE) AS base FROM sales GROUP BY 1, 2, 3),
 m AS (SELECT *, round((CASE WHEN sale_date BETWEEN DATE '1997-01-10' AND DATE '1997-02-08' AND category = 'PROMO' THEN 1.22 ELSE 1 END)
   * (CASE WHEN sale_date BETWEEN DATE '1997-01-10' AND DATE '1997-02-08' AND region = 'ASIA' THEN 1.10 ELSE 1 END)
   * (CASE WHEN month(sale_date) = 9 AND day(sale_date) = 23 THEN 1.10 ELSE 1 END) * (CASE WHEN day(sale_date) BETWEEN 25 AND 28 THEN 1.05 ELSE 1 END), 4) AS multiplier FROM g)
 SELECT sale_date, category, region, multiplier, base * multiplier AS modeled FROM m""",
)
def rule_multipliers(t):
    from ebbtide.functions.calendar import in_windows

    g = t.sales("sale_date", "category", "region", "net_sales").groupBy("sale_date", "category", "region").agg(
        F.sum("net_sales").alias("base")
    )
    d = F.col("sale_date")
    fast = in_windows(d, [("1997-01-10", "1997-02-08")])
    rules = [
        (fast & (F.col("category") == "PROMO"), 1.22),
        (fast & (F.col("region") == "ASIA"), 1.10),
        ((F.month(d) == 9) & (F.dayofmonth(d) == 23), 1.10),
        (F.dayofmonth(d).between(25, 28), 1.05),
    ]
    return cleaning.apply_rule_multipliers(g, rules, "base")


@query(
    "clip_nonnegative",
    "date:d sales:f4",
    f"WITH {COMPANY} SELECT date, greatest(sales - 200000, 0) AS sales FROM company",
)
def clip_nonnegative(t):
    return cleaning.clip_nonnegative(base.company_day(t).withColumn("sales", F.col("sales") - 200000.0), "sales")


@query(
    "fill_neutral",
    "entity:s date:d r_ratio:f change:f share:f",
    f"""WITH {panel_sql()}, f AS (SELECT entity, date, gross / nullif(lag(gross, 7) OVER w, 0) AS r_ratio,
   (gross - lag(gross, 28) OVER w) / nullif(abs(lag(gross, 28) OVER w), 0) AS change,
   CASE WHEN invoices > 4 THEN electronic_share END AS share FROM panel WINDOW w AS (PARTITION BY entity ORDER BY date))
 SELECT entity, date, coalesce(r_ratio, 1) AS r_ratio, coalesce(change, 0) AS change,
   coalesce(share, CASE year(date) WHEN 1995 THEN 0.57 WHEN 1996 THEN 0.62 ELSE 0.85 END) AS share FROM f""",
)
def fill_neutral(t):
    from ebbtide.functions.scalars import safe_ratio
    from ebbtide.operators.windows import Series

    s = Series("entity", "date")
    d = base.day_panel(t, measures=("gross", "invoices", "electronic_invoices")).select(
        "entity",
        "date",
        safe_ratio(F.col("gross"), s.lag("gross", 7)).alias("r_ratio"),
        s.change("gross", 28).alias("change"),
        F.when(F.col("invoices") > 4, F.col("electronic_share")).alias("share"),
    )
    return cleaning.fill_neutral(d, ["r_ratio", "change"], "share", F.year("date"), {1995: 0.57, 1996: 0.62})


@query(
    "union_parts",
    "source_part:s n:i net:f4",
    f"""WITH {SALES} SELECT CASE WHEN line_status = 'F' THEN 'closed' ELSE 'open' END AS source_part, count(*) AS n, sum(net_sales) AS net FROM sales GROUP BY 1""",
)
def union_parts(t):
    s = t.sales("line_status", "net_sales")
    d = readers.union_parts({"closed": s.where("line_status = 'F'"), "open": s.where("line_status <> 'F'")})
    return d.groupBy("source_part").agg(F.count(F.lit(1)).alias("n"), F.sum("net_sales").alias("net"))


@query("read_panel", "o_orderkey:i o_orderpriority:s", "SELECT o_orderkey, o_orderpriority FROM orders")
def read_panel(t):
    return readers.read_panel(t.spark, f"{t.folder}/orders.parquet", ["o_orderkey", "o_orderpriority"])


@query(
    "import_ledger",
    "total_rows:i accepted_rows:i rejected_rows:i inserted_rows:i duplicate_rows:i status:s error_count:i",
    f"""WITH {UCI}, {VALID}, a AS (SELECT DISTINCT InvoiceNo, StockCode, Quantity, InvoiceDate, UnitPrice FROM valid WHERE reject_reason IS NULL),
 c AS (SELECT count(*) AS total_rows, count(*) FILTER (reject_reason IS NULL) AS accepted_rows, count(reject_reason) AS rejected_rows FROM valid)
 SELECT *, (SELECT count(*) FROM a) AS inserted_rows, accepted_rows - (SELECT count(*) FROM a) AS duplicate_rows, 'imported' AS status, least(100, rejected_rows) AS error_count FROM c""",
)
def import_ledger(t):
    rows = cleaning.split_valid(uci_rows(t), "uci")
    keyed = cleaning.row_hash(rows, "uci", ["InvoiceNo", "StockCode", "Quantity", "InvoiceDate", "UnitPrice"])
    accepted = keyed.where("reject_reason is null")
    inserted = cleaning.insert_new(accepted.limit(0), accepted)
    return sinks.import_ledger(rows, inserted).withColumn("error_count", F.size("errors"))
