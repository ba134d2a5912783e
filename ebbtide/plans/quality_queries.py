"""Audits, gates, profiles and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbtide.operators import quality
from ebbtide.plans import base
from ebbtide.plans.base import COMPANY, SALES, panel_sql, scores_sql
from ebbtide.plans.registry import query

FEATURES = ("score", "score_b", "score_c", "r")


@query(
    "prevalence_month",
    "period:d rows:i positives:i rate:f mean:f std:f",
    f"""WITH {scores_sql()} SELECT date_trunc('month', date) AS period, count(*) AS rows, sum(y) AS positives, avg(y) AS rate, avg(future_ratio) AS mean, stddev_samp(future_ratio) AS std FROM scores GROUP BY 1""",
)
def prevalence_month(t):
    return quality.prevalence(base.scores(t), "date", "month", "y", "future_ratio")


@query(
    "latest_revision",
    "product_id:i sale_date:d net_sales:f4 versions:i relative_spread:f",
    f"""WITH {SALES}, r AS (SELECT product_id, sale_date, net_sales, row_number() OVER (PARTITION BY product_id ORDER BY sale_date DESC, net_sales DESC) AS rn,
   count(*) OVER (PARTITION BY product_id) AS versions, max(net_sales) OVER (PARTITION BY product_id) AS hi, min(net_sales) OVER (PARTITION BY product_id) AS lo FROM sales)
 SELECT product_id, sale_date, net_sales, versions, CAST(hi - lo AS DOUBLE) / nullif(CAST(hi AS DOUBLE), 0) AS relative_spread FROM r WHERE rn = 1""",
)
def latest_revision(t):
    return quality.latest_revision(t.sales("product_id", "sale_date", "net_sales"), ["product_id"], "sale_date", "net_sales")


@query(
    "gap_histogram",
    "gap_days:i n:i",
    f"""WITH {SALES}, d AS (SELECT DISTINCT branch, sale_date FROM sales), g AS (SELECT sale_date - lag(sale_date) OVER (PARTITION BY branch ORDER BY sale_date) AS gap_days FROM d)
 SELECT gap_days, count(*) AS n FROM g WHERE gap_days IS NOT NULL GROUP BY 1""",
)
def gap_histogram(t):
    return quality.gap_histogram(t.sales("branch", "sale_date"), "branch", "sale_date")


@query(
    "continuity_audit",
    "entities:i max_gap_days:i coverage_min:i coverage_median:f coverage_max:i same_days:b",
    f"""WITH {SALES}, d AS (SELECT DISTINCT branch, sale_date FROM sales), g AS (SELECT branch, sale_date, sale_date - lag(sale_date) OVER (PARTITION BY branch ORDER BY sale_date) AS gap FROM d),
 p AS (SELECT branch, count(*) AS n, max(gap) AS gap FROM g GROUP BY 1)
 SELECT count(*) AS entities, max(gap) AS max_gap_days, min(n) AS coverage_min, quantile_cont(n, 0.5) AS coverage_median, max(n) AS coverage_max,
   min(n) = (SELECT count(DISTINCT sale_date) FROM d) AS same_days FROM p""",
)
def continuity_audit(t):
    return quality.continuity_audit(t.sales("branch", "sale_date"), "branch", "sale_date")


_PROFILE = ("channel", "priority", "branch", "customer_key")


@query(
    "profile_columns",
    "column_name:s rows:i nulls:i distinct_values:i entropy:f",
    f"""WITH {SALES}, l AS ({' UNION ALL '.join(f"SELECT '{c}' AS column_name, CAST({'CASE WHEN branch <> 4 THEN customer_key END' if c == 'customer_key' else c} AS VARCHAR) AS v FROM sales" for c in _PROFILE)}),
 c AS (SELECT column_name, v, count(*) AS n FROM l GROUP BY 1, 2), s AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY column_name) AS DOUBLE) AS p FROM c)
 SELECT column_name, sum(n) AS rows, coalesce(sum(n) FILTER (v IS NULL), 0) AS nulls, count(v) AS distinct_values, -sum(p * ln(p)) / ln(count(*)) AS entropy FROM s GROUP BY 1""",
)
def profile_columns(t):
    s = t.sales(*_PROFILE).withColumn("customer_key", F.when(F.col("branch") != 4, F.col("customer_key")))
    return quality.profile_columns(s, _PROFILE).withColumnRenamed("column", "column_name")


@query(
    "top_values",
    "value:s n:i",
    f"WITH {SALES} SELECT CAST(customer_key AS VARCHAR) AS value, count(*) AS n FROM sales GROUP BY 1 ORDER BY n DESC, value LIMIT 10",
)
def top_values(t):
    return quality.top_values(t.sales("customer_key"), "customer_key")


@query(
    "profile_table",
    "rows:i duplicate_rows:i null_cells:i parse_rate:f first_day:d last_day:d days:i invoices:i products:i flags:a",
    f"""WITH {SALES}, d AS (SELECT transaction_number, product_id, sale_date FROM sales),
 c AS (SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS duplicate_rows, min(sale_date) AS first_day, max(sale_date) AS last_day,
   count(DISTINCT sale_date) AS days, count(DISTINCT transaction_number) AS invoices, count(DISTINCT product_id) AS products FROM d)
 SELECT *, 0 AS null_cells, 1.0 AS parse_rate, list_filter([CASE WHEN rows < 5000 THEN 'small_row_count' END, CASE WHEN days < 180 THEN 'short_or_sparse_date_history' END,
   CASE WHEN last_day - first_day < 365 THEN 'less_than_one_year_history' END, CASE WHEN invoices = rows THEN 'exactly_one_row_per_invoice' END,
   CASE WHEN duplicate_rows = 0 THEN 'no_exact_duplicates' END, 'no_nulls', CASE WHEN products <= 20 THEN 'very_small_product_catalog' END], lambda x: x IS NOT NULL) AS flags FROM c""",
)
def profile_table(t):
    s = t.sales("transaction_number", "product_id", "sale_date")
    return quality.profile_table(s, F.col("sale_date"), "transaction_number", "product_id", s.columns)


_LAGS = (1, 2, 3, 7, 14, 28, 56)


@query(
    "autocorrelation",
    "lag:i autocorrelation:f",
    f"WITH {COMPANY}, l AS (SELECT sales, {', '.join(f'(lag(sales, {k}) OVER (ORDER BY date)) AS l{k}' for k in _LAGS)} FROM company) "
    + " UNION ALL ".join(f"SELECT {k} AS lag, corr(sales, l{k}) AS autocorrelation FROM l" for k in _LAGS),
)
def autocorrelation(t):
    return quality.autocorrelation(base.company_day(t), "date", "sales", _LAGS)


@query(
    "variance_explained",
    "grouping_name:s explained:f",
    f"""WITH {COMPANY}, l AS (SELECT 'weekday' AS grouping_name, isodow(date) AS g, sales FROM company UNION ALL SELECT 'month', month(date), sales FROM company UNION ALL SELECT 'year', year(date), sales FROM company),
 m AS (SELECT avg(sales) AS mu, sum((sales - (SELECT avg(sales) FROM company)) * (sales - (SELECT avg(sales) FROM company))) AS tot FROM company),
 b AS (SELECT grouping_name, g, count(*) AS n, avg(sales) AS a FROM l GROUP BY 1, 2)
 SELECT grouping_name, sum(n * (a - mu) * (a - mu)) / any_value(tot) AS explained FROM b, m GROUP BY 1""",
)
def variance_explained(t):
    groups = {"weekday": F.weekday("date"), "month": F.month("date"), "year": F.year("date")}
    return quality.variance_explained(base.company_day(t), "sales", groups).withColumnRenamed("grouping", "grouping_name")


@query(
    "entity_outcomes",
    "entity:s rows:i declines:i decline_rate:f red_tp:i red_fp:i amber_tp:i amber_fp:i green_fn:i green_tn:i positive_min:f negative_p95:f negative_p99:f positive_median:f",
    f"""WITH {scores_sql()}, s AS (SELECT *, CASE WHEN score >= 0.6 THEN 'RED' WHEN score >= 0.5 THEN 'AMBER' ELSE 'GREEN' END AS st FROM scores)
 SELECT entity, count(*) AS rows, sum(y) AS declines, avg(y) AS decline_rate, count(*) FILTER (st = 'RED' AND y = 1) AS red_tp, count(*) FILTER (st = 'RED' AND y = 0) AS red_fp,
   count(*) FILTER (st = 'AMBER' AND y = 1) AS amber_tp, count(*) FILTER (st = 'AMBER' AND y = 0) AS amber_fp, count(*) FILTER (st = 'GREEN' AND y = 1) AS green_fn,
   count(*) FILTER (st = 'GREEN' AND y = 0) AS green_tn, min(score) FILTER (y = 1) AS positive_min, quantile_cont(score, 0.95) FILTER (y = 0) AS negative_p95,
   quantile_cont(score, 0.99) FILTER (y = 0) AS negative_p99, quantile_cont(score, 0.5) FILTER (y = 1) AS positive_median FROM s GROUP BY 1""",
)
def entity_outcomes(t):
    return quality.entity_outcomes(base.scores(t), "entity", "y", "score", 0.5, 0.6)


@query(
    "external_gate",
    "branch:i row_count:i invalid_date_rows:i distinct_days:i transactions:i span_days:i missing_ratio:f eligible:b grade:s reasons:a warnings:a",
    f"""WITH {SALES}, s AS (SELECT branch, CASE WHEN branch = 3 AND quantity < 3 OR branch = 4 AND quantity = 50 AND line_number = 2 THEN NULL ELSE sale_date END AS d, transaction_number AS t FROM sales),
 m AS (SELECT branch, count(*) AS row_count, count(*) FILTER (d IS NULL) AS invalid_date_rows, count(DISTINCT d) AS distinct_days, count(DISTINCT t) AS transactions, max(d) - min(d) + 1 AS span_days FROM s GROUP BY 1),
 r AS (SELECT *, (span_days - distinct_days) / CAST(span_days AS DOUBLE) AS missing_ratio FROM m),
 x AS (SELECT *, list_filter([CASE WHEN span_days < 365 THEN 'insufficient_time_span' END, CASE WHEN distinct_days < 300 THEN 'insufficient_distinct_calendar_days' END,
   CASE WHEN transactions < 1000 THEN 'insufficient_unique_transactions' END, CASE WHEN missing_ratio > 0.5 THEN 'excessive_calendar_gaps' END,
   CASE WHEN invalid_date_rows / CAST(row_count AS DOUBLE) > 0.01 THEN 'too_many_invalid_dates' END], lambda x: x IS NOT NULL) AS reasons,
   list_filter([CASE WHEN invalid_date_rows > 0 AND invalid_date_rows / CAST(row_count AS DOUBLE) <= 0.01 THEN 'some_invalid_dates' END, 'missing_product_identifier',
   'provenance_and_freshness_must_be_verified_separately'], lambda x: x IS NOT NULL) AS warnings FROM r)
 SELECT *, len(reasons) = 0 AS eligible, CASE WHEN len(reasons) = 0 THEN 'ELIGIBLE_FOR_BLIND_EVALUATION' ELSE 'REJECT' END AS grade FROM x""",
)
def external_gate(t):
    s = t.sales("branch", "sale_date", "transaction_number", "quantity", "line_number")
    bad = ((F.col("branch") == 3) & (F.col("quantity") < 3)) | (
        (F.col("branch") == 4) & (F.col("quantity") == 50) & (F.col("line_number") == 2)
    )
    return quality.external_gate(
        s, F.when(~bad, F.col("sale_date")), F.col("transaction_number"), True, False, by=["branch"], max_missing=0.5
    )


@query(
    "panel_gate",
    "check_name:s passed:b",
    f"""WITH {panel_sql()}, s AS (SELECT count(*) AS rows, count(DISTINCT entity) AS e, count(DISTINCT date) AS d, count(*) - count(DISTINCT entity || CAST(date AS VARCHAR)) AS dup,
   count(*) FILTER (sales IS NULL) + count(*) FILTER (invoices IS NULL) AS nulls, avg(structural_zero) AS z FROM panel)
 SELECT 'expected_entities' AS check_name, e = 6 AS passed FROM s UNION ALL SELECT 'enough_days', d >= 600 FROM s UNION ALL SELECT 'enough_rows', rows >= 20000 FROM s
 UNION ALL SELECT 'no_duplicates', dup = 0 FROM s UNION ALL SELECT 'no_core_nulls', nulls = 0 FROM s UNION ALL SELECT 'few_structural_zeros', z < 0.05 FROM s""",
)
def panel_gate(t):
    bounds = {"entities": 6, "min_days": 600, "min_rows": 20000, "max_zero_rate": 0.05}
    return quality.panel_gate(base.day_panel(t, measures=("sales", "invoices")), "entity", "date", ["sales", "invoices"], bounds).withColumnRenamed("check", "check_name")


_MELT = " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS v, date FROM scores" for f in FEATURES)


@query(
    "drift",
    "feature:s mean_a:f mean_b:f smd:f abs_smd:f edge_share:f",
    f"""WITH {scores_sql()}, l AS ({_MELT}), b AS (SELECT feature, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM l WHERE date < DATE '1999-01-01' GROUP BY 1),
 s AS (SELECT l.feature, avg(v) FILTER (date < DATE '1999-01-01') AS mean_a, avg(v) FILTER (date >= DATE '1999-01-01') AS mean_b, var_pop(v) FILTER (date < DATE '1999-01-01') AS va, var_pop(v) FILTER (date >= DATE '1999-01-01') AS vb,
   avg(CAST(v <= lo + 1e-12 OR v >= hi - 1e-12 AS DOUBLE)) FILTER (date >= DATE '1999-01-01') AS edge_share FROM l JOIN b USING (feature) GROUP BY 1)
 SELECT *, (mean_b - mean_a) / sqrt((va + vb) / 2) AS smd, abs((mean_b - mean_a) / sqrt((va + vb) / 2)) AS abs_smd FROM s""",
)
def drift(t):
    from ebbtide.operators.ordering import exact_quantiles, melt

    s = base.scores(t)
    a, b = s.where("date < date'1999-01-01'"), s.where("date >= date'1999-01-01'")
    bounds = exact_quantiles(melt(a, [], FEATURES), "value", [0.01, 0.99], ["feature"]).select(
        "feature", F.col("q1").alias("low"), F.col("q99").alias("high")
    )
    return quality.drift(a, b, FEATURES, bounds)


_OOD = f"""{scores_sql()}, l AS ({_MELT}), q AS (SELECT feature, quantile_cont(v, 0.01) AS q01, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q75, quantile_cont(v, 0.99) AS q99 FROM l WHERE date < DATE '1999-01-01' GROUP BY 1),
 prof AS (SELECT feature, median, q01 - 0.75 * greatest(q75 - q25, 1e-9) AS low, q99 + 0.75 * greatest(q75 - q25, 1e-9) AS high FROM q)"""


@query("ood_profile", "feature:s median:f low:f high:f", f"WITH {_OOD} SELECT * FROM prof")
def ood_profile(t):
    return quality.ood_profile(base.scores(t).where("date < date'1999-01-01'"), FEATURES)


@query(
    "ood_fraction",
    "entity:s date:d ood_fraction:f",
    f"""WITH {_OOD}, x AS ({' UNION ALL '.join(f"SELECT entity, date, '{f}' AS feature, CASE WHEN '{f}' = 'score_b' AND r > 1.5 THEN NULL ELSE {f} END AS v FROM scores" for f in FEATURES)})
 SELECT entity, date, avg(CAST(v IS NULL OR v < low OR v > high AS DOUBLE)) AS ood_fraction FROM x JOIN prof USING (feature) GROUP BY 1, 2""",
)
def ood_fraction(t):
    s = base.scores(t)
    profile = quality.ood_profile(s.where("date < date'1999-01-01'"), FEATURES)
    s = s.withColumn("score_b", F.when(~(F.col("r") > 1.5), F.col("score_b")))
    return quality.ood_fraction(s, ["entity", "date"], FEATURES, profile)
