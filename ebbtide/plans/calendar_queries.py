"""Calendar columns, row formulas, counted signals and weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbtide.functions import calendar, scalars
from ebbtide.operators import evidence, mix, panels
from ebbtide.operators.windows import Series
from ebbtide.plans import base
from ebbtide.plans.base import COMPANY, SALES, panel_sql, scores_sql, week_panel_sql
from ebbtide.plans.registry import query
from ebbtide.plans.window_queries import change, lag, pct, roll

EVENTS = ["1995-03-03", "1996-02-21", "1997-02-09", "1998-01-30", "1999-01-19", "2000-01-08", "2000-12-28"]
FASTS = {
    "fast": [("1996-01-22", "1996-02-20"), ("1997-01-10", "1997-02-08")],
    "feast": [("1996-02-21", "1996-02-23"), ("1997-02-09", "1997-02-11")],
}


def days(t):
    return base.company_day(t)


@query("week_start_sunday", "date:d week_start:d", f"WITH {COMPANY} SELECT date, date - CAST(dayofweek(date) AS INTEGER) AS week_start FROM company")
def week_start_sunday(t):
    return base.with_week(days(t))


_H = (1, 2, 3)


def _cyc(name, pos, period, k):
    suffix = "" if k == 1 else str(k)
    return f"sin(2 * {k} * pi() * ({pos}) / {period}) AS {name}_sin{suffix}, cos(2 * {k} * pi() * ({pos}) / {period}) AS {name}_cos{suffix}"


@query(
    "cyclic",
    "date:d dow_sin:f dow_cos:f month_sin:f month_cos:f "
    + " ".join(f"{n}_{f}{'' if k == 1 else k}:f" for n in ("year", "week") for k in _H for f in ("sin", "cos")),
    f"WITH {COMPANY} SELECT date, {_cyc('dow', '(isodow(date) - 1)', '7.0', 1)}, {_cyc('month', '(month(date) - 1)', '12.0', 1)}, "
    + ", ".join(_cyc("year", "dayofyear(date)", "365.25", k) for k in _H)
    + ", "
    + ", ".join(_cyc("week", "weekofyear(date)", "52.18", k) for k in _H)
    + " FROM company",
)
def cyclic(t):
    return calendar.cyclic(days(t), "date", _H)


@query(
    "calendar_flags",
    "date:d weekend:i salary_25_28:i salary_24_31:i salary_25_03:i founding_day:i founding_window:i national_day:i national_window:i month_start:i month_end:i summer:i year_end:i",
    f"""WITH {COMPANY}, d AS (SELECT date, day(date) AS dom, month(date) AS m FROM company)
 SELECT date, CAST(isodow(date) IN (5, 6) AS INTEGER) AS weekend, CAST(dom BETWEEN 25 AND 28 AS INTEGER) AS salary_25_28, CAST(dom BETWEEN 24 AND 31 AS INTEGER) AS salary_24_31,
   CAST(dom >= 25 OR dom <= 3 AS INTEGER) AS salary_25_03, CAST(m = 2 AND dom = 22 AS INTEGER) AS founding_day, CAST(m = 2 AND dom BETWEEN 15 AND 29 AS INTEGER) AS founding_window,
   CAST(m = 9 AND dom = 23 AS INTEGER) AS national_day, CAST(m = 9 AND dom BETWEEN 16 AND 30 AS INTEGER) AS national_window, CAST(dom <= 3 AS INTEGER) AS month_start,
   CAST(dom >= day(last_day(date)) - 2 AS INTEGER) AS month_end, CAST(m IN (6, 7, 8) AS INTEGER) AS summer, CAST(m = 12 AND dom >= 20 AS INTEGER) AS year_end FROM d""",
)
def calendar_flags(t):
    return calendar.calendar_flags(days(t), "date")


_EV = ", ".join(f"DATE '{e}'" for e in EVENTS)


@query(
    "event_windows",
    "date:d event_pre:i event_day:i event_post:i days_to_event:f fast_day:i fast_third:i",
    f"""WITH {COMPANY}, e AS (SELECT unnest([{_EV}]) AS e),
 x AS (SELECT date, max(CAST(e - date BETWEEN 1 AND 7 AS INTEGER)) AS event_pre, max(CAST(e = date AS INTEGER)) AS event_day,
   max(CAST(date - e BETWEEN 1 AND 3 AS INTEGER)) AS event_post, min(CASE WHEN e >= date THEN e - date END) AS nxt FROM company, e GROUP BY 1),
 f(s, t) AS (VALUES {', '.join(f"(DATE '{s}', DATE '{t}')" for s, t in FASTS['fast'])})
 SELECT date, event_pre, event_day, event_post, least(coalesce(nxt, 60), 60) / 60.0 AS days_to_event,
   coalesce(date - f.s + 1, 0) AS fast_day, coalesce(CAST(floor((date - f.s) * 3 / CAST(f.t - f.s + 1 AS DOUBLE)) AS INTEGER) + 1, 0) AS fast_third
 FROM x LEFT JOIN f ON date BETWEEN f.s AND f.t""",
)
def event_windows(t):
    d = calendar.event_windows(days(t), "date", EVENTS)
    return calendar.window_progress(d, "date", FASTS["fast"], "fast")


SPANS = {"before7": (-7, -1), "day0_3": (0, 3), "after7": (4, 10)}


@query(
    "season_features",
    "date:d fast_runs:i fast_share:f fast_first10:i fast_middle10:i fast_last10:i fast_sin:f fast_cos:f before7:i day0_3:i after7:i special:i",
    f"""WITH {COMPANY}, e AS (SELECT unnest([{_EV}]) AS e),
 x AS (SELECT date, {', '.join(f"max(CAST(date - e BETWEEN {lo} AND {hi} AS INTEGER)) AS {n}" for n, (lo, hi) in SPANS.items())} FROM company, e GROUP BY 1),
 f(s, t) AS (VALUES {', '.join(f"(DATE '{s}', DATE '{t}')" for s, t in FASTS['fast'])}), n AS (SELECT x.*, coalesce(date - f.s + 1, 0) AS n FROM x LEFT JOIN f ON date BETWEEN f.s AND f.t)
 SELECT date, CAST(n > 0 AS INTEGER) AS fast_runs, n / 30.0 AS fast_share, CAST(n BETWEEN 1 AND 10 AS INTEGER) AS fast_first10, CAST(n BETWEEN 11 AND 20 AS INTEGER) AS fast_middle10,
   CAST(n BETWEEN 21 AND 30 AS INTEGER) AS fast_last10, CASE WHEN n > 0 THEN sin(2 * pi() * n / 30.0) ELSE 0 END AS fast_sin, CASE WHEN n > 0 THEN cos(2 * pi() * n / 30.0) ELSE 0 END AS fast_cos,
   before7, day0_3, after7, greatest(CAST(n > 0 AS INTEGER), before7, day0_3, after7) AS special FROM n""",
)
def season_features(t):
    d = calendar.window_phase(calendar.anchor_spans(days(t), "date", EVENTS, SPANS), "date", FASTS["fast"], "fast")
    return d.withColumn("special", F.greatest("fast_runs", *SPANS))


@query(
    "next7_counts",
    "date:d fast_next7:i feast_next7:i weekend_next7:i",
    f"WITH {COMPANY}, n AS (SELECT date, unnest([1, 2, 3, 4, 5, 6, 7]) AS k FROM company), a AS (SELECT date, date + CAST(k AS INTEGER) AS x FROM n) SELECT date, "
    + ", ".join(
        f"sum(CAST({' OR '.join(chr(40) + f'x BETWEEN DATE {chr(39)}{s}{chr(39)} AND DATE {chr(39)}{e}{chr(39)}' + chr(41) for s, e in w)} AS INTEGER)) AS {n}_next7"
        for n, w in FASTS.items()
    )
    + ", sum(CAST(isodow(x) IN (5, 6) AS INTEGER)) AS weekend_next7 FROM a GROUP BY 1",
)
def next7_counts(t):
    return calendar.next7_counts(days(t), "date", FASTS)


@query(
    "ratio_to_risk",
    "entity:s date:d risk:f narrow:f",
    f"""WITH {scores_sql()} SELECT entity, date, 1 / (1 + exp(greatest(-30, least(30, (r - 0.85) / 0.08)))) AS risk,
   1 / (1 + exp(greatest(-30, least(30, (r - 0.85) / 0.005)))) AS narrow FROM scores""",
)
def ratio_to_risk(t):
    return base.scores(t).withColumns(
        {"risk": scalars.ratio_to_risk(F.col("r")), "narrow": scalars.ratio_to_risk(F.col("r"), 0.85, 0.005)}
    )


@query(
    "safe_ratio",
    "entity:s date:d per_invoice:f2 per_line_floor:f2",
    f"WITH {panel_sql()} SELECT entity, date, sales / nullif(invoices, 0) AS per_invoice, sales / greatest(lines, 1.0) AS per_line_floor FROM panel",
)
def safe_ratio(t):
    return base.day_panel(t).select(
        "entity",
        "date",
        scalars.safe_ratio(F.col("sales"), F.col("invoices")).alias("per_invoice"),
        (F.col("sales") / F.greatest(F.col("lines"), F.lit(1.0))).alias("per_line_floor"),
    )


@query(
    "severity",
    "entity:s date:d severity:s alert_severity:s",
    f"""WITH {panel_sql()}, c AS (SELECT entity, date, {change('gross', 7)} * 100 AS c FROM panel), d AS (SELECT *, greatest(-c, 0) AS drop FROM c WHERE c IS NOT NULL)
 SELECT entity, date, CASE WHEN drop >= 25 THEN 'high' WHEN drop >= 10 THEN 'medium' ELSE 'low' END AS severity,
   CASE WHEN drop >= 20 AND drop / 100 >= 0.7 THEN 'high' WHEN drop >= 20 THEN 'medium' ELSE 'low' END AS alert_severity FROM d""",
)
def severity(t):
    s = Series("entity", "date")
    d = base.gross_days(t).select("entity", "date", (s.change("gross", 7) * 100).alias("c")).where("c is not null")
    drop = F.greatest(-F.col("c"), F.lit(0.0))
    return d.withColumns(
        {
            "severity": scalars.severity(F.col("c")),
            "alert_severity": scalars.alert_severity(drop >= 20, drop / 100),
        }
    )


@query(
    "wilson",
    "entity:s rate:f low:f high:f",
    f"""WITH {scores_sql()}, g AS (SELECT entity, CAST(sum(y) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n FROM scores GROUP BY 1),
 p AS (SELECT *, k / n AS p, 1.959963984540054 AS z FROM g)
 SELECT entity, p AS rate, ((p + z * z / (2 * n)) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n) AS low,
   ((p + z * z / (2 * n)) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n) AS high FROM p""",
)
def wilson(t):
    g = base.scores(t).groupBy("entity").agg(F.sum("y").alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = scalars.wilson(F.col("k"), F.col("n"))
    return g.select("entity", (F.col("k") / F.col("n")).alias("rate"), low.alias("low"), high.alias("high"))


def _weekly(col, name):
    w = "week_start"
    return (
        f"{col} / nullif({roll('avg', col, 4, w)}, 0) AS {name}_ratio_mean_4, {pct(col, 1)} AS {name}_change_1, {pct(col, 2)} AS {name}_change_2, "
        f"(CASE WHEN count(*) OVER (PARTITION BY entity ORDER BY {w} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) = 4 THEN "
        f"(1.5 * {col} + 0.5 * {lag(col, 1, w)} - 0.5 * {lag(col, 2, w)} - 1.5 * {lag(col, 3, w)}) / 5 END) / abs({roll('avg', col, 4, w)}) AS {name}_slope_4, "
        f"{pct(name + '_share', 4)} AS {name}_share_change_4"
    )


_SIGNALS = f"""{week_panel_sql()}, sh AS (SELECT *, gross / nullif(sum(gross) OVER (PARTITION BY week_start), 0) AS value_share,
   lines / nullif(sum(lines) OVER (PARTITION BY week_start), 0) AS count_share FROM wpanel),
 sig AS (SELECT entity, week_start, gross, {_weekly('gross', 'value')}, {_weekly('lines', 'count')} FROM sh)"""


def count_sql(signals):
    return " + ".join(f"coalesce(CAST({n} < {c} AS INTEGER), 0)" for n, c in signals)


def weekly_signals(t):
    return evidence.weekly_signals(
        base.week_panel(t, measures=("gross", "lines")).select("entity", "week_start", "gross", "lines"), "entity", "week_start", "gross", "lines"
    )


@query(
    "precursor_and_evidence",
    "entity:s week_start:d precursors:i evidence:i",
    f"WITH {_SIGNALS} SELECT entity, week_start, {count_sql(evidence.PRECURSORS)} AS precursors, {count_sql(evidence.EVIDENCE)} AS evidence FROM sig",
)
def precursor_and_evidence(t):
    return weekly_signals(t).select(
        "entity",
        "week_start",
        evidence.signal_count(evidence.PRECURSORS).alias("precursors"),
        evidence.signal_count(evidence.EVIDENCE).alias("evidence"),
    )


_HARD = [
    "short_long_change_gap", "day_week_gap", "week_fortnight_gap", "ratio_7_28_gap", "ratio_7_14_gap", "z_7_28_gap", "vs_market",
    "vs_invoices", "vs_customers", "vs_products", "breadth_mean", "breadth_strength", "breadth_minus_shock", "rebound",
    "persistent", "temporary", "return_distortion", "consensus",
]


def merchant_features(t):
    """Company features and category breadth per day."""
    panel = base.day_panel(t)
    s = Series("entity", "date")
    cat = panel.select(
        "entity", "date",
        s.ratio_to_mean("gross", 7).alias("r7"), s.change("gross", 7).alias("c7"),
        s.change("invoices", 7).alias("i7"), s.change("customers", 7).alias("u7"),
    )
    share = mix.breadth(cat, "date", "r7", "c7")
    more = cat.groupBy("date").agg(
        F.avg(F.coalesce(F.col("i7") < 0, F.lit(False)).cast("double")).alias("negative_invoices"),
        F.avg(F.coalesce(F.col("u7") < 0, F.lit(False)).cast("double")).alias("negative_customers"),
    )
    total = panels.merchant_rollup(panel, "date")
    m = Series([], "date")
    feats = total.select(
        "date",
        *[m.change("gross", k).alias(f"change_{k}") for k in (1, 7, 14, 28)],
        *[m.ratio_to_mean("gross", k).alias(f"ratio_{k}") for k in (7, 14, 28)],
        *[m.zscore("gross", k).alias(f"z_{k}") for k in (7, 28)],
        m.change("units", 7).alias("market_7"),
        m.change("invoices", 7).alias("invoices_7"),
        m.change("customers", 7).alias("customers_7"),
        m.change("products", 7).alias("products_7"),
        m.change("return_rate", 7).alias("returns_7"),
    )
    return feats.join(share, "date").join(more, "date").withColumnsRenamed(
        {"negative": "negative_sales", "severe": "severe_sales"}
    ).where("change_28 is not null and z_28 is not null and returns_7 is not null")


def _m(fn, *a):
    return fn(*a, part="")


MERCHANT = f"""{panel_sql()}, cat AS (SELECT entity, date, gross / nullif({roll('avg', 'gross', 7)}, 0) AS r7, {change('gross', 7)} AS c7, {change('invoices', 7)} AS i7, {change('customers', 7)} AS u7 FROM panel),
 br AS (SELECT date, {', '.join(f"avg(CAST(coalesce({c}, false) AS DOUBLE)) AS {n}" for n, c in (('below_090', 'r7 < 0.9'), ('below_100', 'r7 < 1'), ('above_110', 'r7 > 1.1'), ('negative_sales', 'c7 < 0'), ('severe_sales', 'c7 < -0.15'), ('negative_invoices', 'i7 < 0'), ('negative_customers', 'u7 < 0')))} FROM cat GROUP BY 1),
 tot AS (SELECT date, sum(gross) AS gross, sum(units) AS units, sum(invoices) AS invoices, sum(customers) AS customers, sum(products) AS products, sum(returns) / greatest(sum(gross), 1.0) AS return_rate FROM panel GROUP BY 1),
 mf AS (SELECT date, {', '.join(f"{change('gross', k, part='')} AS change_{k}" for k in (1, 7, 14, 28))},
   {', '.join(f"gross / nullif({roll('avg', 'gross', k, part='')}, 0) AS ratio_{k}" for k in (7, 14, 28))},
   {', '.join(f"(gross - {roll('avg', 'gross', k, part='')}) / nullif({roll('stddev_samp', 'gross', k, part='')}, 0) AS z_{k}" for k in (7, 28))},
   {change('units', 7, part='')} AS market_7, {change('invoices', 7, part='')} AS invoices_7, {change('customers', 7, part='')} AS customers_7,
   {change('products', 7, part='')} AS products_7, {change('return_rate', 7, part='')} AS returns_7 FROM tot),
 mer AS (SELECT * FROM mf JOIN br USING (date) WHERE change_28 IS NOT NULL AND z_28 IS NOT NULL AND returns_7 IS NOT NULL)"""


@query(
    "hard_negative_features",
    "date:d " + " ".join(f"{h}:f" for h in _HARD),
    f"""WITH {MERCHANT} SELECT date, change_7 - change_28 AS short_long_change_gap, change_1 - change_7 AS day_week_gap, change_7 - change_14 AS week_fortnight_gap,
   ratio_7 - ratio_28 AS ratio_7_28_gap, ratio_7 - ratio_14 AS ratio_7_14_gap, z_7 - z_28 AS z_7_28_gap, change_7 - market_7 AS vs_market, change_7 - invoices_7 AS vs_invoices,
   change_7 - customers_7 AS vs_customers, change_7 - products_7 AS vs_products, (negative_sales + negative_invoices + negative_customers) / 3 AS breadth_mean,
   (negative_sales + severe_sales + below_090) / 3 AS breadth_strength, negative_sales - greatest(-change_7, 0) AS breadth_minus_shock,
   greatest(-change_1, 0) * greatest(change_7 - change_1, 0) AS rebound, greatest(-change_7, 0) * greatest(-change_14, 0) * (0.5 + negative_sales) AS persistent,
   greatest(-change_7, 0) * least(2, greatest(0, above_110 + (1 - negative_sales))) AS temporary, abs(returns_7) * greatest(-change_7, 0) AS return_distortion,
   (sign(-change_7) + sign(-invoices_7) + sign(-customers_7) + sign(-products_7)) / 4 AS consensus FROM mer""",
)
def hard_negative_features(t):
    return evidence.hard_negative_features(merchant_features(t))


@query(
    "severity_class",
    "entity:s date:d three:i four:i",
    f"""WITH {scores_sql()} SELECT entity, date, CAST(future_ratio < 0.7 AS INTEGER) + CAST(future_ratio < 0.85 AS INTEGER) AS three,
   CAST(future_ratio < 0.7 AS INTEGER) + CAST(future_ratio < 0.85 AS INTEGER) + CAST(future_ratio < 1.1 AS INTEGER) AS four FROM scores""",
)
def severity_class(t):
    r = F.col("future_ratio")
    return base.scores(t).withColumns(
        {"three": scalars.severity_class(r, (0.70, 0.85)), "four": scalars.severity_class(r, (0.70, 0.85, 1.10))}
    )


_PROFILES = {
    "baseline": "greatest(0.55, least(1.65, 0.55 + abs(r - 0.85) / 0.12))",
    "soft_band": "(CASE WHEN r > 0.82 AND r < 0.9 THEN 0.35 ELSE 1 END) * (CASE WHEN r <= 0.78 THEN 1.25 ELSE 1 END) * (CASE WHEN r >= 0.94 THEN 1.1 ELSE 1 END)",
    "strong_band": "(CASE WHEN r > 0.8 AND r < 0.9 THEN 0.2 ELSE 1 END) * (CASE WHEN r <= 0.78 THEN 1.4 ELSE 1 END) * (CASE WHEN r >= 0.95 THEN 1.15 ELSE 1 END)",
    "asymmetric": "(CASE WHEN y = 0 AND r >= 0.85 AND r < 0.92 THEN 0.28 ELSE 1 END) * (CASE WHEN y = 1 AND r > 0.8 THEN 0.45 ELSE 1 END) * (CASE WHEN r <= 0.78 THEN 1.35 ELSE 1 END) * (CASE WHEN r >= 0.95 THEN 1.1 ELSE 1 END)",
}


@query(
    "sample_weight",
    "entity:s date:d w_none:f w_baseline:f w_soft_band:f w_strong_band:f w_asymmetric:f",
    f"""WITH {scores_sql()}, s AS (SELECT entity, date, y, future_ratio AS r FROM scores), c AS (SELECT sum(1 - y) / CAST(sum(y) AS DOUBLE) AS b FROM s)
 SELECT entity, date, 1 AS w_none, {', '.join(f"CAST((CASE WHEN y = 1 THEN b ELSE 1 END) * {e} AS DOUBLE) AS w_{n}" for n, e in _PROFILES.items())} FROM s, c""",
)
def sample_weight(t):
    d = base.scores(t)
    for p in ("none", *_PROFILES):
        d = evidence.sample_weight(d, "y", "future_ratio", p, f"w_{p}")
    return d


@query(
    "class_weights",
    "cls:i class_weight:f",
    f"""WITH {scores_sql()}, c AS (SELECT CAST(future_ratio < 0.7 AS INTEGER) + CAST(future_ratio < 0.85 AS INTEGER) AS cls, count(*) AS n FROM scores GROUP BY 1)
 SELECT cls, (SELECT sum(n) FROM c) / CAST((SELECT count(*) FROM c) * n AS DOUBLE) AS class_weight FROM c""",
)
def class_weights(t):
    d = base.scores(t).withColumn("cls", scalars.severity_class(F.col("future_ratio"), (0.70, 0.85)))
    return evidence.class_weights(d, "cls")


@query(
    "ordinal",
    "rank:i n:i",
    "SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 4 WHEN '4-NOT SPECIFIED' THEN 1 ELSE 3 END AS rank, count(*) AS n FROM orders GROUP BY 1",
)
def ordinal(t):
    rank = scalars.ordinal(F.col("o_orderpriority"), {"1-urgent": 5, "2-High": 4, "4-not specified": 1})
    return t.read("orders").select(rank.alias("rank")).groupBy("rank").agg(F.count(F.lit(1)).alias("n"))


@query(
    "one_hot",
    "entity:s n:i seg_AUTOMOBILE:f seg_BUILDING:f seg_MACHINERY:f",
    f"""WITH {SALES} SELECT channel AS entity, count(*) AS n, avg(CAST(channel = 'AUTOMOBILE' AS DOUBLE)) AS seg_AUTOMOBILE,
   avg(CAST(channel = 'BUILDING' AS DOUBLE)) AS seg_BUILDING, avg(CAST(channel = 'MACHINERY' AS DOUBLE)) AS seg_MACHINERY FROM sales GROUP BY 1""",
)
def one_hot(t):
    values = ["MACHINERY", "AUTOMOBILE", "BUILDING"]
    d = scalars.one_hot(t.sales("channel").withColumnRenamed("channel", "entity"), "entity", values, "seg")
    return d.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"seg_{v}").alias(f"seg_{v}") for v in values])


@query(
    "odds_shift",
    "entity:s date:d shifted:f",
    f"""WITH {scores_sql()}, q AS (SELECT entity, date, greatest(1e-6, least(1 - 1e-6, score)) AS p FROM scores),
 o AS (SELECT *, p / (1 - p) * (0.05 / 0.95) / (0.3 / 0.7) AS o FROM q) SELECT entity, date, o / (1 + o) AS shifted FROM o""",
)
def odds_shift(t):
    return base.scores(t).withColumn("shifted", scalars.odds_shift(F.col("score"), F.lit(0.3), F.lit(0.05)))


@query(
    "run_json",
    "mode:s horizon:i n:i",
    f"""SELECT CASE WHEN o_orderpriority = '5-LOW' THEN 'seed' ELSE 'imported' END AS mode, CASE WHEN o_orderstatus = 'F' THEN 30 ELSE 7 END AS horizon, count(*) AS n FROM orders GROUP BY ALL""",
)
def run_json(t):
    mode = F.when(F.col("o_orderpriority") == "5-LOW", "seed").otherwise("imported")
    horizon = F.when(F.col("o_orderstatus") == "F", 30).otherwise(7)
    filters = t.read("orders").select(F.to_json(F.struct(mode.alias("data_mode"), F.struct(horizon.alias("days")).alias("run"))).alias("j"))
    read = filters.select(
        F.get_json_object("j", "$.data_mode").alias("mode"), F.get_json_object("j", "$.run.days").cast("int").alias("horizon")
    )
    return read.groupBy("mode", "horizon").agg(F.count(F.lit(1)).alias("n"))


@query(
    "operational_score",
    "date:d merchant_evidence:f category_breadth:f rich_evidence:f operational_score:f",
    f"""WITH {MERCHANT}, ref AS (SELECT quantile_cont(severe_sales, 0.8) AS a, quantile_cont(negative_customers, 0.8) AS b FROM mer WHERE date < DATE '1998-01-01'),
 e AS (SELECT date, (CAST(ratio_7 < 0.95 AS INTEGER) + CAST(ratio_28 < 0.95 AS INTEGER) + CAST(change_7 < -0.05 AS INTEGER) + CAST(change_28 < -0.05 AS INTEGER)) / 4.0 AS merchant_evidence,
   (CAST(ratio_14 < 0.92 AS INTEGER) + CAST(change_14 < -0.08 AS INTEGER)) / 2.0 AS category_breadth,
   (CAST(ratio_7 < 0.9 AS INTEGER) + CAST(severe_sales > a AS INTEGER) + CAST(negative_customers > b AS INTEGER)) / 3.0 AS rich_evidence FROM mer, ref)
 SELECT *, 0.45 * merchant_evidence + 0.35 * category_breadth + 0.2 * rich_evidence AS operational_score FROM e""",
)
def operational_score(t):
    d = merchant_features(t)
    ref = evidence.operational_reference(d.where("date < date'1998-01-01'"), ["severe_sales", "negative_customers"])
    return evidence.operational_score(
        d, ref, ["ratio_7", "ratio_28"], ["change_7", "change_28"], ["ratio_14"], ["change_14"], ["ratio_7"],
        ["severe_sales", "negative_customers"],
    )
