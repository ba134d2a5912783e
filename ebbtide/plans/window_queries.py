"""Lags, rolling statistics, labels and memory features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbtide.functions.scalars import safe_ratio
from ebbtide.operators import history, windows
from ebbtide.operators.windows import Series, below
from ebbtide.plans import base
from ebbtide.plans.base import COMPANY, panel_sql, scores_sql, week_panel_sql
from ebbtide.plans.registry import query

DAY = Series("entity", "date")
WEEK = Series("entity", "week_start")
LAG_DAYS = (1, 2, 3, 7, 14, 21, 28, 35, 56)
LAG_WEEKS = (1, 2, 3, 4, 8, 13, 26, 52)


def day_panel(t, *measures):
    measures = measures or ("gross",)
    return base.day_panel(t, measures=measures).select("entity", "date", *measures)


def week_panel(t, *measures):
    measures = measures or ("gross",)
    return base.week_panel(t, measures=measures).select("entity", "week_start", *measures)


def frame(lo: int, hi: int, time: str = "date", part: str = "PARTITION BY entity ") -> str:
    """SQL frame from `lo` to `hi` rows relative to the current one."""

    def edge(k):
        return "CURRENT ROW" if k == 0 else f"{-k} PRECEDING" if k < 0 else f"{k} FOLLOWING"

    return f"({part}ORDER BY {time} ROWS BETWEEN {edge(lo)} AND {edge(hi)})"


def roll(fn, col, w, time="date", past=False, need=None, part="PARTITION BY entity "):
    f = frame(-w, -1, time, part) if past else frame(1 - w, 0, time, part)
    call = f"quantile_cont({col}, {fn})" if isinstance(fn, float) else f"{fn}({col})"
    return f"(CASE WHEN count({col}) OVER {f} >= {need or w} THEN {call} OVER {f} END)"


def lag(col, k, time="date", part="PARTITION BY entity "):
    return f"(lag({col}, {k}) OVER ({part}ORDER BY {time}))"


def change(col, k, time="date", part="PARTITION BY entity "):
    p = lag(col, k, time, part)
    return f"(({col} - {p}) / nullif(abs({p}), 0))"


def pct(col, k, time="week_start"):
    return f"({col} / nullif({lag(col, k, time)}, 0) - 1)"


def day_sql(columns: str) -> str:
    return f"WITH {panel_sql()} SELECT entity, date, {columns} FROM panel"


def week_sql(columns: str) -> str:
    return f"WITH {week_panel_sql()} SELECT entity, week_start, {columns} FROM wpanel"


@query(
    "lags_days",
    "entity:s date:d " + " ".join(f"gross_lag_{k}:f4" for k in LAG_DAYS),
    day_sql(", ".join(f"{lag('gross', k)} AS gross_lag_{k}" for k in LAG_DAYS)),
)
def lags_days(t):
    return windows.lags(day_panel(t), DAY, ["gross"], LAG_DAYS)


@query(
    "lags_weeks",
    "entity:s week_start:d " + " ".join(f"gross_lag_{k}:f4" for k in LAG_WEEKS),
    week_sql(", ".join(f"{lag('gross', k, 'week_start')} AS gross_lag_{k}" for k in LAG_WEEKS)),
)
def lags_weeks(t):
    return windows.lags(week_panel(t), WEEK, ["gross"], LAG_WEEKS)


_STATS = {"mean": "avg", "std": "stddev_samp", "median": 0.5, "max": "max"}


def _stat_sql(ws, time="date", past=False):
    tag = "past_" if past else ""
    return ", ".join(
        f"{roll(f, 'gross', w, time, past)} AS gross_{tag}{n}_{w}" for n, f in _STATS.items() for w in ws
    )


def _stat_cols(ws, past=False):
    tag = "past_" if past else ""
    digits = {"mean": "f0", "std": "f2", "median": "f1", "max": "f4"}
    return " ".join(f"gross_{tag}{n}_{w}:{digits[n]}" for n in _STATS for w in ws)


def _stats(df, s, ws, past=False):
    for n in _STATS:
        df = windows.rolling(df, s, ["gross"], ws, n, past)
    return df


@query("rolling_days", "entity:s date:d " + _stat_cols((7, 14, 28, 56)), day_sql(_stat_sql((7, 14, 28, 56))))
def rolling_days(t):
    return _stats(day_panel(t), DAY, (7, 14, 28, 56))


@query(
    "rolling_weeks",
    "entity:s week_start:d " + _stat_cols((4, 8, 13, 26, 52)),
    week_sql(_stat_sql((4, 8, 13, 26, 52), "week_start")),
)
def rolling_weeks(t):
    return _stats(week_panel(t), WEEK, (4, 8, 13, 26, 52))


@query(
    "rolling_past",
    "entity:s date:d " + _stat_cols((7, 14, 28, 56), True),
    day_sql(_stat_sql((7, 14, 28, 56), past=True)),
)
def rolling_past(t):
    return _stats(day_panel(t), DAY, (7, 14, 28, 56), True)


_LOOSE = {w: windows.store_min_rows(w) for w in (3, 7, 14, 28)}
_SECTOR = {w: windows.sector_min_rows(w) for w in (7, 28)}


@query(
    "rolling_loose",
    "entity:s date:d " + " ".join([f"gross_mean_{w}:f2" for w in _LOOSE] + [f"invoices_mean_{w}:f4" for w in _SECTOR]),
    day_sql(
        ", ".join(
            [f"{roll('avg', 'gross', w, need=m)} AS gross_mean_{w}" for w, m in _LOOSE.items()]
            + [f"{roll('avg', 'invoices', w, need=m)} AS invoices_mean_{w}" for w, m in _SECTOR.items()]
        )
    ),
)
def rolling_loose(t):
    d = windows.rolling(day_panel(t, "gross", "invoices"), DAY, ["gross"], list(_LOOSE), "mean", min_rows=_LOOSE)
    return windows.rolling(d, DAY, ["invoices"], list(_SECTOR), "mean", min_rows=_SECTOR)


@query(
    "safe_change",
    "entity:s date:d c1:f c7:f c28:f",
    day_sql(", ".join(f"{change('sales', k)} AS c{k}" for k in (1, 7, 28))),
)
def safe_change(t):
    return day_panel(t, "sales").withColumns({f"c{k}": DAY.change("sales", k) for k in (1, 7, 28)})


@query(
    "pct_change",
    "entity:s week_start:d p1:f p4:f p13:f",
    week_sql(", ".join(f"{pct('sales', k)} AS p{k}" for k in (1, 4, 13))),
)
def pct_change(t):
    return week_panel(t, "sales").withColumns({f"p{k}": WEEK.pct_change("sales", k) for k in (1, 4, 13)})


@query(
    "ratio_zscore_cv",
    "entity:s date:d ratio7:f ratio28:f z28:f cv28:f",
    day_sql(
        f"gross / nullif({roll('avg', 'gross', 7)}, 0) AS ratio7, gross / nullif({roll('avg', 'gross', 28)}, 0) AS ratio28, "
        f"(gross - {roll('avg', 'gross', 28)}) / nullif({roll('stddev_samp', 'gross', 28)}, 0) AS z28, "
        f"{roll('stddev_samp', 'gross', 28)} / nullif(abs({roll('avg', 'gross', 28)}), 0) AS cv28"
    ),
)
def ratio_zscore_cv(t):
    return day_panel(t).withColumns(
        {
            "ratio7": DAY.ratio_to_mean("gross", 7),
            "ratio28": DAY.ratio_to_mean("gross", 28),
            "z28": DAY.zscore("gross", 28),
            "cv28": DAY.variation("gross", 28),
        }
    )


@query(
    "slope",
    "entity:s week_start:d slope4:f slope8:f",
    f"""WITH {week_panel_sql()}, n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY week_start) AS i FROM wpanel)
 SELECT entity, week_start, """
    + ", ".join(
        f"(CASE WHEN count(*) OVER {frame(1 - w, 0, 'week_start')} = {w} THEN regr_slope(gross, i) OVER {frame(1 - w, 0, 'week_start')} END)"
        f" / abs({roll('avg', 'gross', w, 'week_start')}) AS slope{w}"
        for w in (4, 8)
    )
    + " FROM n",
)
def slope(t):
    return week_panel(t).withColumns({f"slope{w}": WEEK.slope("gross", w) for w in (4, 8)})


@query(
    "drawdown",
    "entity:s date:d dd28:f dd56:f",
    day_sql(", ".join(f"gross / nullif({roll('max', 'gross', w)}, 0) - 1 AS dd{w}" for w in (28, 56))),
)
def drawdown(t):
    return day_panel(t).withColumns({f"dd{w}": DAY.drawdown("gross", w) for w in (28, 56)})


@query(
    "same_weekday_mean",
    "entity:s date:d weekday_mean:f2 vs_weekday:f",
    f"""WITH {panel_sql()}, l AS (SELECT entity, date, gross, list_filter([{', '.join(lag('gross', k) for k in (7, 14, 21, 28))}], lambda x: x IS NOT NULL) AS v FROM panel)
 SELECT entity, date, list_avg(v) AS weekday_mean, gross / nullif(list_avg(v), 0) AS vs_weekday FROM l""",
)
def same_weekday_mean(t):
    return day_panel(t).withColumn("weekday_mean", DAY.same_weekday_mean("gross")).withColumn(
        "vs_weekday", safe_ratio(F.col("gross"), F.col("weekday_mean"))
    )


@query(
    "ma_and_vol_ratio",
    "entity:s date:d ma7_28:f ma14_56:f vol7_28:f",
    day_sql(
        f"{roll('avg', 'gross', 7)} / nullif({roll('avg', 'gross', 28)}, 0) AS ma7_28, "
        f"{roll('avg', 'gross', 14)} / nullif({roll('avg', 'gross', 56)}, 0) AS ma14_56, "
        f"{roll('stddev_samp', 'gross', 7)} / nullif({roll('stddev_samp', 'gross', 28)}, 0) AS vol7_28"
    ),
)
def ma_and_vol_ratio(t):
    return day_panel(t).withColumns(
        {
            "ma7_28": DAY.ma_ratio("gross", 7, 28),
            "ma14_56": DAY.ma_ratio("gross", 14, 56),
            "vol7_28": DAY.vol_ratio("gross", 7, 28),
        }
    )


def _future(h):
    f = frame(1, h)
    return f"(CASE WHEN count(gross) OVER {f} = {h} THEN sum(gross) OVER {f} END)"


@query(
    "forward_ratio",
    "entity:s date:d r3:f r7:f r14:f r7_past:f y85:i y80:i",
    f"""WITH {panel_sql()}, r AS (SELECT entity, date, """
    + ", ".join(f"{_future(h)} / nullif({h} * {roll('avg', 'gross', 28)}, 0) AS r{h}" for h in (3, 7, 14))
    + f", {_future(7)} / nullif(7 * {roll('avg', 'gross', 28, past=True)}, 0) AS r7_past FROM panel)"
    + " SELECT *, CAST(r7 < 0.85 AS INTEGER) AS y85, CAST(r7 < 0.80 AS INTEGER) AS y80 FROM r",
)
def forward_ratio(t):
    d = day_panel(t).withColumns({f"r{h}": DAY.forward_ratio("gross", h) for h in (3, 7, 14)})
    d = d.withColumn("r7_past", DAY.forward_ratio("gross", 7, past_base=True))
    return d.withColumns({"y85": below(F.col("r7"), 0.85), "y80": below(F.col("r7"), 0.80)})


@query(
    "next_week_ratio",
    "entity:s week_start:d ratio:f y:i",
    f"""WITH {week_panel_sql()}, r AS (SELECT entity, week_start,
 (lead(gross, 1) OVER (PARTITION BY entity ORDER BY week_start)) / nullif({roll('avg', 'gross', 4, 'week_start')}, 0) AS ratio FROM wpanel)
 SELECT *, CAST(ratio < 0.80 AS INTEGER) AS y FROM r""",
)
def next_week_ratio(t):
    return week_panel(t).withColumn("ratio", WEEK.next_ratio("gross")).withColumn("y", below(F.col("ratio"), 0.80))


@query(
    "worst_of_next",
    "entity:s week_start:d w1:f w2:f w4:f",
    week_sql(
        ", ".join(
            f"(CASE WHEN count(gross) OVER {frame(1, h, 'week_start')} = {h} THEN min(gross) OVER {frame(1, h, 'week_start')} END)"
            f" / nullif({roll('avg', 'gross', 4, 'week_start')}, 0) AS w{h}"
            for h in (1, 2, 4)
        )
    ),
)
def worst_of_next(t):
    return week_panel(t).withColumns({f"w{h}": WEEK.worst_of_next("gross", h) for h in (1, 2, 4)})


@query(
    "share_of_total",
    "entity:s week_start:d share:f share_ratio:f share_change:f",
    f"""WITH {week_panel_sql()}, s AS (SELECT entity, week_start, gross / nullif(sum(gross) OVER (PARTITION BY week_start), 0) AS share FROM wpanel)
 SELECT entity, week_start, share, share / nullif({roll('avg', 'share', 4, 'week_start')}, 0) AS share_ratio,
   {pct('share', 4)} AS share_change FROM s""",
)
def share_of_total(t):
    d = windows.share_of_total(week_panel(t), ["week_start"], "gross", "share")
    return d.withColumns(
        {"share_ratio": WEEK.ratio_to_mean("share", 4), "share_change": WEEK.pct_change("share", 4)}
    )


@query(
    "relative_growth",
    "entity:s date:d rel7:f rel28:f",
    f"""WITH {panel_sql()}, m AS (SELECT date, sum(gross) AS g FROM panel GROUP BY 1),
 mc AS (SELECT date, {change('g', 7, part='')} AS m7, {change('g', 28, part='')} AS m28 FROM m),
 e AS (SELECT entity, date, {change('gross', 7)} AS c7, {change('gross', 28)} AS c28 FROM panel)
 SELECT entity, date, c7 - m7 AS rel7, c28 - m28 AS rel28 FROM e JOIN mc USING (date)""",
)
def relative_growth(t):
    d = windows.relative_growth(day_panel(t), "entity", "date", "gross", 7, "rel7")
    return windows.relative_growth(d, "entity", "date", "gross", 28, "rel28")


@query(
    "panel_zscore",
    "entity:s week_start:d change:f panel_mean:f panel_median:f panel_z:f breadth_down:f",
    f"""WITH {week_panel_sql('branch')}, c AS (SELECT entity, week_start, {pct('gross', 1)} AS change FROM wpanel),
 s AS (SELECT week_start, avg(change) AS panel_mean, stddev_samp(change) AS sd, quantile_cont(change, 0.5) AS panel_median,
   avg(CAST(coalesce(change, 0) < 0 AS DOUBLE)) AS breadth_down FROM c GROUP BY 1)
 SELECT entity, week_start, change, panel_mean, panel_median, (change - panel_mean) / nullif(sd, 0) AS panel_z, breadth_down
 FROM c JOIN s USING (week_start)""",
)
def panel_zscore(t):
    d = base.week_panel(t, "branch").select("entity", "week_start", "gross")
    d = d.withColumn("change", WEEK.pct_change("gross", 1))
    return history.panel_zscore(d, ["week_start"], "change")


@query(
    "prior_prevalence",
    "entity:s week_start:d "
    + " ".join([f"decline_rate_{w}:f" for w in (13, 26, 52, 104)] + [f"market_decline_rate_{w}:f" for w in (4, 13, 26, 52)]),
    f"""WITH {week_panel_sql()}, l AS (SELECT entity, week_start, CAST((lead(gross, 1) OVER (PARTITION BY entity ORDER BY week_start))
   / nullif({roll('avg', 'gross', 4, 'week_start')}, 0) < 0.8 AS DOUBLE) AS y FROM wpanel),
 m AS (SELECT week_start, avg(y) AS r FROM l GROUP BY 1),
 mr AS (SELECT week_start, {', '.join(f"{roll('avg', 'r', w, 'week_start', True, max(3, min(w, 8)), '')} AS market_decline_rate_{w}" for w in (4, 13, 26, 52))} FROM m)
 SELECT entity, week_start, {', '.join(f"{roll('avg', 'y', w, 'week_start', True, max(6, min(w, 13)))} AS decline_rate_{w}" for w in (13, 26, 52, 104))},
   {', '.join(f"market_decline_rate_{w}" for w in (4, 13, 26, 52))} FROM l JOIN mr USING (week_start)""",
)
def prior_prevalence(t):
    d = week_panel(t).withColumn("y", below(WEEK.next_ratio("gross"), 0.80))
    return history.prior_prevalence(d, "entity", "week_start", "y")


@query(
    "momentum",
    "entity:s week_start:d yoy_ratio:f yoy_log:f momentum_4_13:f acceleration:f",
    week_sql(
        f"gross / nullif({lag('gross', 52, 'week_start')}, 0) AS yoy_ratio, "
        f"ln(CASE WHEN gross > 0 THEN gross / nullif({lag('gross', 52, 'week_start')}, 0) END) AS yoy_log, "
        f"{pct('gross', 4)} - {pct('gross', 13)} AS momentum_4_13, {pct('gross', 1)} - {pct('gross', 4)} / 4 AS acceleration"
    ),
)
def momentum(t):
    return history.momentum(week_panel(t), WEEK, "gross")


@query(
    "causal_percentile",
    "entity:s date:d pct:f pct_early:f",
    f"""WITH {scores_sql()}, n AS (SELECT entity, date, score, row_number() OVER (PARTITION BY entity ORDER BY date) AS i FROM scores),
 j AS (SELECT a.entity, a.date, count(b.i) AS n, sum(CASE WHEN b.score < a.score THEN 1 WHEN b.score = a.score THEN 0.5 ELSE 0 END) AS s
   FROM n a LEFT JOIN n b ON a.entity = b.entity AND b.i BETWEEN a.i - 126 AND a.i - 1 GROUP BY 1, 2)
 SELECT entity, date, CASE WHEN n >= 20 THEN CAST(s AS DOUBLE) / n ELSE 0.5 END AS pct,
   CASE WHEN n >= 56 THEN CAST(s AS DOUBLE) / n END AS pct_early FROM j""",
)
def causal_percentile(t):
    return base.scores(t).withColumns(
        {
            "pct": DAY.causal_percentile("score", 126, 20, 0.5),
            "pct_early": DAY.causal_percentile("score", 126, 56),
        }
    )


@query(
    "rank_in_fold",
    "entity:s date:d fold_id:i fold_rank:f",
    f"""WITH {scores_sql()} SELECT entity, date, fold_id, row_number() OVER (PARTITION BY fold_id ORDER BY score, date, entity)
   / CAST(count(*) OVER (PARTITION BY fold_id) AS DOUBLE) AS fold_rank FROM scores""",
)
def rank_in_fold(t):
    return history.rank_in_fold(base.scores(t), "score", "date", "entity", "fold_id")


@query(
    "rank_against_train",
    "entity:s date:d train_rank:f",
    f"""WITH {scores_sql()}, ref AS (SELECT score FROM scores WHERE fold_id < 3),
 d AS (SELECT DISTINCT score FROM scores),
 r AS (SELECT d.score, count(ref.score) / CAST((SELECT count(*) FROM ref) AS DOUBLE) AS train_rank
   FROM d LEFT JOIN ref ON ref.score <= d.score GROUP BY d.score)
 SELECT entity, date, train_rank FROM scores JOIN r USING (score) WHERE fold_id >= 3""",
)
def rank_against_train(t):
    s = base.scores(t)
    return history.rank_against(s.where("fold_id >= 3"), s.where("fold_id < 3"), "score")


@query(
    "trend_index_warmup",
    "entity:s week_start:d trend:i",
    f"""WITH {week_panel_sql()}, n AS (SELECT entity, week_start, row_number() OVER (PARTITION BY entity ORDER BY week_start) AS trend FROM wpanel)
 SELECT * FROM n WHERE trend > 13""",
)
def trend_index_warmup(t):
    return week_panel(t).withColumn("trend", WEEK.row_no()).where("trend > 13")


@query(
    "compress_calendar",
    "entity:s date:d training_date:d gap_days:i sales:f4",
    f"""WITH {panel_sql()}, src AS (SELECT entity, date, sales FROM panel WHERE (CAST(datediff('day', DATE '1990-01-01', date) AS BIGINT) * 7919) % 11 < 7),
 dd AS (SELECT DISTINCT date FROM src),
 m AS (SELECT date, DATE '2023-01-01' + CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS training_date,
   coalesce(date - lag(date) OVER (ORDER BY date) - 1, 0) AS gap_days FROM dd)
 SELECT entity, date, training_date, gap_days, sales FROM src JOIN m USING (date)""",
)
def compress_calendar(t):
    src = day_panel(t, "sales").where("(datediff(date, date'1990-01-01') * bigint(7919)) % 11 < 7")  # gaps at any size of the data
    return windows.compress_calendar(src, "date", "2023-01-01")



def _predicted(t):
    d = week_panel(t, "gross", "lines").withColumns(
        {"m4": WEEK.rolling("gross", 4), "actual": WEEK.lead("gross", 1), "c4": WEEK.rolling("lines", 4)}
    )
    return d.withColumns(
        {
            "predicted_value": 0.6 * F.col("m4") + 0.4 * F.col("gross"),
            "predicted_count": 0.5 * F.col("c4") + 0.5 * F.col("lines"),
        }
    )


_PREDICTED = f"""{week_panel_sql()}, b AS (SELECT entity, week_start, gross, lines, {roll('avg', 'gross', 4, 'week_start')} AS m4,
   {roll('avg', 'lines', 4, 'week_start')} AS c4, lead(gross, 1) OVER (PARTITION BY entity ORDER BY week_start) AS actual FROM wpanel),
 p AS (SELECT *, 0.6 * m4 + 0.4 * gross AS predicted_value, 0.5 * c4 + 0.5 * lines AS predicted_count FROM b)"""


@query(
    "error_memory",
    "entity:s week_start:d error_median8:f error_q10_13:f error_q90_13:f corrected_ratio:f lower_ratio:f upper_ratio:f corrected_risk:f upper_risk:f",
    f"""WITH {_PREDICTED}, e AS (SELECT *, ln(CASE WHEN actual / nullif(predicted_value, 0) > 0 THEN actual / nullif(predicted_value, 0) END) AS le FROM p),
 q AS (SELECT *, {roll(0.5, 'le', 8, 'week_start', True, 4)} AS error_median8, {roll(0.1, 'le', 13, 'week_start', True, 6)} AS error_q10_13,
   {roll(0.9, 'le', 13, 'week_start', True, 6)} AS error_q90_13 FROM e),
 r AS (SELECT *, predicted_value * exp(error_median8) / nullif(m4, 0) AS corrected_ratio, predicted_value * exp(error_q10_13) / nullif(m4, 0) AS lower_ratio,
   predicted_value * exp(error_q90_13) / nullif(m4, 0) AS upper_ratio FROM q)
 SELECT *, 1 / (1 + exp(greatest(-30, least(30, (corrected_ratio - 0.85) / 0.055)))) AS corrected_risk,
   1 / (1 + exp(greatest(-30, least(30, (upper_ratio - 0.85) / 0.055)))) AS upper_risk FROM r WHERE corrected_ratio IS NOT NULL AND upper_ratio IS NOT NULL""",
)
def error_memory(t):
    d = history.error_memory(_predicted(t), "entity", "week_start", "actual", "predicted_value", "m4")
    return d.where("corrected_ratio is not null and upper_ratio is not null")


@query(
    "scale_to_median",
    "entity:s week_start:d forecast_index:f forecast_change:f",
    f"""WITH {_PREDICTED} SELECT entity, week_start,
   predicted_value / nullif(quantile_cont(gross, 0.5) OVER {frame(-51, 0, 'week_start')}, 0) AS forecast_index,
   predicted_value / nullif(gross, 0) - 1 AS forecast_change FROM p""",
)
def scale_to_median(t):
    return history.scale_to_median(_predicted(t), WEEK, "gross", "predicted_value")


@query(
    "fill_both",
    "entity:s date:d ffill:f4 filled:f4",
    f"""WITH {panel_sql()}, g AS (SELECT entity, date, CASE WHEN gross > 150000 THEN gross END AS v FROM panel),
 f AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY entity ORDER BY date ROWS UNBOUNDED PRECEDING) AS ffill,
   first_value(v IGNORE NULLS) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bfill FROM g)
 SELECT entity, date, ffill, coalesce(ffill, bfill) AS filled FROM f""",
)
def fill_both(t):
    d = day_panel(t).withColumn("v", F.when(F.col("gross") > 150000, F.col("gross")))
    return d.withColumn("ffill", DAY.forward_fill("v")).withColumn(
        "filled", F.coalesce(F.col("ffill"), DAY.backward_fill("v"))
    )


@query(
    "local_prior",
    "entity:s week_start:d market_prior:f entity_prior:f effective_prior:f",
    f"""WITH {week_panel_sql()}, l AS (SELECT entity, week_start, CAST((lead(gross, 1) OVER (PARTITION BY entity ORDER BY week_start))
   / nullif({roll('avg', 'gross', 4, 'week_start')}, 0) < 0.8 AS DOUBLE) AS y FROM wpanel),
 h AS (SELECT * FROM l WHERE y IS NOT NULL),
 w AS (SELECT week_start, sum(y) AS s, count(*) AS n FROM h GROUP BY 1),
 g AS (SELECT a.week_start, sum(b.s) FILTER (b.week_start >= a.week_start - 364) AS s52, coalesce(sum(b.n) FILTER (b.week_start >= a.week_start - 364), 0) AS n52,
   sum(b.s) AS sa, sum(b.n) AS na FROM w a LEFT JOIN w b ON b.week_start < a.week_start GROUP BY 1),
 gp AS (SELECT week_start, CASE WHEN n52 >= 100 THEN s52 / n52 ELSE sa / na END AS r FROM g),
 c AS (SELECT a.entity, a.week_start, coalesce(sum(b.y), 0) AS s, count(b.y) AS n FROM h a
   LEFT JOIN h b ON a.entity = b.entity AND b.week_start < a.week_start AND b.week_start >= a.week_start - 728 GROUP BY 1, 2),
 m AS (SELECT entity, week_start, r, CASE WHEN r IS NULL THEN 0.08 ELSE greatest(0.003, least(0.2, r)) END AS market_prior, s, n FROM c JOIN gp USING (week_start)),
 e AS (SELECT *, CASE WHEN r IS NULL THEN 0.08 ELSE greatest(0.003, least(0.2, (s + 26 * market_prior) / (n + 26))) END AS entity_prior FROM m)
 SELECT entity, week_start, market_prior, entity_prior, sqrt(market_prior * entity_prior) AS effective_prior FROM e""",
)
def local_prior(t):
    d = week_panel(t).withColumn("y", below(WEEK.next_ratio("gross"), 0.80)).where("y is not null")
    return history.local_prior(d, "entity", "week_start", "y")


_FR = [f"{p}{w}:f" for w in (4, 8, 13) for p in ("pred_value_ratio", "pred_count_ratio", "value_cv")]


@query(
    "forecast_ratios",
    "entity:s week_start:d " + " ".join(_FR) + " pred_value_change:f value_count_gap:f value_ape8_known:f",
    f"""WITH {_PREDICTED}, a AS (SELECT *, abs(actual - predicted_value) / nullif(actual, 0) AS ape FROM p)
 SELECT entity, week_start, """
    + ", ".join(
        f"predicted_value / nullif({roll('avg', 'gross', w, 'week_start')}, 0) AS pred_value_ratio{w}, "
        f"predicted_count / nullif({roll('avg', 'lines', w, 'week_start')}, 0) AS pred_count_ratio{w}, "
        f"{roll('stddev_samp', 'gross', w, 'week_start')} / nullif({roll('avg', 'gross', w, 'week_start')}, 0) AS value_cv{w}"
        for w in (4, 8, 13)
    )
    + f""", predicted_value / nullif(gross, 0) - 1 AS pred_value_change,
   (predicted_value / nullif(gross, 0) - 1) - (predicted_count / nullif(lines, 0) - 1) AS value_count_gap,
   {roll('avg', 'ape', 8, 'week_start', True, 4)} AS value_ape8_known FROM a""",
)
def forecast_ratios(t):
    return history.forecast_ratios(_predicted(t), "entity", "week_start", "gross", "lines")


def _conv_sql():
    parts = []
    for b, past in (("today", False), ("before", True)):
        for a, lo in (("after", 1), ("with_today", 0)):
            for h in (3, 7, 14):
                f = frame(lo, h if lo else h - 1, part="")
                parts.append(
                    f"SELECT date, '{b}__{a}__{h}' AS convention, stored, (CASE WHEN count(sales) OVER {f} = {h} THEN sum(sales) OVER {f} END)"
                    f" / nullif({h} * {roll('avg', 'sales', 28, past=past, part='')}, 0) AS ratio FROM stored"
                )
    return " UNION ALL ".join(parts)


@query(
    "label_conventions",
    "convention:s n:i mae:f rmse:f correlation:f",
    f"""WITH {COMPANY}, stored AS (SELECT date, sales, (CASE WHEN count(sales) OVER {frame(1, 7, part='')} = 7 THEN sum(sales) OVER {frame(1, 7, part='')} END)
   / nullif(7 * {roll('avg', 'sales', 28, part='')}, 0) AS stored FROM company), c AS ({_conv_sql()})
 SELECT convention, count(*) AS n, avg(abs(ratio - stored)) AS mae, sqrt(avg((ratio - stored) * (ratio - stored))) AS rmse, corr(ratio, stored) AS correlation
 FROM c WHERE ratio IS NOT NULL AND stored IS NOT NULL GROUP BY 1""",
)
def label_conventions(t):
    d = base.company_day(t).withColumn("stored", Series([], "date").forward_ratio("sales", 7))
    return history.label_conventions(d, "date", "sales", "stored")


@query(
    "consecutive_only",
    "entity:s week_start:d",
    f"""WITH {week_panel_sql()}, s AS (SELECT entity, week_start FROM wpanel WHERE (CAST(datediff('day', DATE '1990-01-01', week_start) AS BIGINT) // 7 * 31 + length(entity)) % 9 < 7),
 g AS (SELECT *, week_start - lag(week_start) OVER w AS back, lead(week_start) OVER w - week_start AS ahead FROM s
   WINDOW w AS (PARTITION BY entity ORDER BY week_start)) SELECT entity, week_start FROM g WHERE back = 7 AND ahead = 7""",
)
def consecutive_only(t):
    return windows.consecutive_only(week_panel(t).where("(datediff(week_start, date'1990-01-01') div 7 * 31 + length(entity)) % 9 < 7"), WEEK)
