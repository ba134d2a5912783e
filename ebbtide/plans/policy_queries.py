"""Metrics, threshold choice, states and policies over the scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbtide.operators import policy
from ebbtide.operators.ordering import settle
from ebbtide.operators.windows import Series, below
from ebbtide.plans import base
from ebbtide.plans.base import scores_sql, settled_scores, week_panel_sql
from ebbtide.plans.registry import query
from ebbtide.plans.window_queries import roll

S = scores_sql()
RATE_COLS = "accuracy:f balanced_accuracy:f precision:f recall:f f1:f npv:f fpr:f alert_rate:f"


def conf(alert: str) -> str:
    return (
        f"CAST(count(*) FILTER (y = 1 AND {alert}) AS DOUBLE) AS tp, CAST(count(*) FILTER (y = 0 AND {alert}) AS DOUBLE) AS fp, "
        f"CAST(count(*) FILTER (y = 1 AND NOT ({alert})) AS DOUBLE) AS fn, CAST(count(*) FILTER (y = 0 AND NOT ({alert})) AS DOUBLE) AS tn"
    )


RATES = """(tp + tn) / nullif(tp + fp + fn + tn, 0) AS accuracy,
   (coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2 AS balanced_accuracy,
   coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1,
   coalesce(tn / nullif(tn + fn, 0), 0) AS npv, coalesce(fp / nullif(fp + tn, 0), 0) AS fpr, (tp + fp) / nullif(tp + fp + fn + tn, 0) AS alert_rate"""


@query(
    "binary_metrics",
    "entity:s tp:i fp:i fn:i tn:i " + RATE_COLS,
    f"WITH {S}, c AS (SELECT entity, {conf('score >= 0.55')} FROM scores GROUP BY 1) SELECT entity, tp, fp, fn, tn, {RATES} FROM c",
)
def binary_metrics(t):
    return policy.binary_metrics(base.scores(t), "y", F.col("score") >= 0.55, ["entity"])


FOLD = f"""c AS (SELECT fold_id, {conf('score >= 0.55')} FROM scores GROUP BY 1), f AS (SELECT *, {RATES} FROM c),
 w AS (SELECT min(recall) FILTER (tp + fn >= 4) AS worst, max(alert_rate) AS max_fold_alert_rate, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn FROM f)"""


@query(
    "fold_summary",
    "tp:i fp:i fn:i tn:i worst_fold_recall:f max_fold_alert_rate:f " + RATE_COLS,
    f"WITH {S}, {FOLD} SELECT *, coalesce(worst, 0) AS worst_fold_recall, {RATES} FROM w",
)
def fold_summary(t):
    return policy.fold_summary(base.scores(t), "y", F.col("score") >= 0.55, "fold_id")


@query(
    "roc_auc",
    "fold_id:i roc_auc:f",
    f"""WITH {S}, r AS (SELECT fold_id, y, rank() OVER (PARTITION BY fold_id ORDER BY score) + (count(*) OVER (PARTITION BY fold_id, score) - 1) / 2.0 AS rk FROM scores)
 SELECT fold_id, (sum(CAST(rk AS DOUBLE)) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * sum(1 - y), 0) AS roc_auc FROM r GROUP BY 1""",
)
def roc_auc(t):
    return policy.roc_auc(base.scores(t), "y", "score", ["fold_id"])


@query(
    "average_precision",
    "pr_auc:f",
    f"""WITH {S}, g AS (SELECT score, CAST(sum(y) AS DOUBLE) AS p, count(*) AS n FROM scores GROUP BY 1),
 c AS (SELECT p, sum(p) OVER o / sum(n) OVER o AS prec FROM g WINDOW o AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
 SELECT sum(p * prec) / sum(p) AS pr_auc FROM c""",
)
def average_precision(t):
    return policy.average_precision(base.scores(t), "y", "score")


_EDGES = [i * 0.1 for i in range(1, 10)]


@query(
    "calibration_metrics",
    "brier:f ece:f",
    f"""WITH {S}, p AS (SELECT y, greatest(1e-6, least(1 - 1e-6, score)) AS p FROM scores),
 b AS (SELECT *, {' + '.join(f"CAST(p >= CAST('{e!r}' AS DOUBLE) AS INTEGER)" for e in _EDGES)} AS bin FROM p),
 g AS (SELECT bin, count(*) AS n, abs(avg(p) - avg(y)) AS gap, sum((p - y) * (p - y)) AS se FROM b GROUP BY 1)
 SELECT sum(se) / sum(n) AS brier, sum(n * gap) / sum(n) AS ece FROM g""",
)
def calibration_metrics(t):
    return policy.calibration_metrics(base.scores(t), "y", "score")


def grid_sql(spec_even, quantiles=None) -> str:
    values = ", ".join(f"CAST('{v!r}' AS DOUBLE)" for v in policy.even(*spec_even)) if spec_even else ""
    parts = [f"SELECT unnest([{values}]) AS t"] if values else []
    if quantiles:
        qs = ", ".join(repr(q) for q in policy.even(*quantiles))
        parts.append(f"SELECT unnest((SELECT quantile_cont(score, [{qs}]) FROM scores)) AS t")
    return f"g AS (SELECT DISTINCT t FROM ({' UNION ALL '.join(parts)}))"


SWEEP = f"""m AS (SELECT fold_id, t, {conf('score >= t')} FROM scores, g GROUP BY 1, 2), mf AS (SELECT *, {RATES} FROM m)"""


def _objective(profile):
    spec = policy.SWEEPS[profile]
    terms = [f"{w} * {n}" for n, w in spec["weights"].items()]
    terms += [f"-{w} * greatest({floor} - {n}, 0)" for n, (floor, w) in spec["shortfalls"].items()]
    terms += [f"-{w} * greatest({n} - {cap}, 0)" for n, (cap, w) in spec["excesses"].items()]
    limits = [f"{n} >= {v}" for n, v in spec["limits"].items()] + [f"{n} <= {v}" for n, v in spec["caps"].items()]
    return f"round({' + '.join(terms)}, 9) AS objective, {' AND '.join(limits)} AS feasible"


def sweep_sql(profile: str) -> str:
    spec = policy.SWEEPS[profile]
    return f"""WITH {S}, {grid_sql(spec['even'], spec['quantiles'])}, {SWEEP},
 a AS (SELECT t AS threshold, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn, min(recall) FILTER (tp + fn >= {spec['min_positives']}) AS worst, max(alert_rate) AS max_fold_alert_rate FROM mf GROUP BY 1),
 b AS (SELECT *, {RATES} FROM a), d AS (SELECT *, coalesce(worst, recall) AS worst_fold_recall FROM b), e AS (SELECT *, {_objective(profile)} FROM d)"""


def _sweep_query(profile):
    spec = policy.SWEEPS[profile]
    order = ", ".join(f"{c} DESC" for c in spec["ties"])

    @query(
        f"sweep_threshold_{profile}",
        "threshold:f feasible:b objective:f tp:i fp:i recall:f precision:f worst_fold_recall:f",
        sweep_sql(profile) + f" SELECT * FROM e ORDER BY feasible DESC, objective DESC, {order}, threshold LIMIT 1",
    )
    def build(t):
        return policy.sweep_threshold(settled_scores(t), "y", "score", "fold_id", profile)

    return build


for _p in policy.SWEEPS:
    _sweep_query(_p)


@query(
    "sweep_table",
    "threshold:f tp:i fp:i fn:i tn:i worst_fold_recall:f max_fold_alert_rate:f objective:f feasible:b",
    sweep_sql("fusion") + " SELECT * FROM e",
)
def sweep_table(t):
    return policy.sweep_table(settled_scores(t), "y", "score", "fold_id", "fusion")


@query(
    "watch_red",
    "watch_threshold:f watch_precision:f watch_recall:f watch_fallback:b red_threshold:f red_precision:f red_recall:f red_fallback:b",
    f"""WITH {S}, {grid_sql((0.01, 0.99, 197), (0.0, 1.0, 101))}, m AS (SELECT t, {conf('score >= t')} FROM scores, g GROUP BY 1), r AS (SELECT *, {RATES} FROM m),
 w AS (SELECT *, recall >= 0.8 AND npv >= 0.7 AS met FROM r), wx AS (SELECT t AS wt, precision AS wp, recall AS wr, met AS wm FROM w
   ORDER BY met DESC, CASE WHEN met THEN 0 ELSE least(recall, 0.9) + least(npv, 0.98) END DESC, precision DESC, alert_rate, CASE WHEN met THEN npv END DESC NULLS LAST, t LIMIT 1),
 rx AS (SELECT r.*, tp + fp >= 8 AND precision >= 0.6 AND fpr <= 0.1 AS ok, wx.* FROM r, wx WHERE t >= wt)
 SELECT wt AS watch_threshold, wp AS watch_precision, wr AS watch_recall, NOT wm AS watch_fallback, t AS red_threshold, precision AS red_precision, recall AS red_recall, NOT ok AS red_fallback
 FROM rx ORDER BY ok DESC, CASE WHEN ok THEN recall ELSE precision - 2 * fpr END DESC, CASE WHEN ok THEN precision ELSE recall END DESC, fpr, t LIMIT 1""",
)
def watch_red(t):
    return policy.watch_red(settled_scores(t), "y", "score", 0.8, 0.7, 0.6, 0.1)


STATES = """st AS (SELECT *, CAST(score >= 0.5 AS INTEGER) + CAST(score_b >= 0.5 AS INTEGER) + CAST(score_c >= 0.5 AS INTEGER) AS votes,
   CAST(r < 0.97 AS INTEGER) + CAST(score_b > 0.4 AS INTEGER) + CAST(score_c > 0.55 AS INTEGER) AS pc FROM scores),
 tr AS (SELECT *, CASE WHEN score >= 0.6 AND votes >= 2 AND pc >= 2 THEN 'RED' WHEN score >= 0.6 AND votes >= 2 AND pc >= 2 OR score >= 0.5 OR pc >= 2 THEN 'AMBER' ELSE 'GREEN' END AS state FROM st)"""


def with_votes(t):
    from ebbtide.functions.scalars import count_true

    d = policy.consensus(base.scores(t), ["score", "score_b", "score_c"])
    return d.withColumn("pc", count_true(F.col("r") < 0.97, F.col("score_b") > 0.4, F.col("score_c") > 0.55))


@query("triage", "entity:s date:d state:s", f"WITH {S}, {STATES} SELECT entity, date, state FROM tr")
def triage(t):
    return policy.triage(with_votes(t), "score", 0.5, 0.6, "votes", "pc")


@query(
    "state_metrics",
    "state:s rows:i coverage:f positive_rate:f npv:f share_of_declines:f",
    f"""WITH {S}, s AS (SELECT y, CASE WHEN score >= 0.6 THEN 'RED' WHEN score >= 0.5 THEN 'AMBER' ELSE 'GREEN' END AS state FROM scores)
 SELECT state, count(*) AS rows, count(*) / CAST((SELECT count(*) FROM s) AS DOUBLE) AS coverage, avg(y) AS positive_rate, 1 - avg(y) AS npv, sum(y) / CAST((SELECT sum(y) FROM s) AS DOUBLE) AS share_of_declines FROM s GROUP BY 1""",
)
def state_metrics(t):
    return policy.state_metrics(policy.triage(base.scores(t), "score", 0.5, 0.6), "y")


def _arr(values):
    return ", ".join(f"CAST('{v!r}' AS DOUBLE)" for v in values)


@query(
    "selective",
    "fold_id:i rows:i amber:i green:i coverage:f decision_accuracy:f amber_precision:f green_npv:f amber_recall:f",
    f"""WITH {S}, h AS (SELECT t, count(*) AS n, avg(y) AS p FROM scores, (SELECT unnest([{_arr(policy.even(0.20, 0.99, 160))}]) AS t) WHERE score >= t GROUP BY 1),
 l AS (SELECT t, count(*) AS n, 1 - avg(y) AS p FROM scores, (SELECT unnest([{_arr(policy.even(0.01, 0.80, 160))}]) AS t) WHERE score <= t GROUP BY 1),
 b AS (SELECT coalesce((SELECT t FROM h WHERE n >= 3 AND p >= 0.38 ORDER BY n DESC, t LIMIT 1), 1.01) AS hi, coalesce((SELECT t FROM l WHERE n >= 10 AND p >= 0.62 ORDER BY n DESC, t LIMIT 1), -0.01) AS lo),
 s AS (SELECT fold_id, y, CASE WHEN score >= hi THEN 'AMBER' WHEN score <= CASE WHEN lo >= hi THEN least(lo, hi - 0.01) ELSE lo END THEN 'GREEN' ELSE 'WATCH' END AS st FROM scores, b),
 m AS (SELECT fold_id, count(*) AS rows, count(*) FILTER (st = 'AMBER') AS amber, count(*) FILTER (st = 'GREEN') AS green, count(*) FILTER (st = 'AMBER' AND y = 1) AS ah, count(*) FILTER (st = 'GREEN' AND y = 0) AS gh, sum(y) AS p FROM s GROUP BY 1)
 SELECT fold_id, rows, amber, green, (amber + green) / CAST(rows AS DOUBLE) AS coverage, (ah + gh) / greatest(amber + green, 1.0) AS decision_accuracy, ah / nullif(CAST(amber AS DOUBLE), 0) AS amber_precision,
   gh / nullif(CAST(green AS DOUBLE), 0) AS green_npv, ah / greatest(p, 1.0) AS amber_recall FROM m""",
)
def selective(t):
    s = settled_scores(t)
    lo, hi = policy.selective_bounds(s, "y", "score", 0.38, 0.62)
    return policy.selective_metrics(policy.selective(s, "score", lo, hi), "y", ["fold_id"])


def weekly_scores(t):
    """Weekly scores per category with the next-week label."""
    s = Series("entity", "week_start")
    d = base.week_panel(t, measures=("gross",)).select(
        "entity", "week_start", s.ratio_to_mean("gross", 4).alias("ratio"), below(s.next_ratio("gross"), 0.80).alias("y")
    )
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.col("ratio") / 2.0)), 3)
    return d.where("ratio is not null and y is not null").withColumn("score", score)


WSCORES = f"""{week_panel_sql()}, wr AS (SELECT entity, week_start, gross / nullif({roll('avg', 'gross', 4, 'week_start')}, 0) AS ratio,
   CAST((lead(gross) OVER (PARTITION BY entity ORDER BY week_start)) / nullif({roll('avg', 'gross', 4, 'week_start')}, 0) < 0.8 AS INTEGER) AS y FROM wpanel),
 ws AS (SELECT *, round(greatest(0.0, least(1.0, 1 - ratio / 2)), 3) AS score FROM wr WHERE ratio IS NOT NULL AND y IS NOT NULL)"""


_PVALUES = f"""{WSCORES}, c AS (SELECT a.entity, a.week_start, a.y,
   count(*) FILTER (b.y = 0 AND r) AS nn, count(*) FILTER (b.y = 0 AND r AND b.score >= a.score) AS ne,
   count(*) FILTER (b.y = 0 AND r AND b.entity = a.entity) AS onn, count(*) FILTER (b.y = 0 AND r AND b.entity = a.entity AND b.score >= a.score) AS oe,
   count(*) FILTER (b.y = 1 AND r) AS pn, count(*) FILTER (b.y = 1 AND r AND b.score <= a.score) AS pe,
   count(*) FILTER (b.y = 0) AS nn2, count(*) FILTER (b.y = 0 AND b.score >= a.score) AS ne2,
   count(*) FILTER (b.y = 0 AND b.entity = a.entity) AS onn2, count(*) FILTER (b.y = 0 AND b.entity = a.entity AND b.score >= a.score) AS oe2,
   count(*) FILTER (b.y = 1) AS pn2, count(*) FILTER (b.y = 1 AND b.score <= a.score) AS pe2
   FROM ws a LEFT JOIN (SELECT *, 1 AS one FROM ws) b ON b.week_start < a.week_start, LATERAL (SELECT b.week_start >= a.week_start - 728 AS r) GROUP BY 1, 2, 3),
 k AS (SELECT *, CASE WHEN nn >= 30 AND pn >= 10 THEN 'window' WHEN nn2 >= 30 AND pn2 >= 10 THEN 'all' ELSE 'none' END AS calibration FROM c),
 u AS (SELECT entity, week_start, y, calibration, CASE WHEN calibration = 'window' THEN nn ELSE nn2 END AS nn, CASE WHEN calibration = 'window' THEN ne ELSE ne2 END AS ne,
   CASE WHEN calibration = 'window' THEN onn ELSE onn2 END AS onn, CASE WHEN calibration = 'window' THEN oe ELSE oe2 END AS oe,
   CASE WHEN calibration = 'window' THEN pn ELSE pn2 END AS pn, CASE WHEN calibration = 'window' THEN pe ELSE pe2 END AS pe FROM k),
 p AS (SELECT entity, week_start, y, calibration, CASE WHEN calibration <> 'none' THEN (1 + ne) / CAST(nn + 1 AS DOUBLE) END AS p_market,
   CASE WHEN calibration <> 'none' THEN CASE WHEN onn >= 30 THEN (1 + oe) / CAST(onn + 1 AS DOUBLE) ELSE (1 + ne) / CAST(nn + 1 AS DOUBLE) END END AS p_entity,
   CASE WHEN calibration <> 'none' THEN (1 + pe) / CAST(pn + 1 AS DOUBLE) END AS p_decline FROM u)"""


@query(
    "conformal_state",
    "entity:s week_start:d p_market:f p_entity:f p_decline:f calibration:s state:s",
    f"""WITH {_PVALUES}
 SELECT *, CASE WHEN p_market <= 0.05 AND p_entity <= 0.1 THEN 'RED' WHEN p_decline <= 0.1 THEN 'GREEN' ELSE 'AMBER' END AS state FROM p""",
)
def conformal_state(t):
    return policy.conformal_state(settle(weekly_scores(t)), "entity", "week_start", "y", "score")


_LEVELS = ", ".join(
    f"{name}({name}v) AS (VALUES {', '.join(f'({v}::DOUBLE)' for v in steps)})"
    for name, steps in (("am", policy.RED_MARKET_LEVELS), ("ae", policy.RED_ENTITY_LEVELS), ("ag", policy.GREEN_LEVELS))
)


@query(
    "conformal_alphas",
    "red_market:f red_entity:f green:f rows:i red:i green_rows:i red_precision:f red_fpr:f alert_recall:f green_npv:f gates:i passes:b rank:i",
    f"""WITH {_PVALUES}, {_LEVELS},
 ch AS (SELECT amv AS red_market, aev AS red_entity, agv AS green, y, coalesce(p_market <= amv AND p_entity <= aev, false) AS r, coalesce(p_decline <= agv, false) AS g FROM p, am, ae, ag WHERE y IS NOT NULL AND week_start >= DATE '1997-01-05'),
 cn AS (SELECT red_market, red_entity, green, count(*) AS rows, sum(y) AS declines, count(*) FILTER (r) AS red, count(*) FILTER (r AND y = 1) AS hits,
   count(*) FILTER (g AND NOT r) AS green_rows, count(*) FILTER (g AND NOT r AND y = 1) AS misses FROM ch GROUP BY 1, 2, 3),
 cf AS (SELECT *, rows - red - green_rows AS amber, CAST(hits AS DOUBLE) / greatest(red, 1) AS red_precision, CAST(red - hits AS DOUBLE) / greatest(rows - declines, 1) AS red_fpr,
   CAST(hits AS DOUBLE) / greatest(declines, 1) AS red_recall, CAST(declines - misses AS DOUBLE) / greatest(declines, 1) AS alert_recall, CAST(green_rows - misses AS DOUBLE) / greatest(green_rows, 1) AS green_npv FROM cn),
 cz AS (SELECT *, CAST(red_precision >= 0.35 AS INTEGER) + CAST(red_fpr <= 0.1 AS INTEGER) + CAST(alert_recall >= 0.9 AS INTEGER) + CAST(green_npv >= 0.85 AS INTEGER) + CAST(red >= 3 AS INTEGER) AS gates FROM cf)
 SELECT red_market, red_entity, green, rows, red, green_rows, red_precision, red_fpr, alert_recall, green_npv, gates, gates = 5 AS passes,
   row_number() OVER (ORDER BY gates DESC, CASE WHEN gates = 5 THEN red_recall END DESC NULLS LAST, CASE WHEN gates = 5 THEN green_rows END DESC NULLS LAST,
   CASE WHEN gates = 5 THEN red_precision END DESC NULLS LAST, CASE WHEN gates = 5 THEN amber END NULLS LAST, red_precision DESC, alert_recall DESC, green_npv DESC, red_market, red_entity, green) AS rank FROM cz""",
)
def conformal_alphas(t):
    states = policy.conformal_state(settle(weekly_scores(t)), "entity", "week_start", "y", "score")
    evaluated = policy.require_calibration(settle(states), "week_start", "1997-01-05", strict=False)
    return policy.conformal_alphas(evaluated, "y", 0.35, 0.1, 0.9, 0.85)


@query(
    "prior_shift_state",
    "entity:s week_start:d effective_prior:f adjusted:f state:s",
    f"""WITH {WSCORES}, w AS (SELECT week_start, CAST(sum(y) AS DOUBLE) AS s, count(*) AS n FROM ws GROUP BY 1),
 g AS (SELECT a.week_start, sum(b.s) FILTER (b.week_start >= a.week_start - 364) AS s52, coalesce(sum(b.n) FILTER (b.week_start >= a.week_start - 364), 0) AS n52, sum(b.s) AS sa, sum(b.n) AS na
   FROM w a LEFT JOIN w b ON b.week_start < a.week_start GROUP BY 1),
 gp AS (SELECT week_start, CASE WHEN n52 >= 100 THEN s52 / n52 ELSE sa / na END AS r FROM g),
 c AS (SELECT a.entity, a.week_start, a.score, coalesce(sum(b.y), 0) AS s, count(b.y) AS n FROM ws a LEFT JOIN ws b ON a.entity = b.entity AND b.week_start < a.week_start AND b.week_start >= a.week_start - 728 GROUP BY 1, 2, 3),
 m AS (SELECT *, CASE WHEN r IS NULL THEN 0.3 ELSE greatest(0.003, least(0.2, r)) END AS mp FROM c JOIN gp USING (week_start)),
 e AS (SELECT *, sqrt(mp * CASE WHEN r IS NULL THEN 0.3 ELSE greatest(0.003, least(0.2, (s + 26 * mp) / (n + 26))) END) AS effective_prior, greatest(1e-6, least(1 - 1e-6, score)) AS p FROM m),
 o AS (SELECT *, p / (1 - p) * (effective_prior / (1 - effective_prior)) / (0.3 / 0.7) AS o FROM e)
 SELECT entity, week_start, effective_prior, o / (1 + o) AS adjusted, CASE WHEN o / (1 + o) >= 0.5 THEN 'RED' WHEN o / (1 + o) >= 0.35 THEN 'AMBER' ELSE 'GREEN' END AS state FROM o""",
)
def prior_shift_state(t):
    return policy.prior_shift_state(settle(weekly_scores(t)), "entity", "week_start", "y", "score", 0.3, 0.35, 0.5)


@query(
    "percentile_policy",
    "entity:s date:d percentile:f policy_mode:s alert:b",
    f"""WITH {S}, n AS (SELECT entity, date, score, row_number() OVER (PARTITION BY entity ORDER BY date) AS i FROM scores),
 j AS (SELECT a.entity, a.date, a.score, count(b.i) AS n, CAST(sum(CASE WHEN b.score < a.score THEN 1 WHEN b.score = a.score THEN 0.5 ELSE 0 END) AS DOUBLE) AS s
   FROM n a LEFT JOIN n b ON a.entity = b.entity AND b.i BETWEEN a.i - 126 AND a.i - 1 GROUP BY 1, 2, 3),
 p AS (SELECT *, CASE WHEN n >= 20 THEN s / n END AS percentile FROM j)
 SELECT entity, date, percentile, CASE WHEN percentile IS NULL THEN 'static' ELSE 'causal_percentile' END AS policy_mode,
   CASE WHEN percentile IS NULL THEN score >= 0.55 ELSE percentile >= 0.7 END AS alert FROM p""",
)
def percentile_policy(t):
    return policy.percentile_policy(base.scores(t), "entity", "date", "score", 0.55)


def regimes(t):
    """Score columns under the names the regime rules read."""
    s = base.scores(t)
    market = s.groupBy("date").agg(
        (F.max("score_c") - 0.6).alias("market_p90"), F.min("score_c").alias("market_mean")
    )
    d = s.join(market, "date").withColumns(
        {
            "merchant_logreg": F.col("score"),
            "merchant_extra": F.col("score_b"),
            "merchant_mean": (F.col("score") + F.col("score_b")) / 2.0,
            "merchant_disagreement": F.abs(F.col("score") - F.col("score_b")),
            "precursor_share_2": F.col("score_c"),
        }
    )
    return policy.regime_flags(d)


REG = f"""{S}, mk AS (SELECT date, max(score_c) - 0.6 AS market_p90, min(score_c) AS market_mean FROM scores GROUP BY 1),
 rg AS (SELECT *, score AS merchant_logreg, score_b AS merchant_extra, (score + score_b) / 2 AS merchant_mean, abs(score - score_b) AS merchant_disagreement, score_c AS precursor_share_2 FROM scores JOIN mk USING (date)),
 fl AS (SELECT *, merchant_mean >= 0.7 AND merchant_extra >= 0.6 AS strong, market_p90 <= 0.05 AND merchant_logreg >= 0.45 AND merchant_disagreement >= 0.1 AND merchant_mean >= 0.35 AS quiet,
   market_p90 >= 0.2 AND merchant_mean >= 0.35 AS market FROM rg), rf AS (SELECT *, strong OR quiet OR market AS base FROM fl)"""


@query("regime_flags", "entity:s date:d strong:b quiet:b market:b base:b", f"WITH {REG} SELECT entity, date, strong, quiet, market, base FROM rf")
def regime_flags(t):
    return regimes(t)


@query(
    "confirm_policy",
    "entity:s date:d is_high:b marginal:b alert:b",
    f"""WITH {REG}, h AS (SELECT *, merchant_mean >= 0.75 AS is_high, merchant_mean >= 0.55 AND NOT merchant_mean >= 0.75 AS marginal FROM rf)
 SELECT entity, date, is_high, marginal, is_high OR (marginal AND ((least(merchant_logreg, merchant_extra) >= 0.45 AND merchant_disagreement <= 0.2)
   OR market_p90 >= 0.15 OR (market_mean >= 0.15 * 0.60 AND precursor_share_2 >= 0.2))) AS alert FROM h""",
)
def confirm_policy(t):
    return policy.confirm_policy(regimes(t), 0.55, 0.75, 0.45, 0.15, 0.2)


def veto_sql(rule: str = "r") -> str:
    v = f"(CASE {rule}.vs WHEN 'quiet' THEN quiet AND NOT strong AND NOT market WHEN 'market' THEN market AND NOT strong WHEN 'nonstrong' THEN NOT strong WHEN 'none' THEN false ELSE true END)"
    r = f"(CASE {rule}.rs WHEN 'near' THEN merchant_mean >= 0.28 WHEN 'market' THEN market_p90 >= 0.10 WHEN 'none' THEN false ELSE true END)"
    return f"((base AND NOT (base AND {v} AND score_c < {rule}.vb)) OR (NOT base AND {r} AND score_c >= {rule}.rf))"


@query(
    "veto_rescue",
    "entity:s date:d alert:b",
    f"WITH {REG}, r(vs, vb, rs, rf) AS (VALUES ('nonstrong', 0.48, 'market', 0.7)) SELECT entity, date, {veto_sql()} AS alert FROM rf, r",
)
def veto_rescue(t):
    rule = {
        "veto_scope": F.lit("nonstrong"), "veto_below": F.lit(0.48), "rescue_scope": F.lit("market"), "rescue_from": F.lit(0.7),
    }
    return regimes(t).withColumn("alert", policy.veto_rescue(F.col("score_c"), rule))


@query(
    "consensus_veto",
    "entity:s date:d alert:b",
    f"WITH {REG} SELECT entity, date, base AND NOT (NOT strong AND score < 0.5 AND score_c < 0.5 AND r > 0.95) AS alert FROM rf",
)
def consensus_veto(t):
    return policy.consensus_veto(regimes(t), "nonstrong", {"score": 0.5, "score_c": 0.5}, "r", 0.95)


RULES = [
    (vs, vb, rs, rf)
    for vs in ("none", "quiet", "market", "nonstrong", "all")
    for vb in ((0.0,) if vs == "none" else (0.40, 0.45, 0.50))
    for rs, rf in (("none", 1.01), ("near", 0.80), ("market", 0.70))
]
_RULE_ROWS = ", ".join(f"({i}, '{a}', {b}, '{c}', {d})" for i, (a, b, c, d) in enumerate([policy.NO_RULE, *RULES]))
PREQ = f"""{REG}, rr(rn, vs, vb, rs, rf) AS (VALUES {_RULE_ROWS}),
 pf AS (SELECT rn, fold_id, {conf(veto_sql('rr'))} FROM rf, rr GROUP BY 1, 2),
 ps AS (SELECT rn, fold_id, sum(tp) OVER w AS tp, sum(fp) OVER w AS fp, sum(fn) OVER w AS fn, sum(tn) OVER w AS tn FROM pf WINDOW w AS (PARTITION BY rn ORDER BY fold_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 pm AS (SELECT *, {RATES} FROM ps WHERE tp IS NOT NULL),
 pk AS (SELECT a.*, a.recall >= b.recall - 0.02 AND a.npv >= b.npv - 0.005 AND a.alert_rate <= b.alert_rate + 0.01 AND a.fp <= b.fp AND a.f1 >= b.f1 AS ok FROM pm a JOIN pm b ON a.fold_id = b.fold_id AND b.rn = 0),
 ch AS (SELECT fold_id, CASE WHEN ok THEN rn ELSE 0 END AS rule_no, ok AS history_feasible FROM (SELECT *, row_number() OVER (PARTITION BY fold_id ORDER BY ok DESC, f1 DESC, precision DESC, fp, recall DESC, rn) AS k FROM pk) WHERE k = 1)"""


@query("prequential_rules_chosen", "fold_id:i rule_no:i history_feasible:b", f"WITH {PREQ} SELECT * FROM ch")
def prequential_rules_chosen(t):
    return policy.prequential_rules(settle(regimes(t)), "y", "fold_id", "score_c", RULES)[1]


@query(
    "prequential_rules",
    "entity:s date:d rule_no:i alert:b",
    f"""WITH {PREQ}, u AS (SELECT rf.*, coalesce(rule_no, 0) AS rule_no FROM rf LEFT JOIN ch USING (fold_id))
 SELECT entity, date, rule_no, {veto_sql('rr')} AS alert FROM u JOIN rr ON rr.rn = u.rule_no""",
)
def prequential_rules(t):
    return policy.prequential_rules(settle(regimes(t)), "y", "fold_id", "score_c", RULES)[0]


@query(
    "alert_verifier",
    "entity:s date:d veto:b alert:b",
    f"""WITH {REG}, f AS (SELECT DISTINCT fold_id FROM rf), p AS (SELECT f.fold_id, count(*) AS n, sum(y) AS h, quantile_cont(score_c, 0.1) FILTER (y = 1) AS q FROM f JOIN rf a ON a.fold_id < f.fold_id AND a.base GROUP BY 1),
 l AS (SELECT fold_id, CASE WHEN n >= 20 AND h > 0 AND h < n THEN greatest(0, q - 0.02) END AS lim FROM p),
 v AS (SELECT entity, date, base, coalesce(base AND NOT strong AND score_c < lim AND score < 0.6, false) AS veto FROM rf LEFT JOIN l USING (fold_id))
 SELECT entity, date, veto, base AND NOT veto AS alert FROM v""",
)
def alert_verifier(t):
    return policy.alert_verifier(settle(regimes(t)), "y", "fold_id", "score_c", {"score": 0.6})


@query(
    "changed_alerts",
    "entity:s date:d before:b after:b",
    f"""WITH {REG}, x AS (SELECT entity, date, base AS before, base AND NOT (NOT strong AND score < 0.5 AND score_c < 0.5 AND r > 0.95) AS after FROM rf) SELECT * FROM x WHERE before IS DISTINCT FROM after""",
)
def changed_alerts(t):
    from ebbtide.operators.explain import changed_alerts as build

    r = settle(regimes(t))
    new = policy.consensus_veto(r, "nonstrong", {"score": 0.5, "score_c": 0.5}, "r", 0.95)
    return build(r.withColumn("alert", F.col("base")), new, ["entity", "date"], "alert")


@query(
    "frontier",
    "point:s precision:f recall:f f1:f threshold:f",
    f"""WITH {S}, t AS (SELECT DISTINCT t FROM (SELECT score AS t FROM scores UNION ALL SELECT unnest([{_arr(policy.even(0.0, 1.0, 501))}]))),
 h AS (SELECT score, sum(y) AS p, sum(1 - y) AS n FROM scores GROUP BY 1), m AS (SELECT t, coalesce(CAST(sum(p) AS DOUBLE), 0) AS tp, coalesce(CAST(sum(n) AS DOUBLE), 0) AS fp FROM t LEFT JOIN h ON h.score >= t.t GROUP BY 1),
 c AS (SELECT t, tp, fp, (SELECT sum(p) FROM h) - tp AS fn, (SELECT sum(n) FROM h) - fp AS tn FROM m), r AS (SELECT t AS threshold, {RATES} FROM c)
 SELECT * FROM (SELECT 'precision_at_recall_80' AS point, precision, recall, f1, threshold FROM r WHERE recall >= 0.8 AND precision > 0 ORDER BY precision DESC, threshold LIMIT 1)
 UNION ALL SELECT * FROM (SELECT 'recall_at_precision_80', precision, recall, f1, threshold FROM r WHERE precision >= 0.8 AND recall > 0 ORDER BY recall DESC, threshold LIMIT 1)
 UNION ALL SELECT * FROM (SELECT 'best_f1', precision, recall, f1, threshold FROM r ORDER BY f1 DESC, threshold LIMIT 1)""",
)
def frontier(t):
    return policy.frontier(base.scores(t), "y", "score")


@query("bootstrap_ci", "metric:s low:f high:f n:i")
def bootstrap_ci(t):
    return policy.bootstrap_ci(base.scores(t), "y", "score", F.col("score") >= 0.55)


FOLD_WINDOWS = [(0, "1997-01-01", "1997-12-31"), (1, "1998-01-01", "1998-12-31"), (2, "1999-01-01", "1999-12-31"), (3, "2000-01-01", "2001-06-30")]
FOLDS = f"""fw(fid, s, e) AS (VALUES {', '.join(f"({i}, DATE '{s}', DATE '{e}')" for i, s, e in FOLD_WINDOWS)}),
 fo AS (SELECT fid AS fold_id, entity, date, y, CASE WHEN date <= s - 8 THEN 'train' ELSE 'validate' END AS role FROM scores JOIN fw ON date <= s - 8 OR date BETWEEN s AND e)"""


@query("purged_folds", "fold_id:i role:s entity:s date:d", f"WITH {S}, {FOLDS} SELECT fold_id, role, entity, date FROM fo")
def purged_folds(t):
    return policy.purged_folds(base.scores(t), "date", FOLD_WINDOWS)


@query(
    "fold_checks",
    "fold_id:i train_rows:i validate_rows:i valid:b",
    f"""WITH {S}, {FOLDS} SELECT fold_id, count(*) FILTER (role = 'train') AS train_rows, count(*) FILTER (role = 'validate') AS validate_rows,
   count(*) FILTER (role = 'train') >= 100 AND count(*) FILTER (role = 'validate') >= 35 AND count(DISTINCT y) FILTER (role = 'train') = 2 AND count(DISTINCT y) FILTER (role = 'validate') = 2 AS valid FROM fo GROUP BY 1""",
)
def fold_checks(t):
    return policy.fold_checks(policy.purged_folds(base.scores(t), "date", FOLD_WINDOWS), "y")


@query(
    "fold_overlap_audit",
    "fold_id:i train_end:d validate_start:d shared_rows:i gap_days:i passed:b",
    f"""WITH {S}, {FOLDS}, e AS (SELECT fold_id, max(date) FILTER (role = 'train') AS train_end, min(date) FILTER (role = 'validate') AS validate_start FROM fo GROUP BY 1),
 s AS (SELECT fold_id, count(*) AS n FROM (SELECT fold_id, entity, date FROM fo GROUP BY 1, 2, 3 HAVING count(DISTINCT role) > 1) GROUP BY 1)
 SELECT fold_id, train_end, validate_start, coalesce(n, 0) AS shared_rows, validate_start - train_end AS gap_days, coalesce(n, 0) = 0 AND validate_start - train_end >= 8 AS passed FROM e LEFT JOIN s USING (fold_id)""",
)
def fold_overlap_audit(t):
    folds = policy.purged_folds(base.scores(t), "date", FOLD_WINDOWS)
    return policy.fold_overlap_audit(folds, "date", ["entity", "date"])


TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query(
    "source_gate",
    "status:s state:s reason:s",
    f"""WITH {week_panel_sql()}, l AS (SELECT *, max(week_start) OVER () AS latest FROM wpanel)
 SELECT CASE WHEN reason IS NULL THEN 'OK' ELSE 'NO_DECISION' END AS status, CASE WHEN reason IS NOT NULL THEN 'AMBER' END AS state, reason FROM (
   SELECT CASE WHEN (SELECT count(DISTINCT entity) FROM l WHERE week_start = latest) <> 6 THEN 'ENTITY_CONTRACT_MISMATCH'
     WHEN (SELECT min(n) FROM (SELECT count(*) AS n FROM l GROUP BY entity)) < 104 THEN 'INSUFFICIENT_HISTORY_LT_104_WEEKS'
     WHEN (SELECT least(min(gross), min(lines)) FROM l WHERE week_start = latest) <= 0 THEN 'NONPOSITIVE_LATEST_SOURCE' END AS reason)""",
)
def source_gate(t):
    return policy.source_gate(base.week_panel(t, measures=("gross", "lines")), "entity", "week_start", ["gross", "lines"], TYPES)


@query(
    "blends",
    "blend_no:i rows:i mean_score:f high:i",
    f"""WITH {S}, w(i, a, b, c) AS (VALUES {', '.join(f"({i}, CAST({a} AS DOUBLE), CAST({b} AS DOUBLE), CAST({c} AS DOUBLE))" for i, (a, b, c) in enumerate(policy.blend_weights(3)))})
 SELECT i AS blend_no, count(*) AS rows, avg(a * score + b * score_b + c * score_c) AS mean_score, count(*) FILTER (a * score + b * score_b + c * score_c > 0.54321) AS high FROM scores, w GROUP BY 1""",
)
def blends(t):
    b = policy.blends(base.scores(t), ["score", "score_b", "score_c"])
    return b.groupBy("blend_no").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("blend_score").alias("mean_score"), F.count_if(F.col("blend_score") > 0.54321).alias("high")
    )


@query(
    "consensus",
    "entity:s date:d mean_score:f median_score:f votes:i disagreement:f",
    f"""WITH {S} SELECT entity, date, (score + score_b + score_c) / 3 AS mean_score, list_sort([score, score_b, score_c])[2] AS median_score,
   CAST(score >= 0.5 AS INTEGER) + CAST(score_b >= 0.5 AS INTEGER) + CAST(score_c >= 0.5 AS INTEGER) AS votes, greatest(score, score_b, score_c) - least(score, score_b, score_c) AS disagreement FROM scores""",
)
def consensus(t):
    return policy.consensus(base.scores(t), ["score", "score_b", "score_c"])


def _both(alert, p):
    return f"{p}c AS (SELECT fold_id, {conf(alert)} FROM scores GROUP BY 1), {p}f AS (SELECT *, {RATES} FROM {p}c), {p}w AS (SELECT min(recall) FILTER (tp + fn >= 4) AS worst_fold_recall, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn FROM {p}f), {p} AS (SELECT *, {RATES} FROM {p}w)"


@query(
    "not_worse_than",
    "recall:f precision:f b_recall:f b_precision:f passed:b",
    f"""WITH {S}, {_both('score >= 0.55', 'b')}, {_both('score >= 0.56', 'k')}
 SELECT k.recall, k.precision, b.recall AS b_recall, b.precision AS b_precision, k.recall >= b.recall AND k.npv >= b.npv AND k.precision > b.precision AND k.f1 > b.f1 AND k.fp < b.fp
   AND k.worst_fold_recall >= b.worst_fold_recall AND k.alert_rate <= b.alert_rate AS passed FROM b, k""",
)
def not_worse_than(t):
    s = base.scores(t)
    return policy.not_worse_than(
        policy.fold_summary(s, "y", F.col("score") >= 0.55, "fold_id"),
        policy.fold_summary(s, "y", F.col("score") >= 0.56, "fold_id"),
    )


@query(
    "incremental_watch",
    "tp:i fp:i fn:i tn:i recall:f precision:f added_alerts:i added_rate_negatives:f",
    f"""WITH {S}, {STATES}, b AS (SELECT *, score >= 0.6 AS base, (pc >= 3 AND score >= 0.5) OR (r <= 0.9 AND votes >= 2) AS ext FROM st),
 c AS (SELECT {conf('(base OR ext)')}, count(*) FILTER (ext AND NOT base) AS added_alerts, count(*) FILTER (ext AND NOT base AND y = 0) / CAST(greatest(count(*) FILTER (NOT base AND y = 0), 1) AS DOUBLE) AS added_rate_negatives FROM b)
 SELECT *, {RATES} FROM c""",
)
def incremental_watch(t):
    return policy.incremental_watch(
        with_votes(t), "y", F.col("score") >= 0.6, "pc", "score", 3, 0.5, "r", 0.9, "votes", 2
    )


@query(
    "ratio_metrics",
    "rows:i mae:f rmse:f r2:f spearman:f",
    f"""WITH {S}, k AS (SELECT future_ratio AS a, r AS p, rank() OVER (ORDER BY future_ratio) + (count(*) OVER (PARTITION BY future_ratio) - 1) / 2.0 AS ra, rank() OVER (ORDER BY r) + (count(*) OVER (PARTITION BY r) - 1) / 2.0 AS rp FROM scores)
 SELECT count(*) AS rows, avg(abs(a - p)) AS mae, sqrt(avg((a - p) * (a - p))) AS rmse, 1 - avg((a - p) * (a - p)) / var_pop(a) AS r2, corr(CAST(ra AS DOUBLE), CAST(rp AS DOUBLE)) AS spearman FROM k""",
)
def ratio_metrics(t):
    return policy.ratio_metrics(settled_scores(t), "future_ratio", "r")


@query(
    "replay",
    "entity:s date:d state:s y:i",
    f"WITH {S} SELECT entity, date, CASE WHEN score >= 0.6 THEN 'RED' WHEN score >= 0.5 THEN 'AMBER' ELSE 'GREEN' END AS state, y FROM scores",
)
def replay(t):
    s = base.scores(t)
    decided = policy.triage(s, "score", 0.5, 0.6)
    return policy.replay(decided.select("entity", "date", "state"), s, ["entity", "date"], "y")


@query(
    "signal_distribution",
    "y:i pc:i n:i",
    f"WITH {S}, {STATES} SELECT y, pc, count(*) AS n FROM st GROUP BY 1, 2",
)
def signal_distribution(t):
    return policy.signal_distribution(with_votes(t), "y", "pc")


@query(
    "signal_trade_off",
    "alert_cap:f threshold:f min_signals:i recall:f precision:f alert_rate:f",
    f"""WITH {S}, {STATES}, {grid_sql(None, (0.02, 0.98, 60))}, k AS (SELECT unnest([0, 1, 2, 3]) AS k), m AS (SELECT t, k, {conf('score >= t AND pc >= k')} FROM st, g, k GROUP BY 1, 2), r AS (SELECT *, {RATES} FROM m),
 c AS (SELECT unnest([0.15, 0.25, 0.35, 0.5]) AS cap), x AS (SELECT *, row_number() OVER (PARTITION BY cap ORDER BY recall DESC, precision DESC, t, k) AS i FROM r JOIN c ON alert_rate <= cap)
 SELECT cap AS alert_cap, t AS threshold, k AS min_signals, recall, precision, alert_rate FROM x WHERE i = 1""",
)
def signal_trade_off(t):
    return policy.signal_trade_off(settle(with_votes(t)), "y", "score", "pc")
