"""Training and scoring on the panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbtide.operators import ml, policy
from ebbtide.operators.ordering import settle
from ebbtide.operators.windows import Series, below
from ebbtide.plans import base
from ebbtide.plans.base import scores_sql, settled_scores, week_panel_sql
from ebbtide.plans.policy_queries import FOLD_WINDOWS, TYPES
from ebbtide.plans.quality_queries import FEATURES, _MELT
from ebbtide.plans.registry import query
from ebbtide.plans.window_queries import lag, roll

INPUTS = ["score", "score_b", "score_c"]
_BOUNDS = f"""{scores_sql()}, l AS ({_MELT}), b AS (SELECT feature, quantile_cont(v, 0.01) AS low, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.99) AS high FROM l WHERE date < DATE '1999-01-01' GROUP BY 1)"""


@query("fit_clip", "feature:s low:f median:f high:f", f"WITH {_BOUNDS} SELECT * FROM b")
def fit_clip(t):
    return ml.fit_clip(base.scores(t).where("date < date'1999-01-01'"), FEATURES)


@query(
    "apply_clip",
    "entity:s date:d " + " ".join(f"{f}:f" for f in FEATURES),
    f"""WITH {_BOUNDS}, x AS (SELECT s.entity, s.date, {', '.join(f"greatest((SELECT low FROM b WHERE feature = '{f}'), least((SELECT high FROM b WHERE feature = '{f}'), coalesce({'CASE WHEN s.r > 1.5 THEN NULL ELSE s.score_b END' if f == 'score_b' else 's.' + f}, (SELECT median FROM b WHERE feature = '{f}')))) AS {f}" for f in FEATURES)} FROM scores s WHERE date >= DATE '1999-01-01') SELECT * FROM x""",
)
def apply_clip(t):
    s = settled_scores(t)
    bounds = ml.fit_clip(s.where("date < date'1999-01-01'"), FEATURES)
    later = s.where("date >= date'1999-01-01'").withColumn("score_b", F.when(~(F.col("r") > 1.5), F.col("score_b")))
    return ml.apply_clip(later, bounds, FEATURES)


def split(t):
    s = settled_scores(t)
    return s.where("date < date'1999-01-01'"), s.where("date >= date'1999-01-09'")


@query("fit_classifier", "kind:s roc_auc:f4 pr_auc:f4")
def fit_classifier(t):
    train, valid = split(t)
    out = None
    for kind in ("logistic", "forest", "boosted"):
        scored = ml.classify(ml.fit_classifier(train, INPUTS, "y", kind), valid, "p")
        one = policy.roc_auc(scored, "y", "p").join(F.broadcast(policy.average_precision(scored, "y", "p"))).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


@query("fit_regressor", "kind:s rows:i mae:f4 rmse:f4 r2:f4 spearman:f4")
def fit_regressor(t):
    train, valid = split(t)
    out = None
    for kind, logs in (("ridge", False), ("ridge", True), ("forest", False), ("boosted", False)):
        model = ml.fit_regressor(train, INPUTS, "future_ratio", kind, logs)
        scored = ml.predict_ratio(model, valid, "predicted", logs)
        one = policy.ratio_metrics(scored, "future_ratio", "predicted").withColumn("kind", F.lit(kind + ("_log" if logs else "")))
        out = one if out is None else out.unionByName(one)
    return out


def oof(t):
    folds = policy.purged_folds(base.scores(t), "date", FOLD_WINDOWS)
    return ml.oof_scores(folds, INPUTS, "y", {"logistic": "logistic", "forest": "forest"}, {"ridge": "ridge"})


@query("oof_scores", "entity:s date:d fold_id:i p_logistic:f4 p_forest:f4 ratio_ridge:f4 ratio_ridge_risk:f4")
def oof_scores(t):
    return oof(t)


@query("prequential_stack", "fold_id:i stack_mode:s rows:i mean_score:f4")
def prequential_stack(t):
    stacked = ml.prequential_stack(oof(t), "fold_id", "y", ["p_logistic", "p_forest", "ratio_ridge_risk"], "p_logistic", "score_b", "score_c")
    return stacked.groupBy("fold_id", "stack_mode").agg(F.count(F.lit(1)).alias("rows"), F.avg("stack_score").alias("mean_score"))


def weekly_inputs(t):
    s = Series("entity", "week_start")
    return base.week_panel(t, measures=("gross", "lines")).select(
        "entity", "week_start", "gross", "lines",
        F.coalesce(s.ratio_to_mean("gross", 4), F.lit(1.0)).alias("ratio4"),
        F.coalesce(s.pct_change("gross", 1), F.lit(0.0)).alias("change1"),
        F.coalesce(s.pct_change("lines", 2), F.lit(0.0)).alias("count_change2"),
        below(s.next_ratio("gross"), 0.80).alias("y"),
    )


@query("monthly_snapshot_scores", "entity:s week_start:d exposed_from:d train_rows:i snapshot_risk:f4")
def monthly_snapshot_scores(t):
    return ml.monthly_snapshot_scores(
        weekly_inputs(t), "week_start", "y", ["ratio4", "change1", "count_change2"]
    )


def market(t):
    return ml.market_features(base.week_panel(t, measures=("gross", "lines")), ["entity"], "week_start", "gross", "lines")


@query("walk_forward_market_forecast", "entity:s week_start:d train_h1:i train_h2:i predicted_value_h1:f0 predicted_value_h2:f0 predicted_count_h1:f0 predicted_count_h2:f0")
def walk_forward_market_forecast(t):
    return ml.walk_forward_market_forecast(market(t), "week_start")


_NEED = f"{lag('gross', 52, 'week_start')} IS NOT NULL"


@query(
    "market_forecast_origins",
    "entity:s week_start:d train_h1:i train_h2:i value_h1:b value_h2:b count_h1:b count_h2:b",
    f"""WITH {week_panel_sql()}, f AS (SELECT entity, week_start, {_NEED} AS ok, lead(gross, 1) OVER w IS NOT NULL AS k1, lead(gross, 2) OVER w IS NOT NULL AS k2 FROM wpanel WINDOW w AS (PARTITION BY entity ORDER BY week_start)),
 weeks AS (SELECT DISTINCT week_start AS origin FROM f WHERE ok),
 n AS (SELECT origin, count(*) FILTER (ok AND k1 AND week_start + 7 <= origin) AS train_h1, count(*) FILTER (ok AND k2 AND week_start + 14 <= origin) AS train_h2 FROM weeks, f GROUP BY 1)
 SELECT entity, week_start, train_h1, train_h2, train_h1 >= 80 AS value_h1, train_h2 >= 80 AS value_h2, train_h1 >= 80 AS count_h1, train_h2 >= 80 AS count_h2
 FROM f JOIN n ON origin = week_start WHERE ok""",
)
def market_forecast_origins(t):
    """Which origins get which forecasts, from how many known rows."""
    d = ml.walk_forward_market_forecast(market(t), "week_start")
    has = [F.col(f"predicted_{x}").isNotNull().alias(x) for x in ml.MARKET_TARGETS]
    return d.select("entity", "week_start", "train_h1", "train_h2", *has)


@query(
    "training_set_sizes",
    "anchor:d train_h1:i train_h2:i",
    f"""WITH {week_panel_sql()}, f AS (SELECT entity, week_start, {_NEED} AS ok, lead(gross, 1) OVER w IS NOT NULL AS k1, lead(gross, 2) OVER w IS NOT NULL AS k2 FROM wpanel WINDOW w AS (PARTITION BY entity ORDER BY week_start)),
 a AS (SELECT CAST(unnest(generate_series(DATE '1996-01-07', DATE '2001-10-21', INTERVAL 28 DAY)) AS DATE) AS anchor)
 SELECT anchor, count(*) FILTER (ok AND k1 AND week_start + 7 <= anchor) AS train_h1, count(*) FILTER (ok AND k2 AND week_start + 14 <= anchor) AS train_h2 FROM a, f GROUP BY 1""",
)
def training_set_sizes(t):
    m = market(t)
    span = m.agg(F.lit("1996-01-07").cast("date").alias("lo"), F.lit("2001-10-21").cast("date").alias("hi"))
    anchors = span.select(F.explode(F.sequence("lo", "hi", F.make_dt_interval(F.lit(28)))).alias("anchor"))
    return ml.training_set_sizes(m, "week_start", anchors)


TREES = [
    ([0, 1, -1, -1, -1], [0.5, 0.4, 0.0, 0.0, 0.0], [1, 2, -1, -1, -1], [4, 3, -1, -1, -1], [0.0, 0.0, 0.1, 0.35, 0.7]),
    ([2, -1, 0, -1, -1], [0.45, 0.0, 0.55, 0.0, 0.0], [1, -1, 3, -1, -1], [2, -1, 4, -1, -1], [0.0, 0.2, 0.0, 0.5, 0.9]),
    ([-1], [0.0], [-1], [-1], [0.25]),
]


@query(
    "forest_score",
    "entity:s date:d p:f",
    f"""WITH {scores_sql()} SELECT entity, date, (CASE WHEN score <= 0.5 THEN CASE WHEN score_b <= 0.4 THEN 0.1 ELSE 0.35 END ELSE 0.7 END
   + CASE WHEN score_c <= 0.45 THEN 0.2 WHEN score <= 0.55 THEN 0.5 ELSE 0.9 END + 0.25) / 3 AS p FROM scores""",
)
def forest_score(t):
    schema = "feature array<int>, threshold array<double>, left array<int>, right array<int>, p1 array<double>"
    trees = t.spark.createDataFrame(TREES, schema)
    return ml.forest_score(base.scores(t), trees, INPUTS, "p")


@query("score_latest", "case:s entity:s week_start:d status:s state:s base_probability:f4 adjusted_probability:f4")
def score_latest(t):
    """The newest week, whose label nobody knows, once as it is and once for an
    extract that one entity is missing from: no decision there."""
    d = settle(weekly_inputs(t))
    features = ["ratio4", "change1", "count_change2"]
    model = ml.fit_classifier(d.where("week_start < date'2001-06-01' and y is not null"), features, "y", "logistic")

    def scored(panel, case):
        out = ml.score_latest(panel, "entity", "week_start", ["gross", "lines"], TYPES, lambda p: p, model, features, "y", 0.3, 0.2, 0.5)
        return out.withColumn("case", F.lit(case))

    return scored(d, "complete").unionByName(scored(d.where(F.col("entity") != F.lit(TYPES[0])), "missing entity"))


_HC = (0.10, 0.15, 0.20, 0.25, 0.30)


@query(
    "target_choice",
    "horizon:i cut:f rows:i positives:i positive_rate:f segment_min:i rate_range:f eligible:b chosen:b",
    f"""WITH {base.panel_sql()}, r AS (SELECT entity, date, year(date) AS s, {', '.join(f"(CASE WHEN count(gross) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) = {h} THEN sum(gross) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) END) / nullif({h} * {roll('avg', 'gross', 28)}, 0) AS r{h}" for h in (3, 7, 14))} FROM panel),
 l AS ({' UNION ALL '.join(f"SELECT {h} AS horizon, s, r{h} AS ratio FROM r WHERE r{h} IS NOT NULL" for h in (3, 7, 14))}), c AS (SELECT unnest([{', '.join(f"CAST({c} AS DOUBLE)" for c in _HC)}]) AS cut),
 p AS (SELECT horizon, s, cut, count(*) AS n, count(*) FILTER (ratio < 1 - cut) AS k FROM l, c GROUP BY 1, 2, 3),
 t AS (SELECT horizon, cut, sum(n) AS rows, sum(k) AS positives, sum(k) / CAST(sum(n) AS DOUBLE) AS positive_rate, min(k) AS segment_min, max(k / CAST(n AS DOUBLE)) - min(k / CAST(n AS DOUBLE)) AS rate_range FROM p GROUP BY 1, 2),
 e AS (SELECT *, positive_rate BETWEEN 0.15 AND 0.4 AND segment_min >= 10 AS eligible FROM t),
 o AS (SELECT *, row_number() OVER (ORDER BY eligible DESC, horizon = 7 DESC, cut DESC, rate_range, horizon) AS i FROM e) SELECT *, i = 1 AND eligible AS chosen FROM o""",
)
def target_choice(t):
    s = Series("entity", "date")
    d = base.gross_days(t).select("date", *[s.forward_ratio("gross", h).alias(f"r{h}") for h in (3, 7, 14)])
    return ml.target_choice(d, {h: f"r{h}" for h in (3, 7, 14)}, _HC, F.year("date"))


@query("calibrate_scores", "chosen:s watch_threshold:f4 watch_fallback:b red_threshold:f4 red_fallback:b")
def calibrate_scores(t):
    best, _, thresholds = ml.calibrate_scores(
        base.scores(t), "date", "y", INPUTS, "1998-12-31", "2000-12-31", 0.8, 0.7, 0.6, 0.1
    )
    return thresholds.withColumn("chosen", F.lit(best))
