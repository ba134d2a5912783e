"""Training, out-of-fold scores and scoring with Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import timedelta
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.functions.scalars import clip, ratio_to_risk
from ebbtide.operators import policy
from ebbtide.operators.ordering import exact_quantiles, melt, settle
from ebbtide.operators.windows import Series

SEED = 42
#: Inverse penalty of the stacked model; Spark averages the loss, so the penalty falls with the rows.
STACK_C = 0.10
MAX_TREE_NODES = 5_000_000


# --- preparation ------------------------------------------------------------------


def fit_clip(train: DataFrame, features: Sequence[str], low: float = 0.01, high: float = 0.99, by: Sequence[str] = ()) -> DataFrame:
    """Clip bounds and median per feature, from the training rows only.

    A feature without a value gets zeros. One row per feature (and fold).
    """
    by = list(by)
    q = exact_quantiles(melt(train, by, features), "value", [low, 0.5, high], [*by, "feature"])
    names = [c for c in q.columns if c.startswith("q")]
    found = q.select(
        *by, "feature", F.col(names[0]).alias("low"), F.col(names[1]).alias("median"), F.col(names[2]).alias("high")
    )
    listed = train.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    groups = train.select(*by).distinct().join(F.broadcast(listed)) if by else listed
    return groups.join(found, [*by, "feature"], "left").na.fill(0.0, ["low", "median", "high"])


def apply_clip(df: DataFrame, bounds: DataFrame, features: Sequence[str]) -> DataFrame:
    """Fill with the stored median, then clip. The bounds travel as one row."""
    packed = bounds.where(F.col("feature").isin(*features)).agg(
        F.map_from_entries(F.collect_list(F.struct("feature", F.struct("low", "median", "high")))).alias("_b")
    )
    d = df.join(F.broadcast(packed))
    out = {}
    for f in features:
        b = F.col("_b")[f]
        out[f] = F.greatest(b["low"], F.least(b["high"], F.coalesce(F.col(f).cast("double"), b["median"])))
    return d.withColumns(out).drop("_b")


def balance_weight(df: DataFrame, label: str) -> DataFrame:
    """`weight`: each class counts the same in total."""
    counts = df.agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(label).cast("long")).alias("_p"))
    y = F.col(label) == 1
    n, p = F.col("_n"), F.greatest(F.col("_p"), F.lit(1))
    return df.join(F.broadcast(counts)).withColumn(
        "weight", F.when(y, n / (2.0 * p)).otherwise(n / (2.0 * F.greatest(n - p, F.lit(1))))
    ).drop("_n", "_p")


# --- models -----------------------------------------------------------------------


def _stages(features: Sequence[str], estimator) -> Pipeline:
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="error"),
            StandardScaler(inputCol="_raw", outputCol="_features", withMean=True, withStd=True),
            estimator,
        ]
    )


def fit_classifier(train: DataFrame, features: Sequence[str], label: str, kind: str, **params) -> PipelineModel:
    """Scaled, class-weighted logistic, forest or boosted trees."""
    common = {"featuresCol": "_features", "labelCol": label, "weightCol": "weight"}
    estimator = {
        "logistic": lambda: LogisticRegression(**common, **{"regParam": 0.02, "maxIter": 60, **params}),
        "forest": lambda: RandomForestClassifier(
            **common, seed=SEED, **{"numTrees": 40, "maxDepth": 6, "minInstancesPerNode": 7, **params}
        ),
        "boosted": lambda: GBTClassifier(**common, seed=SEED, **{"maxIter": 20, "maxDepth": 4, "stepSize": 0.1, **params}),
    }[kind]()
    return _stages(features, estimator).fit(balance_weight(train, label))


def classify(model: PipelineModel, df: DataFrame, out: str) -> DataFrame:
    # a forest trained without a positive row knows one class only
    scored = model.transform(df).withColumn(out, F.coalesce(F.get(vector_to_array("probability"), F.lit(1)), F.lit(0.0)))
    return scored.select(*df.columns, out)


def fit_regressor(train: DataFrame, features: Sequence[str], target: str, kind: str, log_target: bool = False,
                  low: float = 0.15, high: float = 3.0, **params) -> PipelineModel:
    """Future ratio, clipped and optionally in logs; rows without one do not train."""
    t = clip(F.col(target).cast("double"), low, high)
    d = train.where(F.col(target).isNotNull()).withColumn("_target", F.ln(t) if log_target else t)
    common = {"featuresCol": "_features", "labelCol": "_target"}
    estimator = {
        "ridge": lambda: LinearRegression(**common, **{"regParam": 0.05, "elasticNetParam": 0.0, **params}),
        "forest": lambda: RandomForestRegressor(
            **common, seed=SEED, **{"numTrees": 40, "maxDepth": 6, "minInstancesPerNode": 8, **params}
        ),
        "boosted": lambda: GBTRegressor(**common, seed=SEED, **{"maxIter": 20, "maxDepth": 4, "stepSize": 0.1, **params}),
    }[kind]()
    return _stages(features, estimator).fit(d)


def predict_ratio(model: PipelineModel, df: DataFrame, out: str, log_target: bool = False,
                  low: float = 0.15, high: float = 3.0) -> DataFrame:
    """Predicted ratio and the risk it implies."""
    p = F.exp("prediction") if log_target else F.col("prediction")
    p = F.greatest(F.lit(low), F.least(F.lit(high), p))
    scored = model.transform(df).withColumn(out, p)
    return scored.select(*df.columns, out).withColumn(f"{out}_risk", ratio_to_risk(F.col(out)))


Scorer = Callable[[DataFrame, DataFrame], DataFrame]


def oof_scores(
    folds: DataFrame, features: Sequence[str], label: str, classifiers: Mapping[str, str], regressors: Mapping[str, str] | None = None,
    ratio: str = "future_ratio", clip: bool = True,
) -> DataFrame:
    """Scores for each validation window from models trained before it.

    `folds` comes from `purged_folds`. The loop runs over the few folds; each
    fit is a distributed job over its training rows.
    """
    folds = settle(folds)
    ids = [r["fold_id"] for r in folds.select("fold_id").distinct().orderBy("fold_id").collect()]
    out = None
    for fid in ids:
        train = folds.where((F.col("fold_id") == fid) & (F.col("role") == "train"))
        valid = folds.where((F.col("fold_id") == fid) & (F.col("role") == "validate"))
        if clip:
            bounds = settle(fit_clip(train, features))
            train, valid = apply_clip(train, bounds, features), apply_clip(valid, bounds, features)
        train = settle(train)
        for name, kind in classifiers.items():
            valid = classify(fit_classifier(train, features, label, kind), valid, f"p_{name}")
        for name, kind in (regressors or {}).items():
            valid = predict_ratio(fit_regressor(train, features, ratio, kind), valid, f"ratio_{name}")
        out = valid if out is None else out.unionByName(valid)
    return out


def prequential_stack(oof: DataFrame, fold: str, label: str, features: Sequence[str], merchant: str, market: str, market_max: str) -> DataFrame:
    """Meta-score of each fold from a model over the folds before it; a fixed
    blend while there are too few rows or declines."""
    oof = settle(oof)
    sizes = oof.groupBy(fold).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("p")).orderBy(fold).collect()
    rows = positives = 0
    out = None
    for s in sizes:
        current = oof.where(F.col(fold) == s[fold])
        if rows < 120 or positives < 8 or positives == rows:
            scored = current.withColumn(
                "stack_score", 0.78 * F.col(merchant) + 0.14 * F.col(market) + 0.08 * F.col(market_max)
            ).withColumn("stack_mode", F.lit("fixed_cold_start"))
        else:
            model = fit_classifier(oof.where(F.col(fold) < s[fold]), features, label, "logistic", regParam=1 / (STACK_C * rows))
            scored = classify(model, current, "stack_score").withColumn("stack_mode", F.lit("prequential_logistic"))
        out = scored if out is None else out.unionByName(scored)
        rows, positives = rows + s["n"], positives + s["p"]
    return out


def monthly_snapshot_scores(
    df: DataFrame, day: str, label: str, features: Sequence[str], kind: str = "logistic", min_rows: int = 500, lag_days: int = 14,
    by: Sequence[str] = ("entity",),
) -> DataFrame:
    """One frozen model per calendar month, trained on labels at least
    `lag_days` old; its scores are exposed one week later. Rows of a month
    without enough labels take their entity's last score; rows before the
    first model have none, without any model no row has one."""
    d = settle(df.withColumn("_month", F.trunc(day, "month")))
    months = [r["_month"] for r in d.select("_month").distinct().orderBy("_month").collect()]
    out, skipped = None, []
    for m in months:
        cutoff = F.date_sub(F.lit(m), lag_days)
        known = d.where((F.col(day) <= cutoff) & F.col(label).isNotNull())
        size = known.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(label).alias("k")).first()
        if size["n"] < min_rows or size["k"] < 2:
            skipped.append(m)
            continue
        model = fit_classifier(known, features, label, kind)
        scored = classify(model, d.where(F.col("_month") == F.lit(m)), "snapshot_risk").withColumns(
            {"train_rows": F.lit(size["n"]), "label_cutoff": cutoff}
        )
        out = scored if out is None else out.unionByName(scored)
    empty = {"snapshot_risk": F.lit(None).cast("double"), "train_rows": F.lit(None).cast("int"), "label_cutoff": F.lit(None).cast("date")}
    if out is None:
        out = d.where(F.col("_month").isNotNull()).withColumns(empty)
    elif skipped:
        out = out.unionByName(d.where(F.col("_month").isin(*skipped)).withColumns(empty))
        past = Window.partitionBy(*by).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumns({c: F.last(c, ignorenulls=True).over(past) for c in empty})
    return out.drop("_month").withColumn("exposed_from", F.date_add(day, 7))


#: Lags and rolling spans of the weekly forecaster, in weeks.
MARKET_LAGS = (1, 2, 3, 4, 8, 13, 26, 52)
MARKET_SPANS = (4, 8, 13, 26, 52)


def market_features(panel: DataFrame, entity: Sequence[str], week: str, value: str, count: str) -> DataFrame:
    """Log levels, lags, rolling means and deviations, calendar position and
    trend for the weekly forecaster, with the h1 and h2 targets."""
    s = Series(list(entity), week)
    d = panel.withColumns({f"log_{n}": F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0))) for n, c in (("value", value), ("count", count))})
    more = {}
    for name in ("value", "count"):
        c = f"log_{name}"
        more.update({f"{c}_lag_{k}": s.lag(c, k) for k in MARKET_LAGS})
        for w in MARKET_SPANS:
            more[f"{c}_mean_{w}"], more[f"{c}_std_{w}"] = s.rolling(c, w), s.rolling(c, w, "std")
        more.update({f"{name}_h{h}": s.lead(c, h) for h in (1, 2)})
    angle = 2 * F.pi() * F.weekofyear(week) / 52.18
    more.update({"week_sin": F.sin(angle), "week_cos": F.cos(angle), "trend": (s.row_no() - 1).cast("double")})
    return d.withColumns(more)


MARKET_INPUTS = tuple(
    [f"log_{n}" for n in ("value", "count")]
    + [f"log_{n}_lag_{k}" for n in ("value", "count") for k in MARKET_LAGS]
    + [f"log_{n}_{f}_{w}" for n in ("value", "count") for w in MARKET_SPANS for f in ("mean", "std")]
    + ["week_sin", "week_cos", "trend"]
)
MARKET_TARGETS = ("value_h1", "value_h2", "count_h1", "count_h2")


def week_statistics(d: DataFrame, week: str, inputs: Sequence[str], targets: Sequence[str], shift: Sequence[float]) -> dict:
    """{week: per target (rows, Z'Z, Z'y, y'y)} with Z = (1, inputs - shift).

    Rows are summed to one set of matrices per week and task, then per week;
    what reaches the driver is as long as the calendar. Only rows with all
    inputs count, for each target those that have it.
    """
    size, moved = len(inputs) + 1, np.array(shift)

    def partial(batches):
        sums: dict = {}
        for b in batches:
            z = np.c_[np.ones(len(b)), np.column_stack([b[c].to_numpy(zero_copy_only=False) for c in inputs]) - moved]
            y = np.column_stack([b[c].cast(pa.float64()).to_numpy(zero_copy_only=False) for c in targets])
            weeks, place = np.unique(b[week].to_numpy(zero_copy_only=False), return_inverse=True)
            for i, w in enumerate(weeks.tolist()):
                here = place == i
                for k in range(len(targets)):
                    known = here & ~np.isnan(y[:, k])
                    zk, yk = z[known], y[known, k]
                    stats = np.concatenate([(zk.T @ zk).ravel(), zk.T @ yk, [yk @ yk]])
                    sums[w, k] = sums.get((w, k), 0.0) + stats
        yield from out(sums)

    def out(sums):
        if sums:
            keys = list(sums)
            columns = [pa.array([w for w, _ in keys], pa.date32()), pa.array([k for _, k in keys], pa.int32()), pa.array([sums[k].tobytes() for k in keys], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["week", "target", "stats"])

    def total(batches):
        sums: dict = {}
        for b in batches:
            for w, k, raw in zip(*(b[c].to_pylist() for c in ("week", "target", "stats")), strict=True):
                sums[w, k] = sums.get((w, k), 0.0) + np.frombuffer(raw)
        yield from out(sums)

    shape = "week date, target int, stats binary"
    rows = d.select(week, *inputs, *targets).na.drop(subset=list(inputs))
    summed = rows.mapInArrow(partial, shape).repartition("week").mapInArrow(total, shape)
    found: dict = {}
    for r in summed.collect():
        v = np.frombuffer(r["stats"])
        found.setdefault(r["week"], {})[r["target"]] = (v[: size * size].reshape(size, size), v[size * size : -1], v[-1])
    return found


def ridge_from_statistics(zz: np.ndarray, zy: np.ndarray, alpha: float) -> np.ndarray:
    """(intercept, coefficients) of the ridge regression on standardised inputs
    with penalty `alpha`, from the sums alone; constant inputs get 0."""
    n, mean = zz[0, 0], zz[0, 1:] / zz[0, 0]
    spread = zz[1:, 1:] / n - np.outer(mean, mean)
    scale = np.sqrt(np.clip(np.diag(spread), 0, None))
    free = scale > 1e-9
    cross = zy[1:] / n - mean * zy[0] / n
    out = np.zeros(len(zy))
    if free.any():
        unit = scale[free]
        a = spread[np.ix_(free, free)] / np.outer(unit, unit) + alpha / n * np.eye(int(free.sum()))
        out[1:][free] = np.linalg.solve(a, cross[free] / unit) / unit
    out[0] = zy[0] / n - out[1:] @ mean
    return out


def walk_forward_market_forecast(
    features: DataFrame, week: str, alpha: float = 1.0, min_rows: int = 80, inputs: Sequence[str] = MARKET_INPUTS, targets: Sequence[str] = MARKET_TARGETS
) -> DataFrame:
    """h1 and h2 forecasts of value and count, refitted every week.

    A row may train a model only when its target week lies at or before the
    origin. Ridge regressions need sums of products only, so these are added
    up per week in one pass and accumulated over the weeks; every origin's
    model is solved from its prefix. Adds `train_h1`, `train_h2` and the
    forecasts, NULL where fewer than `min_rows` rows may train.
    """
    d = settle(features.na.drop(subset=list(inputs)))
    spark = d.sparkSession
    means = d.agg(*[F.avg(c) for c in inputs]).first()
    shift = [m or 0.0 for m in means]
    weekly = week_statistics(d, week, inputs, targets, shift)
    weeks = sorted(r[0] for r in d.select(week).distinct().collect())  # the calendar
    size, models = len(inputs) + 1, []
    sums = [(np.zeros((size, size)), np.zeros(size)) for _ in targets]
    ready = sorted(((w + timedelta(days=7 * int(t[-1])), k, w) for w, found in weekly.items() for k, t in enumerate(targets) if k in found), key=lambda x: (x[0], x[1]))
    at = 0
    for origin in weeks:
        while at < len(ready) and ready[at][0] <= origin:
            _, k, w = ready[at]
            zz, zy, _ = weekly[w][k]
            sums[k] = (sums[k][0] + zz, sums[k][1] + zy)
            at += 1
        row: list = [origin]
        for zz, zy in sums:
            solved = ridge_from_statistics(zz, zy, alpha) if zz[0, 0] >= min_rows else None
            row += [int(zz[0, 0]), None if solved is None else [float(x) for x in solved]]
        models.append(tuple(row))
    shape = ", ".join([f"{week} date", *(f"n_{t} bigint, model_{t} array<double>" for t in targets)])
    table = F.broadcast(spark.createDataFrame(models, shape))  # a row per week of the calendar
    x = F.array(F.lit(1.0), *[F.col(c) - F.lit(float(m)) for c, m in zip(inputs, shift, strict=True)])

    def predicted(t: str) -> Column:
        products = F.zip_with(F.col("_x"), F.col(f"model_{t}"), lambda a, b: a * b)
        return F.expm1(F.greatest(F.aggregate(products, F.lit(0.0), lambda total, p: total + p), F.lit(0.0)))

    scored = d.withColumn("_x", x).join(table, week, "left")
    out = {f"predicted_{t}": F.when(F.col(f"model_{t}").isNotNull(), predicted(t)) for t in targets}
    sizes = {f"train_h{h}": F.col(f"n_{next(t for t in targets if t.endswith(f'h{h}'))}") for h in (1, 2) if any(t.endswith(f"h{h}") for t in targets)}
    return scored.withColumns({**sizes, **out}).drop("_x", *[f"{p}_{t}" for t in targets for p in ("n", "model")])


def training_set_sizes(features: DataFrame, week: str, anchors: DataFrame) -> DataFrame:
    """Rows each anchor may train on, per horizon, without looping.

    `anchors` is a column `anchor` of dates; counts come from a running total
    over weeks.
    """
    weekly = features.na.drop(subset=list(MARKET_INPUTS)).groupBy(week).agg(
        F.count("value_h1").alias("c1"), F.count("value_h2").alias("c2")
    )
    marks = weekly.select(F.date_add(week, 7).alias("known"), "c1", F.lit(0).alias("c2"), F.lit(0).alias("_a")).unionByName(
        weekly.select(F.date_add(week, 14).alias("known"), F.lit(0).alias("c1"), "c2", F.lit(0).alias("_a"))
    ).unionByName(anchors.select(F.col("anchor").alias("known"), F.lit(0).alias("c1"), F.lit(0).alias("c2"), F.lit(1).alias("_a")))
    per = marks.groupBy("known").agg(F.sum("c1").alias("c1"), F.sum("c2").alias("c2"), F.max("_a").alias("_a"))
    s = Series([], "known")
    upto = s.frame(-(2**31) + 1, 0)
    return per.select(
        F.col("known").alias("anchor"), "_a", F.sum("c1").over(upto).alias("train_h1"), F.sum("c2").over(upto).alias("train_h2")
    ).where("_a = 1").drop("_a")


# --- scoring ------------------------------------------------------------------------


def forest_score(
    df: DataFrame, trees: DataFrame, features: Sequence[str], out: str = "score", max_nodes: int = MAX_TREE_NODES
) -> DataFrame:
    """Mean leaf probability over a stored ensemble.

    `trees`: arrays feature, threshold, left, right, p1 per tree; feature < 0
    marks a leaf. The ensemble is a model artifact; it may have `max_nodes`
    nodes, as it is shipped to the tasks, which descend all rows of a batch together.
    """
    nodes = trees.agg(F.sum(F.size("feature"))).first()[0] or 0
    if nodes == 0 or nodes > max_nodes:
        raise ValueError(f"ensemble with {nodes} nodes")
    packed = [
        tuple(np.asarray(r[c]) for c in ("feature", "threshold", "left", "right", "p1"))
        for r in trees.select("feature", "threshold", "left", "right", "p1").collect()
    ]
    shared = df.sparkSession.sparkContext.broadcast(packed)

    @F.pandas_udf(T.DoubleType())
    def score(rows: pd.DataFrame) -> pd.Series:
        x = rows.to_numpy(dtype=float)
        index = np.arange(len(x))
        total = np.zeros(len(x))
        for feature, threshold, left, right, p1 in shared.value:
            node = np.zeros(len(x), dtype=int)
            inner = feature[node] >= 0
            while inner.any():
                at = node[inner]
                goes_left = x[index[inner], feature[at]] <= threshold[at]
                node[inner] = np.where(goes_left, left[at], right[at])
                inner = feature[node] >= 0
            total += p1[node]
        return pd.Series(total / len(shared.value))

    return df.withColumn(out, score(F.struct(*[F.col(f).cast("double").alias(f) for f in features])))


def score_latest(
    panel: DataFrame, entity: str, week: str, values: Sequence[str], expected: Sequence[str], featurize: Callable[[DataFrame], DataFrame],
    model: PipelineModel, features: Sequence[str], label: str, reference: float, watch: float, red: float,
    min_labels: int = 500, min_positives: int = 20,
) -> DataFrame:
    """Gate, features, model, prior shift and state for the newest week. When
    the gate is closed, a feature of an entity is missing or too few labels
    are known, its rows carry NO_DECISION and no score."""
    gate = policy.source_gate(panel, entity, week, values, expected)
    feats = featurize(panel)
    whole = reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in features])
    complete = feats.where(whole)
    known = feats.agg(F.count(label).alias("_labels"), F.sum(F.col(label).cast("long")).alias("_positives"))
    newest = panel.agg(F.max(week).alias("_latest"))
    scored = classify(model, complete, "base_probability")
    shifted = policy.prior_shift_state(
        scored.select(entity, week, "base_probability", label), entity, week, label, "base_probability", reference, watch, red
    )
    latest = feats.join(F.broadcast(newest)).where(F.col(week) == F.col("_latest")).select(entity, week)
    latest = latest.join(shifted.withColumnRenamed("state", "_state").select(entity, week, "base_probability", "adjusted", "_state"), [entity, week], "left")
    enough = (F.col("_labels") >= min_labels) & (F.col("_positives") >= min_positives)
    scored_row = F.col("base_probability").isNotNull()
    passed = F.col("status") == "OK"
    open_gate = passed & enough & scored_row
    return latest.join(F.broadcast(gate)).join(F.broadcast(known)).select(
        entity,
        week,
        F.when(passed & ~(enough & scored_row), "NO_DECISION").otherwise(F.col("status")).alias("status"),
        F.when(open_gate, F.col("base_probability")).alias("base_probability"),
        F.when(open_gate, F.col("adjusted")).alias("adjusted_probability"),
        F.when(open_gate, F.col("_state")).when(passed, "AMBER").otherwise(F.col("state")).alias("state"),
        F.when(passed & ~enough, "too few known labels").when(passed & ~scored_row, "missing features").otherwise(F.col("reason")).alias("reason"),
    )


def target_choice(
    df: DataFrame, ratios: Mapping[int, str], cuts: Sequence[float], segment: Column, min_positives: int = 10,
    low: float = 0.15, high: float = 0.40,
) -> DataFrame:
    """All (horizon, cut-off) pairs with rate, positives per segment, whether
    they are usable and which is chosen: 7 days first, then the largest drop,
    then the steadiest."""
    long = df.select(segment.alias("_s"), *[F.col(c).cast("double").alias(str(h)) for h, c in ratios.items()]).unpivot(
        ["_s"], [str(h) for h in ratios], "horizon", "ratio"
    ).where("ratio is not null")
    hits = [F.count_if(F.col("ratio") < 1.0 - c).alias(f"c{i}") for i, c in enumerate(cuts)]
    per = long.groupBy("horizon", "_s").agg(F.count(F.lit(1)).alias("n"), *hits)
    options = F.array(*[F.struct(F.lit(float(c)).alias("cut"), F.col(f"c{i}").alias("k")) for i, c in enumerate(cuts)])
    cells = per.select("horizon", "_s", "n", F.explode(options).alias("_o")).select(
        "horizon", "_s", "n", F.col("_o.cut").alias("cut"), F.col("_o.k").alias("k")
    )
    rate = F.col("k") / F.col("n")
    table = cells.groupBy(F.col("horizon").cast("int").alias("horizon"), "cut").agg(
        F.sum("n").alias("rows"),
        F.sum("k").alias("positives"),
        (F.sum("k") / F.sum("n")).alias("positive_rate"),
        F.min("k").alias("segment_min"),
        (F.max(rate) - F.min(rate)).alias("rate_range"),
    )
    usable = F.col("positive_rate").between(low, high) & (F.col("segment_min") >= min_positives)
    table = settle(table.withColumn("eligible", usable))
    best = table.where("eligible").agg(
        F.max_by(
            F.struct("horizon", "cut"), F.struct((F.col("horizon") == 7).cast("int"), F.col("cut"), -F.col("rate_range"), -F.col("horizon"))
        ).alias("_b")
    )
    return table.join(F.broadcast(best)).withColumn(
        "chosen", F.coalesce((F.col("horizon") == F.col("_b.horizon")) & (F.col("cut") == F.col("_b.cut")), F.lit(False))
    ).drop("_b")


def calibrate_scores(
    oof: DataFrame, day: str, label: str, candidates: Sequence[str], selection_end: str, policy_end: str,
    recall_min: float, npv_min: float, red_precision: float, red_fpr: float,
) -> tuple[str, DataFrame, DataFrame]:
    """Pick the score column with the best PR-AUC on an early window, fit a
    one-variable logistic on it there, set thresholds on a later window.

    Returns (column, calibrated rows after the selection window, thresholds).
    """
    oof = settle(oof)
    first = oof.where(F.col(day) <= F.lit(selection_end).cast("date"))
    later = oof.where((F.col(day) > F.lit(selection_end).cast("date")) & (F.col(day) <= F.lit(policy_end).cast("date")))
    ranked = {c: policy.average_precision(first, label, c).first()["pr_auc"] or 0.0 for c in candidates}
    best = max(sorted(ranked), key=lambda c: ranked[c])
    model = fit_classifier(first.withColumn("_one", F.col(best)), ["_one"], label, "logistic", regParam=0.0)
    rows = settle(classify(model, later.withColumn("_one", F.col(best)), "calibrated").drop("_one"))
    return best, rows, policy.watch_red(rows, label, "calibrated", recall_min, npv_min, red_precision, red_fpr)
