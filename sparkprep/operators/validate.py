"""Cross-validation, model comparison and learning curves (CV-1, CMP-1, VIZ-16).

Folds come from a hash of an integer key (``fold`` column).  Each fit is a
distributed pyspark.ml job over the persisted input; only the per-fold
metric values (models x folds x metrics numbers) are gathered, and the
roll-up is a DataFrame group-by.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprep.functions.exprs import HASH_MOD, split_hash
from sparkprep.functions.comoments import merged
from sparkprep.operators import linear_states
from sparkprep.operators import metrics as M
from sparkprep.operators.encode import kfold
from sparkprep.operators.models import (LABEL_COL, evaluate, fit_pipeline, problem_of,
                                        resolve_features)

FOLD_SCHEMA = "model string, metric string, fold int, value double"


def _metric_names(problem: str, metrics: Sequence[str] | None) -> list[str]:
    allowed = M.CLASSIFICATION_METRICS if problem == "classification" else M.REGRESSION_METRICS
    names = list(metrics or allowed)
    bad = [m for m in names if m not in allowed]
    if bad:
        raise ValueError(f"metrics {bad} do not apply to {problem}")
    return names


def _run_parallel(fn, tasks: list, parallelism: int) -> list:  # noqa: ANN001
    """Independent fits submitted from several driver threads (Spark runs the
    jobs concurrently, as CrossValidator(parallelism=...) does)."""
    if parallelism <= 1 or len(tasks) <= 1:
        return [fn(t) for t in tasks]
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        return list(pool.map(fn, tasks))


def fold_scores(df: DataFrame, target: str, model_type: str, key: str, cv_folds: int = 5,
                features: Sequence[str] | None = None, params: dict | None = None,
                metrics: Sequence[str] | None = None, seed: int = 42,
                parallelism: int = 4) -> list[tuple]:
    problem = problem_of(model_type)
    names = _metric_names(problem, metrics)
    feats = [c for c in resolve_features(df, target, features) if c not in (key, "fold")]
    own = "fold" not in df.columns  # compare_models hands over one frame with folds
    if linear_states.applies(df, feats, target, model_type, params):
        return _linear_fold_scores(kfold(df, key, cv_folds, seed) if own else df, target, feats, cv_folds, params, names)
    data = kfold(df, key, cv_folds, seed).persist(StorageLevel.MEMORY_AND_DISK) if own else df

    def one(f: int) -> list[tuple]:
        tr = data.where(F.col("fold") != f)
        te = data.where(F.col("fold") == f)
        fitted = fit_pipeline(tr, target, model_type, feats, params)
        scores = evaluate(fitted, te)
        return [(model_type, m, f, scores[m]) for m in names]

    try:
        parts = _run_parallel(one, list(range(cv_folds)), parallelism)
    finally:
        if own:
            data.unpersist()
    return [r for part in parts for r in part]


def _linear_fold_scores(data: DataFrame, target: str, feats: Sequence[str], cv_folds: int, params: dict | None,
                        names: Sequence[str]) -> list[tuple]:
    """Least squares of all folds from one scan; a second one only for absolute errors."""
    held, fits = linear_states.fold_fits(data, feats, target, cv_folds, params)
    rest = [m for m in names if m not in ("r2", "rmse")]
    errors = linear_states.absolute_errors(data, feats, target, fits) if rest else {}

    def value(f: int, m: str) -> float | None:
        if m in rest:
            return errors.get(f, {}).get(m)
        return fits[f].metric(m, held[f]) if f in held else None
    return [("linear_regression", m, f, value(f, m)) for f in range(cv_folds) for m in names]


def _linear_curve(data: DataFrame, target: str, feats: Sequence[str], cv_folds: int, sizes: Sequence[float], params: dict | None,
                  metric: str) -> list[tuple]:
    """All sizes and folds from one scan: states per (fold, smallest size that takes the row)."""
    order = sorted(sizes)
    step = F.lit(len(order))
    for i, s in reversed(list(enumerate(order))):
        step = F.when(F.col("_sub") < F.lit(float(s)), F.lit(i)).otherwise(step)
    width = len(order) + 1
    found = linear_states.states(data, feats, target, F.col("fold") * width + step)
    p = params or {}
    intercept = bool(p.get("fit_intercept", p.get("fitIntercept", True)))
    rows = []
    for s in sizes:
        for f in range(cv_folds):
            seen = merged([m for g, m in found.items() if g // width != f and g % width <= order.index(s)])
            held = merged([m for g, m in found.items() if g // width == f])
            fit = linear_states.solve(seen, intercept)
            rows.append((float(s), f, fit.metric(metric, seen), fit.metric(metric, held)))
    return rows


def cross_validate(df: DataFrame, target: str, model_type: str, key: str, cv_folds: int = 5,
                   features: Sequence[str] | None = None, params: dict | None = None,
                   metrics: Sequence[str] | None = None, seed: int = 42) -> DataFrame:
    """(model, metric, fold, value) for every fold; metric family from the model table."""
    rows = fold_scores(df, target, model_type, key, cv_folds, features, params, metrics, seed)
    return df.sparkSession.createDataFrame(rows, FOLD_SCHEMA)


def summarize_folds(folds: DataFrame) -> DataFrame:
    """(model, metric, mean, std, values) with population std, as CV reports use."""
    return folds.groupBy("model", "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.transform(F.array_sort(F.collect_list(F.struct("fold", "value"))),
                    lambda s: s["value"]).alias("values"))


def compare_models(df: DataFrame, target: str, model_types: Sequence[str], key: str,
                   cv_folds: int = 5, features: Sequence[str] | None = None,
                   metrics: Sequence[str] | None = None, params: dict | None = None,
                   seed: int = 42) -> DataFrame:
    """CV every model; rows sorted by the first metric (errors negated so
    that larger is always better, as in the ranking key ``sort_value``).
    Models of the wrong family for the target or failing fits are reported
    with ``error`` instead of aborting the comparison."""
    spark = df.sparkSession
    rows, errors = [], []
    first_metric = None
    data = kfold(df, key, cv_folds, seed).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for mt in model_types:
            try:
                problem = problem_of(mt)
                names = _metric_names(problem, metrics)
                first_metric = first_metric or names[0]
                rows.extend(fold_scores(data, target, mt, key, cv_folds, features,
                                        (params or {}).get(mt), names, seed))
            except Exception as e:  # noqa: BLE001 - reported per model instead of aborting
                errors.append((mt, str(e)))
    finally:
        data.unpersist()
    folds = spark.createDataFrame(rows, FOLD_SCHEMA)
    summary = summarize_folds(folds)
    lower_better = F.col("metric").isin("rmse", "mae", "mape")
    summary = summary.withColumn("sort_value", F.when(lower_better, -F.col("mean")).otherwise(F.col("mean")))
    err = spark.createDataFrame(errors, "model string, error string")
    first = F.col("metric") == F.lit(first_metric)
    # one row per (model, metric): bounded, so a global sort is cheap
    return (summary.join(err, "model", "full")
            .orderBy(first.desc_nulls_last(), F.desc_nulls_last("sort_value"), "model", "metric"))


def learning_curve(df: DataFrame, target: str, model_type: str, key: str, cv_folds: int = 5,
                   sizes: Sequence[float] = tuple(i / 10 for i in range(1, 11)),
                   features: Sequence[str] | None = None, params: dict | None = None,
                   metric: str | None = None, seed: int = 42, parallelism: int = 4) -> DataFrame:
    """(train_fraction, train_mean, train_std, cv_mean, cv_std).

    Training subsets are nested: a row is in the fraction-s subset of a fold
    when its second hash is below s, so every size reuses the same rows.
    """
    problem = problem_of(model_type)
    metric = metric or ("accuracy" if problem == "classification" else "r2")
    feats = [c for c in resolve_features(df, target, features) if c != key]
    data = kfold(df, key, cv_folds, seed).withColumn("_sub", split_hash(key, seed + 7919).cast("double") / F.lit(float(HASH_MOD)))
    if metric in ("r2", "rmse") and linear_states.applies(df, feats, target, model_type, params):
        return _curve(df.sparkSession, _linear_curve(data, target, feats, cv_folds, sizes, params, metric))
    data = data.persist(StorageLevel.MEMORY_AND_DISK)

    def one(task: tuple[float, int]) -> tuple:
        s, f = task
        in_train = (F.col("fold") != f) & (F.col("_sub") < F.lit(float(s)))
        fitted = fit_pipeline(data.where(in_train), target, model_type, feats, params)
        if metric in ("r2", "rmse", "mae", "mape", "accuracy"):
            # train and held-out rows scored in one grouped job
            role = F.when(F.col("fold") == f, "cv").otherwise("train")
            scored = fitted.transform(data.where(in_train | (F.col("fold") == f))).withColumn("_role", role)
            m = M.grouped_metric(scored, "_role", metric, LABEL_COL, "prediction")
            return (float(s), f, m.get("train"), m.get("cv"))
        tr, te = data.where(in_train), data.where(F.col("fold") == f)
        return (float(s), f, evaluate(fitted, tr)[metric], evaluate(fitted, te)[metric])

    try:
        rows = _run_parallel(one, [(s, f) for s in sizes for f in range(cv_folds)], parallelism)
    finally:
        data.unpersist()
    return _curve(df.sparkSession, rows)


def _curve(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    curve = spark.createDataFrame(rows, "train_fraction double, fold int, train double, cv double")
    return curve.groupBy("train_fraction").agg(
        F.avg("train").alias("train_mean"), F.stddev_pop("train").alias("train_std"),
        F.avg("cv").alias("cv_mean"), F.stddev_pop("cv").alias("cv_std"))
