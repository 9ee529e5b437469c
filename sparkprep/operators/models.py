"""Estimators, training, saving and batch scoring (EST, REC, TRN, MDL, SCR-1).

Everything learned - string feature indexers, the label indexer, the
estimator - lives in one fitted ``PipelineModel`` saved as a directory, so
scoring never refits an encoder on the data being scored.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, RandomForestClassifier
from pyspark.ml.feature import IndexToString, SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, LinearRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (BooleanType, DateType, NumericType, StringType, TimestampNTZType,
                               TimestampType)

from sparkprep.operators import metrics as M
from sparkprep.operators.boosting import BoostedTrees
from sparkprep.operators.cell_forest import CellForestRegressor
from sparkprep.operators.table_encoder import TableIndexer

MODEL_TABLE = {
    "linear_regression": "regression",
    "random_forest_regressor": "regression",
    "xgboost_regressor": "regression",
    "logistic_regression": "classification",
    "random_forest_classifier": "classification",
    "xgboost_classifier": "classification",
}

FEATURES_COL = "__features"
LABEL_COL = "__label"


def problem_of(model_type: str) -> str:
    if model_type not in MODEL_TABLE:
        raise ValueError(f"Unsupported model type: {model_type}")
    return MODEL_TABLE[model_type]


def infer_problem(df: DataFrame, target: str) -> str:
    """classification for string/boolean/integer-like targets, else regression."""
    t = df.schema[target].dataType
    s = t.simpleString()
    if isinstance(t, (StringType, BooleanType)) or "int" in s:
        return "classification"
    return "regression"


#: What a model gets where the caller says nothing.
DEFAULTS = {
    "linear_regression": {"fit_intercept": True},
    "logistic_regression": {"C": 1.0, "penalty": "l2", "max_iter": 100},
    "random_forest_regressor": {"n_estimators": 100, "max_depth": None},
    "random_forest_classifier": {"n_estimators": 100, "max_depth": None},
    "xgboost_regressor": {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 6},
    "xgboost_classifier": {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 6},
}
MAX_LABELS = 100_000  # values of a text feature that a fitted indexer keeps on the driver
SPARK_MAX_DEPTH = 30  # pyspark.ml grows no deeper tree
#: Further parameters of boosted trees, and the estimator's name for each.
_BOOSTED = {"reg_lambda": "regLambda", "gamma": "gamma", "min_child_weight": "minChildWeight", "max_bin": "maxBins",
            "colsample_bytree": "columnRate"}
#: The pyspark.ml name that makes a default unnecessary.
_NATIVE = {"n_estimators": ("numTrees", "maxIter"), "max_depth": ("maxDepth",), "learning_rate": ("stepSize",),
           "max_iter": ("maxIter",), "fit_intercept": ("fitIntercept",), "C": ("regParam",), "penalty": ("regParam",)}


def with_defaults(model_type: str, params: dict | None) -> dict:
    given = dict(params or {})
    for name, value in DEFAULTS[model_type].items():
        if name not in given and not any(n in given for n in _NATIVE.get(name, ())):
            given[name] = value
    return given


def translate_params(model_type: str, params: dict | None, n_rows: int | None = None) -> dict:
    """scikit-learn-style hyper-parameter names -> pyspark.ml parameter names.

    ``max_depth`` None means as deep as Spark allows (30); more raises.  An
    unpenalised logistic fit is ``penalty`` "none"; else regParam = 1 / (C n).
    """
    p = dict(params or {})
    out: dict = {}
    boosted = model_type.startswith("xgboost")
    for name, native in _BOOSTED.items() if boosted else ():
        if name in p:
            out[native] = p.pop(name)
    if "n_estimators" in p:
        out["numTrees" if "random_forest" in model_type else "maxIter"] = int(p.pop("n_estimators"))
    if "max_depth" in p:
        d = p.pop("max_depth")
        if d is not None and int(d) > SPARK_MAX_DEPTH:
            raise ValueError(f"max_depth {d} is beyond Spark's limit of {SPARK_MAX_DEPTH}")
        out["maxDepth"] = SPARK_MAX_DEPTH if d is None else int(d)
    if boosted and ("min_samples_leaf" in p or "min_samples_split" in p):
        raise ValueError("boosted trees bound a child by min_child_weight")
    if "min_samples_leaf" in p:
        out["minInstancesPerNode"] = int(p.pop("min_samples_leaf"))
    if "min_samples_split" in p:
        split = int(p.pop("min_samples_split"))
        out["minInstancesPerNode"] = max(out.get("minInstancesPerNode", 1), math.ceil(split / 2))
    if "bootstrap" in p:
        out["bootstrap"] = bool(p.pop("bootstrap"))
    if "learning_rate" in p:
        out["stepSize"] = float(p.pop("learning_rate"))
    if "subsample" in p:
        out["subsamplingRate"] = float(p.pop("subsample"))
    if "fit_intercept" in p:
        out["fitIntercept"] = bool(p.pop("fit_intercept"))
    if "normalize" in p:
        out["standardization"] = bool(p.pop("normalize"))
    if "max_iter" in p:
        out["maxIter"] = int(p.pop("max_iter"))
    if "C" in p or "penalty" in p:
        c = float(p.pop("C", 1.0))
        penalty = p.pop("penalty", "l2")
        if penalty not in ("none", None) and not n_rows:
            raise ValueError("a penalty needs the number of training rows")
        out["regParam"] = 0.0 if penalty in ("none", None) else 1.0 / (c * n_rows)
        out["elasticNetParam"] = {"l2": 0.0, "l1": 1.0, "elasticnet": float(p.pop("l1_ratio", 0.5))}.get(penalty, 0.0)
    p.pop("solver", None)
    seed = p.pop("random_state", None)
    if seed is not None and model_type not in ("linear_regression", "logistic_regression"):
        out["seed"] = int(seed)
    out.update(p)  # anything left is taken as a pyspark.ml name
    return out


def make_estimator(model_type: str, params: dict | None = None, n_classes: int = 2, forest: type | None = None):  # noqa: ANN201
    params = dict(params or {})
    seed = params.pop("seed", 42)
    common = {"featuresCol": FEATURES_COL, "labelCol": LABEL_COL}
    if model_type == "linear_regression":
        params.setdefault("regParam", 0.0)
        return LinearRegression(**common, **params)
    if model_type == "random_forest_regressor":
        return (forest or RandomForestRegressor)(**common, seed=seed, **params)
    if model_type == "xgboost_regressor":
        return BoostedTrees(**common, objective="squared", seed=seed, **params)
    if model_type == "logistic_regression":
        params.setdefault("family", "auto")
        params.setdefault("standardization", False)  # penalty on raw coefficients, like C
        return LogisticRegression(**common, **params)
    if model_type == "random_forest_classifier":
        return RandomForestClassifier(**common, seed=seed, **params)
    if model_type == "xgboost_classifier":
        objective = "softmax" if n_classes > 2 else "logistic"
        return BoostedTrees(**common, objective=objective, numClasses=n_classes, seed=seed, **params)
    raise ValueError(f"Unsupported model type: {model_type}")


@dataclass
class FittedModel:
    pipeline: PipelineModel
    model_type: str
    target: str
    features: list[str]
    problem: str
    label_labels: list[str] | None = None
    meta: dict = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        """Input + ``__features``/``prediction`` (+ probability for classifiers)."""
        data = df
        if self.target in df.columns:
            data = add_label(data, self.target, self.problem, self.label_labels)
        return self.pipeline.transform(data)

    def predict(self, df: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
        """Input columns + ``prediction`` (the class itself: text for string
        targets, a double for numeric ones); classifiers with probabilities add
        ``score`` (of the second class) when binary, else ``probabilities`` in
        the order of ``label_labels``."""
        out = self.pipeline.transform(df)
        cols = [F.col(c) for c in (keep or df.columns)]
        pred = F.col("prediction")
        if self.label_labels is not None:
            out = IndexToString(inputCol="prediction", outputCol="__class", labels=self.label_labels).transform(out)
            pred = F.col("__class").cast("double") if self.meta.get("numeric_label") else F.col("__class")
        extra = []
        if "probability" in out.columns and self.problem == "classification":
            p = vector_to_array(F.col("probability"))
            extra.append(p[1].alias("score") if self.meta.get("n_classes", 2) == 2 else p.alias("probabilities"))
        return out.select(*cols, pred.alias("prediction"), *extra)

    def importances(self) -> list[tuple[str, float]]:
        """(feature, importance), best first: impurity gains of trees, absolute
        coefficients (several classes: their sum)."""
        est = self.pipeline.stages[-1]
        if isinstance(est, LogisticRegressionModel):
            vals = abs(est.coefficientMatrix.toArray()).sum(axis=0).tolist()
        elif isinstance(est, LinearRegressionModel):
            vals = abs(est.coefficients.toArray()).tolist()
        else:
            vals = est.featureImportances.toArray().tolist()
        names = self.meta.get("assembled", self.features)
        return sorted(zip(names, vals), key=lambda t: (-t[1], t[0]))

    def importance_frame(self, spark: SparkSession, top: int | None = None) -> DataFrame:
        rows = [(f, float(v), i + 1) for i, (f, v) in enumerate(self.importances())]
        if top is not None:
            rows = rows[:top]
        return spark.createDataFrame(rows, "feature string, importance double, rank int")

    def save(self, path: str) -> str:
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        spark = SparkSession.getActiveSession()
        meta = {"model_type": self.model_type, "target": self.target, "features": self.features,
                "problem": self.problem, "label_labels": self.label_labels, "meta": self.meta}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1) \
            .write.mode("overwrite").text(f"{path}/meta")
        return path

    @staticmethod
    def load(path: str) -> FittedModel:
        spark = SparkSession.getActiveSession()
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        return FittedModel(PipelineModel.load(f"{path}/pipeline"), meta["model_type"], meta["target"],
                           meta["features"], meta["problem"], meta["label_labels"], meta["meta"])


def _class_text(df: DataFrame, target: str):  # noqa: ANN202
    c = F.col(target)
    return (c.cast("double") if isinstance(df.schema[target].dataType, NumericType) else c).cast("string")


def add_label(df: DataFrame, target: str, problem: str, labels: list[str] | None) -> DataFrame:
    """``__label``: the number, or the class's index; a class unseen in training
    has the index after the last, so no prediction is ever right for it."""
    if labels is None:
        return df.withColumn(LABEL_COL, F.col(target).cast("double"))
    indexer = StringIndexerModel.from_labels(labels, inputCol="__class_text", outputCol="__class_index",
                                             handleInvalid="keep")
    out = indexer.transform(df.withColumn("__class_text", _class_text(df, target)))
    # the arithmetic drops the indexer's metadata, which would count the class "unseen" in
    label = F.when(F.col("__class_text").isNotNull(), F.col("__class_index") + F.lit(0.0))
    return out.withColumn(LABEL_COL, label).drop("__class_text", "__class_index")


def label_labels(df: DataFrame, target: str, problem: str) -> list[str] | None:
    """Sorted class names (numeric targets: by number).  They live on the driver,
    as in any fitted indexer; a classifier keeps parameters per class as well, so
    a target of more than ``MAX_CLASSES`` values is refused."""
    if problem != "classification":
        return None
    found = df.select(_class_text(df, target).alias("v")).where(F.col("v").isNotNull()).distinct()
    rows = found.limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"target {target!r} has more than {MAX_CLASSES} distinct values; it is not a class")
    names = [r["v"] for r in rows]
    return sorted(names, key=float) if isinstance(df.schema[target].dataType, NumericType) else sorted(names)


def feature_stages(df: DataFrame, features: Sequence[str]) -> tuple[list, list[str]]:
    """String features -> one multi-column StringIndexer (a single pass over
    the data for all of them), those of more than ``MAX_LABELS`` values a
    ``TableIndexer`` each; numeric/boolean features pass through."""
    stages, assembled, strings = [], [], []
    for c in features:
        t = df.schema[c].dataType
        if isinstance(t, StringType):
            strings.append(c)
            assembled.append(f"{c}__code")
        elif isinstance(t, (NumericType, BooleanType)):
            assembled.append(c)
        elif isinstance(t, (DateType, TimestampType, TimestampNTZType)):
            raise ValueError(f"feature {c} is a date/time column; derive datetime features first")
        else:
            raise ValueError(f"feature {c} has unsupported type {t.simpleString()}")
    if strings:
        sizes = df.agg(*[F.approx_count_distinct(F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(strings)]).first()
        few = [c for c, n in zip(strings, sizes) if n <= MAX_LABELS]
        if few:
            stages.append(StringIndexer(inputCols=few, outputCols=[f"{c}__idx" for c in few],
                                        stringOrderType="alphabetAsc", handleInvalid="keep"))
        # the map of a column of many values stays a table
        stages += [TableIndexer(c, f"{c}__idx") for c in strings if c not in few]
        # codes are plain numbers to every model (arithmetic drops the nominal metadata, and
        # with it the trees' limit of maxBins categories)
        codes = ", ".join(f"`{c}__idx` + 0.0D AS `{c}__code`" for c in strings)
        stages.append(SQLTransformer(statement=f"SELECT *, {codes} FROM __THIS__"))
    stages.append(VectorAssembler(inputCols=assembled, outputCol=FEATURES_COL, handleInvalid="keep"))
    return stages, assembled


def resolve_features(df: DataFrame, target: str, features: Sequence[str] | None) -> list[str]:
    if target not in df.columns:
        raise ValueError(f"no target column {target!r}")
    if features is None:
        return [c for c in df.columns if c != target]
    missing = [c for c in features if c not in df.columns]
    if missing:
        raise ValueError(f"no feature columns {missing}")
    return list(features)


def missing_values(df: DataFrame, features: Sequence[str]) -> dict[str, int]:
    """Numeric features with nulls or NaN, and how many rows have them."""
    def gap(c: str):  # noqa: ANN202
        x = F.col(f"`{c}`")
        return x.isNull() | F.isnan(x.cast("double"))
    numeric = [c for c in features if isinstance(df.schema[c].dataType, (NumericType, BooleanType))]
    if not numeric:
        return {}
    row = df.agg(*[F.count(F.when(gap(c), 1)).alias(f"_{i}") for i, c in enumerate(numeric)]).first()
    return {c: n for c, n in zip(numeric, row) if n}


#: Rows of a forest's task: at least (where cores are free), and at most, for it keeps counts of every tree by row.
FOREST_ROWS = (1 << 14, 1 << 18)


#: A regression forest of more rows grows from sums by cell, where its bins make few cells.
CELL_ROWS = 1 << 22


def deal_rows(df: DataFrame, n: int) -> DataFrame:
    """``n`` rows dealt evenly to the tasks that grow a forest: its work is rows x trees x
    levels, and a scan has as many tasks as row groups, however few and uneven."""
    least, most = FOREST_ROWS
    tasks = max(-(-n // most), min(df.sparkSession.sparkContext.defaultParallelism, n // least))
    return df.repartition(tasks) if tasks > 1 else df


#: More distinct targets than this are not classes.
MAX_CLASSES = 10_000


def fit_pipeline(df: DataFrame, target: str, model_type: str,
                 features: Sequence[str] | None = None, params: dict | None = None,
                 n_rows: int | None = None) -> FittedModel:
    problem = problem_of(model_type)
    feats = resolve_features(df, target, features)
    labels = label_labels(df, target, problem)
    data = add_label(df.select(*feats, target), target, problem, labels).where(
        F.col(LABEL_COL).isNotNull())
    n_classes = max(2, len(labels)) if labels is not None else 2
    given = with_defaults(model_type, params)
    if n_rows is None and given.get("penalty", "none") not in ("none", None):
        n_rows = data.count()  # regParam = 1/(C*n) needs the training size
    sp = translate_params(model_type, given, n_rows)
    stages, assembled = feature_stages(df, feats)
    est = make_estimator(model_type, sp, n_classes)
    if model_type.startswith("random_forest"):
        rows = data.count()
        if model_type == "random_forest_regressor" and rows > CELL_ROWS:
            est = make_estimator(model_type, sp, n_classes, CellForestRegressor).using(rows, lambda df: deal_rows(df, rows))
        else:
            data = deal_rows(data, rows)
    try:
        pipe = Pipeline(stages=stages + [est]).fit(data)
    except Exception as e:
        gaps = {} if model_type.startswith("xgboost") else missing_values(data, feats)
        if gaps:
            listed = ", ".join(f"{c} ({n} rows)" for c, n in gaps.items())
            raise ValueError(f"{model_type} takes no nulls or NaN; fill or remove them in: {listed}") from e
        raise
    return FittedModel(pipe, model_type, target, feats, problem, labels,
                       {"assembled": feats, "n_classes": n_classes, "params": sp,
                        "numeric_label": isinstance(df.schema[target].dataType, NumericType)})


def evaluate(fitted: FittedModel, df: DataFrame) -> dict[str, float]:
    scored = fitted.transform(df).where(F.col(LABEL_COL).isNotNull())
    return M.metrics_for(fitted.problem, scored, LABEL_COL, "prediction")


def train(df: DataFrame, target: str, model_type: str, key: str,
          features: Sequence[str] | None = None, params: dict | None = None,
          test_size: float = 0.2, seed: int = 42) -> tuple[FittedModel, dict[str, float]]:
    """Hash split on ``key`` -> fit on train -> metrics on test."""
    from sparkprep.operators.encode import train_test_split
    split = train_test_split(df, key, test_size, seed)
    tr = split.where(F.col("split") == "train").drop("split")
    te = split.where(F.col("split") == "test").drop("split")
    feats = [c for c in resolve_features(df, target, features) if c != key] if features is None \
        else list(features)
    n = split.groupBy("split").count().collect()  # two rows
    sizes = {r["split"]: r["count"] for r in n}
    fitted = fit_pipeline(tr, target, model_type, feats, params)
    fitted.meta |= {"train_samples": sizes.get("train", 0), "test_samples": sizes.get("test", 0)}
    return fitted, evaluate(fitted, te)


def batch_predict(model: FittedModel | str, df: DataFrame,
                  keep: Sequence[str] | None = None) -> DataFrame:
    if isinstance(model, str):
        model = FittedModel.load(model)
    return model.predict(df, keep)


def batch_predict_to(spark: SparkSession, model: FittedModel | str, df: DataFrame, output: str, catalog_path: str,
                     parent_dataset_id: str, keep: Sequence[str] | None = None, name: str | None = None) -> str:
    """Score, write as Parquet and register the result as a child of its input
    dataset; returns the child's id."""
    from sparkprep.sources import catalog
    fitted = FittedModel.load(model) if isinstance(model, str) else model
    fitted.predict(df, keep).write.mode("overwrite").parquet(output)
    return catalog.register_dataset(spark, catalog_path, spark.read.parquet(output), name or f"{parent_dataset_id}_scored", output,
                                    "parquet", parent_dataset_id=parent_dataset_id,
                                    operations=[{"type": "batch_predict", "model_type": fitted.model_type}])


RECOMMENDATIONS = {
    # FIXED VALUES: model suggestions by problem and size (rows < 10000 = small)
    ("classification", "small"): [
        ("random_forest_classifier",
         "Good performance on small-to-medium datasets, handles non-linearity well",
         {"n_estimators": 100, "max_depth": 10, "min_samples_split": 5}),
        ("logistic_regression",
         "Good baseline model, interpretable, works well with small datasets",
         {"C": 1.0, "penalty": "l2", "solver": "lbfgs", "max_iter": 1000}),
    ],
    ("classification", "large"): [
        ("xgboost_classifier",
         "Excellent performance on large datasets, handles complex relationships",
         {"n_estimators": 200, "learning_rate": 0.1, "max_depth": 6}),
        ("random_forest_classifier", "Good balance of performance and training speed",
         {"n_estimators": 200, "max_depth": 15, "min_samples_split": 10}),
    ],
    ("regression", "small"): [
        ("random_forest_regressor", "Handles non-linearity well, resistant to overfitting",
         {"n_estimators": 100, "max_depth": 10, "min_samples_split": 5}),
        ("linear_regression", "Simple baseline model, interpretable", {}),
    ],
    ("regression", "large"): [
        ("xgboost_regressor",
         "Excellent performance on large datasets, handles complex relationships",
         {"n_estimators": 200, "learning_rate": 0.1, "max_depth": 6}),
        ("random_forest_regressor", "Good balance of performance and training speed",
         {"n_estimators": 200, "max_depth": 15, "min_samples_split": 10}),
    ],
}
# FIXED VALUES: fewer rows are a small dataset, fewer distinct values a categorical target
SMALL_DATASET_ROWS = 10000
CATEGORICAL_UNIQUE_LIMIT = 10
MISMATCH = {"classification": "the target looks continuous; classification expects a few distinct values",
            "regression": "the target looks categorical; regression expects many numeric values"}


def recommend_models(df: DataFrame, target: str, problem_type: str) -> DataFrame:
    """Rule rows (rank, model, reason, suggested_hyperparameters, ...) from one
    aggregate (row count, target distinct count)."""
    if problem_type not in ("classification", "regression"):
        raise ValueError("problem_type must be classification or regression")
    is_string = isinstance(df.schema[target].dataType, StringType)
    s = df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(target).alias("u")).first()
    n, u = int(s["n"]), int(s["u"])
    categorical = is_string or u < CATEGORICAL_UNIQUE_LIMIT
    fits = categorical if problem_type == "classification" else not categorical
    warning = None if fits else MISMATCH[problem_type]
    size = "small" if n < SMALL_DATASET_ROWS else "large"
    rows = [(i + 1, m, r, json.dumps(h, sort_keys=True), n, u, categorical, warning)
            for i, (m, r, h) in enumerate(RECOMMENDATIONS[(problem_type, size)])]
    spark = df.sparkSession
    return spark.createDataFrame(rows, "rank int, model string, reason string, "
                                       "suggested_hyperparameters string, num_rows bigint, "
                                       "target_unique bigint, target_is_categorical boolean, "
                                       "warning string")
