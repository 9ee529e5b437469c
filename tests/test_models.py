"""Model-side invariants (rows-only operators)."""

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.sql import functions as F

from sparkprep.operators import charts, importance, metrics, models, validate
from sparkprep.plans import q_models
from sparkprep.session import scratch_path


def test_rf_importances_sum_to_one(spark, sf_small):
    df = q_models.lineitem_features(spark, sf_small).drop("row_key")
    imp = importance.random_forest_importance(df, "l_returnflag", num_trees=5).collect()
    assert abs(sum(r["importance"] for r in imp) - 1.0) < 1e-9
    assert [r["rank"] for r in imp] == list(range(1, len(imp) + 1))


def test_auc_matches_evaluator(spark, sf_small):
    from sparkprep.plans.q_viz import scored_documents
    s = scored_documents(spark, sf_small)
    ours = charts.roc_auc(s).first()["auc"]
    ev = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", metricName="areaUnderROC")
    want = ev.evaluate(s.withColumn("label", F.col("label").cast("double")))
    assert abs(ours - want) < 1e-9


def test_regression_metrics_match_evaluator(spark, sf_small):
    from sparkprep.plans.q_viz import scored_lineitem
    s = scored_lineitem(spark, sf_small)
    m = metrics.regression_metrics(s).first()
    for name in ("rmse", "mae", "r2"):
        want = RegressionEvaluator(metricName=name).evaluate(s)
        assert abs(m[name] - want) <= 1e-9 * max(1.0, abs(want))


def test_save_load_and_prediction_domain(spark, sf_small):
    df = q_models.document_features(spark, sf_small)
    fitted = models.fit_pipeline(df, "quality", "random_forest_classifier", ["n_chars", "lang", "source"],
                                 {"n_estimators": 5})
    loaded = models.FittedModel.load(fitted.save(scratch_path(spark, "m")))
    a = fitted.predict(df, ["doc_id"]).orderBy("doc_id").collect()
    b = loaded.predict(df, ["doc_id"]).orderBy("doc_id").collect()
    assert a == b
    assert {r["prediction"] for r in a} <= {0.0, 1.0}
    assert all(0.0 <= r["score"] <= 1.0 for r in a)


def test_string_target_round_trip(spark, sf_small):
    df = q_models.lineitem_features(spark, sf_small).drop("row_key")
    fitted = models.fit_pipeline(df, "l_returnflag", "logistic_regression", ["l_quantity", "l_discount"])
    preds = {r["prediction"] for r in fitted.predict(df).select("prediction").distinct().collect()}
    assert preds <= {"A", "N", "R"}


def test_cross_validate_folds_and_family(spark, sf_small):
    df = q_models.document_features(spark, sf_small)
    out = validate.cross_validate(df, "quality", "logistic_regression", "doc_id", cv_folds=3)
    rows = out.collect()
    assert {r["metric"] for r in rows} == {"accuracy", "precision", "recall", "f1"}
    assert {r["fold"] for r in rows} == {0, 1, 2}
    with pytest.raises(ValueError):
        validate.cross_validate(df, "quality", "logistic_regression", "doc_id", 3, metrics=["rmse"])


def test_compare_reports_wrong_family_as_error(spark, sf_small):
    df = q_models.lineitem_features(spark, sf_small)
    out = validate.compare_models(df, "l_extendedprice", ["linear_regression", "logistic_regression"],
                                  "row_key", cv_folds=2, metrics=["rmse", "r2"]).collect()
    errs = {r["model"]: r["error"] for r in out if r["error"]}
    assert "logistic_regression" in errs
    assert {r["metric"] for r in out if r["model"] == "linear_regression"} == {"rmse", "r2"}


def test_recommend_rules(spark, sf_small):
    from sparkprep.plans.registry import table
    small = models.recommend_models(table(spark, sf_small, "labels"), "quality", "classification").collect()
    assert [r["model"] for r in small] == ["random_forest_classifier", "logistic_regression"]
    assert small[0]["warning"] is None


def test_translate_params():
    p = models.translate_params("random_forest_regressor", {"n_estimators": 50, "max_depth": None,
                                                             "min_samples_split": 10})
    assert p == {"numTrees": 50, "maxDepth": 30, "minInstancesPerNode": 5}
    lg = models.translate_params("logistic_regression", {"C": 2.0, "penalty": "l1"}, n_rows=100)
    assert lg["regParam"] == 1.0 / 200 and lg["elasticNetParam"] == 1.0


def test_pca_matches_numpy_up_to_sign(spark, sf_small):
    import numpy as np
    from sparkprep.operators import features
    e = spark.read.parquet(f"{sf_small}/embeddings.parquet")
    rows = e.orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in rows], dtype=float)
    cov = np.cov(x, rowvar=False)
    w, v = np.linalg.eigh(cov)
    top = v[:, np.argsort(w)[::-1][:2]]
    want = np.abs(x @ top)  # projection of uncentred rows, sign-free
    got = features.pca(e, "embedding", 2).orderBy("vec_id").select("pc1", "pc2").collect()
    got = np.abs(np.array([[r["pc1"], r["pc2"]] for r in got]))
    assert np.allclose(got, want, rtol=1e-6, atol=1e-6)
    ev = features.pca_model(e, "embedding", 2).ratios
    assert np.allclose(ev, np.sort(w)[::-1][:2] / w.sum(), rtol=1e-6)


def test_c_parameter_uses_training_size(spark, sf_small):
    df = q_models.document_features(spark, sf_small)
    fitted = models.fit_pipeline(df, "quality", "logistic_regression", ["n_chars"], {"C": 1.0})
    n = df.count()
    assert abs(fitted.meta["params"]["regParam"] - 1.0 / n) < 1e-15


def test_elasticnet_l1_ratio():
    p = models.translate_params("logistic_regression", {"C": 0.5, "penalty": "elasticnet", "l1_ratio": 0.3},
                                n_rows=10)
    assert p == {"regParam": 1.0 / 5.0, "elasticNetParam": 0.3}


def test_forest_rows_of_one_row_group_are_dealt_evenly(spark, monkeypatch):
    """A scan with all rows in one task grows its forest in four, and small tables stay as they are."""
    seen, fit = [], models.RandomForestRegressor._fit
    monkeypatch.setattr(models.RandomForestRegressor, "_fit", lambda self, ds: seen.append(
        [r["count"] for r in ds.groupBy(F.spark_partition_id()).count().collect()]) or fit(self, ds))
    df = spark.range(70_000).coalesce(1).select((F.col("id") % 7).alias("x"), (F.col("id") % 11).cast("double").alias("y"))
    models.fit_pipeline(df, "y", "random_forest_regressor", ["x"], {"n_estimators": 2, "max_depth": 2})
    assert len(seen[0]) == min(4, spark.sparkContext.defaultParallelism) and max(seen[0]) < 1.1 * min(seen[0])
    models.fit_pipeline(df.limit(5000), "y", "random_forest_regressor", ["x"], {"n_estimators": 2, "max_depth": 2})
    assert len(seen[1]) == 1
