"""Boosted trees: nulls, several classes, spread and single-task fits, saving."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sparkprep.operators import boosting, models
from sparkprep.session import scratch_path

SCHEMA = "x array<double>, label double"


def table(spark, x, y, parts=3):
    return spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y)], SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    x = np.stack([rng.integers(0, 9, 900), np.round(rng.normal(size=900), 2), rng.integers(0, 2, 900)], axis=1).astype(float)
    x[rng.random(900) < 0.2, 0] = np.nan
    y = np.where(np.isnan(x[:, 0]), 6, x[:, 0]) + 2 * x[:, 2] + 0.1 * rng.normal(size=900)
    return x, y


def best_stump(x, g, h, lam=1.0):
    """The best split of all rows, by trying every threshold and side for nulls."""
    found = (0.0,)
    for f in range(x.shape[1]):
        null = np.isnan(x[:, f])
        for null_left in (False, True) if null.any() else (False,):
            for cut in [*np.unique(x[~null, f])[1:], np.inf]:
                left = (x[:, f] < cut) | (null & null_left)
                if h[left].sum() >= 1 and h[~left].sum() >= 1:
                    score = sum(g[s].sum() ** 2 / (h[s].sum() + lam) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + lam)
                    if score / 2 > found[0] * (1 + 1e-9):
                        found = (score / 2, f, cut, null_left, left)
    return found


def test_stumps_of_a_squared_loss(spark, rows):
    """Two rounds of depth 1 against a search over all splits."""
    x, y = rows
    model = boosting.boost(table(spark, x, y), boosting.Settings("squared", 1, rounds=2, depth=1, rate=0.5))
    margin = np.full(len(y), y.mean())
    for trees in model["rounds"]:
        g, h = margin - y, np.ones(len(y))
        gain, f, cut, null_left, left = best_stump(x, g, h)
        t = trees[0]
        assert (t["feature"][0], t["threshold"][0], t["null_left"][0]) == (f, cut, null_left)
        assert abs(t["gain"][0] / gain - 1) < 1e-9
        for side, some in (("left", left), ("right", ~left)):
            value = -0.5 * g[some].sum() / (some.sum() + 1)
            assert abs(t["value"][t[side][0]] - value) < 1e-9
            margin[some] += value


@pytest.mark.parametrize("collect_bytes", [1 << 26, 0])
def test_spread_fit_equals_single_task_fit(spark, rows, collect_bytes):
    """Level by level over several tasks, sums added by the driver or merged by Spark."""
    x, y = rows
    classes = (y > 3).astype(float) + (y > 6)
    settings = boosting.Settings("softmax", 3, rounds=12, depth=3)
    one = boosting.boost(table(spark, x, classes), settings)
    spread = boosting.boost(table(spark, x, classes), settings, collect_bytes=collect_bytes, task_bytes=8000, alone=False)
    for a, b in zip(one["rounds"], spread["rounds"], strict=True):
        for s, t in zip(a, b, strict=True):
            assert s["feature"] == t["feature"] and s["threshold"] == t["threshold"] and s["null_left"] == t["null_left"]
            assert np.allclose(s["value"], t["value"], atol=1e-9) and np.allclose(s["cover"], t["cover"])


def test_classes_with_nulls(spark, rows):
    x, y = rows
    classes = (y > 3).astype(float) + (y > 6)
    names = np.array(["low", "mid", "high"])[classes.astype(int)]
    df = spark.createDataFrame([(*[None if np.isnan(v) else float(v) for v in a], n) for a, n in zip(x, names)],
                               "a double, b double, c double, kind string")
    fitted = models.fit_pipeline(df, "kind", "xgboost_classifier", params={"n_estimators": 30})
    out = fitted.predict(df)
    p = F.col("probabilities")
    assert out.where(F.abs(F.aggregate(p, F.lit(0.0), lambda s, v: s + v) - 1) > 1e-9).count() == 0
    assert out.where("prediction = kind").count() > 0.93 * len(y)
    loaded = models.FittedModel.load(fitted.save(scratch_path(spark, "boosted")))
    assert sorted(loaded.predict(df).collect(), key=str) == sorted(out.collect(), key=str)
    shares = dict(fitted.importances())
    assert abs(sum(shares.values()) - 1) < 1e-9 and shares["a"] > shares["b"]
    assert fitted.transform(df).select(vector_to_array("probability")).first() is not None


def test_many_values_are_cut_at_quantiles(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 1))
    cuts = boosting.feature_cuts(table(spark, x, x[:, 0]).select("x"), 1, 50)
    rank = np.searchsorted(np.sort(x[:, 0]), cuts[0]) + 1
    assert len(rank) == 49 and np.abs(rank - np.arange(1, 50) * 60).max() <= 1
    few = boosting.feature_cuts(table(spark, np.array([[1.0], [np.nan], [3.0], [2.0], [2.0]]), np.zeros(5)).select("x"), 1, 50)
    assert few[0].tolist() == [2.0, 3.0]


def test_sampled_rows_and_columns(spark, rows):
    x, y = rows
    kind = boosting.Settings("squared", 1, rounds=25, sample=0.5, columns=0.67, depth=3)
    a, b = (boosting.boost(table(spark, x, y, 1), kind) for _ in range(2))
    assert a == b
    trees = [[boosting.Tree(**t) for t in r] for r in a["rounds"]]
    assert np.mean((boosting.margins(a, trees, x)[:, 0] - y) ** 2) < 0.2 * y.var()
    assert all(len({f for f in t["feature"] if f >= 0}) <= 2 for r in a["rounds"] for t in r)


def test_defaults_and_refusals(spark, rows):
    assert models.translate_params("xgboost_regressor", models.with_defaults("xgboost_regressor", None)) == {
        "maxIter": 100, "maxDepth": 6, "stepSize": 0.1}
    assert models.translate_params("xgboost_classifier", {"reg_lambda": 2.0, "colsample_bytree": 0.5, "subsample": 0.7}) == {
        "regLambda": 2.0, "columnRate": 0.5, "subsamplingRate": 0.7}
    with pytest.raises(ValueError, match="min_child_weight"):
        models.translate_params("xgboost_classifier", {"min_samples_leaf": 3})
    with pytest.raises(ValueError, match="no training rows"):
        boosting.boost(spark.createDataFrame([], SCHEMA), boosting.Settings("squared", 1))
    constant = boosting.boost(spark.createDataFrame([([1.0], 5.0), ([2.0], 5.0)], SCHEMA), boosting.Settings("squared", 1))
    assert len(constant["rounds"]) == 1 and constant["base"] == 5.0


def test_other_models_name_the_columns_with_nulls(spark):
    df = spark.createDataFrame([(1.0, None, 2.0), (2.0, 1.0, float("nan")), (3.0, 2.0, 1.0)], "a double, b double, y double")
    for kind in ("linear_regression", "random_forest_regressor"):
        with pytest.raises(ValueError, match=r"b \(1 rows\)"):
            models.fit_pipeline(df.where("a < 10"), "y", kind, ["a", "b"])
    with pytest.raises(ValueError, match="distinct values"):
        models.label_labels(spark.range(20000).withColumn("t", F.col("id").cast("double")), "t", "classification")


def test_rows_of_equal_codes_are_one_weighted_row(spark, monkeypatch):
    """Thirty thousand rows of sixty codes are held as sixty, with the same trees."""
    rng = np.random.default_rng(3)
    x = np.stack([rng.integers(0, 20, 30000), rng.integers(0, 3, 30000)], axis=1).astype(float)
    x[x[:, 0] == 7, 0] = np.nan
    y = np.nan_to_num(x[:, 0]) ** 2 + x[:, 1] + rng.normal(size=30000)
    seen = []
    write = boosting.materialize
    monkeypatch.setattr(boosting, "materialize", lambda df, name: seen.append((name, write(df, name))) or seen[-1][1])
    for kind, label in (("squared", y), ("logistic", (y > 50).astype(float)), ("softmax", (y > 50).astype(float) + (y > 200))):
        settings = boosting.Settings(kind, 3 if kind == "softmax" else 1, rounds=2, depth=2)
        model = boosting.boost(table(spark, x, label), settings)
        held = dict(seen)["equal_codes"]
        assert held.count() <= 180 and held.agg(F.sum("weight")).first()[0] == 30000
        cuts = boosting.feature_cuts(table(spark, x, label), 2, boosting.MAX_BINS)
        base = np.full((30000, settings.n_trees), model["base"])
        plain = boosting.grow(boosting.HeldRows(boosting.coded(x, cuts), label, base, np.ones(30000), settings), cuts, settings, 1)
        for a, b in zip(model["rounds"], plain, strict=True):
            for s, t in zip(a, b, strict=True):
                assert s["feature"] == t.feature and s["threshold"] == t.threshold and np.allclose(s["value"], t.value, atol=1e-9)


def test_sums_of_a_round_cost_its_cells_and_rows(monkeypatch):
    """Ten classes, forty features: sums of a feature are no longer than its nodes' cells, and of two
    children the one of more rows is what the other leaves of their parent."""
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(600, 40)).round(1), rng.integers(0, 10, 600).astype(float)
    cuts = [np.unique(x[:, f])[1:] for f in range(40)]
    codes = boosting.coded(np.where(rng.random(x.shape) < 0.05, np.nan, x), cuts)

    def fitted():  # noqa: ANN202
        settings = boosting.Settings("softmax", 10, rounds=2, depth=4)
        held = boosting.HeldRows(codes, y, np.zeros((600, 10)), np.ones(600), settings)
        return boosting.grow(held, cuts, settings, 1)
    made, used, count = [], [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda cell, weights=None, minlength=0: made.append(minlength) or used.append(
        len(cell) * (weights is not None)) or count(cell, weights, minlength))
    rounds = fitted()
    nodes = sum(len(t.feature) for r in rounds for t in r)
    assert sum(made) <= 2 * nodes * sum(len(c) + 2 for c in cuts)
    assert sum(used) <= 2 * 2 * 600 * 40 * 10 * (1 + 3 / 2)
    monkeypatch.setattr(boosting, "KEPT_BYTES", 0)
    for r, s in zip(rounds, fitted(), strict=True):
        for t, u in zip(r, s, strict=True):
            assert (t.feature, t.code, t.null_left) == (u.feature, u.code, u.null_left)
            assert np.allclose(t.value, u.value, atol=1e-12) and np.allclose(t.cover, u.cover)
