"""Regression forests that grow from sums by cell."""

import numpy as np
import pytest
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from sparkprep.operators import cell_forest, models


@pytest.fixture(scope="module")
def df(spark):
    x = F.col("id")
    df = spark.range(0, 6000, 1, 3).select((x % 23).cast("double").alias("a"), (F.hash(x) % 7).cast("int").alias("b"),
                                           F.concat(F.lit("k"), (x % 3).cast("string")).alias("c"), (F.hash(x, x) % 1000 / 100.0).alias("noise"))
    y = 3 * F.abs(F.col("a") - 11) + F.col("b") * 2 + F.when(F.col("c") == "k1", 9).otherwise(0) + F.col("noise")
    return df.select("a", "b", "c", y.alias("y")).cache()


def both(df, monkeypatch, params):
    """Scores of the forest grown from rows and of that grown from cells, and rows the former's code got for the latter."""
    seen, fit = [], RandomForestRegressor._fit
    monkeypatch.setattr(RandomForestRegressor, "_fit", lambda self, ds: seen.append(ds.count()) or fit(self, ds))
    out = []
    for rows in (1 << 22, 0):
        monkeypatch.setattr(models, "CELL_ROWS", rows)
        fitted = models.fit_pipeline(df, "y", "random_forest_regressor", None, params)
        found = fitted.predict(df).select("a", "b", "c", "y", "prediction").orderBy("a", "b", "c", "y").toPandas()
        out.append((fitted, found))
    return *out, seen


@pytest.mark.parametrize("depth", [1, 5])
def test_tree_of_all_rows_is_that_of_spark(df, monkeypatch, depth):
    """The same splits, leaves and importances; no row reaches the code that walks rows through trees."""
    params = {"n_estimators": 1, "max_depth": depth, "bootstrap": False, "min_samples_leaf": 20}
    (rows, want), (cells, got), seen = both(df, monkeypatch, params)
    assert np.allclose(want["prediction"], got["prediction"]) and want["prediction"].nunique() > depth
    assert np.allclose(sorted(v for _, v in rows.importances()), sorted(v for _, v in cells.importances()))
    assert seen == [6000, 64]


def test_forest_of_cells_is_as_good_as_one_of_rows(df, monkeypatch, tmp_path):
    """Poisson draws for every row and tree, some features a node; it is saved and read like any model."""
    (rows, want), (cells, got), seen = both(df, monkeypatch, {"n_estimators": 40, "max_depth": 6})
    errors = [float(((f["y"] - f["prediction"]) ** 2).mean()) for f in (want, got)]
    assert abs(errors[1] / errors[0] - 1) < 0.15 and errors[0] < 0.6 * want["y"].var() and seen == [6000, 64]
    trees = cells.pipeline.stages[-1].trees
    assert len(trees) == 40 and len({t.toDebugString for t in trees}) == 40 and max(t.depth for t in trees) == 6
    again = models.FittedModel.load(cells.save(str(tmp_path / "m"))).predict(df).select("prediction").distinct()
    assert again.count() == got["prediction"].nunique()


def test_draws_are_poisson_counts():
    rng = np.random.Generator(np.random.SFC64(1))
    for mean in (1.0, 0.3):
        draws = cell_forest.Draws(mean)
        w = draws.of(rng, 400_000)
        assert abs(w.mean() - mean) < 0.01 and abs(w.var() - mean) < 0.02 and (draws.table < 0).sum() < 20
        assert w.min() == 0 and len(np.unique(w)) > 4


def test_many_cells_grow_from_rows(df, monkeypatch):
    monkeypatch.setattr(cell_forest, "MAX_CELLS", 20)
    _, _, seen = both(df, monkeypatch, {"n_estimators": 2, "max_depth": 2})
    assert seen == [6000, 6000]


def test_nulls_are_named(df, monkeypatch):
    monkeypatch.setattr(models, "CELL_ROWS", 0)
    gaps = df.withColumn("a", F.when(F.col("a") > 0, F.col("a")))
    with pytest.raises(ValueError, match="a .261 rows"):
        models.fit_pipeline(gaps, "y", "random_forest_regressor", None, {"n_estimators": 2, "max_depth": 2})


def test_split_candidates():
    assert cell_forest.split_candidates(np.array([3.0, 1, 1, 7]), 3).tolist() == [2, 5]
    assert cell_forest.split_candidates(np.array([2.0, 2]), 3).tolist() == []
    cuts = cell_forest.split_candidates(np.arange(100.0), 4)
    assert len(cuts) == 3 and np.all(np.abs(cuts - [24.5, 49.5, 74.5]) <= 1)
    assert [cell_forest.features_tried(s, 5, 10) for s in ("auto", "all", "sqrt", "log2", "0.25", "3")] == [4, 10, 4, 4, 3, 3]
