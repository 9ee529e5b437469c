"""Co-moment states, linear fits from them, principal components, lags and bootstrap."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from sparkprep.functions import comoments, halo
from sparkprep.functions.exprs import split_hash
from sparkprep.operators import bootstrap, charts, linear_states, principal, validate
from sparkprep.plans import q_models


def gappy(n=500, d=7, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) + 1e4
    x[rng.random((n, d)) < 0.15] = np.nan
    x[:, 3] = 5.0
    return x


def frame(spark, x):
    rows = [[None if np.isnan(v) else float(v) for v in r] for r in x]
    return spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(x.shape[1])))


# -- co-moments ----------------------------------------------------------------------

def test_states_merge_and_subtract():
    x = gappy()
    whole = comoments.Moments.of(x, x)
    parts = [comoments.Moments.of(x[a:b], x[a:b]) for a, b in ((0, 1), (1, 200), (200, 200), (200, 500))]
    for other in (comoments.merged(parts), comoments.merged(parts[::-1])):
        assert np.array_equal(whole.n, other.n)
        assert np.allclose(whole.ma, other.ma) and np.allclose(whole.c, other.c, rtol=1e-9, atol=1e-6)
    rest = whole.without(parts[3])
    want = comoments.Moments.of(x[:200], x[:200])
    assert np.array_equal(rest.n, want.n) and np.allclose(rest.c, want.c, rtol=1e-6, atol=1e-4) and np.allclose(rest.ma, want.ma)


@pytest.mark.parametrize("block", [256, 3])
def test_group_states_and_correlations(spark, monkeypatch, block):
    """In one block of columns, and in blocks of three."""
    monkeypatch.setattr(comoments, "BLOCK", block)
    x = gappy()
    df = frame(spark, x).withColumn("g", F.pmod(F.monotonically_increasing_id(), F.lit(3))).repartition(5)
    names = [f"c{i}" for i in range(x.shape[1])]
    rows = df.toPandas()
    for g, state in comoments.group_moments(df, [F.col(c) for c in names], F.col("g")).items():
        own = rows[rows.g == g][names].to_numpy()
        want = comoments.Moments.of(own, own)
        assert np.array_equal(state.n, want.n) and np.allclose(state.c, want.c, rtol=1e-9, atol=1e-6) and np.allclose(state.mb, want.mb)
    corr = rows[names].corr()
    for r in comoments.correlations(df, names).collect():
        want = 1.0 if r.col_a == r.col_b else corr.loc[r.col_a, r.col_b]
        assert (r["corr"] is None and np.isnan(want)) or abs(r["corr"] - want) < 1e-9


def test_correlation_of_many_columns_without_rows(spark):
    df = spark.createDataFrame([], ", ".join(f"c{i} double" for i in range(30)))
    assert charts.correlation_matrix(df, df.columns).count() == 0


# -- linear fits -----------------------------------------------------------------------

def test_fold_scores_equal_fits_per_fold(spark, sf_small, monkeypatch):
    df = q_models.lineitem_features(spark, sf_small)
    args = (df, "l_extendedprice", "linear_regression", "row_key", 4, ["l_quantity", "l_discount", "l_tax"])
    fast = sorted(validate.fold_scores(*args))
    curve = validate.learning_curve(df, "l_extendedprice", "linear_regression", "row_key", 3, (0.3, 1.0), ["l_quantity"]).orderBy("train_fraction").collect()
    monkeypatch.setattr(linear_states, "applies", lambda *_: False)
    slow = sorted(validate.fold_scores(*args))
    assert [r[:3] for r in fast] == [r[:3] for r in slow]
    assert np.allclose([r[3] for r in fast], [r[3] for r in slow], rtol=1e-7)
    plain = validate.learning_curve(df, "l_extendedprice", "linear_regression", "row_key", 3, (0.3, 1.0), ["l_quantity"]).orderBy("train_fraction").collect()
    assert np.allclose(np.array(curve, float), np.array(plain, float), rtol=1e-7)


def test_solve_without_intercept_and_with_dependent_columns():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 3)) + 3
    x[:, 2] = 2 * x[:, 0]
    y = x @ np.array([1.0, -2.0, 0.5]) + 0.01 * rng.normal(size=80)
    state = comoments.Moments.of(np.c_[x, y], np.c_[x, y])
    for intercept in (True, False):
        fit = linear_states.solve(state, intercept)
        a = np.c_[x, np.ones(80)] if intercept else x
        want = a @ np.linalg.lstsq(a, y, rcond=None)[0]
        assert np.allclose(x @ fit.coefficients + fit.intercept, want, atol=1e-6)
        assert abs(fit.sse(state) - ((y - want) ** 2).sum()) < 1e-6


def test_linear_folds_name_columns_with_nulls(spark):
    df = spark.createDataFrame([(i, float(i), None if i == 3 else float(i % 5)) for i in range(40)], "k bigint, y double, x double")
    with pytest.raises(ValueError, match=r"x \(1 rows\)"):
        validate.cross_validate(df, "y", "linear_regression", "k", 3)


# -- principal components ----------------------------------------------------------------

def exact(x, k):
    _, s, v = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    return s[:k] ** 2 / (len(x) - 1), v[:k].T


def test_random_range_of_dense_rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(800, 64)) * 0.8 ** np.arange(64) @ np.linalg.qr(rng.normal(size=(64, 64)))[0] + 7
    df = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>").repartition(6)
    for options in ({}, {"exact_columns": 0, "oversample": 6}):
        got = principal.fit(df, "x", 4, **options)
        variances, components = exact(x, 4)
        assert np.allclose(got.variances, variances, rtol=1e-7)
        assert np.allclose(np.abs(got.components), np.abs(components), atol=1e-5)
        assert np.allclose(got.ratios, variances / x.var(axis=0, ddof=1).sum(), rtol=1e-6)
    assert got.steps > 1
    out = principal.transform(df, "x", got).select("x", "pc1", "pc4").toPandas()
    assert np.allclose(np.stack(out.x) @ got.components[:, [0, 3]], out[["pc1", "pc4"]].to_numpy())


def test_sparse_rows_of_20000_columns(spark):
    rng = np.random.default_rng(5)
    topics = rng.integers(0, 20000, (3, 40))
    x = np.zeros((300, 20000))
    for i in range(300):
        x[i, rng.choice(topics[i % 3], 20, replace=False)] = 1 + rng.random(20)
        x[i, rng.integers(0, 20000, 5)] = 0.3
    rows = [(Vectors.sparse(20000, {int(j): float(v[j]) for j in np.flatnonzero(v)}),) for v in x]
    rows[7] = (Vectors.dense(x[7]),)  # kinds may be mixed
    df = spark.createDataFrame(rows, ["v"]).repartition(4)
    got = principal.fit(df, "v", 2)
    variances, components = exact(x, 2)
    assert np.allclose(got.variances, variances, rtol=1e-6)
    assert np.allclose(np.abs(got.components), np.abs(components), atol=1e-4)
    first = principal.transform(df.limit(20), "v", got).collect()
    assert np.allclose([r.pc1 for r in first], [r.v.toArray() @ got.components[:, 0] for r in first])


def test_components_refuse_gaps(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 1.0), (3.0, 4.0)], "a double, b double")
    with pytest.raises(ValueError, match="nulls"):
        principal.fit(df, ["a", "b"], 1)
    with pytest.raises(ValueError, match="components of"):
        principal.fit(df, ["a", "b"], 3)


# -- lags ----------------------------------------------------------------------------------

@pytest.mark.parametrize("parts", [1, 5, 60])
def test_lags_over_ranges(spark, parts):
    """A hot group, null keys, groups of one, ranges shorter than the largest lag."""
    rng = np.random.default_rng(parts)
    n = 240
    group = np.where(np.arange(n) < 100, "hot", [f"g{v}" for v in rng.integers(0, 40, n)]).astype(object)
    group[rng.random(n) < 0.1] = None
    rows = pd.DataFrame({"g": group, "h": rng.integers(0, 2, n), "t": rng.permutation(n), "v": rng.normal(size=n)})
    rows.loc[rng.random(n) < 0.1, "v"] = np.nan
    df = spark.createDataFrame([(r.g, int(r.h), int(r.t), None if np.isnan(r.v) else float(r.v)) for r in rows.itertuples()],
                               "g string, h int, t bigint, v double").withColumn("__pid", F.lit("clash"))
    df = df.drop("__pid").withColumn("pos", F.lit("clash"))
    got = halo.lagged(df, "v", [1, 3, 9], ["g", "h"], ["t"], parts).toPandas().sort_values("t", ignore_index=True)
    rows = rows.sort_values("t", ignore_index=True)
    by = rows.fillna({"g": "\0null"}).groupby(["g", "h"]).v
    for k in (1, 3, 9):
        assert np.allclose(got[f"v_lag{k}"].to_numpy(float), by.shift(k).to_numpy(float), equal_nan=True)
    assert halo.lagged(df.where("false"), "v", [2], ["g"], ["t"]).count() == 0


# -- bootstrap ---------------------------------------------------------------------------------

def test_bootstrap_draws_as_the_hash_says(spark):
    keys = np.arange(3000, dtype=np.int64) * 7919
    by_spark = [r[0] for r in spark.createDataFrame([(int(k),) for k in keys], "k bigint").select(split_hash("k", 45)).collect()]
    assert bootstrap.hashes(keys, np.array([45]))[:, 0].tolist() == by_spark
    drawn = np.searchsorted(bootstrap.poisson_limits(), bootstrap.hashes(keys, np.arange(50)), "right")
    assert abs(drawn.mean() - 1) < 0.01 and abs(drawn.var() - 1) < 0.03
    assert np.isclose((drawn == 0).mean(), np.exp(-1), atol=0.01)


def test_bootstrap_interval(spark):
    rng = np.random.default_rng(0)
    rows = [(["a", "b", None][i % 3], float(v), i) for i, v in enumerate(rng.exponential(size=1500))]
    rows += [("a", None, 5000), ("a", float("nan"), 5001), ("b", 1e9, None), ("c", 2.0, 6000)]
    df = spark.createDataFrame(rows, "x string, y double, k bigint").repartition(3)
    got = {r.x: r for r in bootstrap.bar_bootstrap(df, "x", "y", "k", 400).collect()}
    assert set(got) == {"a", "b", "c", None} and got["c"].ci_low == got["c"].ci_high == 2.0
    for name in ("a", "b", None):
        y = np.array([v for x, v, k in rows if x == name and v == v and v is not None and k is not None and v < 1e9])
        half = 1.96 * y.std() / np.sqrt(len(y))
        r = got[name]
        assert r.n == len(y) and abs(r["mean"] - y.mean()) < 1e-9
        assert abs(r.ci_low - (y.mean() - half)) < 0.35 * half and abs(r.ci_high - (y.mean() + half)) < 0.35 * half
