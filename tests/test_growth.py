"""Stored profile states, table-backed codes, out-of-fold codes, binned densities, word vectors."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from sparkprep.functions.exprs import split_hash
from sparkprep.operators import charts, clean, encode, models, profile, text
from sparkprep.operators.table_encoder import TableIndexer
from sparkprep.session import scratch_path
from sparkprep.sources import profiles


# -- stored states ---------------------------------------------------------------------

@pytest.fixture(scope="module")
def readings(spark):
    rng = np.random.default_rng(0)
    n = 6000
    rows = pd.DataFrame({"v": rng.normal(size=n) ** 3 + 1e6, "w": rng.integers(0, 40, n).astype(float), "name": [f"n{i}" for i in rng.integers(0, 900, n)]})
    rows.loc[rng.random(n) < 0.1, "v"] = np.nan
    rows.loc[rng.random(n) < 0.1, "name"] = None
    schema = "v double, w double, name string, gone int"
    return rows, spark.createDataFrame([(None if i % 3 == 0 and np.isnan(r.v) else float(r.v), float(r.w), r.name, None)
                                        for i, r in enumerate(rows.itertuples(index=False))], schema)


def test_appended_parts_equal_the_whole(spark, readings):
    rows, df = readings
    path, at = scratch_path(spark, "states"), F.monotonically_increasing_id()
    parts = df.withColumn("p", F.pmod(F.xxhash64("v", "w", "name", at), F.lit(3)))
    for p in (0, 1, 2, 1):  # a part written again replaces itself
        profiles.write_part(parts.where(F.col("p") == p).drop("p"), path, "a/b c", f"day {p}")
    profiles.write_part(df.where("false"), path, "a/b c", "empty")
    profiles.write_part(df.limit(5), path, "other", "day 0")
    got = {r["column"]: r for r in profiles.stored_summary(spark, path, "a/b c").collect()}
    assert list(got) == ["v", "w", "gone"]
    for c in ("v", "w"):
        x = rows[c].dropna().to_numpy()
        r = got[c]
        assert r["count"] == len(x) and (r["min"], r["max"]) == (x.min(), x.max())
        assert np.isclose(r["mean"], x.mean(), rtol=1e-12) and np.isclose(r["std"], x.std(ddof=1), rtol=1e-9)
        low, high = np.quantile(x, [0.5 - profiles.RANK_ERROR, 0.5 + profiles.RANK_ERROR])
        assert low <= r["median"] <= high
    assert got["gone"]["count"] == 0 and got["gone"]["mean"] is None and got["gone"]["median"] is None
    about = {r["column"]: r for r in profiles.stored_profile(spark, path, "a/b c").collect()}
    names = rows.name.dropna()
    assert about["name"].non_null == len(names) and abs(about["name"].distinct / names.nunique() - 1) < 0.03
    assert about["name"].sample_values == sorted(set(names))[:3] and about["gone"].sample_values is None
    assert about["w"].distinct == 40


def test_outliers_by_stored_bounds(spark, readings):
    rows, df = readings
    path = scratch_path(spark, "states")
    profiles.write_part(df, path, "d", "0")
    kept = profiles.remove_outliers(df, path, "d", "w", 0.2).toPandas().w
    q1, q3 = profiles.stored_quantiles(spark, path, "d", "w", [0.25, 0.75])
    assert abs(q1 - rows.w.quantile(0.25)) <= 1 and abs(q3 - rows.w.quantile(0.75)) <= 1
    assert len(kept) == rows.w.between(q1 - 0.2 * (q3 - q1), q3 + 0.2 * (q3 - q1)).sum()
    assert profiles.remove_outliers(df, path, "d", "gone").count() == 0
    with pytest.raises(ValueError, match="no stored column"):
        profiles.stored_quantiles(spark, path, "d", "x", [0.5])
    with pytest.raises(ValueError, match="least values"):
        profiles.stored_profile(spark, path, "d", 99)


def test_least_values(spark):
    df = spark.createDataFrame([("b", 1.5), ("a", -0.0), (None, 0.0), ("c", None), ("a", 1.5), ("", 9.0)], "s string, x double").repartition(4)
    got = {r["column"]: r["least"] for r in profile.least_values(df, ["s", "x"], 3).collect()}
    assert got == {"s": ["", "a", "b"], "x": ["0.0", "1.5", "9.0"]}
    assert profile.least_values(df.where("false"), ["s", "x"], 3).count() == 0


# -- codes -------------------------------------------------------------------------------

def test_codes_of_many_values_live_in_a_table(spark):
    many = spark.range(300_000).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("k"))
    fitted = Pipeline(stages=[TableIndexer("k", "code")]).fit(many)
    path = scratch_path(spark, "pipe")
    fitted.write().save(path)
    model = PipelineModel.load(path)
    new = spark.createDataFrame([("k0000000",), ("k0123456",), ("k0299999",), ("unseen",), (None,), ("",)], "k string")
    assert [r.code for r in model.transform(new).orderBy(F.col("k").asc_nulls_last()).collect()] == [300000.0, 0.0, 123456.0, 299999.0, 300000.0, 300000.0]
    assert model.transform(many).where(F.col("code") != F.substring("k", 2, 7).cast("double")).count() == 0
    back = model.stages[0].decode(model.transform(new), "code", "again").where("again IS NOT NULL")
    assert back.where("again = k").count() == 3
    assert model.transform(model.transform(new)).columns == ["k", "code"]


def test_models_keep_long_label_lists_in_tables(spark, monkeypatch):
    monkeypatch.setattr(models, "MAX_LABELS", 3)
    df = spark.createDataFrame([(f"c{i % 7}", ["x", "y"][i % 2], float(i % 7 + i % 2)) for i in range(140)], "many string, few string, y double")
    fitted = models.fit_pipeline(df, "y", "linear_regression")
    assert [type(s).__name__ for s in fitted.pipeline.stages][:2] == ["StringIndexerModel", "TableIndexerModel"]
    loaded = models.FittedModel.load(fitted.save(scratch_path(spark, "m")))
    out = loaded.predict(df)
    assert out.where(F.abs(F.col("prediction") - F.col("y")) > 1e-6).count() == 0


def test_codes_from_other_folds(spark):
    rng = np.random.default_rng(3)
    rows = [(i, ["a", "b", None, "hot", "hot"][int(rng.integers(5))], float(rng.normal() + 3)) for i in range(400)]
    rows += [(1000, "once", 50.0), (1001, "a", None), (1002, "void", None)]
    df = spark.createDataFrame(rows, "k bigint, c string, y double")
    out, table = clean.target_encode_folds(df, "c", "y", "k", 4, 5.0)
    data = encode.kfold(df, "k", 4).toPandas()
    data["c"] = data.c.fillna("\0null")
    for r in out.collect():
        rest = data[(data.fold != data.fold[data.k == r.k].iloc[0]) & data.y.notna()]
        own = rest[rest.c == ("\0null" if r.c is None else r.c)].y
        want = (own.sum() + 5 * rest.y.mean()) / (len(own) + 5) if len(own) else rest.y.mean()
        assert abs(r.c_te - want) < 1e-9
    fitted = {r.c: r.c_te for r in table.collect()}
    y = data[data.y.notna()]
    assert set(fitted) == {"a", "b", None, "hot", "once"}
    assert abs(fitted["hot"] - (y[y.c == "hot"].y.sum() + 5 * y.y.mean()) / ((y.c == "hot").sum() + 5)) < 1e-9
    assert out.columns == ["k", "c", "y", "c_te"]


# -- densities -------------------------------------------------------------------------------

@pytest.mark.parametrize("cells", [4, 64])
def test_binned_density_is_within_its_bound(spark, cells):
    rng = np.random.default_rng(1)
    x = np.r_[rng.normal(size=1500), rng.normal(size=300) * 0.1 + 5]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),), (float("inf"),)], "x double").repartition(3)
    exact, fast = (f.orderBy("grid_index").toPandas() for f in (charts.kde(df, "x", 150), charts.kde_binned(df, "x", 150, cells)))
    assert np.allclose(exact.x, fast.x)
    h = x.std(ddof=1) * len(x) ** -0.2
    assert np.abs(exact.density - fast.density).max() <= 0.39895 / (8 * cells**2 * h) + 1e-12
    assert abs(np.trapezoid(fast.density, fast.x) - 1) < 0.01
    assert charts.kde_binned(df.where("x > 100"), "x").count() == 0


# -- word vectors ------------------------------------------------------------------------------

def test_word_vectors_of_planted_synonyms(spark):
    """Words that stand in the same places have near vectors; a document's vector is the mean of its words'."""
    rng = np.random.default_rng(2)
    animals, tools = ["cat", "feline"], ["hammer", "mallet"]
    docs = []
    for i in range(900):
        kind, around = (animals, ["purrs", "milk", "whiskers", "sofa"]) if i % 2 else (tools, ["nail", "bench", "wood", "strike"])
        words = [kind[int(rng.integers(2))], *rng.permutation(around)]
        docs.append((i, " ".join(words)))
    for i, w in enumerate([*animals, *tools, "cat hammer"]):
        docs.append((5000 + i, w))
    df = spark.createDataFrame(docs, "id bigint, t string")
    out = text.text_vectorization(df, "t", "word2vec", vector_size=16, min_count=3, seed=7, num_partitions=1, as_array=True)
    v = {r.id - 5000: np.array(r.t_vector) for r in out.where("id >= 5000").collect()}

    def cosine(a, b):
        return a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    assert cosine(v[0], v[1]) > cosine(v[0], v[2]) + 0.1 and cosine(v[2], v[3]) > cosine(v[3], v[1]) + 0.1
    assert np.allclose(v[4], (v[0] + v[2]) / 2, atol=1e-6)


def test_median_bounds_pass_no_table_through_one_task(spark):
    """The bounds come from brackets of the ranks, not from one map of all values."""
    from sparkprep.plans import q_growth
    from tests.conftest import SF_SMALL
    out = q_growth.prv6_parts(spark, SF_SMALL)
    assert "percentile(" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert all(r["median_in_range"] for r in out.collect())
