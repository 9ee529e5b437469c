"""Labels, categories, names, files and values that the test tables do not hold."""

import pytest
from pyspark.sql import functions as F

from sparkprep.functions.joins import join_small
from sparkprep.operators import charts, clean, features, importance, models
from sparkprep.plans.operations import apply_operations
from sparkprep.session import ensure_checkpoint_dir, scratch_path
from sparkprep.sources import catalog, io


def _classes(spark, labels, n=120):
    rows = [(i, float(i % 7) + (3.0 if i % len(labels) == 0 else 0.0), f"c{i % 40}", labels[i % len(labels)]) for i in range(n)]
    kind = "string" if isinstance(labels[0], str) else "double" if isinstance(labels[0], float) else "bigint"
    return spark.createDataFrame(rows, f"id bigint, x double, cat string, y {kind}")


@pytest.mark.parametrize("labels", [[-1, 1], [1000, 2000], ["a", "b", "c"], [0.5, 1.5, 10.0]])
def test_forest_predicts_the_labels_themselves(spark, labels):
    df = _classes(spark, labels)
    fitted = models.fit_pipeline(df, "y", "random_forest_classifier", ["x", "cat"], {"n_estimators": 5, "max_depth": 4})
    out = fitted.predict(df, ["id", "y"])
    assert {r[0] for r in out.select("prediction").distinct().collect()} <= set(labels)
    assert ("score" in out.columns) == (len(labels) == 2)
    assert ("probabilities" in out.columns) == (len(labels) > 2)


def test_importances_of_every_kind(spark):
    three = _classes(spark, ["a", "b", "c"])
    for kind, params in (("logistic_regression", {}), ("xgboost_classifier", {"n_estimators": 2, "max_depth": 2})):
        fitted = models.fit_pipeline(three, "y", kind, ["x", "cat"], params)
        assert {f for f, _ in fitted.importances()} == {"x", "cat"}
    line = models.fit_pipeline(three.withColumn("t", F.col("x") * 2), "t", "linear_regression", ["x"])
    assert abs(line.importances()[0][1] - 2.0) < 1e-6


def test_penalty_alone_and_defaults(spark):
    df = _classes(spark, [0, 1])
    for params in ({"penalty": "l2"}, {}):
        fitted = models.fit_pipeline(df, "y", "logistic_regression", ["x"], params)
        assert fitted.meta["params"]["regParam"] == pytest.approx(1 / 120)
    forest = models.translate_params("random_forest_classifier", models.with_defaults("random_forest_classifier", {"random_state": 7}))
    assert forest == {"numTrees": 100, "maxDepth": 30, "seed": 7}
    with pytest.raises(ValueError):
        models.translate_params("random_forest_classifier", {"max_depth": 50})


def test_unseen_test_labels_count_as_errors(spark):
    df = _classes(spark, ["a", "b"])
    fitted = models.fit_pipeline(df, "y", "logistic_regression", ["x"])
    more = df.unionByName(df.withColumn("y", F.lit("new")))
    assert models.evaluate(fitted, more)["accuracy"] == pytest.approx(models.evaluate(fitted, df)["accuracy"] / 2)


def test_normalise_twice_then_bin_equals_one_by_one(spark):
    df = spark.createDataFrame([(float(i), float(i * i)) for i in range(10)], "a double, b double")
    ops = [{"type": "normalize", "columns": ["a"]}, {"type": "normalize", "columns": ["a_scaled", "b"]},
           {"type": "normalize", "columns": ["a"], "method": "zscore"}, {"type": "binning", "column": "a_scaled", "bins": 5}]
    one = df
    for op in ops:
        one = apply_operations(one, [op])
    assert sorted(apply_operations(df, ops).collect()) == sorted(one.select(*apply_operations(df, ops).columns).collect())


def test_one_hot_names_and_sparse_form(spark):
    df = spark.createDataFrame([("a b",), ("a_b",), ("a.b",), (None,)], "c string")
    out = clean.one_hot(df, "c")
    assert len(set(out.columns)) == 4
    out.write.parquet(scratch_path(spark, "onehot"))
    many = spark.range(1500).select(F.col("id").cast("string").alias("c"))
    with pytest.raises(ValueError):
        clean.one_hot(many, "c")
    row = clean.one_hot_sparse(many, "c").where("c = '10'").first()["c_onehot"]
    assert row.size == 1500 and row.indices.tolist() == [sorted(map(str, range(1500))).index("10")]
    assert clean.one_hot_sparse(df, "c").where("c IS NULL").first()["c_onehot"].numNonzeros() == 0


def test_null_keys_meet(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "k string, v double")
    got = {r["k"]: (r["v_mean"], r["v_count"]) for r in features.aggregation(df, ["k"], ["v"], ["mean", "count"], mode="broadcast_back").collect()}
    assert got == {None: (2.0, 2), "a": (5.0, 1)}
    got = {r["k"]: r["v"] for r in charts.bar(df, "k", "v", "median").collect()}
    assert got == {None: 2.0, "a": 5.0}
    small = spark.createDataFrame([(None, 9)], "k string, w int")
    assert join_small(df, small, "k").where("w = 9").count() == 2


def test_f_does_not_cancel(spark):
    rows = [(i % 3, float(i % 3) + (i % 5) / 10) for i in range(300)]
    df = spark.createDataFrame(rows, "y int, x double")
    far = df.withColumn("x", F.col("x") + F.lit(1.7e9))
    a, b = (importance.f_classif(d, ["x"], "y").first()["score"] for d in (df, far))
    assert b == pytest.approx(a, rel=1e-4)


def test_json_files_of_every_shape(spark, tmp_path):
    (tmp_path / "lines.json").write_text('{"a": 1}\n{"a": 2}\n{"a": 3, "b\n\n{"a": 4}\n')
    (tmp_path / "pretty.json").write_text('{\n  "a": 5,\n  "c": {"d": [1, 2]}\n}\n')
    (tmp_path / "array.json").write_text('[\n{"a": 6},\n{"a": 7}\n]\n')
    (tmp_path / "one.json").write_text('[{"a": 8}, {"a": 9}]')
    for schema in (None, "a bigint"):
        got = io.read(spark, str(tmp_path), "json", schema=schema)
        assert sorted(r["a"] for r in got.collect()) == [1, 2, 4, 5, 6, 7, 8, 9]
        assert got.count() == 8


def test_csv_keeps_token_arrays_as_one_column(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"] * 300)], "id int, tokens array<string>")
    assert io.expand_vectors(df).columns == ["id", "tokens"]


def test_lineage_of_a_long_chain_and_a_cycle(spark):
    cat = scratch_path(spark, "lineage")
    df = spark.range(1)
    for i in range(40):
        catalog.register_dataset(spark, cat, df, f"d{i}", "p", "parquet", f"d{i - 1}" if i else None, dataset_id=f"d{i}", num_rows=1)
    catalog.register_dataset(spark, cat, df, "x", "p", "parquet", "y", dataset_id="x", num_rows=1)
    catalog.register_dataset(spark, cat, df, "y", "p", "parquet", "x", dataset_id="y", num_rows=1)
    got = {(r["dataset_id"], r["ancestor_id"]): r["depth"] for r in catalog.lineage(spark, cat).collect()}
    assert got[("d39", "d0")] == 39 and got[("x", "y")] == 1 and ("x", "x") in got


def test_cluster_without_shared_folder_is_refused(spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()  # noqa: N815

        class conf:  # noqa: N801
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())
