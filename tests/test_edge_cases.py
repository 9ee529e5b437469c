"""Hand-made edge fixtures (nulls, constants, tiny/empty inputs, unseen
categories, chained vector ops, JSON variants)."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from sparkprep.operators import charts, clean, features, metrics, profile
from sparkprep.operators.models import FittedModel, fit_pipeline
from sparkprep.plans.operations import apply_operations, run_operations
from sparkprep.session import scratch_path
from sparkprep.sources import io

MIXED_SCHEMA = "s string, i int, d double, b boolean"


@pytest.fixture()
def nulls_mixed(spark):
    rows = [("a", 1, 1.5, True), (None, 2, None, False), ("c", None, 3.5, None), ("d", 4, 4.5, True)]
    return spark.createDataFrame(rows, MIXED_SCHEMA)


def test_fillna_skips_type_mismatch(nulls_mixed):
    out = clean.fillna(nulls_mixed, 0).collect()
    assert [r["s"] for r in out] == ["a", None, "c", "d"]
    assert [r["i"] for r in out] == [1, 2, 0, 4]
    assert [r["d"] for r in out] == [1.5, 0.0, 3.5, 4.5]
    assert out[2]["b"] is None


def test_remove_nulls_subset_and_all(nulls_mixed):
    assert clean.remove_nulls(nulls_mixed, ["d"]).count() == 3
    assert clean.remove_nulls(nulls_mixed).count() == 2


def test_constant_column(spark):
    df = spark.createDataFrame([(7.0,)] * 5, "x double")
    mm = clean.normalize(df, ["x"], "minmax").select("x_scaled").distinct().collect()
    assert [r[0] for r in mm] == [0.5]
    zs = clean.normalize(df, ["x"], "zscore").select("x_scaled").distinct().collect()
    assert [r[0] for r in zs] == [0.0]
    b = features.binning(df, "x", 3).select("x_binned").distinct().collect()
    assert [r[0] for r in b] == [0.0]
    assert clean.outlier_removal(df, ["x"], "zscore", 1.0).count() == 5
    assert clean.outlier_removal(df, ["x"], "iqr", 1.5).count() == 5


def test_single_row_and_empty(spark):
    one = spark.createDataFrame([(3.0,)], "x double")
    empty = spark.createDataFrame([], "x double")
    assert clean.normalize(one, ["x"], "zscore").first()["x_scaled"] == 0.0
    assert clean.outlier_removal(one, ["x"], "iqr").count() == 1
    assert clean.outlier_removal(empty, ["x"], "iqr").count() == 0
    assert charts.histogram(empty, "x").count() == 0
    assert charts.box(empty, "x").first()["n"] == 0
    assert profile.numeric_summary(empty, ["x"]).first()["count"] == 0
    assert features.binning(one, "x", 1).first()["x_binned"] == 0.0


def test_unseen_category_uses_saved_encoder(spark):
    train = spark.createDataFrame([("a", 1.0, 0), ("b", 2.0, 1), ("a", 1.5, 0), ("b", 2.5, 1)] * 5,
                                  "cat string, x double, y int")
    score = spark.createDataFrame([("a", 1.0), ("c", 2.0)], "cat string, x double")
    fitted = fit_pipeline(train, "y", "logistic_regression", ["cat", "x"])
    path = fitted.save(scratch_path(spark, "unseen"))
    loaded = FittedModel.load(path)
    out = loaded.predict(score).collect()
    assert len(out) == 2  # unseen "c" is kept, not an error
    idx = loaded.pipeline.stages[0]
    assert list(idx.labelsArray[0]) == ["a", "b"]  # the fitted alphabetical codes, not refitted


def test_two_vector_ops_in_one_list(spark):
    df = spark.createDataFrame([(float(i), float(i * i % 7), float(i % 3)) for i in range(30)], "a double, b double, c double")
    ops = [{"type": "polynomial_features", "columns": ["a", "b"], "degree": 2},
           {"type": "pca", "columns": ["a", "b", "c"], "n_components": 2},
           {"type": "normalize", "columns": ["a"], "method": "minmax"},
           {"type": "normalize", "columns": ["b"], "method": "zscore"}]
    out = apply_operations(df, ops)
    assert {"poly_a", "poly_a_x_b", "poly_b_pow2", "pc1", "pc2", "a_scaled", "b_scaled"} <= set(out.columns)
    assert out.count() == 30
    assert not [c for c in out.columns if c.startswith("__")]


def test_polynomial_count_matches_real_size(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    out = features.polynomial_features(df, ["a", "b"], 2)
    assert len(out.columns) - 2 == features.polynomial_count(2, 2) == 5
    r = out.first()
    assert (r["poly_a"], r["poly_a_pow2"], r["poly_a_x_b"], r["poly_b"], r["poly_b_pow2"]) == (1, 1, 2, 2, 4)


def test_unknown_operation_raises(spark):
    df = spark.createDataFrame([(1.0,)], "x double")
    with pytest.raises(ValueError, match="unknown type"):
        apply_operations(df, [{"type": "no_such_op"}])


def test_json_variants(spark):
    d = tempfile.mkdtemp(prefix="json-variants-")
    with open(os.path.join(d, "arr.json"), "w") as f:
        json.dump([{"a": 1, "b": "x"}, {"a": 2, "b": "y"}], f)
    with open(os.path.join(d, "obj.json"), "w") as f:
        f.write('{\n  "a": 3,\n  "b": "z"\n}\n')
    with open(os.path.join(d, "lines.jsonl"), "w") as f:
        f.write('{"a": 4, "b": "p"}\n{"a": 5, "b": \n{"a": 6, "b": "q"}\n')
    arr = io.read(spark, os.path.join(d, "arr.json"), "json").orderBy("a").collect()
    assert [r["a"] for r in arr] == [1, 2]
    obj = io.read(spark, os.path.join(d, "obj.json"), "json").collect()
    assert obj[0]["a"] == 3
    good = io.read(spark, os.path.join(d, "lines.jsonl"), "jsonl", schema="a long, b string",
                   drop_malformed=True).orderBy("a").collect()
    assert [r["a"] for r in good] == [4, 6]
    with pytest.raises(ValueError, match="Unsupported file type"):
        io.read(spark, d, "xml")


def test_multi_part_json_keeps_every_row(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    path = io.write(df.repartition(5), scratch_path(spark, "multipart"), "json")
    parts = [p for p in os.listdir(path.replace("file:", "")) if p.startswith("part-")]
    assert len(parts) >= 3
    assert io.read(spark, path, "jsonl").count() == 1000


def test_csv_sink_expands_vectors(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "a double, b double")
    vec = features.assemble(df, ["a", "b"], "f", as_array=False)
    path = io.write(vec, scratch_path(spark, "csvvec"), "csv")
    back = io.read(spark, path, "csv")
    assert {"f_0", "f_1"} <= set(back.columns)


def test_run_operations_summary(spark, sf_small):
    out = scratch_path(spark, "runops")
    summary = run_operations(spark, f"{sf_small}/orders.parquet", out,
                             [{"type": "binning", "column": "o_totalprice", "bins": 4},
                              {"type": "categorical_encoding", "columns": ["o_orderstatus"], "method": "onehot"}],
                             "parquet")
    n = spark.read.parquet(f"{sf_small}/orders.parquet").count()
    assert summary["rows_processed"] == n
    assert summary["features_created"] == 1 + 3


def test_classification_metrics_string_labels(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "label string, prediction string")
    m = metrics.classification_metrics(df).first()
    assert m["accuracy"] == 0.5
    # class c never predicted: precision 0 for it (zero_division = 0)
    assert abs(m["precision"] - (2 * 1.0 + 1 * (1 / 3) + 0) / 4) < 1e-12


def test_json_type_reads_spark_json_lines_output_completely(spark):
    df = spark.range(500).select(F.col("id").alias("k"))
    path = io.write(df.repartition(3), scratch_path(spark, "jsonlines"), "json")
    assert io.read(spark, path, "json").count() == 500
    assert io.read(spark, path, "json", schema="k long").count() == 500


def test_json_type_mixed_files(spark):
    d = tempfile.mkdtemp(prefix="json-mixed-")
    with open(os.path.join(d, "a.json"), "w") as f:
        f.write('{"a": 1}\n{"a": 2}\n')
    with open(os.path.join(d, "b.json"), "w") as f:
        f.write('[\n  {"a": 3},\n  {"a": 4}\n]\n')
    with open(os.path.join(d, "c.json"), "w") as f:
        f.write('{\n "a": 5\n}\n')
    got = sorted(r["a"] for r in io.read(spark, d, "json").collect())
    assert got == [1, 2, 3, 4, 5]


def test_fused_statistics_equal_per_operation_statistics(spark, sf_small):
    from sparkprep.plans.operations import OPERATIONS
    li = spark.read.parquet(f"{sf_small}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity",
                                                                   "l_extendedprice", "l_discount")
    ops = [{"type": "outlier_removal", "columns": ["l_extendedprice"]},
           {"type": "normalize", "columns": ["l_extendedprice"], "method": "minmax"},
           {"type": "normalize", "columns": ["l_discount"], "method": "zscore"},
           {"type": "polynomial_features", "columns": ["l_quantity"], "degree": 2},
           {"type": "binning", "column": "l_quantity", "bins": 4},
           {"type": "binning", "column": "poly_l_quantity_pow2", "bins": 3}]
    fused = apply_operations(li, ops)
    plain = li
    for op in ops:
        plain = OPERATIONS[op["type"]](plain, op)
    assert fused.columns == plain.columns
    assert sorted(fused.collect()) == sorted(plain.collect())


def test_catalog_get_and_lineage(spark, sf_small):
    from sparkprep.sources import catalog
    cat = scratch_path(spark, "cat_test")
    src = f"{sf_small}/region.parquet"
    df = spark.read.parquet(src)
    catalog.register_dataset(spark, cat, df, "region", src, "parquet", dataset_id="r0")
    catalog.register_dataset(spark, cat, df.limit(2), "region2", src, "parquet", parent_dataset_id="r0",
                             operations=[{"type": "head", "n": 2}], dataset_id="r1")
    got = catalog.get_dataset(spark, cat, "r1")
    assert got["parent_dataset_id"] == "r0" and got["num_rows"] == 2
    assert got["processing_history"] == [{"type": "head", "n": "2"}]
    assert catalog.get_dataset(spark, cat, "missing") is None
    lin = {(r["dataset_id"], r["ancestor_id"], r["depth"]) for r in catalog.lineage(spark, cat).collect()}
    assert lin == {("r0", "r0", 0), ("r1", "r1", 0), ("r1", "r0", 1)}
