"""Physical-plan properties the design relies on."""

import contextlib
import io

from pyspark.sql import functions as F

from sparkprep.operators import charts, clean, features, importance, profile, text
from sparkprep.plans.q_viz import scored_documents


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_outlier_bounds_reach_the_parquet_scan(spark, sf_small):
    li = spark.read.parquet(f"{sf_small}/lineitem.parquet").select("l_orderkey", "l_extendedprice")
    plan = _plan(clean.outlier_removal(li, ["l_extendedprice"], "iqr"))
    scan = [ln for ln in plan.splitlines() if "FileScan parquet" in ln][0]
    assert "PushedFilters: [IsNotNull(l_extendedprice), GreaterThanOrEqual(l_extendedprice" in scan
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double>" in scan


def test_profile_values(spark):
    df = spark.createDataFrame([("b", 1.0, None), ("a", -0.0, None), ("c", 0.0, None), ("a", None, None)], "s string, x double, n string")
    for exact in (False, True):
        got = {r["column"]: (r["non_null"], r["distinct"], r["sample_values"]) for r in
               profile.column_profile(df, samples=2, exact_distinct=exact).collect()}
        assert got == {"s": (4, 3, ["a", "b"]), "x": (3, 2, ["0.0", "1.0"]), "n": (0, 0, None)}


def test_target_encoding_broadcasts_checked_small_side(spark, sf_small):
    o = spark.read.parquet(f"{sf_small}/orders.parquet")
    plan = _plan(clean.target_encode(o, "o_orderpriority", "o_totalprice"))
    assert "BroadcastHashJoin" in plan


def test_roc_has_no_single_partition_window(spark, sf_small):
    plan = _plan(charts.roc_curve(scored_documents(spark, sf_small)))
    window_lines = [ln for ln in plan.splitlines() if "Window [" in ln]
    assert window_lines and all("_pid" in ln for ln in window_lines)
    assert "SinglePartition" not in plan


def test_contingency_scans_the_input_once(spark, sf_small):
    li = spark.read.parquet(f"{sf_small}/lineitem.parquet")
    plan = _plan(importance.contingency(li, ["l_quantity", "l_tax"], "l_returnflag"))
    assert plan.count("FileScan parquet") == 1


def test_scalar_features_stay_in_codegen(spark, sf_small):
    li = spark.read.parquet(f"{sf_small}/lineitem.parquet")
    out = features.interaction_features(features.polynomial_features(li, ["l_quantity", "l_tax"], 2),
                                        ["l_quantity", "l_discount"])
    plan = _plan(out.select([c for c in out.columns if "_x_" in c or c.startswith("poly_")]))
    assert "*(1) Project" in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_text_term_counts_tokenize_once(spark, sf_small):
    from sparkprep.operators import text
    d = spark.read.parquet(f"{sf_small}/documents.parquet")
    plan = _plan(text.term_counts(d, "doc_id", "text"))
    assert plan.count("rtrim(") == 1
    assert "INSET" in plan


def test_terms_of_a_document_are_not_shuffled(spark):
    """Texts are dealt by document; (doc, term) rows stay where they are."""
    docs = spark.createDataFrame([(i % 40, f"w{i} w{i % 7} w{i}") for i in range(80)], "doc_id long, text string")
    plan = _plan(text.term_counts(docs, "doc_id", "text", tasks=3))
    assert plan.count("Exchange") == 1 and "hashpartitioning(doc_id" in plan and "term#" not in plan[plan.index("Exchange"):].split("\n")[0]


def test_tfidf_shuffles_rare_terms_only(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a b{i % 4} c{i} c{i}") for i in range(24)], "doc_id long, text string")
    whole = sorted(text.tfidf_long(docs, "doc_id", "text").collect())
    monkeypatch.setattr(text, "BROADCAST_TERMS", 0)
    monkeypatch.setattr(text, "FREQUENT_TERMS", 4)
    found = text.tfidf_long(docs, "doc_id", "text")
    assert sorted(found.collect()) == whole and len(whole) == 48
    assert "explode" not in _plan(found).lower()


def test_count_vectors_keep_ties_in_order(spark):
    rows = [(["t9", "t1", "t5", "all"],)] * 3 + [(["t5", "once", "all"],)] + [(["all"],)] * 2 + [([],)]
    data = spark.createDataFrame(rows, "tk array<string>")
    assert text.row_vocabulary(data, "tk", 2) == ["t5", "t1"]
    assert text.row_vocabulary(data, "tk", 9, 1.0, 0.9) == ["all", "t5", "t1", "t9", "once"]
