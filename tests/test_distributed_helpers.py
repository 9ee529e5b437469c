"""The distributed building blocks agree with their single-partition forms."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkprep.functions import stats
from sparkprep.functions.ordinal import dense_codes, prefix_sums, with_ordinal
from sparkprep.operators import features


def _exact(spark, vals, probs):
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = stats.exact_quantiles(df, "x", probs, slice_limit=7, accuracy=40)
    want = df.agg(F.percentile("x", probs)).first()[0]
    return got, list(want)


def test_exact_quantiles_refinement_matches_percentile(spark):
    rnd = random.Random(7)
    vals = [rnd.choice([1.0, 2.0, 2.0, 5.5]) for _ in range(40)] + [rnd.uniform(-50, 50) for _ in range(300)]
    got, want = _exact(spark, vals, [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0])
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, want))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(-20, 20), min_size=1, max_size=60),
       st.floats(0, 1, allow_nan=False))
def test_exact_quantiles_property(spark, ints, p):
    got, want = _exact(spark, [float(i) for i in ints], [p])
    assert abs(got[0] - want[0]) < 1e-9


def test_with_ordinal_is_contiguous_and_ordered(spark):
    df = spark.range(500).select(((F.col("id") * 37) % 101).alias("k"), F.col("id"))
    out = with_ordinal(df, ["k", "id"], "o", num_partitions=6).orderBy("o").collect()
    assert [r["o"] for r in out] == list(range(500))
    keys = [(r["k"], r["id"]) for r in out]
    assert keys == sorted(keys)


def test_dense_codes(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",), (None,)], "v string")
    codes = {r["v"]: r["code"] for r in dense_codes(df, "v", "code").collect()}
    assert codes == {"a": 0, "b": 1, "c": 2}


def test_prefix_sums_match_window(spark):
    df = spark.range(300).select(F.col("id").alias("t"), ((F.col("id") * 13) % 7).alias("v"))
    got = {r["t"]: r["cum_v"] for r in prefix_sums(df, [F.desc("t")], ["v"], num_partitions=5).collect()}
    w = Window.orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = {r["t"]: r["c"] for r in df.select("t", F.sum("v").over(w).alias("c")).collect()}
    assert got == want


def test_lag_hot_key_path_equals_window(spark):
    # one user holds a third of the rows
    rows = [(i, 0 if i % 3 == 0 else i % 17, float(i % 11)) for i in range(600)]
    df = spark.createDataFrame(rows, "eid long, user long, v double")
    a = features.lag_features(df, "v", [1, 2], ["eid"], ["user"])
    b = features.lag_features(df, "v", [1, 2], ["eid"], ["user"])
    key = ["eid", "v_lag1", "v_lag2"]
    assert sorted(a.select(*key).collect()) == sorted(b.select(*key).collect())


def test_exact_quantiles_bucket_refinement_path(spark):
    rnd = random.Random(11)
    vals = [rnd.gauss(0, 1) ** 3 for _ in range(800)] + [3.0] * 200
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    probs = [0.05, 0.25, 0.5, 0.75, 0.99]
    want = list(df.agg(F.percentile("x", probs)).first()[0])
    # accuracy=10 forces the bucket path (6n/accuracy > slice_limit)
    got = stats.exact_quantiles_multi(df, {"x": probs}, slice_limit=7, accuracy=40)["x"]
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, want))


def test_exact_quantiles_multi_columns_with_nulls(spark):
    rows = [(float(i % 13) if i % 5 else None, float((i * 7) % 101)) for i in range(500)]
    df = spark.createDataFrame(rows, "a double, b double")
    got = stats.exact_quantiles_multi(df, {"a": [0.1, 0.5], "b": [0.25, 0.75, 1.0]}, slice_limit=5, accuracy=30)
    for c, probs in (("a", [0.1, 0.5]), ("b", [0.25, 0.75, 1.0])):
        want = list(df.agg(F.percentile(c, probs)).first()[0])
        assert all(abs(x - y) < 1e-9 for x, y in zip(got[c], want))


def test_lag_equals_window_with_null_and_hot_keys(spark):
    from pyspark.sql import Window
    rows = [(i, None if i % 3 == 0 else i % 17, float(i % 11)) for i in range(600)]
    df = spark.createDataFrame(rows, "eid long, user long, v double")
    a = features.lag_features(df, "v", [1, 3], ["eid"], ["user"])
    w = Window.partitionBy("user").orderBy("eid")
    b = df.select("*", F.lag("v", 1).over(w).alias("v_lag1"), F.lag("v", 3).over(w).alias("v_lag3"))
    key = ["eid", "user", "v", "v_lag1", "v_lag3"]
    assert sorted(map(str, a.select(*key).collect())) == sorted(map(str, b.select(*key).collect()))


def test_quantiles_end_on_infinities_and_large_brackets(spark):
    inf = float("inf")
    rnd = random.Random(1)
    rows = [(rnd.choice([rnd.gauss(0, 1), rnd.expovariate(1) * 1e6, 3.0, -inf, inf]),) for _ in range(3000)]
    df = spark.createDataFrame(rows, "v double")
    ordered = sorted(r[0] for r in rows)
    probs = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    got = stats.exact_quantiles(df, "v", probs, slice_limit=20, accuracy=40)
    for p, g in zip(probs, got):
        lo, hi = ordered[int(p * 2999)], ordered[min(2999, int(p * 2999) + 1)]
        assert lo <= g <= hi or g == lo or (g != g and lo == -inf)


def test_grouped_exact_quantiles_match_percentile(spark):
    from sparkprep.functions.ordinal import grouped_exact_quantiles
    rnd = random.Random(3)
    rows = [("hot" if i % 2 == 0 else f"g{i % 7}", rnd.choice([rnd.uniform(0, 9), 4.0])) for i in range(700)]
    rows += [("nulls", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: [r[f"q{i}"] for i in range(len(probs))]
           for r in grouped_exact_quantiles(df, ["g"], "v", probs).collect() if r["q0"] is not None}
    want = {r["g"]: r["p"] for r in df.groupBy("g").agg(F.percentile("v", probs).alias("p")).collect()
            if r["p"] is not None}
    assert set(got) == set(want)
    for g in want:
        assert all(abs(a - b) < 1e-9 for a, b in zip(got[g], want[g]))


def test_join_small_checks_rows_and_bytes(spark):
    from sparkprep.functions.joins import join_small, measure
    big = spark.range(100).select(F.col("id").alias("k"))
    small = spark.range(10).select(F.col("id").alias("k"), F.repeat(F.lit("x"), 1000).alias("s"))
    rows, size = measure(small)
    assert rows == 10 and size >= 10 * 1000

    def plan(df):
        import contextlib
        import io
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain()
        return buf.getvalue()
    assert "BroadcastHashJoin" in plan(join_small(big, small, "k"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" not in plan(join_small(big, small, "k", max_bytes=5000))
        assert "BroadcastHashJoin" not in plan(join_small(big, small, "k", max_rows=5))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert join_small(big, small, "k", max_bytes=5000).count() == 100
