"""Registered queries: cleaning operators (CLN-1..11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprep.functions.exprs import round_all
from sparkprep.operators import clean
from sparkprep.plans.operations import apply_operations
from sparkprep.plans.registry import bins_sql, register, table

NULLED = """SELECT l_orderkey, l_linenumber, nullif(l_tax, 0.0) AS l_tax_n,
       nullif(l_discount, 0.0) AS l_discount_n, nullif(l_returnflag, 'R') AS l_returnflag_n
FROM lineitem"""


def nulled_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     F.nullif("l_tax", F.lit(0.0)).alias("l_tax_n"),
                     F.nullif("l_discount", F.lit(0.0)).alias("l_discount_n"),
                     F.nullif("l_returnflag", F.lit("R")).alias("l_returnflag_n"))


@register("cln1_remove_nulls", f"SELECT * FROM ({NULLED}) WHERE l_tax_n IS NOT NULL")
def cln1_remove_nulls(spark: SparkSession, sf: str) -> DataFrame:
    return clean.remove_nulls(nulled_lineitem(spark, sf), ["l_tax_n"])


@register("cln1_remove_nulls_all_columns",
          f"SELECT * FROM ({NULLED}) WHERE l_tax_n IS NOT NULL AND l_discount_n IS NOT NULL "
          "AND l_returnflag_n IS NOT NULL")
def cln1_remove_nulls_all(spark: SparkSession, sf: str) -> DataFrame:
    return clean.remove_nulls(nulled_lineitem(spark, sf))


@register("cln2_fillna", f"""
SELECT l_orderkey, l_linenumber, coalesce(l_tax_n, 0.0) AS l_tax_n, coalesce(l_discount_n, 0.0) AS l_discount_n,
       l_returnflag_n FROM ({NULLED})""")
def cln2_fillna(spark: SparkSession, sf: str) -> DataFrame:
    return clean.fillna(nulled_lineitem(spark, sf), 0)


@register("cln3_normalize_minmax", """
SELECT l_orderkey, l_linenumber,
  round((l_extendedprice - min(l_extendedprice) OVER ()) / (max(l_extendedprice) OVER () - min(l_extendedprice) OVER ()), 6) AS l_extendedprice_scaled,
  round((l_quantity - min(l_quantity) OVER ()) / (max(l_quantity) OVER () - min(l_quantity) OVER ()), 6) AS l_quantity_scaled
FROM lineitem""")
def cln3_normalize_minmax(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    out = clean.normalize(li, ["l_extendedprice", "l_quantity"], "minmax")
    return round_all(out.select("l_orderkey", "l_linenumber", "l_extendedprice_scaled", "l_quantity_scaled"))


@register("cln4_normalize_zscore", """
SELECT l_orderkey, l_linenumber,
  round((l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_samp(l_extendedprice) OVER (), 6) AS l_extendedprice_scaled,
  round((l_discount - avg(l_discount) OVER ()) / stddev_samp(l_discount) OVER (), 6) AS l_discount_scaled
FROM lineitem""")
def cln4_normalize_zscore(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")
    out = clean.normalize(li, ["l_extendedprice", "l_discount"], "zscore")
    return round_all(out.select("l_orderkey", "l_linenumber", "l_extendedprice_scaled", "l_discount_scaled"))


@register("cln5_outlier_iqr_sequential", """
WITH q1 AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem),
f1 AS (SELECT l.* FROM lineitem l, q1 WHERE l_extendedprice >= a - 1.5 * (b - a) AND l_extendedprice <= b + 1.5 * (b - a)),
q2 AS (SELECT quantile_cont(l_quantity, 0.25) AS a, quantile_cont(l_quantity, 0.75) AS b FROM f1),
f2 AS (SELECT f1.* FROM f1, q2 WHERE l_quantity >= a - 1.5 * (b - a) AND l_quantity <= b + 1.5 * (b - a))
SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity FROM f2""")
def cln5_outlier_iqr(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return clean.outlier_removal(li, ["l_extendedprice", "l_quantity"], "iqr", 1.5)


@register("cln5_outlier_iqr_orders", """
WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders)
SELECT o_orderkey, o_totalprice FROM orders, q
WHERE o_totalprice >= a - 1.0 * (b - a) AND o_totalprice <= b + 1.0 * (b - a)""")
def cln5_outlier_iqr_orders(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return clean.outlier_removal(o, ["o_totalprice"], "iqr", 1.0)


@register("cln6_outlier_zscore_sequential", """
WITH s1 AS (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s FROM lineitem),
f1 AS (SELECT l.* FROM lineitem l, s1 WHERE abs((l_extendedprice - m) / s) <= 2.0),
s2 AS (SELECT avg(l_discount) AS m, stddev_samp(l_discount) AS s FROM f1),
f2 AS (SELECT f1.* FROM f1, s2 WHERE abs((l_discount - m) / s) <= 2.0)
SELECT l_orderkey, l_linenumber FROM f2""")
def cln6_outlier_zscore(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")
    return clean.outlier_removal(li, ["l_extendedprice", "l_discount"], "zscore", 2.0).select(
        "l_orderkey", "l_linenumber")


@register("cln7_label_encoding", """
SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS DOUBLE) AS o_orderpriority_index
FROM orders""")
def cln7_label_encoding(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return clean.label_encode(o, ["o_orderpriority"]).select("o_orderkey", "o_orderpriority_index")


@register("cln8_one_hot_encoding", """
SELECT o_orderkey,
  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS o_orderstatus_F,
  CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS o_orderstatus_O,
  CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS o_orderstatus_P
FROM orders""")
def cln8_one_hot(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return clean.one_hot(o, "o_orderstatus").drop("o_orderstatus")


@register("cln9_target_encoding", """
WITH g AS (SELECT avg(o_totalprice) AS gm FROM orders),
c AS (SELECT o_orderpriority, count(o_totalprice) AS n, avg(o_totalprice) AS m FROM orders GROUP BY o_orderpriority)
SELECT o.o_orderkey, round((c.n * c.m + 10.0 * g.gm) / (c.n + 10.0), 4) AS o_orderpriority_te
FROM orders o JOIN c USING (o_orderpriority), g""")
def cln9_target_encoding(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    out = clean.target_encode(o, "o_orderpriority", "o_totalprice", 10.0)
    return round_all(out.select("o_orderkey", "o_orderpriority_te"), 4)


@register("cln10_datetime_features", """
SELECT event_id, CAST(year(ts) AS INTEGER) AS ts_year, CAST(quarter(ts) AS INTEGER) AS ts_quarter,
  CAST(month(ts) AS INTEGER) AS ts_month, CAST(day(ts) AS INTEGER) AS ts_day,
  CAST(dayofweek(ts) + 1 AS INTEGER) AS ts_dayofweek, CAST(week(ts) AS INTEGER) AS ts_weekofyear,
  CAST(hour(ts) AS INTEGER) AS ts_hour, CASE WHEN dayofweek(ts) IN (0, 6) THEN 1 ELSE 0 END AS ts_is_weekend
FROM events""")
def cln10_datetime_features(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "ts")
    return clean.datetime_features(e, "ts").drop("ts")


@register("cln10_datetime_features_orders", """
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year,
  CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_month,
  CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS o_orderdate_dayofweek,
  CAST(week(o_orderdate) AS INTEGER) AS o_orderdate_weekofyear
FROM orders""")
def cln10_datetime_orders(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return clean.datetime_features(o, "o_orderdate", ["year", "month", "dayofweek", "weekofyear"]).drop(
        "o_orderdate")


@register("cln11_binning_preprocess", f"""
WITH s AS (SELECT min(o_totalprice) AS mn, max(o_totalprice) AS mx FROM orders)
SELECT o_orderkey, {bins_sql('o_totalprice', 'mn', 'mx', 10)} AS o_totalprice_binned FROM orders, s""")
def cln11_binning_preprocess(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    out = apply_operations(o, [{"type": "binning", "column": "o_totalprice", "bins": 10}])
    return out.select("o_orderkey", "o_totalprice_binned")


PIP_OPS = [
    {"type": "fillna", "value": 0},
    {"type": "outlier_removal", "columns": ["o_totalprice"], "method": "zscore", "threshold": 2.5},
    {"type": "normalize", "columns": ["o_totalprice"], "method": "zscore"},
    {"type": "categorical_encoding", "columns": ["o_orderstatus"], "method": "onehot"},
    {"type": "datetime_features", "columns": ["o_orderdate"], "parts": ["year", "month"]},
]


@register("pip1_operation_list_summary", """
WITH s AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS sd FROM orders),
f AS (SELECT o.* FROM orders o, s WHERE abs((o_totalprice - m) / sd) <= 2.5)
SELECT 'success' AS status, 5 AS operations_applied, 6 AS features_created,
  (SELECT count(*) FROM f) AS rows_processed, 12 AS columns_processed""")
def pip1_summary(spark: SparkSession, sf: str) -> DataFrame:
    from sparkprep.plans.operations import run_operations
    from sparkprep.session import scratch_path, table_path
    summary = run_operations(spark, table_path(sf, "orders"), scratch_path(spark, "pip1"), PIP_OPS, "parquet")
    return spark.createDataFrame([summary], "status string, operations_applied int, features_created int, "
                                            "rows_processed bigint, columns_processed int")


TWICE_OPS = [
    {"type": "normalize", "columns": ["o_totalprice"]},
    {"type": "normalize", "columns": ["o_totalprice"], "method": "zscore"},
    {"type": "binning", "column": "o_totalprice_scaled", "bins": 4},
]


@register("pip1_normalize_twice_then_bin", f"""
WITH s AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS sd FROM orders),
z AS (SELECT o_orderkey, (o_totalprice - m) / sd AS z FROM orders, s),
b AS (SELECT min(z) AS mn, max(z) AS mx FROM z)
SELECT o_orderkey, round(z, 6) AS o_totalprice_scaled, {bins_sql('z', 'mn', 'mx', 4)} AS o_totalprice_scaled_binned FROM z, b""")
def pip1_twice(spark: SparkSession, sf: str) -> DataFrame:
    """A column written twice is binned by its last values."""
    from sparkprep.plans.operations import apply_operations
    out = apply_operations(table(spark, sf, "orders"), TWICE_OPS)
    return round_all(out.select("o_orderkey", "o_totalprice_scaled", "o_totalprice_scaled_binned"))


@register("cln4_normalize_scale_only", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice / stddev_samp(l_extendedprice) OVER (), 6) AS l_extendedprice_scaled
FROM lineitem""")
def cln4_scale_only(spark: SparkSession, sf: str) -> DataFrame:
    """center=False: x / stddev, what a default StandardScaler computes."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    out = clean.normalize(li, ["l_extendedprice"], "zscore", center=False)
    return round_all(out.select("l_orderkey", "l_linenumber", "l_extendedprice_scaled"))


@register("cln5_outlier_iqr_simultaneous", """
WITH q AS (SELECT quantile_cont(c_acctbal, 0.25) AS a, quantile_cont(c_acctbal, 0.75) AS b,
                  quantile_cont(c_nationkey, 0.25) AS c, quantile_cont(c_nationkey, 0.75) AS d FROM customer)
SELECT c_custkey FROM customer, q
WHERE c_acctbal >= a - 0.5 * (b - a) AND c_acctbal <= b + 0.5 * (b - a)
  AND c_nationkey >= c - 0.5 * (d - c) AND c_nationkey <= d + 0.5 * (d - c)""")
def cln5_simultaneous(spark: SparkSession, sf: str) -> DataFrame:
    """Bounds of every column from the same (unfiltered) rows."""
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    return clean.outlier_removal(c, ["c_acctbal", "c_nationkey"], "iqr", 0.5, sequential=False).select("c_custkey")


@register("cln5_outlier_iqr_approximate")
def cln5_approx(spark: SparkSession, sf: str) -> DataFrame:
    """percentile_approx quartiles (bounded sketch memory), rows-only check."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return clean.outlier_removal(o, ["o_totalprice"], "iqr", 1.0, exact=False)
