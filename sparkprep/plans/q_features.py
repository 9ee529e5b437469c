"""Registered queries: scalar feature engineering (FE-1..3, FE-11..15)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprep.functions.exprs import round_all
from sparkprep.operators import features
from sparkprep.plans.registry import bins_sql, register, table


@register("fe1_polynomial_features", """
SELECT l_orderkey, l_linenumber,
  round(l_quantity, 6) AS poly_l_quantity, round(l_quantity * l_quantity, 6) AS poly_l_quantity_pow2,
  round(l_quantity * l_discount, 6) AS poly_l_quantity_x_l_discount, round(l_discount, 6) AS poly_l_discount,
  round(l_discount * l_discount, 6) AS poly_l_discount_pow2
FROM lineitem""")
def fe1_polynomial(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    out = features.polynomial_features(li, ["l_quantity", "l_discount"], 2)
    return round_all(out.drop("l_quantity", "l_discount"))


@register("fe1_polynomial_degree3_count", """
SELECT count(*) AS n_rows, 19 AS n_features,
  round(sum(l_quantity * l_discount * l_tax), 4) AS sum_l_quantity_x_l_discount_x_l_tax,
  round(sum(l_tax * l_tax * l_tax), 6) AS sum_l_tax_pow3 FROM lineitem""")
def fe1_polynomial_degree3(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax")
    out = features.polynomial_features(li, ["l_quantity", "l_discount", "l_tax"], 3)
    n_feat = len([c for c in out.columns if c.startswith("poly_")])
    return out.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(n_feat).alias("n_features"),
                   F.round(F.sum("poly_l_quantity_x_l_discount_x_l_tax"), 4).alias(
                       "sum_l_quantity_x_l_discount_x_l_tax"),
                   F.round(F.sum("poly_l_tax_pow3"), 6).alias("sum_l_tax_pow3"))


@register("fe2_binning", f"""
WITH s AS (SELECT min(l_extendedprice) AS mn, max(l_extendedprice) AS mx FROM lineitem)
SELECT l_orderkey, l_linenumber, {bins_sql('l_extendedprice', 'mn', 'mx', 7)} AS l_extendedprice_binned
FROM lineitem, s""")
def fe2_binning(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return features.binning(li, "l_extendedprice", 7).drop("l_extendedprice")


@register("fe3_binning_labels", f"""
WITH s AS (SELECT min(p_retailprice) AS mn, max(p_retailprice) AS mx FROM part),
b AS (SELECT p_partkey, {bins_sql('p_retailprice', 'mn', 'mx', 3)} AS p_retailprice_binned FROM part, s)
SELECT p_partkey, p_retailprice_binned,
  CASE CAST(p_retailprice_binned AS INTEGER) WHEN 0 THEN 'low' WHEN 1 THEN 'mid' ELSE 'high' END AS p_retailprice_bin_label
FROM b""")
def fe3_binning_labels(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    return features.binning(p, "p_retailprice", 3, ["low", "mid", "high"]).drop("p_retailprice")


@register("fe11_interaction_features", """
SELECT l_orderkey, l_linenumber, round(l_quantity * l_discount, 6) AS l_quantity_x_l_discount,
  round(l_quantity * l_tax, 6) AS l_quantity_x_l_tax, round(l_discount * l_tax, 6) AS l_discount_x_l_tax
FROM lineitem""")
def fe11_interaction(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    return round_all(features.interaction_features(li, ["l_quantity", "l_discount", "l_tax"]).drop(
        "l_quantity", "l_discount", "l_tax"))


AGG_SQL = """SELECT user_id, round(avg(value), 6) AS value_mean, round(sum(value), 4) AS value_sum,
  round(min(value), 6) AS value_min, round(max(value), 6) AS value_max, count(value) AS value_count
FROM events GROUP BY user_id"""


@register("fe12_aggregation_table", AGG_SQL)
def fe12_aggregation_table(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    out = features.aggregation(e, ["user_id"], ["value"], ["mean", "sum", "min", "max", "count"])
    return out.select("user_id", F.round("value_mean", 6).alias("value_mean"),
                      F.round("value_sum", 4).alias("value_sum"), F.round("value_min", 6).alias("value_min"),
                      F.round("value_max", 6).alias("value_max"), "value_count")


@register("fe12_aggregation_broadcast_back", """
SELECT e.event_id, e.user_id, round(avg(value) OVER (PARTITION BY user_id), 6) AS value_mean,
  count(value) OVER (PARTITION BY user_id) AS value_count FROM events e""")
def fe12_aggregation_back(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "user_id", "value")
    out = features.aggregation(e, ["user_id"], ["value"], ["mean", "count"], mode="broadcast_back")
    return out.select("event_id", "user_id", F.round("value_mean", 6).alias("value_mean"), "value_count")


@register("fe12_aggregation_null_keys", """
SELECT event_id, round(avg(value) OVER (PARTITION BY k), 6) AS value_mean, count(value) OVER (PARTITION BY k) AS value_count
FROM (SELECT event_id, value, nullif(user_id % 5, 0) AS k FROM events)""")
def fe12_null_keys(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "value", F.nullif(F.pmod("user_id", F.lit(5)), F.lit(0)).alias("k"))
    out = features.aggregation(e, ["k"], ["value"], ["mean", "count"], mode="broadcast_back")
    return out.select("event_id", F.round("value_mean", 6).alias("value_mean"), "value_count")


LAG_SQL = """SELECT event_id,
  lag(value, 1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS value_lag1,
  lag(value, 3) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS value_lag3
FROM events"""


@register("fe13_lag_features", LAG_SQL)
def fe13_lag(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    out = features.lag_features(e, "value", [1, 3], ["ts", "event_id"], ["user_id"])
    return out.select("event_id", "value_lag1", "value_lag3")


@register("fe13_lag_features_skew_safe", LAG_SQL)
def fe13_lag_ordinal(spark: SparkSession, sf: str) -> DataFrame:
    """Same result through the hot-group path (global ordinal + equi-join)."""
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    out = features.lag_features(e, "value", [1, 3], ["ts", "event_id"], ["user_id"])
    return out.select("event_id", "value_lag1", "value_lag3")


@register("fe14_custom_transformer_sql", """
SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge
FROM lineitem WHERE l_returnflag = 'R'""")
def fe14_custom_sql(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return features.custom_transformer(li, sql=(
        "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge "
        "FROM __THIS__ WHERE l_returnflag = 'R'"))


@register("fe15_vector_assembly_skip_invalid", """
SELECT l_orderkey, l_linenumber, l_quantity AS features_0, nullif(l_tax, 0.0) AS features_1
FROM lineitem WHERE nullif(l_tax, 0.0) IS NOT NULL""")
def fe15_vector_assembly(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity",
                                             F.nullif("l_tax", F.lit(0.0)).alias("l_tax_n"))
    out = features.assemble(li, ["l_quantity", "l_tax_n"], "features", handle_invalid="skip")
    return out.select("l_orderkey", "l_linenumber", F.col("features")[0].alias("features_0"),
                      F.col("features")[1].alias("features_1"))


def _log_features(pdf):  # noqa: ANN001, ANN202
    import numpy as np
    import pandas as pd
    return pd.DataFrame({"l_orderkey": pdf["l_orderkey"], "l_linenumber": pdf["l_linenumber"],
                         "log_price": np.round(np.log(pdf["l_extendedprice"]), 9)})


@register("fe14_custom_transformer_batch_function", """
SELECT l_orderkey, l_linenumber, round(ln(l_extendedprice), 9) AS log_price FROM lineitem""")
def fe14_custom_batch(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return features.custom_transformer(li, batch_fn=_log_features,
                                       schema="l_orderkey long, l_linenumber int, log_price double")


@register("fe14_custom_transformer_dataframe_function", """
SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def fe14_custom_fn(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return features.custom_transformer(
        li, fn=lambda d: d.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n")))


@register("fe13_lag_features_hot_group_split",
          LAG_SQL.replace("FROM events", "FROM (SELECT event_id, nullif(user_id % 7, 0) AS user_id, ts, value FROM events)"))
def fe13_lag_hot_split(spark: SparkSession, sf: str) -> DataFrame:
    """A group of null keys takes part like any other."""
    e = table(spark, sf, "events").select("event_id", F.nullif(F.pmod("user_id", F.lit(7)), F.lit(0)).alias("user_id"), "ts", "value")
    out = features.lag_features(e, "value", [1, 3], ["ts", "event_id"], ["user_id"])
    return out.select("event_id", "value_lag1", "value_lag3")
