"""Registered queries: preview, counts, schema, typing, profiles (PRV-1..7, PRJ-1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprep.functions.exprs import round_all
from sparkprep.operators import profile
from sparkprep.plans.registry import register, table


@register("prv1_preview_ordered", """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag FROM lineitem
ORDER BY l_orderkey, l_linenumber LIMIT 10""")
def prv1_preview(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity",
                                             "l_extendedprice", "l_returnflag")
    return profile.preview(li, 10, ["l_orderkey", "l_linenumber"])


@register("prv2_row_column_counts", "SELECT count(*) AS num_rows, 11 AS num_columns FROM lineitem")
def prv2_counts(spark: SparkSession, sf: str) -> DataFrame:
    return profile.counts(table(spark, sf, "lineitem"))


@register("prv3_schema_listing", """
SELECT CAST(p AS INTEGER) AS position, n AS name, t AS type, true AS nullable FROM (VALUES
  (0, 'o_orderkey', 'bigint'), (1, 'o_custkey', 'bigint'), (2, 'o_orderstatus', 'string'), (3, 'o_totalprice', 'double'),
  (4, 'o_orderdate', 'timestamp_ntz'), (5, 'o_orderpriority', 'string')) v(p, n, t)""")
def prv3_schema(spark: SparkSession, sf: str) -> DataFrame:
    return profile.schema_table(table(spark, sf, "orders"))


def _text_kind(col: str, pos: int) -> str:
    return (f"SELECT {pos} AS position, '{col}' AS \"column\", CASE WHEN avg(len(string_split_regex({col}, '\\s+'))) > 5 "
            f"THEN 'text' ELSE 'categorical' END AS kind FROM documents")


@register("prv4_feature_types", f"""
SELECT 0 AS position, 'doc_id' AS "column", 'numeric' AS kind
UNION ALL {_text_kind('text', 1)}
UNION ALL {_text_kind('lang', 2)}
UNION ALL {_text_kind('source', 3)}
UNION ALL SELECT 4, 'n_chars', 'numeric'""")
def prv4_feature_types(spark: SparkSession, sf: str) -> DataFrame:
    return profile.feature_types(table(spark, sf, "documents"))


def _profile_sql(col: str) -> str:
    return f"""SELECT '{col}' AS "column", count({col}) AS non_null, count(DISTINCT {col}) AS "distinct",
  (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT CAST({col} AS VARCHAR) AS v FROM customer
   WHERE {col} IS NOT NULL ORDER BY v LIMIT 3)) AS sample_values FROM customer"""


@register("prv5_column_profile", " UNION ALL ".join(
    _profile_sql(c) for c in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")))
def prv5_column_profile(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    out = profile.column_profile(c, ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"], samples=3, exact_distinct=True)
    return out.select("column", "non_null", "distinct",
                      F.concat_ws("|", "sample_values").alias("sample_values"))


def _summary_sql(col: str) -> str:
    return (f"SELECT '{col}' AS \"column\", count({col}) AS count, round(avg({col}), 6) AS mean, "
            f"round(quantile_cont({col}, 0.5), 6) AS median, round(min({col}), 6) AS min, "
            f"round(max({col}), 6) AS max, round(stddev_samp({col}), 6) AS std FROM lineitem")


@register("prv6_numeric_summary", " UNION ALL ".join(
    _summary_sql(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def prv6_numeric_summary(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return round_all(profile.numeric_summary(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


@register("prv7_target_cardinality", """
SELECT 'l_returnflag' AS target, count(DISTINCT l_returnflag) AS n_unique, true AS is_categorical FROM lineitem
UNION ALL
SELECT 'l_quantity', count(DISTINCT l_quantity), count(DISTINCT l_quantity) < 10 FROM lineitem
UNION ALL
SELECT 'l_linenumber', count(DISTINCT l_linenumber), count(DISTINCT l_linenumber) < 10 FROM lineitem""")
def prv7_target_info(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return (profile.target_info(li, "l_returnflag").unionByName(profile.target_info(li, "l_quantity"))
            .unionByName(profile.target_info(li, "l_linenumber")))


@register("prj1_feature_projection",
          "SELECT o_orderstatus, o_orderpriority, o_totalprice FROM orders")
def prj1_projection(spark: SparkSession, sf: str) -> DataFrame:
    return profile.project(table(spark, sf, "orders"), "o_totalprice", ["o_orderstatus", "o_orderpriority"])


@register("flt1_row_predicates", """
SELECT l_orderkey, l_linenumber FROM lineitem
WHERE nullif(l_tax, 0.0) IS NOT NULL AND l_quantity BETWEEN 10 AND 40""")
def flt1_filters(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    from sparkprep.operators import clean
    out = clean.remove_nulls(li.withColumn("l_tax_n", F.nullif("l_tax", F.lit(0.0))), ["l_tax_n"])
    return out.where(F.col("l_quantity").between(10, 40)).select("l_orderkey", "l_linenumber")
