"""Registered queries: scans, sinks, listing and catalog (SRC, SNK, CAT).

Round-trip queries write data Spark derives from the test tables into a
fresh folder under the shared checkpoint directory and read it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprep.functions.exprs import split_hash
from sparkprep.operators import clean, features
from sparkprep.plans.registry import register, table
from sparkprep.session import scratch_path, table_path
from sparkprep.sources import catalog, io

JSON_ARRAY_ROWS = 5000  # rows per JSON-array file (bounds each group)


@register("src1_csv_scan_explicit_schema",
          "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag FROM lineitem")
def src1_csv_explicit(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity",
                                             "l_extendedprice", "l_returnflag")
    path = io.write(li, scratch_path(spark, "src1"), "csv")
    return io.read(spark, path, "csv", schema=li.schema)


@register("src1_csv_scan_inferred",
          "SELECT l_orderkey, l_quantity, l_extendedprice, l_returnflag FROM lineitem")
def src1_csv_inferred(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_returnflag")
    path = io.write(li, scratch_path(spark, "src1i"), "csv")
    back = io.read(spark, path, "csv")  # header + inferred types
    return back.select(F.col("l_orderkey").cast("bigint").alias("l_orderkey"), "l_quantity",
                       "l_extendedprice", "l_returnflag")


@register("src2_parquet_scan_pushdown", """
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_returnflag = 'R'""")
def src2_parquet_scan(spark: SparkSession, sf: str) -> DataFrame:
    li = io.read(spark, table_path(sf, "lineitem"), "parquet")
    return (li.where((F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz"))
                     & (F.col("l_returnflag") == "R"))
            .select("l_orderkey", "l_linenumber", "l_extendedprice"))


ORDERS_COLS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
ORDERS_SQL = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"


@register("src3_jsonl_scan", ORDERS_SQL)
def src3_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(*ORDERS_COLS)
    path = io.write(o, scratch_path(spark, "src3"), "jsonl")
    return io.read(spark, path, "jsonl", schema=o.schema)


@register("src3_json_multiline_arrays", ORDERS_SQL)
def src3_json_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """Whole-file JSON arrays (one per chunk of ~JSON_ARRAY_ROWS rows) read with multiLine."""
    o = table(spark, sf, "orders").select(*ORDERS_COLS)
    n = o.count()
    chunks = max(1, -(-n // JSON_ARRAY_ROWS))
    arrays = (o.withColumn("chunk", F.pmod(split_hash("o_orderkey"), F.lit(chunks)))
              .groupBy("chunk").agg(F.to_json(F.collect_list(F.struct(*ORDERS_COLS))).alias("value")))
    path = scratch_path(spark, "src3a")
    arrays.write.partitionBy("chunk").text(path)
    back = io.read(spark, path, "json", schema=o.schema, recursiveFileLookup=True)
    return back


@register("src4_json_drop_malformed", ORDERS_SQL + " WHERE o_orderstatus <> 'P'")
def src4_json_drop_malformed(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of 'P' orders are cut short (corrupt JSON) and must be dropped."""
    o = table(spark, sf, "orders").select(*ORDERS_COLS)
    js = F.to_json(F.struct(*ORDERS_COLS))
    lines = o.select(F.when(F.col("o_orderstatus") == "P", F.expr("substring(to_json(struct(*)), 1, 17)"))
                     .otherwise(js).alias("value"))
    path = scratch_path(spark, "src4")
    lines.write.text(path)
    return io.read(spark, path, "jsonl", schema=o.schema, drop_malformed=True)


@register("src4_json_type_bad_line", ORDERS_SQL + " WHERE o_orderkey % 10 <> 3")
def src4_json_type_bad_line(spark: SparkSession, sf: str) -> DataFrame:
    """Type json: every tenth line is cut short; the others all come back."""
    o = table(spark, sf, "orders").select(*ORDERS_COLS)
    js = F.to_json(F.struct(*ORDERS_COLS))
    lines = o.select(F.when(F.col("o_orderkey") % 10 == 3, F.substring(js, 1, 17)).otherwise(js).alias("value"))
    path = scratch_path(spark, "src4j")
    lines.write.text(path)
    return io.read(spark, path, "json", schema=o.schema)


@register("src5_format_dispatch_parquet", "SELECT count(*) AS n FROM orders")
def src5_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    return io.read(spark, table_path(sf, "orders"), "PARQUET").agg(F.count(F.lit(1)).alias("n"))


@register("src6_object_uri_read",
          "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY l_returnflag")
def src6_uri(spark: SparkSession, sf: str) -> DataFrame:
    uri = "file://" + table_path(sf, "lineitem") if sf.startswith("/") else table_path(sf, "lineitem")
    li = io.read(spark, uri, "parquet")
    return li.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@register("src7_object_listing")
def src7_listing(spark: SparkSession, sf: str) -> DataFrame:
    return io.list_objects(spark, sf, recursive=True, glob="*.parquet")


@register("snk1_csv_sink_vector_columns",
          "SELECT l_orderkey, l_linenumber, l_quantity AS features_0, l_discount AS features_1 FROM lineitem")
def snk1_csv_vectors(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    vec = features.assemble(li, ["l_quantity", "l_discount"], "features", as_array=False).select(
        "l_orderkey", "l_linenumber", "features")
    path = io.write(vec, scratch_path(spark, "snk1"), "csv")
    back = io.read(spark, path, "csv")
    return back.select(F.col("l_orderkey").cast("bigint"), F.col("l_linenumber").cast("int"),
                       F.col("features_0").cast("double"), F.col("features_1").cast("double"))


@register("snk2_parquet_sink_partitioned",
          "SELECT l_orderkey, l_linenumber, l_returnflag, l_extendedprice FROM lineitem")
def snk2_parquet(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    path = io.write(li, scratch_path(spark, "snk2"), "parquet", partition_by=["l_returnflag"])
    return io.read(spark, path, "parquet").select("l_orderkey", "l_linenumber", "l_returnflag",
                                                  "l_extendedprice")


@register("snk3_json_sink_multi_part", ORDERS_SQL)
def snk3_json(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(*ORDERS_COLS)
    path = io.write(o.repartition(4), scratch_path(spark, "snk3"), "json")
    return io.read(spark, path, "jsonl", schema=o.schema)


# --------------------------------------------------------------------------
# Catalog: three derived datasets with lineage (CAT-1..3)
# --------------------------------------------------------------------------
_CAT_COUNTS = """
WITH b AS (SELECT * FROM lineitem WHERE nullif(l_tax, 0.0) IS NOT NULL),
q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS z FROM b),
c AS (SELECT b.* FROM b, q WHERE l_extendedprice >= a - 1.5 * (z - a) AND l_extendedprice <= z + 1.5 * (z - a))
"""


def _build_catalog(spark: SparkSession, sf: str) -> str:
    cat = scratch_path(spark, "catalog")
    src = table_path(sf, "lineitem")
    li = io.read(spark, src, "parquet")
    catalog.register_dataset(spark, cat, li, "lineitem", src, "parquet", dataset_id="ds_raw")
    ops_b = [{"type": "remove_nulls", "columns": ["l_tax"]}]
    b = clean.remove_nulls(li.withColumn("l_tax", F.nullif("l_tax", F.lit(0.0))), ["l_tax"])
    pb = io.write(b, scratch_path(spark, "ds_clean"), "parquet")
    catalog.register_dataset(spark, cat, io.read(spark, pb, "parquet"), "lineitem_clean", pb, "parquet",
                             parent_dataset_id="ds_raw", operations=ops_b, dataset_id="ds_clean")
    ops_c = [{"type": "outlier_removal", "columns": ["l_extendedprice"], "method": "iqr"}]
    bb = io.read(spark, pb, "parquet")
    c = clean.outlier_removal(bb, ["l_extendedprice"], "iqr", 1.5)
    pc = io.write(c, scratch_path(spark, "ds_final"), "parquet")
    catalog.register_dataset(spark, cat, io.read(spark, pc, "parquet"), "lineitem_final", pc, "parquet",
                             parent_dataset_id="ds_clean", operations=ops_c, dataset_id="ds_final")
    # a second version of ds_clean (re-registered with a description)
    catalog.register_dataset(spark, cat, io.read(spark, pb, "parquet"), "lineitem_clean", pb, "parquet",
                             parent_dataset_id="ds_raw", operations=ops_b, dataset_id="ds_clean",
                             description="v2")
    return cat


@register("cat1_register_datasets", _CAT_COUNTS + """
SELECT 'ds_raw' AS dataset_id, NULL AS parent_dataset_id, (SELECT count(*) FROM lineitem) AS num_rows, 11 AS num_columns, 0 AS n_ops
UNION ALL SELECT 'ds_clean', 'ds_raw', (SELECT count(*) FROM b), 11, 1
UNION ALL SELECT 'ds_final', 'ds_clean', (SELECT count(*) FROM c), 11, 1
UNION ALL SELECT 'ds_clean', 'ds_raw', (SELECT count(*) FROM b), 11, 1""")
def cat1_register(spark: SparkSession, sf: str) -> DataFrame:
    cat = _build_catalog(spark, sf)
    rows = spark.read.schema(catalog.DATASET_SCHEMA).parquet(cat)
    return rows.select("dataset_id", "parent_dataset_id", "num_rows", "num_columns",
                       F.size("processing_history").alias("n_ops"))


@register("cat2_list_latest", _CAT_COUNTS + """
SELECT 'ds_raw' AS dataset_id, 'lineitem' AS name, '' AS description, (SELECT count(*) FROM lineitem) AS num_rows
UNION ALL SELECT 'ds_clean', 'lineitem_clean', 'v2', (SELECT count(*) FROM b)
UNION ALL SELECT 'ds_final', 'lineitem_final', '', (SELECT count(*) FROM c)""")
def cat2_list(spark: SparkSession, sf: str) -> DataFrame:
    cat = _build_catalog(spark, sf)
    return catalog.list_datasets(spark, cat).select("dataset_id", "name", "description", "num_rows")


@register("cat3_lineage", _CAT_COUNTS + """
SELECT dataset_id, ancestor_id, depth FROM (VALUES ('ds_raw', 'ds_raw', 0), ('ds_clean', 'ds_clean', 0),
  ('ds_clean', 'ds_raw', 1), ('ds_final', 'ds_final', 0), ('ds_final', 'ds_clean', 1),
  ('ds_final', 'ds_raw', 2)) AS t(dataset_id, ancestor_id, depth)
WHERE (SELECT count(*) FROM c) > 0""")
def cat3_lineage(spark: SparkSession, sf: str) -> DataFrame:
    cat = _build_catalog(spark, sf)
    return catalog.lineage(spark, cat)


@register("cat2_list_charts_by_dataset_and_type", """
SELECT 'hist_price' AS chart_id, 'histogram' AS chart_type, 'lineitem' AS dataset_id, CAST(20 AS BIGINT) AS num_rows
UNION ALL
SELECT 'hist_qty', 'histogram', 'lineitem', CAST(10 AS BIGINT)
WHERE (SELECT count(*) FROM lineitem) > 0""")
def cat2_charts(spark: SparkSession, sf: str) -> DataFrame:
    from sparkprep.operators import charts
    cat = scratch_path(spark, "chart_catalog")
    li = table(spark, sf, "lineitem")
    o = table(spark, sf, "orders")
    catalog.register_chart(spark, cat, charts.histogram(li, "l_extendedprice", 20), "histogram", "lineitem",
                           scratch_path(spark, "chart"), options={"bins": 20}, chart_id="hist_price")
    catalog.register_chart(spark, cat, charts.histogram(li, "l_quantity", 10), "histogram", "lineitem",
                           scratch_path(spark, "chart"), options={"bins": 10}, chart_id="hist_qty")
    catalog.register_chart(spark, cat, charts.box(li, "l_discount"), "box", "lineitem",
                           scratch_path(spark, "chart"), chart_id="box_discount")
    catalog.register_chart(spark, cat, charts.pie(o, "o_orderstatus"), "pie", "orders",
                           scratch_path(spark, "chart"), chart_id="pie_status")
    return catalog.list_charts(spark, cat, dataset_id="lineitem", chart_type="histogram").select(
        "chart_id", "chart_type", "dataset_id", "num_rows")


@register("src4_json_rejects", """WITH l AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS line FROM orders),
r AS (SELECT line, o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 10 = 3 THEN 'not json ' || o_orderkey
  WHEN o_orderkey % 10 = 7 THEN '{"o_orderkey":"seven","o_orderpriority":"x"}' END AS bad FROM l)
SELECT CASE WHEN bad IS NULL THEN 'row' ELSE 'reject' END AS kind, CAST(CASE WHEN bad IS NULL THEN o_orderkey ELSE line END AS BIGINT) AS number,
  CASE WHEN bad IS NULL THEN o_orderpriority ELSE bad END AS text FROM r""")
def src4_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """orders as JSON lines of which two in ten do not parse: rows, and rejects with their lines."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    key = F.col("o_orderkey")
    line = (F.when(key % 10 == 3, F.concat(F.lit("not json "), key.cast("string")))
            .when(key % 10 == 7, F.lit('{"o_orderkey":"seven","o_orderpriority":"x"}')).otherwise(F.to_json(F.struct("o_orderkey", "o_orderpriority"))))
    path = scratch_path(spark, "lines")
    o.orderBy("o_orderkey").coalesce(1).select(line.alias("value")).write.text(path)
    rows, rejects = io.read_with_rejects(spark, path, "jsonl", "o_orderkey bigint, o_orderpriority string", scratch_path(spark, "rejects"))
    return (rows.select(F.lit("row").alias("kind"), F.col("o_orderkey").alias("number"), F.col("o_orderpriority").alias("text"))
            .unionByName(rejects.select(F.lit("reject").alias("kind"), F.col("line").alias("number"), "text")))
