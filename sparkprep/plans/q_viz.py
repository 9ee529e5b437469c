"""Registered queries: evaluation metrics and chart tables (MET, VIZ)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprep.functions.exprs import round_all, split_hash_sql
from sparkprep.operators import charts, metrics
from sparkprep.plans.registry import bins_sql, register, table

# Fixed scoring rules standing in for a model, identical in both engines.
REG_PRED = "950.0 * l_quantity + 1000.0"
CLS_SCORE = "n_chars / (n_chars + CAST(2000 AS DOUBLE))"
CLS_PRED = "CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END"


def scored_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("label"),
                     F.expr(REG_PRED).alias("prediction"))


def scored_documents(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    return d.join(lab, "doc_id").select("doc_id", F.col("quality").alias("label"),
                                        F.expr(CLS_PRED).alias("prediction"),
                                        F.expr(CLS_SCORE).alias("score"))


DOCS_SQL = (f"SELECT d.doc_id, l.quality AS label, {CLS_PRED} AS prediction, {CLS_SCORE} AS score "
            "FROM documents d JOIN labels l ON d.doc_id = l.doc_id")


@register("met1_4_regression_metrics", f"""
SELECT round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae,
  round(1.0 - sum((y - p) * (y - p)) / (var_pop(y) * count(y)), 6) AS r2,
  round(avg(abs((y - p) / (y + 1e-10))) * 100.0, 6) AS mape
FROM (SELECT l_extendedprice AS y, {REG_PRED} AS p FROM lineitem)""")
def met_regression(spark: SparkSession, sf: str) -> DataFrame:
    m = metrics.regression_metrics(scored_lineitem(spark, sf))
    return m.select(F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"),
                    F.round("r2", 6).alias("r2"), F.round("mape", 6).alias("mape"))


def _weighted_sql(src: str) -> str:
    return f"""WITH s AS ({src}),
cm AS (SELECT label AS l, prediction AS p, count(*) AS n FROM s GROUP BY 1, 2),
sup AS (SELECT l AS cls, sum(n) AS support FROM cm GROUP BY 1),
prd AS (SELECT p AS cls, sum(n) AS predicted FROM cm GROUP BY 1),
tp AS (SELECT l AS cls, n AS tp FROM cm WHERE l = p),
pc AS (SELECT coalesce(sup.cls, prd.cls) AS cls, CAST(coalesce(support, 0) AS DOUBLE) AS support,
              CAST(coalesce(predicted, 0) AS DOUBLE) AS predicted
       FROM sup FULL JOIN prd ON sup.cls = prd.cls),
pc2 AS (SELECT pc.*, CAST(coalesce(tp.tp, 0) AS DOUBLE) AS tp FROM pc LEFT JOIN tp ON pc.cls = tp.cls)
SELECT round(sum(tp) / sum(support), 6) AS accuracy,
  round(sum(support * CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END) / sum(support), 6) AS precision,
  round(sum(support * CASE WHEN support > 0 THEN tp / support ELSE 0 END) / sum(support), 6) AS recall,
  round(sum(support * CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0 END)
        / sum(support), 6) AS f1
FROM pc2"""


@register("met5_8_classification_metrics_binary", _weighted_sql(DOCS_SQL))
def met_classification(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(metrics.classification_metrics(scored_documents(spark, sf)))


MULTI_PRED = ("CASE WHEN l_discount < 0.03 THEN 'A' WHEN l_discount < 0.07 THEN 'N' ELSE 'R' END")


@register("met5_8_classification_metrics_multiclass",
          _weighted_sql(f"SELECT l_returnflag AS label, {MULTI_PRED} AS prediction FROM lineitem"))
def met_classification_multi(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("label"),
                                             F.expr(MULTI_PRED).alias("prediction"))
    return round_all(metrics.classification_metrics(li))


@register("viz1_histogram", f"""
WITH s AS (SELECT min(l_extendedprice) AS mn, max(l_extendedprice) AS mx FROM lineitem),
h AS (SELECT CAST({bins_sql('l_extendedprice', 'mn', 'mx', 20)} AS INTEGER) AS bin, count(*) AS n
      FROM lineitem, s GROUP BY 1)
SELECT CAST(g.bin AS INTEGER) AS bin, round(mn + g.bin * ((mx - mn) / 20), 6) AS bin_start,
  round(CASE WHEN g.bin = 19 THEN mx ELSE mn + (g.bin + 1) * ((mx - mn) / 20) END, 6) AS bin_end,
  coalesce(h.n, 0) AS count
FROM (SELECT range AS bin FROM range(20)) g LEFT JOIN h ON g.bin = h.bin, s""")
def viz1_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(charts.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 20))


@register("viz2_kde", """
WITH s AS (SELECT count(l_quantity) AS n, min(l_quantity) AS mn, max(l_quantity) AS mx,
                  stddev_samp(l_quantity) AS sd FROM lineitem),
p AS (SELECT n, mn, mx, sd * pow(n, -0.2) AS h FROM s),
g AS (SELECT n, h, mn - 3.0 * h AS glo, (mx + 3.0 * h - (mn - 3.0 * h)) / 199 AS gstep FROM p)
SELECT CAST(j.range AS INTEGER) AS grid_index, round(min(glo + j.range * gstep), 6) AS x,
  round(sum(exp(-0.5 * pow((glo + j.range * gstep - l_quantity) / h, 2)) / (n * h * sqrt(2 * pi()))), 9) AS density
FROM lineitem, g, range(200) j WHERE l_quantity IS NOT NULL GROUP BY j.range""")
def viz2_kde(spark: SparkSession, sf: str) -> DataFrame:
    k = charts.kde(table(spark, sf, "lineitem"), "l_quantity", 200)
    return k.select("grid_index", F.round("x", 6).alias("x"), F.round("density", 9).alias("density"))


@register("viz3_scatter_sampled", f"""
SELECT l_quantity, l_extendedprice, l_returnflag FROM lineitem
WHERE {split_hash_sql('l_orderkey')} < CAST(floor(0.25 * 2147483648) AS BIGINT)""")
def viz3_scatter(spark: SparkSession, sf: str) -> DataFrame:
    return charts.scatter(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag",
                          key="l_orderkey", fraction=0.25)


@register("viz4_bar_median_null_category", """
SELECT nullif(p_type, (SELECT min(p_type) FROM part)) AS p_type, round(median(p_size), 6) AS p_size FROM part GROUP BY 1""")
def viz4_bar_median_null(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    lowest = part.agg(F.min("p_type")).first()[0]
    rows = part.withColumn("p_type", F.nullif(F.col("p_type"), F.lit(lowest)))
    return round_all(charts.bar(rows, "p_type", "p_size", "median"))


@register("viz4_bar_mean", """
SELECT o_orderpriority, round(avg(o_totalprice), 4) AS o_totalprice FROM orders GROUP BY 1""")
def viz4_bar_mean(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(charts.bar(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice", "mean"), 4)


@register("viz4_bar_median", """
SELECT p_type, round(median(p_retailprice), 6) AS p_retailprice FROM part GROUP BY 1""")
def viz4_bar_median(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(charts.bar(table(spark, sf, "part"), "p_type", "p_retailprice", "median"))


@register("viz4_bar_std", """
SELECT p_brand, round(stddev_samp(p_size), 6) AS p_size FROM part GROUP BY 1""")
def viz4_bar_std(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(charts.bar(table(spark, sf, "part"), "p_brand", "p_size", "std"))


@register("viz5_bar_interval", """
SELECT c_mktsegment, round(avg(c_acctbal), 6) AS mean, count(*) AS n, round(stddev_samp(c_acctbal), 6) AS std,
  round(avg(c_acctbal) - 1.96 * stddev_samp(c_acctbal) / sqrt(count(*)), 6) AS ci_low,
  round(avg(c_acctbal) + 1.96 * stddev_samp(c_acctbal) / sqrt(count(*)), 6) AS ci_high
FROM customer GROUP BY 1""")
def viz5_bar_interval(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(charts.bar_interval(table(spark, sf, "customer"), "c_mktsegment", "c_acctbal"))


def _box_sql(col: str, tbl: str) -> str:
    return f"""SELECT '{col}' AS variable, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
  round(min(CASE WHEN {col} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN {col} END), 6) AS whisker_low,
  round(max(CASE WHEN {col} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN {col} END), 6) AS whisker_high,
  CAST(sum(CASE WHEN {col} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers,
  count(*) AS n
FROM {tbl}, (SELECT quantile_cont({col}, 0.25) AS q1, quantile_cont({col}, 0.5) AS med,
                    quantile_cont({col}, 0.75) AS q3 FROM {tbl}) WHERE {col} IS NOT NULL
GROUP BY q1, med, q3"""


@register("viz6_box", _box_sql("o_totalprice", "orders"))
def viz6_box(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(charts.box(table(spark, sf, "orders"), "o_totalprice"))


@register("viz7_box_many_columns", " UNION ALL ".join(
    _box_sql(c, "lineitem") for c in ("l_quantity", "l_discount", "l_tax")))
def viz7_box_many(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(charts.box_many(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"]))


HEAT = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@register("viz8_heatmap_correlation", " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, "
    + ("max(1.0)" if a == b else f"round(corr({a}, {b}), 6)") + " AS corr FROM lineitem"
    for a in HEAT for b in HEAT))
def viz8_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(charts.correlation_matrix(table(spark, sf, "lineitem"), list(HEAT)))


@register("viz9_pie_counts", """
SELECT c_mktsegment AS category, CAST(count(*) AS DOUBLE) AS value,
  round(100.0 * count(*) / (SELECT count(*) FROM customer), 1) AS share_pct
FROM customer GROUP BY 1""")
def viz9_pie(spark: SparkSession, sf: str) -> DataFrame:
    return charts.pie(table(spark, sf, "customer"), "c_mktsegment")


@register("viz10_pie_values", """
SELECT o_orderstatus AS category, round(sum(o_totalprice), 2) AS value,
  round(100.0 * sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders), 1) AS share_pct
FROM orders GROUP BY 1""")
def viz10_pie_values(spark: SparkSession, sf: str) -> DataFrame:
    p = charts.pie(table(spark, sf, "orders"), "o_orderstatus", "o_totalprice")
    return p.select("category", F.round("value", 2).alias("value"), "share_pct")


@register("viz11_line_long", """
SELECT event_id, 'value' AS series, value FROM events""")
def viz11_line(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return charts.line(e, "event_id", ["value"])


@register("viz11_line_hourly", """
SELECT date_trunc('hour', ts) AS ts, 'value' AS series, round(avg(value), 6) AS value FROM events GROUP BY 1""")
def viz11_line_hourly(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    out = charts.line(e, "ts", ["value"], time_bucket="hour")
    return out.select(F.col("ts").cast("timestamp_ntz").alias("ts"), "series", F.round("value", 6).alias("value"))


@register("viz12_category_count",
          "SELECT count(DISTINCT p_type) AS n_unique, count(DISTINCT p_type) > 5 AS rotate_labels FROM part")
def viz12_category_count(spark: SparkSession, sf: str) -> DataFrame:
    return charts.category_count(table(spark, sf, "part"), "p_type")


def _confusion_sql(src: str) -> str:
    return f"""WITH s AS ({src}), c AS (SELECT label AS c FROM s UNION SELECT prediction FROM s)
SELECT a.c AS label, b.c AS prediction, count(s.label) AS count
FROM c a CROSS JOIN c b LEFT JOIN s ON s.label = a.c AND s.prediction = b.c GROUP BY 1, 2"""


@register("viz13_confusion_matrix", _confusion_sql(DOCS_SQL))
def viz13_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return charts.confusion_matrix(scored_documents(spark, sf))


ONE_SIDED = "CASE WHEN l_returnflag = 'A' THEN 'N' ELSE l_returnflag END"


@register("viz13_confusion_zero_cells", _confusion_sql(f"SELECT l_returnflag AS label, {ONE_SIDED} AS prediction FROM lineitem"))
def viz13_zero_cells(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("label"), F.expr(ONE_SIDED).alias("prediction"))
    return charts.confusion_matrix(li)


_CUM = f"""WITH s AS ({DOCS_SQL}),
t AS (SELECT score AS threshold, CAST(sum(CASE WHEN label > 0 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
             CAST(sum(CASE WHEN label > 0 THEN 0 ELSE 1 END) AS BIGINT) AS fp FROM s GROUP BY 1),
c AS (SELECT threshold, tp, fp, CAST(sum(tp) OVER (ORDER BY threshold DESC) AS BIGINT) AS cum_tp,
             CAST(sum(fp) OVER (ORDER BY threshold DESC) AS BIGINT) AS cum_fp,
             sum(tp) OVER () AS p, sum(fp) OVER () AS n FROM t)"""


@register("viz14_roc_curve", _CUM + """
SELECT round(threshold, 9) AS threshold, round(cum_tp / p, 9) AS tpr, round(cum_fp / n, 9) AS fpr, tp, fp,
  cum_tp, cum_fp FROM c UNION ALL SELECT NULL, 0, 0, 0, 0, 0, 0""")
def viz14_roc(spark: SparkSession, sf: str) -> DataFrame:
    r = charts.roc_curve(scored_documents(spark, sf))
    return round_all(r, 9)


@register("viz14_roc_auc", _CUM + """,
r AS (SELECT cum_fp / n AS fpr, cum_tp / p AS tpr, threshold FROM c)
SELECT round(sum((fpr - coalesce(pf, 0)) * (tpr + coalesce(pt, 0)) / 2), 9) AS auc
FROM (SELECT fpr, tpr, lag(fpr) OVER (ORDER BY threshold DESC) AS pf,
             lag(tpr) OVER (ORDER BY threshold DESC) AS pt FROM r)""")
def viz14_auc(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(charts.roc_auc(scored_documents(spark, sf)), 9)


@register("viz15_precision_recall_curve", _CUM + """
SELECT round(threshold, 9) AS threshold, round(cum_tp / (cum_tp + cum_fp), 9) AS precision,
  round(cum_tp / p, 9) AS recall FROM c UNION ALL SELECT NULL, 1, 0""")
def viz15_pr(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(charts.pr_curve(scored_documents(spark, sf)), 9)


@register("viz15_average_precision", _CUM + """
SELECT round(sum((rec - coalesce(pr, 0)) * prec), 9) AS average_precision
FROM (SELECT cum_tp / p AS rec, cum_tp / (cum_tp + cum_fp) AS prec,
             lag(cum_tp / p) OVER (ORDER BY threshold DESC) AS pr FROM c)""")
def viz15_ap(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(charts.average_precision(scored_documents(spark, sf)), 9)


@register("viz17_residuals", f"""
SELECT {REG_PRED} AS prediction, l_extendedprice - ({REG_PRED}) AS residual FROM lineitem""")
def viz17_residuals(spark: SparkSession, sf: str) -> DataFrame:
    return charts.residuals(scored_lineitem(spark, sf))


@register("viz18_residual_trend", f"""
WITH r AS (SELECT {REG_PRED} AS p, l_extendedprice - ({REG_PRED}) AS e FROM lineitem),
g AS (SELECT regr_slope(e, p) AS slope, regr_intercept(e, p) AS intercept, min(p) AS x0, max(p) AS x1 FROM r)
SELECT round(slope, 6) AS slope, round(intercept, 4) AS intercept, round(x0, 6) AS x0,
  round(intercept + slope * x0, 4) AS y0, round(x1, 6) AS x1, round(intercept + slope * x1, 4) AS y1 FROM g""")
def viz18_trend(spark: SparkSession, sf: str) -> DataFrame:
    t = charts.residual_trend(scored_lineitem(spark, sf))
    return t.select(F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"),
                    F.round("x0", 6).alias("x0"), F.round("y0", 4).alias("y0"),
                    F.round("x1", 6).alias("x1"), F.round("y1", 4).alias("y1"))


@register("viz3_scatter_all_points", "SELECT p_size AS x, p_retailprice AS y FROM part")
def viz3_scatter_all(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_size").alias("x"), F.col("p_retailprice").alias("y"))
    return charts.scatter(p, "x", "y")


@register("viz4_bar_count_by_segment", """
SELECT c_mktsegment, count(c_custkey) AS c_custkey FROM customer GROUP BY 1""")
def viz4_bar_count(spark: SparkSession, sf: str) -> DataFrame:
    return charts.bar(table(spark, sf, "customer"), "c_mktsegment", "c_custkey", "count")
