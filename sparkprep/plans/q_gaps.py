"""Registered queries: NaN as a missing value, and charts over many columns.

``gaps`` is lineitem with NaN prices on every third line and null prices on
every fifth; the oracle has null in both places, and -1 marks a NaN result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprep.functions.exprs import HASH_MOD, round_all, split_hash_sql
from sparkprep.operators import bootstrap, charts, clean, features, principal
from sparkprep.plans.registry import bins_sql, register, table

GAPS = """(SELECT l_orderkey, l_linenumber, l_discount, l_linenumber = 3 AS was_nan,
  CASE WHEN l_linenumber NOT IN (3, 5) THEN l_extendedprice END AS price FROM lineitem)"""


def gaps(spark: SparkSession, sf: str) -> DataFrame:
    line = F.col("l_linenumber")
    price = F.when(line == 3, F.lit(float("nan"))).when(line != 5, F.col("l_extendedprice"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", price.alias("price"))


def _marked(df: DataFrame, column: str) -> DataFrame:
    return df.select("l_orderkey", "l_linenumber", F.when(F.isnan(column), -1.0).otherwise(F.round(column, 6)).alias(column))


_SCALED = "SELECT l_orderkey, l_linenumber, CASE WHEN was_nan THEN -1.0 ELSE round({}, 6) END AS price_scaled FROM " + GAPS


@register("cln3_normalize_minmax_nan", _SCALED.format("(price - min(price) OVER ()) / (max(price) OVER () - min(price) OVER ())"))
def cln3_nan(spark: SparkSession, sf: str) -> DataFrame:
    return _marked(clean.normalize(gaps(spark, sf), ["price"], "minmax"), "price_scaled")


@register("cln4_normalize_zscore_nan", _SCALED.format("(price - avg(price) OVER ()) / stddev_samp(price) OVER ()"))
def cln4_nan(spark: SparkSession, sf: str) -> DataFrame:
    return _marked(clean.normalize(gaps(spark, sf), ["price"], "zscore"), "price_scaled")


@register("cln6_outlier_zscore_nan", f"""SELECT l_orderkey, l_linenumber FROM {GAPS} g,
  (SELECT avg(price) AS m, stddev_samp(price) AS s FROM {GAPS}) WHERE abs((price - m) / s) <= 1.5""")
def cln6_nan(spark: SparkSession, sf: str) -> DataFrame:
    return clean.outlier_removal(gaps(spark, sf), ["price"], "zscore", 1.5).select("l_orderkey", "l_linenumber")


@register("cln5_outlier_iqr_nan", f"""SELECT l_orderkey, l_linenumber FROM {GAPS} g,
  (SELECT quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.75) AS b FROM {GAPS})
  WHERE price BETWEEN a - 0.5 * (b - a) AND b + 0.5 * (b - a)""")
def cln5_nan(spark: SparkSession, sf: str) -> DataFrame:
    return clean.outlier_removal(gaps(spark, sf), ["price"], "iqr", 0.5).select("l_orderkey", "l_linenumber")


@register("fe2_binning_nan", f"""SELECT l_orderkey, l_linenumber, {bins_sql('price', 'mn', 'mx', 7)} AS price_binned
FROM {GAPS} g, (SELECT min(price) AS mn, max(price) AS mx FROM {GAPS})""")
def fe2_nan(spark: SparkSession, sf: str) -> DataFrame:
    return features.binning(gaps(spark, sf), "price", 7).select("l_orderkey", "l_linenumber", "price_binned")


@register("viz1_histogram_nan", f"""WITH g AS {GAPS}, s AS (SELECT min(price) AS mn, max(price) AS mx FROM g),
h AS (SELECT CAST({bins_sql('price', 'mn', 'mx', 20)} AS INTEGER) AS bin, count(*) AS n FROM g, s WHERE price IS NOT NULL GROUP BY 1)
SELECT CAST(b.range AS INTEGER) AS bin, round(mn + b.range * ((mx - mn) / 20), 6) AS bin_start,
  round(CASE WHEN b.range = 19 THEN mx ELSE mn + (b.range + 1) * ((mx - mn) / 20) END, 6) AS bin_end, coalesce(h.n, 0) AS count
FROM range(20) b LEFT JOIN h ON h.bin = b.range, s""")
def viz1_nan(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(charts.histogram(gaps(spark, sf), "price", 20))


_DISCOUNTS = "(SELECT CASE WHEN l_linenumber NOT IN (3, 5) THEN l_discount END AS v FROM lineitem)"


@register("viz2_kde_nan", f"""WITH s AS (SELECT count(v) AS n, min(v) AS mn, max(v) AS mx, stddev_samp(v) AS sd FROM {_DISCOUNTS}),
p AS (SELECT n, mn, mx, sd * pow(n, -0.2) AS h FROM s),
g AS (SELECT n, h, mn - 3.0 * h AS glo, (mx + 3.0 * h - (mn - 3.0 * h)) / 99 AS gstep FROM p),
c AS (SELECT v, count(*) AS k FROM {_DISCOUNTS} WHERE v IS NOT NULL GROUP BY 1)
SELECT CAST(j.range AS INTEGER) AS grid_index, round(min(glo + j.range * gstep), 6) AS x,
  round(sum(k * exp(-0.5 * pow((glo + j.range * gstep - v) / h, 2)) / (n * h * sqrt(2 * pi()))), 6) AS density
FROM c, g, range(100) j GROUP BY j.range""")
def viz2_nan(spark: SparkSession, sf: str) -> DataFrame:
    line = F.col("l_linenumber")
    value = F.when(line == 3, F.lit(float("nan"))).when(line != 5, F.col("l_discount"))
    return round_all(charts.kde(table(spark, sf, "lineitem").select(value.alias("v")), "v", 100))


@register("viz6_box_nan", f"""WITH g AS {GAPS}, q AS (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS med,
  quantile_cont(price, 0.75) AS q3 FROM g)
SELECT 'price' AS variable, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
  round(min(price) FILTER (price BETWEEN q1 - 0.5 * (q3 - q1) AND q3 + 0.5 * (q3 - q1)), 6) AS whisker_low,
  round(max(price) FILTER (price BETWEEN q1 - 0.5 * (q3 - q1) AND q3 + 0.5 * (q3 - q1)), 6) AS whisker_high,
  count(*) FILTER (price NOT BETWEEN q1 - 0.5 * (q3 - q1) AND q3 + 0.5 * (q3 - q1)) AS n_outliers, count(price) AS n
FROM g, q GROUP BY q1, med, q3""")
def viz6_nan(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(charts.box(gaps(spark, sf), "price", whis=0.5))


@register("viz7_box_many_nan", f"""WITH g AS {GAPS}, l AS (SELECT 'price' AS variable, price AS v FROM g UNION ALL SELECT 'l_discount', l_discount FROM g),
q AS (SELECT variable, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS med, quantile_cont(v, 0.75) AS q3 FROM l GROUP BY 1)
SELECT variable, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
  round(min(v) FILTER (v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_low,
  round(max(v) FILTER (v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
  count(*) FILTER (v NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_outliers, count(v) AS n
FROM l JOIN q USING (variable) GROUP BY variable, q1, med, q3""")
def viz7_nan(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(charts.box_many(gaps(spark, sf), ["price", "l_discount"]))


@register("viz8_heatmap_nan", f"""SELECT a.c AS col_a, b.c AS col_b,
  CASE WHEN a.c = b.c THEN 1.0 ELSE (SELECT round(corr(price, l_discount), 6) FROM {GAPS}) END AS corr
FROM (VALUES ('price'), ('l_discount')) a(c), (VALUES ('price'), ('l_discount')) b(c)""")
def viz8_nan(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(charts.correlation_matrix(gaps(spark, sf), ["price", "l_discount"]))


@register("viz8_heatmap_many_columns", """
WITH x AS (SELECT vec_id, unnest(range(0, 64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
y AS (SELECT vec_id, i, CASE WHEN (vec_id + i) % 11 <> 0 THEN v END AS v FROM x)
SELECT 'e' || a.i AS col_a, 'e' || b.i AS col_b, CASE WHEN a.i = b.i THEN 1.0 ELSE round(corr(a.v, b.v), 6) END AS corr
FROM y a JOIN y b USING (vec_id) GROUP BY a.i, b.i""")
def viz8_many(spark: SparkSession, sf: str) -> DataFrame:
    """64 columns, each with a gap in every eleventh row (null or NaN)."""
    def cell(i: int):  # noqa: ANN202
        gap = F.when(F.col("vec_id") % 2 == 0, F.lit(float("nan")))
        return F.when((F.col("vec_id") + i) % 11 != 0, F.col("embedding")[i].cast("double")).otherwise(gap).alias(f"e{i}")
    df = table(spark, sf, "embeddings").select(*[cell(i) for i in range(64)])
    return round_all(charts.correlation_matrix(df, df.columns))


REPLICATES = 100
#: Occurrences that a hash stands for: how many limits of the Poisson(1) distribution it reaches.
_DRAWN = " + ".join(f"CAST(h >= {limit} AS INTEGER)" for limit in bootstrap.poisson_limits())


@register("viz5_bar_bootstrap", f"""WITH r AS (
  SELECT c_mktsegment, c_acctbal, {split_hash_sql('c_custkey', 0).replace('+ 0)', '+ (42 + b.range) % ' + str(HASH_MOD) + ')')} AS h, b.range AS b
  FROM customer, range({REPLICATES}) b),
w AS (SELECT c_mktsegment, b, sum(({_DRAWN}) * c_acctbal) / sum({_DRAWN}) AS m FROM r GROUP BY 1, 2)
SELECT w.c_mktsegment, round(min(p.mean), 6) AS mean, min(p.n) AS n, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high
FROM w JOIN (SELECT c_mktsegment, avg(c_acctbal) AS mean, count(*) AS n FROM customer GROUP BY 1) p USING (c_mktsegment) GROUP BY 1""")
def viz5_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(bootstrap.bar_bootstrap(table(spark, sf, "customer"), "c_mktsegment", "c_acctbal", "c_custkey", REPLICATES))


_PCA = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _power_sql() -> str:
    """The two main directions of the four columns' covariance by power steps, the
    second after taking the first out."""
    pairs = [(a, b) for a in range(4) for b in range(4)]
    cov = ", ".join(f"covar_samp({_PCA[a]}, {_PCA[b]}) AS s{a}{b}" for a, b in pairs)

    def steps(name: str, src: str, start: str) -> str:
        image = ", ".join(" + ".join(f"s{a}{b} * v{b}" for b in range(4)) + f" AS w{a}" for a in range(4))
        norm = "sqrt(" + " + ".join(f"w{a} * w{a}" for a in range(4)) + ")"
        return (f"{name} AS (SELECT 0 AS k, {start} UNION ALL SELECT k + 1, " + ", ".join(f"w{a} / {norm} AS v{a}" for a in range(4))
                + f" FROM (SELECT k, {image} FROM {name}, {src} WHERE k < 60))")
    start = ", ".join(f"{x}::DOUBLE AS v{a}" for a, x in enumerate((0.5, 0.5, 0.5, 0.5)))
    value = " + ".join(f"v{a} * s{a}{b} * v{b}" for a, b in pairs)
    rest = ", ".join(f"s{a}{b} - value * v{a} * v{b} AS s{a}{b}" for a, b in pairs)
    rows = " UNION ALL ".join(f"SELECT {c} AS component, '{name}' AS feature, round(abs(v{a}), 6) AS loading, round(value, 4) AS variance, "
                              f"round(value / total, 8) AS ratio FROM top{c}, t" for c in (1, 2) for a, name in enumerate(_PCA))
    return f"""WITH RECURSIVE c AS (SELECT {cov} FROM lineitem), t AS (SELECT s00 + s11 + s22 + s33 AS total FROM c),
{steps('p1', 'c', start)}, top1 AS (SELECT p1.*, {value} AS value FROM p1, c WHERE k = 60),
c2 AS (SELECT {rest} FROM c, top1), {steps('p2', 'c2', start)}, top2 AS (SELECT p2.*, {value} AS value FROM p2, c2 WHERE k = 60)
{rows}"""


@register("fe9_pca_components", _power_sql())
def fe9_components(spark: SparkSession, sf: str) -> DataFrame:
    fitted = principal.fit(table(spark, sf, "lineitem"), list(_PCA), 2)
    rows = [(c + 1, name, round(abs(float(fitted.components[a, c])), 6), round(float(fitted.variances[c]), 4), round(float(fitted.ratios[c]), 8))
            for c in range(2) for a, name in enumerate(_PCA)]
    return spark.createDataFrame(rows, "component int, feature string, loading double, variance double, ratio double")
