"""Registered queries: profiles of growing datasets, table-backed codes,
out-of-fold codes, binned densities.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprep.functions.exprs import HASH_MOD, round_all, split_hash, split_hash_sql
from sparkprep.functions.stats import exact_quantiles_multi
from sparkprep.operators import charts, clean, table_encoder
from sparkprep.plans.registry import register, table
from sparkprep.session import scratch_path
from sparkprep.sources import profiles

_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_FEW = ("l_linenumber", "l_returnflag", "l_linestatus")


def _stored_lineitem(spark: SparkSession, sf: str) -> str:
    """States of lineitem in three parts, the last one appended twice (a replay)."""
    path = scratch_path(spark, "profiles")
    li = table(spark, sf, "lineitem").select(*_FEW, *_COLUMNS, split_hash("l_orderkey").alias("h"))
    cuts = (0, HASH_MOD // 2, HASH_MOD // 4 * 3, HASH_MOD)
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        rows = li.where((F.col("h") >= a) & (F.col("h") < b)).drop("h")
        for _ in range(1 + (i == 2)):
            profiles.write_part(rows, path, "lineitem", f"batch {i}")
    return path


@register("prv5_profile_of_parts", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS non_null, count(DISTINCT {c}) AS \"distinct\", "
    f"(SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM lineitem ORDER BY v LIMIT 3)) AS sample_values "
    "FROM lineitem" for c in _FEW))
def prv5_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct counts of few values are exact in the sketch."""
    out = profiles.stored_profile(spark, _stored_lineitem(spark, sf), "lineitem").where(F.col("column").isin(*_FEW))
    return out.select("column", "non_null", "distinct", F.concat_ws("|", "sample_values").alias("sample_values"))


@register("prv6_summary_of_parts", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 6) AS mean, round(min({c}), 6) AS min, round(max({c}), 6) AS max, "
    f"round(stddev_samp({c}), 6) AS std, true AS median_in_range FROM lineitem" for c in _COLUMNS))
def prv6_parts(spark: SparkSession, sf: str) -> DataFrame:
    """The sketch's median lies between the values at ranks 0.49 and 0.51."""
    s = profiles.stored_summary(spark, _stored_lineitem(spark, sf), "lineitem").where(F.col("column").isin(*_COLUMNS))
    li = table(spark, sf, "lineitem")
    e = profiles.RANK_ERROR
    sides = exact_quantiles_multi(li, {c: [0.5 - e, 0.5 + e] for c in _COLUMNS})
    bounds = spark.createDataFrame([(c, *sides[c]) for c in _COLUMNS], "column string, a double, b double")
    out = s.join(bounds, "column")
    return round_all(out.select("column", "count", "mean", "min", "max", "std", F.col("median").between(F.col("a"), F.col("b")).alias("median_in_range")))


@register("enc1_table_indexer", f"""WITH known AS (
  SELECT c_name, CAST(row_number() OVER (ORDER BY c_name) - 1 AS DOUBLE) AS code FROM customer WHERE {split_hash_sql('c_custkey')} < {HASH_MOD // 2})
SELECT c_custkey, coalesce(code, (SELECT count(*) FROM known)) AS code, known.c_name AS decoded FROM customer LEFT JOIN known USING (c_name)""")
def enc1_table(spark: SparkSession, sf: str) -> DataFrame:
    """Fitted on half of the customers, saved and loaded in a pipeline; the others' names are unseen."""
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    fitted = Pipeline(stages=[table_encoder.TableIndexer("c_name", "code")]).fit(c.where(split_hash("c_custkey") < HASH_MOD // 2))
    path = scratch_path(spark, "encoder")
    fitted.write().save(path)
    model = PipelineModel.load(path)
    return model.stages[0].decode(model.transform(c), "code", "decoded").select("c_custkey", "code", "decoded")


@register("cln9_target_encoding_folds", f"""WITH o AS (
  SELECT o_orderkey, o_orderpriority AS c, o_totalprice AS y, CAST(floor({split_hash_sql('o_orderkey')} * 5 / {HASH_MOD}) AS INTEGER) AS fold FROM orders),
g AS (SELECT k.range AS fold, avg(y) AS m FROM o, range(5) k WHERE o.fold <> k.range GROUP BY 1),
r AS (SELECT k.range AS fold, c, sum(y) AS s, count(y) AS n FROM o, range(5) k WHERE o.fold <> k.range GROUP BY 1, 2)
SELECT o_orderkey, round(coalesce((r.s + 10.0 * g.m) / (r.n + 10.0), g.m), 4) AS o_orderpriority_te
FROM o JOIN g ON g.fold = o.fold LEFT JOIN r ON r.fold = o.fold AND r.c IS NOT DISTINCT FROM o.c""")
def cln9_folds(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    out, _ = clean.target_encode_folds(o, "o_orderpriority", "o_totalprice", "o_orderkey")
    return round_all(out.select("o_orderkey", "o_orderpriority_te"), 4)


@register("viz2_kde_binned", f"""WITH s AS (SELECT count(l_extendedprice) AS n, min(l_extendedprice) AS mn, max(l_extendedprice) AS mx,
                  stddev_samp(l_extendedprice) AS sd FROM lineitem),
p AS (SELECT n, mn, mx, sd * pow(n, -0.2) AS h FROM s),
g AS (SELECT n, mn, h, h / {charts.KDE_CELLS} AS w, mn - 3.0 * h AS glo, (mx + 3.0 * h - (mn - 3.0 * h)) / 199 AS gstep FROM p),
a AS (SELECT floor((l_extendedprice - mn) / w) AS k, (l_extendedprice - mn) / w - floor((l_extendedprice - mn) / w) AS part FROM lineitem, g),
c AS (SELECT k, sum(v) AS v FROM (SELECT k, 1 - part AS v FROM a UNION ALL SELECT k + 1, part FROM a) GROUP BY 1)
SELECT CAST(j.range AS INTEGER) AS grid_index, round(min(glo + j.range * gstep), 4) AS x,
  round(1e9 * sum(v * exp(-0.5 * pow((glo + j.range * gstep - (mn + k * w)) / h, 2)) / (n * h * sqrt(2 * pi()))), 4) AS density_e9
FROM c, g, range(200) j GROUP BY j.range""")
def viz2_binned(spark: SparkSession, sf: str) -> DataFrame:
    k = charts.kde_binned(table(spark, sf, "lineitem"), "l_extendedprice", 200)
    return k.select("grid_index", F.round("x", 4).alias("x"), F.round(F.col("density") * 1e9, 4).alias("density_e9"))
