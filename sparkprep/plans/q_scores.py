"""Registered queries: univariate feature scores and selection (IMP-2..5, FE-10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprep.operators import importance
from sparkprep.plans.registry import bins_sql, register, table

FEATS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _rank(score_sql: str, digits: int) -> str:
    return (f"SELECT feature, round(score, {digits}) AS score, "
            f"CAST(row_number() OVER (ORDER BY score DESC, feature ASC) AS INTEGER) AS rank FROM ({score_sql})")


def _cells_sql(feats=FEATS, target: str = "l_returnflag", bins: int = 10) -> str:  # noqa: ANN001
    stats = ", ".join(f"min({c}) AS mn_{c}, max({c}) AS mx_{c}" for c in feats)
    longs = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {bins_sql(c, 'mn_' + c, 'mx_' + c, bins)} AS bin, {target} AS y "
        f"FROM lineitem, s WHERE {c} IS NOT NULL" for c in feats)
    return f"""s AS (SELECT {stats} FROM lineitem),
cells AS (SELECT feature, bin, y, CAST(count(*) AS DOUBLE) AS n FROM ({longs}) GROUP BY feature, bin, y),
nx AS (SELECT feature, bin, sum(n) AS n_x FROM cells GROUP BY feature, bin),
ny AS (SELECT feature, y, sum(n) AS n_y FROM cells GROUP BY feature, y),
nt AS (SELECT feature, sum(n) AS n_total FROM cells GROUP BY feature),
c AS (SELECT cells.*, n_x, n_y, n_total FROM cells JOIN nx USING (feature, bin) JOIN ny USING (feature, y)
      JOIN nt USING (feature))"""


@register("imp2_mutual_info", f"WITH {_cells_sql()} " + _rank(
    "SELECT feature, sum((n / n_total) * ln((n * n_total) / (n_x * n_y))) AS score FROM c GROUP BY feature", 9))
def imp2_mutual_info(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    r = importance.univariate_scores(li, list(FEATS), "l_returnflag", "mutual_info", 10)
    return r.select("feature", F.round("score", 9).alias("score"), "rank")


@register("imp3_chi2", f"WITH {_cells_sql()} " + _rank(
    "SELECT feature, sum(n * n * n_total / (n_x * n_y)) - max(n_total) AS score FROM c GROUP BY feature", 6))
def imp3_chi2(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    r = importance.univariate_scores(li, list(FEATS), "l_returnflag", "chi2", 10)
    return r.select("feature", F.round("score", 6).alias("score"), "rank")


def _anova_sql(feats=FEATS, target: str = "l_returnflag") -> str:  # noqa: ANN001
    longs = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v, {target} AS y FROM lineitem "
                               f"WHERE {c} IS NOT NULL" for c in feats)
    return f"""WITH per AS (SELECT feature, y, CAST(count(*) AS DOUBLE) AS n, sum(v) AS s, sum(v * v) AS ss
            FROM ({longs}) GROUP BY feature, y),
tot AS (SELECT feature, sum(n) AS nn, sum(s) AS st, CAST(count(*) AS DOUBLE) AS k, sum(s * s / n) AS br, sum(ss) AS sst
        FROM per GROUP BY feature)
""" + _rank("SELECT feature, ((br - st * st / nn) / (k - 1)) / ((sst - br) / (nn - k)) AS score FROM tot", 6)


@register("imp4_f_classif", _anova_sql())
def imp4_f_classif(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    r = importance.univariate_scores(li, list(FEATS), "l_returnflag", "f_classif")
    return r.select("feature", F.round("score", 6).alias("score"), "rank")


@register("imp4_f_classif_large_means", f"SELECT feature, rank, round(score, 3) AS score FROM ({_anova_sql()})")
def imp4_shifted(spark: SparkSession, sf: str) -> DataFrame:
    """F does not change when every feature is shifted."""
    li = table(spark, sf, "lineitem")
    far = li.select("l_returnflag", *[(F.col(c) + F.lit(1e5)).alias(c) for c in FEATS])
    r = importance.univariate_scores(far, list(FEATS), "l_returnflag", "f_classif")
    return r.select("feature", F.round("score", 3).alias("score"), "rank")


REG_FEATS = ("l_quantity", "l_discount", "l_tax")


@register("imp5_f_regression", _rank(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, (corr({c}, l_extendedprice) * corr({c}, l_extendedprice)) / "
    f"(1 - corr({c}, l_extendedprice) * corr({c}, l_extendedprice)) * CAST(count(*) - 2 AS DOUBLE) AS score "
    f"FROM lineitem" for c in REG_FEATS), 4))
def imp5_f_regression(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    r = importance.univariate_scores(li, list(REG_FEATS), "l_extendedprice", "f_regression")
    return r.select("feature", F.round("score", 4).alias("score"), "rank")


@register("fe10_feature_selection_chi2_top2", f"SELECT * FROM (WITH {_cells_sql()} " + _rank(
    "SELECT feature, sum(n * n * n_total / (n_x * n_y)) - max(n_total) AS score FROM c GROUP BY feature", 6)
    + ") WHERE rank <= 2")
def fe10_feature_selection(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    r = importance.feature_selection(li, list(FEATS), "l_returnflag", "chi2", k=2, return_scores=True)
    return r.select("feature", F.round("score", 6).alias("score"), "rank")


@register("fe10_feature_selection_columns")
def fe10_feature_selection_columns(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return importance.feature_selection(li, list(FEATS), "l_returnflag", "f_classif", k=2)


DOCS_JOIN = "SELECT d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id"


def _doc_frame(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    return d.join(table(spark, sf, "labels"), "doc_id").select("n_chars", "quality", "toxic")


@register("imp2_mutual_info_documents_quality", f"""
WITH j AS ({DOCS_JOIN}),
s AS (SELECT min(n_chars) AS mn, max(n_chars) AS mx, min(toxic) AS tmn, max(toxic) AS tmx FROM j),
long AS (SELECT 'n_chars' AS feature, {bins_sql('n_chars', 'mn', 'mx', 10)} AS bin, CAST(quality AS VARCHAR) AS y FROM j, s
         UNION ALL
         SELECT 'toxic', {bins_sql('toxic', 'tmn', 'tmx', 10)}, CAST(quality AS VARCHAR) FROM j, s),
cells AS (SELECT feature, bin, y, CAST(count(*) AS DOUBLE) AS n FROM long GROUP BY feature, bin, y),
c AS (SELECT *, sum(n) OVER (PARTITION BY feature, bin) AS n_x, sum(n) OVER (PARTITION BY feature, y) AS n_y,
             sum(n) OVER (PARTITION BY feature) AS n_total FROM cells)
""" + _rank("SELECT feature, sum((n / n_total) * ln((n * n_total) / (n_x * n_y))) AS score FROM c GROUP BY feature", 9))
def imp2_mi_documents(spark: SparkSession, sf: str) -> DataFrame:
    r = importance.univariate_scores(_doc_frame(spark, sf), ["n_chars", "toxic"], "quality", "mutual_info", 10)
    return r.select("feature", F.round("score", 9).alias("score"), "rank")


@register("imp4_f_classif_documents_quality", """
WITH j AS (SELECT d.n_chars, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
per AS (SELECT quality AS y, CAST(count(*) AS DOUBLE) AS n, sum(CAST(n_chars AS DOUBLE)) AS s,
               sum(CAST(n_chars AS DOUBLE) * CAST(n_chars AS DOUBLE)) AS ss FROM j GROUP BY quality),
tot AS (SELECT 'n_chars' AS feature, sum(n) AS nn, sum(s) AS st, CAST(count(*) AS DOUBLE) AS k,
               sum(s * s / n) AS br, sum(ss) AS sst FROM per)
""" + _rank("SELECT feature, ((br - st * st / nn) / (k - 1)) / ((sst - br) / (nn - k)) AS score FROM tot", 6))
def imp4_f_documents(spark: SparkSession, sf: str) -> DataFrame:
    r = importance.univariate_scores(_doc_frame(spark, sf), ["n_chars"], "quality", "f_classif")
    return r.select("feature", F.round("score", 6).alias("score"), "rank")
