"""Univariate feature scores and model importances (IMP-1..6, FE-10).

All scores come from small aggregated tables: numeric features are
unpivoted to (feature, value) rows, binned with per-feature equal-width
edges, and counted per (feature, bin, class) - a partial+final aggregate
whose output is bounded by features x bins x classes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from sparkprep.functions.exprs import bin_index, number
from sparkprep.functions.stats import one_row

METHODS = ("mutual_info", "chi2", "f_classif", "f_regression", "random_forest")


def _long(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """(feature, value, y) rows; nulls and NaN dropped per feature."""
    stack = df.select(F.col(target).alias("y"),
                      *[number(c).alias(c) for c in features])
    long = stack.unpivot("y", list(features), "feature", "value")
    return long.where(F.col("value").isNotNull() & F.col("y").isNotNull())


def _binned(df: DataFrame, features: Sequence[str], target: str, bins: int) -> DataFrame:
    exprs = {}
    for i, c in enumerate(features):
        exprs[f"mn{i}"] = F.min(number(c))
        exprs[f"mx{i}"] = F.max(number(c))
    s = one_row(df, exprs)
    long = _long(df, features, target)
    b = None
    for i, c in enumerate(features):
        e = bin_index(F.col("value"), s[f"mn{i}"], s[f"mx{i}"], bins)
        b = F.when(F.col("feature") == F.lit(c), e) if b is None else b.when(F.col("feature") == F.lit(c), e)
    return long.select("feature", b.alias("bin"), F.col("y").cast("string").alias("y"))


def contingency(df: DataFrame, features: Sequence[str], target: str, bins: int = 10) -> DataFrame:
    """(feature, bin, y, n, n_x, n_y, n_total) observed cells with margins.

    The data is scanned once into the cell counts; the margins are windows
    over that cell table, which is bounded by features x bins x classes.
    """
    from pyspark.sql import Window
    # counts are doubles: products such as n * n_total overflow 64-bit at scale
    cells = _binned(df, features, target, bins).groupBy("feature", "bin", "y").agg(
        F.count(F.lit(1)).cast("double").alias("n"))
    return cells.select(
        "*",
        F.sum("n").over(Window.partitionBy("feature", "bin")).alias("n_x"),
        F.sum("n").over(Window.partitionBy("feature", "y")).alias("n_y"),
        F.sum("n").over(Window.partitionBy("feature")).alias("n_total"))


def mutual_info(df: DataFrame, features: Sequence[str], target: str, bins: int = 10) -> DataFrame:
    """MI (natural log) between each binned feature and the class."""
    c = contingency(df, features, target, bins)
    term = (F.col("n") / F.col("n_total")) * F.log(
        (F.col("n") * F.col("n_total")) / (F.col("n_x") * F.col("n_y")))
    return c.groupBy("feature").agg(F.sum(term).alias("score"))


def chi2(df: DataFrame, features: Sequence[str], target: str, bins: int = 10) -> DataFrame:
    """Pearson chi-square of the (bin x class) table, zero cells included.

    sum over all cells (o-e)^2/e == sum over observed cells o^2/e - N, so
    empty cells never have to be materialised.
    """
    c = contingency(df, features, target, bins)
    term = F.col("n") * F.col("n") * F.col("n_total") / (F.col("n_x") * F.col("n_y"))
    return (c.groupBy("feature").agg(F.sum(term).alias("s"), F.first("n_total").alias("nt"))
            .select("feature", (F.col("s") - F.col("nt")).alias("score")))


def f_classif(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """One-way ANOVA F of each feature across the target classes.

    One group-by on the class with count, mean and population variance per
    feature (no raw squares, so large means do not cancel); the small class
    table is unpivoted and combined around the overall mean.
    """
    features = list(features)
    y = F.col(target)
    aggs = []
    for i, c in enumerate(features):
        x = number(c)
        aggs += [F.count(x).cast("double").alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}")]
    per = df.where(y.isNotNull()).groupBy(y.alias("y")).agg(*aggs)
    rows = per.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("m"), F.col(f"v{i}").alias("v"))
        for i, c in enumerate(features)])).alias("s")).select("s.*").where(F.col("n") > 0)
    mean = rows.groupBy("feature").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("centre"))
    apart = F.col("m") - F.col("centre")
    tot = rows.join(mean, "feature").groupBy("feature").agg(
        F.sum("n").alias("N"), F.count(F.lit(1)).alias("K"), F.sum(F.col("n") * F.col("v")).alias("within"),
        F.sum(F.col("n") * apart * apart).alias("between"))
    score = F.try_divide(F.try_divide(F.col("between"), F.col("K") - 1), F.try_divide(F.col("within"), F.col("N") - F.col("K")))
    return tot.select("feature", score.alias("score"))


def f_regression(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """F = r^2/(1-r^2)*(n-2) from the Pearson correlation with a numeric target;
    one aggregate for all features."""
    y = F.col(target).cast("double")
    aggs = []
    for i, c in enumerate(features):
        x = F.when(y.isNotNull(), F.col(c).cast("double"))
        aggs += [F.corr(x, y).alias(f"r{i}"), F.count(x).alias(f"n{i}")]
    g = df.agg(*aggs).select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"r{i}").alias("r"), F.col(f"n{i}").alias("n"))
        for i, c in enumerate(features)])).alias("s")).select("s.*").where(F.col("n") > 0)
    r2 = F.col("r") * F.col("r")
    return g.select("feature", (F.try_divide(r2, 1 - r2) * (F.col("n") - 2).cast("double")).alias("score"))


def rank_scores(scores: DataFrame) -> DataFrame:
    """Adds rank (1 = best) by score desc, feature asc (bounded: one row per feature)."""
    from pyspark.sql import Window
    w = Window.orderBy(F.desc_nulls_last("score"), F.asc("feature"))
    return scores.withColumn("rank", F.row_number().over(w))


def univariate_scores(df: DataFrame, features: Sequence[str], target: str,
                      method: str = "mutual_info", bins: int = 10) -> DataFrame:
    fns = {"mutual_info": lambda: mutual_info(df, features, target, bins),
           "chi2": lambda: chi2(df, features, target, bins),
           "f_classif": lambda: f_classif(df, features, target),
           "f_value": lambda: f_classif(df, features, target),
           "f_regression": lambda: f_regression(df, features, target)}
    if method not in fns:
        raise ValueError(f"Unknown scoring method: {method}")
    return rank_scores(fns[method]())


def feature_selection(df: DataFrame, features: Sequence[str], target: str,
                      method: str = "mutual_info", k: int = 10, bins: int = 10,
                      return_scores: bool = False) -> DataFrame:
    """Keep the ``k`` best features (plus the target).

    With ``return_scores`` the ranking table (feature, score, rank) of the
    selected features is returned instead.
    """
    ranked = univariate_scores(df, features, target, method, bins).where(F.col("rank") <= k)
    if return_scores:
        return ranked
    chosen = [r["feature"] for r in ranked.orderBy("rank").collect()]  # <= k names
    return df.select(*chosen, target)


def numeric_features(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in exclude]


def random_forest_importance(df: DataFrame, target: str, features: Sequence[str] | None = None,
                             num_trees: int = 10, max_depth: int = 5, seed: int = 42,
                             problem: str | None = None) -> DataFrame:
    """(feature, importance, rank) from a random forest (classifier for
    string/boolean/integer targets, regressor otherwise); string features
    and labels are indexed inside the fitted pipeline."""
    from sparkprep.operators.models import fit_pipeline, infer_problem
    problem = problem or infer_problem(df, target)
    model_type = "random_forest_classifier" if problem == "classification" else "random_forest_regressor"
    fitted = fit_pipeline(df, target, model_type, features,
                          {"numTrees": num_trees, "maxDepth": max_depth, "seed": seed})
    return fitted.importance_frame(df.sparkSession)
