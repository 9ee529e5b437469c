"""Chart data as small result tables (VIZ-1..19, IMP-6).

Nothing is drawn; each chart is the table a plotting layer would need.
Every table is produced by aggregates whose output size is bounded by the
chart (bins, grid points, categories, thresholds), not by the input.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep.functions.comoments import correlations
from sparkprep.functions.exprs import HASH_MOD, bin_index, finite_number, number, split_hash
from sparkprep.functions.materialize import materialize
from sparkprep.functions.ordinal import grouped_exact_quantiles, prefix_sums
from sparkprep.functions.stats import exact_quantiles_multi, one_row, quantiles

BAR_AGGS = {
    "mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max,
    "count": lambda c: F.count(c).cast("bigint"),
    "median": None,  # exact, via grouped_exact_quantiles (see bar)
    "approx_median": lambda c: F.percentile_approx(c, 0.5, 10000),
    "std": F.stddev_samp, "var": F.var_samp,
}


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """(bin, bin_start, bin_end, count): equal width, last bin closed, empty bins kept.
    Null, NaN and infinite values take no part."""
    x = finite_number(column)
    s = one_row(df, {"mn": F.min(x), "mx": F.max(x)})
    lo, hi = s["mn"], s["mx"]
    spark = df.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bin int, bin_start double, bin_end double, count bigint")
    b = bin_index(x, lo, hi, bins).cast("int")
    counts = (df.where(x.isNotNull()).groupBy(b.alias("bin"))
              .agg(F.count(F.lit(1)).alias("count")))
    step = (hi - lo) / bins
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    start = F.lit(lo) + F.col("bin").cast("double") * F.lit(step)
    end = F.when(F.col("bin") == bins - 1, F.lit(hi)).otherwise(
        F.lit(lo) + (F.col("bin") + 1).cast("double") * F.lit(step))
    return (grid.join(F.broadcast(counts), "bin", "left")
            .select("bin", start.alias("bin_start"), end.alias("bin_end"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count")))


KDE_CELLS = 64           # cells a bandwidth
KDE_REACH = 9.0          # bandwidths beyond which a kernel is under 1e-17 of its height


def kde_binned(df: DataFrame, column: str, grid_points: int = 200, cells: int = KDE_CELLS, bandwidth: float | None = None,
               cut: float = 3.0) -> DataFrame:
    """(grid_index, x, density) as ``kde``, with work bounded by cells, not by values.

    Every value's weight is split linearly between the two nearest nodes of a
    fine grid (``cells`` a bandwidth h); the nodes' sums are then met with the
    kernel, each node with the grid points in reach.  Linear interpolation of the
    kernel errs by at most an eighth of the squared node distance times its
    largest second derivative, so the density errs by at most
    phi(0) / (8 * cells**2 * h), phi(0) = 0.3989: 0.000012 / h by default.
    """
    x = finite_number(column)
    s = one_row(df, {"n": F.count(x), "mn": F.min(x), "mx": F.max(x), "sd": F.stddev_samp(x)})
    spark = df.sparkSession
    n, lo, hi, sd = s["n"], s["mn"], s["mx"], s["sd"]
    if not n or sd is None or sd == 0.0 or hi == lo:
        return spark.createDataFrame([], "grid_index int, x double, density double")
    h = bandwidth or sd * n ** (-0.2)
    glo, ghi = lo - cut * h, hi + cut * h
    gstep, width = (ghi - glo) / (grid_points - 1), h / cells
    at = (x - F.lit(lo)) / F.lit(width)
    node = F.floor(at)
    parts = df.where(x.isNotNull()).select(node.alias("node"), (at - node).alias("w"))
    # both shares of a cell are sums over its values, so each cell is one row
    sums = parts.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))
    ends = F.array(F.struct("node", (F.col("n") - F.col("w")).alias("w")), F.struct((F.col("node") + 1).alias("node"), "w"))
    nodes = sums.select(F.explode(ends).alias("e")).select("e.node", "e.w").groupBy("node").agg(F.sum("w").alias("w"))
    v = F.lit(lo) + F.col("node").cast("double") * F.lit(width)
    first = F.greatest(F.lit(0), F.ceil((v - F.lit(KDE_REACH * h + glo)) / F.lit(gstep)).cast("int"))
    last = F.least(F.lit(grid_points - 1), F.floor((v + F.lit(KDE_REACH * h - glo)) / F.lit(gstep)).cast("int"))
    met = nodes.where(first <= last).select("w", v.alias("v"), F.explode(F.sequence(first, last)).alias("grid_index"))
    gx = F.lit(glo) + F.col("grid_index").cast("double") * F.lit(gstep)
    z = (gx - F.col("v")) / F.lit(h)
    dens = met.groupBy("grid_index").agg(F.sum(F.col("w") * F.exp(F.lit(-0.5) * z * z)).alias("w"))
    grid = spark.range(grid_points).select(F.col("id").cast("int").alias("grid_index"))
    norm = 1.0 / (n * h * math.sqrt(2 * math.pi))
    return (grid.join(F.broadcast(dens), "grid_index", "left")
            .select("grid_index", gx.alias("x"), (F.coalesce("w", F.lit(0.0)) * F.lit(norm)).alias("density")))


def kde(df: DataFrame, column: str, grid_points: int = 200, cell_width: float | None = None,
        bandwidth: float | None = None, cut: float = 3.0) -> DataFrame:
    """(grid_index, x, density) of a Gaussian KDE evaluated on a grid.

    Distinct values are counted first (one partial + final aggregate), then
    every value adds to every grid point.  ``cell_width`` first rounds values to
    the centres of cells of that width; the density then errs by at most
    cell_width / (2 h) * 0.25 / h, h being the bandwidth.  Bandwidth: Scott's
    rule sigma * n^(-1/5); grid spans min - cut*h to max + cut*h.
    """
    x = finite_number(column)
    s = one_row(df, {"n": F.count(x), "mn": F.min(x), "mx": F.max(x), "sd": F.stddev_samp(x)})
    spark = df.sparkSession
    n, lo, hi, sd = s["n"], s["mn"], s["mx"], s["sd"]
    if not n or sd is None or sd == 0.0 or hi == lo:
        return spark.createDataFrame([], "grid_index int, x double, density double")
    h = bandwidth or sd * n ** (-0.2)
    glo, ghi = lo - cut * h, hi + cut * h
    gstep = (ghi - glo) / (grid_points - 1)
    value = x if cell_width is None else (F.floor(x / F.lit(float(cell_width))) + F.lit(0.5)) * F.lit(float(cell_width))
    counts = df.where(x.isNotNull()).groupBy(value.alias("v")).agg(F.count(F.lit(1)).alias("cnt"))
    spread = counts.select("cnt", "v", F.explode(F.sequence(F.lit(0), F.lit(grid_points - 1))).alias("grid_index"))
    gx = F.lit(glo) + F.col("grid_index").cast("double") * F.lit(gstep)
    z = (gx - F.col("v")) / F.lit(h)
    dens = spread.groupBy("grid_index").agg(F.sum(F.col("cnt") * F.exp(F.lit(-0.5) * z * z)).alias("w"))
    norm = 1.0 / (n * h * math.sqrt(2 * math.pi))
    return dens.select("grid_index", gx.alias("x"), (F.col("w") * F.lit(norm)).alias("density"))


def scatter(df: DataFrame, x: str, y: str, hue: str | None = None, key: str | None = None,
            fraction: float | None = None, seed: int = 42) -> DataFrame:
    """(x, y[, hue]) points: all of them, or a stable hash sample of ``fraction``."""
    cols = [x, y] + ([hue] if hue else [])
    out = df.select(*cols, *([key] if key and key not in cols else []))
    if fraction is not None:
        h = split_hash(key, seed) if key else F.pmod(F.xxhash64(*cols), F.lit(HASH_MOD))
        out = out.where(h < F.lit(int(fraction * HASH_MOD)))
    return out.select(*cols)


def bar(df: DataFrame, x: str, y: str, aggfunc: str = "mean") -> DataFrame:
    """(x, y) with y aggregated per category by ``aggfunc``.

    ``median`` is exact and skew-proof (global ordinal, no per-group value
    map); ``approx_median`` is a bounded-memory sketch per group.
    """
    if aggfunc not in BAR_AGGS:
        raise ValueError(f"Unsupported aggfunc: {aggfunc}")
    if aggfunc == "median":
        return grouped_exact_quantiles(df, [x], y, [0.5]).withColumnRenamed("q0", y).select(x, y)
    return df.groupBy(x).agg(BAR_AGGS[aggfunc](F.col(y)).alias(y))


def bar_interval(df: DataFrame, x: str, y: str, z: float = 1.96) -> DataFrame:
    """(x, mean, n, std, ci_low, ci_high) with an analytic normal interval."""
    g = df.where(F.col(y).isNotNull()).groupBy(x).agg(
        F.avg(y).alias("mean"), F.count(F.lit(1)).alias("n"), F.stddev_samp(y).alias("std"))
    half = F.lit(z) * F.col("std") / F.sqrt(F.col("n").cast("double"))
    return g.select(x, "mean", "n", "std", (F.col("mean") - half).alias("ci_low"),
                    (F.col("mean") + half).alias("ci_high"))


def box(df: DataFrame, column: str, whis: float = 1.5, exact: bool = True,
        variable: str | None = None) -> DataFrame:
    """One row: q1, median, q3, whiskers (extreme values inside whis*IQR), outliers."""
    q1, med, q3 = quantiles(df, column, [0.25, 0.5, 0.75], exact=exact)
    x = number(column)
    name = F.lit(variable or column)
    if q1 is None:
        return df.agg(name.alias("variable")).select(
            "variable", *[F.lit(None).cast("double").alias(c) for c in
                          ("q1", "median", "q3", "whisker_low", "whisker_high")],
            F.lit(0).cast("bigint").alias("n_outliers"), F.lit(0).cast("bigint").alias("n"))
    iqr = q3 - q1
    flo, fhi = q1 - whis * iqr, q3 + whis * iqr
    inside = (x >= F.lit(flo)) & (x <= F.lit(fhi))
    return df.where(x.isNotNull()).agg(
        name.alias("variable"), F.lit(q1).alias("q1"), F.lit(med).alias("median"), F.lit(q3).alias("q3"),
        F.min(F.when(inside, x)).alias("whisker_low"), F.max(F.when(inside, x)).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(1)).cast("bigint").alias("n_outliers"),
        F.count(F.lit(1)).alias("n"))


def box_many(df: DataFrame, columns: Sequence[str], whis: float = 1.5, exact: bool = True) -> DataFrame:
    """``box`` for several columns in long form (variable, ...): one quantile
    pass for all columns and one aggregate for whiskers and outliers."""
    cols = list(columns)
    if exact:
        qs = exact_quantiles_multi(df, {c: [0.25, 0.5, 0.75] for c in cols})
    else:
        qs = {c: quantiles(df, c, [0.25, 0.5, 0.75], exact=False) for c in cols}
    aggs, structs = [], []
    for i, c in enumerate(cols):
        q1, med, q3 = qs[c]
        x = number(c)
        if q1 is None:
            inside = F.lit(False)
        else:
            iqr = q3 - q1
            inside = (x >= F.lit(q1 - whis * iqr)) & (x <= F.lit(q3 + whis * iqr))
        aggs += [F.min(F.when(inside, x)).alias(f"wl{i}"), F.max(F.when(inside, x)).alias(f"wh{i}"),
                 F.sum(F.when(x.isNull(), 0).when(inside, 0).otherwise(1)).cast("bigint").alias(f"o{i}"),
                 F.count(x).alias(f"n{i}")]
        structs.append(F.struct(F.lit(c).alias("variable"), F.lit(q1).cast("double").alias("q1"),
                                F.lit(med).cast("double").alias("median"), F.lit(q3).cast("double").alias("q3"),
                                F.col(f"wl{i}").alias("whisker_low"), F.col(f"wh{i}").alias("whisker_high"),
                                F.coalesce(F.col(f"o{i}"), F.lit(0).cast("bigint")).alias("n_outliers"),
                                F.col(f"n{i}").alias("n")))
    return df.agg(*aggs).select(F.explode(F.array(*structs)).alias("s")).select("s.*")


WIDE = 24


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(col_a, col_b, corr) Pearson, pairwise-complete, full symmetric matrix.
    More than ``WIDE`` columns go through block states, not one expression a pair."""
    cols = list(columns)
    if len(cols) > WIDE:
        return correlations(df, cols)
    exprs = {}
    for i in range(len(cols)):
        for j in range(i + 1, len(cols)):
            exprs[f"c_{i}_{j}"] = F.corr(number(cols[i]), number(cols[j]))
    one = df.agg(*[e.alias(k) for k, e in exprs.items()]) if exprs else df.limit(1).select()
    entries = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if i == j:
                v = F.lit(1.0)
            else:
                lo_, hi_ = min(i, j), max(i, j)
                v = F.col(f"c_{lo_}_{hi_}")
            entries.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), v.alias("corr")))
    return one.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def pie(df: DataFrame, column: str, values: str | None = None) -> DataFrame:
    """(category, value, share_pct): counts (or sums of ``values``) and % to 1 decimal."""
    if values is None:
        g = df.groupBy(F.col(column).alias("category")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    else:
        g = df.groupBy(F.col(column).alias("category")).agg(F.sum(F.col(values).cast("double")).alias("value"))
    total = one_row(g, {"t": F.sum("value")})["t"] or 0.0
    share = F.round(F.lit(100.0) * F.try_divide(F.col("value"), F.lit(total)), 1)
    return g.select("category", "value", share.alias("share_pct"))


def line(df: DataFrame, x: str, ys: Sequence[str], time_bucket: str | None = None) -> DataFrame:
    """(x, series, value) long form sorted by x; optional time-bucket means."""
    data = df.select(x, *ys)
    if time_bucket:
        data = data.groupBy(F.date_trunc(time_bucket, F.col(x)).alias(x)).agg(
            *[F.avg(c).alias(c) for c in ys])
    long = data.unpivot(x, list(ys), "series", "value")
    return long.orderBy(x, "series")


def category_count(df: DataFrame, column: str, rotate_over: int = 5) -> DataFrame:
    return df.agg(F.countDistinct(column).alias("n_unique")).select(
        "n_unique", (F.col("n_unique") > rotate_over).alias("rotate_labels"))


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(label, prediction, count), zero cells included: every class seen as a
    label or a prediction against every such class."""
    cells = materialize(df.where(F.col(label).isNotNull() & F.col(prediction).isNotNull())
                        .groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction"))
                        .agg(F.count(F.lit(1)).alias("count")), "cells")
    names = cells.select(F.explode(F.array("label", "prediction")).alias("c")).distinct()
    every = names.agg(F.collect_set("c").alias("all"))  # classes only
    grid = (every.select(F.explode("all").alias("label"), "all").select("label", F.explode("all").alias("prediction")))
    return grid.join(cells, ["label", "prediction"], "left").select(
        "label", "prediction", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


def _threshold_table(df: DataFrame, label: str, score: str, buckets: int | None) -> DataFrame:
    s = F.col(score).cast("double")
    if buckets:
        s = F.floor(s * F.lit(buckets)) / F.lit(float(buckets))
    y = F.col(label).cast("double")
    g = (df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
         .groupBy(s.alias("threshold"))
         .agg(F.sum(F.when(y > 0, 1).otherwise(0)).cast("bigint").alias("tp"),
              F.sum(F.when(y > 0, 0).otherwise(1)).cast("bigint").alias("fp")))
    return prefix_sums(g, [F.desc("threshold")], ["tp", "fp"])


def _with_start(points: DataFrame, start: dict) -> DataFrame:
    """The curve's points and its start, which no row of the table stands for."""
    values = [F.lit(start.get(f.name)).cast(f.dataType).alias(f.name) for f in points.schema.fields]
    return points.unionByName(points.sparkSession.range(1).select(*values))


def roc_curve(df: DataFrame, label: str = "label", score: str = "score",
              buckets: int | None = None) -> DataFrame:
    """(threshold, tpr, fpr, tp, fp, cum_tp, cum_fp) per distinct score, from
    (0, 0), which no threshold reaches, on.

    Exact by default; ``buckets`` rounds scores down to a fixed grid first.
    """
    t = _threshold_table(df, label, score, buckets)
    tot = one_row(t, {"p": F.sum("tp"), "n": F.sum("fp")})
    p, n = float(tot["p"] or 0), float(tot["n"] or 0)
    points = t.select(F.col("threshold").cast("double").alias("threshold"), F.try_divide(F.col("cum_tp"), F.lit(p)).alias("tpr"),
                      F.try_divide(F.col("cum_fp"), F.lit(n)).alias("fpr"), "tp", "fp", "cum_tp", "cum_fp")
    return _with_start(points, {"tpr": 0.0, "fpr": 0.0, "tp": 0, "fp": 0, "cum_tp": 0, "cum_fp": 0})


def roc_auc(df: DataFrame, label: str = "label", score: str = "score",
            buckets: int | None = None) -> DataFrame:
    """Trapezoid AUC: sum fp_i * (2*cum_tp_i - tp_i) / (2*P*N) (no lag needed)."""
    t = _threshold_table(df, label, score, buckets)
    tp, fp, cum = (F.col(c).cast("double") for c in ("tp", "fp", "cum_tp"))  # products outgrow a bigint
    return t.agg(F.try_divide(F.sum(fp * (2.0 * cum - tp)), 2.0 * F.sum(tp) * F.sum(fp)).alias("auc"))


def pr_curve(df: DataFrame, label: str = "label", score: str = "score",
             buckets: int | None = None) -> DataFrame:
    """(threshold, precision, recall) per distinct score, and the end point
    (recall 0, precision 1), which no threshold reaches."""
    t = _threshold_table(df, label, score, buckets)
    p = float(one_row(t, {"p": F.sum("tp")})["p"] or 0)
    points = t.select(F.col("threshold").cast("double").alias("threshold"),
                      (F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp"))).alias("precision"),
                      F.try_divide(F.col("cum_tp"), F.lit(p)).alias("recall"))
    return _with_start(points, {"precision": 1.0, "recall": 0.0})


def average_precision(df: DataFrame, label: str = "label", score: str = "score",
                      buckets: int | None = None) -> DataFrame:
    """AP = sum (R_n - R_{n-1}) P_n = sum tp_i/P * cum_tp_i/(cum_tp_i+cum_fp_i)."""
    t = _threshold_table(df, label, score, buckets)
    tp, cum_tp, cum_fp = (F.col(c).cast("double") for c in ("tp", "cum_tp", "cum_fp"))
    return t.agg(F.try_divide(F.sum(tp * cum_tp / (cum_tp + cum_fp)), F.sum(tp)).alias("average_precision"))


def residuals(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.select(F.col(prediction).cast("double").alias("prediction"),
                     (F.col(label).cast("double") - F.col(prediction).cast("double")).alias("residual"))


def residual_trend(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Least-squares line of residual on prediction, with its end points."""
    r = residuals(df, label, prediction)
    g = r.agg(F.regr_slope("residual", "prediction").alias("slope"),
              F.regr_intercept("residual", "prediction").alias("intercept"),
              F.min("prediction").alias("x0"), F.max("prediction").alias("x1"))
    return g.select("slope", "intercept", "x0", (F.col("intercept") + F.col("slope") * F.col("x0")).alias("y0"),
                    "x1", (F.col("intercept") + F.col("slope") * F.col("x1")).alias("y1"))


def feature_importance_top(fitted, top: int = 10) -> DataFrame:  # noqa: ANN001
    from pyspark.sql import SparkSession
    return fitted.importance_frame(SparkSession.getActiveSession(), top=top)


MODEL_CHARTS = ("confusion", "roc", "pr", "importance", "residuals", "residual_trend")


def model_chart(fitted, df: DataFrame, kind: str) -> DataFrame:  # noqa: ANN001
    """Score ``df`` with a trained model and chart the result: confusion, roc and
    pr (binary: the second class against the first) of classifiers, residuals and
    residual_trend of regressors, importance of any."""
    if kind not in MODEL_CHARTS:
        raise ValueError(f"unknown model chart {kind!r}")
    if kind == "importance":
        return fitted.importance_frame(df.sparkSession)
    if (kind in ("residuals", "residual_trend")) != (fitted.problem == "regression"):
        raise ValueError(f"chart {kind} does not apply to a {fitted.problem} model")
    if kind in ("roc", "pr"):
        if fitted.meta.get("n_classes") != 2:
            raise ValueError(f"chart {kind} needs two classes")
        from pyspark.ml.functions import vector_to_array

        from sparkprep.operators.models import LABEL_COL
        scored = fitted.transform(df).select(F.col(LABEL_COL).alias("label"), vector_to_array("probability")[1].alias("score"))
        return roc_curve(scored) if kind == "roc" else pr_curve(scored)
    scored = fitted.predict(df.withColumn("__truth", F.col(fitted.target)), ["__truth"])
    if kind == "confusion":
        kind_of = scored.schema["prediction"].dataType
        return confusion_matrix(scored.withColumn("__truth", F.col("__truth").cast(kind_of)), "__truth", "prediction")
    return residuals(scored, "__truth") if kind == "residuals" else residual_trend(scored, "__truth")


def decision_boundary(fitted, df: DataFrame, f1: str, f2: str, grid: int = 50) -> DataFrame:  # noqa: ANN001
    """(x, y, prediction) over a grid spanning the data range of two features;
    other numeric features are held at their mean, string features at their
    smallest value."""
    from pyspark.sql.types import NumericType
    spark = df.sparkSession
    exprs = {"a0": F.min(F.col(f1).cast("double")), "a1": F.max(F.col(f1).cast("double")),
             "b0": F.min(F.col(f2).cast("double")), "b1": F.max(F.col(f2).cast("double"))}
    others = [c for c in fitted.features if c not in (f1, f2)]
    for i, c in enumerate(others):
        exprs[f"o{i}"] = F.avg(c) if isinstance(df.schema[c].dataType, NumericType) else F.min(c)
    s = one_row(df, exprs)
    ax = (s["a1"] - s["a0"]) / max(grid - 1, 1)
    bx = (s["b1"] - s["b0"]) / max(grid - 1, 1)
    g = spark.range(grid * grid)
    pts = g.select((F.lit(s["a0"]) + (F.col("id") % grid).cast("double") * F.lit(ax)).alias(f1),
                   (F.lit(s["b0"]) + F.floor(F.col("id") / grid).cast("double") * F.lit(bx)).alias(f2),
                   *[F.lit(s[f"o{i}"]).cast(df.schema[c].dataType).alias(c) for i, c in enumerate(others)])
    for c in (f1, f2):
        pts = pts.withColumn(c, F.col(c).cast(df.schema[c].dataType))
    return fitted.predict(pts, keep=[f1, f2])
