"""Cleaning operators (CLN-1..11).

Statistics an operator needs (min/max, mean/stddev, quartiles) are computed
by one distributed aggregate whose single result row is inlined as literals,
so the following filter or projection stays a plain Column expression that
Catalyst can push into the scan.  Multi-column outlier removal is
sequential by default: each column's bounds are computed on the rows kept
by the previous columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from sparkprep.functions.exprs import number, safe_name
from sparkprep.functions.joins import join_small
from sparkprep.functions.materialize import materialize
from sparkprep.functions.ordinal import dense_codes
from sparkprep.functions.stats import exact_quantiles_multi, one_row, quantiles

MAX_ONE_HOT_VALUES = 1000


def remove_nulls(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop rows holding a null in any of ``columns`` (all columns when empty)."""
    cols = list(columns or [])
    return df.dropna(how="any", subset=cols or None)


def fillna(df: DataFrame, value=0, columns: Sequence[str] | None = None) -> DataFrame:  # noqa: ANN001
    """Fill nulls; columns whose type does not match ``value`` are left alone."""
    cols = list(columns or [])
    return df.fillna(value, subset=cols or None)


def _numeric_check(df: DataFrame, columns: Sequence[str]) -> None:
    for c in columns:
        if c not in df.columns:
            raise ValueError(f"Column not found: {c}")
        if not isinstance(df.schema[c].dataType, NumericType):
            raise ValueError(f"Column {c} is not numeric")


def minmax_params(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple]:
    exprs: dict[str, Column] = {}
    for i, c in enumerate(columns):
        exprs[f"mn{i}"] = F.min(number(c))
        exprs[f"mx{i}"] = F.max(number(c))
    r = one_row(df, exprs)
    return {c: (r[f"mn{i}"], r[f"mx{i}"]) for i, c in enumerate(columns)}


def zscore_params(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple]:
    exprs: dict[str, Column] = {}
    for i, c in enumerate(columns):
        exprs[f"m{i}"] = F.avg(number(c))
        exprs[f"s{i}"] = F.stddev_samp(number(c))
    r = one_row(df, exprs)
    return {c: (r[f"m{i}"], r[f"s{i}"]) for i, c in enumerate(columns)}


def minmax_expr(c: str, mn: float | None, mx: float | None) -> Column:
    x = F.col(c).cast("double")
    if mn is None:
        return F.lit(None).cast("double")
    if mx == mn:  # constant column: MinMaxScaler maps it to the middle of [0, 1]
        return F.when(x.isNull() | F.isnan(x), x).otherwise(F.lit(0.5))
    return (x - F.lit(mn)) / F.lit(mx - mn)


def zscore_expr(c: str, mean: float | None, std: float | None, center: bool = True) -> Column:
    x = F.col(c).cast("double")
    if mean is None:
        return F.lit(None).cast("double")
    if std is None or std == 0.0:
        return F.when(x.isNull() | F.isnan(x), x).otherwise(F.lit(0.0))
    num = (x - F.lit(mean)) if center else x
    return num / F.lit(std)


def normalize(df: DataFrame, columns: Sequence[str], method: str = "minmax",
              center: bool = True, suffix: str = "_scaled", params: dict | None = None) -> DataFrame:
    """Scale columns into ``<c>_scaled``.

    minmax: (x-min)/(max-min), a constant column gives 0.5.
    zscore (any other method): (x-mean)/stddev_samp; ``center=False`` gives
    x/stddev (what a default StandardScaler computes).  Zero spread gives 0.
    NaN takes no part in the statistics and stays NaN.
    ``params`` ({column: (min, max) | (mean, std)}) skips the statistics job
    when the caller already computed them (fused operation lists).
    """
    columns = list(columns)
    _numeric_check(df, columns)
    if not columns:
        return df
    if method == "minmax":
        p = params or minmax_params(df, columns)
        new = [minmax_expr(c, *p[c]).alias(f"{c}{suffix}") for c in columns]
    else:
        p = params or zscore_params(df, columns)
        new = [zscore_expr(c, *p[c], center=center).alias(f"{c}{suffix}") for c in columns]
    keep = [F.col(c) for c in df.columns if c not in {f"{x}{suffix}" for x in columns}]
    return df.select(*keep, *new)


def iqr_bounds(df: DataFrame, c: str, threshold: float = 1.5, exact: bool = True):  # noqa: ANN201
    q1, q3 = quantiles(df, c, [0.25, 0.75], exact=exact)
    if q1 is None:
        return None, None
    iqr = q3 - q1
    return q1 - threshold * iqr, q3 + threshold * iqr


def outlier_removal(df: DataFrame, columns: Sequence[str], method: str = "iqr",
                    threshold: float = 1.5, exact: bool = True,
                    sequential: bool = True) -> DataFrame:
    """Keep rows inside the per-column bounds (nulls and NaN in those columns are dropped).

    iqr: q1 - t*iqr <= x <= q3 + t*iqr (exact linear quantiles by default,
    ``exact=False`` uses percentile_approx).  zscore: |x-mean|/stddev <= t;
    a zero-spread column keeps all its non-null rows.
    """
    columns = list(columns)
    _numeric_check(df, columns)
    if method not in ("iqr", "zscore"):
        raise ValueError(f"Unknown outlier method: {method}")
    base = df
    preds: list[Column] = []
    pre_q = {}
    if method == "iqr" and not sequential and exact and columns:
        # simultaneous bounds: all columns' quartiles in one refinement pass
        pre_q = exact_quantiles_multi(base, {c: [0.25, 0.75] for c in columns})
    for c in columns:
        stats_df = df if sequential else base
        x = F.col(c)
        if method == "iqr":
            if c in pre_q:
                q1, q3 = pre_q[c]
                lo, hi = (None, None) if q1 is None else (q1 - threshold * (q3 - q1), q3 + threshold * (q3 - q1))
            else:
                lo, hi = iqr_bounds(stats_df, c, threshold, exact)
            pred = (x >= F.lit(lo)) & (x <= F.lit(hi)) if lo is not None else F.lit(False)
        else:
            p = zscore_params(stats_df, [c])[c]
            mean, std = p
            if mean is None:
                pred = F.lit(False)
            elif std is None or std == 0.0:
                pred = number(c).isNotNull()
            else:
                pred = F.abs((number(c) - F.lit(mean)) / F.lit(std)) <= F.lit(float(threshold))
        if sequential:
            df = df.filter(pred)
        else:
            preds.append(pred)
    if not sequential and preds:
        combined = preds[0]
        for p in preds[1:]:
            combined = combined & p
        df = base.filter(combined)
    return df


def label_encode(df: DataFrame, columns: Sequence[str], suffix: str = "_index",
                 max_broadcast_rows: int = 1_000_000) -> DataFrame:
    """Integer codes = rank of the value among the sorted distinct values.

    The code table is built distributed (range-partitioned ordinal, no
    single-partition window) and joined back, broadcast only when its size
    is checked small.  Null stays null.
    """
    for c in columns:
        codes = dense_codes(df, c, f"{c}{suffix}")
        codes = codes.withColumn(f"{c}{suffix}", F.col(f"{c}{suffix}").cast("double"))
        df = join_small(df, codes, c, "left", max_rows=max_broadcast_rows)
    return df


def one_hot(df: DataFrame, column: str, values: Sequence | None = None,
            drop_last: bool = False, max_values: int = MAX_ONE_HOT_VALUES) -> DataFrame:
    """One 0/1 int column ``<c>_<value>`` per distinct value (sorted).

    Names that would be equal get a number.  More than ``max_values`` values
    are an error: a table cannot be that wide; ``one_hot_sparse`` holds any
    number of them in one column.
    """
    if values is None:
        top = (df.select(column).where(F.col(column).isNotNull()).distinct()
               .orderBy(column).limit(max_values + 1).collect())
        if len(top) > max_values:
            raise ValueError(f"{column} has more than {max_values} distinct values; use the sparse form")
        values = [r[0] for r in top]
    values = list(values)
    if drop_last and values:
        values = values[:-1]
    taken = {c.lower() for c in df.columns}
    new = []
    for v in values:
        base = name = f"{column}_{safe_name(v)}"
        n = 2
        while name.lower() in taken:
            name, n = f"{base}_{n}", n + 1
        taken.add(name.lower())
        new.append(F.when(F.col(column) == F.lit(v), 1).otherwise(0).alias(name))
    return df.select("*", *new)


def one_hot_sparse(df: DataFrame, column: str, output: str | None = None, drop_last: bool = False) -> DataFrame:
    """``<c>_onehot``: a sparse vector with a 1 at the value's place among the
    sorted distinct values; null and values unseen in fitting give all zeros."""
    from pyspark.ml.feature import OneHotEncoder, StringIndexer
    output = output or f"{column}_onehot"
    text, index = f"__{column}_text", f"__{column}_place"
    data = df.withColumn(text, F.col(column).cast("string"))
    places = StringIndexer(inputCol=text, outputCol=index, stringOrderType="alphabetAsc", handleInvalid="keep").fit(data)
    n = len(places.labels)
    # the last place, of null, is dropped: all zeros
    encoder = OneHotEncoder(inputCol=index, outputCol=output, dropLast=True)
    data = places.transform(data)
    out = encoder.fit(data).transform(data).drop(text, index)
    if drop_last and n:
        from pyspark.ml.feature import VectorSlicer
        full = f"__{output}_full"
        out = VectorSlicer(inputCol=full, outputCol=output, indices=list(range(n - 1))).transform(
            out.withColumnRenamed(output, full)).drop(full)
    return out


def target_encode(df: DataFrame, column: str, target: str, smoothing: float = 10.0,
                  suffix: str = "_te", max_broadcast_rows: int = 1_000_000) -> DataFrame:
    """Smoothed category mean of ``target``: (n*mean_c + m*mean) / (n + m).

    Category statistics are one partial+final aggregate (skew-safe) that is
    written once; the global mean is derived from that small table (no second
    scan), and the table is joined back with a size-checked broadcast.
    Unseen/null categories get the global mean.
    """
    y = F.col(target).cast("double")
    stats = materialize(df.groupBy(column).agg(F.count(y).alias("_n"), F.sum(y).alias("_s")), "categories")
    tot = stats.agg(F.sum("_n").alias("n"), F.sum("_s").alias("s")).first()
    g = (tot["s"] / tot["n"]) if tot["n"] else None
    m = float(smoothing)
    enc = stats.where(F.col(column).isNotNull() & (F.col("_n") > 0)).select(
        column, ((F.col("_s") + F.lit(m) * F.lit(g)) / (F.col("_n") + F.lit(m))).alias(f"{column}{suffix}"))
    out = join_small(df, enc, column, "left", max_rows=max_broadcast_rows)
    return out.withColumn(f"{column}{suffix}", F.coalesce(F.col(f"{column}{suffix}"), F.lit(g)))


def target_encode_folds(df: DataFrame, column: str, target: str, key: str, folds: int = 5, smoothing: float = 10.0, seed: int = 42,
                        suffix: str = "_te") -> tuple[DataFrame, DataFrame]:
    """(``df`` with ``<c>_te``, fitted table): every row is encoded from the other folds.

    Sums are taken once per (category, fold); a row's code is the smoothed mean
    of its category's sums less those of its own fold, so its target is not in
    its feature.  A category that the other folds do not have gets their mean,
    null is a category like any other, and null targets count nowhere.  The
    table (category, value) is what ``target_encode`` would give: it encodes rows
    that took no part in the fit.
    """
    from sparkprep.operators.encode import kfold
    y, fold = F.col(f"`{target}`").cast("double"), "_te_fold"
    data = kfold(df, key, folds, seed, fold)
    sums = materialize(data.groupBy(F.col(f"`{column}`").alias("_c"), F.col(fold)).agg(F.count(y).alias("_n"), F.sum(y).alias("_s")), "sums")
    rest = {r[fold]: (r["n"], r["s"]) for r in sums.groupBy(fold).agg(F.sum("_n").alias("n"), F.sum("_s").alias("s")).collect()}
    n, s = (sum(v[i] or 0 for v in rest.values()) for i in range(2))

    def mean(count: float, total: float) -> float | None:
        return total / count if count else None
    base = F.create_map(*[x for f in range(folds) for x in (
        F.lit(f), F.lit(mean(n - (rest.get(f, (0, 0))[0] or 0), s - (rest.get(f, (0, 0))[1] or 0))).cast("double"))])
    m = F.lit(float(smoothing))
    whole = sums.groupBy("_c").agg(F.sum("_n").alias("_an"), F.sum("_s").alias("_as"))
    own = sums.alias("o").join(whole.alias("w"), F.col("o._c").eqNullSafe(F.col("w._c")))
    left_n = F.col("w._an") - F.col("o._n")
    left_s = F.coalesce("w._as", F.lit(0.0)) - F.coalesce("o._s", F.lit(0.0))
    value = F.try_divide(left_s + m * base[F.col(f"o.{fold}")], left_n + m)
    table = own.select(F.col("o._c").alias(column), F.col(f"o.{fold}").alias(fold), F.when(left_n > 0, value).alias(f"{column}{suffix}"))
    out = join_small(data.drop(f"{column}{suffix}"), table, [column, fold])
    out = out.withColumn(f"{column}{suffix}", F.coalesce(F.col(f"{column}{suffix}"), base[F.col(fold)])).drop(fold)
    fitted = whole.where(F.col("_an") > 0).select(F.col("_c").alias(column), ((F.col("_as") + m * F.lit(mean(n, s))) / (F.col("_an") + m))
                                                  .alias(f"{column}{suffix}"))
    return out, fitted


DATETIME_PARTS = ("year", "quarter", "month", "day", "dayofweek", "weekofyear", "hour", "is_weekend")


def datetime_features(df: DataFrame, column: str,
                      parts: Sequence[str] = DATETIME_PARTS) -> DataFrame:
    """Calendar parts of a date/timestamp column as ``<c>_<part>`` ints.

    dayofweek: 1 = Sunday .. 7 = Saturday; weekofyear: ISO week;
    is_weekend: Saturday or Sunday.
    """
    x = F.col(column)
    fns = {
        "year": F.year(x), "quarter": F.quarter(x), "month": F.month(x),
        "day": F.dayofmonth(x), "dayofweek": F.dayofweek(x),
        "weekofyear": F.weekofyear(x), "hour": F.hour(x),
        "minute": F.minute(x), "dayofyear": F.dayofyear(x),
        "is_weekend": F.dayofweek(x).isin(1, 7).cast("int"),
    }
    bad = [p for p in parts if p not in fns]
    if bad:
        raise ValueError(f"Unknown datetime parts: {bad}")
    return df.select("*", *[fns[p].alias(f"{column}_{p}") for p in parts])
