"""Feature engineering on scalar columns (FE-1..3, FE-9, FE-11..15).

Vector-producing pyspark.ml stages are always given unique temporary column
names and their output is turned into named scalar (or array) columns, so
two vector operations in one operation list never collide.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Sequence

from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep.functions.exprs import bin_index, number
from sparkprep.functions.halo import lagged
from sparkprep.functions.joins import join_small
from sparkprep.functions.ordinal import with_ordinal
from sparkprep.functions.stats import one_row
from sparkprep.operators import principal

AGG_FUNCS: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg, "avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max,
    "count": F.count, "std": F.stddev_samp, "var": F.var_samp,
}


def _tmp(prefix: str) -> str:
    return f"__{prefix}_{uuid.uuid4().hex[:8]}"


def polynomial_names(columns: Sequence[str], degree: int) -> list[tuple[str, tuple[str, ...]]]:
    """(name, factors) for every monomial of total degree 1..degree."""
    out = []
    for d in range(1, degree + 1):
        for combo in itertools.combinations_with_replacement(columns, d):
            parts = []
            for c, grp in itertools.groupby(combo):
                k = len(list(grp))
                parts.append(c if k == 1 else f"{c}_pow{k}")
            out.append(("poly_" + "_x_".join(parts), combo))
    return out


def polynomial_features(df: DataFrame, columns: Sequence[str], degree: int = 2) -> DataFrame:
    """All monomials up to ``degree`` as named double columns (C(n+d,d)-1 of them)."""
    if degree < 1:
        raise ValueError("degree must be >= 1")
    new = []
    for name, combo in polynomial_names(list(columns), degree):
        e = F.col(combo[0]).cast("double")
        for c in combo[1:]:
            e = e * F.col(c).cast("double")
        new.append(e.alias(name))
    return df.select("*", *new)


def polynomial_count(n: int, degree: int) -> int:
    from math import comb
    return comb(n + degree, degree) - 1


def binning(df: DataFrame, column: str, bins: int = 5,
            labels: Sequence[str] | None = None, bounds: tuple | None = None) -> DataFrame:
    """Equal-width bins of ``column`` -> ``<c>_binned`` (double 0..bins-1).

    Edges are min + i*(max-min)/bins with open outer edges, bins are
    left-closed.  With ``labels`` (exactly ``bins`` of them) the label of
    each bin is added as ``<c>_bin_label``.
    """
    if bins < 1:
        raise ValueError("bins must be >= 1")
    if labels is not None and len(labels) != bins:
        raise ValueError("labels must have exactly `bins` entries")
    if bounds is None:
        s = one_row(df, {"mn": F.min(number(column)), "mx": F.max(number(column))})
        bounds = (s["mn"], s["mx"])
    b = bin_index(F.col(column).cast("double"), bounds[0], bounds[1], bins)
    out = df.withColumn(f"{column}_binned", b)
    if labels is not None:
        arr = F.array(*[F.lit(str(x)) for x in labels])
        out = out.withColumn(f"{column}_bin_label",
                             F.element_at(arr, F.col(f"{column}_binned").cast("int") + 1))
    return out


def interaction_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairwise products ``<a>_x_<b>`` for every pair of ``columns``."""
    new = [(F.col(a).cast("double") * F.col(b).cast("double")).alias(f"{a}_x_{b}")
           for a, b in itertools.combinations(columns, 2)]
    return df.select("*", *new)


def aggregation(df: DataFrame, group_by: Sequence[str], columns: Sequence[str],
                functions: Sequence[str] = ("mean", "sum", "min", "max", "count"),
                mode: str = "table", max_broadcast_rows: int = 1_000_000) -> DataFrame:
    """Group statistics ``<col>_<fn>``.

    mode="table": one row per group.  mode="broadcast_back": the group
    statistics are attached to every input row (size-checked broadcast
    join, else a shuffle join with AQE skew handling) - not a window, so a
    hot group never lands in one task.
    """
    bad = [f for f in functions if f not in AGG_FUNCS]
    if bad:
        raise ValueError(f"Unknown aggregate functions: {bad}")
    aggs = []
    for c in columns:
        for f in functions:
            e = AGG_FUNCS[f](F.col(c))
            if f == "count":
                e = e.cast("bigint")
            aggs.append(e.alias(f"{c}_{f}"))
    table = df.groupBy(*group_by).agg(*aggs)
    if mode == "table":
        return table
    if mode == "broadcast_back":
        return join_small(df, table, list(group_by), "left", max_rows=max_broadcast_rows)
    raise ValueError(f"Unknown aggregation mode: {mode}")


def lag_features(df: DataFrame, column: str, lags: Sequence[int], order_by: Sequence[str],
                 partition_by: Sequence[str]) -> DataFrame:
    """``<c>_lag<k>`` = value k rows earlier in the same partition group.

    ``order_by`` must make the order total (add a unique key).  Rows are shuffled
    once by range of (partition_by, order_by), so a group of any size spans many
    tasks; the first rows of a range look back through a small table of the
    ranges' ends (``functions.halo``).  Null keys equal each other.  A lag of 0 or
    less (a lead) takes an equi-join on the rows' ordinals.
    """
    if not partition_by:
        raise ValueError("lag_features needs partition_by (no global window)")
    lags = [int(k) for k in lags]
    if not lags:
        return df
    if min(lags) < 1:
        return _lag_by_ordinal(df, column, lags, order_by, list(partition_by))
    return lagged(df, column, lags, list(partition_by), list(order_by))


def _lag_by_ordinal(df: DataFrame, column: str, lags: list[int], order_by: Sequence[str],
                    keys: list[str]) -> DataFrame:
    ordc = _tmp("ord")
    ranked = with_ordinal(df, keys + list(order_by), ordc)
    out = ranked
    for k in lags:
        kc = _tmp("k")
        prev = ranked.select((F.col(ordc) + F.lit(k)).alias(ordc),
                             *[F.col(p).alias(f"{kc}_{i}") for i, p in enumerate(keys)],
                             F.col(column).alias(f"{column}_lag{k}"))
        out = out.join(prev, ordc, "left")
        same = F.lit(True)
        for i, p in enumerate(keys):
            same = same & F.col(p).eqNullSafe(F.col(f"{kc}_{i}"))
        out = out.withColumn(f"{column}_lag{k}",
                             F.when(same, F.col(f"{column}_lag{k}"))).drop(
            *[f"{kc}_{i}" for i in range(len(keys))])
    return out.drop(ordc)


def custom_transformer(df: DataFrame, sql: str | None = None,
                       fn: Callable[[DataFrame], DataFrame] | None = None,
                       batch_fn: Callable | None = None, schema: str | None = None) -> DataFrame:
    """A user step, in one of three forms:

    sql: a statement over ``__THIS__`` (SQLTransformer, fully optimized);
    fn: a DataFrame -> DataFrame function (stays in the Catalyst plan);
    batch_fn: pandas.DataFrame -> pandas.DataFrame applied to Arrow batches
    of each partition (``mapInPandas``) with output ``schema`` - the slow
    path, for logic with no built-in equivalent.
    """
    if sum(x is not None for x in (sql, fn, batch_fn)) != 1:
        raise ValueError("give exactly one of sql, fn or batch_fn")
    if sql is not None:
        return SQLTransformer(statement=sql).transform(df)
    if fn is not None:
        return df.transform(fn)
    if schema is None:
        raise ValueError("batch_fn needs an output schema")

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            yield batch_fn(b)
    return df.mapInPandas(run, schema)


def assemble(df: DataFrame, columns: Sequence[str], output: str = "features",
             handle_invalid: str = "error", as_array: bool = True) -> DataFrame:
    """Numeric columns -> one vector (or array<double>) column.

    handle_invalid: "error" (raise on null/NaN), "skip" (drop the row),
    "keep" (NaN in the vector).  Uses a unique temporary name internally.
    """
    tmp = _tmp("vec")
    va = VectorAssembler(inputCols=list(columns), outputCol=tmp, handleInvalid=handle_invalid)
    out = va.transform(df)
    val = vector_to_array(F.col(tmp)) if as_array else F.col(tmp)
    return out.withColumn(output, val).drop(tmp)


def pca(df: DataFrame, columns: Sequence[str] | str, n_components: int = 2,
        prefix: str = "pc") -> DataFrame:
    """Principal components ``pc1..pck`` (projection of uncentred rows).
    ``columns`` may be a list of numeric columns, one array<float|double> column
    or one vector column.  Skipped when k >= number of inputs.
    """
    width = principal.feature_rows(df, columns)[1]
    if n_components >= width:
        return df
    return principal.transform(df, columns, principal.fit(df, columns, n_components), prefix)


def pca_model(df: DataFrame, column: str, n_components: int = 2) -> principal.Principal:
    """The fitted components of an array or vector column, their variances and shares."""
    return principal.fit(df, column, n_components)
