"""Preview, counts, schema, feature typing and column profiles (PRV-1..7, PRJ-1)."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (BooleanType, DateType, DoubleType, FloatType, NumericType, StringType, TimestampNTZType,
                               TimestampType)

from sparkprep.functions.exprs import number
from sparkprep.functions.stats import approx_quantiles, exact_quantiles_multi, one_row

TEXT_MIN_AVG_TOKENS = 5.0


def preview(df: DataFrame, limit: int = 10, order_by: Sequence[str] | None = None) -> DataFrame:
    """First ``limit`` rows; with ``order_by`` a per-partition top-k merge."""
    return (df.orderBy(*order_by) if order_by else df).limit(limit)


def counts(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("num_rows")).select(
        "num_rows", F.lit(len(df.columns)).alias("num_columns"))


def schema_table(df: DataFrame) -> DataFrame:
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string, nullable boolean")


def feature_types(df: DataFrame, text_min_avg_tokens: float = TEXT_MIN_AVG_TOKENS) -> DataFrame:
    """(column, kind) with kind numeric | categorical | text | datetime | boolean | other.

    A string column is text when its average whitespace token count exceeds
    ``text_min_avg_tokens``; all string columns are measured in one aggregate.
    """
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    avg = {}
    if strings:
        r = one_row(df, {f"t{i}": F.avg(F.size(F.split(F.col(c), r"\s+")).cast("double"))
                         for i, c in enumerate(strings)})
        avg = {c: r[f"t{i}"] for i, c in enumerate(strings)}
    rows = []
    for i, f in enumerate(df.schema.fields):
        t = f.dataType
        if isinstance(t, NumericType):
            kind = "numeric"
        elif isinstance(t, StringType):
            kind = "text" if (avg.get(f.name) or 0.0) > text_min_avg_tokens else "categorical"
        elif isinstance(t, (DateType, TimestampType, TimestampNTZType)):
            kind = "datetime"
        elif isinstance(t, BooleanType):
            kind = "boolean"
        else:
            kind = "other"
        rows.append((i, f.name, kind))
    return df.sparkSession.createDataFrame(rows, "position int, column string, kind string")


def as_text(df: DataFrame, c: str):  # noqa: ANN202
    x = F.col(c)
    if isinstance(df.schema[c].dataType, (DoubleType, FloatType)):
        x = F.when(x == 0, F.lit(0.0)).otherwise(x)  # -0.0 and 0.0 are one value
    return x.cast("string")


def least_values(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """(column, least): the ``k`` least distinct values as text, ascending.  One scan:
    a task sends at most ``k`` values a column."""
    cols = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[bytes]] = [[] for _ in cols]
        for batch in batches:
            for i in range(len(cols)):
                found = pc.unique(pc.drop_null(batch.column(i).cast(pa.binary())))
                if len(held[i]) == k and k:
                    found = found.filter(pc.less(found, pa.scalar(held[i][-1], pa.binary())))
                held[i] = sorted({*held[i], *found.take(pc.array_sort_indices(found)[:k]).to_pylist()})[:k]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, h in enumerate(held) for _ in h], pa.int32()),
                                          pa.array([v.decode() for h in held for v in h], pa.string())], names=["i", "v"])
    found = df.select(*[as_text(df, c).alias(f"_{i}") for i, c in enumerate(cols)]).mapInArrow(run, "i int, v string")
    ranked = found.distinct().withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy("v"))).where(F.col("r") <= k)
    lists = ranked.groupBy("i").agg(F.array_sort(F.collect_list("v")).alias("least"))
    return lists.select(F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("i") + 1).alias("column"), "least")


def column_profile(df: DataFrame, columns: Sequence[str] | None = None, samples: int = 3,
                   exact_distinct: bool = False) -> DataFrame:
    """(column, non_null, distinct, sample_values) per column.

    One narrow aggregate counts all columns (distinct values by HyperLogLog);
    one more scan finds the ``samples`` smallest values (as text) of all of them.
    ``exact_distinct`` counts distinct values
    exactly: the (column, value) pairs are then de-duplicated in a shuffle, once
    for all columns.
    """
    cols = list(columns or df.columns)
    texts = {c: as_text(df, c) for c in cols}
    aggs = [F.count(F.col(c)).alias(f"nn{i}") for i, c in enumerate(cols)]
    if not exact_distinct:
        aggs += [F.approx_count_distinct(F.col(c)).alias(f"d{i}") for i, c in enumerate(cols)]
    row = df.agg(*aggs).first()
    stats = {c: (row[f"nn{i}"], None if exact_distinct else row[f"d{i}"]) for i, c in enumerate(cols)}
    found = {r["column"]: r["least"] for r in least_values(df, cols, samples).collect()}
    rows = [(c, stats[c][0], stats[c][1], found.get(c)) for c in cols]
    out = df.sparkSession.createDataFrame(rows, "column string, non_null bigint, distinct bigint, sample_values array<string>")
    if exact_distinct:
        long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), texts[c].alias("value")) for c in cols])).alias("e"))
        pairs = long.select("e.*").where(F.col("value").isNotNull()).distinct()
        counts = pairs.groupBy("column").agg(F.count(F.lit(1)).alias("_d"))
        out = (out.drop("distinct").join(counts, "column", "left")
               .withColumn("distinct", F.coalesce("_d", F.lit(0)).cast("bigint")))
    return out.select("column", "non_null", "distinct", "sample_values")


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """(column, count, mean, median, min, max, std) for numeric columns.

    With ``exact`` the moments ride in the first job of the exact-quantile
    pass, so the whole summary costs that pass only (no separate scan).
    """
    cols = list(columns or [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)])
    exprs = {}
    for i, c in enumerate(cols):
        x = number(c)
        exprs.update({f"n{i}": F.count(x), f"m{i}": F.avg(x), f"lo{i}": F.min(x),
                      f"hi{i}": F.max(x), f"s{i}": F.stddev_samp(x)})
    if exact:
        moments: dict = {}
        medians = {c: v[0] for c, v in
                   exact_quantiles_multi(df, {c: [0.5] for c in cols}, extra=exprs, extra_out=moments).items()}
        rows = [(c, int(moments[f"n{i}"] or 0), moments[f"m{i}"], medians[c], moments[f"lo{i}"],
                 moments[f"hi{i}"], moments[f"s{i}"]) for i, c in enumerate(cols)]
        return df.sparkSession.createDataFrame(
            rows, "column string, count bigint, mean double, median double, min double, max double, std double")
    agg = df.agg(*[e.alias(k) for k, e in exprs.items()])
    medians = {c: approx_quantiles(df, c, [0.5])[0] for c in cols}
    return agg.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"n{i}").cast("bigint").alias("count"),
                 F.col(f"m{i}").alias("mean"), F.lit(medians[c]).cast("double").alias("median"),
                 F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"),
                 F.col(f"s{i}").alias("std"))
        for i, c in enumerate(cols)])).alias("s")).select("s.*")


def target_info(df: DataFrame, target: str, unique_limit: int = 10) -> DataFrame:
    """(target, n_unique, is_categorical): string targets or < unique_limit values."""
    is_string = isinstance(df.schema[target].dataType, StringType)
    return df.agg(F.countDistinct(target).alias("n_unique")).select(
        F.lit(target).alias("target"), F.col("n_unique").cast("bigint").alias("n_unique"),
        (F.lit(is_string) | (F.col("n_unique") < unique_limit)).alias("is_categorical"))


def project(df: DataFrame, target: str, features: Sequence[str] | None = None) -> DataFrame:
    """Features (default: all but target) + target, with a missing-column error."""
    if target not in df.columns:
        raise ValueError(f"no target column {target!r}")
    if features is None:
        features = [c for c in df.columns if c != target]
    missing = [c for c in features if c not in df.columns]
    if missing:
        raise ValueError(f"no feature columns {missing}")
    return df.select(*features, target)


# tasks get this module with the functions that use it, so a cluster needs no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])
