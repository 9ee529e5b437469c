"""Profiles of growing datasets from stored, mergeable states (PRV-5, PRV-6, CLN-5).

Every part of a dataset (a batch of appended rows) leaves one small row per
column: counts, moments, extremes, the least values as text, a KLL sketch of
the numbers and a HyperLogLog sketch of the values.  A profile of the dataset
merges these rows; only new parts are ever read.
"""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from sparkprep.functions.exprs import number
from sparkprep.operators.profile import as_text, least_values

KLL_K = 800          # size of a quantile sketch: ranks err by about 0.4 %
LG_K = 14            # registers of a distinct sketch: counts err by about 0.8 %
SAMPLES = 5          # least values that a part keeps
RANK_ERROR = 0.01    # what a median's rank may be off, as a share of the rows

STATE = ("column string, position int, numeric boolean, rows bigint, non_null bigint, n bigint, mean double, m2 double, low double, "
         "high double, quantiles binary, distinct binary, least array<string>")


def part_states(df: DataFrame, columns: Sequence[str] | None = None, samples: int = SAMPLES) -> DataFrame:
    """One row of state per column of ``df``: one aggregate, and one scan for the
    least values.  Numbers: NaN counts as missing.  Distinct values are told
    apart as text.
    """
    cols = list(columns or df.columns)
    aggs, structs = [F.count(F.lit(1)).alias("rows")], []
    for i, c in enumerate(cols):
        numeric = isinstance(df.schema[c].dataType, NumericType)
        aggs += [F.count(F.col(f"`{c}`")).alias(f"nn{i}"), F.hll_sketch_agg(as_text(df, c), F.lit(LG_K)).alias(f"h{i}")]
        if numeric:
            x = number(F.col(f"`{c}`"))
            aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}"), F.min(x).alias(f"a{i}"),
                     F.max(x).alias(f"b{i}"), F.kll_sketch_agg_double(x, F.lit(KLL_K)).alias(f"k{i}")]
        n = F.col(f"n{i}") if numeric else F.lit(0).cast("bigint")
        own = {k: F.col(f"{k}{i}") if numeric else F.lit(None).cast("double") for k in "mvab"}
        structs.append(F.struct(
            F.lit(c).alias("column"), F.lit(i).alias("position"), F.lit(numeric).alias("numeric"), F.col("rows"), F.col(f"nn{i}").alias("non_null"),
            n.alias("n"), own["m"].alias("mean"), (own["v"] * n).alias("m2"), own["a"].alias("low"), own["b"].alias("high"),
            (F.col(f"k{i}") if numeric else F.lit(None).cast("binary")).alias("quantiles"), F.col(f"h{i}").alias("distinct")))
    states = df.agg(*aggs).select(F.explode(F.array(*structs)).alias("s")).select("s.*")
    least = least_values(df, cols, samples)
    return states.join(F.broadcast(least), "column", "left").select(*[f.split()[0] for f in STATE.split(", ")])


def write_part(df: DataFrame, path: str, dataset_id: str, part: str, columns: Sequence[str] | None = None) -> None:
    """Stores the states of one part.  A part written again replaces itself, so a
    repeated append counts once."""
    part_states(df, columns).coalesce(1).write.mode("overwrite").parquet(f"{_folder(path, dataset_id)}/part={quote(part, safe='')}")


def _folder(path: str, dataset_id: str) -> str:
    return f"{path.rstrip('/')}/dataset={quote(dataset_id, safe='')}"


def stored_states(spark: SparkSession, path: str, dataset_id: str) -> DataFrame:
    """One merged row of state per column, from the parts' rows alone."""
    parts = spark.read.schema(STATE).parquet(f"{_folder(path, dataset_id)}/part=*")
    own = F.col("n") > 0
    # the squares around the common mean: those around the parts' means and the means' own
    mean = F.try_divide(F.sum(F.when(own, F.col("n") * F.col("mean"))), F.sum("n"))
    centre = parts.groupBy("column").agg(mean.alias("centre"))
    apart = F.col("mean") - F.col("centre")
    return parts.join(F.broadcast(centre), "column").groupBy("column").agg(
        F.min("position").alias("position"), F.max("numeric").alias("numeric"), F.sum("rows").alias("rows"), F.sum("non_null").alias("non_null"),
        F.sum("n").alias("n"), F.max("centre").alias("mean"), F.sum(F.when(own, F.col("m2") + F.col("n") * apart * apart)).alias("m2"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double(F.when(own, F.col("quantiles"))).alias("quantiles"),
        F.hll_union_agg("distinct").alias("distinct"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("least")))).alias("least"))


def stored_profile(spark: SparkSession, path: str, dataset_id: str, samples: int = 3) -> DataFrame:
    """(column, non_null, distinct, sample_values) of all parts; ``samples`` at most ``SAMPLES``."""
    if samples > SAMPLES:
        raise ValueError(f"parts keep their {SAMPLES} least values")
    values = F.slice("least", 1, samples)
    return stored_states(spark, path, dataset_id).orderBy("position").select(
        "column", "non_null", F.hll_sketch_estimate("distinct").alias("distinct"),
        F.when(F.size(values) > 0, values).alias("sample_values"))


def stored_summary(spark: SparkSession, path: str, dataset_id: str) -> DataFrame:
    """(column, count, mean, median, min, max, std) of the numeric columns of all
    parts; the median's rank errs by at most ``RANK_ERROR``."""
    s = stored_states(spark, path, dataset_id).where("numeric").orderBy("position")
    median = F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("quantiles", F.lit(0.5)))
    return s.select("column", F.col("n").alias("count"), "mean", median.alias("median"), F.col("low").alias("min"), F.col("high").alias("max"),
                    F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))).alias("std"))


def stored_quantiles(spark: SparkSession, path: str, dataset_id: str, column: str, probabilities: Sequence[float]) -> list[float | None]:
    """Quantiles of a column over all parts, to be used as bounds (outliers, bins)."""
    at = F.array(*[F.kll_sketch_get_quantile_double("quantiles", F.lit(float(p))) for p in probabilities])
    row = stored_states(spark, path, dataset_id).where(F.col("column") == column).select(F.when(F.col("n") > 0, at).alias("q")).first()
    if row is None:
        raise ValueError(f"no stored column {column!r}")
    return list(row["q"]) if row["q"] is not None else [None] * len(probabilities)


def remove_outliers(df: DataFrame, path: str, dataset_id: str, column: str, threshold: float = 1.5) -> DataFrame:
    """Rows of ``df`` inside the interquartile bounds that the stored parts give."""
    q1, q3 = stored_quantiles(df.sparkSession, path, dataset_id, column, [0.25, 0.75])
    if q1 is None:
        return df.where(F.lit(False))
    x = F.col(f"`{column}`")
    return df.where((x >= F.lit(q1 - threshold * (q3 - q1))) & (x <= F.lit(q3 + threshold * (q3 - q1))))
