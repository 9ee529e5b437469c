"""Global row ordinals without a single-partition window.

``with_ordinal`` range-partitions rows by a total order, numbers rows inside
each partition with ``monotonically_increasing_id`` (partition id in the
upper bits, row number in the lower 33 bits), and turns that into a
contiguous 0-based ordinal using per-partition counts (one small row per
partition).  A hot key is spread over several range partitions, so no task
holds a whole group.  The ranged frame is written once to the shared
checkpoint folder, so both passes read identical rows and a lost executor
recomputes nothing upstream.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep.functions.materialize import materialize

_LOW_BITS = (1 << 33) - 1


def with_ordinal(df: DataFrame, order_cols: Sequence[str], name: str = "_ord",
                 num_partitions: int | None = None) -> DataFrame:
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(n, *order_cols)
              .sortWithinPartitions(*order_cols)
              .withColumn("_mid", F.monotonically_increasing_id()))
    ranged = materialize(ranged, "ordinal")
    ranged = ranged.withColumn("__pid", F.shiftright("_mid", 33))
    counts = ranged.groupBy("__pid").agg(F.count(F.lit(1)).alias("n"))
    offsets = _offsets(counts, "__pid", ["n"], ["__off"])
    ordinal = (F.col("__off") + F.col("_mid").bitwiseAND(F.lit(_LOW_BITS))).cast("bigint")
    return ranged.join(offsets, "__pid").withColumn(name, ordinal).drop("_mid", "__pid", "__off")


def _offsets(totals: DataFrame, key: str, columns: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Sums of the partitions before each, as a table to broadcast (one row per
    range partition, so its size is the shuffle's partition count)."""
    spark = totals.sparkSession
    kinds = [totals.schema[c].dataType.simpleString() for c in columns]
    rows, acc = [], [0.0 if k in ("double", "float") else 0 for k in kinds]
    for r in totals.orderBy(key).collect():
        rows.append((int(r[key]), *acc))
        acc = [x + (r[c] or 0) for x, c in zip(acc, columns)]
    schema = ", ".join([f"{key} bigint", *[f"{n} {k}" for n, k in zip(names, kinds)]])
    return F.broadcast(spark.createDataFrame(rows, schema))


def dense_codes(df: DataFrame, column: str, code_name: str) -> DataFrame:
    """(value, code) with code = 0-based rank of the value in ascending order."""
    vals = df.select(column).where(F.col(column).isNotNull()).distinct()
    return with_ordinal(vals, [column], code_name)


def prefix_sums(df: DataFrame, order: Sequence, sum_cols: Sequence[str],
                prefix: str = "cum_", num_partitions: int | None = None) -> DataFrame:
    """Running totals of ``sum_cols`` in ``order`` (Columns or names, total order).

    Rows are range-partitioned by the order, totals per partition (one row
    each) become offsets, and a window restricted to one range partition
    finishes the running sum - so no window ever sees all rows.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
              .withColumn("_pid", F.spark_partition_id()))
    ranged = materialize(ranged, "prefix")
    from pyspark.sql import Window
    totals = ranged.groupBy("_pid").agg(*[F.sum(c).alias(c) for c in sum_cols])
    offs = [f"__off{i}" for i in range(len(sum_cols))]
    w = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding,
                                                                Window.currentRow)
    out = ranged.select("*", *[F.sum(c).over(w).alias(f"{prefix}{c}") for c in sum_cols])
    out = out.join(_offsets(totals, "_pid", sum_cols, offs), "_pid")
    for c, o in zip(sum_cols, offs):
        out = out.withColumn(f"{prefix}{c}", F.col(f"{prefix}{c}") + F.col(o))
    return out.drop("_pid", *offs)


def grouped_exact_quantiles(df: DataFrame, group_cols: Sequence[str], column: str,
                            probs: Sequence[float], prefix: str = "q") -> DataFrame:
    """Exact linear-interpolated quantiles per group, for any skew and any ties.

    Rows are first counted per (group, value); running sums of those counts in
    (group, value) order (range partitions, so a hot group spans many tasks)
    place every order statistic, and each group picks its own with one
    aggregate.  The work after the first aggregate grows with the distinct
    pairs only.  Output: group columns + ``<prefix>0, <prefix>1, ...``; groups
    without a value have nulls.
    """
    keys = list(group_cols)
    x = F.col(column).cast("double")
    v = F.when(x.isNotNull() & ~F.isnan(x), x)
    counts = df.groupBy(*keys, v.alias("__v")).agg(F.count(v).alias("__n"))
    order = [*[F.col(k) for k in keys], F.col("__v")]
    cum = materialize(prefix_sums(counts, order, ["__n"], prefix="__cum"), "quantiles")
    stats = cum.groupBy(*keys).agg(F.sum("__n").alias("__size"), F.min(F.col("__cum__n") - F.col("__n")).alias("__first"))
    on = [F.col(f"c.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    both = cum.alias("c").join(stats.alias("s"), on).select(*[F.col(f"c.{k}") for k in keys], "__v", "__n", "__size",
                                                            (F.col("__cum__n") - F.col("__first")).alias("__upto"))
    aggs, outs = [], []
    for i, p in enumerate(probs):
        pos = (F.col("__size") - 1).cast("double") * F.lit(float(p))
        for name, at in ((f"__lo{i}", F.floor(pos)), (f"__hi{i}", F.ceil(pos))):
            here = (F.col("__upto") - F.col("__n") <= at) & (at < F.col("__upto"))
            aggs.append(F.max(F.when(here, F.col("__v"))).alias(name))
        aggs.append(F.max(pos - F.floor(pos)).alias(f"__f{i}"))
        lo, hi = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        outs.append(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * F.col(f"__f{i}")).alias(f"{prefix}{i}"))
    return both.groupBy(*keys).agg(*aggs).select(*keys, *outs)
