"""Lags inside ranges, with the last rows of a range handed to the next.

Rows are range-partitioned once by (group, order), so a group of any size
spans as many tasks as it needs.  A task lags its rows as Arrow columns; only
its first rows look beyond it.  They and every range's last rows, a few per
range, make a small table in which the same lags are taken again.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from sparkprep.functions.joins import join_small
from sparkprep.functions.materialize import materialize


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    batches = pa.Table.from_batches(parts).combine_chunks().to_batches()
    return batches[0] if batches else parts[0].slice(0, 0)


def lagged(df: DataFrame, column: str, lags: Sequence[int], keys: Sequence[str], order: Sequence[str],
           num_partitions: int | None = None) -> DataFrame:
    """``df`` with ``<column>_lag<k>``, the value k rows earlier among the rows of
    equal ``keys`` (null equals null) in the order of ``order``, null where there
    is none; every lag at least 1.  One shuffle, whatever the number of lags.
    """
    spark = df.sparkSession
    lags, most = [int(k) for k in lags], max(int(k) for k in lags)
    names = [f"{column}_lag{k}" for k in lags]
    kept = [c for c in df.columns if c not in names]
    flags = [F.col(f"`{k}`").isNull() for k in keys]
    group = [F.xxhash64(*flags, *[F.col(f"`{k}`") for k in keys]), F.xxhash64(F.lit(1), *[F.col(f"`{k}`") for k in keys], *flags)]
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sort = [F.col(f"`{c}`") for c in (*keys, *order)]
    ranged = (df.select(*[F.col(f"`{c}`") for c in kept]).repartitionByRange(n, *sort).sortWithinPartitions(*sort)
              .select("*", group[0].alias("__g1"), group[1].alias("__g2")))
    value = df.schema[column]
    schema = StructType([*ranged.schema.fields, *[StructField(c, value.dataType) for c in names], StructField("__pid", IntegerType()),
                         StructField("__pos", LongType()), StructField("__last", BooleanType())])
    at = kept.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``before``: rows already sent that later ones may look back to; ``held``:
        the last rows so far, sent with the next batch or marked at the end."""
        pid, sent, before, held = TaskContext.get().partitionId(), 0, None, []

        def out(rows: pa.RecordBatch, last: bool) -> pa.RecordBatch:
            nonlocal sent, before
            seen = rows if before is None else _joined([before, rows])
            skip = seen.num_rows - rows.num_rows
            g1, g2 = (seen.column(len(kept) + i).to_numpy() for i in range(2))
            here = np.arange(skip, seen.num_rows)
            new = np.r_[True, (g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1])] if len(g1) else np.zeros(0, bool)
            start = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0)) if len(new) else new
            cols = []
            for k in lags:
                from_ = here - k
                cols.append(seen.column(at).take(pa.array(np.maximum(from_, 0), mask=from_ < (start[here] if len(here) else from_))))
            pos = np.arange(sent, sent + rows.num_rows)
            sent += rows.num_rows
            before = seen.slice(max(0, seen.num_rows - most))
            m = rows.num_rows
            return pa.RecordBatch.from_arrays(
                [*rows.columns, *cols, pa.array(np.full(m, pid, np.int32)), pa.array(pos), pa.array(np.full(m, last))], names=schema.names)

        for batch in batches:
            rows = _joined([*held, batch])
            go = max(0, rows.num_rows - most)
            if go:
                yield out(rows.slice(0, go), False)
            held = [rows.slice(go)]
        if held and held[0].num_rows:
            yield out(held[0], True)
    inside = materialize(ranged.mapInArrow(run, schema), "lagged")
    edge = inside.where((F.col("__pos") < most) | F.col("__last")).select(
        "__pid", "__pos", "__g1", "__g2", F.col(f"`{column}`").alias("__value"))
    line = Window.orderBy("__pid", "__pos")  # at most 2 * largest lag rows a range
    patch = []
    for k in lags:
        same = (F.lag("__g1", k).over(line) == F.col("__g1")) & (F.lag("__g2", k).over(line) == F.col("__g2"))
        patch.append(F.when(same, F.lag("__value", k).over(line)).alias(f"__patch{k}"))
    heads = edge.select("__pid", "__pos", *patch).where(F.col("__pos") < most)
    joined = join_small(inside, heads, ["__pid", "__pos"])
    fixed = [F.when(F.col("__pos") < k, F.col(f"__patch{k}")).otherwise(F.col(f"`{c}`")).alias(c) for k, c in zip(lags, names)]
    return joined.select(*[F.col(f"`{c}`") for c in kept], *fixed)


# tasks get this module with the functions that use it, so a cluster needs no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])
