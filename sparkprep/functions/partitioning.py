"""Partition-count helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame


def _has_shuffle(df: DataFrame) -> bool:
    """Whether the optimised plan moves rows (joins, aggregates, sorts, windows, repartitions)."""
    plan = df._jdf.queryExecution().optimizedPlan()
    todo, moves = [plan], ("Join", "Aggregate", "Sort", "Window", "Repartition", "RepartitionByExpression",
                           "RebalancePartitions", "Distinct", "Deduplicate", "GlobalLimit", "Intersect", "Except")
    while todo:
        node = todo.pop()
        if node.nodeName() in moves:
            return True
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return False


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin repartition only when a plain scan yields fewer partitions
    than the cluster has cores (e.g. a few fat parquet row groups feeding
    CPU-heavy per-row work).  Large scans already exceed the core count and
    are returned untouched (no shuffle).  Plans that already contain a
    shuffle are left alone too: asking them for their partition count would
    make adaptive execution run those shuffle stages early.
    """
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if _has_shuffle(df):
        return df
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df
