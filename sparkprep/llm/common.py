"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkprep.functions.joins import join_small
from sparkprep.functions.materialize import materialize

WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    """Words of a text as bigint; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    if len(column) == 0 or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def byte_groups(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive (first, last) row ranges of at most ``limit`` bytes, or one longer row."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


BROADCAST_BYTES = 48 << 20
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """From now on texts reach Python tasks in Arrow batches of about ``BATCH_BYTES``
    (a longer text comes alone), unless the session already asks for less.
    Spark's own limit of 64 MB takes several times that in every task."""
    now = spark.conf.get(_BATCH_SETTING)
    unit = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(now[-1:].lower(), 0)
    limit = int(now[:-1]) * unit if unit else int(now)
    if limit <= 0 or limit > BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, f"{BATCH_BYTES}b")


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run`` for mapInArrow, returning a worker's unused memory when its task ends:
    workers stay for later tasks."""
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)
    return wrapped


def text_hash(text_col: str) -> Column:
    """64-bit hash of a text; null reads as empty."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def row_key(id_col: str, text_col: str) -> list[Column]:
    """``_d, _t``: a row is known by its id and its text's hash; rows that share
    both are the same document."""
    return [F.coalesce(F.col(id_col).cast("bigint"), F.lit(-1)).alias("_d"), text_hash(text_col).alias("_t")]


def packed(docs: DataFrame) -> Column:
    """A row's own columns as one struct, so that no name clashes with a helper's."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")


def unpacked(columns: list[str]) -> list[Column]:
    return [F.col("_row").getField(c).alias(c) for c in columns]


def with_found(docs: DataFrame, rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_row`` of every document and the columns of ``rows`` (_d, _t, ...) under its
    key, null where there is none.  ``rows`` (written here) is broadcast if measured
    to be small, else both sides are shuffled."""
    rows = materialize(rows, "rows")
    small = rows.count() * 32 * len(rows.columns) <= BROADCAST_BYTES
    keyed = docs.select(packed(docs), *row_key(id_col, text_col))
    return keyed.join(F.broadcast(rows) if small else rows, ["_d", "_t"], "left")


def hash_sample(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """At most ``rows`` rows, those of the smallest hash of ``key``.  Only hashes
    are sorted; the rows themselves are read by a filter."""
    h = F.xxhash64(key)
    last = df.select(h.alias("_h")).orderBy("_h").limit(rows).agg(F.max("_h")).first()[0]
    return df.where(h <= F.lit(last)).limit(rows) if last is not None else df.limit(0)


def rank_in_group(df: DataFrame, group: list[str], order: list[Column], name: str = "_rank") -> DataFrame:
    """0-based rank of every row in its group, for groups of any size.

    Rows are range-partitioned by (group, order), so one group spans as many
    tasks as it needs; a table with one row per (group, partition) gives the
    offsets, and the window only sees the rows of one group in one partition.
    """
    spark = df.sparkSession
    keys = [F.col(g).asc_nulls_last() for g in group]
    ranged = (df.repartitionByRange(shuffle_partitions(spark), *keys, *order)
              .withColumn("_part", F.spark_partition_id()))
    ranged = materialize(ranged, "ranked")
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (ranged.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    inside = Window.partitionBy(*group, "_part").orderBy(*order)
    ranked = ranged.withColumn("_in", F.row_number().over(inside) - 1)
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")) for c in (*group, "_part")]
    joined = ranked.alias("r").join(offsets.alias("o"), on)
    return joined.select(*[F.col(f"r.{c}") for c in df.columns],
                         (F.col("r._in") + F.col("o._before")).cast("bigint").alias(name))


HEAVY = 1000


def split_join(rows: DataFrame, facts: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """``rows`` with the other columns of ``facts``, which has one row per key and,
    as ``weight``, the number of rows under it.  Keys of many rows are few: they
    come by a broadcast measured to be small, the others by an equi-join."""
    heavy = facts.where(F.col(weight) > HEAVY).withColumn("_heavy", F.lit(True))
    first = materialize(join_small(rows, heavy, keys), "heavy")
    light = facts.where(F.col(weight) <= HEAVY)
    rest = first.where(F.col("_heavy").isNull()).select(*rows.columns).join(light, keys)
    out = [*rows.columns, *[c for c in facts.columns if c not in keys]]
    return first.where("_heavy").select(*out).unionByName(rest.select(*out))
