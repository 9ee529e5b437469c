"""Principal components of tall and wide tables (FE-9).

A random range is sharpened by power steps, each one scan that sends back a
columns x range matrix, block of columns by block; the rows' projections are
reduced by a tree of QR factors.  No matrix of columns x columns is made
beyond ``EXACT_COLUMNS`` columns; up to there the range is the whole space
and one step is exact.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXACT_COLUMNS = 512
OVERSAMPLE = 32       # range columns beyond the components asked for
MAX_STEPS = 60
TOLERANCE = 1e-10     # change of the components' variances, as a share, that ends the steps
BLOCK = 1024          # columns whose sums travel together
ROWS = 4096           # rows that a task works on at once
SEED = 9


@dataclass
class Principal:
    """``components`` columns x k; the variances along them; their shares of all variance."""

    components: np.ndarray
    variances: np.ndarray
    ratios: np.ndarray
    mean: np.ndarray
    rows: int
    steps: int


class Sparse:
    """Rows of sparse vectors: what the steps need of a matrix."""

    def __init__(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, n: int, width: int) -> None:
        self.row, self.col, self.value, self.shape = row, col, value, (n, width)

    def times(self, q: np.ndarray) -> np.ndarray:
        out = np.zeros((self.shape[0], q.shape[1]))
        np.add.at(out, self.row, self.value[:, None] * q[self.col])
        return out

    def transposed_times(self, y: np.ndarray) -> np.ndarray:
        out = np.zeros((self.shape[1], y.shape[1]))
        np.add.at(out, self.col, self.value[:, None] * y[self.row])
        return out

    def sums(self) -> tuple[np.ndarray, float]:
        return np.bincount(self.col, self.value, self.shape[1]), float((self.value**2).sum())


class Dense:
    def __init__(self, x: np.ndarray) -> None:
        self.x, self.shape = x, x.shape

    def times(self, q: np.ndarray) -> np.ndarray:
        return self.x @ q

    def transposed_times(self, y: np.ndarray) -> np.ndarray:
        return self.x.T @ y

    def sums(self) -> tuple[np.ndarray, float]:
        return self.x.sum(axis=0), float((self.x**2).sum())


def _rows(batch: pa.RecordBatch, width: int) -> Iterator[Dense | Sparse]:
    """A batch's rows, ``ROWS`` at a time: arrays, vectors (dense or sparse) or one column a feature."""
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        first = part.column(0)
        if pa.types.is_struct(first.type):
            yield from _vectors(first, width)
        elif pa.types.is_list(first.type):
            yield Dense(first.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width))
        else:
            yield Dense(np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in part.columns], axis=1))


def _vectors(column: pa.StructArray, width: int) -> Iterator[Dense | Sparse]:
    kind = column.field("type").to_numpy(zero_copy_only=False)
    for sparse in (False, True):
        some = column.filter(pa.array(kind == (0 if sparse else 1)))
        if not len(some):
            continue
        values = some.field("values")
        flat = values.flatten().to_numpy(zero_copy_only=False)
        if not sparse:
            yield Dense(flat.reshape(-1, width))
            continue
        sizes = np.diff(values.offsets.to_numpy())
        yield Sparse(np.repeat(np.arange(len(some)), sizes), some.field("indices").flatten().to_numpy(zero_copy_only=False).astype(np.int64),
                     flat, len(some), width)


def _by_block(total: np.ndarray) -> pa.RecordBatch:
    starts = range(0, len(total), BLOCK)
    return pa.RecordBatch.from_arrays([pa.array(list(range(len(starts))), pa.int32()),
                                       pa.array([total[a:a + BLOCK].tobytes() for a in starts], pa.binary())], names=["block", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the blocks; rows arrive block by block."""
    key, total = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "sums"])
    for batch in batches:
        for block, sums in zip(*(c.to_pylist() for c in batch.columns)):
            one = np.frombuffer(sums)
            if block == key:
                total = total + one
                continue
            if key is not None:
                yield out()
            key, total = block, one
    if key is not None:
        yield out()


def _summed(rows: DataFrame, scan, width: int, columns: int) -> np.ndarray:  # noqa: ANN001
    """``width`` x ``columns`` sums over all tasks, merged by block of columns."""
    parts = rows.mapInArrow(scan, "block int, sums binary")
    merged = parts.repartition("block").sortWithinPartitions("block").mapInArrow(_added, "block int, sums binary")
    out = np.zeros((width, columns))
    for r in merged.collect():
        at = r["block"] * BLOCK
        out[at:at + BLOCK] = np.frombuffer(r["sums"]).reshape(-1, columns)
    return out


def _qr_tree(rows: DataFrame, scan, size: int) -> np.ndarray:  # noqa: ANN001
    """R of the stacked factors of all tasks: tasks hand theirs to the square root
    of as many mergers, whose factors the driver stacks."""
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, size))
        for batch in batches:
            for one in batch.column(0).to_pylist():
                r = np.linalg.qr(np.concatenate([r, np.frombuffer(one).reshape(-1, size)]), mode="r")
        yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["r"])
    parts = rows.mapInArrow(scan, "part int, r binary")
    mergers = max(1, int(np.sqrt(rows.rdd.getNumPartitions())))
    merged = parts.repartition(mergers, "part").select("r").mapInArrow(merge, "r binary").collect()
    return np.linalg.qr(np.concatenate([np.frombuffer(m["r"]).reshape(-1, size) for m in merged]), mode="r")


def feature_rows(df: DataFrame, columns: Sequence[str] | str) -> tuple[DataFrame, int]:
    """(rows for the scans, number of features)."""
    if not isinstance(columns, str):
        return df.select(*[F.col(f"`{c}`").cast("double").alias(f"_{i}") for i, c in enumerate(columns)]), len(columns)
    if isinstance(df.schema[columns].dataType, VectorUDT):
        first = df.where(F.col(columns).isNotNull()).select(columns).first()
        return df.select(columns), len(first[0]) if first else 0
    width = df.select(F.max(F.size(columns))).first()[0] or 0
    return df.select(F.col(columns).cast("array<double>").alias("x")), width


def fit(df: DataFrame, columns: Sequence[str] | str, k: int, oversample: int = OVERSAMPLE, max_steps: int = MAX_STEPS,
        tolerance: float = TOLERANCE, exact_columns: int = EXACT_COLUMNS, seed: int = SEED) -> Principal:
    """The ``k`` directions of largest variance of numeric columns, of one array
    column or of one vector column (dense or sparse).

    A direction's sign makes its largest loading positive.  Nulls and NaN raise.
    """
    rows, width = feature_rows(df, columns)
    if not 0 < k <= width:
        raise ValueError(f"{k} components of {width} columns")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, squares, n = np.zeros(width), 0.0, 0
        for batch in batches:
            for x in _rows(batch, width):
                s, q = x.sums()
                total, squares, n = total + s, squares + q, n + x.shape[0]
        yield _by_block(np.concatenate([total, [squares, n]])[:, None])
    sums = _summed(rows, first, width + 2, 1)[:, 0]
    total, squares, n = sums[:width], sums[width], int(sums[width + 1])
    if not np.isfinite(sums).all():
        raise ValueError("principal components take no nulls, NaN or infinite values")
    if n < 2:
        raise ValueError("principal components take at least two rows")
    mean = total / n
    size = width if width <= exact_columns else min(width, n, k + oversample)
    q = np.eye(width) if size == width else np.linalg.qr(np.random.default_rng(seed).normal(size=(width, size)))[0]

    def projected(x: Dense | Sparse, q: np.ndarray) -> np.ndarray:
        return x.times(q) - mean @ q

    def power(q: np.ndarray):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((width, size))
            for batch in batches:
                for x in _rows(batch, width):
                    y = projected(x, q)
                    out += x.transposed_times(y) - np.outer(mean, y.sum(axis=0))
            yield _by_block(out)
        return run
    steps, before = 0, None
    while size < width and steps < max_steps:
        z = _summed(rows, power(q), width, size)
        found = np.sort(np.linalg.eigvalsh((q.T @ z + z.T @ q) / 2))[::-1][:k]
        q, steps = np.linalg.qr(z)[0], steps + 1
        if before is not None and np.abs(found - before).max() <= tolerance * max(found.max(), 1e-300):
            break
        before = found

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, size))
        for batch in batches:
            for x in _rows(batch, width):
                r = np.linalg.qr(np.concatenate([r, projected(x, q)]), mode="r")
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([r.tobytes()], pa.binary())],
                                         names=["part", "r"])
    _, s, w = np.linalg.svd(_qr_tree(rows, factor, size), full_matrices=False)
    s, w = np.r_[s, np.zeros(max(0, k - len(s)))][:k], w[:k].T
    components = q @ w
    components *= np.where(components[np.abs(components).argmax(axis=0), np.arange(components.shape[1])] < 0, -1.0, 1.0)
    variances = s**2 / (n - 1)
    whole = max(0.0, (squares - n * float(mean @ mean)) / (n - 1))
    return Principal(components, variances, variances / whole if whole > 0 else np.zeros(k), mean, n, steps)


def transform(df: DataFrame, columns: Sequence[str] | str, fitted: Principal, prefix: str = "pc") -> DataFrame:
    """``df`` with the projection of its rows, not centred, as columns ``<prefix>1, ...``."""
    rows, width = fitted.components, len(fitted.components)
    k = rows.shape[1]
    if not isinstance(columns, str):
        def along(j: int):  # noqa: ANN202
            total = F.lit(0.0)
            for c, v in zip(columns, rows[:, j]):
                total = total + F.col(f"`{c}`").cast("double") * F.lit(float(v))
            return total.alias(f"{prefix}{j + 1}")
        return df.select("*", *[along(j) for j in range(k)])
    shared = df.sparkSession.sparkContext.broadcast(rows)

    @F.arrow_udf("array<double>")
    def score(column: pa.Array) -> pa.Array:
        out = np.zeros((len(column), k))
        at = 0
        for x in _rows(pa.RecordBatch.from_arrays([column], names=["x"]), width):
            out[at:at + x.shape[0]] = x.times(shared.value)
            at += x.shape[0]
        return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, k, dtype=np.int32)), pa.array(out.ravel()))
    column = F.col(columns)
    if isinstance(df.schema[columns].dataType, VectorUDT):
        from pyspark.ml.functions import vector_to_array
        column = vector_to_array(column)  # rows keep their order
    scored = df.withColumn("__scored", score(column.cast("array<double>")))
    return scored.select("*", *[F.col("__scored")[j].alias(f"{prefix}{j + 1}") for j in range(k)]).drop("__scored")


# tasks get this module with the functions that use it, so a cluster needs no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])
