"""Centred co-moments of many columns as one mergeable state.

A state holds, for every pair of columns, the number of rows that have both,
the mean of each over those rows and their centred product sum.  Two states
merge elementwise (the pairwise update of means and sums of squares), so every
task makes one state a group from Arrow batches, and states of folds or
subsets add up to those of any union of them: one scan serves all fits.

Wide inputs are cut into blocks of columns; a state is then a table with one
row per pair of blocks, and no d x d matrix exists in any place.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 256              # columns of a block
TASK_BYTES = 256 << 20   # states that a task holds before it sends them on
COLLECT_COLUMNS = 4096   # most columns of a state that the driver takes
_STATE = "grp bigint, a int, b int, n binary, ma binary, mb binary, c binary"


@dataclass
class Moments:
    """Pairs of columns (rows of ``a`` with columns of ``b``): counts, means of
    either over the shared rows, centred product sums."""

    n: np.ndarray
    ma: np.ndarray
    mb: np.ndarray
    c: np.ndarray

    @staticmethod
    def of(x: np.ndarray, y: np.ndarray) -> Moments:
        """Of two batches of columns with the same rows; NaN is missing."""
        has_x, has_y = ~np.isnan(x), ~np.isnan(y)
        with np.errstate(invalid="ignore", divide="ignore"):
            cx = np.where(has_x.any(axis=0), np.where(has_x, x, 0.0).sum(axis=0) / np.maximum(has_x.sum(axis=0), 1), 0.0)
            cy = np.where(has_y.any(axis=0), np.where(has_y, y, 0.0).sum(axis=0) / np.maximum(has_y.sum(axis=0), 1), 0.0)
        zx, zy = np.where(has_x, x - cx, 0.0), np.where(has_y, y - cy, 0.0)
        n = has_x.T.astype(float) @ has_y.astype(float)
        sx, sy = zx.T @ has_y, has_x.T.astype(float) @ zy
        some = np.maximum(n, 1.0)
        return Moments(n, cx[:, None] + sx / some, cy[None, :] + sy / some, zx.T @ zy - sx * sy / some)

    def merge(self, other: Moments) -> Moments:
        n = self.n + other.n
        some = np.maximum(n, 1.0)
        da, db = other.ma - self.ma, other.mb - self.mb
        share = other.n / some
        # a side without rows has no mean of its own
        c = self.c + other.c + np.where((self.n > 0) & (other.n > 0), da * db * self.n * share, 0.0)
        ma = np.where(self.n == 0, other.ma, self.ma + da * share)
        mb = np.where(self.n == 0, other.mb, self.mb + db * share)
        return Moments(n, ma, mb, c)

    def without(self, part: Moments) -> Moments:
        """The state of the rows that are not in ``part``, which is in this state."""
        n = self.n - part.n
        some = np.maximum(n, 1.0)
        ma = np.where(n > 0, (self.n * self.ma - part.n * part.ma) / some, 0.0)
        mb = np.where(n > 0, (self.n * self.mb - part.n * part.mb) / some, 0.0)
        c = self.c - part.c - np.where(n > 0, (ma - part.ma) * (mb - part.mb) * n * part.n / np.maximum(self.n, 1.0), 0.0)
        return Moments(n, ma, mb, np.where(n > 0, c, 0.0))

    def correlation(self, da: np.ndarray, db: np.ndarray) -> np.ndarray:
        """Correlations, ``da`` and ``db`` being the columns' sums of squares over the
        shared rows; NaN where a column does not vary."""
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.clip(np.where((da > 0) & (db > 0), self.c / np.sqrt(da * db), np.nan), -1.0, 1.0)


def _blocks(width: int) -> list[tuple[int, int]]:
    return [(a, min(a + BLOCK, width)) for a in range(0, width, BLOCK)]


def _sent(states: dict[tuple[int, int, int], Moments]) -> pa.RecordBatch:
    keys = list(states)
    cols = [[getattr(states[k], f).tobytes() for k in keys] for f in ("n", "ma", "mb", "c")]
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.int64()), *[pa.array([k[i] for k in keys], pa.int32()) for i in (1, 2)],
         *[pa.array(c, pa.binary()) for c in cols]], names=["grp", "a", "b", "n", "ma", "mb", "c"])


def _scan(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    blocks, states = _blocks(width), {}
    each = 32 * min(width, BLOCK) ** 2
    for batch in batches:
        groups = batch.column(0).to_numpy()
        if batch.num_columns == 2 and pa.types.is_list(batch.column(1).type):
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        else:
            x = np.stack([batch.column(1 + i).to_numpy(zero_copy_only=False).astype(float) for i in range(width)], axis=1)
        for g in np.unique(groups):
            rows = x[groups == g]
            for i, (a0, a1) in enumerate(blocks):
                for j, (b0, b1) in enumerate(blocks[i:], i):
                    key, new = (int(g), i, j), Moments.of(rows[:, a0:a1], rows[:, b0:b1])
                    states[key] = states[key].merge(new) if key in states else new
                    if len(states) * each > TASK_BYTES:
                        yield _sent(states)
                        states = {}
    if states:
        yield _sent(states)


def _moments(n: bytes, ma: bytes, mb: bytes, c: bytes, rows: int, cols: int) -> Moments:
    return Moments(*(np.frombuffer(v).reshape(rows, cols) for v in (n, ma, mb, c)))


def _merge(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by (group, block pair)."""
    blocks, key, state = _blocks(width), None, None
    for batch in batches:
        for grp, a, b, *parts in zip(*(c.to_pylist() for c in batch.columns)):
            one = _moments(*parts, blocks[a][1] - blocks[a][0], blocks[b][1] - blocks[b][0])
            if key == (grp, a, b):
                state = state.merge(one)
                continue
            if key:
                yield _sent({key: state})
            key, state = (grp, a, b), one
    if key:
        yield _sent({key: state})


def block_states(df: DataFrame, columns: Sequence[Column], group: Column | None = None) -> DataFrame:
    """One merged state per group (bigint) and pair of column blocks, from one scan."""
    numbers = [F.when(~F.isnan(c.cast("double")), c.cast("double")).alias(f"_{i}") for i, c in enumerate(columns)]
    rows = df.select((F.lit(0) if group is None else group).cast("bigint").alias("grp"), *numbers)
    return merged_states(rows, len(numbers))


def merged_states(rows: DataFrame, width: int) -> DataFrame:
    """As ``block_states``, of rows (grp, column, ...) or (grp, one array of ``width`` doubles)."""
    parts = rows.where(F.col("grp").isNotNull()).mapInArrow(lambda b: _scan(b, width), _STATE)
    return (parts.repartition("grp", "a", "b").sortWithinPartitions("grp", "a", "b")
            .mapInArrow(lambda b: _merge(b, width), _STATE))


def group_moments(df: DataFrame, columns: Sequence[Column], group: Column | None = None) -> dict[int, Moments]:
    """The full state of every group, on the driver: at most ``COLLECT_COLUMNS`` columns."""
    width = len(columns)
    if width > COLLECT_COLUMNS:
        raise ValueError(f"{width} columns; at most {COLLECT_COLUMNS} fit one state")
    blocks, out = _blocks(width), {}
    for r in block_states(df, columns, group).collect():
        g = out.setdefault(r["grp"], Moments(*(np.zeros((width, width)) for _ in range(4))))
        (a0, a1), (b0, b1) = blocks[r["a"]], blocks[r["b"]]
        one = _moments(r["n"], r["ma"], r["mb"], r["c"], a1 - a0, b1 - b0)
        for name, flipped in (("n", one.n), ("ma", one.mb), ("mb", one.ma), ("c", one.c)):
            getattr(g, name)[b0:b1, a0:a1] = flipped.T
            getattr(g, name)[a0:a1, b0:b1] = getattr(one, name)
    return out


def merged(states: Sequence[Moments]) -> Moments:
    return reduce(Moments.merge, states)


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(col_a, col_b, corr): Pearson over the rows that have both columns, both
    orders and the diagonal (1).  Made block by block in Spark, so any number of
    columns works.  NaN counts as missing."""
    names = list(columns)
    width, blocks = len(names), _blocks(len(names))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per pair of blocks also the sums of squares over the shared rows: those of
        x with x weighted by where y is, which the squares' co-moments give."""
        for batch in batches:
            x = np.stack([batch.column(1 + i).to_numpy(zero_copy_only=False).astype(float) for i in range(width)], axis=1)
            has = ~np.isnan(x)
            mid = np.where(has, x, 0.0).sum(axis=0) / np.maximum(has.sum(axis=0), 1)
            z = np.where(has, x - mid, 0.0)
            for i, (a0, a1) in enumerate(blocks):
                for j, (b0, b1) in enumerate(blocks[i:], i):
                    m = Moments.of(x[:, a0:a1], x[:, b0:b1])
                    n = np.maximum(m.n, 1.0)
                    qa = (z[:, a0:a1] ** 2).T @ has[:, b0:b1] - n * (m.ma - mid[a0:a1, None]) ** 2 * (m.n > 0)
                    qb = has[:, a0:a1].T.astype(float) @ (z[:, b0:b1] ** 2) - n * (m.mb - mid[None, b0:b1]) ** 2 * (m.n > 0)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i], pa.int32()), pa.array([j], pa.int32()),
                         *[pa.array([v.tobytes()], pa.binary()) for v in (m.n, m.ma, m.mb, m.c, qa, qb)]],
                        names=["a", "b", "n", "ma", "mb", "c", "qa", "qb"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, qa, qb = None, None, None, None

        def rows() -> pa.RecordBatch:
            (a0, a1), (b0, b1) = blocks[key[0]], blocks[key[1]]
            r = state.correlation(qa, qb)
            i, j = np.meshgrid(np.arange(a0, a1), np.arange(b0, b1), indexing="ij")
            i, j, r = i.ravel(), j.ravel(), r.ravel()
            if key[0] != key[1]:
                i, j, r = np.r_[i, j], np.r_[j, i], np.r_[r, r]
            r = np.where(i == j, 1.0, r)
            return pa.RecordBatch.from_arrays([pa.array([names[k] for k in i]), pa.array([names[k] for k in j]),
                                               pa.array(r, pa.float64(), mask=np.isnan(r))], names=["col_a", "col_b", "corr"])
        for batch in batches:
            for a, b, *parts in zip(*(c.to_pylist() for c in batch.columns)):
                shape = (blocks[a][1] - blocks[a][0], blocks[b][1] - blocks[b][0])
                one = _moments(*parts[:4], *shape)
                oa, ob = (np.frombuffer(v).reshape(shape) for v in parts[4:])
                if key == (a, b):
                    w = np.where((state.n > 0) & (one.n > 0), state.n * one.n / np.maximum(state.n + one.n, 1.0), 0.0)
                    qa, qb = qa + oa + w * (one.ma - state.ma) ** 2, qb + ob + w * (one.mb - state.mb) ** 2
                    state = state.merge(one)
                    continue
                if key:
                    yield rows()
                key, state, qa, qb = (a, b), one, oa, ob
        if key:
            yield rows()
    numbers = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(f"_{i}") for i, c in enumerate(names)]
    parts = df.select(F.lit(0).alias("grp"), *numbers).mapInArrow(
        scan, "a int, b int, n binary, ma binary, mb binary, c binary, qa binary, qb binary")
    return parts.repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(finish, "col_a string, col_b string, corr double")


# tasks get this module with the functions that use it, so a cluster needs no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])
