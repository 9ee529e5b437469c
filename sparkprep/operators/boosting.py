"""Gradient boosted trees on quantile-coded features (EST-3, EST-6).

Features are coded once into quantile bins, nulls (NaN) into a bin of their
own.  Every level of a round's trees takes one aggregate of the table: first
and second derivatives of the loss, summed by (node, feature, bin).  A split
sends nulls to the side that gains more.  Several classes grow one tree each
per round under a softmax.

Rows of equal codes have equal margins, so they are one weighted row wherever that
at least halves the table (exact but for the rounding of sums; not where rows are
drawn).  Codes and margins live in a table under the shared checkpoint folder, which
is written anew every ``REFRESH`` rounds; in between a task adds the newest
trees to the margins it reads, so a lost executor costs one level's work.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasPredictionCol, HasProbabilityCol, HasSeed, HasStepSize
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep.functions.materialize import materialize

MISSING = 255           # code of a null; bins are 0..253
MAX_BINS = 254
ACCURACY = 10_000       # of the quantiles: rank error at most rows / ACCURACY
EQUAL = 1e-9            # gains are equal up to this share
REFRESH = 10            # rounds between two writes of the margins
TASK_BYTES = 4 << 20    # codes and margins that one task should read
COLLECT_BYTES = 64 << 20  # partial sums of a level that the driver adds up itself
ALONE_BYTES = 16 << 20  # a table of at most this is one task's
BLOCK = 1 << 16           # rows that are summed at a time
KEPT_BYTES = 256 << 20    # sums of a level that one task keeps for the next
SPLIT_CELLS = 1 << 16     # cells that are searched for splits at a time


@dataclass
class Tree:
    """Nodes as parallel lists; a leaf has feature -1.  A row goes left when its
    value is below the threshold (its code below ``code``), or is null and
    ``null_left``."""

    feature: list[int] = field(default_factory=list)
    code: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    null_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)

    def add(self, value: float, cover: float) -> int:
        for name, v in (("feature", -1), ("code", 0), ("threshold", 0.0), ("null_left", False), ("left", -1), ("right", -1),
                        ("value", value), ("gain", 0.0), ("cover", cover)):
            getattr(self, name).append(v)
        return len(self.feature) - 1

    def leaves(self, x: np.ndarray, coded: bool) -> np.ndarray:
        """Node that every row ends in (``coded``: rows are bin codes, else values)."""
        feature, left, right = (np.array(a, np.int64) for a in (self.feature, self.left, self.right))
        null_left = np.array(self.null_left, bool)
        border = np.array(self.code if coded else self.threshold, np.int64 if coded else np.float64)
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while len(rows):
            rows = rows[feature[node[rows]] >= 0]
            at = node[rows]
            v = x[rows, feature[at]]
            null = v == MISSING if coded else np.isnan(v)
            node[rows] = np.where(np.where(null, null_left[at], v < border[at]), left[at], right[at])
        return node

    def step(self, codes: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Nodes one level below ``node`` (itself where that is a leaf) of rows given
        as bin codes, features x rows."""
        feature, left, right = (np.array(a, np.int32) for a in (self.feature, self.left, self.right))
        inner = feature >= 0
        if not inner.any():
            return node
        leaf = np.arange(len(feature), dtype=np.int32)
        left, right = np.where(inner, left, leaf), np.where(inner, right, leaf)
        v = codes[np.where(inner, feature, 0)[node], np.arange(len(node))]
        go_left = np.where(v == MISSING, np.array(self.null_left, bool)[node], v < np.array(self.code, np.int32)[node])
        return np.where(go_left, left[node], right[node])

    def margin(self, x: np.ndarray, coded: bool = False) -> np.ndarray:
        return np.array(self.value)[self.leaves(x, coded)]


def gradients(objective: str, margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss by margin, rows x trees of a round."""
    if objective == "squared":
        return margin - y[:, None], np.ones_like(margin)
    p = probabilities(objective, margin)
    if objective == "logistic":
        p = p[:, 1:]
        return p - y[:, None], p * (1 - p)
    g = p.copy()
    g[np.arange(len(y)), y.astype(np.int64)] -= 1.0
    return g, p * (1 - p)


def probabilities(objective: str, margin: np.ndarray) -> np.ndarray:
    """Of every class; a squared loss gives the value itself."""
    if objective == "squared":
        return margin
    if objective == "logistic":
        p = 0.5 * (1.0 + np.tanh(0.5 * margin[:, 0]))
        return np.stack([1.0 - p, p], axis=1)
    e = np.exp(margin - margin.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


# -- bins ------------------------------------------------------------------------

def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def feature_cuts(rows: DataFrame, width: int, bins: int, accuracy: int = ACCURACY) -> list[np.ndarray]:
    """Ascending thresholds of every feature of ``rows`` (x array<double>).

    A feature of at most ``bins`` distinct values is cut at each of them but
    the least; any other at its j/bins quantiles.  Tasks send their distinct
    values only while they are that few, so what is collected is bounded by
    the bins; quantile sketches are taken of the other features alone.
    """
    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray | None] = [np.zeros(0)] * width
        for batch in batches:
            x = _matrix(batch.column(0), width)
            for f in range(width):
                if seen[f] is not None:
                    v = x[:, f]
                    both = np.unique(np.concatenate([seen[f], v[~np.isnan(v)]]))
                    seen[f] = both if len(both) <= bins else None
        f = np.repeat(np.arange(width), [1 if s is None else len(s) for s in seen])
        v = [x for s in seen for x in ([None] if s is None else s.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(f.astype(np.int32)), pa.array(v, pa.float64())], names=["f", "v"])
    found = materialize(rows.select("x").mapInArrow(distinct, "f int, v double").distinct(), "values")
    sizes = found.groupBy("f").agg(F.count("v").alias("n"), F.max(F.col("v").isNull()).alias("many"))
    small = sizes.where((F.col("n") <= bins) & ~F.col("many")).select("f")
    cuts: list[np.ndarray] = [np.zeros(0)] * width
    values: dict[int, list[float]] = {}
    for r in found.join(F.broadcast(small), "f").collect():
        values.setdefault(r["f"], []).append(r["v"])
    for f, v in values.items():
        cuts[f] = np.sort(np.array(v))[1:]
    many = [r["f"] for r in sizes.where((F.col("n") > bins) | F.col("many")).select("f").collect()]
    if many:
        shares = [j / bins for j in range(1, bins)]
        picked = F.filter(F.transform("x", lambda x, i: F.struct(i.alias("f"), x.alias("v"))),
                          lambda s: s["f"].isin(many) & ~F.isnan(s["v"]))
        long = rows.select(F.explode(picked).alias("s")).select("s.f", "s.v")
        for r in long.groupBy("f").agg(F.percentile_approx("v", shares, accuracy).alias("q")).collect():
            cuts[r["f"]] = np.unique(np.array(r["q"]))
    return cuts


def coded(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Number of thresholds at or below each value; ``MISSING`` for NaN."""
    out = np.empty(x.shape, np.uint8)
    for f, c in enumerate(cuts):
        out[:, f] = np.searchsorted(c, x[:, f], "right")
    out[np.isnan(x)] = MISSING
    return out


# -- histograms and splits ----------------------------------------------------------

@dataclass
class Level:
    """What a task needs to sum one level: trees not yet in the margins, the trees
    being grown, and for each of them the slot of every open node."""

    objective: str
    done: list[list[Tree]]
    growing: list[Tree]
    slots: list[np.ndarray]
    n_slots: int
    starts: np.ndarray      # first cell of every feature
    sizes: np.ndarray       # bins of every feature, without that of nulls
    cells: int
    sample: float
    seed: tuple[int, int]   # seed, round

    def margins(self, codes: np.ndarray, margin: np.ndarray) -> np.ndarray:
        """Margins with the trees that are not yet in them."""
        return margin + sum((np.stack([t.margin(codes, True) for t in r], axis=1) for r in self.done), np.zeros(1))

    def derivatives(self, codes: np.ndarray, y: np.ndarray, margin: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        g, h = gradients(self.objective, self.margins(codes, margin), y)
        return g * weight[:, None], h * weight[:, None]

    def placed(self, codes: np.ndarray) -> np.ndarray:
        """Codes, features x rows, with nulls in the bin after the last."""
        return np.ascontiguousarray(np.where(codes == MISSING, self.sizes[:, None].astype(np.uint8), codes))

    def drawn(self, rng: np.random.Generator, n: int) -> np.ndarray:
        return rng.random(n) < self.sample if self.sample < 1 else np.ones(n, bool)

    def add(self, total: list[np.ndarray], codes: np.ndarray, placed: np.ndarray, drawn: np.ndarray, g: np.ndarray, h: np.ndarray) -> None:
        """Adds the derivatives of some rows to the sums, slots x cells."""
        both = [t.reshape(self.n_slots, self.cells) for t in total]
        for k, tree in enumerate(self.growing):
            some = self.slots[k][self.slots[k] >= 0]
            if len(some):  # the slots of a tree are neighbours
                slot = self.slots[k][tree.leaves(codes, True)]
                own = slice(some.min(), some.max() + 1)
                self.sum_rows(*(t[own] for t in both), placed, np.where((slot >= 0) & drawn, slot - own.start, -1), g[:, k], h[:, k])

    def sum_rows(self, total_g: np.ndarray, total_h: np.ndarray, placed: np.ndarray, slot: np.ndarray, g: np.ndarray, h: np.ndarray) -> None:
        """Adds rows to the sums (nodes x cells) of the node ``slot``, -1: of none.
        The cells of one feature are few enough to stay in the cache."""
        rows = np.flatnonzero(slot >= 0)
        whole = len(rows) == len(slot)
        if not whole:
            slot, g, h = slot[rows], g[rows], h[rows]
        g, h, slot, n = np.ascontiguousarray(g), np.ascontiguousarray(h), slot.astype(np.intp), len(total_g)
        for start, size, code in zip(self.starts.tolist(), (self.sizes + 1).tolist(), placed):
            cell = slot * size + (code if whole else code[rows])
            for total, part in ((total_g, g), (total_h, h)):
                total[:, start:start + size] += np.bincount(cell, part, n * size).reshape(n, size)

    def empty(self) -> list[np.ndarray]:
        return [np.zeros(self.n_slots * self.cells), np.zeros(self.n_slots * self.cells)]

    def draws(self, part: int) -> np.random.Generator:
        return np.random.Generator(np.random.PCG64([*self.seed, part]))


@dataclass
class Settings:
    """How the trees grow."""

    objective: str
    n_trees: int
    rounds: int = 100
    rate: float = 0.1
    depth: int = 6
    lam: float = 1.0
    gamma: float = 0.0
    least: float = 1.0
    sample: float = 1.0
    columns: float = 1.0
    seed: int = 42


def _batch(batch: pa.RecordBatch, width: int, trees: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, labels, margins and weights of a batch."""
    def raw(column: pa.Array, kind: type, n: int) -> np.ndarray:
        buffer = b"".join(column.to_pylist())
        return np.frombuffer(buffer, kind).reshape(batch.num_rows, n)
    return raw(batch.column(0), np.uint8, width), batch.column(1).to_numpy(), raw(batch.column(2), np.float64, trees), batch.column(3).to_numpy()


def _sums(batches: Iterator[pa.RecordBatch], level: Level) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(g, h) of a task, slots x cells."""
    total, rng = level.empty(), level.draws(TaskContext.get().partitionId())
    for batch in batches:
        codes, y, margin, weight = _batch(batch, len(level.starts), len(level.growing))
        level.add(total, codes, level.placed(codes.T), level.drawn(rng, len(y)), *level.derivatives(codes, y, margin, weight))
    yield total[0], total[1]


def _packed(batches: Iterator[pa.RecordBatch], level: Level) -> Iterator[pa.RecordBatch]:
    for g, h in _sums(batches, level):
        some = np.flatnonzero(h)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (some, g[some], h[some])],
                                         names=["cell", "g", "h"])


def _by_feature(batches: Iterator[pa.RecordBatch], level: Level) -> Iterator[pa.RecordBatch]:
    """The sums of a task as one row per (slot, feature), for merging by Spark."""
    for total in _sums(batches, level):
        g, h = (t.reshape(level.n_slots, level.cells) for t in total)
        for s in range(level.n_slots):
            parts = [(s, f, g[s, a:a + n + 1].tobytes(), h[s, a:a + n + 1].tobytes())
                     for f, (a, n) in enumerate(zip(level.starts.tolist(), level.sizes.tolist())) if h[s, a:a + n + 1].any()]
            cols = list(zip(*parts)) if parts else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()),
                                              pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())],
                                             names=["slot", "f", "g", "h"])


@dataclass
class Split:
    """The best split of a node: its sums, and the sums of the left side."""

    g: float
    h: float
    gain: float = 0.0
    feature: int = -1
    bin: int = -1
    null_left: bool = False
    left_g: float = 0.0
    left_h: float = 0.0


def best_splits(g: np.ndarray, h: np.ndarray, starts: np.ndarray, sizes: np.ndarray, p: Settings, allowed: np.ndarray) -> list[Split]:
    """Best of all splits of every node from its sums (nodes x cells).  Ties (up
    to ``EQUAL``, so that the order of sums does not decide) go to the first
    feature, then to nulls on the right, then to the lowest bin.

    gain = (GL^2/(HL+lam) + GR^2/(HR+lam) - G^2/(H+lam)) / 2 - gamma, with at
    least ``least`` of H on both sides.
    """
    most = int(sizes.max())
    place = np.arange(most)
    inside = place[None, :] < sizes[:, None]
    at = np.where(inside, starts[:, None] + place[None, :], 0)
    usable = inside & allowed[:, None]
    even, open_ = bool(inside.all()) and len(g[0]) == len(starts) * (most + 1), bool(usable.all())
    chunk = max(1, SPLIT_CELLS // at.size)
    out: list[Split] = []

    def by_bin(x: np.ndarray) -> np.ndarray:
        return x.reshape(len(x), len(starts), most + 1)[:, :, :most] if even else np.where(inside, x[:, at], 0.0)
    for i in range(0, len(g), chunk):
        gs, hs = g[i:i + chunk], h[i:i + chunk]
        first = slice(int(starts[0]), int(starts[0] + sizes[0] + 1))
        total_g, total_h = gs[:, first].sum(axis=1), hs[:, first].sum(axis=1)
        null_g, null_h = gs[:, starts + sizes], hs[:, starts + sizes]
        whole = np.where(total_h + p.lam > 0, total_g**2 / np.maximum(total_h + p.lam, 1e-300), 0.0)
        # nodes x features x (nulls right, left) x bins
        left_g, left_h = (np.cumsum(by_bin(x), axis=2)[:, :, None] for x in (gs, hs))
        sides = 2 if (null_h > 0).any() else 1
        if sides == 2:
            left_g = np.concatenate([left_g, left_g + null_g[:, :, None, None]], axis=2)
            left_h = np.concatenate([left_h, left_h + null_h[:, :, None, None]], axis=2)
        right_g, right_h = total_g[:, None, None, None] - left_g, total_h[:, None, None, None] - left_h
        good = (left_h >= p.least) & (right_h >= p.least)
        if p.least <= 1e-12 * total_h.max(initial=0.0):
            good &= (left_h > 0) & (right_h > 1e-12 * total_h[:, None, None, None])
        if not open_:
            good &= usable[None, :, None, :]
        if sides == 2:
            good[:, :, 1] &= (null_h > 0)[:, :, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left_g * left_g
            gain /= left_h + p.lam
            right_g *= right_g
            right_h += p.lam
            right_g /= right_h
            gain += right_g
            gain -= whole[:, None, None, None]
            gain *= 0.5
            gain -= p.gamma
        gain[~good] = -np.inf
        gain = gain.reshape(len(gs), -1)
        top = gain.max(axis=1)
        pick = (gain >= np.where(np.isfinite(top), top - EQUAL * np.abs(top), np.inf)[:, None]).argmax(axis=1)
        f, side, b = np.unravel_index(pick, (len(starts), sides, most))
        for n in range(len(gs)):
            s = Split(float(total_g[n]), float(total_h[n]))
            if top[n] > EQUAL * whole[n] and top[n] > 0:
                s = Split(s.g, s.h, float(gain[n, pick[n]]), int(f[n]), int(b[n]), bool(side[n]),
                          float(left_g[n, f[n], side[n], b[n]]), float(left_h[n, f[n], side[n], b[n]]))
            out.append(s)
    return out


def _merged(batches: Iterator[pa.RecordBatch], sizes: np.ndarray, p: Settings, allowed: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Best split of every (slot, feature); rows arrive sorted by both."""
    key, sums = None, [np.zeros(0), np.zeros(0)]

    def found() -> pa.RecordBatch:
        slot, f = key
        g, h = sums
        s = best_splits(g[None], h[None], np.zeros(1, np.int64), sizes[f:f + 1], p, allowed[f:f + 1])[0]
        return pa.RecordBatch.from_arrays(
            [pa.array([slot], pa.int32()), pa.array([f], pa.int32()), pa.array([s.gain if s.feature >= 0 else -1.0]), pa.array([s.bin], pa.int32()),
             pa.array([s.null_left]), pa.array([s.left_g]), pa.array([s.left_h]), pa.array([s.g]), pa.array([s.h])],
            names=["slot", "f", "gain", "bin", "null_left", "left_g", "left_h", "g", "h"])
    for batch in batches:
        for slot, f, g, h in zip(*(c.to_pylist() for c in batch.columns)):
            if key != (slot, f):
                if key:
                    yield found()
                key, sums = (slot, f), [np.zeros(len(g) // 8), np.zeros(len(h) // 8)]
            sums = [a + np.frombuffer(b) for a, b in zip(sums, (g, h))]
    if key:
        yield found()


class SpreadRows:
    """The coded table, level by level: one job each."""

    def __init__(self, table: DataFrame, settings: Settings, collect_bytes: int) -> None:
        self.table, self.settings, self.collect_bytes = table, settings, collect_bytes
        self.tasks = table.rdd.getNumPartitions()

    def splits(self, level: Level, allowed: np.ndarray) -> list[Split | None]:
        """The best split of every open node, from one aggregate of the table.

        While the partial sums of all tasks are small the driver adds them up; else
        Spark merges them by (node, feature) and the driver sees one row per node.
        """
        p, sizes = self.settings, level.sizes
        if self.tasks * level.n_slots * level.cells * 24 <= self.collect_bytes:
            total = level.empty()
            for r in self.table.mapInArrow(lambda b: _packed(b, level), "cell binary, g binary, h binary").collect():
                cell = np.frombuffer(r["cell"], np.int64)
                total[0][cell] += np.frombuffer(r["g"])
                total[1][cell] += np.frombuffer(r["h"])
            return _best_splits(total, level, p, allowed)
        parts = self.table.mapInArrow(lambda b: _by_feature(b, level), "slot int, f int, g binary, h binary")
        each = parts.repartition("slot", "f").sortWithinPartitions("slot", "f").mapInArrow(
            lambda b: _merged(b, sizes, p, allowed),
            "slot int, f int, gain double, bin int, null_left boolean, left_g double, left_h double, g double, h double")
        best = each.groupBy("slot").agg(F.max(F.struct("gain", (-F.col("f")).alias("first"), "bin", "null_left", "left_g", "left_h", "g", "h")).alias("s"))
        out: list[Split | None] = [None] * level.n_slots
        for r in best.collect():
            s = r["s"]
            out[r["slot"]] = (Split(s["g"], s["h"], s["gain"], -s["first"], s["bin"], s["null_left"], s["left_g"], s["left_h"])
                              if s["gain"] > 0 else Split(s["g"], s["h"]))
        return out

    def advance(self, done: list[list[Tree]]) -> None:
        """Writes the table anew with the trees in its margins."""
        width_trees = self.settings.n_trees

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                width = len(batch.column(0)[0].as_py()) if batch.num_rows else 0
                codes, _, margin, _ = _batch(batch, width, width_trees)
                margin = margin + sum((np.stack([t.margin(codes, True) for t in r], axis=1) for r in done), np.zeros(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([m.tobytes() for m in margin], pa.binary()),
                                                  batch.column(3)], names=["codes", "label", "margin", "weight"])
        self.table = materialize(self.table.mapInArrow(run, _CODED), "margins")


class HeldRows:
    """The same for rows of one task, which needs no job a level: every level moves
    each row one node down and sums the rows tree by tree.  Of two children only the
    one of fewer rows is summed; the other has what that leaves of their parent."""

    def __init__(self, codes: np.ndarray, y: np.ndarray, margin: np.ndarray, weight: np.ndarray, settings: Settings) -> None:
        self.codes, self.y, self.margin, self.weight, self.settings = np.ascontiguousarray(codes.T), y, margin, weight, settings
        self.placed = None
        self.round = None
        self.nodes = np.zeros((margin.shape[1], len(y)), np.int32)
        self.known = np.zeros((2, margin.shape[1], len(y)))  # derivatives
        self.kept: list[dict[int, tuple[np.ndarray, np.ndarray]]] = []  # sums of the level above, by tree and node

    def _blocks(self) -> Iterator[slice]:
        return (slice(i, i + BLOCK) for i in range(0, len(self.y), BLOCK))

    def splits(self, level: Level, allowed: np.ndarray) -> list[Split | None]:
        if self.placed is None:
            self.placed = level.placed(self.codes) if (self.codes == MISSING).any() else self.codes
        if self.round != level.seed:  # the levels of a round share derivatives and drawn rows
            self.round = level.seed
            self.nodes[:] = 0
            self.kept = [{} for _ in level.growing]
            drawn = level.drawn(level.draws(0), len(self.y))
            for rows in self._blocks():
                for known, d in zip(self.known, gradients(level.objective, self.margin[rows], self.y[rows])):
                    known[:, rows] = np.where(drawn[rows], d.T * self.weight[rows], 0.0)
        out: list[Split | None] = [None] * level.n_slots
        keep = 16 * level.n_slots * level.cells <= KEPT_BYTES
        for k, slots in enumerate(level.slots):
            nodes = np.flatnonzero(slots >= 0)
            if len(nodes):
                g, h = self._sums(k, nodes, level)
                self.kept[k] = dict(zip(nodes.tolist(), zip(g, h))) if keep else {}
                for s, found in zip(slots[nodes].tolist(), best_splits(g, h, level.starts, level.sizes, self.settings, allowed)):
                    out[s] = found
        return out

    def _sums(self, k: int, nodes: np.ndarray, level: Level) -> tuple[np.ndarray, np.ndarray]:
        """(g, h) of the open nodes of a tree, nodes x cells."""
        tree = level.growing[k]
        for rows in self._blocks():
            self.nodes[k, rows] = tree.step(self.codes[:, rows], self.nodes[k, rows])
        n_rows = np.bincount(self.nodes[k], minlength=len(tree.feature))
        pairs = {child: (up, a + b - child) for up, (a, b) in enumerate(zip(tree.left, tree.right)) if a >= 0 for child in (a, b)}
        rest = {}  # nodes that are what a sibling leaves of their parent
        for node in nodes.tolist():
            up, other = pairs.get(node, (-1, -1))
            if up in self.kept[k] and (n_rows[other], other) < (n_rows[node], node):
                rest[node] = (up, other)
        summed = sorted({*nodes.tolist(), *(other for _, other in rest.values())} - {*rest})
        local = np.full(len(tree.feature), -1)
        local[summed] = np.arange(len(summed))
        some = [np.zeros((len(summed), level.cells)) for _ in range(2)]
        for rows in self._blocks():
            level.sum_rows(*some, self.placed[:, rows], local[self.nodes[k, rows]], *self.known[:, k, rows])
        if not rest and len(summed) == len(nodes):
            return some[0], some[1]
        out = [np.empty((len(nodes), level.cells)) for _ in range(2)]
        for i, node in enumerate(nodes.tolist()):
            for j in range(2):
                if node in rest:
                    up, other = rest[node]
                    np.subtract(self.kept[k][up][j], some[j][local[other]], out=out[j][i])
                else:
                    out[j][i] = some[j][local[node]]
        return out[0], out[1]

    def advance(self, done: list[list[Tree]]) -> None:
        """Takes in the trees of one round, whose nodes the rows know but for the last level."""
        (trees,) = done
        for rows in self._blocks():
            for k, tree in enumerate(trees):
                self.margin[rows, k] += np.array(tree.value)[tree.step(self.codes[:, rows], self.nodes[k, rows])]


_CODED = "codes binary, label double, margin binary, weight double"


def _best_splits(total: list[np.ndarray], level: Level, p: Settings, allowed: np.ndarray) -> list[Split | None]:
    g, h = (t.reshape(level.n_slots, level.cells) for t in total)
    return best_splits(g, h, level.starts, level.sizes, p, allowed)


# -- training ---------------------------------------------------------------------

def grow(rows: SpreadRows | HeldRows, cuts: list[np.ndarray], p: Settings, refresh: int) -> list[list[Tree]]:
    """Rounds of trees, level by level; the rows take in the trees every ``refresh`` rounds."""
    width = len(cuts)
    sizes = np.array([len(c) + 1 for c in cuts], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    rng = np.random.Generator(np.random.PCG64(p.seed))
    finished: list[list[Tree]] = []
    fresh: list[list[Tree]] = []
    for number in range(p.rounds):
        trees = [Tree() for _ in range(p.n_trees)]
        open_ = [(k, t.add(0.0, 0.0)) for k, t in enumerate(trees)]
        allowed = np.ones(width, bool)
        if p.columns < 1:
            allowed[:] = False
            allowed[rng.choice(width, max(1, round(p.columns * width)), replace=False)] = True
        for _ in range(p.depth):
            slots = [np.full(len(t.feature), -1) for t in trees]
            for s, (k, node) in enumerate(open_):
                slots[k][node] = s
            level = Level(p.objective, fresh, trees, slots, len(open_), starts, sizes, int((sizes + 1).sum()), p.sample, (p.seed, number))
            below = []
            for (k, node), s in zip(open_, rows.splits(level, allowed)):
                if s is None:
                    continue
                tree = trees[k]
                tree.cover[node], tree.value[node] = s.h, -p.rate * s.g / (s.h + p.lam) if s.h + p.lam > 0 else 0.0
                if s.feature < 0:
                    continue
                c = cuts[s.feature]
                tree.feature[node], tree.code[node], tree.null_left[node], tree.gain[node] = s.feature, s.bin + 1, s.null_left, s.gain
                tree.threshold[node] = float(c[s.bin]) if s.bin < len(c) else float("inf")
                for side, (g, h) in (("left", (s.left_g, s.left_h)), ("right", (s.g - s.left_g, s.h - s.left_h))):
                    child = tree.add(-p.rate * g / (h + p.lam), h)
                    getattr(tree, side)[node] = child
                    if h >= 2 * p.least:
                        below.append((k, child))
            open_ = below
            if not open_:
                break
        finished.append(trees)
        fresh.append(trees)
        if all(len(t.feature) == 1 for t in trees) and p.sample >= 1 and p.columns >= 1 and all(abs(t.value[0]) < 1e-12 for t in trees):
            break  # neither a split nor a constant is left to gain
        if len(fresh) == refresh and number + 1 < p.rounds:
            rows.advance(fresh)
            fresh = []
    return finished


def boost(rows: DataFrame, settings: Settings, bins: int = MAX_BINS, collect_bytes: int = COLLECT_BYTES, task_bytes: int = TASK_BYTES,
          alone: bool = True, alone_bytes: int = ALONE_BYTES) -> dict:
    """Fits trees to ``rows`` (x array<double>, NaN for null; label double) and
    returns the model as plain values: objective, base margin, rounds of trees.

    ``settings.n_trees``: trees a round (classes of a softmax, else 1).  A squared
    loss starts from the mean label, the others from margin 0.  A coded table of
    at most ``alone_bytes`` is one task's: unless ``alone`` is off, that task grows
    all rounds in one job, for there is nothing to merge between levels.
    """
    if not 2 <= bins <= MAX_BINS:
        raise ValueError(f"bins must be 2..{MAX_BINS}")
    objective, n_trees = settings.objective, settings.n_trees
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("width"), F.avg("label").alias("mean")).first()
    if not facts["n"]:
        raise ValueError("no training rows")
    width = facts["width"]
    base = float(facts["mean"]) if objective == "squared" else 0.0
    cuts = feature_cuts(rows, width, bins)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = np.full(n_trees, base).tobytes()
        for batch in batches:
            codes = coded(_matrix(batch.column(0), width), cuts)
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes() for c in codes], pa.binary()), batch.column(1),
                                              pa.array([start] * batch.num_rows, pa.binary()), pa.array(np.ones(batch.num_rows))],
                                             names=["codes", "label", "margin", "weight"])
    table, n = materialize(rows.select("x", "label").mapInArrow(code, _CODED), "codes"), facts["n"]
    if settings.sample >= 1:
        same = ["codes", "label"] if objective == "softmax" else ["codes"]
        if table.agg(F.approx_count_distinct(F.struct(*same)).alias("n")).first()["n"] <= n / 2:
            mean = F.avg("label") if objective != "softmax" else F.col("label")
            few = table.groupBy(*same).agg(mean.alias("_y"), F.first("margin").alias("margin"), F.sum("weight").alias("weight"))
            table = materialize(few.select("codes", F.col("_y").alias("label"), "margin", "weight"), "equal_codes")
            n = table.count()
    size = n * (width + 16 + 8 * n_trees)
    tasks = int(max(1, -(-size // task_bytes)))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_batch(b, width, n_trees) for b in batches if b.num_rows]
        held = HeldRows(*(np.concatenate(x) for x in zip(*parts)), settings)
        found = json.dumps([[asdict(t) for t in r] for r in grow(held, cuts, settings, 1)])
        yield pa.RecordBatch.from_arrays([pa.array([found])], names=["trees"])
    if size <= alone_bytes and alone:
        rounds = json.loads(table.coalesce(1).mapInArrow(whole, "trees string").first()[0])
    else:
        rounds = [[asdict(t) for t in r] for r in grow(SpreadRows(table.coalesce(tasks), settings, collect_bytes), cuts, settings, REFRESH)]
    return {"objective": objective, "base": base, "n_trees": n_trees, "width": width, "rounds": rounds}


def margins(model: dict, trees: list[list[Tree]], x: np.ndarray) -> np.ndarray:
    out = np.full((len(x), model["n_trees"]), model["base"])
    for r in trees:
        for k, t in enumerate(r):
            out[:, k] += t.margin(x)
    return out


class _BoostParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasMaxIter, HasStepSize, HasSeed):
    objective = Param(Params._dummy(), "objective", "squared, logistic or softmax", TypeConverters.toString)
    numClasses = Param(Params._dummy(), "numClasses", "classes of a softmax", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of splits", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a feature", TypeConverters.toInt)
    regLambda = Param(Params._dummy(), "regLambda", "L2 penalty of leaf values", TypeConverters.toFloat)
    gamma = Param(Params._dummy(), "gamma", "gain that a split must exceed", TypeConverters.toFloat)
    minChildWeight = Param(Params._dummy(), "minChildWeight", "least second-derivative sum of a child", TypeConverters.toFloat)
    subsamplingRate = Param(Params._dummy(), "subsamplingRate", "rows drawn for a round", TypeConverters.toFloat)
    columnRate = Param(Params._dummy(), "columnRate", "features drawn for a round", TypeConverters.toFloat)


class BoostedTrees(Estimator, _BoostParams, DefaultParamsReadable, DefaultParamsWritable):
    """``pyspark.ml`` estimator: second-order boosting with nulls (NaN) in features.

    Labels: numbers (squared), 0/1 (logistic), 0..numClasses-1 (softmax)."""

    @keyword_only
    def __init__(self, *, featuresCol: str = "features", labelCol: str = "label", objective: str = "squared", numClasses: int = 2,  # noqa: N803
                 maxIter: int = 100, stepSize: float = 0.1, maxDepth: int = 6, maxBins: int = MAX_BINS, regLambda: float = 1.0,  # noqa: N803
                 gamma: float = 0.0, minChildWeight: float = 1.0, subsamplingRate: float = 1.0, columnRate: float = 1.0,  # noqa: N803
                 seed: int = 42) -> None:
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(objective="squared", numClasses=2, maxIter=100, stepSize=0.1, maxDepth=6, maxBins=MAX_BINS, regLambda=1.0,
                         gamma=0.0, minChildWeight=1.0, subsamplingRate=1.0, columnRate=1.0, seed=42)

    def _fit(self, dataset: DataFrame) -> BoostedTreesModel:
        value = self.getOrDefault
        objective = value("objective")
        rows = dataset.select(vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("double").alias("label"))
        settings = Settings(objective, value("numClasses") if objective == "softmax" else 1, value("maxIter"), value("stepSize"),
                            value("maxDepth"), value("regLambda"), value("gamma"), value("minChildWeight"), value("subsamplingRate"),
                            value("columnRate"), value("seed"))
        fitted = boost(rows, settings, value("maxBins"))
        model = BoostedTreesModel()
        self._copyValues(model)
        return model._set(modelJson=json.dumps(fitted))


class BoostedTreesModel(Model, _BoostParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted trees; scoring broadcasts them and evaluates Arrow batches."""

    modelJson = Param(Params._dummy(), "modelJson", "the trees", TypeConverters.toString)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(objective="squared", numClasses=2)

    @property
    def fitted(self) -> dict:
        return json.loads(self.getOrDefault("modelJson"))

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802
        """Share of every feature in the gain of all splits."""
        model = self.fitted
        total = np.zeros(model["width"])
        for r in model["rounds"]:
            for t in r:
                for f, g in zip(t["feature"], t["gain"]):
                    if f >= 0:
                        total[f] += g
        return Vectors.dense(total / total.sum() if total.sum() > 0 else total)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        model = self.fitted
        trees = [[Tree(**t) for t in r] for r in model.pop("rounds")]
        shared = dataset.sparkSession.sparkContext.broadcast((model, trees))

        @F.arrow_udf("array<double>")
        def score(x: pa.Array) -> pa.Array:
            model, trees = shared.value
            rows = _matrix(x, model["width"])
            out = probabilities(model["objective"], margins(model, trees, rows))
            ends = np.arange(0, out.size + 1, out.shape[1], dtype=np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))
        scored = dataset.withColumn("__scored", score(vector_to_array(self.getFeaturesCol())))
        value = F.col("__scored")
        if model["objective"] == "squared":
            return scored.withColumn(self.getPredictionCol(), value[0]).drop("__scored")
        best = (F.array_position(value, F.array_max(value)) - 1).cast("double")
        return (scored.withColumn(self.getProbabilityCol(), array_to_vector(value)).withColumn(self.getPredictionCol(), best)
                .drop("__scored"))


# tasks get this module with the functions that use it, so a cluster needs no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])
