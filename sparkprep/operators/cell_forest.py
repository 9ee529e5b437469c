"""Regression forests over tables of many rows and few cells.

A forest of ``pyspark.ml`` keeps every row with a count for each tree and walks all
rows through all trees at every level.  But a tree sees no more of a row than its
bins, so rows of equal bins are one cell: a single pass draws every row's counts,
one tree after the other, and adds them up by cell.  A tree then grows from the
sums of its cells, in one task.  Draws, split candidates, gains and limits are those of
``pyspark.ml``, and so is the model.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep.functions.partitioning import spread
from sparkprep.session import scratch_path

MAX_CELLS = 1 << 16      # bins of one feature x bins of the next x ...
STATE_BYTES = 256 << 20  # sums of all trees and cells in a task
BATCH_ROWS = 1 << 17     # rows that are counted at a time
_NODES = ("treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, "
          "gain: double, leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, "
          "numCategories: int>>")


def split_candidates(values: np.ndarray, bins: int) -> np.ndarray:
    """Thresholds of a feature from a sample of its values: between all neighbours, or
    ``bins`` - 1 of them at even counts."""
    found, count = np.unique(values, return_counts=True)
    between = (found[:-1] + found[1:]) / 2
    if len(between) < bins:
        return between
    stride, out = len(values) / bins, []
    target, total = stride, np.cumsum(count)
    for i in range(1, len(found)):
        if abs(total[i - 1] - target) < abs(total[i] - target):
            out.append(between[i - 1])
            target += stride
    return np.array(out)


class Draws:
    """Poisson counts: 16 bits decide nearly all of them, the few on a border take 53 more."""

    def __init__(self, mean: float) -> None:
        p, self.cdf = math.exp(-mean), []
        total = 0.0
        while total < 1 - 1e-17 and len(self.cdf) < 200:
            total += p
            self.cdf.append(total)
            p *= mean / len(self.cdf)
        edges = np.searchsorted(self.cdf, np.arange((1 << 16) + 1) / (1 << 16), "right")
        self.table = np.where(edges[:-1] == edges[1:], edges[:-1], -1).astype(np.float64)

    def of(self, rng: np.random.Generator, n: int) -> np.ndarray:
        bits = rng.integers(0, 1 << 16, n, dtype=np.uint16)
        out = self.table[bits]
        border = np.flatnonzero(out < 0)
        out[border] = np.searchsorted(self.cdf, (bits[border] + rng.random(len(border))) / (1 << 16), "right")
        return out


def features_tried(strategy: str, trees: int, features: int) -> int:
    """How many features a node may split on."""
    if strategy == "auto":
        strategy = "all" if trees == 1 else "onethird"
    named = {"all": features, "onethird": math.ceil(features / 3), "sqrt": math.ceil(math.sqrt(features)),
             "log2": max(1, math.ceil(math.log2(features)))}
    if strategy in named:
        return named[strategy]
    if strategy.isdigit():
        return min(int(strategy), features)
    return math.ceil(float(strategy) * features)


class Grower:
    """How a tree grows from the sums of its cells."""

    def __init__(self, cuts: list[np.ndarray], tried: int, depth: int, least: int, least_share: float, least_gain: float, seed: int) -> None:
        self.cuts, self.tried, self.depth, self.least, self.least_share, self.least_gain, self.seed = (
            cuts, tried, depth, least, least_share, least_gain, seed)

    def tree(self, number: int, sums: np.ndarray) -> list[dict]:
        """Nodes, parents first, each before its left and then its right side; ``sums``: count, label, label squared x cells."""
        rng = np.random.Generator(np.random.PCG64([self.seed, number]))
        cells = np.flatnonzero(sums[0])
        codes = np.array(np.unravel_index(cells, [len(c) + 1 for c in self.cuts]))
        sums = sums[:, cells]
        least = max(self.least, self.least_share * sums[0].sum())
        nodes: list[dict] = []

        def grow(here: np.ndarray, depth: int) -> int:
            n, s, q = (float(x) for x in sums[:, here].sum(axis=1))
            me, impurity = len(nodes), (q - s * s / n) / n
            node = {"id": me, "prediction": s / n, "impurity": impurity, "impurityStats": [n, s, q], "rawCount": int(n), "gain": -1.0, "leftChild": -1,
                    "rightChild": -1, "split": {"featureIndex": -1, "leftCategoriesOrThreshold": [], "numCategories": -1}}
            nodes.append(node)
            best = (0.0, -1, -1)
            if depth < self.depth:
                for f in np.sort(rng.permutation(len(self.cuts))[:self.tried]).tolist():
                    bins = len(self.cuts[f]) + 1
                    left = np.cumsum([np.bincount(codes[f, here], x, bins) for x in sums[:, here]], axis=1)[:, :-1]
                    right = np.array([[n], [s], [q]]) - left
                    good = (left[0] >= least) & (right[0] >= least) & (left[0] > 0) & (right[0] > 0)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        gain = impurity - sum((x[2] - x[1] * x[1] / x[0]) / n for x in (left, right))
                    gain = np.where(good & (gain >= self.least_gain), gain, -np.inf)
                    if len(gain) and gain.max() > best[0]:
                        best = (float(gain.max()), f, int(gain.argmax()))
            if best[1] >= 0:
                gain, f, b = best
                node["gain"], node["split"] = gain, {"featureIndex": f, "leftCategoriesOrThreshold": [float(self.cuts[f][b])], "numCategories": -1}
                goes = codes[f, here] <= b
                node["leftChild"] = grow(here[goes], depth + 1)
                node["rightChild"] = grow(here[~goes], depth + 1)
            return me
        grow(np.arange(len(cells)), 0)
        return nodes


def _cells(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Cell of every row; a value goes left where it is at most the threshold."""
    if np.isnan(x).any():
        raise ValueError("forests take no NaN")
    return np.ravel_multi_index([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], [len(c) + 1 for c in cuts])


def cell_sums(batches: Iterator[pa.RecordBatch], cuts: list[np.ndarray], trees: int, rate: float, bootstrap: bool, seed: int) -> np.ndarray:
    """Trees x (count, label, label squared) x cells of a task's rows, with every tree's own draws."""
    out = np.zeros((trees, 3, math.prod(len(c) + 1 for c in cuts)))
    rng = np.random.Generator(np.random.SFC64([seed, TaskContext.get().partitionId()]))
    draws = Draws(rate) if bootstrap else None
    for x, y in _chunks(batches, len(cuts)):
        cell, whole = _cells(x, cuts), None
        for tree in out:
            if bootstrap:
                w = draws.of(rng, len(y))
            elif rate < 1:
                w = (rng.random(len(y)) < rate).astype(np.float64)
            else:
                w = np.ones(len(y))
            if whole is None or bootstrap or rate < 1:
                wy = w * y
                whole = [np.bincount(cell, v, out.shape[2]) for v in (w, wy, wy * y)]
            for total, part in zip(tree, whole):
                total += part
    return out


def _chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features and labels of ``BATCH_ROWS`` rows and more at a time, so that adding up the cells costs little."""
    def made(some: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        parts = [(b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width), b.column(1).to_numpy(zero_copy_only=False)) for b in some]
        return np.concatenate([x for x, _ in parts]), np.concatenate([y for _, y in parts])
    some, n = [], 0
    for batch in batches:
        some, n = [*some, batch], n + batch.num_rows
        if n >= BATCH_ROWS:
            yield made(some)
            some, n = [], 0
    if n:
        yield made(some)


class CellForestRegressor(RandomForestRegressor):
    """A forest of ``pyspark.ml`` that grows from sums by cell.  Where bins make too many
    cells it is grown from rows, dealt to tasks by ``deal``."""

    def using(self, n_rows: int, deal) -> CellForestRegressor:  # noqa: ANN001
        self.n_rows, self.deal = n_rows, deal
        return self

    def _fit(self, dataset: DataFrame) -> RandomForestRegressionModel:
        value, spark, trees = self.getOrDefault, dataset.sparkSession, self.getNumTrees()
        bins, seed = self.getMaxBins(), self.getSeed()
        rows = dataset.select(vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y"))
        # as pyspark.ml finds its splits: from a sample of max(10,000, bins squared) rows
        share = max(10_000, bins * bins) / self.n_rows
        sample = np.array([r["x"] for r in (rows.sample(share, seed) if share < 1 else rows).select("x").collect()])
        if not len(sample):
            return super()._fit(self.deal(dataset))
        cuts = [split_candidates(sample[:, f], bins) for f in range(sample.shape[1])]
        cells = math.prod(len(c) + 1 for c in cuts)
        state = 24 * trees * cells
        if cells > MAX_CELLS or state > STATE_BYTES or value("impurity") != "variance" or self.isSet("weightCol"):
            return super()._fit(self.deal(dataset))
        # sums sent on are no more than a few bytes a row where that leaves tasks for all cores
        most = max(2 * spark.sparkContext.defaultParallelism, 8 * self.n_rows // state)
        rate, bootstrap = value("subsamplingRate"), value("bootstrap")

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = cell_sums(batches, cuts, trees, rate, bootstrap, seed)
            for t in range(trees):
                if found[t, 0].any():
                    yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([found[t].tobytes()], pa.binary())], names=["tree", "sums"])
        grower = Grower(cuts, features_tried(value("featureSubsetStrategy"), trees, len(cuts)), value("maxDepth"), value("minInstancesPerNode"),
                        value("minWeightFractionPerNode"), value("minInfoGain"), seed)

        def grow(key: tuple, found: pa.Table) -> pa.Table:
            total = np.zeros((3, cells))
            for sums in found.column("sums"):
                total += np.frombuffer(sums.as_py()).reshape(3, cells)
            number = key[0].as_py()
            return pa.Table.from_pylist([{"treeID": number, "nodeData": n} for n in grower.tree(number, total)],
                                        pa.schema([("treeID", pa.int32()), ("nodeData", _NODE_TYPE)]))
        sums = spread(rows).coalesce(int(most)).mapInArrow(add, "tree int, sums binary")
        nodes = sums.groupBy("tree").applyInArrow(grow, _NODES)
        # the model is read as a saved one; what it says of itself is that of a forest of some rows of nothing
        path, form = scratch_path(spark, "forest"), scratch_path(spark, "forest")
        none = spark.createDataFrame([(Vectors.dense([0.0] * len(cuts)), 0.0)] * 64, [self.getFeaturesCol(), self.getLabelCol()])
        super()._fit(none.coalesce(1)).write().save(form)
        spark.read.text(f"{form}/metadata").coalesce(1).write.text(f"{path}/metadata")
        spark.read.parquet(f"{form}/treesMetadata").write.parquet(f"{path}/treesMetadata")
        nodes.write.parquet(f"{path}/data")
        return RandomForestRegressionModel.load(path)


_NODE_TYPE = pa.struct([("id", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()), ("impurityStats", pa.list_(pa.float64())),
                        ("rawCount", pa.int64()), ("gain", pa.float64()), ("leftChild", pa.int32()), ("rightChild", pa.int32()),
                        ("split", pa.struct([("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(pa.float64())),
                                             ("numCategories", pa.int32())]))])

# tasks get this module with the functions that use it, so a cluster needs no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])
