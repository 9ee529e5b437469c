"""Embedding near-duplicates by collision-counting projections."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep.functions.joins import join_small
from sparkprep.functions.materialize import materialize
from sparkprep.llm.common import split_join
from sparkprep.llm.components import connected_components
from sparkprep.llm.hard_negatives import _padded, directions, finite
from sparkprep.llm.simhash import Forest

COSINE = 0.93
PROJECTIONS = 32        # sorted projections whose collisions are counted
WINDOW = 1.5            # half a window, in standard deviations of a linked pair at the threshold
RECALL = 0.995          # of a pair at the threshold: by the count, and by the tables together
CELL_ROWS = 2048        # rows that a cell should hold
MOST_ROWS = 4096        # a larger cell is cut into blocks, which meet pair by pair
CELL_WIDTH = 6.0        # width of a cell along a projection, in distances of a pair at the threshold
BALL_PROJECTIONS = 8
BALL_ROWS = 64          # rows that make a ball worth while
QUERY_ROWS = 256
GROUP_BYTES = 64 << 20  # vectors of a group of rows in a task
SEED = 13
SALT = 0xBA11
_PHI = 0.797884560802865  # mean of |z|, z standard normal


@dataclass(frozen=True)
class Plan:
    """Projections, windows, the count that a pair must pass, and the tables of cells."""

    cosine: float
    projections: np.ndarray     # dims x projections
    half: float                 # half a window
    count: int                  # collisions that a pair must have
    keys: list[np.ndarray]      # per table: dims x key projections
    offsets: list[np.ndarray]
    width: float
    ball: np.ndarray            # dims x BALL_PROJECTIONS
    ball_offsets: np.ndarray
    rows: int                   # a cell of more rows is cut into blocks

    @property
    def angle(self) -> float:
        return math.acos(self.cosine)


def _orthogonal(rng: np.random.Generator, dims: int, n: int) -> np.ndarray:
    """``n`` random directions, at right angles as far as there is room, scaled so
    that a random unit vector's projections have variance 1."""
    out = [np.linalg.qr(rng.normal(size=(dims, dims)))[0][:, :min(dims, n - i)] for i in range(0, n, dims)]
    return np.concatenate([np.zeros((dims, 0)), *out], axis=1) * math.sqrt(dims)


def needed_count(n: int, p: float, recall: float) -> int:
    """Largest count that at least ``recall`` of pairs reach, whose ``n``
    projections each collide with probability ``p``."""
    tail = 0.0
    for k in range(n, 0, -1):
        tail += math.comb(n, k) * p**k * (1 - p)**(n - k)
        if tail >= recall:
            return k
    return 0


def make_plan(dims: int, rows: int, cosine: float = COSINE, projections: int = PROJECTIONS, window: float = WINDOW,
              recall: float = RECALL, cell_rows: int = CELL_ROWS, most_rows: int = MOST_ROWS) -> Plan:
    """Calibrated for pairs at the threshold, the hardest to find: their distance
    d gives the spread of a projected difference (d, in units where a random
    direction has variance 1), hence the chance to collide in a window and to
    share a cell.  ``rows``: of the most frequent label.  More rows take more key
    projections a table, and so more tables to keep the recall."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    dims = max(1, dims)
    d = math.sqrt(max(0.0, 2 - 2 * cosine))
    collide = math.erf(window / math.sqrt(2))
    width = CELL_WIDTH * d
    together = 1 - _PHI / CELL_WIDTH
    bits = max(0.5, math.log2(max(2.0, 4.13 / max(width, 1e-9))))  # of a normal variable cut at this width
    n_keys = max(0, math.ceil(math.log2(max(1.0, rows / cell_rows)) / bits))
    n_tables = 1 if n_keys == 0 else math.ceil(math.log(1 - recall) / math.log(1 - together**n_keys))
    return Plan(cosine, _orthogonal(rng, dims, projections), window * d, needed_count(projections, collide, recall),
                [_orthogonal(rng, dims, n_keys) for _ in range(n_tables)],
                [rng.uniform(0, width, n_keys) for _ in range(n_tables)], width,
                _orthogonal(rng, dims, BALL_PROJECTIONS), rng.uniform(0, width, BALL_PROJECTIONS),
                max(1, min(most_rows, GROUP_BYTES // (8 * dims))))


def cells(unit: np.ndarray, label: np.ndarray, keys: np.ndarray, offsets: np.ndarray, width: float, table: int) -> np.ndarray:
    """64-bit cell of every row: a hash of its label and its places on the key projections."""
    h = label.view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15 * (table + 1) % 2**64)
    places = np.floor((unit @ keys + offsets) / width).astype(np.int64).view(np.uint64)
    for column in places.T:
        h = (h ^ column) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


class Group:
    """Rows that one task compares: all with all, or a left part with a right part."""

    def __init__(self, plan: Plan, table: int, batch: pa.RecordBatch) -> None:
        dims = len(plan.projections)
        self.plan, self.table = plan, table
        self.cid, self.n, self.label, self.ball, side = (batch.column(i).to_numpy() for i in range(5))
        self.cells = np.stack([np.frombuffer(c, np.int64) for c in batch.column(5).to_pylist()])
        self.unit = directions(_padded(batch.column(6), dims))
        self.within = bool((side == 2).all())
        self.left, self.right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)

    def collisions(self, rows: np.ndarray, sorted_: list[np.ndarray], ranks: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Of every query among ``rows`` with every right row: on how many sorted
        projections the row's rank lies in the window centred at the query."""
        count = np.zeros((len(rows), len(self.right)), np.uint8)
        for m, values in enumerate(sorted_):
            low = np.searchsorted(values, places[rows, m] - self.plan.half, "left").astype(np.uint16)
            span = np.searchsorted(values, places[rows, m] + self.plan.half, "right").astype(np.uint16) - low
            count += (ranks[m][None, :] - low[:, None]) < span[:, None]
        return count

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(links of every row: copies counted, a, b): pairs whose count passes and
        whose cosine reaches the threshold; a, b is a spanning forest of them."""
        total = np.zeros(len(self.cid), np.int64)
        forest = Forest(len(self.cid))
        if not len(self.left) or not len(self.right):
            return total, self.cid[:0], self.cid[:0]
        places = self.unit @ self.plan.projections
        order = [np.argsort(places[self.right, m], kind="stable") for m in range(places.shape[1])]
        sorted_ = [places[self.right[o], m] for m, o in enumerate(order)]
        ranks = np.zeros((len(order), len(self.right)), np.uint16)
        for m, o in enumerate(order):
            ranks[m, o] = np.arange(len(o))
        for i in range(0, len(self.left), QUERY_ROWS):
            rows = self.left[i:i + QUERY_ROWS]
            passed = self.collisions(rows, sorted_, ranks, places) >= self.plan.count
            if self.within:
                passed &= rows[:, None] < self.right[None, :]
            some = np.flatnonzero(passed.any(axis=0))
            for j in range(0, len(some), 4096):
                cols = self.right[some[j:j + 4096]]
                good = passed[:, some[j:j + 4096]]
                good &= self.unit[rows] @ self.unit[cols].T >= self.plan.cosine
                good &= self.label[rows][:, None] == self.label[cols][None]
                good &= (self.ball[rows][:, None] != self.ball[cols][None]) | (self.ball[rows] < 0)[:, None]
                for t in range(self.table):  # such a pair belongs to the first table where it shares a cell
                    good &= self.cells[rows, t][:, None] != self.cells[cols, t][None]
                total[rows] += good @ self.n[cols]
                total[cols] += self.n[rows] @ good
                q, p = np.nonzero(good)
                forest.union(rows[q], cols[p])
        root = forest.roots(np.arange(len(self.cid)))
        moved = np.flatnonzero(root != np.arange(len(self.cid)))
        return total, self.cid[moved], self.cid[root[moved]]


def _compared(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by group; one group, of bounded size, is held at a time."""
    def done(parts: list[pa.RecordBatch], table: int) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        total, a, b = (g := Group(plan, table, rows)).links()
        some = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.r_[g.cid[some], a]), pa.array([None] * len(some) + b.tolist(), pa.int64()),
             pa.array(total[some].tolist() + [None] * len(a), pa.int64())], names=["a", "b", "links"])

    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        g, t = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cut = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (t[1:] != t[:-1])])
        for a, b in zip(cut, np.r_[cut[1:], len(g)]):
            if key != (g[a], t[a]):
                if held:
                    yield done(held, int(key[1]))
                key, held = (g[a], t[a]), []
            held.append(batch.slice(a, b - a).select(list(range(2, 9))))
    if held:
        yield done(held, int(key[1]))


def _classes(rows: DataFrame) -> DataFrame:
    """One row per distinct (label, vector): cid, k1, k2, rep (smallest vec_id), n, lh, v."""
    found = rows.groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"),
                                         F.first("lh").alias("lh"), F.first("v").alias("v"))
    return materialize(found.withColumn("cid", F.monotonically_increasing_id()), "classes")


def _balls(classes: DataFrame, plan: Plan) -> DataFrame:
    """``cid, ball`` of classes that lie within half the threshold's angle of a
    common centre: any two of one ball are linked, by the triangle inequality, so
    no pair of them need be compared.  A centre is the class of least hash in a
    cell of the ball projections; cells of few rows have none.
    """
    dims = len(plan.projections)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = directions(_padded(batch.column(2), dims))
            cell = cells(unit, batch.column(1).to_numpy(), plan.ball, plan.ball_offsets, plan.width, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell), batch.column(2)],
                                             names=["cid", "lh", "ball_cell", "v"])
    placed = classes.select("cid", "lh", "v").mapInArrow(place, "cid bigint, lh bigint, ball_cell bigint, v array<double>")
    dense = placed.groupBy("lh", "ball_cell").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= BALL_ROWS).drop("_n")
    within = join_small(placed, dense.withColumn("_dense", F.lit(True)), ["lh", "ball_cell"]).where("_dense").drop("_dense")
    within = materialize(within, "dense")
    centres = within.groupBy("lh", "ball_cell").agg(
        F.min_by(F.struct("cid", "v"), F.xxhash64("cid", F.lit(SALT))).alias("_c"))
    centres = centres.select("lh", "ball_cell", F.col("_c.cid").alias("ball"), F.col("_c.v").alias("centre"))
    near = math.cos(plan.angle / 2 - 1e-6)

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (directions(_padded(batch.column(i), dims)) for i in (1, 3))
            keep = pa.array(np.einsum("ij,ij->i", a, b) >= near)
            yield batch.select([0, 2]).filter(keep)
    return materialize(join_small(within, centres, ["lh", "ball_cell"], "inner").select("cid", "v", "ball", "centre")
                       .mapInArrow(inner, "cid bigint, ball bigint"), "balls")


def _groups(placed: DataFrame, plan: Plan) -> DataFrame:
    """Rows (cid, n, lh, ball, cells, v, t, cell) under the groups ``g`` in which they
    are compared.  A cell of bounded size is one group.  A larger one is cut into
    blocks, those of a ball apart from the others; two blocks make a group,
    unless they belong to one ball."""
    size = placed.groupBy("t", "cell").agg(F.count(F.lit(1)).alias("rows"))
    large = size.where(F.col("rows") > plan.rows).withColumn("_large", F.lit(True)).drop("rows")
    marked = materialize(join_small(placed, large, ["t", "cell"]), "placed")
    columns = ["g", "t", "cid", "n", "lh", "ball", "side", "cells", "v"]
    whole = (marked.where(F.col("_large").isNull()).withColumn("g", F.xxhash64("t", "cell"))
             .withColumn("side", F.lit(2)).select(*columns))
    cut = marked.where("_large")
    parts = cut.groupBy("t", "cell", "ball").agg(F.count(F.lit(1)).alias("rows"))
    parts = materialize(parts.withColumn("parts", F.ceil(F.col("rows") / F.lit(plan.rows)).cast("int")), "parts")
    blocks = parts.select("t", "cell", "ball", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("u"))
    two = blocks.alias("a").join(blocks.alias("b"), ["t", "cell"]).where(
        (F.struct("a.ball", "a.u") <= F.struct("b.ball", "b.u")) & ((F.col("a.ball") != F.col("b.ball")) | (F.col("a.ball") < 0)))
    two = two.select("t", "cell", F.col("a.ball").alias("ball"), F.col("a.u").alias("u"), F.col("b.ball").alias("ball2"),
                     F.col("b.u").alias("u2")).withColumn("g", F.xxhash64("t", "cell", "ball", "u", "ball2", "u2"))
    two = materialize(two, "pairs")
    own = (F.col("ball") == F.col("ball2")) & (F.col("u") == F.col("u2"))
    asked = two.select("t", "cell", "ball", "u", "g", F.when(own, 2).otherwise(0).alias("side")).unionByName(
        two.where(~own).select("t", "cell", F.col("ball2").alias("ball"), F.col("u2").alias("u"), "g", F.lit(1).alias("side")))
    dealt = join_small(cut.drop("_large"), parts.drop("rows"), ["t", "cell", "ball"], "inner")
    dealt = dealt.withColumn("u", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    return whole.unionByName(dealt.join(asked, ["t", "cell", "ball", "u"]).select(*columns))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    cosine: float = COSINE, projections: int = PROJECTIONS, window: float = WINDOW, recall: float = RECALL,
                    cell_rows: int = CELL_ROWS, most_rows: int = MOST_ROWS) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row per input row.

    Rows of equal, non-null labels link when their cosine, in double precision,
    is at least ``cosine``.  Equal vectors of a label form a class.  Classes are
    dealt to cells of random projections, in as many tables as the recall takes;
    within a cell every projection is sorted, the windows centred at each row are
    counted pair by pair, and pairs that pass the calibrated count are verified.
    No pair below the threshold links; a pair at it is found with a chance of
    about ``recall`` squared, nearer pairs more surely.  ``n_links`` counts other
    rows, copies included; ``component_id`` is the smallest vec_id reachable.

    Pairs are counted where they are compared and only a spanning forest is sent
    on.  Dense groups are recognised as balls, whose pairs need no comparison.

    Vectors that are null, empty, zero or hold null or non-finite components, and
    rows without a label, link with nothing (0, own vec_id, kept); shorter
    vectors count as ending in zeros; rows that share a vec_id are vectors of
    their own; a null vec_id names no component and is not kept.
    """
    label = F.col(label_col).cast("string")
    clean = F.transform(F.col(vector_col).cast("array<double>"), lambda x: x + F.lit(0.0))  # one zero
    usable = label.isNotNull() & finite(F.col(vector_col)) & F.exists(F.col(vector_col), lambda x: x.cast("double") != F.lit(0.0))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.coalesce(usable, F.lit(False)).alias("ok"),
                          F.xxhash64(label).alias("lh"), clean.alias("v"))
    rows = rows.withColumn("k1", F.xxhash64("lh", "v")).withColumn("k2", F.xxhash64("v", F.lit(SALT), "lh"))
    good = rows.where("ok")
    classes = _classes(good)
    facts = classes.agg(F.max(F.size("v")).alias("dims")).first()
    most = classes.groupBy("lh").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    plan = make_plan(facts["dims"] or 1, most, cosine, projections, window, recall, cell_rows, most_rows)
    balls = _balls(classes, plan)
    held = with_balls(classes, balls)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims = len(plan.projections)
        for batch in batches:
            unit, lh = directions(_padded(batch.column(4), dims)), batch.column(2).to_numpy()
            found = np.stack([cells(unit, lh, k, o, plan.width, t) for t, (k, o) in enumerate(zip(plan.keys, plan.offsets))], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in found], pa.binary()),
                                              pa.array(found.tolist(), pa.list_(pa.int64()))],
                                             names=["cid", "n", "lh", "ball", "v", "cells", "each"])
    kind = "cid bigint, n bigint, lh bigint, ball bigint, v array<double>, cells binary, each array<bigint>"
    placed = held.select("cid", "n", "lh", "ball", "v").mapInArrow(place, kind)
    placed = placed.select("*", F.posexplode("each").alias("t", "cell")).drop("each")
    groups = _groups(placed, plan)
    compared = groups.repartition("g").sortWithinPartitions("g", "t").mapInArrow(
        lambda b: _compared(b, plan), "a bigint, b bigint, links bigint")
    compared = materialize(compared, "compared")

    edges = compared.where(F.col("b").isNotNull()).select("a", "b").unionByName(
        balls.select(F.col("cid").alias("a"), F.col("ball").alias("b")))
    parts = connected_components(edges)
    members = materialize(classes.select("cid", "rep", "n", "k1", "k2").join(parts, F.col("cid") == F.col("node"), "left")
                          .withColumn("component", F.coalesce("component", "cid")), "members")
    names = members.groupBy("component").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("_size"))
    counted = compared.where(F.col("b").isNull()).groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("found"))
    weights = held.where(F.col("ball") >= 0).select("cid", "ball", "n")
    in_ball = join_small(weights, weights.groupBy("ball").agg(F.sum("n").alias("_all")), ["ball"], "inner")
    in_ball = in_ball.select("cid", (F.col("_all") - F.col("n")).alias("inside"))
    linked = members.join(counted, "cid", "left").join(in_ball, "cid", "left")
    links = F.col("n") - 1 + F.coalesce("found", F.lit(0)) + F.coalesce("inside", F.lit(0))
    linked = split_join(linked.select("component", "k1", "k2", "n", links.alias("n_links")), names, ["component"], "_size")
    out = split_join(good.select("vec_id", "k1", "k2"), linked.select("k1", "k2", "n", "n_links", "component_id"), ["k1", "k2"], "n")
    alone = rows.where(~F.col("ok")).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    every = out.select("vec_id", "n_links", "component_id").unionByName(alone)
    return every.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def with_balls(classes: DataFrame, balls: DataFrame) -> DataFrame:
    """``classes`` with ``ball`` (-1: none)."""
    return materialize(classes.join(balls, "cid", "left").withColumn("ball", F.coalesce("ball", F.lit(-1))), "held")
