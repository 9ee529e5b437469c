"""Hard-negative mining with angular triangle filters."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkprep.functions.materialize import materialize
from sparkprep.llm.common import hash_sample, shuffle_partitions

SCALE = 256.0
POSITIVES = 5
NEGATIVES = 10
REFERENCES = 24         # reference directions
SAMPLE_ROWS = 4096      # vectors that the reference directions are chosen from
ANCHOR_ROWS = 128       # anchors in a block
ROWS = 2048             # rows in a block
GROUP_BLOCKS = 64       # anchor blocks that one group of tasks searches
SLACK = 1e-6            # radians that a stored angle may be off
_EXACT = 2.0**52


def finite(vector: Column) -> Column:
    """Not null, no null and no non-finite component."""
    good = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(good, F.lit(False))


def quantised(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as exact integers: float64 where they hold them, else Python ints."""
    big = np.abs(x).max(initial=0.0) * scale >= _EXACT
    if not big:
        return np.floor(x * scale)
    whole = [int(v) * int(scale) if abs(v) >= _EXACT else math.floor(v * scale) for v in x.ravel().tolist()]
    return np.array(whole, object).reshape(x.shape)


def exact_scores(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Integer inner products of the rows of ``a`` with those of ``b``.  In float64
    if every partial sum is under 2**52 (``bound``: product of the largest norms)."""
    if a.dtype != object and b.dtype != object and bound < _EXACT:
        return (a @ b.T).astype(np.int64)
    return _ints(a) @ _ints(b).T


def _ints(m: np.ndarray) -> np.ndarray:
    if m.dtype == object:
        return m
    out = np.empty(m.shape, object)
    out[...] = [[int(v) for v in row] for row in m.tolist()]
    return out


def _norms(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    top = np.abs(m).max(axis=1, initial=0.0)
    safe = np.where(top > 0, top, 1.0)
    return np.sqrt(((m / safe[:, None]) ** 2).sum(axis=1)) * top


def directions(m: np.ndarray) -> np.ndarray:
    """Unit vectors of the rows; a zero vector stays zero, at right angles to all."""
    m = m.astype(np.float64)
    top = np.abs(m).max(axis=1, initial=0.0)
    m = m / np.where(top > 0, top, 1.0)[:, None]
    n = np.sqrt((m ** 2).sum(axis=1))
    return m / np.where(n > 0, n, 1.0)[:, None]


def angles(m: np.ndarray, refs: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(directions(m) @ refs.T, -1.0, 1.0))


def choose_references(sample: np.ndarray, n: int) -> np.ndarray:
    """Directions far from each other: each next one has the largest angle to the nearest chosen."""
    unit = directions(sample)
    unit = unit[(unit != 0).any(axis=1)]
    if not len(unit):
        return np.zeros((1, sample.shape[1]))
    chosen = [0]
    near = unit @ unit[0]
    while len(chosen) < min(n, len(unit)):
        nxt = int(np.argmin(near))
        if near[nxt] > 1 - 1e-9:
            break
        chosen.append(nxt)
        near = np.maximum(near, unit @ unit[nxt])
    return unit[chosen]


def _padded(column: pa.Array, dims: int) -> np.ndarray:
    out = np.zeros((len(column), dims))
    for i, v in enumerate(column):
        values = v.values.to_numpy(zero_copy_only=False)
        out[i, :len(values)] = values
    return out


def _packed(m: np.ndarray) -> tuple[bytes, list[str] | None]:
    """A matrix of integers as bytes, or as decimals where float64 does not hold them."""
    if m.dtype == object:
        return b"", [str(v) for v in m.ravel()]
    return m.astype(np.float64).tobytes(), None


def _unpacked(data: bytes, wide: list[str] | None, n: int) -> np.ndarray:
    if wide is not None:
        return np.array([int(v) for v in wide], object).reshape(n, -1)
    return np.frombuffer(data, np.float64).reshape(n, -1)


def _blocks(batches: Iterator[pa.RecordBatch], size: int, dims: int, scale: float, refs: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blocks of rows (label, cell, angle, id, vector) of one label and nearest
    reference.  Rows come sorted; in a block they are in the order of that angle."""
    number = TaskContext.get().partitionId() << 33
    for batch in batches:
        label, cell, ids = (batch.column(i).to_numpy() for i in (0, 1, 3))
        new = np.flatnonzero(np.r_[True, (label[1:] != label[:-1]) | (cell[1:] != cell[:-1])]) if len(label) else []
        for a, b in zip(new, np.r_[new[1:], len(label)] if len(label) else []):
            for i in range(int(a), int(b), size):
                j = min(i + size, int(b))
                raw = _padded(batch.column(4).slice(i, j - i), dims)
                q = quantised(raw, scale)
                theta = angles(q, refs)
                order = np.argsort(theta[:, cell[i]], kind="stable")
                q, theta = q[order], theta[order]
                data, wide = _packed(q)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([label[i]], pa.int64()), pa.array([number], pa.int64()), pa.array([int(cell[i])], pa.int32()),
                     pa.array([ids[i:j][order].tobytes()], pa.binary()), pa.array([data], pa.binary()),
                     pa.array([wide], pa.list_(pa.string())), pa.array([theta.tobytes()], pa.binary()),
                     pa.array([_norms(q).tobytes()], pa.binary())],
                    names=["label", "block", "cell", "ids", "data", "wide", "angles", "norms"])
                number += 1


class Block:
    """Rows of one label, sorted by the angle to one reference, with all stored angles."""

    def __init__(self, label: int, cell: int, ids: bytes, data: bytes, wide: list[str] | None, theta: bytes, norms: bytes) -> None:
        self.label, self.cell = label, cell
        self.ids = np.frombuffer(ids, np.int64)
        n = len(self.ids)
        self.rows = _unpacked(data, wide, n)
        self.angles = np.frombuffer(theta, np.float64).reshape(n, -1)
        self.norms = np.frombuffer(norms, np.float64)
        self.low, self.high = self.angles.min(axis=0), self.angles.max(axis=0)
        self.least, self.most = float(self.norms.min()), float(self.norms.max())

    def angle_range(self, theta: np.ndarray) -> tuple[float, float]:
        """Least and largest angle that a direction with angles ``theta`` to the
        references can have to a row of this block, by the triangle inequality."""
        least = max(0.0, float(np.maximum(theta - self.high, self.low - theta).max()) - SLACK)
        most = min(math.pi, float(np.minimum(theta + self.high, 2 * math.pi - theta - self.low).min()) + SLACK)
        return least, most

    def window(self, theta: np.ndarray, norm: float, low: float, high: float) -> tuple[int, int]:
        """The run of rows whose score with an anchor can be in [low, high]; the
        others' cosine intervals, times the norms, lie outside."""
        least, most = self.angle_range(theta)
        widest = _reach(low, norm, self.least, self.most, upper=True)
        nearest = _reach(high, norm, self.least, self.most, upper=False)
        if least > widest or most < nearest:
            return 0, 0
        own, at = self.angles[:, self.cell], theta[self.cell]
        # angle >= |own - at| and angle <= min(own + at, 2 pi - own - at)
        a = np.searchsorted(own, max(at - widest, nearest - at) - SLACK, "left")
        b = np.searchsorted(own, min(at + widest, 2 * math.pi - nearest - at) + SLACK, "right")
        return int(a), int(b)


def _reach(score: float, norm: float, least: float, most: float, upper: bool) -> float:
    """Largest angle (``upper``) at which a score of at least ``score`` is possible
    for a row of norm least..most, or the smallest at which one of at most it is;
    rounded to the safe side."""
    if score == -math.inf or score == math.inf:
        return math.pi if upper else 0.0
    score += (-1.0 if upper else 1.0) * (1.0 + abs(score) * 1e-9)
    row = (most if score > 0 else least) if upper else (least if score > 0 else most)
    if norm * row == 0:  # such rows score 0
        return (math.pi if score <= 0 else -1.0) if upper else (0.0 if score >= 0 else 4.0)
    cosine = score / (norm * row)
    if upper:
        return -1.0 if cosine > 1 + 1e-9 else math.acos(max(-1.0, min(1.0, cosine))) + SLACK
    return 4.0 if cosine < -1 - 1e-9 else math.acos(max(-1.0, min(1.0, cosine))) - SLACK


class Anchors:
    """A block of anchors and the best rows found so far."""

    def __init__(self, label: list[int], ids: bytes, data: bytes, wide: list[str] | None, theta: bytes, norms: bytes,
                 wanted: int) -> None:
        self.labels = np.asarray(label, np.int64)
        self.ids = np.frombuffer(ids, np.int64)
        n = len(self.ids)
        self.rows = _unpacked(data, wide, n)
        self.angles, self.norms = np.frombuffer(theta, np.float64).reshape(n, -1), np.frombuffer(norms, np.float64)
        self.wanted = wanted
        self.best: dict = {}

    def keep(self, key, scores: np.ndarray, ids: np.ndarray) -> None:  # noqa: ANN001
        if key in self.best:
            scores, ids = np.concatenate([self.best[key][0], scores]), np.concatenate([self.best[key][1], ids])
        top = np.lexsort((ids, -scores))[:self.wanted] if scores.dtype != object else np.array(
            sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:self.wanted], np.int64)
        self.best[key] = (scores[top], ids[top])

    def floor(self, key) -> float:  # noqa: ANN001
        found = self.best.get(key)
        return float(found[0][-1]) if found is not None and len(found[0]) == self.wanted else -math.inf

    def scored(self, block: Block, i: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        bound = float(self.norms[i]) * block.most
        scores = exact_scores(block.rows[a:b], self.rows[i:i + 1], bound)[:, 0]
        other = block.ids[a:b] != self.ids[i]
        return scores[other], block.ids[a:b][other]

    def positives(self, block: Block) -> None:
        for i in np.flatnonzero(self.labels == block.label):
            a, b = block.window(self.angles[i], float(self.norms[i]), self.floor(i), math.inf)
            if a < b:
                self.keep(i, *self.scored(block, i, a, b))

    def negatives(self, block: Block, windows: list[list[tuple[int, int]]], least: int, most: int) -> None:
        """``windows``: the (positive id, positive score) of every anchor; a row fits
        when least * positive <= 100 * score <= most * positive."""
        for i in np.flatnonzero(self.labels != block.label):
            wanted = [(p, s, max(s * least / 100, self.floor((i, p, s))), s * most / 100) for p, s in windows[i] if s >= 0]
            if not wanted:
                continue
            a, b = block.window(self.angles[i], float(self.norms[i]), min(w[2] for w in wanted), max(w[3] for w in wanted))
            if a >= b:
                continue
            scores, ids = self.scored(block, i, a, b)
            if scores.dtype != object and len(scores) and max(abs(int(scores.max())), abs(int(scores.min())),
                                                              *(abs(w[1]) for w in wanted)) >= 2**53:
                scores = scores.astype(object)
            for p, s, _, _ in wanted:
                fits = np.asarray((scores * 100 >= least * s) & (scores * 100 <= most * s), bool)
                if fits.any():
                    self.keep((i, p, s), scores[fits], ids[fits])


def _meet(batches: Iterator[pa.RecordBatch], wanted: int, ratio: tuple[int, int] | None) -> Iterator[pa.RecordBatch]:
    """One state for every anchor block of the task; blocks of rows stream by."""
    states: dict[int, Anchors] = {}
    blocks: dict[int, list] = {}

    def rows(state: Anchors) -> pa.RecordBatch:
        out: list[tuple] = []
        for key, (scores, ids) in state.best.items():
            i, p, s = key if isinstance(key, tuple) else (key, None, None)
            out += [(int(state.ids[i]), p, s, int(j), v) for j, v in zip(ids, scores)]
        cols = list(zip(*out)) if out else [[]] * 5
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), _decimals(cols[2]), pa.array(cols[3], pa.int64()),
             _decimals(cols[4])], names=["anchor_id", "positive_id", "positive_score", "vec_id", "score"])

    for batch in batches:
        for r in range(batch.num_rows):
            (number, labels, ids, data, wide, theta, norms, found, label, cell, *block) = (c[r].as_py() for c in batch.columns)
            if number not in states:
                if len(states) >= GROUP_BLOCKS:
                    yield rows(states.pop(next(iter(states))))
                states[number] = Anchors(labels, ids, data, wide, theta, norms, wanted)
                blocks[number] = [sorted({(x["id"], int(x["score"])) for x in f or []}) for f in found]
            one = Block(label, cell, *block)
            if ratio is None:
                states[number].positives(one)
            else:
                states[number].negatives(one, blocks[number], *ratio)
    for state in states.values():
        yield rows(state)


def _decimals(values: list) -> pa.Array:
    return pa.array([None if v is None else str(v) for v in values], pa.string())


def _anchor_blocks(anchors: DataFrame, dims: int, scale: float, refs: np.ndarray, size: int) -> DataFrame:
    """Anchors (vec_id, label, v, found) in blocks; an anchor's positives travel with it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for i in range(0, batch.num_rows, size):
                part = batch.slice(i, size)
                q = quantised(_padded(part.column(2), dims), scale)
                data, wide = _packed(q)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.array([part.column(1).to_pylist()], pa.list_(pa.int64())),
                     pa.array([part.column(0).to_numpy().tobytes()], pa.binary()), pa.array([data], pa.binary()),
                     pa.array([wide], pa.list_(pa.string())), pa.array([angles(q, refs).tobytes()], pa.binary()),
                     pa.array([_norms(q).tobytes()], pa.binary()), pa.array([part.column(3).to_pylist()], found)],
                    names=["number", "labels", "ids", "data", "wide", "angles", "norms", "found"])
                number += 1
    found = pa.list_(pa.list_(pa.struct([("id", pa.int64()), ("score", pa.string())])))
    return anchors.select("vec_id", "label", "v", "found").mapInArrow(
        run, "number bigint, labels array<bigint>, ids binary, data binary, wide array<string>, angles binary, norms binary, "
             "found array<array<struct<id:bigint,score:string>>>")


def _searched(anchors: DataFrame, blocks: DataFrame, rows: int, k: int, ratio: tuple[int, int] | None) -> DataFrame:
    """Anchor blocks and row blocks meet in an equi-join on (group of anchor
    blocks, shard of row blocks).  Every shard sends its best rows of each anchor,
    so there are no more shards than full blocks of ``rows``."""
    spark = blocks.sparkSession
    anchors = materialize(anchors, "anchors")
    groups = max(1, -(-anchors.count() // GROUP_BLOCKS))
    shards = max(1, min(shuffle_partitions(spark), -(-rows // ROWS)))
    q = (anchors.withColumn("g", F.pmod(F.hash("number"), F.lit(groups)))
         .withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))
    c = (blocks.withColumn("s", F.pmod(F.hash("block"), F.lit(shards)))
         .withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))))
    met = (c.alias("c").join(q.alias("q").hint("merge"), ["g", "s"])
           .select(*[F.col(f"q.{x}").alias(f"q_{x}") for x in ("number", "labels", "ids", "data", "wide", "angles", "norms", "found")],
                   *[F.col(f"c.{x}") for x in ("label", "cell", "ids", "data", "wide", "angles", "norms")]))
    kind = "anchor_id bigint, positive_id bigint, positive_score string, vec_id bigint, score string"
    out = met.mapInArrow(lambda b: _meet(b, k, ratio), kind)
    order = Window.partitionBy("anchor_id", "positive_id", "positive_score").orderBy(*_descending(F.col("score")), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _descending(score: Column) -> list[Column]:
    """Order of integers written as decimals, of any length, from the largest on."""
    below = score.startswith("-")
    return [below.asc(), F.when(below, -F.length(score)).otherwise(F.length(score)).desc(),
            F.when(~below, score).desc(), F.when(below, score).asc()]


def mine(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
         positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = 30, most: int = 90,
         scale: float = SCALE, references: int = REFERENCES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Components become floor(scale * x); a score is an exact integer inner
    product.  An anchor's positives are its ``positives`` best other rows of the
    same label, ties to the smaller id; a positive's negatives are the first
    ``negatives`` rows of other labels whose score lies between ``least`` and
    ``most`` percent of the positive's.

    Rows are laid out by label and nearest reference direction in the order of
    the angle to it, in blocks that keep the angles to all references.  For an
    anchor, a block's angles give an interval of cosines by the triangle
    inequality, times the norms an interval of scores, rounded to the safe side;
    inside a block the rows that can still score within the limits are one run
    of the sorted angles, and only that run is scored.

    Rows with a null id, label or vector, or a null or non-finite component
    take no part; any finite vector does (integers beyond float64 are Python
    ints; only a returned score beyond a bigint raises).  Shorter vectors count
    as ending in zeros.  Repeated rows count separately as positives and
    negatives, and once as an anchor (the smallest label, then vector); a row with the anchor's id is
    never its positive or negative.  A negative positive score has no negatives.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("bigint").alias("label"),
                          F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("v")))
    facts = rows.agg(F.max(F.size("v")).alias("dims"), F.count(F.lit(1)).alias("n")).first()
    dims = max(1, facts["dims"] or 1)
    sample = hash_sample(rows.select("vec_id", "v"), F.col("vec_id"), SAMPLE_ROWS).select("v").collect()
    raw = np.zeros((max(1, len(sample)), dims))
    for i, r in enumerate(sample):
        raw[i, :len(r["v"])] = r["v"]
    refs = choose_references(quantised(raw, scale).astype(np.float64), references)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            theta = angles(quantised(_padded(batch.column(2), dims), scale), refs)
            cell = theta.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(cell.astype(np.int32)), pa.array(theta[np.arange(len(cell)), cell]),
                 batch.column(0), batch.column(2)], names=["label", "cell", "angle", "vec_id", "v"])
    placed = rows.select("vec_id", "label", "v").mapInArrow(place, "label bigint, cell int, angle double, vec_id bigint, v array<double>")
    laid = (placed.repartitionByRange(shuffle_partitions(spark), "label", "cell", "angle", "vec_id")
            .sortWithinPartitions("label", "cell", "angle", "vec_id"))
    kind = "label bigint, block bigint, cell int, ids binary, data binary, wide array<string>, angles binary, norms binary"
    blocks = materialize(laid.mapInArrow(lambda b: _blocks(b, ROWS, dims, scale, refs), kind), "blocks")

    anchors = rows.where("is_anchor").groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("_a"))
    anchors = materialize(anchors.select("vec_id", "_a.label", "_a.v"), "anchors")
    none = F.lit(None).cast("array<struct<id:bigint,score:string>>").alias("found")
    near = _searched(_anchor_blocks(anchors.select("*", none), dims, scale, refs, ANCHOR_ROWS), blocks, facts["n"], positives, None)
    near = materialize(near.groupBy("anchor_id").agg(F.collect_list(F.struct(F.col("vec_id").alias("id"), "score")).alias("found")),
                       "positives")
    asking = anchors.join(near, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "v", "found")
    far = _searched(_anchor_blocks(asking, dims, scale, refs, ANCHOR_ROWS), blocks, facts["n"], negatives, (least, most))
    # a row may be a positive twice (repeated rows): its negatives are returned for each
    twice = near.select("anchor_id", F.explode("found").alias("f")).groupBy(
        "anchor_id", F.col("f.id").alias("positive_id"), F.col("f.score").alias("positive_score")).agg(F.count(F.lit(1)).alias("n"))
    out = far.join(twice, ["anchor_id", "positive_id", "positive_score"]).withColumn(
        "_copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"),
                      F.col("positive_score").cast("bigint").alias("positive_score"), F.col("score").cast("bigint").alias("negative_score"))
