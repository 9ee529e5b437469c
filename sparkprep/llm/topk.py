"""Exact top-k search by columnar branch and bound."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkprep.functions.materialize import materialize
from sparkprep.llm.common import shuffle_partitions
from sparkprep.llm.hard_negatives import _descending, _ints, _norms, _packed, _padded, _unpacked, finite, quantised

SCALE = 256.0
TOP = 5
QUERY_ROWS = 256        # queries in a block
CANDIDATE_ROWS = 4096   # candidates in a block
GROUP_BLOCKS = 64       # query blocks that one group of tasks searches
DIMENSIONS = 8          # dimensions added between two bounds
_BLOCK = "block bigint, ids binary, data binary, wide array<string>"
_EXACT = 2.0**53


def vertical_blocks(rows: DataFrame, size: int, dims: int, scale: float) -> DataFrame:
    """(id, vector) rows as blocks of up to ``size`` in vertical layout: one run per dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for i in range(0, batch.num_rows, size):
                part = batch.slice(i, size)
                data, wide = _packed(np.ascontiguousarray(quantised(_padded(part.column(1), dims), scale).T))
                ids = np.asarray(part.column(0).to_numpy(zero_copy_only=False), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([data], pa.binary()),
                     pa.array([wide], pa.list_(pa.string()))], names=["block", "ids", "data", "wide"])
                number += 1
    return rows.mapInArrow(run, _BLOCK)


def _matrix(ids: bytes, data: bytes, wide: list[str] | None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, dimensions x rows); float64, or Python ints where it does not hold them."""
    keys = np.frombuffer(ids, np.int64)
    if wide is None:
        return keys, np.frombuffer(data, np.float64).reshape(-1, len(keys))
    return keys, _unpacked(data, wide, len(wide) // max(1, len(keys)))


class Best:
    """The best candidates so far of every query in one block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.ids, self.vectors, self.k = ids, vectors, k
        self.scores: list[list[int]] = [[] for _ in ids]
        self.found = [np.zeros(0, np.int64) for _ in ids]

    def search(self, cand: np.ndarray, x: np.ndarray, step: int = DIMENSIONS) -> None:
        """Score one candidate block, dimension block by dimension block; after
        each, candidates whose partial score plus the remaining mass (product of
        the remaining norms) stays under the k-th best score are dropped."""
        q = self.vectors
        squares = _squares(x).sum(axis=1)
        order = np.argsort(-squares, kind="stable")
        x, q = x[order], q[order]
        x_mass, q_mass = _remaining(x, step), _remaining(q, step)
        if x.dtype == object or q.dtype == object or not x_mass[0].max(initial=0) * q_mass[0].max(initial=0) < _EXACT / 4:
            x, q = _ints(x), _ints(q)
        for i, own in enumerate(self.ids):
            alive = np.flatnonzero(cand != own)
            score = np.zeros(len(alive), x.dtype)
            floor = float(self.scores[i][-1]) if len(self.scores[i]) == self.k else None
            for n, d in enumerate(range(0, len(x), step), 1):
                score = score + q[d:d + step, i] @ x[d:d + step, alive]
                if floor is not None and len(alive):
                    mass = q_mass[n][i] * x_mass[n][alive]
                    partial = score.astype(np.float64)
                    bound = partial + mass + 1e-9 * (np.abs(partial) + mass + abs(floor)) + 1
                    keep = ~(bound < floor)  # what overflows is kept
                    if not keep.all():
                        alive, score = alive[keep], score[keep]
            if len(alive):
                if score.dtype != object and len(alive) > self.k:  # the k best and their ties
                    some = np.flatnonzero(score >= np.partition(score, -self.k)[-self.k])
                    alive, score = alive[some], score[some]
                both = [*zip(self.scores[i], self.found[i].tolist()), *zip((int(v) for v in score), cand[alive].tolist())]
                both = sorted(both, key=lambda r: (-r[0], r[1]))[:self.k]
                self.scores[i], self.found[i] = [r[0] for r in both], np.array([r[1] for r in both], np.int64)

    def rows(self) -> pa.RecordBatch:
        n = [len(s) for s in self.scores]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(self.ids, n)), pa.array(np.concatenate([np.zeros(0, np.int64), *self.found])),
             pa.array([str(v) for scores in self.scores for v in scores], pa.string())],
            names=["query_id", "vec_id", "score"])


def _squares(m: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return m.astype(np.float64) ** 2


def _remaining(m: np.ndarray, step: int) -> list[np.ndarray]:
    """Norms over the dimensions from 0, step, 2 step, ... on; last: none left."""
    out = [np.zeros(m.shape[1])]
    for d in reversed(range(0, len(m), step)):
        out.append(_norms(np.concatenate([m[d:d + step].astype(np.float64), out[-1][None]]).T))
    return out[::-1] if len(out) > 1 else [np.zeros(m.shape[1])]


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    states: dict[int, Best] = {}
    for batch in batches:
        for r in range(batch.num_rows):
            block, q_ids, q_data, q_wide, ids, data, wide = (c[r].as_py() for c in batch.columns)
            if block not in states:
                if len(states) >= GROUP_BLOCKS:
                    yield states.pop(next(iter(states))).rows()
                states[block] = Best(*_matrix(q_ids, q_data, q_wide), k)
            states[block].search(*_matrix(ids, data, wide))
    for best in states.values():
        yield best.rows()


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = TOP,
           scale: float = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k highest integer inner
    products over all other rows, ties to the smaller vec_id; exact.

    Queries and candidates are packed into blocks; blocks meet in an equi-join
    on (group of query blocks, shard of candidate blocks), and a task keeps
    each query's k best while candidate blocks stream by.  k rows per query and
    shard are shuffled for the final ranking.

    Vectors that are null or hold null or non-finite components take no part,
    nor do null ids; every finite vector does (integers beyond float64 are
    Python ints, and only a returned score beyond a bigint raises); shorter
    vectors count as ending in zeros; rows with the query's own vec_id
    are not its candidates, other repeated rows count separately as candidates
    and once as a query (the smallest vector); no candidates, no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"),
                          F.coalesce(is_query, F.lit(False)).alias("asks")).where(F.col("vec_id").isNotNull() & finite(F.col("v")))
    dims = max(1, rows.agg(F.max(F.size("v"))).first()[0] or 1)
    chosen = rows.where("asks").groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = materialize(vertical_blocks(chosen, QUERY_ROWS, dims, scale), "queries")
    groups = max(1, -(-queries.count() // GROUP_BLOCKS))
    shards = shuffle_partitions(spark)
    q = (queries.withColumn("g", F.pmod(F.hash("block"), F.lit(groups)))
         .withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))
    c = (vertical_blocks(rows.select("vec_id", "v"), CANDIDATE_ROWS, dims, scale).withColumn("s", F.pmod(F.hash("block"), F.lit(shards)))
         .withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))))
    met = (c.alias("c").join(q.alias("q").hint("merge"), ["g", "s"])
           .select("q.block", *[F.col(f"q.{x}").alias(f"q_{x}") for x in ("ids", "data", "wide")], "c.ids", "c.data", "c.wide"))
    found = met.mapInArrow(lambda b: _search(b, k), "query_id bigint, vec_id bigint, score string")
    order = Window.partitionBy("query_id").orderBy(*_descending(F.col("score")), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", F.col("score").cast("bigint").alias("score"))
