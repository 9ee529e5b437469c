"""SimHash near-duplicates, linked with vantage-point trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep.functions.materialize import materialize
from sparkprep.llm.common import bounded_batches, text_hash, tidy
from sparkprep.llm.components import connected_components

SHINGLE = 3
MAX_BITS = 2
SEED = 42
SHARD_ROWS = 4096        # fingerprints that a shard of the tree should own
MAX_DEPTH = 14           # at most 2**14 shards; beyond that shards grow
SAMPLE_PER_SHARD = 64    # fingerprints that fit the top of the tree, per shard
LEAF = 64
_CHUNK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of a text's word shingles, repeats included; 0 without words."""
    words = text.lower().split()  # bytes: lowers A-Z, splits at 0x20 and 0x09-0x0D
    if not words:
        return 0
    if len(words) < shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))
    counts = np.zeros(64, np.int64)
    for i in range(0, len(shingles), _CHUNK):
        digests = b"".join([xxhash.xxh64_digest(s, seed) for s in shingles[i:i + _CHUNK]])
        bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(shingles)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` (signed 64-bit) of every whole text; one pass, no shuffle."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            fps = np.array([fingerprint(t.as_py() or b"", shingle) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])
    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string"))
            .mapInArrow(tidy(run), f"doc_id {kind}, fp bigint"))


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def choose_split(points: np.ndarray, rng: np.random.Generator, reach: int) -> tuple[np.uint64, int]:
    """A vantage point among ``points`` and a radius near the median distance,
    with as few points as possible within reach of the border."""
    best = None
    for pivot in rng.choice(points, min(16, len(points)), replace=False):
        d = np.sort(hamming(points, pivot))
        for at in (0.4, 0.5, 0.6):
            radius = int(d[int(at * (len(d) - 1))])
            inner = np.searchsorted(d, radius, "right")
            near = np.searchsorted(d, radius + reach, "right") - np.searchsorted(d, radius + 1 - reach, "left")
            cost = near + abs(2 * inner - len(d))
            if inner < len(d) and (best is None or cost < best[0]):
                best = (cost, pivot, radius)
    return (best[1], best[2]) if best else (points[0], 127)  # 127: all inside


class TopTree:
    """The upper levels of a vantage-point tree, fitted on a sample; its leaves are shards.

    Every fingerprint is owned by one shard.  It also visits the shards that
    may own a fingerprint within reach: at the split where its way leaves a
    border within reach, by the triangle bound.  Of two shards only one is
    visited by the other's, so a pair is looked at from one side.
    """

    def __init__(self, sample: np.ndarray, depth: int, reach: int) -> None:
        self.depth, self.reach = depth, reach
        rng = np.random.Generator(np.random.PCG64(SEED))
        self.pivots = np.zeros(2**depth, np.uint64)
        self.radii = np.full(2**depth, 127, np.int16)
        nodes = {1: np.unique(sample)}
        for node in range(1, 2**depth):
            points = nodes.pop(node)
            if len(points) > 1:
                self.pivots[node], self.radii[node] = choose_split(points, rng, reach)
            inside = hamming(points, self.pivots[node]) <= self.radii[node]
            nodes[2 * node], nodes[2 * node + 1] = points[inside], points[~inside]

    def route(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, shard, owner) of every place where a fingerprint goes."""
        rows = np.arange(len(fps))
        node = np.ones(len(fps), np.int64)
        owner = np.ones(len(fps), bool)
        for _ in range(self.depth):
            d, r = hamming(fps[rows], self.pivots[node]), self.radii[node]
            home = (d > r).astype(np.int64)
            own = owner
            crosses_out = np.where(own, (home == 0) & (d >= r + 1 - self.reach), (d >= r + 1 - self.reach))
            goes_in = ~own & (d <= r + self.reach)
            rows, node, owner = (np.concatenate(x) for x in zip(
                (rows[own], 2 * node[own] + home[own], np.ones(own.sum(), bool)),
                (rows[goes_in], 2 * node[goes_in], np.zeros(goes_in.sum(), bool)),
                (rows[crosses_out], 2 * node[crosses_out] + 1, np.zeros(crosses_out.sum(), bool))))
        return rows, node - 2**self.depth, owner


class VPTree:
    """All pairs within reach between queries and points, in blocks."""

    def __init__(self, points: np.ndarray, reach: int) -> None:
        self.points, self.reach = points, reach
        self.rng = np.random.Generator(np.random.PCG64(SEED))
        self.root = self._build(np.arange(len(points)))

    def _build(self, index: np.ndarray):  # noqa: ANN202
        if len(index) <= LEAF:
            return index
        own = self.points[index]
        pivot, radius = choose_split(own[:: max(1, len(own) // 512)], self.rng, self.reach)
        inside = hamming(own, pivot) <= radius
        if inside.all() or not inside.any():
            return index
        return pivot, radius, self._build(index[inside]), self._build(index[~inside])

    def pairs(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        todo = [(self.root, np.arange(len(queries)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if isinstance(node, tuple):
                pivot, radius, inner, outer = node
                d = hamming(queries[rows], pivot)
                todo.append((inner, rows[d <= radius + self.reach]))
                todo.append((outer, rows[d >= radius + 1 - self.reach]))
                continue
            for a in range(0, len(node), 4 * LEAF):
                leaf = node[a:a + 4 * LEAF]
                q, p = np.nonzero(hamming(queries[rows][:, None], self.points[leaf][None]) <= self.reach)
                found.append((rows[q], leaf[p]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([q for q, _ in found]), np.concatenate([p for _, p in found])


class Forest:
    """Union-find over array positions; a root is the smallest position."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        x = self.parent[x]
        while (up := self.parent[x]) is not None and (up != x).any():
            x = up
        return x

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


def shard_links(batches: Iterator[pa.RecordBatch], reach: int) -> Iterator[pa.RecordBatch]:
    """Links within one shard: rows (owner, fp), owners first.  Emits a
    spanning forest of the owners and one link per visitor that meets one."""
    def edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))],
                                          names=["a", "b"])

    own, tree, forest, points = [], None, None, np.zeros(0, np.uint64)

    def ready() -> None:
        nonlocal tree, forest, points
        if tree is None:
            points = np.concatenate([points, *own])
            tree, forest = VPTree(points, reach), Forest(len(points))
            for i in range(0, len(points), 2048):
                q, p = tree.pairs(points[i:i + 2048])
                forest.union(q + i, p)

    for batch in batches:
        owner = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
        fps = batch.column(1).to_numpy().view(np.uint64)
        if owner.any():
            own.append(fps[owner].copy())
        guests = np.flatnonzero(~owner)
        if len(guests):
            ready()
            for i in range(0, len(guests), 2048):
                rows = guests[i:i + 2048]
                q, p = tree.pairs(fps[rows])
                if len(q):
                    order = np.argsort(q, kind="stable")
                    q, p = q[order], p[order]
                    same = q[1:] == q[:-1]
                    forest.union(p[1:][same], p[:-1][same])
                    first = np.r_[True, ~same]
                    yield edges(fps[rows[q[first]]], points[p[first]])
    ready()
    root = forest.roots(np.arange(len(points)))
    moved = np.flatnonzero(root != np.arange(len(points)))
    if len(moved):
        yield edges(points[moved], points[root[moved]])


def links(classes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` whose components are
    those of all pairs within ``max_bits``."""
    n = classes.count()
    depth = min(MAX_DEPTH, max(0, int(np.ceil(np.log2(max(1, n) / SHARD_ROWS)))))
    rows = (classes.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE_PER_SHARD * 2**depth).select("fp").collect()
            if depth else [])
    tree = TopTree(np.array([r["fp"] for r in rows], np.int64).view(np.uint64), depth, max_bits)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for i in range(0, len(fps), 8192):
                at, shard, owner = tree.route(fps[i:i + 8192].view(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.astype(np.int32)), pa.array(owner), pa.array(fps[i + at])],
                    names=["shard", "owner", "fp"])

    placed = classes.select("fp").mapInArrow(tidy(route), "shard int, owner boolean, fp bigint")
    dealt = placed.repartitionById(2**depth, F.col("shard")).sortWithinPartitions(F.col("owner").desc())
    return dealt.select("owner", "fp").mapInArrow(tidy(lambda b: shard_links(b, max_bits)), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fp, component_id``, one row per input row.

    Equal fingerprints form a class; classes within ``max_bits`` differing bits
    are linked by a vantage-point tree whose top levels deal fingerprints out to
    shards.  ``component_id`` is the smallest doc_id reachable over links, its
    own included.

    Null or wordless texts have fingerprint 0 and are linked like any other;
    every row is a text of its own, also where rows share a doc_id; a null
    doc_id never names a component; an empty table gives an empty result; other
    columns are not read.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, shingle), "simhash")
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    parts = connected_components(links(classes, max_bits))
    members = classes.join(parts, F.col("fp") == F.col("node"))
    names = members.groupBy("component").agg(F.min("rep").alias("name"))
    named = members.join(names, "component").select(F.col("fp").alias("linked"), "name")
    own = (classes.join(named, F.col("fp") == F.col("linked"), "left")
           .select("fp", F.coalesce("name", "rep").alias("component_id")))
    return fps.join(own, "fp").select("doc_id", "fp", "component_id")


def keepers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
            max_bits: int = MAX_BITS) -> DataFrame:
    """``id, text_hash, n``: the row key of one document of every component of
    ``near_duplicates``, and the number of rows under that key.

    It is the smallest by id (null last) and text hash.  Components are told
    apart by their smallest fingerprint, which is never null; rows under one key
    have one text, so no two components have the same key.
    """
    key = F.struct(F.col(id_col).isNull().alias("unnamed"), F.col(id_col).alias("id"), text_hash(text_col).alias("text_hash"))
    fps = fingerprints(docs.select(key.alias("key"), F.col(text_col).alias("text")), "key", "text", shingle)
    first = fps.groupBy("fp", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    classes = materialize(first.groupBy("fp").agg(F.min(F.struct("doc_id", "n")).alias("first")), "classes")
    parts = connected_components(links(classes, max_bits))
    named = classes.join(parts, F.col("fp") == F.col("node"), "left")
    best = named.groupBy(F.coalesce("component", "fp").alias("component")).agg(F.min("first").alias("first"))
    return best.select("first.doc_id.id", "first.doc_id.text_hash", "first.n")
