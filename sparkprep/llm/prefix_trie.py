"""Prefix trie of conversations, with count-min screening of prefix digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkprep.functions.joins import join_small
from sparkprep.functions.materialize import materialize
from sparkprep.llm.common import shuffle_partitions, word_count

SALT = 0x5EED
SKETCH_ROWS = 4
CELLS_PER_PREFIX = 4
MAX_WIDTH = 1 << 26     # cells of a sketch row; the whole sketch is at most 4 * 8 MB
_BLOCK = 1 << 16        # cells of a row that are merged together
HEAVY = 256             # a parent of more children is looked up by a measured broadcast
CHUNK = 4096            # ids that are joined into one string before a digest reads them
_KEY = ["depth", "dx", "dy"]


# -- turns in order --------------------------------------------------------------

def ordered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(turns, parts) of every conversation in the order of ``turn``.

    ``turns``: conv_id, _part, pos (0-based), a, b (hashes of role and text),
    words.  ``parts``: conv_id, _part, n, before.  A long conversation is spread
    over several parts (range partitions), so no task holds all of it.  Null
    turns come first, rows of one turn in the order of their hashes; null role
    or text reads as empty; rows without a conv_id take no part.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.select(
        F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).alias("turn"), F.xxhash64(role, text).alias("a"),
        F.xxhash64(text, F.lit(SALT), role).alias("b"), word_count(text).alias("words")).where(F.col("conv_id").isNotNull())
    order = [F.col("turn").asc_nulls_first(), F.col("a"), F.col("b")]
    ranged = materialize(rows.repartitionByRange(shuffle_partitions(rows.sparkSession), F.col("conv_id"), *order)
                         .withColumn("_part", F.spark_partition_id()), "ranged")
    before = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = materialize(ranged.groupBy("conv_id", "_part").agg(F.count(F.lit(1)).alias("n"))
                        .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "parts")
    inside = Window.partitionBy("conv_id", "_part").orderBy(*order)
    placed = ranged.withColumn("_in", F.row_number().over(inside) - 1).join(parts, ["conv_id", "_part"])
    return placed.select("conv_id", "_part", (F.col("_in") + F.col("before")).alias("pos"), "a", "b", "words"), parts


def sequences(turns: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, convs) for ``prefix_nodes``: the conversations as they are."""
    convs = parts.groupBy("conv_id").agg(F.sum("n").alias("len"))
    lens = parts.select("conv_id", "_part").join(convs, "conv_id")
    return turns.join(lens, ["conv_id", "_part"]), convs


def grafted_sequences(turns: DataFrame, parts: DataFrame, taken: Column, base: Column) -> tuple[DataFrame, DataFrame]:
    """(rows, convs) of rebuilt conversations: the first ``taken`` turns of the
    conversation ``base`` (both functions of conv_id), then the own turns after
    the first ``taken``.

    A base's head meets the conversations that ask for it in an equi-join; own
    turns learn their place through the table of parts.
    """
    turns = materialize(turns, "turns")
    counts = parts.groupBy("conv_id").agg(F.sum("n").alias("n"))
    plan = counts.withColumn("base", base).withColumn("h", taken)
    lens = plan.join(counts.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left")
    head = F.least(F.col("h"), F.coalesce(F.col("n_base"), F.lit(0)))
    plan = materialize(lens.select("conv_id", "base", "h", head.alias("head"),
                                   (head + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")), "plan")
    most = plan.agg(F.max("h")).first()[0] or 0
    heads = (turns.where(F.col("pos") < F.lit(most)).select(F.col("conv_id").alias("base"), "pos", "a", "b", "words")
             .join(plan.where(F.col("head") > 0), "base").where(F.col("pos") < F.col("h"))
             .select("conv_id", F.lit(-1).alias("_part"), "pos", "a", "b", "words", "len"))
    own = (turns.join(parts.select("conv_id", "_part").join(plan, "conv_id"), ["conv_id", "_part"])
           .where(F.col("pos") >= F.col("h"))
           .select("conv_id", "_part", (F.col("pos") - F.col("h") + F.col("head")).alias("pos"), "a", "b", "words", "len"))
    return heads.unionByName(own), plan.select("conv_id", "len")


# -- digests -----------------------------------------------------------------------

def prefix_digests(rows: DataFrame) -> DataFrame:
    """``rows`` with the digest (dx, dy) of each prefix and (px, py) of the one before.

    A prefix's digest is the exclusive or of 128-bit hashes of its turns with
    their places, so it is a running aggregate: inside every part by a window,
    over the parts of a conversation by a table with one row a part.
    """
    depth = (F.col("pos") + 1).alias("depth")
    hashed = rows.select("conv_id", "_part", depth, "len", "words", F.xxhash64("pos", "a", "b").alias("x"),
                         F.xxhash64("b", F.lit(SALT), "a", "pos").alias("y"))
    run = Window.partitionBy("conv_id", "_part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    runs = materialize(hashed.withColumn("rx", F.bit_xor("x").over(run)).withColumn("ry", F.bit_xor("y").over(run)), "runs")
    before = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = runs.groupBy("conv_id", "_part").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    offsets = (totals.select("conv_id", "_part", F.bit_xor("x").over(before).alias("ox"), F.bit_xor("y").over(before).alias("oy"))
               .where(F.col("ox").isNotNull()))
    joined = runs.join(offsets, ["conv_id", "_part"], "left")
    dx, dy = (F.col(f"r{c}").bitwiseXOR(F.coalesce(F.col(f"o{c}"), F.lit(0))) for c in "xy")
    out = joined.select("conv_id", "_part", "depth", "len", "words", dx.alias("dx"), dy.alias("dy"),
                        dx.bitwiseXOR(F.col("x")).alias("px"), dy.bitwiseXOR(F.col("y")).alias("py"))
    return materialize(out.sortWithinPartitions("conv_id", "depth"), "digests")


# -- count-min screening -------------------------------------------------------------

def screened(depth: Column) -> Column:
    """Depths 2**k and 3 * 2**k: the prefixes that the sketch counts."""
    third = (depth % 3 == 0)
    core = F.when(third, (depth / 3).cast("bigint")).otherwise(depth)
    return core.bitwiseAND(core - 1) == 0


def _cells(dx: np.ndarray, dy: np.ndarray, width: int, row: int) -> np.ndarray:
    mixed = dx.view(np.uint64) + np.uint64(row) * (dy.view(np.uint64) | np.uint64(1))
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - int(width).bit_length() + 1)).astype(np.int64)


class CountMin:
    """A count-min sketch of prefix digests whose counters stop at two.

    Only "counted once" is asked of it, so one bit a cell is kept: whether the
    cell was hit again.  A prefix with an untouched cell in any row was counted
    once, which proves that one conversation has it; a sketch that is too small
    proves less and errs to that side only.
    """

    def __init__(self, width: int, rows: int) -> None:
        self.width, self.rows = width, rows
        self.again = np.zeros((rows, width // 8), np.uint8)

    def single(self, dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
        out = np.zeros(len(dx), bool)
        for r in range(self.rows):
            at = _cells(dx, dy, self.width, r)
            out |= (self.again[r][at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 0
        return out


def _partial(batches: Iterator[pa.RecordBatch], width: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Cells that this task hits once, and more often, by sketch row and block of cells."""
    for batch in batches:
        dx, dy = (batch.column(i).to_numpy() for i in range(2))
        for r in range(rows):
            cells, n = np.unique(_cells(dx, dy, width, r), return_counts=True)
            block = cells // _BLOCK
            cut = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(cells) else np.zeros(0, np.int64)
            ends = np.r_[cut[1:], len(cells)]
            low = (cells % _BLOCK).astype(np.uint16)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(cut), r, np.int32)), pa.array(block[cut].astype(np.int32)),
                 pa.array([low[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary()),
                 pa.array([low[a:b][n[a:b] > 1].tobytes() for a, b in zip(cut, ends)], pa.binary())],
                names=["row", "block", "cells", "more"])


def _merged(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """One bitmap of the cells hit twice for every block; rows arrive block by block."""
    key, count = None, np.zeros(block, np.uint8)

    def bitmap() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()),
             pa.array([np.packbits(count > 1, bitorder="little").tobytes()], pa.binary())], names=["row", "block", "again"])
    for batch in batches:
        for row, at, cells, more in zip(*(c.to_pylist() for c in batch.columns)):
            if key != (row, at):
                if key:
                    yield bitmap()
                key, count = (row, at), np.zeros(block, np.uint8)
            for part in (cells, more):
                hit = np.frombuffer(part, np.uint16)
                count[hit] = np.minimum(count[hit] + 1, 2)
    if key:
        yield bitmap()


def sketch(digests: DataFrame, rows: int = SKETCH_ROWS, max_width: int = MAX_WIDTH) -> CountMin:
    """Counts the screened prefixes.  Tasks send the cells they hit; merging tasks
    send bitmaps, ``rows * width / 8`` bytes in all (at most 32 MB by default)."""
    chosen = digests.where(screened(F.col("depth"))).select("dx", "dy")
    n = chosen.count()
    width = min(max_width, max(_BLOCK, 1 << int(max(1, CELLS_PER_PREFIX * n - 1)).bit_length()))
    size = min(_BLOCK, width)
    cells = chosen.mapInArrow(lambda b: _partial(b, width, rows), "row int, block int, cells binary, more binary")
    merged = (cells.repartition(F.col("row"), F.col("block")).sortWithinPartitions("row", "block")
              .mapInArrow(lambda b: _merged(b, size), "row int, block int, again binary"))
    out = CountMin(width, rows)
    for r in merged.toLocalIterator():
        at = r["block"] * size // 8
        out.again[r["row"], at:at + size // 8] = np.frombuffer(r["again"], np.uint8)
    return out


def screen(digests: DataFrame, counts: CountMin) -> DataFrame:
    """``digests`` with ``single`` (proved to be of one conversation) and ``local``
    (so was the prefix before it, seen in the same task).

    An extension of a single prefix is single.  What a task has not seen, it
    does not claim, so any cut of a conversation between tasks is right.
    """
    shared = digests.sparkSession.sparkContext.broadcast(counts)
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in digests.schema.fields]
    names = digests.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (None, None, False)
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, depth, dx, dy = (batch.column(names.index(c)).to_numpy() for c in ("conv_id", *_KEY))
            core = np.where(depth % 3 == 0, depth // 3, depth)
            proved = (core & (core - 1)) == 0
            proved[proved] = shared.value.single(dx[proved], dy[proved])
            follows = np.r_[last[:2] == (conv[0], depth[0] - 1), (conv[1:] == conv[:-1]) & (depth[1:] == depth[:-1] + 1)]
            at = np.arange(len(conv))
            start = np.maximum.accumulate(np.where(follows, -1, at))
            single = np.maximum.accumulate(np.where(proved, at, -1)) >= np.maximum(start, 0)
            if last[2]:
                single |= start < 0  # the run goes on from the batch before
            local = follows & np.r_[last[2], single[:-1]]
            last = (int(conv[-1]), int(depth[-1]), bool(single[-1]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(single), pa.array(local)],
                                             names=[*names, "single", "local"])
    return digests.mapInArrow(run, ", ".join([*fields, "single boolean", "local boolean"]))


# -- digests of member lists ------------------------------------------------------------

def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Runs of one key in sorted rows, as strings of up to ``size`` ids."""
    for batch in batches:
        cols = [batch.column(i).to_numpy() for i in range(4)]
        n = batch.num_rows
        new = np.r_[True, np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)] if n else np.zeros(0, bool)
        start = np.flatnonzero(new)
        place = np.arange(n) - np.repeat(start, np.diff(np.r_[start, n]))
        cut = np.flatnonzero(place % size == 0)
        ids = cols[3].tolist()
        texts = [",".join(map(str, ids[a:b])) for a, b in zip(cut, np.r_[cut[1:], n])]
        yield pa.RecordBatch.from_arrays([pa.array(c[cut]) for c in cols] + [pa.array(texts, pa.string())],
                                         names=[*_KEY, "first", "ids"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, state = None, hashlib.sha256()
    for batch in batches:
        done: list[tuple] = []
        for *at, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if at != key:
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = at, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield _digest_rows(done)
    if key is not None:
        yield _digest_rows([(*key, state.hexdigest())])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())],
                                      names=[*_KEY, "ends_sha256"])


def end_digests(ends: DataFrame, size: int = CHUNK) -> DataFrame:
    """SHA-256 of the ascending ids that end at each node.

    Many tasks sort the ids and join them to strings; the digest, which can only
    be taken in order, streams over one row for every ``size`` ids of a node.
    """
    n = shuffle_partitions(ends.sparkSession)
    ids = ends.select(*_KEY, "conv_id")
    sorted_ids = ids.repartitionByRange(n, *_KEY, "conv_id").sortWithinPartitions(*_KEY, "conv_id")
    chunks = sorted_ids.mapInArrow(lambda b: _chunks(b, size), "depth bigint, dx bigint, dy bigint, first bigint, ids string")
    dealt = chunks.repartition(n, *_KEY).sortWithinPartitions(*_KEY, "first")
    return dealt.mapInArrow(_digested, "depth bigint, dx bigint, dy bigint, ends_sha256 string")


# -- nodes --------------------------------------------------------------------------------

def _parents(nodes: DataFrame) -> DataFrame:
    """``nodes`` with the conv_id of each one's parent.  Parents of many children
    are few and come by a measured broadcast, the others by an equi-join."""
    names = [F.col("depth").alias("_pd"), F.col("dx").alias("px"), F.col("dy").alias("py"), F.col("conv_id").alias("parent_conv_id")]
    kids = nodes.withColumn("_pd", F.col("depth") - 1)
    heavy = nodes.where(F.col("kids") > HEAVY).select(*names)
    light = nodes.where((F.col("kids") > 0) & (F.col("kids") <= HEAVY)).select(*names)
    root = kids.where(F.col("depth") == 0).withColumn("parent_conv_id", F.lit(None).cast("bigint"))
    first = materialize(join_small(kids.where(F.col("depth") > 0), heavy, ["_pd", "px", "py"]), "children")
    rest = first.where(F.col("parent_conv_id").isNull()).drop("parent_conv_id").join(light, ["_pd", "px", "py"], "left")
    # a parent that was emitted by its own task has one conversation, that of its child
    rest = rest.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "conv_id"))
    found = first.where(F.col("parent_conv_id").isNotNull())
    return found.unionByName(rest).unionByName(root)


def prefix_nodes(rows: DataFrame, convs: DataFrame, sketch_rows: int = SKETCH_ROWS, max_width: int = MAX_WIDTH) -> DataFrame:
    """One row per distinct prefix of ``rows`` (conv_id, _part, pos, a, b, words,
    len), from the root on, which all of ``convs`` (conv_id, len) share.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256, single (proved by the sketch).

    Prefixes after one that the sketch proves single are emitted where they are
    read; the others are grouped exactly by depth and 128-bit digest.  Sums over
    a subtree need no walk: every node is booked on its smallest member at its
    depth, so a node's subtree is what its members carry at its depth or below.
    No conversations, no rows.
    """
    digests = prefix_digests(rows)
    marked = materialize(screen(digests, sketch(digests, sketch_rows, max_width)), "screened")
    alone = marked.where("local").select(
        "conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), F.lit(1).cast("bigint").alias("n_convs"),
        (F.col("len") > F.col("depth")).cast("bigint").alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"),
        F.lit(0).cast("bigint").alias("saved_tokens"),
        F.sha2(F.when(F.col("len") == F.col("depth"), F.col("conv_id").cast("string")).otherwise(F.lit("")), 256)
        .alias("ends_sha256"), F.lit(True).alias("single"))
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    roots = convs.select("conv_id", F.lit(-2).alias("_part"), zero.alias("depth"), "len", zero.alias("words"),
                         zero.alias("dx"), zero.alias("dy"), none.alias("px"), none.alias("py"), F.lit(False).alias("single"))
    shared = materialize(marked.where(~F.col("local")).select(*roots.columns).unionByName(roots), "shared")

    groups = shared.groupBy(*_KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"),
        F.min("px").alias("px"), F.min("py").alias("py"), F.max("single").alias("single"), F.max("len").alias("len"))
    groups = materialize(groups, "groups")
    kids = (groups.groupBy((F.col("depth") - 1).alias("depth"), F.col("px").alias("dx"), F.col("py").alias("dy"))
            .agg(F.count(F.lit(1)).alias("kids")))
    children = F.when(F.col("single"), (F.col("len") > F.col("depth")).cast("bigint")).otherwise(F.col("kids"))
    nodes = materialize(groups.join(kids, _KEY, "left").withColumn("kids", F.coalesce("kids", F.lit(0)))
                        .withColumn("n_children", children), "nodes")

    booked = nodes.select(*_KEY, "conv_id", ((F.col("n_convs") - 1) * F.col("words")).alias("value"),
                          (F.col("n_children") == 0).cast("int").alias("leaf"))
    paths = materialize(shared.join(booked, [*_KEY, "conv_id"], "left")
                        .select("conv_id", "_part", *_KEY, "len", F.coalesce("value", F.lit(0)).alias("value"),
                                F.coalesce("leaf", F.lit(0)).alias("leaf")), "paths")
    later = Window.partitionBy("conv_id").orderBy(F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    totals = paths.groupBy("conv_id", "_part").agg(
        F.sum("value").alias("value"), F.max(F.when(F.col("depth") == F.col("len"), F.col("leaf"))).alias("leaf"))
    # a conversation whose last prefix its own task emitted has a leaf of its own
    totals = totals.select("conv_id", "_part", F.coalesce(F.sum("value").over(later), F.lit(0)).alias("after"),
                           F.coalesce(F.max("leaf").over(Window.partitionBy("conv_id")), F.lit(1)).alias("ends_leaf"))
    run = Window.partitionBy("conv_id", "_part").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    below = (paths.withColumn("value", F.sum("value").over(run)).join(totals, ["conv_id", "_part"])
             .groupBy(*_KEY).agg(F.sum(F.col("value") + F.col("after")).alias("saved_tokens"),
                                 F.sum("ends_leaf").alias("n_leaves")))
    ends = end_digests(shared.where(F.col("depth") == F.col("len")))
    full = _parents(nodes).join(below, _KEY).join(ends, _KEY, "left")
    return full.select("conv_id", "depth", "parent_conv_id", "n_convs", F.col("n_children").cast("bigint").alias("n_children"),
                       F.col("n_leaves").cast("bigint").alias("n_leaves"), "saved_tokens",
                       F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
                       "single").unionByName(alone)


def conversation_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                      text_col: str = "text") -> DataFrame:
    """The trie of the conversations as they are, with the last role and text of
    every node's prefix (null at the root): ``prefix_nodes`` and role, text.

    Rows without a conv_id take no part, null roles and texts read as empty,
    other columns are not read.  A long text is hashed where it is read; only
    its hashes are shuffled until the texts of the nodes are looked up.
    """
    turns, parts = ordered_turns(conversations, conv_col, turn_col, role_col, text_col)
    turns = materialize(turns, "turns")
    nodes = prefix_nodes(*sequences(turns, parts))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    said = conversations.select(F.xxhash64(role, text).alias("a"), F.xxhash64(text, F.lit(SALT), role).alias("b"),
                                role.alias("role"), text.alias("text")).dropDuplicates(["a", "b"])
    last = turns.select("conv_id", (F.col("pos") + 1).alias("depth"), "a", "b")
    return nodes.join(last, ["conv_id", "depth"], "left").join(said, ["a", "b"], "left").drop("a", "b")
