"""Exact removal of long repeated byte strings, with a logarithmic family of suffix arrays."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep.functions.materialize import materialize
from sparkprep.llm.bytehash import Hasher, mix
from sparkprep.llm.common import HEAVY, WORD, bounded_batches, byte_groups, packed, row_key, tidy, utf8

MATCH = 400
SEED_BYTES = 48
BATCHES = 4
CELLS = (64, 8, 1)         # widths in which undecided strings are looked at
BROADCAST_BYTES = 24 << 20  # largest lists of cells or spans that are broadcast
ITEM_BYTES = 32            # bytes that a cell, a span or a text's key may take there
LIST_BYTES = 1 << 20       # a list of cells covers so many bytes of one text
SEED = 7
GROUP_BYTES = 1 << 19

_U = np.uint64
_HIGH = _U(0xFFFFFFFF00000000)


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width`` values, from block-wise running minima."""
    n = len(x)
    if width == 1 or n < width:
        return x[:max(0, n - width + 1)]
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


class Sampler:
    """Samples the suffixes of byte texts so that every ``match``-byte string holds one.

    A string's sample is its leftmost ``seed_bytes``-gram of least hash, so
    equal strings are sampled at equal places, whatever surrounds them.
    """

    def __init__(self, match: int = MATCH, seed_bytes: int = SEED_BYTES) -> None:
        self.match, self.k = match, min(seed_bytes, match)
        self.key, self.hull = Hasher(SEED), Hasher(SEED + 1)

    def samples(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, pos, lo, hi, key, hull) of every sampled suffix: it is the sample
        of the strings that start at lo..hi (places in the row), ``key`` hashes
        its first bytes and ``hull`` all bytes of those strings."""
        empty = tuple(np.zeros(0, t) for t in (np.int64,) * 4 + (np.uint64,) * 2)
        n, width = len(data), self.match - self.k + 1
        if n < self.match:
            return empty
        prefix = self.key.prefix(data)
        at = np.arange(n - self.k + 1)
        grams = mix(self.key.spans(prefix, at, at + self.k))
        least = sliding_minimum((grams & _HIGH) | at.astype(np.uint64), width)  # ties: the leftmost
        sample = (least & ~_HIGH).astype(np.int64)
        starts = np.arange(len(sample))
        row = np.searchsorted(offsets, starts, "right") - 1
        inside = starts + self.match <= offsets[row + 1]
        starts, sample, row = starts[inside], sample[inside], row[inside]
        if not len(starts):
            return empty
        new = np.r_[True, (sample[1:] != sample[:-1]) | (row[1:] != row[:-1])]
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(starts)] - 1
        lo, hi, pos, row = starts[first], starts[last], sample[first], row[first]
        hull = mix(self.hull.spans(self.hull.prefix(data), lo, hi + self.match) + (hi - lo).astype(np.uint64)
                   + ((pos - lo).astype(np.uint64) << _U(32)))
        base = offsets[row]
        return row, pos - base, lo - base, hi - base, grams[pos], hull

    def cells(self, data: np.ndarray, offsets: np.ndarray, row: np.ndarray, pos: np.ndarray, a1: np.ndarray,
              a2: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(core, hull) of cells of strings that start a1..a2 bytes before a sample.

        ``core`` hashes the bytes that all strings of the whole cell of ``width``
        starts have in common, ``hull`` all bytes of the strings a1..a2.
        """
        prefix = self.hull.prefix(data)
        at = offsets[row] + pos
        first = a1 // width * width
        core = self.hull.spans(prefix, at - first, at - first - width + 1 + self.match)
        hull = self.hull.spans(prefix, at - a2, at - a1 + self.match)
        return mix(core), mix(hull + a1.astype(np.uint64) + (a2.astype(np.uint64) << _U(32)))


# -- documents and samples -----------------------------------------------------

def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(*row_key(id_col, text_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))


def sampled_suffixes(keyed: DataFrame, match: int, seed_bytes: int, batches: int) -> DataFrame:
    """``_d, _t, pos, lo, hi, key, hull, batch`` of every sampled suffix."""
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(match, seed_bytes)
        for batch in stream:
            data, offsets = utf8(batch.column(2))
            ids, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b in byte_groups(offsets, GROUP_BYTES):
                base = offsets[a]
                row, pos, lo, hi, key, hull = sampler.samples(data[base:offsets[b]], offsets[a:b + 1] - base)
                if len(row):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[a + row]), pa.array(marks[a + row]),
                         *[pa.array(x.astype(np.int32)) for x in (pos, lo, hi)],
                         pa.array(key.view(np.int64)), pa.array(hull.view(np.int64))],
                        names=["_d", "_t", "pos", "lo", "hi", "key", "hull"])
    rows = keyed.where(F.octet_length("_text") >= match).mapInArrow(
        tidy(run), "_d bigint, _t bigint, pos int, lo int, hi int, key bigint, hull bigint")
    return rows.withColumn("batch", F.pmod(F.xxhash64("_d", "_t"), F.lit(batches)).cast("int"))


# -- the logarithmic family ------------------------------------------------------

class SuffixFamily:
    """Suffix arrays of geometrically growing size.

    A level is a table of sampled suffixes by key, sorted, with the number of
    suffixes per key.  A new batch becomes a level of size one; while the last
    level has its size, the two merge into one of twice the size.  The merge and
    the merge-scan against the larger levels find the keys that occur again.
    """

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []
        self.met: list[DataFrame] = []

    @staticmethod
    def _array(rows: DataFrame) -> DataFrame:
        counted = rows.groupBy("key").agg(F.sum("n").alias("n"))
        return materialize(counted.sortWithinPartitions("key"), "suffixes")

    def add(self, batch: DataFrame) -> None:
        array, size = self._array(batch.select("key", F.lit(1).cast("bigint").alias("n"))), 1
        while self.levels and self.levels[-1][0] == size:
            array, size = self._array(array.unionByName(self.levels.pop()[1])), 2 * size
        for _, level in self.levels:
            self.met.append(materialize(array.select("key").join(level.select("key"), "key"), "met"))
        self.levels.append((size, array))

    def repeated(self) -> DataFrame:
        """``key, n``: keys of suffixes that occur at least twice in what was added;
        ``n`` tells about how often, levels that hold a key once may be left out."""
        found = ([level.where(F.col("n") > 1) for _, level in self.levels]
                 + [met.withColumn("n", F.lit(1).cast("bigint")) for met in self.met])
        return reduce(DataFrame.unionByName, found).groupBy("key").agg(F.sum("n").alias("n"))


# -- exact matches ----------------------------------------------------------------

def _joined_lists(keyed: DataFrame, lists: DataFrame, column: str, how: str = "inner") -> DataFrame:
    """Texts with their lists: the lists are broadcast if they are measured to be
    small, else both sides are shuffled."""
    size = lists.agg(F.sum(F.size(column) * ITEM_BYTES + ITEM_BYTES)).first()[0] or 0
    return keyed.join(F.broadcast(lists) if size <= BROADCAST_BYTES else lists, ["_d", "_t"], how)


def _members(rows: DataFrame, groups: DataFrame, on: list[str], weight: str) -> DataFrame:
    """``rows`` whose key is in ``groups``, which has one row per key and, as ``weight``,
    about the number of rows under it.  Keys of many rows are few: they come by a broadcast
    measured to be small, so that their rows stay where they are, the others by an equi-join."""
    groups = materialize(groups.select(*on, weight), "groups")
    heavy, light = (groups.where(c).select(*on) for c in (F.col(weight) > HEAVY, F.col(weight) <= HEAVY))
    many = heavy.count()
    if not many or many * ITEM_BYTES * len(on) > BROADCAST_BYTES:
        return rows.join(groups.select(*on), on, "left_semi")
    common = F.broadcast(heavy)
    return rows.join(common, on, "left_semi").unionByName(
        rows.join(common, on, "left_anti").join(light, on, "left_semi"))


def _hashed_cells(keyed: DataFrame, cells: DataFrame, match: int, seed_bytes: int, width: int) -> DataFrame:
    """``cells`` (_d, _t, pos, key, a1, a2, open) cut at multiples of ``width``,
    with their core and hull hashes."""
    items = (cells.groupBy("_d", "_t", F.floor(F.col("pos") / LIST_BYTES).alias("_slice"))
             .agg(F.collect_list(F.struct("pos", "key", "a1", "a2", "open")).alias("_cells")).drop("_slice"))
    texts = _joined_lists(keyed, materialize(items, "cells"), "_cells")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(match, seed_bytes)
        for batch in stream:
            data, offsets = utf8(batch.column(2))
            lists = batch.column(3)
            ends = lists.offsets.to_numpy().astype(np.int64)
            fields = [lists.values.field(i).to_numpy(zero_copy_only=False) for i in range(5)]
            ids, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b in byte_groups(offsets, GROUP_BYTES):
                base = offsets[a]
                row = np.repeat(np.arange(b - a), np.diff(ends[a:b + 1]))
                pos, key, a1, a2, open_ = (f[ends[a]:ends[b]] for f in fields)
                pieces = (a2 // width - a1 // width + 1).astype(np.int64)
                row, pos, key, a1, a2, open_ = (np.repeat(x, pieces) for x in (row, pos, key, a1, a2, open_))
                pos, a1, a2 = (x.astype(np.int64) for x in (pos, a1, a2))
                nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                j = a1 // width + nth
                a1, a2 = np.maximum(a1, j * width), np.minimum(a2, j * width + width - 1)
                core, hull = sampler.cells(data[base:offsets[b]], offsets[a:b + 1] - base, row, pos, a1, a2, width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[a + row]), pa.array(marks[a + row]), pa.array(pos.astype(np.int32)),
                     pa.array(key), pa.array(a1.astype(np.int32)), pa.array(a2.astype(np.int32)),
                     pa.array(open_.astype(bool)), pa.array(core.view(np.int64)), pa.array(hull.view(np.int64))],
                    names=["_d", "_t", "pos", "key", "a1", "a2", "open", "core", "hull"])
    hashed = texts.select("_d", "_t", "_text", "_cells").mapInArrow(
        tidy(run), "_d bigint, _t bigint, pos int, key bigint, a1 int, a2 int, open boolean, core bigint, hull bigint")
    return materialize(hashed, "hashed")


def repeated_strings(keyed: DataFrame, match: int = MATCH, seed_bytes: int = SEED_BYTES,
                     batches: int = BATCHES) -> DataFrame:
    """``_d, _t, lo, hi``: the strings of ``match`` bytes that start at lo..hi
    occur somewhere else too.  All such strings are covered."""
    seed_bytes = min(seed_bytes, match)
    rows = materialize(sampled_suffixes(keyed, match, seed_bytes, batches), "samples")
    family = SuffixFamily()
    for b in range(batches):
        family.add(rows.where(F.col("batch") == b))
    again = materialize(_members(rows.drop("batch"), family.repeated(), ["key"], "n"), "again")

    # samples with equal hulls: all their strings repeat; a hull of its own: look closer
    place = F.struct("_d", "_t", "pos", "lo", "hi")
    hulls = materialize(again.groupBy("key", "hull").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("at")), "hulls")
    equal = _members(again, hulls.where(F.col("n") > 1), ["key", "hull"], "n")
    found = [equal.select("_d", "_t", "lo", "hi")]
    mixed = hulls.groupBy("key").agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") > 1)
    cells = _members(hulls, mixed, ["key"], "_m").select(
        "at._d", "at._t", "at.pos", "key", (F.col("at.pos") - F.col("at.hi")).alias("a1"),
        (F.col("at.pos") - F.col("at.lo")).alias("a2"), (F.col("n") == 1).alias("open"))
    for width in [w for w in CELLS if 2 * w <= match or w == 1]:
        hashed = _hashed_cells(keyed, cells, match, seed_bytes, width)
        strings = hashed.withColumn("_j", F.expr(f"a1 div {width}"))
        group = ["key", "_j", "core"]
        if width == 1:  # one string per cell
            twice = strings.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
            done = _members(strings.where("open"), twice, group, "_n")
            found.append(done.select("_d", "_t", (F.col("pos") - F.col("a2")).alias("lo"),
                                     (F.col("pos") - F.col("a1")).alias("hi")))
            break
        same = [*group, "a1", "a2", "hull"]
        place = F.struct("_d", "_t", "pos")
        by_hull = materialize(strings.groupBy(*same).agg(F.count(F.lit(1)).alias("_n"), F.max("open").alias("_open"),
                                                         F.min(place).alias("_at")), "by_hull")
        equal = by_hull.where((F.col("_n") > 1) & F.col("_open"))
        done = _members(strings.where("open"), equal, same, "_n")
        found.append(done.select("_d", "_t", (F.col("pos") - F.col("a2")).alias("lo"),
                                 (F.col("pos") - F.col("a1")).alias("hi")))
        # cores that several hulls share, one of them still open
        shared = (by_hull.groupBy(*group).agg(F.count(F.lit(1)).alias("_m"),
                                              F.max((F.col("_n") == 1) & F.col("_open")).alias("_some"))
                  .where((F.col("_m") > 1) & F.col("_some")))
        cells = _members(by_hull, shared, group, "_m").select(
            "_at._d", "_at._t", "_at.pos", "key", "a1", "a2", ((F.col("_n") == 1) & F.col("_open")).alias("open"))
    return reduce(DataFrame.unionByName, found)


def kept_parts(strings: DataFrame, match: int = MATCH) -> DataFrame:
    """``_d, _t, _spans``: per text the maximal runs (start, end) that the strings cover."""
    spans = strings.select("_d", "_t", "lo", "hi").distinct()
    lists = spans.groupBy("_d", "_t").agg(F.collect_list(F.struct("lo", "hi")).alias("_list"))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            out = []
            for items in batch.column(2):
                lo, hi = (items.values.field(i).to_numpy().astype(np.int64) for i in range(2))
                order = np.argsort(lo, kind="stable")
                lo, end = lo[order], np.maximum.accumulate(hi[order] + match)
                new = np.flatnonzero(np.r_[True, lo[1:] > end[:-1]])
                out.append([{"lo": int(s), "hi": int(e)} for s, e in
                            zip(lo[new], end[np.r_[new[1:], len(lo)] - 1])])
            kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)],
                                             names=["_d", "_t", "_spans"])
    return materialize(lists.mapInArrow(tidy(run), "_d bigint, _t bigint, _spans array<struct<lo:bigint,hi:bigint>>"),
                       "spans")


def whole_words(data: Column, lo: Column, hi: Column) -> Column:
    """Number of words of the bytes that lie wholly in lo..hi (0-based, end excluded)."""
    def piece(start: Column, n: Column) -> Column:
        return F.substring(data, (start + 1).cast("int"), n.cast("int")).cast("string")
    inside = F.regexp_count(piece(lo, hi - lo), F.lit(WORD))
    # a word that goes on beyond either end is not whole
    cut_first = (lo > 0) & piece(lo - 1, F.lit(2)).rlike(f"^{WORD}$")
    cut_last = (hi < F.octet_length(data)) & piece(hi - 1, F.lit(2)).rlike(f"^{WORD}$")
    return F.greatest(inside - cut_first.cast("int") - cut_last.cast("int"), F.lit(0))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", match: int = MATCH,
                   seed_bytes: int = SEED_BYTES, batches: int = BATCHES, min_words: int = 0) -> DataFrame:
    """``docs`` (as struct ``_row``) with ``spans`` (removed byte runs), ``parts`` (remaining byte
    strings, in order), ``n_bytes``, ``n_removed``.

    A byte is removed if a ``match``-byte string over it also starts anywhere
    else, in another document or this one; strings never cross documents and
    are judged on the input.  With ``min_words``, only runs of so many whole words
    go.  Null texts read as empty; repeated rows are each
    other's copies; texts shorter than ``match`` stay whole; an empty table
    gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    keyed = _keyed(docs, id_col, text_col)
    spans = kept_parts(repeated_strings(keyed, match, seed_bytes, batches), match)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    marked = docs.select(packed(docs), *row_key(id_col, text_col), F.encode(text, "UTF-8").alias("_bytes"))
    joined = _joined_lists(marked, spans, "_spans", "left")
    spans_ = F.coalesce(F.col("_spans"), F.array().cast("array<struct<lo:bigint,hi:bigint>>"))
    if min_words:
        spans_ = F.filter(spans_, lambda s: whole_words(F.col("_bytes"), s["lo"], s["hi"]) >= F.lit(min_words))
    n = F.octet_length("_bytes").cast("bigint")
    # a part starts at 0 and at every run's end, and stops at the next run's start or the end
    starts = F.concat(F.array(F.lit(0).cast("bigint")), F.transform("spans", lambda s: s["hi"]))
    stops = F.concat(F.transform("spans", lambda s: s["lo"]), F.array(F.col("n_bytes")))
    cut = F.transform(F.arrays_zip(starts.alias("a"), stops.alias("b")), lambda p: F.substring(
        F.col("_bytes"), (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int")))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x["hi"] - x["lo"])
    return (joined.withColumn("spans", spans_).withColumn("n_bytes", n).withColumn("n_removed", removed)
            .withColumn("parts", cut).select("_row", "spans", "parts", "n_bytes", "n_removed"))


def joined_bytes(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(b""), lambda s, x: F.concat(s, x))


def joined_text(parts: Column) -> Column:
    """The parts as text; a character that a run has cut through goes as a whole."""
    whole = F.transform(parts, lambda p: F.regexp_replace(F.make_valid_utf8(p.cast("string")), "^�+|�+$", ""))
    return F.array_join(F.when(F.size(parts) > 1, whole).otherwise(F.transform(parts, lambda p: p.cast("string"))), "")
