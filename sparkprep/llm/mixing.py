"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep.functions.materialize import materialize
from sparkprep.functions.ordinal import prefix_sums
from sparkprep.llm.common import BROADCAST_BYTES, packed, rank_in_group, unpacked, word_count


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """One row per source: source_size, weight, target.

    Sources take the weights in code-point order (null last), repeating.  All
    share ``share`` times the total size; a target stops at ``cap`` times its
    source's size and the excess goes to the others by weight.  With sources in
    the order of limit / weight, those that stop come first: a source stops
    while the level that its predecessors leave to the rest is above its ratio.
    Prefix sums over range partitions of that order give every level, and the
    smallest one that does not stop its source is the level of all.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = rank_in_group(sources.withColumn("_all", F.lit(0)), ["_all"],
                           [F.col("source").asc_nulls_last()], "_rank").drop("_all")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = materialize(ranked.select("source", "source_size", weight.alias("weight")), "sources")
    row = ranked.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    whole = float(share) * (row["size"] or 0)
    limit = F.col("source_size") * F.lit(float(cap))
    order = ranked.withColumn("limit", limit).withColumn("ratio", F.col("limit") / F.col("weight"))
    sums = prefix_sums(order, ["ratio", F.col("source").asc_nulls_last()], ["limit", "weight"], "upto_")
    before, left = F.col("upto_limit") - F.col("limit"), F.lit(row["weight"]) - F.col("upto_weight") + F.col("weight")
    level = (F.lit(whole) - before) / left
    # the first source that its level does not stop sets the level of it and of all after it
    open_ = sums.select("ratio", level.alias("level")).where(F.col("level") < F.col("ratio"))
    first = open_.agg(F.min(F.struct("ratio", "level")).alias("s")).first()["s"] if row["weight"] else None
    target = F.least(limit, F.col("weight") * F.lit(first["level"])) if first else limit
    return ranked.withColumn("target", F.greatest(target, F.lit(0.0)))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0,
        seed: int = 42) -> DataFrame:
    """How often the mix takes each document.

    Returns one row per input row: ``doc_id, source, size, source_size,
    weight, target, copies, taken``.  The documents of a source are laid out
    by size and id (in strata of alternating direction); each expects ``target / source_size`` copies.  A document
    is emitted once for every integer that the running sum of expected copies,
    plus one offset per source, crosses: floor(u + (i+1) r) - floor(u + i r).
    This order keeps the taken words within a part of one large document of
    the target; the offset is a hash of (seed, source), so reruns agree.

    Null or empty texts have size 0 and take 0 words (they may still be
    emitted); a null source is a source of its own, ordered last; a source of
    size 0 has target 0 and no copies; repeated rows count as separate
    documents; an empty table gives an empty result.  Other columns of
    ``docs`` are not read.
    """
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                        word_count(F.col(text_col)).alias("size"))
    return _copies(sizes, weights, share, cap, seed)


def _copies(sizes: DataFrame, weights: Sequence[float], share: float, cap: float, seed: int) -> DataFrame:
    """``mix`` of rows (doc_id, source, size, ...); further columns come last."""
    more = [c for c in sizes.columns if c not in ("doc_id", "source", "size")]
    sizes = materialize(sizes, "sizes")
    targets = source_targets(sizes, weights, share, cap)
    ranked = rank_in_group(sizes, ["source"], [F.col("size").desc(), F.col("doc_id").asc_nulls_last()])
    joined = ranked.alias("d").join(targets.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    ratio = F.when(F.col("s.source_size") > 0, F.col("s.target") / F.col("s.source_size")).otherwise(F.lit(0.0))
    # 53 bits of a hash as a number in [0, 1)
    offset = F.shiftrightunsigned(F.xxhash64(F.lit(int(seed)), F.coalesce(F.col("d.source"), F.lit("\0null"))),
                                  11).cast("double") / F.lit(float(2**53))
    # every stratum of 1/f neighbours (f: the fraction of a copy) has one pick; every other
    # stratum is walked backwards, so a pick at its large end is followed by one at a small end
    fraction = ratio - F.floor(ratio)
    stratum = F.floor(F.col("_rank") * fraction)
    mirrored = F.ceil(stratum / fraction) + F.ceil((stratum + 1) / fraction) - 1 - F.col("_rank")
    place = F.when((fraction > 0) & (stratum % 2 == 1), mirrored).otherwise(F.col("_rank"))
    crossed = F.floor(offset + (place + 1) * ratio) - F.floor(offset + place * ratio)
    copies = F.least(crossed, F.ceil(ratio)).cast("bigint")
    out = joined.select("d.doc_id", "d.source", "d.size", "s.source_size", "s.weight", "s.target",
                        copies.alias("copies"), *[f"d.{c}" for c in more])
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
              weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 42) -> DataFrame:
    """``docs`` with every row repeated as often as ``mix`` takes it.

    Rows are written once under a key of their own, so rows that share a doc_id,
    or have none, are taken each by its own copies.  The table of copies is
    broadcast if measured to be small, else both sides are shuffled.
    """
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("_key"), packed(docs)), "rows")
    own = F.col("_row")
    sizes = rows.select("_key", own.getField(id_col).alias("doc_id"), own.getField(source_col).alias("source"),
                        word_count(own.getField(text_col)).alias("size"))
    taken = materialize(_copies(sizes, weights, share, cap, seed).where(F.col("copies") > 0)
                        .select("_key", F.col("copies").alias("_copies")), "taken")
    small = taken.count() * 32 * len(taken.columns) <= BROADCAST_BYTES
    joined = rows.join(F.broadcast(taken) if small else taken, "_key")
    return (joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
            .select(*unpacked(docs.columns)))
