"""Poisson bootstrap of category means (VIZ-5).

Every replicate weighs every row by a Poisson(1) number drawn from a hash of
(row key, replicate), so a replicate is a weighted mean, all replicates come
from one scan, and any engine that knows the hash gets the same bounds.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep.functions.exprs import HASH_MOD, HASH_MULT
from sparkprep.functions.ordinal import grouped_exact_quantiles

REPLICATES = 1000
CELLS = 1 << 20          # rows times replicates that a task weighs at once
CATEGORIES = 4096        # categories whose sums a task holds before it sends them on


def poisson_limits() -> list[int]:
    """A hash in [0, 2**31) counts as many occurrences as there are limits at or below it."""
    out, term, total = [], math.exp(-1.0), 0.0
    for j in range(1, 40):
        total += term
        term /= j
        if math.floor(total * HASH_MOD) >= HASH_MOD - 1:
            break
        out.append(math.floor(total * HASH_MOD))
    return out


def hashes(key: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """``functions.exprs.split_hash`` of every key (rows) under every seed (columns)."""
    x = (key[:, None] % HASH_MOD + seed[None, :] % HASH_MOD) * HASH_MULT % HASH_MOD
    x ^= x >> 13
    return x * HASH_MULT % HASH_MOD


def _sums(batches: Iterator[pa.RecordBatch], replicates: int, seed: int) -> Iterator[pa.RecordBatch]:
    limits, seeds = np.array(poisson_limits(), np.int64), seed + np.arange(replicates, dtype=np.int64)
    held: dict = {}

    def out() -> pa.RecordBatch:
        n = len(held)
        ends = np.arange(0, n * replicates + 1, replicates, dtype=np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([v[i] for v in held.values()]) if n else np.zeros(0)))
                 for i in range(2)]
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), *lists], names=["x", "w", "wy"])
    for batch in batches:
        category = batch.column(0).dictionary_encode()
        names, codes = category.dictionary.to_pylist(), category.indices.to_numpy(zero_copy_only=False)
        codes = np.where(category.indices.is_null(), len(names), codes).astype(np.int64)
        names.append(None)
        y, key = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
        step = max(1, CELLS // replicates)
        for at in range(0, len(y), step):
            some = slice(at, at + step)
            weight = np.searchsorted(limits, hashes(key[some], seeds), "right").astype(np.float64)
            order = np.argsort(codes[some], kind="stable")
            own = codes[some][order]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            w = np.add.reduceat(weight[order], first, axis=0)
            wy = np.add.reduceat((weight * y[some][:, None])[order], first, axis=0)
            for i, code in enumerate(own[first]):
                name = names[code]
                held[name] = (held[name][0] + w[i], held[name][1] + wy[i]) if name in held else (w[i], wy[i])
            if len(held) >= CATEGORIES:
                yield out()
                held.clear()
    if held:
        yield out()


def bar_bootstrap(df: DataFrame, x: str, y: str, key: str, replicates: int = REPLICATES, level: float = 0.95,
                  seed: int = 42) -> DataFrame:
    """(x, mean, n, ci_low, ci_high): the mean of ``y`` per category and the
    percentile interval of its bootstrap replicates (linear quantiles).

    ``key`` is an integer that tells rows apart.  Rows with a null or NaN ``y`` or
    a null key take no part; a null category is a category.  A replicate that
    draws no row of a category says nothing of it.
    """
    value, name = F.col(f"`{y}`").cast("double"), F.col(f"`{x}`")
    rows = df.where(value.isNotNull() & ~F.isnan(value) & F.col(f"`{key}`").isNotNull())
    drawn = rows.select(name.cast("string").alias("x"), value.alias("y"), F.col(f"`{key}`").cast("bigint").alias("k")).mapInArrow(
        lambda b: _sums(b, replicates, seed), "x string, w array<double>, wy array<double>")
    each = drawn.select("x", F.posexplode(F.arrays_zip("w", "wy")).alias("b", "s"))
    means = (each.groupBy("x", "b").agg(F.sum("s.w").alias("w"), F.sum("s.wy").alias("wy"))
             .where(F.col("w") > 0).select("x", (F.col("wy") / F.col("w")).alias("m")))
    side = (1.0 - level) / 2
    bounds = grouped_exact_quantiles(means, ["x"], "m", [side, 1 - side])
    plain = rows.groupBy(name.alias("__x")).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
    joined = plain.join(bounds, F.col("__x").cast("string").eqNullSafe(F.col("x")))
    return joined.select(F.col("__x").alias(x), "mean", "n", F.col("q0").alias("ci_low"), F.col("q1").alias("ci_high"))


# tasks get this module with the functions that use it, so a cluster needs no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])
