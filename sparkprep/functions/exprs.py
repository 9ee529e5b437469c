"""Pure Column expressions (JVM-side, codegen friendly)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Multiplicative hashing (Knuth) kept inside 63 bits so it never overflows
# under ANSI mode and is reproducible in any SQL engine with 64-bit integers.
HASH_MULT = 2654435761
HASH_MOD = 2147483648  # 2**31


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c: str | Column) -> Column:
    """A column as double, NaN as null: NaN is missing in every statistic."""
    x = col(c).cast("double")
    return F.when(~F.isnan(x), x)


def finite_number(c: str | Column) -> Column:
    """As ``number``, without infinite values."""
    x = col(c).cast("double")
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def split_hash(key: str | Column, seed: int = 42) -> Column:
    """Deterministic hash of an integer key into [0, 2**31).

    Two multiplicative rounds with an xor-shift in between, so different
    seeds give unrelated assignments.  Every intermediate stays below 2**63.
    """
    m, mod = F.lit(HASH_MULT), F.lit(HASH_MOD)
    x = F.pmod(col(key).cast("bigint"), mod)
    x = F.pmod((x + F.lit(int(seed) % HASH_MOD)) * m, mod)
    x = x.bitwiseXOR(F.shiftright(x, 13))
    return F.pmod(x * m, mod)


def split_hash_sql(key: str, seed: int = 42) -> str:
    """The same hash as SQL text (for oracles and SQL users)."""
    x0 = f"((({key}) % {HASH_MOD} + {HASH_MOD}) % {HASH_MOD})"
    x1 = f"((({x0} + {int(seed) % HASH_MOD}) * {HASH_MULT}) % {HASH_MOD})"
    x2 = f"xor({x1}, ({x1} >> 13))"
    return f"(({x2} * {HASH_MULT}) % {HASH_MOD})"


def equal_width_edges(lo: float, hi: float, bins: int) -> list[float]:
    """Inner edges lo + i*step, i = 1..bins-1 (outer edges are +/- infinity)."""
    step = (hi - lo) / bins
    return [lo + i * step for i in range(1, bins)]


def bin_index(x: str | Column, lo: float | None, hi: float | None, bins: int) -> Column:
    """Equal-width bin 0..bins-1 as double, left-closed, outer edges open.

    Counts the edges at or below the value - the same edges a Bucketizer
    would use, so there is no floor()/float drift.  A constant column (or
    bins == 1) lands in bin 0; null and NaN give null.
    """
    x = number(x)
    if lo is None or hi is None:
        return F.lit(None).cast("double")
    if bins <= 1 or hi == lo:
        return F.when(x.isNull(), F.lit(None).cast("double")).otherwise(F.lit(0.0))
    edges = equal_width_edges(lo, hi, bins)
    arr = F.lit([float(e) for e in edges])
    return F.when(x.isNull(), F.lit(None)).otherwise(
        F.size(F.filter(arr, lambda e: e <= x))).cast("double")


def round_all(df, digits: int = 6, exclude: Sequence[str] = ()):  # noqa: ANN001
    """Round every double/float column (used at table boundaries for comparisons)."""
    out = []
    for name, dtype in df.dtypes:
        if name not in exclude and dtype in ("double", "float"):
            out.append(F.round(F.col(name).cast("double"), digits).alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def safe_name(value: object) -> str:
    """Column-name-safe rendering of a category value."""
    s = "null" if value is None else str(value)
    out = "".join(ch if ch.isalnum() else "_" for ch in s)
    return out or "empty"
