"""Joins whose broadcast side is size-checked.

A side is broadcast only when one counting job proves it small: at most
``max_rows`` rows and at most ``max_bytes`` estimated bytes (8 bytes per
scalar column, measured length for strings, binaries and nested values).
Otherwise the join is left to a shuffle join, where AQE's skew-join
handling splits hot partitions of the large side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from sparkprep.functions.materialize import materialize

DEFAULT_MAX_BROADCAST_ROWS = 1_000_000
DEFAULT_MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def measure(df: DataFrame) -> tuple[int, int]:
    """(rows, estimated bytes) in one aggregate: 8 bytes per scalar column,
    measured length for strings/binaries and (as JSON) for nested values."""
    from pyspark.sql.types import ArrayType, MapType, StructType
    aggs = [F.count(F.lit(1)).alias("n")]
    n_fixed = 0
    for i, f in enumerate(df.schema.fields):
        if isinstance(f.dataType, (StringType, BinaryType)):
            aggs.append(F.sum(F.length(F.col(f.name))).alias(f"l{i}"))
        elif isinstance(f.dataType, (ArrayType, MapType, StructType)):
            aggs.append(F.sum(F.length(F.to_json(F.col(f.name)))).alias(f"l{i}"))
        else:
            n_fixed += 1
    r = df.agg(*aggs).first()
    n = int(r["n"])
    var = sum(int(v or 0) for k, v in r.asDict().items() if k != "n")
    return n, n * 8 * (n_fixed + 1) + var


def join_small(big: DataFrame, small: DataFrame, on, how: str = "left",  # noqa: ANN001
               max_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
               max_bytes: int = DEFAULT_MAX_BROADCAST_BYTES,
               known_rows: int | None = None) -> DataFrame:
    """Join ``small`` onto ``big``, broadcasting it only if it is proven small.

    Keys are compared null-safely: a null key of ``big`` meets the null key of
    ``small``.  ``known_rows`` skips the measurement when the caller already
    has a proven bound on a narrow table (e.g. a vocabulary of max_features
    rows).
    """
    if known_rows is not None:
        fits = known_rows <= max_rows
    else:
        small = materialize(small, "small")
        rows, size = measure(small)
        fits = rows <= max_rows and size <= max_bytes
    keys = [on] if isinstance(on, str) else list(on)
    renamed = small.select(*[F.col(f"`{k}`").alias(f"__key{i}") for i, k in enumerate(keys)],
                           *[F.col(f"`{c}`") for c in small.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"__key{i}")) for i, k in enumerate(keys)])
    joined = big.join(F.broadcast(renamed) if fits else renamed, same, how)
    return joined.drop(*[f"__key{i}" for i in range(len(keys))])
