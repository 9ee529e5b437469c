"""One-row statistics and exact distributed quantiles.

``one_row`` runs a single global aggregate (partial aggregation on every
partition, one tiny final merge) and brings the single result row to the
driver.  ``exact_quantiles`` returns the same values as SQL
``percentile``/``quantile_cont`` without holding a value map in one task:
it narrows a value bracket by sketches of its rows until it holds at most
``slice_limit`` of them, then picks the order statistics from that slice.
All columns advance together.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_LIMIT = 50_000
# The sketch buffers of every map partition meet in one final task, so the
# accuracy stays small (a few KB per partition).
SKETCH_ACCURACY = 1_000


def one_row(df: DataFrame, exprs: dict[str, Column]) -> dict:
    row = df.agg(*[e.alias(k) for k, e in exprs.items()]).first()
    return row.asDict() if row is not None else {k: None for k in exprs}


def _valid(c: str) -> tuple[Column, Column]:
    x = F.col(c).cast("double")
    return x, x.isNotNull() & ~F.isnan(x)


def _near(x: Column, lo: float, hi: float) -> Column:
    return (x >= F.lit(lo)) & (x <= F.lit(hi))


class _Bracket:
    """A value range of one column that should hold some of its order statistics."""

    def __init__(self, column: str, lo: float, hi: float, ranks: list[int], expected: float, spread: float,
                 accuracy: int) -> None:
        self.column, self.lo, self.hi, self.ranks = column, lo, hi, ranks
        self.expected, self.spread, self.accuracy = expected, spread, accuracy


def exact_quantiles_multi(df: DataFrame, specs: dict[str, Sequence[float]],
                          slice_limit: int = SLICE_LIMIT, accuracy: int = SKETCH_ACCURACY,
                          extra: dict[str, Column] | None = None,
                          extra_out: dict | None = None) -> dict[str, list[float | None]]:
    """Exact linear-interpolated quantiles for several columns at once.

    Job 1 counts every column (infinities apart) and takes a percentile_approx
    sketch; its rank error is at most n / accuracy, so the sketch's values at
    p -/+ 2 / accuracy bracket a target rank.  A bracket that should hold at most
    ``slice_limit`` rows then returns its distinct values with the count of rows
    below, all columns in one job.  A larger one is counted and narrowed by a
    sketch of its own rows, at the target's rank among them: each level shrinks
    it by about accuracy / 4, whatever the distribution.  A bracket that misses
    its rank is taken again, wider.  The path is the same at every size.
    ``extra`` aggregates ride along in the first job (values in ``extra_out``).
    """
    cols = list(specs)
    out: dict[str, list[float | None]] = {}
    if not cols:
        return out
    inf = float("inf")
    delta = 2.0 / accuracy

    def finite(c: str) -> Column:
        x, ok = _valid(c)
        return F.when(ok & (F.abs(x) < F.lit(inf)), x)

    def probes(ps: Sequence[float], spread: float) -> list[float]:
        return sorted({min(1.0, max(0.0, p + d)) for p in ps for d in (-spread, spread)})

    aggs = []
    for i, c in enumerate(cols):
        x, ok = _valid(c)
        v = finite(c)
        aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"mn{i}"), F.max(v).alias(f"mx{i}"),
                 F.count(F.when(ok & (x == F.lit(-inf)), 1)).alias(f"lo{i}"),
                 F.count(F.when(ok & (x == F.lit(inf)), 1)).alias(f"hi{i}"),
                 F.percentile_approx(v, probes(specs[c], delta), accuracy).alias(f"a{i}")]
    aggs += [e.alias(f"x_{k}") for k, e in (extra or {}).items()]
    st = df.agg(*aggs).first()
    if extra_out is not None:
        extra_out.update({k: st[f"x_{k}"] for k in (extra or {})})
    positions: dict[str, list[float]] = {}
    values: dict[tuple[str, int], float] = {}
    size = {c: st[f"n{i}"] for i, c in enumerate(cols)}
    ends = {c: (st[f"mn{i}"], st[f"mx{i}"]) for i, c in enumerate(cols)}
    first = {c: st[f"lo{i}"] for i, c in enumerate(cols)}  # rank of the first finite value
    todo: list[_Bracket] = []

    def brackets(c: str, targets: list[tuple[float, list[int]]], sketch: dict, spread: float, n: float,
                 lo: float, hi: float) -> list[_Bracket]:
        """One bracket per run of overlapping targets (share of the rows, ranks)."""
        parts = []
        for p, ranks in sorted(targets):
            a = lo if p - spread <= 0 else sketch[max(0.0, p - spread)]
            b = hi if p + spread >= 1 else sketch[min(1.0, p + spread)]
            if parts and a <= parts[-1].hi:
                parts[-1].hi = max(parts[-1].hi, b)
                parts[-1].ranks = sorted({*parts[-1].ranks, *ranks})
                parts[-1].expected += 2 * spread * n
            else:
                parts.append(_Bracket(c, a, b, sorted(set(ranks)), 2 * spread * n, spread, accuracy))
        return parts

    for i, c in enumerate(cols):
        n = first[c] + size[c] + st[f"hi{i}"]
        if not n:
            out[c] = [None for _ in specs[c]]
            continue
        positions[c] = [p * (n - 1) for p in specs[c]]
        targets = []
        for p, q in zip(specs[c], positions[c]):
            inner = []
            for r in {math.floor(q), math.ceil(q)}:
                if r < first[c] or r >= first[c] + size[c]:
                    values[(c, r)] = -inf if r < first[c] else inf
                else:
                    inner.append(r)
            if inner:
                targets.append(((inner[0] - first[c]) / max(1, size[c] - 1) if st[f"lo{i}"] or st[f"hi{i}"] else p, inner))
        if not targets:
            continue
        sketch = dict(zip(probes(specs[c], delta), st[f"a{i}"] or []))
        if st[f"lo{i}"] or st[f"hi{i}"]:  # the shares moved with the infinities: sketch again from the whole range
            todo.append(_Bracket(c, *ends[c], sorted({r for _, rs in targets for r in rs}), float(size[c]), delta, accuracy))
        else:
            todo += brackets(c, targets, sketch, delta, size[c], *ends[c])

    while todo:
        small = [b for b in todo if b.expected <= slice_limit or b.lo == b.hi]
        large = [b for b in todo if not (b.expected <= slice_limit or b.lo == b.hi)]
        todo = []
        if small:
            todo += _resolve(df, small, finite, first, values, ends, size)
        if large:
            counts = df.agg(*[e for i, b in enumerate(large) for e in (
                F.count(F.when(finite(b.column) < F.lit(b.lo), 1)).alias(f"b{i}"),
                F.count(F.when(_near(finite(b.column), b.lo, b.hi), 1)).alias(f"n{i}"))]).first()
            found, asked = [], []
            for i, b in enumerate(large):
                below, inside = first[b.column] + counts[f"b{i}"], counts[f"n{i}"]
                if not all(below <= r < below + inside for r in b.ranks):
                    todo.append(_Bracket(b.column, *ends[b.column], b.ranks, float(size[b.column]), 4 * b.spread, b.accuracy))
                elif inside <= slice_limit:
                    b.expected = inside
                    todo.append(b)
                else:
                    targets = [((r - below) / max(1, inside - 1), [r]) for r in b.ranks]
                    ps = probes([p for p, _ in targets], b.spread)
                    asked.append((b, targets, ps, inside))
                    found.append(F.percentile_approx(F.when(_near(finite(b.column), b.lo, b.hi), finite(b.column)), ps,
                                                     b.accuracy).alias(f"a{len(asked) - 1}"))
            if asked:
                got = df.agg(*found).first()
                for i, (b, targets, ps, inside) in enumerate(asked):
                    parts = brackets(b.column, targets, dict(zip(ps, got[f"a{i}"])), b.spread, inside, b.lo, b.hi)
                    if len(parts) == 1 and (parts[0].lo, parts[0].hi) == (b.lo, b.hi):
                        # ties fill the bracket: look closer, until the sketch tells single rows apart
                        finer = min(8 * b.accuracy, 2**31 - 1)
                        parts = [_Bracket(b.column, b.lo, b.hi, b.ranks, float(inside), 2.0 / finer, finer)]
                    todo += parts
    for c, pos in positions.items():
        res = []
        for q in pos:
            lo_r, hi_r = math.floor(q), math.ceil(q)
            x, y = float(values[(c, lo_r)]), float(values[(c, hi_r)])
            res.append(x if lo_r == hi_r or x == y else x + (y - x) * (q - lo_r))
        out[c] = res
    return out


def _resolve(df: DataFrame, items: list[_Bracket], finite, first: dict, values: dict, ends: dict,  # noqa: ANN001
             size: dict) -> list[_Bracket]:
    """Read the order statistics of small brackets in one job; those that miss come back wider."""
    entries = []
    for i, b in enumerate(items):
        x = finite(b.column)
        entries.append(F.when(_near(x, b.lo, b.hi), F.struct(F.lit(i).alias("i"), x.alias("v"))))
        entries.append(F.when(x < F.lit(b.lo), F.struct(F.lit(i).alias("i"), F.lit(None).cast("double").alias("v"))))
    rows = (df.select(F.explode(F.array(*entries)).alias("k")).where(F.col("k").isNotNull())
            .groupBy("k.i", "k.v").agg(F.count(F.lit(1)).alias("n")).collect())
    by_item: dict[int, list] = {}
    for r in rows:
        by_item.setdefault(r["i"], []).append(r)
    again = []
    for i, b in enumerate(items):
        mine = by_item.get(i, [])
        at = first[b.column] + sum(r["n"] for r in mine if r["v"] is None)
        left = set(b.ranks)
        for r in sorted((r for r in mine if r["v"] is not None), key=lambda r: r["v"]):
            for k in [k for k in left if at <= k < at + r["n"]]:
                values[(b.column, k)] = r["v"]
                left.discard(k)
            at += r["n"]
        if left:
            again.append(_Bracket(b.column, *ends[b.column], sorted(left), float(size[b.column]), 4 * b.spread, b.accuracy))
    return again


def exact_quantiles(df: DataFrame, c: str, probs: Sequence[float],
                    slice_limit: int = SLICE_LIMIT, accuracy: int = SKETCH_ACCURACY) -> list[float | None]:
    """Linear-interpolated quantiles (SQL ``percentile`` / ``quantile_cont``)."""
    return exact_quantiles_multi(df, {c: list(probs)}, slice_limit, accuracy)[c]


def approx_quantiles(df: DataFrame, c: str, probs: Sequence[float],
                     accuracy: int = 10000) -> list[float | None]:
    row = df.agg(F.percentile_approx(F.col(c), list(probs), accuracy).alias("q")).first()
    return list(row["q"]) if row["q"] is not None else [None for _ in probs]


def quantiles(df: DataFrame, c: str, probs: Sequence[float], exact: bool = True,
              accuracy: int = 10000) -> list[float | None]:
    if exact:
        return exact_quantiles(df, c, probs)
    return approx_quantiles(df, c, probs, accuracy)
