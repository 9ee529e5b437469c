"""Least squares of many folds and subsets from one scan (EST-1, CV-1, VIZ-16).

Every fit is solved from co-moment states that are merged over the groups of
rows it trains on; r2 and rmse on any group come from that group's state too.
Absolute errors are not quadratic, so they take one further scan for all folds.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from sparkprep.functions.comoments import COLLECT_COLUMNS, Moments, group_moments, merged

#: Parameters with which a linear fit is plain least squares.
_PLAIN = {"fit_intercept", "fitIntercept", "normalize", "standardization"}


def applies(df: DataFrame, features: Sequence[str], target: str, model_type: str, params: dict | None) -> bool:
    """Whether a fit is least squares on numbers: unpenalised, no text to encode."""
    numeric = all(isinstance(df.schema[c].dataType, (NumericType, BooleanType)) for c in (*features, target))
    return model_type == "linear_regression" and numeric and set(params or {}) <= _PLAIN and 0 < len(features) < COLLECT_COLUMNS


@dataclass
class Fit:
    coefficients: np.ndarray
    intercept: float

    def sse(self, state: Moments) -> float:
        """Squared error on the rows of a state."""
        b, d = self.coefficients, len(self.coefficients)
        n, means = state.n[d, d], np.diag(state.ma)
        bias = means[d] - self.intercept - b @ means[:d]
        return float(state.c[d, d] - 2 * b @ state.c[:d, d] + b @ state.c[:d, :d] @ b + n * bias * bias)

    def metric(self, name: str, state: Moments) -> float | None:
        d = len(self.coefficients)
        n, total = state.n[d, d], state.c[d, d]
        if not n:
            return None
        if name == "rmse":
            return float(np.sqrt(max(0.0, self.sse(state)) / n))
        return float(1 - self.sse(state) / total) if total > 0 else None


def solve(state: Moments, intercept: bool = True) -> Fit:
    """Least squares from a state whose last column is the target; columns that
    depend on others share their weight (smallest norm)."""
    d = len(state.n) - 1
    n, means, c = state.n[d, d], np.diag(state.ma), state.c
    if not intercept:
        c = c + n * np.outer(means, means)
    scale = np.sqrt(np.diag(c)[:d])
    scale = np.where(scale > 0, scale, 1.0)
    normal, right = c[:d, :d] / np.outer(scale, scale), c[:d, d] / scale
    b = np.linalg.lstsq(normal, right, rcond=1e-12)[0] / scale
    return Fit(b, float(means[d] - b @ means[:d]) if intercept else 0.0)


def states(df: DataFrame, features: Sequence[str], target: str, group: Column) -> dict[int, Moments]:
    """State of (features, target) per group, over the rows with a target."""
    rows = df.where(F.col(f"`{target}`").cast("double").isNotNull())
    out = group_moments(rows, [F.col(f"`{c}`") for c in (*features, target)], group)
    gaps = {c: int(sum(s.n[-1, -1] - s.n[i, i] for s in out.values())) for i, c in enumerate(features)}
    if any(gaps.values()):
        listed = ", ".join(f"{c} ({n} rows)" for c, n in gaps.items() if n)
        raise ValueError(f"linear_regression takes no nulls or NaN; fill or remove them in: {listed}")
    return out


def fold_fits(df: DataFrame, features: Sequence[str], target: str, folds: int, params: dict | None) -> tuple[dict[int, Moments], list[Fit]]:
    """(state of every fold, fit of every fold's complement), ``fold`` being a column of ``df``."""
    found = states(df, features, target, F.col("fold"))
    p = params or {}
    intercept = bool(p.get("fit_intercept", p.get("fitIntercept", True)))
    return found, [solve(merged([s for g, s in found.items() if g != f]), intercept) for f in range(folds)]


def absolute_errors(df: DataFrame, features: Sequence[str], target: str, fits: list[Fit]) -> dict[int, dict[str, float]]:
    """{fold: {mae, mape}} of every fold under its own fit, in one aggregate."""
    fold = F.col("fold").cast("int") + 1
    y = F.col(f"`{target}`").cast("double")
    p = F.element_at(F.array(*[F.lit(f.intercept) for f in fits]), fold)
    for i, c in enumerate(features):
        p = p + F.element_at(F.array(*[F.lit(float(f.coefficients[i])) for f in fits]), fold) * F.col(f"`{c}`").cast("double")
    e = F.abs(y - p)
    rows = df.where(y.isNotNull() & ~F.isnan(y)).groupBy("fold").agg(
        F.avg(e).alias("mae"), (F.avg(e / F.abs(y + F.lit(1e-10))) * 100.0).alias("mape")).collect()
    return {int(r["fold"]): {"mae": r["mae"], "mape": r["mape"]} for r in rows}
