"""Registered queries over the test tables and their DuckDB oracle SQL.

Each query reads whole tables from ``sf_dir`` and returns a DataFrame whose
computed columns are aliased exactly as in the matching oracle SQL.
Doubles are rounded at the boundary (6 decimals unless noted) in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkprep.functions.exprs import round_all
from sparkprep.operators import charts
from sparkprep.plans.operations import apply_operations
from sparkprep.session import table_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):  # noqa: ANN201
    def deco(fn):  # noqa: ANN001, ANN202
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def bins_sql(x: str, lo: str, hi: str, bins: int) -> str:
    """SQL twin of functions.exprs.bin_index (edges lo + i*((hi-lo)/bins))."""
    terms = " + ".join(f"CASE WHEN {x} >= {lo} + {i} * (({hi} - {lo}) / {bins}) THEN 1 ELSE 0 END"
                       for i in range(1, bins))
    return f"CAST(CASE WHEN {x} IS NULL THEN NULL WHEN {hi} = {lo} THEN 0 ELSE {terms} END AS DOUBLE)"


# --------------------------------------------------------------------------
# Flagship: preprocessing fold + bar chart (SRC-2, CLN-1/3/5, FE-2, PIP-1, VIZ-4)
# --------------------------------------------------------------------------
FLAGSHIP_OPS = [
    {"type": "remove_nulls"},
    {"type": "outlier_removal", "columns": ["l_extendedprice"], "method": "iqr", "threshold": 1.5},
    {"type": "normalize", "columns": ["l_extendedprice"], "method": "minmax"},
    {"type": "binning", "column": "l_quantity", "bins": 5},
]


@register("flagship_prep_bar", f"""
WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3
           FROM lineitem),
f AS (SELECT l.* FROM lineitem l, q
      WHERE l.l_extendedprice >= q1 - 1.5 * (q3 - q1) AND l.l_extendedprice <= q3 + 1.5 * (q3 - q1)),
s AS (SELECT min(l_extendedprice) AS mn, max(l_extendedprice) AS mx,
             min(l_quantity) AS qmn, max(l_quantity) AS qmx FROM f),
b AS (SELECT (l_extendedprice - mn) / (mx - mn) AS sc, {bins_sql('l_quantity', 'qmn', 'qmx', 5)} AS bin
      FROM f, s)
SELECT bin AS l_quantity_binned, round(avg(sc), 6) AS l_extendedprice_scaled FROM b GROUP BY bin
""")
def flagship_prep_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    prepared = apply_operations(li, FLAGSHIP_OPS)
    out = charts.bar(prepared, "l_quantity_binned", "l_extendedprice_scaled", "mean")
    return round_all(out)


def load_all() -> None:
    """Import every query module (each registers its queries on import)."""
    import importlib
    for mod in ("q_clean", "q_features", "q_gaps", "q_growth", "q_io", "q_models", "q_profile", "q_scores", "q_text", "q_viz"):
        importlib.import_module(f"sparkprep.plans.{mod}")
