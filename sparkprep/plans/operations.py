"""Operation lists (PIP-1): ``[{"type": ..., ...}, ...]`` folded left to right.

Every operation is validated before any job runs; an unknown ``type``
raises.  Scalar operations only extend the lazy plan; the ones that must
learn something (statistics, vocabularies, PCA) run one small job each.
``run_operations`` reads a dataset, folds the operations, writes the result
as a directory, and reports a summary whose row count comes from the written
output (the plan is not re-run).
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from sparkprep.operators import clean, features, importance, text
from sparkprep.sources import io

OpFn = Callable[[DataFrame, dict], DataFrame]


def _cols(op: dict) -> list[str]:
    return list(op.get("columns") or [])


def _binning(df: DataFrame, op: dict) -> DataFrame:
    return features.binning(df, op["column"], int(op.get("bins", 5)), op.get("labels"))


def _categorical(df: DataFrame, op: dict) -> DataFrame:
    method = op.get("method", "label")
    for c in _cols(op):
        if method == "onehot" or method == "one_hot":
            encode = clean.one_hot_sparse if op.get("sparse") else clean.one_hot
            df = encode(df, c, drop_last=bool(op.get("drop_last", False)))
        elif method == "label":
            df = clean.label_encode(df, [c])
        else:
            raise ValueError(f"Unknown categorical_encoding method: {method}")
    return df


def _datetime(df: DataFrame, op: dict) -> DataFrame:
    for c in _cols(op) or [op["column"]]:
        df = clean.datetime_features(df, c, op.get("parts", clean.DATETIME_PARTS))
    return df


def _text(df: DataFrame, op: dict) -> DataFrame:
    return text.text_vectorization(df, op["column"], op.get("method", "tfidf"),
                                   int(op.get("max_features", 1000)),
                                   int(op.get("vector_size", 100)), int(op.get("min_count", 5)),
                                   int(op.get("seed", 42)))


def _feature_selection(df: DataFrame, op: dict) -> DataFrame:
    feats = _cols(op) or importance.numeric_features(df, [op["target"]])
    method = {"f_value": "f_classif"}.get(op.get("method", "mutual_info"), op.get("method", "mutual_info"))
    return importance.feature_selection(df, feats, op["target"], method, int(op.get("k", 10)))


OPERATIONS: dict[str, OpFn] = {
    "remove_nulls": lambda d, o: clean.remove_nulls(d, _cols(o)),
    "fillna": lambda d, o: clean.fillna(d, o.get("value", 0), _cols(o)),
    "normalize": lambda d, o: clean.normalize(d, _cols(o), o.get("method", "minmax"),
                                              bool(o.get("center", True))),
    "outlier_removal": lambda d, o: clean.outlier_removal(
        d, _cols(o), o.get("method", "iqr"), float(o.get("threshold", 1.5)),
        bool(o.get("exact", True)), bool(o.get("sequential", True))),
    "categorical_encoding": _categorical,
    "target_encoding": lambda d, o: functools.reduce(
        lambda x, c: clean.target_encode(x, c, o["target"], float(o.get("smoothing", 10.0))), _cols(o), d),
    "datetime_features": _datetime,
    "time_features": _datetime,
    "binning": _binning,
    "polynomial_features": lambda d, o: features.polynomial_features(d, _cols(o), int(o.get("degree", 2))),
    "text_vectorization": _text,
    "pca": lambda d, o: features.pca(d, _cols(o), int(o.get("n_components", 2))),
    "feature_selection": _feature_selection,
    "interaction_features": lambda d, o: features.interaction_features(d, _cols(o)),
    "aggregation": lambda d, o: features.aggregation(
        d, o["group_by"] if isinstance(o["group_by"], list) else [o["group_by"]], _cols(o),
        o.get("functions", ["mean", "sum", "min", "max", "count"]), o.get("mode", "broadcast_back")),
    "lag_features": lambda d, o: features.lag_features(
        d, o["column"], o.get("lags", [1]),
        o["order_by"] if isinstance(o["order_by"], list) else [o["order_by"]],
        o["partition_by"] if isinstance(o["partition_by"], list) else [o["partition_by"]]),
    "custom_transformer": lambda d, o: features.custom_transformer(
        d, sql=o.get("sql"), fn=o.get("fn"), batch_fn=o.get("batch_fn"), schema=o.get("schema")),
}

REQUIRED = {
    "binning": ("column",), "text_vectorization": ("column",), "lag_features": ("column", "order_by",
                                                                                "partition_by"),
    "aggregation": ("group_by",), "target_encoding": ("target",), "feature_selection": ("target",),
}


def validate(ops: Sequence[dict]) -> None:
    for i, op in enumerate(ops):
        t = op.get("type")
        if t not in OPERATIONS:
            raise ValueError(f"operation {i}: unknown type {t!r}")
        missing = [k for k in REQUIRED.get(t, ()) if op.get(k) is None]
        if missing:
            raise ValueError(f"operation {i} ({t}): missing {missing}")


# Operations that keep every row: in a run of these, the statistics of a column
# can be taken from the frame at the start of the run, until one writes it.
ROW_PRESERVING = {"normalize", "binning", "polynomial_features", "interaction_features",
                  "datetime_features", "time_features"}


def _stat_needs(op: dict) -> list[tuple[str, str]]:
    if op["type"] == "normalize":
        kind = "minmax" if op.get("method", "minmax") == "minmax" else "zscore"
        return [(kind, c) for c in _cols(op)]
    if op["type"] == "binning":
        return [("minmax", op["column"])]
    return []


def _writes(op: dict) -> set[str]:
    """Columns that an operation of a run may write anew."""
    if op["type"] == "normalize":
        return {f"{c}_scaled" for c in _cols(op)}
    if op["type"] == "binning":
        return {f"{op['column']}_binned", f"{op['column']}_bin_label"}
    return set()


def _prefetch(df: DataFrame, ops: Sequence[dict]) -> dict[tuple[str, str], tuple]:
    """One aggregate for the statistics of every op in a row-preserving run
    whose input columns already exist at the start of the run."""
    needs, written = [], set()
    for op in ops:
        if op["type"] not in ROW_PRESERVING:
            break
        needs += [n for n in _stat_needs(op) if n[1] in df.columns and n[1] not in written and n not in needs]
        written |= _writes(op)
    if len(needs) < 2:
        return {}
    from pyspark.sql import functions as F

    from sparkprep.functions.exprs import number
    from sparkprep.functions.stats import one_row
    exprs = {}
    for i, (kind, c) in enumerate(needs):
        x = number(c)
        if kind == "minmax":
            exprs[f"a{i}"], exprs[f"b{i}"] = F.min(x), F.max(x)
        else:
            exprs[f"a{i}"], exprs[f"b{i}"] = F.avg(x), F.stddev_samp(x)
    r = one_row(df, exprs)
    return {n: (r[f"a{i}"], r[f"b{i}"]) for i, n in enumerate(needs)}


def _apply_one(df: DataFrame, op: dict, stats: dict) -> DataFrame:
    t = op["type"]
    if t == "normalize" and stats:
        kind = "minmax" if op.get("method", "minmax") == "minmax" else "zscore"
        cols = _cols(op)
        if cols and all((kind, c) in stats for c in cols):
            return clean.normalize(df, cols, op.get("method", "minmax"), bool(op.get("center", True)),
                                   params={c: stats[(kind, c)] for c in cols})
    if t == "binning" and ("minmax", op["column"]) in stats:
        return features.binning(df, op["column"], int(op.get("bins", 5)), op.get("labels"),
                                bounds=stats[("minmax", op["column"])])
    return OPERATIONS[t](df, op)


def apply_operations(df: DataFrame, ops: Sequence[dict]) -> DataFrame:
    """Fold the operations left to right.  Statistics of consecutive
    row-preserving operations (normalize, binning, ...) are fused into one
    aggregate at the start of each such run instead of one job per op."""
    validate(ops)
    stats: dict = {}
    prev_preserving = False
    for i, op in enumerate(ops):
        preserving = op["type"] in ROW_PRESERVING
        if preserving and not prev_preserving:
            stats = _prefetch(df, ops[i:])
        elif not preserving:
            stats = {}
        df = _apply_one(df, op, stats)
        stats = {k: v for k, v in stats.items() if k[1] not in _writes(op)}
        prev_preserving = preserving
    return df


def run_operations(spark: SparkSession, input_path: str, output_path: str, ops: Sequence[dict],
                   file_type: str, output_type: str | None = None) -> dict:
    """Read -> fold -> write -> summary (rows counted on the written output)."""
    validate(ops)
    df = io.read(spark, input_path, file_type)
    before = set(df.columns)
    out = apply_operations(df, ops)
    out_type = output_type or file_type
    io.write(out, output_path, out_type)
    written = io.read(spark, output_path, "jsonl" if out_type == "json" else out_type)
    return {"status": "success", "operations_applied": len(ops),
            "features_created": len([c for c in out.columns if c not in before]),
            "rows_processed": written.count(), "columns_processed": len(written.columns)}

