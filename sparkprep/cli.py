"""Command line entry points mirroring the workflow endpoints:

  preview | schema | feature-types | profile      inspect a dataset
  preprocess | engineer                           run an operation list (JSON) and write the result
  importance                                      feature scores (mutual_info, chi2, f_classif, f_regression, random_forest)
  recommend | compare | cross-validate            model selection
  train                                           fit, evaluate on a hash split, save the model, append a report
  predict                                         batch-score a dataset with a saved model
  chart                                           write a chart table (histogram, kde, box, bar, pie, heatmap, line, scatter,
                                                  or of a saved model: confusion, roc, pr, importance, residuals)

Every command prints one JSON document; tables are written as directories.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame

from sparkprep.operators import charts, importance, models, profile, validate
from sparkprep.plans.operations import run_operations
from sparkprep.session import get_spark
from sparkprep.sources import catalog, io


def _rows(df: DataFrame, limit: int | None = None) -> list[dict]:
    out = df.limit(limit) if limit else df
    return [r.asDict(recursive=True) for r in out.collect()]


def _ops(arg: str) -> list[dict]:
    if arg.strip().startswith("["):
        return json.loads(arg)
    with open(arg) as f:
        return json.load(f)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sparkprep")
    sub = p.add_subparsers(dest="cmd", required=True)

    def data_cmd(name: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.add_argument("input")
        c.add_argument("--type", default="parquet", help="csv | parquet | json | jsonl")
        return c

    c = data_cmd("preview")
    c.add_argument("--limit", type=int, default=10)
    c.add_argument("--order-by", nargs="*")
    data_cmd("schema")
    data_cmd("feature-types")
    c = data_cmd("profile")
    c.add_argument("--columns", nargs="*")
    for name in ("preprocess", "engineer"):
        c = data_cmd(name)
        c.add_argument("--ops", required=True, help="JSON list or a file holding it")
        c.add_argument("--output", required=True)
        c.add_argument("--output-type")
        c.add_argument("--catalog")
        c.add_argument("--parent-id")
    c = data_cmd("importance")
    c.add_argument("--target", required=True)
    c.add_argument("--method", default="mutual_info")
    c.add_argument("--features", nargs="*")
    c = data_cmd("recommend")
    c.add_argument("--target", required=True)
    c.add_argument("--problem", required=True, choices=["classification", "regression"])
    for name in ("compare", "cross-validate", "train"):
        c = data_cmd(name)
        c.add_argument("--target", required=True)
        c.add_argument("--key", required=True, help="integer key column for hash splits/folds")
        c.add_argument("--features", nargs="*")
        c.add_argument("--folds", type=int, default=5)
        c.add_argument("--params", default="{}")
        if name == "compare":
            c.add_argument("--models", nargs="+", required=True)
        else:
            c.add_argument("--model", required=True)
        if name == "train":
            c.add_argument("--save", required=True)
            c.add_argument("--test-size", type=float, default=0.2)
            c.add_argument("--report")
    c = data_cmd("predict")
    c.add_argument("--model", required=True)
    c.add_argument("--output", required=True)
    c = data_cmd("chart")
    c.add_argument("--kind", required=True,
                   choices=["histogram", "kde", "box", "bar", "pie", "heatmap", "line", "scatter", *charts.MODEL_CHARTS])
    c.add_argument("--columns", nargs="*", default=[])
    c.add_argument("--model", help="saved model, for the charts of a model")
    c.add_argument("--bins", type=int, default=20)
    c.add_argument("--aggfunc", default="mean")
    c.add_argument("--output")

    a = p.parse_args(argv)
    spark = get_spark()
    df = io.read(spark, a.input, a.type)
    result: object
    if a.cmd == "preview":
        result = {"rows": _rows(profile.preview(df, a.limit, a.order_by)),
                  **_rows(profile.counts(df))[0]}
    elif a.cmd == "schema":
        result = _rows(profile.schema_table(df))
    elif a.cmd == "feature-types":
        result = _rows(profile.feature_types(df))
    elif a.cmd == "profile":
        result = {"columns": _rows(profile.column_profile(df, a.columns)),
                  "numeric": _rows(profile.numeric_summary(df, a.columns and
                                                           [c for c in a.columns if c in
                                                            importance.numeric_features(df)]))}
    elif a.cmd in ("preprocess", "engineer"):
        ops = _ops(a.ops)
        result = run_operations(spark, a.input, a.output, ops, a.type, a.output_type)
        if a.catalog:
            out_type = a.output_type or a.type
            written = io.read(spark, a.output, "jsonl" if out_type == "json" else out_type)
            result["dataset_id"] = catalog.register_dataset(
                spark, a.catalog, written, a.output, a.output, out_type, a.parent_id, ops,
                num_rows=result["rows_processed"])
    elif a.cmd == "importance":
        feats = a.features or importance.numeric_features(df, [a.target])
        if a.method == "random_forest":
            result = _rows(importance.random_forest_importance(df, a.target, feats))
        else:
            result = _rows(importance.univariate_scores(df, feats, a.target, a.method).orderBy("rank"))
    elif a.cmd == "recommend":
        result = _rows(models.recommend_models(df, a.target, a.problem))
    elif a.cmd == "compare":
        result = _rows(validate.compare_models(df, a.target, a.models, a.key, a.folds, a.features,
                                               params=json.loads(a.params)))
    elif a.cmd == "cross-validate":
        folds = validate.cross_validate(df, a.target, a.model, a.key, a.folds, a.features, json.loads(a.params))
        result = _rows(validate.summarize_folds(folds))
    elif a.cmd == "train":
        fitted, scores = models.train(df, a.target, a.model, a.key, a.features, json.loads(a.params),
                                      a.test_size)
        fitted.save(a.save)
        if a.report:
            catalog.append_report(spark, a.report, a.save, a.model, a.input, a.target, scores)
        result = {"model_path": a.save, "metrics": scores,
                  "feature_importance": [{"feature": f, "importance": v} for f, v in fitted.importances()]}
    elif a.cmd == "predict":
        out = models.batch_predict(a.model, df)
        io.write(out, a.output, "parquet")
        result = {"output": a.output, "rows": io.read(spark, a.output, "parquet").count()}
    else:  # chart
        cols = a.columns
        kinds = {
            "histogram": lambda: charts.histogram(df, cols[0], a.bins),
            "kde": lambda: charts.kde(df, cols[0]),
            "box": lambda: charts.box_many(df, cols),
            "bar": lambda: charts.bar(df, cols[0], cols[1], a.aggfunc),
            "pie": lambda: charts.pie(df, cols[0], cols[1] if len(cols) > 1 else None),
            "heatmap": lambda: charts.correlation_matrix(df, cols),
            "line": lambda: charts.line(df, cols[0], cols[1:]),
            "scatter": lambda: charts.scatter(df, cols[0], cols[1]),
        }
        if a.kind in charts.MODEL_CHARTS:
            if not a.model:
                raise SystemExit(f"chart {a.kind} needs --model")
            fitted = models.FittedModel.load(a.model)
            table = charts.model_chart(fitted, df, a.kind)
        else:
            table = kinds[a.kind]()
        if a.output:
            io.write(table, a.output, "parquet")
            result = {"output": a.output}
        else:
            if a.kind in ("line", "scatter", "residuals"):
                raise SystemExit(f"chart {a.kind} has a row per point: give --output")
            result = _rows(table)
    json.dump(result, sys.stdout, default=str)
    sys.stdout.write("\n")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
