"""The command line maps the workflow steps onto the library."""

import contextlib
import io as _io
import json

from sparkprep.cli import main
from sparkprep.session import scratch_path


def _run(args):
    buf = _io.StringIO()
    with contextlib.redirect_stdout(buf):
        assert main(args) == 0
    return json.loads(buf.getvalue())


def test_cli_preprocess_train_predict(spark, sf_small):
    src = f"{sf_small}/orders.parquet"
    out = scratch_path(spark, "cli_out")
    summary = _run(["preprocess", src, "--ops", '[{"type": "binning", "column": "o_totalprice", "bins": 4}]',
                    "--output", out, "--catalog", scratch_path(spark, "cli_cat")])
    assert summary["rows_processed"] == spark.read.parquet(src).count()
    assert "dataset_id" in summary
    model = scratch_path(spark, "cli_model")
    t = _run(["train", out, "--target", "o_totalprice", "--key", "o_orderkey", "--model", "linear_regression",
              "--features", "o_totalprice_binned", "o_orderstatus", "--save", model])
    assert set(t["metrics"]) == {"rmse", "mae", "r2", "mape"}
    pred = _run(["predict", out, "--model", model, "--output", scratch_path(spark, "cli_pred")])
    assert pred["rows"] == summary["rows_processed"]
    types = _run(["feature-types", f"{sf_small}/documents.parquet"])
    assert {r["column"]: r["kind"] for r in types}["text"] == "text"
    hist = _run(["chart", src, "--kind", "histogram", "--columns", "o_totalprice", "--bins", "5"])
    assert len(hist) == 5
    trend = _run(["chart", out, "--kind", "residual_trend", "--model", model])
    assert set(trend[0]) == {"slope", "intercept", "x0", "y0", "x1", "y1"}
    imp = _run(["chart", out, "--kind", "importance", "--model", model])
    assert {r["feature"] for r in imp} == {"o_totalprice_binned", "o_orderstatus"}
