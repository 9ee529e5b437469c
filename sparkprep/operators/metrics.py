"""Evaluation metrics as one-row aggregates (MET-1..8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REGRESSION_METRICS = ("rmse", "mae", "r2", "mape")
CLASSIFICATION_METRICS = ("accuracy", "precision", "recall", "f1")


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """rmse, mae, r2 = 1-SSE/SST, mape = mean(|(y-p)/(y+1e-10)|)*100 in one pass."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    e = y - p
    g = df.where(y.isNotNull() & p.isNotNull()).agg(
        F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
        F.sum(e * e).alias("sse"), (F.var_pop(y) * F.count(y)).alias("sst"),
        (F.avg(F.abs(e / (y + F.lit(1e-10)))) * 100.0).alias("mape"))
    return g.select(F.sqrt("mse").alias("rmse"), "mae",
                    (F.lit(1.0) - F.try_divide(F.col("sse"), F.col("sst"))).alias("r2"), "mape")


def per_class(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(cls, support, predicted, tp) for every class seen as label or prediction.

    Built from the (label, prediction) count table, whose size is bounded by
    classes^2, so the joins here are on tiny inputs.
    """
    cm = (df.where(F.col(label).isNotNull() & F.col(prediction).isNotNull())
          .groupBy(F.col(label).alias("l"), F.col(prediction).alias("p"))
          .agg(F.count(F.lit(1)).alias("n")))
    sup = cm.groupBy(F.col("l").alias("cls")).agg(F.sum("n").alias("support"))
    prd = cm.groupBy(F.col("p").alias("cls")).agg(F.sum("n").alias("predicted"))
    tp = cm.where(F.col("l") == F.col("p")).select(F.col("l").alias("cls"), F.col("n").alias("tp"))
    return (sup.join(prd, "cls", "full").join(tp, "cls", "left")
            .fillna(0, ["support", "predicted", "tp"]))


def classification_metrics(df: DataFrame, label: str = "label",
                           prediction: str = "prediction") -> DataFrame:
    """accuracy and support-weighted precision/recall/f1 (zero_division = 0)."""
    pc = per_class(df, label, prediction).select(
        "cls", *[F.col(c).cast("double").alias(c) for c in ("support", "predicted", "tp")])
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f1 = F.when(F.col("support") + F.col("predicted") > 0,
                2.0 * F.col("tp") / (F.col("support") + F.col("predicted"))).otherwise(0.0)
    g = pc.agg(F.sum("support").alias("n"), F.sum("tp").alias("tp"),
               F.sum(F.col("support") * prec).alias("wp"),
               F.sum(F.col("support") * rec).alias("wr"),
               F.sum(F.col("support") * f1).alias("wf"))
    return g.select(F.try_divide("tp", "n").alias("accuracy"), F.try_divide("wp", "n").alias("precision"),
                    F.try_divide("wr", "n").alias("recall"), F.try_divide("wf", "n").alias("f1"))


def metrics_for(problem: str, df: DataFrame, label: str = "label",
                prediction: str = "prediction") -> dict[str, float]:
    """Metric values as a dict: the single row of the metrics plan."""
    plan = classification_metrics if problem == "classification" else regression_metrics
    row = plan(df, label, prediction).first()
    return {k: (None if v is None else float(v)) for k, v in row.asDict().items()}


def grouped_metric(df: DataFrame, group: str, metric: str, label: str = "label",
                   prediction: str = "prediction") -> dict:
    """{group value: metric} for r2 / rmse / mae / mape / accuracy in one aggregate."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    e = y - p
    exprs = {
        "rmse": F.sqrt(F.avg(e * e)),
        "mae": F.avg(F.abs(e)),
        "r2": F.lit(1.0) - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count(y)),
        "mape": F.avg(F.abs(e / (y + F.lit(1e-10)))) * 100.0,
        "accuracy": F.avg((y == p).cast("double")),
    }
    if metric not in exprs:
        raise ValueError(f"grouped_metric does not support {metric}")
    rows = df.where(y.isNotNull() & p.isNotNull()).groupBy(group).agg(exprs[metric].alias("m")).collect()
    return {r[group]: r["m"] for r in rows}
