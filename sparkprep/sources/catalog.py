"""Dataset / model catalog tables (CAT-1..3, TRN-2).

The catalog is an append-only parquet table at a shared path; an entry is
never updated in place, the latest row per id wins.  Lineage is a
transitive walk over ``parent_dataset_id`` by repeated joins, one hop per
iteration.
"""

from __future__ import annotations

import datetime as _dt
import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkprep.functions.materialize import materialize

DATASET_SCHEMA = (
    "dataset_id string, name string, description string, file_type string, storage_path string, "
    "created_at timestamp, num_rows bigint, num_columns int, "
    "schema array<struct<name:string,type:string>>, parent_dataset_id string, "
    "processing_history array<map<string,string>>")

REPORT_SCHEMA = ("model_id string, model_type string, dataset_id string, target string, "
                 "metric string, value double, trained_at timestamp")


def _now() -> _dt.datetime:
    return _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)


def register_dataset(spark: SparkSession, catalog_path: str, df: DataFrame, name: str,
                     storage_path: str, file_type: str, parent_dataset_id: str | None = None,
                     operations: Sequence[dict] | None = None, description: str = "",
                     dataset_id: str | None = None, num_rows: int | None = None) -> str:
    """Append one catalog row describing ``df`` (written at ``storage_path``)."""
    dataset_id = dataset_id or uuid.uuid4().hex
    if num_rows is None:
        num_rows = df.count()
    history = [{k: json.dumps(v) if not isinstance(v, str) else v for k, v in op.items()}
               for op in (operations or [])]
    row = (dataset_id, name, description, file_type, storage_path, _now(), int(num_rows),
           len(df.columns), [(f.name, f.dataType.simpleString()) for f in df.schema.fields],
           parent_dataset_id, history)
    spark.createDataFrame([row], DATASET_SCHEMA).coalesce(1).write.mode("append").parquet(catalog_path)
    return dataset_id


def list_datasets(spark: SparkSession, catalog_path: str, name: str | None = None,
                  dataset_id: str | None = None) -> DataFrame:
    """Latest row per dataset id (optionally filtered by name or id)."""
    cat = spark.read.schema(DATASET_SCHEMA).parquet(catalog_path)
    if name is not None:
        cat = cat.where(F.col("name") == name)
    if dataset_id is not None:
        cat = cat.where(F.col("dataset_id") == dataset_id)
    w = Window.partitionBy("dataset_id").orderBy(F.desc("created_at"), F.desc("num_rows"), "storage_path")
    return cat.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def is_registered(spark: SparkSession, catalog_path: str, dataset_id: str) -> bool:
    """Whether the catalog has the dataset; a catalog that does not exist yet has none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(catalog_path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return False
    return get_dataset(spark, catalog_path, dataset_id) is not None


def get_dataset(spark: SparkSession, catalog_path: str, dataset_id: str) -> dict | None:
    """The latest catalog entry of one dataset as a dict (None if unknown)."""
    row = list_datasets(spark, catalog_path, dataset_id=dataset_id).first()
    return row.asDict(recursive=True) if row is not None else None


def lineage(spark: SparkSession, catalog_path: str) -> DataFrame:
    """(dataset_id, ancestor_id, depth) for every dataset; depth 0 is itself.

    One join per generation until no dataset has a further ancestor; pairs
    found before are left out, so a cycle of parents ends as well.
    """
    latest = materialize(list_datasets(spark, catalog_path).select("dataset_id", "parent_dataset_id"), "lineage")
    edges = latest.where(F.col("parent_dataset_id").isNotNull()).select(
        F.col("dataset_id").alias("child"), F.col("parent_dataset_id").alias("parent"))
    frontier = latest.select("dataset_id", F.col("dataset_id").alias("ancestor_id"), F.lit(0).alias("depth"))
    result, d = frontier, 0
    while True:
        d += 1
        frontier = (frontier.join(edges, frontier["ancestor_id"] == edges["child"])
                    .select("dataset_id", F.col("parent").alias("ancestor_id"), F.lit(d).alias("depth"))
                    .join(result.select("dataset_id", "ancestor_id"), ["dataset_id", "ancestor_id"], "left_anti"))
        frontier = materialize(frontier, "lineage")
        if frontier.isEmpty():
            return result
        result = result.unionByName(frontier)


MODEL_SCHEMA = ("model_id string, model_type string, problem string, dataset_id string, target string, features array<string>, "
                "hyperparameters string, metrics map<string,double>, train_samples bigint, test_samples bigint, "
                "storage_path string, created_at timestamp")


def register_model(spark: SparkSession, models_path: str, model_id: str, fitted, dataset_id: str,  # noqa: ANN001
                   storage_path: str, metrics: dict[str, float]) -> str:
    """Append one row describing a trained model (saved at ``storage_path``)."""
    row = (model_id, fitted.model_type, fitted.problem, dataset_id, fitted.target, list(fitted.features),
           json.dumps(fitted.meta.get("params", {}), sort_keys=True), {k: v for k, v in metrics.items() if v is not None},
           fitted.meta.get("train_samples"), fitted.meta.get("test_samples"), storage_path, _now())
    spark.createDataFrame([row], MODEL_SCHEMA).coalesce(1).write.mode("append").parquet(models_path)
    return model_id


def list_models(spark: SparkSession, models_path: str, dataset_id: str | None = None, model_type: str | None = None) -> DataFrame:
    """Latest row per model id, of one dataset or type."""
    rows = spark.read.schema(MODEL_SCHEMA).parquet(models_path)
    for c, v in (("dataset_id", dataset_id), ("model_type", model_type)):
        if v is not None:
            rows = rows.where(F.col(c) == v)
    w = Window.partitionBy("model_id").orderBy(F.desc("created_at"), "storage_path")
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def append_report(spark: SparkSession, report_path: str, model_id: str, model_type: str,
                  dataset_id: str, target: str, metrics: dict[str, float]) -> None:
    ts = _now()
    rows = [(model_id, model_type, dataset_id, target, k, None if v is None else float(v), ts)
            for k, v in metrics.items()]
    spark.createDataFrame(rows, REPORT_SCHEMA).coalesce(1).write.mode("append").parquet(report_path)


def latest_reports(spark: SparkSession, report_path: str) -> DataFrame:
    rep = spark.read.schema(REPORT_SCHEMA).parquet(report_path)
    w = Window.partitionBy("model_id", "metric").orderBy(F.desc("trained_at"))
    return rep.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def best_model_per_metric(spark: SparkSession, report_path: str) -> DataFrame:
    """Best model per metric (errors: lowest; scores: highest)."""
    rep = latest_reports(spark, report_path)
    key = F.when(F.col("metric").isin("rmse", "mae", "mape"), F.col("value")).otherwise(-F.col("value"))
    w = Window.partitionBy("metric").orderBy(key, F.col("model_id"))
    return rep.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


CHART_SCHEMA = ("chart_id string, chart_type string, dataset_id string, model_id string, "
                "table_path string, num_rows bigint, options string, created_at timestamp")


def register_chart(spark: SparkSession, catalog_path: str, chart: DataFrame, chart_type: str,
                   dataset_id: str | None, table_path: str, model_id: str | None = None,
                   options: dict | None = None, chart_id: str | None = None) -> str:
    """Write a chart table and append its catalog row (CAT-2 for charts)."""
    chart_id = chart_id or uuid.uuid4().hex
    chart.write.mode("overwrite").parquet(table_path)
    n = spark.read.parquet(table_path).count()
    row = (chart_id, chart_type, dataset_id, model_id, table_path, int(n),
           json.dumps(options or {}, sort_keys=True), _now())
    spark.createDataFrame([row], CHART_SCHEMA).coalesce(1).write.mode("append").parquet(catalog_path)
    return chart_id


def list_charts(spark: SparkSession, catalog_path: str, dataset_id: str | None = None,
                model_id: str | None = None, chart_type: str | None = None) -> DataFrame:
    """Latest row per chart id, filtered by dataset, model and/or chart type."""
    cat = spark.read.schema(CHART_SCHEMA).parquet(catalog_path)
    for c, v in (("dataset_id", dataset_id), ("model_id", model_id), ("chart_type", chart_type)):
        if v is not None:
            cat = cat.where(F.col(c) == v)
    w = Window.partitionBy("chart_id").orderBy(F.desc("created_at"))
    return cat.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
