"""SCR-2: a stateless Structured Streaming query that scores new files.

New parquet files dropped in ``input_dir`` are read as a stream, scored by
the saved pipeline (the same fitted encoders as in training), and appended
to ``output_dir``; progress lives in ``checkpoint_dir`` so a restarted or
failed query resumes without re-scoring.  ``available_now`` processes what
is there and stops (batch-like backfill); otherwise it keeps running.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from sparkprep.operators.models import FittedModel
from sparkprep.sources import catalog


def score_stream(spark: SparkSession, model_path: str, input_dir: str, schema: StructType,
                 output_dir: str, checkpoint_dir: str, keep: Sequence[str] | None = None,
                 available_now: bool = True, max_files_per_trigger: int | None = None) -> StreamingQuery:
    model = FittedModel.load(model_path)
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(input_dir)
    scored = model.predict(stream, keep)
    writer = (scored.writeStream.format("parquet").option("path", output_dir)
              .option("checkpointLocation", checkpoint_dir).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def score_stream_registered(spark: SparkSession, model_path: str, input_dir: str, schema: StructType, output_dir: str,
                            checkpoint_dir: str, catalog_path: str, parent_dataset_id: str, keep: Sequence[str] | None = None,
                            available_now: bool = True, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Scores new files and registers every batch as a child of its input dataset, once.

    A batch writes its own folder ``batch=<id>``, replacing what a broken attempt
    left there, and then its catalog entry, whose id names the batch; an entry
    that exists is not written again.  So a replayed batch adds no row and no
    child, wherever the attempt before it stopped.  ``registered_rows`` reads the
    folders that the catalog names.
    """
    model = FittedModel.load(model_path)
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)

    def commit(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        path, child = f"{output_dir.rstrip('/')}/batch={number}", f"{parent_dataset_id}/batch-{number}"
        model.predict(batch, keep).write.mode("overwrite").parquet(path)
        if not catalog.is_registered(session, catalog_path, child):
            catalog.register_dataset(session, catalog_path, session.read.parquet(path), f"{parent_dataset_id}_scored_{number}", path,
                                     "parquet", parent_dataset_id, [{"type": "stream_predict", "model_type": model.model_type}],
                                     dataset_id=child)
    writer = reader.parquet(input_dir).writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def registered_rows(spark: SparkSession, catalog_path: str, parent_dataset_id: str) -> DataFrame | None:
    """All rows of the registered batches of a dataset; None before the first."""
    children = catalog.list_datasets(spark, catalog_path).where(F.col("parent_dataset_id") == parent_dataset_id)
    children = children.where(F.exists("processing_history", lambda h: h["type"] == "stream_predict"))
    paths = [r["storage_path"] for r in children.select("storage_path").orderBy("storage_path").collect()]
    return spark.read.parquet(*paths) if paths else None
