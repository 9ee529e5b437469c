"""SCR-2: the streaming scorer resumes from its checkpoint without re-scoring."""

from pyspark.sql import functions as F

from sparkprep.operators import models
from sparkprep.session import scratch_path
from sparkprep.streaming.scoring import score_stream


def test_stream_scoring_resumes(spark, sf_small):
    e = spark.read.parquet(f"{sf_small}/events.parquet").select("event_id", "user_id", "event_type", "value")
    fitted = models.fit_pipeline(e, "value", "linear_regression", ["user_id", "event_type"])
    path = fitted.save(scratch_path(spark, "stream_model"))
    inbox, outbox, ckpt = (scratch_path(spark, n) for n in ("inbox", "outbox", "ckpt"))
    first = e.where(F.col("event_id") % 2 == 0)
    second = e.where(F.col("event_id") % 2 == 1)
    first.write.parquet(inbox)
    score_stream(spark, path, inbox, e.schema, outbox, ckpt, keep=["event_id"]).awaitTermination()
    assert spark.read.parquet(outbox).count() == first.count()
    second.write.mode("append").parquet(inbox)
    score_stream(spark, path, inbox, e.schema, outbox, ckpt, keep=["event_id"]).awaitTermination()
    out = spark.read.parquet(outbox)
    assert out.count() == e.count()
    assert out.select("event_id").distinct().count() == e.count()
    # the stream applies the same fitted model as a batch score
    batch = fitted.predict(e, ["event_id"]).withColumnRenamed("prediction", "b")
    diff = out.join(batch, "event_id").where(F.abs(F.col("prediction") - F.col("b")) > 1e-9).count()
    assert diff == 0
