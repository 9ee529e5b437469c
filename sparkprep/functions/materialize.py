"""Cut lineage by writing a table into the shared checkpoint folder.

``Dataset.checkpoint`` on an unpersisted plan computes it twice (once for
the eager count, once for the checkpoint write) and stores serialized
rows.  Writing parquet once under the folder named by
``spark.checkpoint.dir`` computes the plan a single time, stores it
columnar, and survives executor loss (later stages re-read the files
instead of recomputing upstream work).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from sparkprep.session import scratch_path


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
