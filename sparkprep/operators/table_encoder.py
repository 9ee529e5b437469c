"""Category codes kept in a table (ENC-1, CLN-7).

A ``pyspark.ml`` stage whose map from value to code is a Parquet table, written
once and joined at scoring by a broadcast measured to be small, else by a
shuffle.  Nothing is collected, whatever the number of categories.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader,
                             MLWritable, MLWriter)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprep.functions.joins import join_small
from sparkprep.functions.ordinal import dense_codes
from sparkprep.session import scratch_path


class TableIndexer(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Codes = rank of the value among the distinct values, from 0, in code-point order."""

    def __init__(self, inputCol: str | None = None, outputCol: str | None = None) -> None:  # noqa: N803
        super().__init__()
        self._set(**{k: v for k, v in (("inputCol", inputCol), ("outputCol", outputCol)) if v is not None})

    def _fit(self, dataset: DataFrame) -> TableIndexerModel:
        spark, column = dataset.sparkSession, self.getInputCol()
        path = scratch_path(spark, "codes")
        codes = dense_codes(dataset.select(F.col(f"`{column}`").cast("string").alias("value")), "value", "code")
        codes.select("value", F.col("code").cast("double").alias("code")).write.parquet(path)
        model = TableIndexerModel()
        self._copyValues(model)
        return model._set(tablePath=path, size=spark.read.parquet(path).count())


class TableIndexerModel(Model, HasInputCol, HasOutputCol, MLReadable, MLWritable):
    """Adds the code as double; null and unseen values get the code after the last."""

    tablePath = Param(Params._dummy(), "tablePath", "the table (value, code)", TypeConverters.toString)
    size = Param(Params._dummy(), "size", "number of known values", TypeConverters.toInt)

    @property
    def table(self) -> DataFrame:
        return SparkSession.getActiveSession().read.parquet(self.getOrDefault("tablePath"))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out, value = self.getOutputCol(), "__value"
        codes = self.table.select(F.col("value").alias(value), F.col("code").alias("__code"))
        keyed = dataset.drop(out).withColumn(value, F.col(f"`{self.getInputCol()}`").cast("string"))
        joined = join_small(keyed, codes, value)
        code = F.coalesce(F.col("__code"), F.lit(float(self.getOrDefault("size"))))
        return joined.withColumn(out, code).drop(value, "__code")

    def decode(self, dataset: DataFrame, column: str, output: str) -> DataFrame:
        """``dataset`` with the value of every code, null for none."""
        values = self.table.select(F.col("code").alias("__code"), F.col("value").alias(output))
        return join_small(dataset.drop(output).withColumn("__code", F.col(f"`{column}`").cast("double")), values, "__code").drop("__code")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model: TableIndexerModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.table.write.parquet(f"{path}/table")


class _Reader(MLReader):
    def __init__(self, cls: type) -> None:
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> TableIndexerModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model._set(tablePath=f"{path}/table")
