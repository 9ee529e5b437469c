"""Format-dispatched reads and writes (SRC-1..7, SNK-1..3).

Paths may be any Hadoop URI (``s3a://bucket/key``, ``hdfs://``, ``file:``);
objects are read in place, never downloaded.  Vector columns are expanded
to scalar columns before a text sink (CSV cannot hold vectors).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from sparkprep.functions.joins import join_small
from sparkprep.functions.materialize import materialize

SUPPORTED = ("csv", "parquet", "json", "jsonl")


def read(spark: SparkSession, path: str | Sequence[str], file_type: str,
         schema: StructType | str | None = None, infer_schema: bool = True,
         drop_malformed: bool = False, sampling_ratio: float | None = None,
         **options) -> DataFrame:
    """Read one dataset.

    csv: header row; column types from ``schema`` when given (no inference
    pass), else inferred.  jsonl: one JSON object per line.  json: files that
    are JSON Lines, a JSON array, or one (possibly multi-line) object; lines
    that do not parse are left out.
    ``drop_malformed`` drops csv and jsonl lines that do not parse.
    Without a schema, ``sampling_ratio`` limits the inference pass to a
    fraction of the rows (csv/json); on large inputs pass a schema instead.
    """
    ft = (file_type or "").lower()
    if ft not in SUPPORTED:
        raise ValueError(f"Unsupported file type: {file_type}")
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    elif sampling_ratio is not None and ft != "parquet":
        reader = reader.option("samplingRatio", float(sampling_ratio))
    for k, v in options.items():
        reader = reader.option(k, v)
    if ft == "csv":
        reader = reader.option("header", True)
        if schema is None:
            reader = reader.option("inferSchema", infer_schema)
        if drop_malformed:
            reader = reader.option("mode", "DROPMALFORMED")
        return reader.csv(path)
    if ft == "parquet":
        return reader.parquet(*([path] if isinstance(path, str) else path))
    if ft == "json":
        return _read_json_documents(spark, path, schema, options)
    if drop_malformed:
        reader = reader.option("mode", "DROPMALFORMED")
    return reader.json(path)


def _document_files(spark: SparkSession, path, options: dict) -> DataFrame:  # noqa: ANN001
    """(_file) of the files that hold one JSON value over several lines.

    Told by their lines alone: some line opens a value without ending it, some
    line ends one that it did not open, and at most one line is a value by
    itself (the last element of an array written one element a line).  Lines are
    parsed only in files that show the first two signs.
    """
    reader = spark.read
    for k in ("recursiveFileLookup", "pathGlobFilter"):
        if k in options:
            reader = reader.option(k, options[k])
    text = reader.text(path).select(F.rtrim(F.ltrim(F.col("value"))).alias("line"), F.col("_metadata.file_path").alias("_file"))
    starts, stops = F.col("line").rlike(r"^[\[{]"), F.col("line").rlike(r"[\]}]$")
    goes_on = F.col("line").rlike(r"[\]}],$")
    signs = text.groupBy("_file").agg(F.max(starts & ~stops).alias("opens"), F.max((stops | goes_on) & ~starts).alias("ends"))
    likely = materialize(signs.where(F.col("opens") & F.col("ends")).select("_file"), "files")
    if likely.isEmpty():
        return likely
    alone = starts & stops & F.try_parse_json("line").isNotNull()
    counted = text.join(likely, "_file", "left_semi").groupBy("_file").agg(F.count(F.when(alone, 1)).alias("alone"))
    return counted.where(F.col("alone") <= 1).select("_file")


def _read_json_documents(spark: SparkSession, path, schema, options: dict) -> DataFrame:  # noqa: ANN001
    """``json``: each file is JSON Lines, a JSON array, or one multi-line object.

    Files are read as lines; lines that do not parse are left out, the others
    stay.  Only files that hold one value over several lines are read whole
    (a multiLine read of a JSON-lines file would keep its first value only).
    """
    def base():  # noqa: ANN202
        r = spark.read.option("mode", "DROPMALFORMED")
        for k, v in options.items():
            r = r.option(k, v)
        return r if schema is None else r.schema(schema)

    lines, whole = base().json(path), base().option("multiLine", True)
    documents = materialize(_document_files(spark, path, options), "files")
    if documents.isEmpty():
        return lines
    if not lines.columns:  # no line parsed anywhere: every file is one value
        return whole.json(path)
    good = lines.select("*", F.col("_metadata.file_path").alias("_file")).join(documents, "_file", "left_anti").drop("_file")
    docs = whole.json(path).select("*", F.col("_metadata.file_path").alias("_file"))
    docs = docs.join(documents, "_file", "left_semi").drop("_file")
    return good.unionByName(docs, allowMissingColumns=True)


REJECT_SCHEMA = "file string, line bigint, text string"


def read_with_rejects(spark: SparkSession, path, file_type: str, schema, rejects_path: str | None = None,  # noqa: ANN001
                      **options) -> tuple[DataFrame, DataFrame]:  # noqa: ANN003
    """(rows, rejects) of JSON-lines or CSV files, from one read of them.

    ``rejects``: file, line (from 1) and text of every line that does not parse
    under ``schema``; written to ``rejects_path`` where one is given.  Rows and
    rejects together are all lines but blank ones (and, with ``header``, the first
    of every CSV file).  Lines are numbered by the counts of the blocks of their file that come
    before theirs, so files of any size are split as usual; a value over several
    lines is no record here.
    """
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    if file_type not in ("json", "jsonl", "csv"):
        raise ValueError(f"no rejects for file type {file_type}")
    bad, header = "_corrupt_text", str(options.pop("header", "false")).lower() == "true"
    wide = StructType([*kind.fields, StructField(bad, StringType())])
    parse = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad, **{k: str(v) for k, v in options.items()}}
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wide.fields)
    parsed = F.from_csv("value", F.lit(ddl), parse) if file_type == "csv" else F.from_json("value", wide, parse)
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                                         F.monotonically_increasing_id().alias("_at"))
    record = materialize(lines.select("_file", "_block", "_at", "value", parsed.alias("_row")), "lines")
    # the lines of a block lie together in one task
    blocks = record.groupBy("_file", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    blank = F.trim("value") == ""
    # of a block's own first line alone it must be known whether it is a header
    kept = record.where(~blank)
    if header:
        first = blocks.where(F.col("_before") == 0).groupBy("_file").agg(F.min("_first").alias("_at")).withColumn("_head", F.lit(True))
        kept = join_small(kept, first, ["_file", "_at"]).where(F.col("_head").isNull()).drop("_head")
    good = F.col("_row").isNotNull() & F.col(f"_row.{bad}").isNull()
    rows = kept.where(good).select(*[F.col("_row").getField(f.name).alias(f.name) for f in kind.fields])
    wrong = join_small(kept.where(~good).select("_file", "_block", "_at", "value"), blocks, ["_file", "_block"])
    line = F.col("_before") + F.col("_at") - F.col("_first") + 1
    rejects = wrong.select(F.col("_file").alias("file"), line.cast("bigint").alias("line"), F.col("value").alias("text"))
    if rejects_path is not None:
        rejects.write.mode("append").parquet(rejects_path)
        rejects = spark.read.schema(REJECT_SCHEMA).parquet(rejects_path)
    return rows, rejects


def expand_vectors(df: DataFrame) -> DataFrame:
    """For text sinks: vector columns become scalar columns ``<c>_0 .. <c>_{n-1}``
    (the width from the column's ML metadata, else one pass), array columns JSON text."""
    vectors = [f.name for f in df.schema.fields if isinstance(f.dataType, VectorUDT)]
    widths = {c: df.schema[c].metadata.get("ml_attr", {}).get("num_attrs") for c in vectors}
    unknown = [c for c in vectors if widths[c] is None]
    if unknown:
        row = df.agg(*[F.max(F.size(vector_to_array(F.col(c)))).alias(c) for c in unknown]).first()
        widths |= {c: row[c] or 0 for c in unknown}
    out = []
    for f in df.schema.fields:
        if f.name in widths:
            values = vector_to_array(F.col(f.name))
            out.extend(values[i].alias(f"{f.name}_{i}") for i in range(widths[f.name]))
        elif isinstance(f.dataType, ArrayType):
            out.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def write(df: DataFrame, path: str, file_type: str, mode: str = "overwrite",
          partition_by: Sequence[str] | None = None) -> str:
    """Write a dataset as a directory of part files (never merged on the driver)."""
    ft = (file_type or "").lower()
    if ft not in SUPPORTED:
        raise ValueError(f"Unsupported file type: {file_type}")
    if ft == "csv":
        df = expand_vectors(df)
    else:
        df = df.select(*[vector_to_array(F.col(f.name)).alias(f.name)
                         if isinstance(f.dataType, VectorUDT) else F.col(f.name)
                         for f in df.schema.fields])
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if ft == "csv":
        w.option("header", True).csv(path)
    elif ft == "parquet":
        w.parquet(path)
    else:
        w.json(path)
    return path


def list_objects(spark: SparkSession, path: str, recursive: bool = True,
                 glob: str | None = None) -> DataFrame:
    """Object listing (name, size, last_modified) without reading contents."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    return files.select(F.col("path").alias("name"), F.col("length").alias("size"),
                        F.col("modificationTime").alias("last_modified"))
