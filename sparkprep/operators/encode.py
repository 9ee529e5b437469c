"""Encoders kept inside fitted models, and deterministic splits (ENC, SPL)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep.functions.exprs import HASH_MOD, split_hash


def string_indexer(column: str, output: str | None = None,
                   handle_invalid: str = "keep") -> StringIndexer:
    """Codes = rank of the value in alphabetical order; unseen values get
    the extra code len(labels) (``handle_invalid="keep"``)."""
    return StringIndexer(inputCol=column, outputCol=output or f"{column}_index",
                         stringOrderType="alphabetAsc", handleInvalid=handle_invalid)


def index_to_string(indexer_model, column: str, output: str) -> IndexToString:  # noqa: ANN001
    return IndexToString(inputCol=column, outputCol=output, labels=indexer_model.labels)


def encode_target(df: DataFrame, target: str, output: str | None = None):  # noqa: ANN201
    """Fit a label indexer on a string target; returns (frame, fitted indexer)."""
    model = string_indexer(target, output or f"{target}_index", "error").fit(df)
    return model.transform(df), model


def train_test_split(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42,
                     output: str = "split") -> DataFrame:
    """Adds ``split`` = 'test' | 'train' from a hash of an integer key.

    Stable across runs and engines (no sampling, nothing dropped); the
    fraction of test rows is ``test_size`` in expectation.
    """
    if not 0.0 < test_size < 1.0:
        raise ValueError("test_size must be in (0, 1)")
    cut = int(test_size * HASH_MOD)
    return df.withColumn(output, F.when(split_hash(key, seed) < F.lit(cut), "test").otherwise("train"))


def kfold(df: DataFrame, key: str, k: int = 5, seed: int = 42, output: str = "fold") -> DataFrame:
    """Adds ``fold`` in 0..k-1 = floor(hash * k / 2**31)."""
    if k < 2:
        raise ValueError("k must be >= 2")
    return df.withColumn(output, F.floor(split_hash(key, seed) * F.lit(k) / F.lit(HASH_MOD)).cast("int"))


def row_key(df: DataFrame, columns: Sequence[str], output: str = "_row_key") -> DataFrame:
    """A 63-bit key from row content, for tables without an integer id."""
    return df.withColumn(output, F.abs(F.xxhash64(*columns)) % F.lit(1 << 62))
