"""URL filter: rules first, then logistic regression on hashed character n-grams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep.llm.common import lower_ascii

FEATURES = 1 << 13
TRAIN_ROWS = 4096  # most labelled urls that the model is fitted on
Rule = tuple[str, str, str]  # verdict, host, path


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ://, up to /, ? or #, A-Z lower-cased.  Path: from
    there up to ? or #.  Null, or no ://: both empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def match(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls.  A rule fits its
    host and all subdomains, if the path starts with the rule's."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the last that fits stays
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def ngrams(text: Column, n: int, prefix: str) -> Column:
    """All character n-grams of ^text$ (all of it, if shorter)."""
    whole = F.concat(F.lit("^"), text, F.lit("$"))
    last = F.greatest(F.length(whole) - n + 1, F.lit(1))
    return F.transform(F.sequence(F.lit(1), last), lambda i: F.concat(F.lit(prefix), F.substr(whole, i, F.lit(n))))


def features(rows: DataFrame, size: int = FEATURES) -> DataFrame:
    grams = F.concat(*[ngrams(F.col(c), n, c[0]) for c in ("host", "path") for n in (3, 4)])
    hashed = HashingTF(numFeatures=size, inputCol="grams", outputCol="features")
    return hashed.transform(rows.withColumn("grams", grams)).drop("grams")


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS):  # noqa: ANN201
    """A model from a labelled table (host, path, block 0/1), or the only class there is.

    At most ``train_rows`` distinct urls, those of the smallest hash: a bounded
    sample, the same at every run.
    """
    key = F.xxhash64("host", "path")
    sample = labelled.select("host", "path", "block").distinct().orderBy(key, "host", "path", "block").limit(train_rows)
    sample = features(sample.repartition(2, "host", "path")).select("features", F.col("block").cast("double").alias("label"))
    sample = sample.cache()
    try:
        classes = [r["label"] for r in sample.select("label").distinct().collect()]
        if len(classes) < 2:
            return classes[0] if classes else 0.0
        return LogisticRegression(maxIter=40, regParam=1e-3, standardization=False).fit(sample)
    finally:
        sample.unpersist()


def block_probability(rows: DataFrame, model) -> DataFrame:  # noqa: ANN001
    """``rows`` (with host, path) and ``p_block``."""
    if isinstance(model, float):
        return rows.withColumn("p_block", F.lit(model))
    columns = [F.col(c) for c in rows.columns]
    scored = model.transform(features(rows))
    return scored.select(*columns, vector_to_array("probability")[1].alias("p_block"))


def judge(pages: DataFrame, rules: Sequence[Rule], labelled: DataFrame | None = None, id_col: str = "page_id",
          url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, p_block`` for every row.

    The rule's verdict, where a rule fits; else the model's: block from an
    even chance on.  The model is fitted on ``labelled`` (url, block 0/1), or
    on the urls of ``pages`` that a rule decides.  With one class only, that
    class is the verdict; with none, allow.

    Null urls have an empty host and path and get the model's verdict;
    repeated rows are judged alike; other columns are not read.
    """
    host, path = host_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = match(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("ruled", verdict)
    if labelled is None:
        known = rows.where(F.col("ruled").isNotNull()).select("host", "path", (F.col("ruled") == "block").alias("block"))
    else:
        known = labelled.select(host.alias("host"), path.alias("path"), F.col("block"))
    scored = block_probability(rows, fit(known))
    said = F.when(F.col("p_block") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", said).alias("verdict"), "p_block")
