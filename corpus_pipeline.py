"""A training corpus from raw documents: language, near-duplicates, repeats, mixture, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next one's
documents.  ``run`` applies them all to the table ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprep.functions.materialize import materialize
from sparkprep.llm import langid, mixing, packing, simhash, suffix_dedup
from sparkprep.llm.common import packed, row_key, table, text_hash, unpacked, with_found
from sparkprep.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known, with that language as ``lang``.

    Rejects texts without letters and texts that no language explains better
    than chance.  The declared language is the column ``lang``, the host the
    column ``source``.  Rows of one doc_id and text are decided alike, whatever
    they declare; null texts have no letters; further columns are carried.
    """
    model = langid.fit_text_model(docs)
    none = F.lit(None).cast("string")
    evidence = docs.select(*row_key("doc_id", "text"), F.col("text"), F.col("lang").alias("declared"),
                           none.alias("suffix"), F.col("source").alias("host"))
    found = langid.identify(evidence, model, id_cols=["_d", "_t"])
    changed = (found.select("_d", "_t", F.col("lang").alias("_lang"), "declared")
               .where(~F.col("lang").eqNullSafe(F.col("declared")))
               .groupBy("_d", "_t").agg(F.max("_lang").alias("_lang"), F.lit(True).alias("_changed")))
    # documents whose language is as declared need no word from the table of the others
    joined = with_found(docs, changed)
    said = F.lower(F.regexp_extract(F.trim(F.col("_row.lang")), "^([A-Za-z]+)", 1))
    lang = F.when(F.col("_changed"), F.col("_lang")).otherwise(said)
    return (joined.withColumn("_lang", lang).where(F.col("_lang").isNotNull())
            .withColumn("_row", F.col("_row").withField("lang", F.col("_lang"))).select(*unpacked(docs.columns)))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate group: that of the smallest doc_id
    (null last) and text hash.  Rows that share both are the same document."""
    keepers = materialize(simhash.keepers(docs), "keepers")
    repeated = keepers.where(F.col("n") > 1).limit(1).count()
    rows = docs.select(F.col("doc_id").alias("_d"), text_hash("text").alias("_t"), packed(docs))
    own = F.col("_d").eqNullSafe(F.col("id")) & (F.col("_t") == F.col("text_hash"))
    kept = rows.join(keepers, own, "left_semi")
    return (kept.dropDuplicates(["_d", "_t"]) if repeated else kept).select(*unpacked(docs.columns))


#: A run of text that occurs again goes if it has more than 50 words.  Strings of so many
#: bytes are compared: 51 words of prose are longer (285 bytes at least in the test documents).
REPEAT_WORDS = 51
REPEAT_BYTES = 224


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of over 50 words that occur more than once.

    A run of fewer whole words stays, and so does one of under ``REPEAT_BYTES``
    bytes.  Null and empty texts stay as they are; repeated rows are each other's
    copies; an empty table gives an empty result; further columns are carried.
    """
    cut = suffix_dedup.remove_repeats(docs, match=REPEAT_BYTES, min_words=REPEAT_WORDS)
    changed = F.col("n_removed") > 0
    text = suffix_dedup.joined_text(F.col("parts"))
    row = F.col("_row").withField("text", text)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.char_length(text).cast(docs.schema["n_chars"].dataType))
    return cut.withColumn("_row", F.when(changed, row).otherwise(F.col("_row"))).select(*unpacked(docs.columns))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Null and empty texts have size 0; a null source is a source of its own;
    repeated rows are taken each by its own copies; further columns are carried.
    """
    return mixing.apply_mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its place in a training sequence.

    A null text is an empty one; repeated rows are packed each; an empty table
    gives an empty result; further columns are not read.
    """
    return packing.pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Stages that hash, fit a model or tokenise have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLE = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
