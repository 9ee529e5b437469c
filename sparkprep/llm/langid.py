"""Language identification by Bayesian fusion of text, markup, address and host."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep.functions.materialize import materialize
from sparkprep.llm.common import bounded_batches, byte_groups, hash_sample, tidy, utf8

LANGUAGES = ("de", "en", "es", "fr")
OTHER = "other"          # a class of its own: text of no known language
BUCKETS = 1 << 13
TRAIN_ROWS = 4000        # most labelled rows that the text model is fitted on
EVIDENCE = 60            # a text weighs as much as so many of its trigrams, at most
OTHER_PRIOR = 0.002
OTHER_COST = 1.0         # nats per trigram by which a language may be worse than chance
SMOOTHING = 8.0          # rows that a level's parent counts for
THRESHOLD = 0.5
GROUP_BYTES = 1 << 20

_FOLD = np.full(256, 0x20, np.uint8)  # letters stay, A-Z lowered; all other ASCII reads as a space
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every byte trigram with a letter at its centre; a space surrounds each row."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    b = np.full(len(data) + len(offsets), 0x20, np.uint32)
    at = np.arange(len(data)) + rows + 1
    b[at] = _FOLD[data]
    letter = b[at] != 0x20
    at, rows = at[letter], rows[letter]
    code = (b[at - 1] << np.uint32(16)) | (b[at] << np.uint32(8)) | b[at + 1]
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - (BUCKETS.bit_length() - 1))).astype(np.int64), rows


def fit_text_model(labelled: DataFrame, languages: Sequence[str] = LANGUAGES, id_col: str = "doc_id",
                   text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """Log probability of every trigram bucket (rows) in every language and ``other``.

    Fitted on at most ``train_rows`` labelled rows, those of the smallest id
    hash; what reaches the driver is one count vector per language and task.
    """
    bounded_batches(labelled.sparkSession)
    known = labelled.where(F.col(lang_col).isin(list(languages)) & F.col(text_col).isNotNull())
    sample = hash_sample(known, F.col(id_col), train_rows).select(
        F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text")).repartition(4, F.xxhash64("text"))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in stream:
            labels = batch.column(0).to_pylist()
            data, offsets = utf8(batch.column(1))
            index = np.array([list(languages).index(x) for x in labels], np.int64)
            for a, b in byte_groups(offsets, GROUP_BYTES):
                bucket, row = trigrams(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                cell = index[a + row] * BUCKETS + bucket
                counts += np.bincount(cell, minlength=counts.size).reshape(counts.shape)
        yield pa.RecordBatch.from_arrays([pa.array([counts.tobytes()])], names=["counts"])
    parts = sample.select("lang", "text").mapInArrow(tidy(run), "counts binary").collect()
    counts = sum((np.frombuffer(r["counts"], np.int64).reshape(len(languages), BUCKETS) for r in parts),
                 np.zeros((len(languages), BUCKETS), np.int64)) + 0.5
    known = np.log(counts / counts.sum(axis=1, keepdims=True))
    return np.vstack([known, np.full(BUCKETS, -np.log(BUCKETS) - OTHER_COST)]).T.copy()


def _softmax(scores: np.ndarray) -> np.ndarray:
    weights = np.exp(scores - scores.max(axis=1, keepdims=True))
    return weights / weights.sum(axis=1, keepdims=True)


def _lists(values: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(values, np.float64).ravel())
    return pa.FixedSizeListArray.from_arrays(flat, values.shape[1]).cast(pa.list_(pa.float64()))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, width)


def _text_posteriors(rows: DataFrame, model: np.ndarray, start: np.ndarray) -> DataFrame:
    """``rows`` (text last) with, for the text, its number ``n`` of trigrams, the
    weighted log likelihoods ``ll`` and the posteriors t0, t1, ... by text alone
    (0 without letters)."""
    classes = model.shape[1]
    kept = rows.columns[:-1]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            data, offsets = utf8(batch.column(batch.num_columns - 1))
            n = np.zeros(batch.num_rows, np.int64)
            ll = np.zeros((batch.num_rows, classes))
            for a, b in byte_groups(offsets, GROUP_BYTES):
                bucket, row = trigrams(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                n[a:b] = np.bincount(row, minlength=b - a)
                for c in range(classes):
                    ll[a:b, c] = np.bincount(row, model[bucket, c], minlength=b - a)
            ll *= np.minimum(1.0, EVIDENCE / np.maximum(n, 1))[:, None]
            t = _softmax(ll + start) * (n > 0)[:, None]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n), _lists(ll), *[pa.array(x) for x in t.T]],
                                             names=[*kept, "n", "ll", *[f"t{i}" for i in range(classes)]])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    shares = ", ".join(f"t{i} double" for i in range(classes))
    return rows.mapInArrow(tidy(run), f"{schema}, n bigint, ll array<double>, {shares}")


def _normal_declared(c: Column, languages: Sequence[str]) -> Column:
    """The primary subtag if it is a known language; else other, or none."""
    tag = F.lower(F.regexp_extract(F.trim(F.coalesce(c, F.lit(""))), "^([A-Za-z]+)", 1))
    return F.when(tag == "", "none").when(tag.isin(list(languages)), tag).otherwise(OTHER)


def identify(rows: DataFrame, model: np.ndarray, languages: Sequence[str] = LANGUAGES, id_cols: Sequence[str] = ("id",),
             threshold: float = THRESHOLD) -> DataFrame:
    """``id_cols, lang, p, declared, text_lang`` for rows (id_cols, text, declared, suffix, host).

    Log posterior = weighted text log likelihood + log P(declared | language)
    + log prior of the host.  The channel of declarations and the priors come
    from grouped sums of the text-only posteriors over all rows: a host's
    counts are smoothed with its address suffix's, those with the global ones,
    each row's own share taken out.  ``lang`` is the best language, or null: if
    its probability is under ``threshold``, ``other`` wins, or the text has no
    letters.  Null suffixes and hosts form a group of their own each; repeated
    rows count separately; empty tables give empty results.
    """
    bounded_batches(rows.sparkSession)
    classes = [*languages, OTHER]
    k = len(classes)
    base = rows.select(*id_cols, _normal_declared(F.col("declared"), languages).alias("declared"),
                       F.coalesce("suffix", F.lit("")).alias("suffix"), F.coalesce("host", F.lit("")).alias("host"), "text")
    start = np.log(np.array([(1 - OTHER_PRIOR) / len(languages)] * len(languages) + [OTHER_PRIOR]))
    scored = materialize(_text_posteriors(base, model, start), "languages")
    # declarations are normalised: at most (languages + 2) rows
    channel = scored.groupBy("declared").agg(*[F.sum(f"t{i}").alias(f"s{i}") for i in range(k)]).collect()
    total = np.array([[r[f"s{i}"] for i in range(k)] for r in channel], float).reshape(-1, k)
    overall = total.sum(axis=0) + np.exp(start)
    prior = overall / overall.sum()
    share = (total.sum(axis=1) + 1) / (total.sum() + len(channel) + 1)
    says = np.log(np.maximum((total + SMOOTHING * share[:, None]) / (total.sum(axis=0) + SMOOTHING), 1e-6))
    declared_given = {r["declared"]: row for r, row in zip(channel, says)}

    def summed(key: str) -> DataFrame:
        sums = scored.groupBy(key).agg(*[F.sum(f"t{i}").alias(f"s{i}") for i in range(k)])
        return sums.select(key, F.array(*[f"s{i}" for i in range(k)]).alias(f"_{key}"))
    own = F.array(*[f"t{i}" for i in range(k)]).alias("_own")
    joined = scored.join(summed("host"), "host").join(summed("suffix"), "suffix").select(
        *id_cols, "declared", "n", "ll", own, "_host", "_suffix")
    width = len(id_cols)

    def fuse(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            ll, t, host, suffix = (_matrix(batch.column(width + 2 + i), k) for i in range(4))
            has = batch.column(width + 1).to_numpy() > 0
            by_suffix = np.maximum(suffix - t, 0) + SMOOTHING * prior
            by_suffix /= by_suffix.sum(axis=1, keepdims=True)
            by_host = np.maximum(host - t, 0) + SMOOTHING * by_suffix
            by_host /= by_host.sum(axis=1, keepdims=True)
            said = batch.column(width).to_pylist()
            scores = ll + np.log(np.maximum(by_host, 1e-9))
            if said:
                scores += np.stack([declared_given[d] for d in said])
            p = _softmax(scores) if len(scores) else scores
            best, text = p.argmax(axis=1), t.argmax(axis=1)
            top = p.max(axis=1) if len(p) else np.zeros(0)
            sure = has & (top >= threshold) & (best < len(languages))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:width], pa.array([classes[b] if s else None for b, s in zip(best, sure)], pa.string()),
                 pa.array(top), batch.column(width),
                 pa.array([classes[b] if s else None for b, s in zip(text, has)], pa.string()), batch.column(width + 1)],
                names=[*id_cols, "lang", "p", "declared", "text_lang", "n"])
    ids = ", ".join(f"`{c}` {joined.schema[c].dataType.simpleString()}" for c in id_cols)
    return joined.mapInArrow(tidy(fuse), f"{ids}, lang string, p double, declared string, text_lang string, n bigint")


def page_evidence(pages: DataFrame) -> DataFrame:
    """``page_id, text, declared, suffix, host`` of raw pages; tags, scripts and styles are not text.
    ``declared`` is from the first ``html`` tag, anywhere outside comments, that has a ``lang``."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    page = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    text = F.regexp_replace(F.regexp_replace(page, "<[^>]*>", " "), "&#?[A-Za-z0-9]+;", " ")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "://([^/?#]*)", 1))
    return pages.select("page_id", text.alias("text"),
                        F.regexp_extract(page, r"(?is)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", 1).alias("declared"),
                        F.regexp_extract(host, r"\.([a-z]+)(?::\d+)?$", 1).alias("suffix"), host.alias("host"))
