"""Passages of over 50 words that two documents share, in the pipeline's stage."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sparkprep.llm import suffix_dedup

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(rng, vocabulary, n):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="module")
def planted():
    """300 documents; 100 passages of 51 to 70 words stand in two each, 40 of 30 to 50 in two others."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(1, 8))) for _ in range(4000)]
    docs = [prose(rng, vocabulary, rng.randint(60, 200)).split(" ") for _ in range(300)]
    long, short = [], []
    for j in range(140):
        n = 51 + j % 20 if j < 100 else 30 + j % 21
        passage = prose(rng, vocabulary, n)
        (long if j < 100 else short).append(passage)
        for d in (2 * j, 2 * j + 1):
            at = rng.randint(0, len(docs[d]))
            docs[d][at:at] = [passage]
    return [" ".join(d) for d in docs], long, short


def test_stage_removes_passages_of_over_50_words(spark, planted):
    import corpus_pipeline
    texts, long, short = planted
    assert min(map(len, (p.encode() for p in long))) < 300  # shorter than op7's strings
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], SCHEMA)
    out = {r.doc_id: r for r in corpus_pipeline.suffix_array_dedup(spark, df, "").collect()}
    for j, passage in enumerate(long):
        for d in (2 * j, 2 * j + 1):
            assert passage not in out[d].text and out[d].n_chars == len(out[d].text)
            before, after = texts[d].split(passage)
            # what stood around it stays, but for characters that both documents happen to share
            assert len(before) + len(after) - 12 <= len(out[d].text) <= len(before) + len(after)
    for d in range(200, 300):
        assert out[d].text == texts[d]  # 50 words or fewer, or nothing repeated
    assert all(any(p in t for t in texts[200:280]) for p in short)


def test_whole_words(spark):
    rows = [("one two three", 0, 13, 3), ("one two three", 1, 13, 2), ("one two three", 1, 12, 1), ("one two three", 3, 8, 1),
            ("one two three", 4, 7, 1), ("one two three", 5, 6, 0), ("éa b", 0, 3, 1), ("éa b", 1, 3, 0), ("a", 0, 1, 1), ("  ", 0, 2, 0)]
    df = spark.createDataFrame(rows, "text string, lo bigint, hi bigint, n int").withColumn("b", F.encode("text", "UTF-8"))
    got = df.select("n", suffix_dedup.whole_words(F.col("b"), F.col("lo"), F.col("hi")).alias("found")).collect()
    assert [r.found for r in got] == [r.n for r in got]


def test_rows_of_a_common_passage_stay_spread(spark, monkeypatch):
    """One passage in 1,500 documents: no task gets all samples of one key, and every copy goes."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    passage = " ".join(word() for _ in range(100))
    rows = [(i, f"{word()} {i} {passage} {i} {word()}") for i in range(1500)]
    largest = {}

    def watched(df, name="stage"):
        out = real(df, name)
        if name == "again":
            per_task = df.groupBy("key", F.spark_partition_id()).count()
            top = per_task.groupBy("key").agg(F.sum("count").alias("n"), F.max("count").alias("most")).orderBy(F.desc("n")).first()
            largest[name] = (top.most, top.n)
        return out

    real = suffix_dedup.materialize
    monkeypatch.setattr(suffix_dedup, "materialize", watched)
    held = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
        got = suffix_dedup.remove_repeats(df).select("_row.text", "spans", suffix_dedup.joined_text(F.col("parts")).alias("kept")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    most, total = largest["again"]
    assert total >= 1500 and most <= 0.5 * total
    assert len(got) == 1500
    for r in got:
        (span,) = r.spans
        assert r.text.encode()[span.lo:span.hi].decode().find(passage) >= 0 and passage not in r.kept


def test_op7_returns_the_remaining_text(spark, planted, tmp_path):
    """The query's ``text`` is what stays of a document: n_bytes is the input's size, planted or not."""
    from sparkprep.llm import queries
    texts, short, _ = planted  # passages of 51 to 70 words that are shorter than 400 bytes stay, longer ones go
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(10))
    long = [" ".join(word() for _ in range(51 + j)) for j in range(20)]
    texts = texts[:200] + [f"{'ab'[k]}{i}<{p}>{i}{'yz'[k]}" for i, p in enumerate(long) for k in range(2)]
    texts += [f"1{long[0][:250]}{word()}{long[1][:250]}é", f"2{'x' * 399}é", f"3{'x' * 399}è", None]
    rows = [(i, t, "en", "a", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    out = {r.doc_id: r for r in queries.op7_suffix_array_dedup(spark, str(tmp_path)).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts[:-3]):
        r, t = out[i], t or ""
        assert r.n_bytes == len(t.encode())
        inside = [p for p in short + long if p in t]
        if inside and len(inside[0].encode()) >= 400:
            before, after = t.split(inside[0])
            assert inside[0] not in r.text and r.n_removed >= len(inside[0].encode())
            assert len(before) + len(after) - 12 <= len(r.text) <= len(before) + len(after)
        else:
            assert r.text == t and r.n_removed == 0
        assert r.kept_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
    # the run ends inside é and è: its second byte stays in the digest, but is no text
    for i, b in ((-3, b"2\xa9"), (-2, b"3\xa8")):
        r = out[len(texts) + i]
        assert (r.text, r.n_removed, r.kept_sha256) == (b[:1].decode(), 400, hashlib.sha256(b).hexdigest())
    assert (out[len(texts) - 1].text, out[len(texts) - 1].n_bytes) == ("", 0)
