"""Rejected lines keep their file and number; stream batches are registered once."""

import os

import pytest
from pyspark.sql import functions as F

from sparkprep.operators import models
from sparkprep.session import scratch_path
from sparkprep.sources import catalog, io
from sparkprep.streaming.scoring import registered_rows, score_stream_registered


@pytest.fixture
def small_blocks(spark):
    """Files are split every few lines."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "120b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def written(folder, files):
    os.makedirs(folder)
    for name, lines in files.items():
        with open(f"{folder}/{name}", "w") as f:
            f.write("\n".join(lines) + "\n")


def test_json_rejects(spark, tmp_path, small_blocks):
    files = {"a.json": [f'{{"k":{i},"s":"v{i}"}}' for i in range(40)], "b.json": ['{"k":100,"s":null}'], "c.json": []}
    wrong = {("a.json", 3): "{broken", ("a.json", 17): '{"k":"text","s":"x"}', ("a.json", 40): "null", ("b.json", 2): "[1, 2"}
    for (name, line), text in wrong.items():
        files[name][line - 1:line] = [text]
    files["a.json"][29] = "   "
    written(tmp_path / "in", files)
    rows, rejects = io.read_with_rejects(spark, str(tmp_path / "in"), "jsonl", "k bigint, s string", str(tmp_path / "rejects"))
    assert {(os.path.basename(r.file), r.line): r.text for r in rejects.collect()} == wrong
    good = {i for i in range(40) if i + 1 not in (3, 17, 30, 40)} | {100}
    assert {r.k for r in rows.collect()} == good and rows.columns == ["k", "s"]
    lines = sum(len([x for x in v if x.strip()]) for v in files.values())
    assert rows.count() + rejects.count() == lines


def test_csv_rejects(spark, tmp_path, small_blocks):
    files = {"a.csv": ["k,x", *[f"{i},{i}.5" for i in range(30)]], "b.csv": ["k,x", "7,oops", "8,1.0"]}
    files["a.csv"][11] = "ten,1.5"
    written(tmp_path / "in", files)
    rows, rejects = io.read_with_rejects(spark, str(tmp_path / "in"), "csv", "k int, x double", header=True)
    assert {(os.path.basename(r.file), r.line, r.text) for r in rejects.collect()} == {("a.csv", 12, "ten,1.5"), ("b.csv", 2, "7,oops")}
    assert sorted(r.k for r in rows.collect()) == sorted([*[i for i in range(30) if i != 10], 8])
    with pytest.raises(ValueError, match="no rejects"):
        io.read_with_rejects(spark, str(tmp_path / "in"), "parquet", "k int")


def test_a_replayed_batch_adds_nothing(spark, sf_small, tmp_path):
    e = spark.read.parquet(f"{sf_small}/events.parquet").select("event_id", "user_id", "value")
    fitted = models.fit_pipeline(e, "value", "linear_regression", ["user_id"])
    path = fitted.save(scratch_path(spark, "model"))
    inbox, outbox, ckpt, cat = (str(tmp_path / n) for n in ("inbox", "outbox", "ckpt", "catalog"))
    e.repartition(3).write.parquet(inbox)

    def run():
        score_stream_registered(spark, path, inbox, e.schema, outbox, ckpt, cat, "events", ["event_id"], max_files_per_trigger=1).awaitTermination()

    def state():
        rows = registered_rows(spark, cat, "events")
        return rows.count(), rows.select("event_id").distinct().count(), catalog.list_datasets(spark, cat).count()
    run()
    assert state() == (e.count(), e.count(), 3)
    # the last batch's commit is lost: it runs again, over what it wrote and registered
    for name in ("2", ".2.crc"):
        os.remove(f"{ckpt}/commits/{name}")
    run()
    assert state() == (e.count(), e.count(), 3)
    # a folder that a broken attempt left unregistered is not read
    e.limit(5).select("event_id", F.lit(0.0).alias("prediction")).write.parquet(f"{outbox}/batch=99")
    assert state() == (e.count(), e.count(), 3)
    assert not catalog.is_registered(spark, cat, "events/batch-99") and not catalog.is_registered(spark, str(tmp_path / "none"), "x")
