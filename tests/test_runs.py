"""Runs of a model: batches that stay whole, a log that survives a stop."""

import random

import pytest
from pyspark.sql import functions as F

from decidra.functions import options as O
from decidra.operators import infer, windows
from decidra.streaming import progress

MANIFEST = {"model": "hash", "limit": 9}


def asked(rows):
    return rows.select(F.col("id").cast("string").alias("id"), "suite", F.col("state"), F.lit("choice").alias("qtype"), O.from_list(F.array(F.lit("a"), F.lit("b"))).alias("options"), F.size(F.split("state", " ")).alias("n"))


class Counting:
    """Says with each answer how many inputs came with it."""

    def predict_batch(self, inputs):
        return [{"status": "ok", "length": len(inputs), "probs": [0.5, 0.5]} for _ in inputs]


@pytest.mark.parametrize("arrow_rows", [3, 10_000])
def test_batches_are_whole(spark, arrow_rows):
    rng = random.Random(2)
    rows = spark.createDataFrame([(i, rng.choice(["x", "y"]), " ".join("w" * rng.randint(1, 30))) for i in range(150)], "id long, suite string, state string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", arrow_rows)
    try:
        got = infer.collated(asked(rows), Counting, "n", 25, 60, 8).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    done = [r for r in got if r["status"] == "ok"]
    assert len(got) == 150 and all(r["length"] == r["batch_size"] for r in done)
    assert all(r["batch"] is None and r["length"] > 25 for r in got if r["status"] != "ok")
    want = {(r["suite"], r["id"]): r["batch"] for r in windows.token_batches(asked(rows).where("n <= 25"), "suite", "id", "n", 60, 8).collect()}
    assert {(r["suite"], r["id"]): r["batch"] for r in done} == want
    assert all(r["padded_tokens"] <= 60 for r in done)


@pytest.mark.parametrize("n_partitions", [1, 7])
def test_ranks(spark, n_partitions):
    rng = random.Random(n_partitions)
    rows = [(rng.choice(["a", "a", "a", None, "b"]), i, rng.random()) for i in range(300)]
    want = {i: sum(1 for s, _, y in rows if s == k and y < x) for k, i, x in rows}
    spark.conf.set("spark.sql.shuffle.partitions", n_partitions)
    try:
        got = windows.ranked(spark.createDataFrame(rows, "k string, i long, x double"), ["k"], ["x"], "at").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert {r["i"]: r["at"] for r in got} == want


@pytest.fixture
def source(spark, tmp_path):
    rows = spark.createDataFrame([(i, "s", "w " * (i % 12)) for i in range(60)], "id long, suite string, state string")
    rows.repartition(6).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = lambda: infer.predict(asked(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))), lambda: infer.WordScorer({}, 9))
    return stream, f"file://{tmp_path}/run"


def once(spark, root):
    ids = [r["id"] for r in progress.logged(spark, root, infer.PREDICTION).collect()]
    assert len(ids) == len(set(ids))
    return set(ids)


def test_a_stopped_run_goes_on(spark, source, monkeypatch):
    stream, root = source
    assert progress.status(spark, root)["status"] == "absent"
    finish = progress.finish_batch

    def dies(spark, root, line):
        if line["batch"] == 3:
            raise RuntimeError("lost")
        finish(spark, root, line)

    monkeypatch.setattr(progress, "finish_batch", dies)
    with pytest.raises(Exception, match="lost"):
        progress.run(stream(), root, MANIFEST)
    halted = progress.status(spark, root)
    # The rows of the batch that died are written, but don't count.
    assert halted["status"] == "failed" and "lost" in halted["error"] and halted["batches"] == 3
    assert len(once(spark, root)) == halted["attempted"] < 60

    monkeypatch.setattr(progress, "finish_batch", finish)
    with pytest.raises(progress.OtherRun):
        progress.run(stream(), root, MANIFEST | {"limit": 10})
    ended = progress.run(stream(), root, MANIFEST)
    assert ended["status"] == "complete" and (ended["batches"], ended["attempted"]) == (6, 60) and 0 < ended["ok"] < 60
    assert once(spark, root) == {str(i) for i in range(60)}
    with pytest.raises(progress.OtherRun):
        progress.run(stream(), root, MANIFEST)


def test_lines_without_commits_are_written_over(spark, source, monkeypatch):
    """The run dies after a batch's line and before its offsets are committed."""
    stream, root = source
    finish = progress.finish_batch

    def dies(spark, root, line):
        finish(spark, root, line)
        if line["batch"] == 2:
            raise RuntimeError("lost")

    monkeypatch.setattr(progress, "finish_batch", dies)
    with pytest.raises(Exception, match="lost"):
        progress.run(stream(), root, MANIFEST)
    monkeypatch.setattr(progress, "finish_batch", finish)
    assert progress.run(stream(), root, MANIFEST)["attempted"] == 60 and len(once(spark, root)) == 60
