import zipfile

import pytest
from pyspark.sql import functions as F

from decidra.operators import metrics
from decidra.sources import sinks, strict
from decidra.streaming import metrics as live

LINES = ['{"id":"a","x":1}', '{"id":"b","id":"c"}', '{"id":"d","x":NaN}', '{"id":"e","x":1e999}', "", "[1]", '{"id":"f","x":"1e999"}', '{"id":"a","x":2}', '{"x":3}']
REASONS = [None, "malformed_json", "malformed_json", "number_not_finite", "blank_line", "record_not_object", None, None, None]


@pytest.fixture
def lines(tmp_path):
    path = tmp_path / "in.jsonl"
    path.write_text("\n".join(LINES) + "\n")
    return str(path)


def test_reasons(spark, lines):
    rows = strict.json_lines(spark, lines, "id string, x string")
    assert {r["line_text"]: r["reason"] for r in rows.collect()} == dict(zip(LINES, REASONS, strict=True))
    later = {(r["line_text"], r["reason"]) for r in strict.quarantined(rows, "id").collect()}
    assert ('{"id":"a","x":2}', "duplicate_source_id") in later and ('{"x":3}', "missing_record_id") in later
    with pytest.raises(ValueError):
        strict.strict_json_lines(spark, lines, "id string")


def test_numbers_and_counts(spark, lines):
    numbered = {r["line"]: r["line_text"] for r in strict.numbered_lines(spark, lines).collect()}
    assert numbered == dict(enumerate(LINES, 1))
    assert tuple(strict.line_counts(spark, lines).select("lines", "bad").first()) == (9, 5)


def test_csv_keeps_quoted_breaks(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('text,category\n"a ""b""\nc",x\nd,y\n')
    rows = strict.csv(spark, str(path), "text string, category string").collect()
    assert [tuple(r) for r in rows] == [('a "b"\nc', "x"), ("d", "y")]


def test_zip_member(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/data.jsonl", '{"a":1}\n{"a":2}\n')
        z.writestr("d/readme.txt", "no")
    rows = strict.zip_lines(spark, str(tmp_path / "a.zip"), ".jsonl").orderBy("line").collect()
    assert [(r["line"], r["line_text"]) for r in rows] == [(1, '{"a":1}'), (2, '{"a":2}')]


def test_paths_stay_inside():
    assert strict.contained("/r/", "a/b") == "/r/a/b"
    for bad in ("/a", "../a", "a/../b", "", "a//b"):
        with pytest.raises(ValueError):
            strict.contained("/r", bad)


def test_profile_counts(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"id":"1"}\n{"id":"2"}\n')
    suites = [{"name": "s", "path": "s.jsonl", "expected_count": 2}]
    assert strict.profile(spark, str(tmp_path), suites, "id string").count() == 2
    with pytest.raises(ValueError):
        strict.profile(spark, str(tmp_path), [{**suites[0], "expected_count": 3}], "id string")


def test_written_rows_come_back(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    path = str(tmp_path / "out")
    rows.write.parquet(path)
    assert tuple(sinks.read_back(rows, path).first()) == (0, 0)
    sinks.json_lines(rows, str(tmp_path / "j"), ["i"])
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "j")).collect()) == ['{"i":1,"s":"a"}', '{"i":2,"s":null}']
    with pytest.raises(Exception):
        sinks.json_lines(rows, str(tmp_path / "j"), ["i"])
    sinks.publish(spark, lambda p: rows.write.parquet(p), str(tmp_path / "pub"))
    assert spark.read.parquet(str(tmp_path / "pub")).count() == 2
    with pytest.raises(FileExistsError):
        sinks.publish(spark, lambda p: rows.write.parquet(p), str(tmp_path / "pub"))
    sinks.document(spark, {"a": 1}, str(tmp_path / "d.json"))
    with pytest.raises(ValueError):
        sinks.document(spark, {"a": float("nan")}, str(tmp_path / "e.json"))


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame(
        [(i, i % 5, f"s{i % 2}", "choice", "ok", [0.2 + (i % 5) / 10, 0.8 - (i % 5) / 10], i % 2, None, None) for i in range(40)],
        "id long, group_id long, suite string, qtype string, status string, probs array<double>, gold_idx int, soft array<double>, gold_score double",
    )
    rows.repartition(4).write.parquet(str(tmp_path / "p"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "p"))
    query = live.running(stream, "suite").writeStream.format("memory").queryName("live").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    got = {r["suite"]: (r["n"], round(r["accuracy"], 9), round(r["nll"], 9)) for r in spark.table("live").collect()}
    want = metrics.scored(rows).groupBy("suite").agg(F.count("correct").alias("n"), F.avg(F.col("correct").cast("double")).alias("a"), F.avg("nll").alias("l")).collect()
    assert got == {r["suite"]: (r["n"], round(r["a"], 9), round(r["l"], 9)) for r in want}
