"""Manifests of hand-made files."""

import gzip
import hashlib
import json

import pytest

from decidra.sources import manifests


@pytest.fixture
def root(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/one.jsonl").write_text('{"x":1}\n{"x":2}\n')
    (tmp_path / "a/two words.csv").write_text('t,c\n"line\nbreak",1\nplain,2\n')
    with gzip.open(tmp_path / "three.jsonl.gz", "wt") as out:
        out.write("{}\n" * 7)
    return tmp_path


def entry(root, path, target, rows, kind=None, **other):
    kind = kind or path.removesuffix(".gz").rpartition(".")[2]
    file = root / path
    return {"path": path, "target": target, "format": kind, "compression": "gzip" if path.endswith(".gz") else "none", "bytes": file.stat().st_size if file.exists() else 1, "rows": rows, "copy_of": None} | other


def found(spark, root, entries):
    rows = manifests.problems(spark, f"file://{root}", spark.createDataFrame(entries, manifests.ENTRY))
    return sorted((r["target"], r["problem"]) for r in rows.collect())


def test_a_sound_manifest(spark, root):
    entries = [entry(root, "a/one.jsonl", "x/one.jsonl", 2), entry(root, "a/two words.csv", "two.csv", 2), entry(root, "three.jsonl.gz", "x/three.jsonl", 7)]
    entries.append({"path": None, "target": "x/copy.jsonl", "format": None, "compression": None, "bytes": None, "rows": None, "copy_of": "x/one.jsonl"})
    assert found(spark, root, entries) == []


def test_what_is_wrong(spark, root):
    entries = [
        entry(root, "a/one.jsonl", "x/one.jsonl", 3), entry(root, "a/two words.csv", "two.csv", 2, bytes=9), entry(root, "gone.jsonl", "gone.jsonl", 1), entry(root, "three.jsonl.gz", "three.csv", 7), entry(root, "../up.jsonl", "up.jsonl", 1),
        entry(root, "b.jsonl", "/abs.jsonl", -1), entry(root, "c.xml", "c.xml", 1), {"path": None, "target": "copy.jsonl", "format": None, "compression": None, "bytes": None, "rows": None, "copy_of": "nothing.jsonl"},
    ]
    assert found(spark, root, entries) == [("/abs.jsonl", "negative"), ("/abs.jsonl", "target"), ("c.xml", "format"), ("copy.jsonl", "copy_source"), ("gone.jsonl", "missing"), ("three.csv", "extension"), ("two.csv", "bytes"), ("up.jsonl", "path"), ("x/one.jsonl", "rows")]


def test_overlaps(spark):
    rows = spark.createDataFrame([("a/b.csv",), ("a/b.csv/c.csv",), ("a/bb.csv",), ("d.csv",), ("d.csv",), (None,)], "target string")
    assert sorted(map(tuple, manifests.overlapping(rows).collect())) == [("a/b.csv/c.csv", "a/b.csv"), ("d.csv", "d.csv")]


def test_a_frozen_partition(spark, tmp_path):
    records = [{"_meta": {"id": f"r{i % 5}", "source": "a" if i < 4 else "b"}, "questions": {"q": {}, "p": {}}} for i in range(6)]
    path = tmp_path / "test.jsonl"
    path.write_text("".join(json.dumps(r) + "\n" for r in records))
    spec = {"sha256": hashlib.sha256(path.read_bytes()).hexdigest(), "records": 6, "questions": 11, "by_source": {"a": 4, "c": 1}}
    got = {r["name"]: (r["expected"], r["found"], r["ok"]) for r in manifests.partition_report(spark, f"file://{path}", spec).collect()}
    assert got == {"sha256": (spec["sha256"],) * 2 + (True,), "records": ("6", "6", True), "questions": ("11", "12", False), "source:a": ("4", "4", True), "source:b": ("0", "2", False), "source:c": ("1", "0", False), "repeated_ids": ("0", "1", False)}
