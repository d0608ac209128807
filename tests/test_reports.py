"""Reports, states as text, rendered questions, answers of a service."""

import json

import pytest
from pyspark.sql import functions as F

from decidra.functions import options as O
from decidra.operators import infer, validate
from decidra.sources import reports


def test_audit_report(spark):
    decisions = spark.createDataFrame([("b|c", 1, 3, 0, 1), ("a", 0, 5, 2, 0)], "suite string, suite_ord int, retain long, exclude long, quarantine long")
    text = reports.audit(decisions, spark.createDataFrame([("near_content", 7)], "kind string, n long"), "core", ["lexical only"])
    lines = text.splitlines()
    assert "Profile: `core`. Decisions: 11; retained: 8, excluded: 2, quarantined: 1." in lines
    at = lines.index("| Suite | Retain | Exclude | Quarantine |")
    assert lines[at + 1 : at + 5] == ["| --- | ---: | ---: | ---: |", "| a | 5 | 2 | 0 |", "| b\\|c | 3 | 0 | 1 |", "| all | 8 | 2 | 1 |"]
    assert "- lexical only" in lines


def test_suite_report(spark):
    schema = "suite string, completed long, attempted long, n_hard long, coverage double, accuracy double, nll double, brier double, all_attempted_accuracy double, score_mae double, score_rps double"
    metrics = spark.createDataFrame([("x", 9, 10, 8, 0.9, 0.5, None, 0.25, 0.45, None, None), ("y", 1, 1, 0, 1.0, None, None, None, None, 0.5, 0.125)], schema)
    text = reports.suites(metrics, spark.createDataFrame([("all", 2, 0.5)], "scope string, n_suites long, macro_accuracy double"), {"model": "m"})
    assert "| x | 9/10 | 8 | 0.9000 | 0.5000 | - | 0.2500 | 0.4500 |" in text and "| y | 0.5000 | 0.1250 |" in text and "| all | 2 | 0.5000 |" in text and '"model": "m"' in text
    with pytest.raises(ValueError):
        reports.suites(metrics, metrics.limit(0).withColumn("scope", F.col("suite")), {"x": float("nan")})


def test_comparison(spark):
    systems = spark.createDataFrame([("ours", "local rerun", 50.5, None), ("theirs", "published", 49.0, 0.25)], "system string, provenance string, index double, ece double")
    datasets = spark.createDataFrame([("d", "area", "ours", 0.5), ("d", "area", "theirs", 0.25), ("c", "zone", "ours", 1.0)], "dataset string, area string, system string, score double")
    text = reports.comparison(systems, datasets, {"draws": 3})
    assert text.index("### d (area)") < text.index("### c (zone)") and "| ours | local rerun | 50.500000 | - |" in text and "| theirs | 0.250000 |" in text


def test_states_read_like_python_s_json(spark):
    values = [{"a": [1, 2.5, "x, y: z"], "b": {"c": None, "é \" \\": True}}, [], {}, [[1], {"k": "\n\t"}], "12"]
    rows = spark.createDataFrame([(i, json.dumps(v, ensure_ascii=False, indent=i % 3 or None), json.dumps(v, ensure_ascii=False)) for i, v in enumerate(values)], "i int, s string, want string")
    for r in rows.select("want", O.state_text(F.col("s"), F.lit(False)).alias("got")).collect():
        assert r["got"] == r["want"]
    plain = spark.createDataFrame([("a,b:c  d",)], "s string")
    assert plain.select(O.state_text(F.col("s"), F.lit(True)).alias("t")).first()["t"] == "a,b:c  d"


def test_rendered_questions(spark):
    pair = "array<struct<key:string,desc:string>>"
    rows = [
        (0, "choice", [("a", None), ("b", None)], "s", [0.5, 0.5], None), (1, "choice", [("a", None)], "s", [1.0], "options"), (2, "choice", [("a", None), ("a", None)], "s", [0.5, 0.5], "options"), (3, "choice", [("a", None), ("b", None)], "has [MASK]", [0.5, 0.5], "masks"),
        (4, "choice", [("a", None), ("b", None)], "s", [0.5, 0.6], "target"), (5, "noul", [], "s", [0.25, 0.75], None), (6, "noul", [], "s", [1.0], "target"), (7, "choice", [("a", None), ("b", None)], "s", None, "target"),
    ]
    frame = spark.createDataFrame(rows, f"i int, qtype string, options {pair}, state string, target array<double>, want string")
    prompt = O.prompt(F.col("state"), F.lit("?"), F.col("qtype"), F.col("options"))
    for r in frame.select("i", "want", validate.rendered_reason(prompt, F.col("qtype"), F.col("options"), F.col("target")).alias("got")).collect():
        assert r["got"] == r["want"], r


def test_a_service_that_fails():
    good = json.dumps({"state": "s", "model": "default", "questions": {"q": {"type": "noul", "instructions": "?"}}})
    assert infer.http_response(good, lambda request: {"n": len(request["questions"])}) == (200, {"n": 1})
    assert infer.http_response(good, lambda request: 1 / 0) == (500, {"error": "ZeroDivisionError"})
    assert infer.http_response("{", lambda request: {}) == (400, {"error": "not JSON"})
    assert infer.http_response(good, lambda request: {}, limit=3)[0] == 413
