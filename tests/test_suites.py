"""Raw layouts of suites, by hand-made files."""

import json

from pyspark.sql import functions as F

from decidra.sources import strict, suites


def by_id(rows):
    return {r["id"]: r for r in rows.collect()}


def lines(spark, records):
    return spark.createDataFrame([(json.dumps(r, ensure_ascii=False),) for r in records], "line_text string")


def test_jevbench(spark):
    q = {"type": "choice", "instructions": "Which?", "criteria": {"z": "last", "a": None, "m": ""}}
    base = {"id": "1", "split": "public", "family": "f", "state": {"k": [1, "x"]}, "question": q, "labels": ["a", "m", "z"], "expected": "a"}
    noul = {"type": "noul", "instructions": "?", "criteria": None}
    records = [
        base, base | {"id": "2", "split": "sealed"}, base | {"id": "3", "labels": ["a", "z"]}, base | {"id": "4", "expected": "b"},
        base | {"id": "5", "family": "probability", "expected": None, "group": "g", "provenance": {"gold_probs": {"a": 0.5, "m": 0.25, "z": 0.25}}},
        base | {"id": "6", "provenance": {"gold_probs": {"a": 0.5, "m": 0.25, "z": 0.25}}}, base | {"id": "7", "family": "probability", "provenance": {"gold_probs": {"a": 0.5, "z": 0.5}}},
        base | {"id": "8", "family": "probability", "provenance": {"gold_probs": {"a": 0.5, "m": 0.5, "z": 0.5}}}, base | {"id": "9", "expected": None},
        base | {"id": "10", "question": noul, "labels": ["yes", "no"], "expected": "yes", "state": "text"},
        base | {"id": "11", "question": {"type": "score", "instructions": "!", "criteria": ["low", "mid", "high"]}, "labels": ["0", "1", "2"], "expected": 2},
        base | {"id": "12", "question": {"type": "score", "instructions": "!", "criteria": ["low", "mid"]}, "labels": ["0", "1"], "expected": 2},
    ]
    got = by_id(suites.jevbench(lines(spark, records), "easy"))
    r = {k.rpartition("/")[2]: v for k, v in got.items()}
    assert [tuple(o) for o in r["1"]["options"]] == [("z", "last"), ("a", None), ("m", "")] and r["1"]["gold_idx"] == 1 and json.loads(r["1"]["state"]) == {"k": [1, "x"]}
    assert {k: v["reason"] for k, v in r.items()} == {
        "1": None, "2": "not_public", "3": "labels_differ", "4": "bad_expected", "5": None, "6": "unclassified_distribution", "7": "distribution_labels", "8": "distribution", "9": "no_target", "10": None, "11": None, "12": "hard_label",
    }
    assert r["5"]["soft"] == [0.25, 0.5, 0.25] and r["5"]["gold_idx"] is None and r["5"]["group_id"] == "jevbench_public_easy/g"
    assert r["10"]["gold_idx"] == 1 and r["10"]["option_ids"] == ["false", "true"] and r["11"]["gold_idx"] == 2


def test_jabr(spark):
    text = """
    [[task]]
    id = "t"
    type = "choice"
    question = { instructions = "Which?", criteria = { b = "second", a = "first" } }
    cases = [ { state = "s", expected = "a" }, { state = { x = 1 }, expected = "c" } ]
    [[task]]
    id = "n"
    type = "noul"
    question = { instructions = "Is it?" }
    cases = [ { state = "s", expected = true }, { state = "s", expected = false } ]
    [[task]]
    id = "l"
    type = "score"
    question = { instructions = "How?", criteria = ["lo", "hi"] }
    cases = [ { state = "s", expected = 1 }, { state = "s", expected = 2 } ]
    """
    got = by_id(suites.jabr(strict.toml_cases(spark, text)))
    assert [(k, r["gold_idx"], r["reason"]) for k, r in sorted(got.items())] == [
        ("jabr_v2/l/0", 1, None), ("jabr_v2/l/1", 2, "hard_label"), ("jabr_v2/n/0", 1, None), ("jabr_v2/n/1", 0, None), ("jabr_v2/t/0", 1, None), ("jabr_v2/t/1", None, "bad_expected"),
    ]
    assert got["jabr_v2/t/0"]["option_ids"] == ["b", "a"] and got["jabr_v2/t/0"]["instructions"] == "Which?"


def test_clinc(spark):
    rows = [("test", 0, "u", "z"), ("test", 1, "v", "a"), ("test", 2, "w", "z"), ("oos_test", 0, "x", "oos"), ("oos_test", 1, "y", "a"), ("train", 0, "q", "a"), ("test", 3, "r", "oos")]
    got = by_id(suites.clinc(spark.createDataFrame(rows, "split string, index int, text string, label string"), "c"))
    assert got["c/test/1"]["option_ids"] == ["z", "a", "oos"] and got["c/test/1"]["gold_idx"] == 1 and got["c/oos_test/0"]["gold_idx"] == 2
    assert got["c/test/0"]["options"][2]["desc"].endswith("2 supported intents.")
    assert {k: r["reason"] for k, r in got.items() if r["reason"]} == {"c/oos_test/1": "unknown_label", "c/train/0": "split", "c/test/3": "unknown_label"}


def test_nimble(spark):
    make = lambda i, kind, criteria, **reference: {"id": i, "family": "f", "domain": "d", "input": {"state": "s", "questions": {"decision": {"type": kind, "instructions": "?", "criteria": criteria}}}, "reference": reference}
    records = [make("1", "choice", {"e": None, "c": None}, target="c", distribution={"e": 0.4, "c": 0.6}, annotations=5), make("2", "choice", {"e": None, "c": None}, target="c", distribution={"e": 0.4, "c": 0.6}, annotations=4), make("3", "noul", None, target=True), make("4", "score", ["a", "b", "c"], target=1, expert_mean=2.4), make("5", "score", ["a", "b"], target=1)]
    got = {k[-1]: r for k, r in by_id(suites.nimble(lines(spark, records), "multinli")).items()}
    assert got["1"]["soft"] == [0.4, 0.6] and got["1"]["gold_idx"] == 1 and got["2"]["reason"] == "annotations" and got["3"]["gold_idx"] == 1
    assert abs(got["4"]["gold_score"] - 1.4) < 1e-12 and got["5"]["gold_score"] == 1.0 and got["4"]["group_id"] == "nimble/multinli/f"
    assert {r["reason"] for r in by_id(suites.nimble(lines(spark, records[:1]), "boolq")).values()} == {"unexpected_distribution"}


def test_contracts(spark):
    docs = spark.createDataFrame([(1, 'A "text"', [{"h1": "Entailment", "h2": "NotMentioned"}]), (2, "B", [{"h1": "Entailment"}]), (3, "C", []), (4, "D", [{"h1": "Maybe", "h2": "Contradiction"}])], "id long, text string, annotation_sets array<map<string,string>>")
    got = by_id(suites.contract_nli(docs, [("h1", "It is so."), ("h2", "It isn't.")]))
    assert len(got) == 8 and got["contractnli/test/1/h1"]["gold_idx"] == 0 and got["contractnli/test/1/h2"]["gold_idx"] == 2 and got["contractnli/test/4/h2"]["gold_idx"] == 1
    assert json.loads(got["contractnli/test/1/h1"]["state"]) == {"contract": 'A "text"', "hypothesis": "It is so."}
    assert {k[17:]: r["reason"] for k, r in got.items() if r["reason"]} == {"2/h1": "hypotheses", "2/h2": "hypotheses", "3/h1": "annotation_sets", "3/h2": "annotation_sets", "4/h1": "choice"}


def test_forecasts(spark):
    context = lambda i, q="On {resolution_date}?", frozen="2024-07-01T00": dict.fromkeys(suites.FORECAST_CONTEXT, "") | {"id": i, "question": q, "freeze_datetime": frozen}
    kind = "array<struct<id:string," + ",".join(f"{f}:string" for f in suites.FORECAST_CONTEXT) + ">>"
    questions = [("s", "a", ["2024-08-01", "2024-07-01"], [context("a")]), ("s", "b", None, [context("b")]), ("s", "c", None, [context("c", "Due {forecast_due_date}?")]), ("s", '["a","c"]', ["2024-08-01"], [context("a"), context("c", "x")]), ("s", "l", None, [context("l", "x", "2024-08-09")]), ("t", "a", None, [context("a", "x")]), ("t", "a", None, [context("a", "x")])]
    resolutions = [
        ("s", "a", None, "2024-08-01", True, 1.0), ("s", "a", None, "2024-07-01", True, 1.0), ("s", "b", None, "2024-08-01", True, 0.0), ("s", "c", None, "2024-08-01", True, 0.0), ("s", '["a","c"]', [1, -1], "2024-08-01", True, 1.0), ("s", '["a","c"]', [1, 0], "2024-08-01", True, 1.0),
        ("s", "l", None, "2024-08-01", True, 1.0), ("s", "zz", None, "2024-08-01", True, 1.0), ("t", "a", None, "2024-08-01", True, 1.0), ("s", "c", None, "2024-09-01", False, None), ("s", "c", None, "2024-09-02", True, 0.5), ("s", "c", None, "2024-09-03", True, 1.0), ("s", "c", None, "2024-09-03", True, 1.0), ("s", "c", [1], "2024-09-04", True, 1.0),
    ]
    rows = suites.forecastbench(spark.createDataFrame(questions, f"source string, id string, resolution_dates array<string>, contexts {kind}"), spark.createDataFrame(resolutions, "source string, id string, direction array<int>, resolution_date string, resolved boolean, resolved_to double"), "2024-07-21")
    tally = {}
    for r in rows.collect():
        tally.setdefault(r["reason"], []).append(r)
    assert {k: len(v) for k, v in tally.items()} == {None: 3, "horizon": 1, "unbound": 1, "direction": 2, "frozen_later": 1, "unknown_question": 1, "ambiguous_question": 1, "unresolved": 1, "target": 1, "repeated_resolution": 2}
    good = {r["group_id"].rpartition("/")[2]: r for r in tally[None]}
    assert set(good) == {"%22a%22", "%22c%22", "%5B%22a%22%2C%22c%22%5D"}
    single, due, both = (json.loads(good[k]["state"]) for k in ("%22a%22", "%22c%22", "%5B%22a%22%2C%22c%22%5D"))
    assert single["scheduled_resolution_date"] == "2024-08-01" and single["question_context"]["question"] == "On 2024-08-01?" and "id" not in single["question_context"]
    assert due["question_context"]["question"] == "Due 2024-07-21?" and "scheduled_resolution_date" not in due
    assert both["event"] == {"operator": "and", "required_component_answers": ["yes", "no"]} and [c["question"] for c in both["components"]] == ["On 2024-08-01?", "x"]


def test_legacy_cases(spark):
    asked = {f"q{i}": {"type": "noul", "instructions": "?"} for i in range(4)} | {"a0": {"type": "choice", "instructions": "!", "criteria": {"y": "Y", "x": "X"}}}
    gold = {f"q{i}": {"idx": i % 2, "soft": [0.25, 0.75]} for i in range(4)} | {"a0": {"idx": 1, "soft": [0.5, 0.5], "gold_score": None}}
    rows = [(7, "s7", json.dumps(asked), json.dumps(gold), "w"), (3, "s3", json.dumps(asked), json.dumps(gold), "w"), (9, "s9", json.dumps({"q": asked["q0"]}), json.dumps({"q": gold["q0"]}), "w"), (11, "s11", json.dumps(asked), json.dumps({"q0": gold["q0"]}), "w"), (12, "s12", json.dumps(asked), json.dumps(gold), " ")]
    got = by_id(suites.typed_decisions(spark.createDataFrame(rows, "n long, state string, questions string, gold string, workflow string"), "n"))
    assert len(got) == 21 and got["typed_decisions/0/a0"]["state"] == "s3" and got["typed_decisions/1/a0"]["option_ids"] == ["y", "x"] and got["typed_decisions/1/q3"]["gold_idx"] == 1
    assert {k.split("/")[1]: r["reason"] for k, r in got.items()} == {"0": None, "1": None, "2": "questions", "3": "gold", "4": "workflow"}


def test_breadth_ids_can_be_taken_apart(spark):
    names = ["plain", 'q"uote', "a/b,c]", "ü漢\U0001f600", "back\\slash", "", "\t\n"]
    rows = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string").withColumn("id", suites.pair_id(F.col("a"), F.col("b"))).withColumn("parts", suites.parts_of(F.col("id")))
    for r in rows.collect():
        assert r["id"] == json.dumps([r["a"], r["b"]], separators=(",", ":")) and r["parts"] == [r["a"], r["b"]]


def test_breadth(spark):
    asked = {"one": {"type": "choice", "instructions": "?", "criteria": {"b": None, "a": None}, "label": "a", "src": "s"}, "two": {"type": "noul", "instructions": "?", "label": True, "src": "s"}, "three": {"type": "score", "instructions": "?", "criteria": ["x", "y"], "label": "x", "src": "s"}, "four": {"type": "choice", "instructions": "?", "criteria": {"b": None, "a": None}, "label": "z", "src": "s"}}
    rows = spark.createDataFrame([(("r1", "g", "d", "clean"), "s", json.dumps(asked)), (("r2", "g", "d", "noisy"), "s", json.dumps({"one": asked["one"]}))], "meta struct<id:string,group_id:string,source:string,variant:string>, state string, questions string")
    got = by_id(suites.breadth(rows))
    assert {k: (r["gold_idx"], r["reason"]) for k, r in got.items()} == {'["r1","one"]': (1, None), '["r1","two"]': (1, None), '["r1","three"]': (None, "primitive"), '["r1","four"]': (None, "label"), '["r2","one"]': (1, "variant")}
