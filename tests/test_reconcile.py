"""Nested values: against a plain walk over parsed JSON."""

import json
import random

from decidra.operators import reconcile


def walk(value, path="$"):
    if isinstance(value, dict):
        yield path, "object", json.dumps(list(value), ensure_ascii=False, separators=(",", ":"))
        for k, v in value.items():
            quoted = k.replace("\\", "\\\\").replace('"', '\\"')
            yield from walk(v, f"{path}.{k}" if k.isascii() and k.replace("_", "a").isalnum() else f'{path}."{quoted}"')
    elif isinstance(value, list):
        yield path, "array", str(len(value))
        for i, v in enumerate(value):
            yield from walk(v, f"{path}[{i}]")
    elif isinstance(value, bool):
        yield path, "boolean", str(value).lower()
    elif value is None:
        yield path, "null", None
    elif isinstance(value, str):
        yield path, "string", value
    else:
        yield path, "int" if isinstance(value, int) else "float", str(value)


def made(rng, depth=0):
    kind = rng.randint(0, 8 if depth < 4 else 6)
    if kind == 7:
        return {rng.choice(["a", "b_1", "odd key", 'q"uote', "", "ü", "x.y"]): made(rng, depth + 1) for _ in range(rng.randint(0, 4))}
    if kind == 8:
        return [made(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return [None, True, 7, -3.5, "text", "12", "{}"][kind]


def test_leaves_equal_a_plain_walk(spark):
    rng = random.Random(5)
    values = [(i, made(rng, 0 if i % 3 else -2)) for i in range(150)] + [(998, 12345678901234567890123), (999, {"deep": [[[[{"x": [1, 1.5]}]]]]})]
    rows = spark.createDataFrame([(i, json.dumps(v, ensure_ascii=bool(i % 2))) for i, v in values] + [(1000, None), (1001, "{bad"), (1002, '{"a":1,"a":2}'), (1003, "")], "id long, j string")
    got = sorted(tuple(r) for r in reconcile.leaves(rows, "id", "j").collect() if r["id"] < 1000)
    want = sorted(((i, *node) for i, v in values for node in walk(v)))
    assert [tuple(map(str, g)) for g in got] == [tuple(map(str, w)) for w in want]
    bad = {r["id"]: r["kind"] for r in reconcile.leaves(rows, "id", "j").where("id >= 1000").collect()}
    assert bad[1001] == bad[1002] == "invalid" and 1000 not in bad


def test_differences(spark):
    pairs = [
        (1, '{"a":1,"b":[1,2]}', '{ "a": 1, "b": [1, 2] }', []),
        (2, '{"a":1,"b":2}', '{"b":2,"a":1}', [("$", "keys_differ")]),
        (3, '{"a":1}', '{"a":1.0}', [("$.a", "kind_differs")]),
        (4, "[1,2]", "[1,2,3]", [("$", "size_differs"), ("$[2]", "missing")]),
        (5, "null", None, [("$", "extra")]),
        (6, None, None, []),
        (7, '{"a":null}', '{"a":null}', []),
        (8, '{"a":{"x":"1"}}', '{"a":{"x":"2"}}', [("$.a.x", "value_differs")]),
        (9, "1e2", "100.0", []),
        (10, "{bad", "{bad", []),
    ]
    ours = spark.createDataFrame([p[:2] for p in pairs] + [(50, "1")], "id long, j string")
    theirs = spark.createDataFrame([(p[0], p[2]) for p in pairs] + [(51, "1")], "id long, j string")
    got = sorted((r["id"], r["path"], r["problem"]) for r in reconcile.differences(ours, theirs, "id", ["j"]).collect())
    assert got == sorted((p[0], *w) for p in pairs for w in p[3])


def test_no_rows(spark):
    none = spark.createDataFrame([], "id long, j string")
    assert reconcile.differences(none, none, "id", ["j"]).count() == 0


def counted(monkeypatch):
    """Rows of every written table, by name."""
    found, write = [], reconcile.stored
    monkeypatch.setattr(reconcile, "stored", lambda rows, name: (done := write(rows, name), found.append((name, done.count())))[0])
    return found


def test_what_agrees_is_not_taken_apart(spark, monkeypatch):
    found = counted(monkeypatch)
    ours, theirs = ([{"same": list(range(1000)), "deep": [{"x": i, "y": [i]} for i in range(1000)]} for _ in range(2)] for _ in range(2))
    theirs[0]["deep"][7]["y"] = [8]
    rows = [spark.createDataFrame([(i, json.dumps(v, indent=n)) for i, v in enumerate(side)], "id long, j string") for n, side in ((None, ours), (1, theirs))]
    got = reconcile.differences(*rows, "id", ["j"]).collect()
    assert [tuple(r) for r in got] == [(0, "j", "$.deep[7].y[0]", "value_differs", "7", "8")]
    assert sum(n for name, n in found if name == "level") < 20, found


def test_differences_equal_two_plain_walks(spark):
    rng = random.Random(9)

    def changed(v):
        if rng.random() < 0.25:
            return made(rng, 2)
        if isinstance(v, dict):
            items = [(k, changed(x)) for k, x in v.items() if rng.random() < 0.9]
            return dict(items[::-1] if rng.random() < 0.2 else items)
        return [changed(x) for x in v if rng.random() < 0.9] if isinstance(v, list) else v

    odd = ["null", "true", "12", "n", "sx", "", 's"q\\', "{}", "[1]", " \n\t", "a: \"b\", \\\"c\\\\", "😀", None, True, 12, -0.5, 1e300, [], {}, {"": ""}, {"s": "s"}, {"null": None}, [None]]
    pairs = [(a, b) for a in odd for b in odd] + [({"k": a, "l": [a]}, {"k": b, "l": [b]}) for a in odd for b in odd]
    pairs += [(v, changed(v)) for v in ([made(rng, -3), made(rng, -3)] for _ in range(150))]
    texts = [(i, json.dumps(a, ensure_ascii=bool(i % 2)), json.dumps(b, ensure_ascii=bool(i % 3), indent=1 if i % 5 == 0 else None)) for i, (a, b) in enumerate(pairs)]
    rows = spark.createDataFrame(texts, "id long, a string, b string").repartition(4)
    got = reconcile.differences(rows.selectExpr("id", "a AS j"), rows.selectExpr("id", "b AS j"), "id", ["j"]).collect()

    def want(a, b):
        x, y = ({n[0]: n[1:] for n in walk(v)} for v in (a, b))
        for path in x.keys() | y.keys():
            (ka, va), (kb, vb) = x.get(path, (None, None)), y.get(path, (None, None))
            va, vb = (float(v) if k == "float" else v for k, v in ((ka, va), (kb, vb)))
            if ka != kb:
                yield path, "missing" if ka is None else "extra" if kb is None else "kind_differs", va, vb
            elif va != vb:
                yield path, {"object": "keys_differ", "array": "size_differs"}.get(ka, "value_differs"), va, vb

    number = lambda v: v if v is None or isinstance(v, float) else float(v) if any(c.isdigit() for c in v) and set(v) <= set("0123456789.eE+-") else v
    assert sorted(((r["id"], r["path"], r["problem"], number(r["ours"]), number(r["theirs"])) for r in got), key=repr) == sorted(
        ((i, p, w, number(x), number(y)) for i, (a, b) in enumerate(pairs) for p, w, x, y in want(a, b)), key=repr)


def test_long_strings_and_wide_values(spark):
    long = "\\\"\n" * 200_000
    a = {"t": long, "wide": {f"k{i}": i for i in range(20_000)}, "list": list(range(20_000))}
    b = {"list": [*range(19_999)], "wide": {f"k{i}": i + (i == 5) for i in reversed(range(20_000))}, "t": long + "."}
    one = lambda v: spark.createDataFrame([(1, json.dumps(v))], "id long, j string")
    got = {(r["path"], r["problem"]) for r in reconcile.differences(one(a), one(b), "id", ["j"]).collect()}
    assert got == {("$", "keys_differ"), ("$.t", "value_differs"), ("$.wide", "keys_differ"), ("$.wide.k5", "value_differs"), ("$.list", "size_differs"), ("$.list[19999]", "extra")}


def test_reconciled_walks_all_checks_at_once(spark, monkeypatch):
    found = counted(monkeypatch)
    made_of = lambda rows, names: spark.createDataFrame(rows, f"id long, {names}")
    original = made_of([(i, '{"a":[1,{"b":2}]}', "[1]", '["x", "y"]') for i in range(8)], "s string, t string, o string")
    retained = made_of([(i, '{"a":[1,{"b":3}]}' if i in (1, 2) else '{"a": [1, {"b":2}]}', "[1.0]" if i in (2, 3) else "[1]") for i in (*range(7), 100)], "s string, t string")
    run = made_of([(i, '["y","x"]' if i in (3, 4) else None if i == 5 else '["x","y"]') for i in (0, 1, 2, 3, 4, 5, 7, 100, 200)], "o string")
    checks = [("input", "retained", ["s"]), ("target", "retained", ["t"]), ("artifact", "run", ["o"])]
    got = {r["id"]: r["reason"] for r in reconcile.reconciled(retained, original, run, "id", checks).collect()}
    assert got == {0: None, 1: "input", 2: "input", 3: "target", 4: "artifact", 5: "artifact", 6: "missing_prediction", 100: "unknown_id", 200: "foreign_prediction"}
    assert len(found) <= 5, found


def test_text_without_an_end_is_gone_through_once(spark):
    """An unclosed string of many escapes took the square of its length when each quote was tried anew."""
    bad = '"' + '\\"' * 400_000
    one = lambda v: spark.createDataFrame([(1, v)], "id long, j string")
    got = reconcile.differences(one(bad), one(bad + "\\"), "id", ["j"]).first()
    assert (got["problem"], got["ours"]) == ("value_differs", bad)
