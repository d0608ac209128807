import math
import random
from itertools import pairwise

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from decidra.functions import lang, mail, options, probs, rational, text
from decidra.operators import calibrate, components, dedup, joins, route, sampling, shortlist, spans, validate, windows
from decidra.operators import metrics as M


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()[0]


def test_softmax_is_shift_invariant_and_sums_to_one(spark):
    rows = spark.createDataFrame([([1.0, 2.0, 3.0],), ([1001.0, 1002.0, 1003.0],), ([0.0],)], "z array<double>")
    got = [r[0] for r in rows.select(probs.softmax(F.col("z"), 0.7)).collect()]
    assert all(abs(sum(p) - 1) < 1e-12 for p in got)
    assert max(abs(a - b) for a, b in zip(got[0], got[1], strict=True)) < 1e-9


def test_first_argmax_on_ties(spark):
    rows = spark.createDataFrame([([0.4, 0.4, 0.2],), ([0.1, 0.45, 0.45],)], "p array<double>")
    from decidra.functions.arrays import first_argmax

    assert [r[0] for r in rows.select(first_argmax(F.col("p"))).collect()] == [0, 1]


def test_score_functions(spark):
    rows = spark.createDataFrame([([0.2, 0.3, 0.5], [0.0, 0.0, 1.0])], "p array<double>, t array<double>")
    p, t = F.col("p"), F.col("t")
    got = rows.select(probs.rps(p, t), probs.normalized_rps(p, t), probs.brier(p, t), probs.kl(p, t), probs.confidence(p), probs.expected_level(p)).first()
    assert abs(got[0] - (0.04 + 0.25)) < 1e-12 and abs(got[1] - 0.145) < 1e-12 and abs(got[2] - (0.04 + 0.09 + 0.25)) < 1e-12
    assert abs(got[3] + math.log(0.5)) < 1e-12 and 0 < got[4] < 1 and abs(got[5] - 1.3) < 1e-12


def test_ece_bins(spark):
    rows = spark.createDataFrame([(0.0, True), (1 / 15, True), (1.0, False), (0.5, True)], "confidence double, correct boolean")
    right = M.ece(rows.withColumn("k", F.lit(1)), ["k"]).first()["ece"]
    left = M.ece(rows.withColumn("k", F.lit(1)), ["k"], closed="left").first()["ece"]
    assert abs(right - ((1 - 1 / 15) + 1 + 0.5) / 4) < 1e-12
    assert abs(left - (1 + (1 - 1 / 15) + 1 + 0.5) / 4) < 1e-12


def test_metrics_keep_unsupported_rows_in_the_denominator(spark):
    rows = spark.createDataFrame(
        [(1, 1, "a", "choice", "ok", [0.9, 0.1], 0, None, None), (2, 1, "a", "choice", "unsupported_length", None, 0, None, None)],
        "id long, group_id long, suite string, qtype string, status string, probs array<double>, gold_idx int, soft array<double>, gold_score double",
    )
    got = M.summarize(M.scored(rows)).first()
    assert got["accuracy"] == 1.0 and got["all_attempted_accuracy"] == 0.5 and got["coverage"] == 0.5


def greedy_batches(lengths, max_tokens, max_rows):
    out, i = [], 0
    while i < len(lengths):
        j = i + 1
        while j < len(lengths) and j - i < max_rows and lengths[j] * (j - i + 1) <= max_tokens:
            j += 1
        out.append(lengths[i:j])
        i = j
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=60), st.integers(5, 80), st.integers(1, 9))
def test_token_batches_are_those_of_the_greedy_pass(lengths, max_tokens, max_rows):
    lengths = sorted(lengths)
    counts = [("s", n, lengths.count(n)) for n in sorted(set(lengths))]
    got = {}
    for _, length, low, high, batch, each in windows.batch_runs(counts, max_tokens, max_rows):
        for r in range(low, high):
            got.setdefault(batch + (r - low) // each, []).append(length)
    assert [got[k] for k in sorted(got)] == greedy_batches(lengths, max_tokens, max_rows)


def test_components_and_propagation(spark):
    random.seed(3)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(40)] + list(pairwise(range(100, 130)))
    nodes = spark.createDataFrame([(i,) for i in range(140)], "n long")
    got = {r[0]: r[1] for r in components.components(nodes, spark.createDataFrame(edges, "a long, b long"), "n").collect()}
    parent = list(range(140))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in range(140)}
    rows = spark.createDataFrame([(1, "x", "retain"), (2, "x", "quarantine"), (3, "y", "retain"), (4, "z", "exclude"), (5, "z", "quarantine")], "i int, c string, d string")
    assert {r["i"]: r["decided"] for r in components.propagated(rows, "c", "d").collect()} == {1: "quarantine", 2: "quarantine", 3: "retain", 4: "exclude", 5: "exclude"}


def test_first_independent_is_the_sequential_pass(spark):
    random.seed(5)
    pairs = [(random.randrange(50), random.randrange(50)) for _ in range(80)]
    kept = []
    for i in range(50):
        if not any((i, j) in pairs or (j, i) in pairs for j in kept):
            kept.append(i)
    nodes = spark.createDataFrame([(i,) for i in range(50)], "n long")
    got = dedup.first_independent(nodes, spark.createDataFrame(pairs, "a long, b long"), "n", "n")
    assert sorted(r[0] for r in got.collect()) == kept


def test_conflicts_are_quarantined(spark):
    rows = spark.createDataFrame([(1, "a", 0), (2, "a", 0), (3, "b", 0), (4, "b", 1), (5, "c", None), (6, "c", 1)], "i int, k string, t int")
    got = {r["i"]: r["decision"] for r in dedup.conflict_decisions(rows, "k", ["i"], "t").collect()}
    assert got == {1: "retain", 2: "exclude", 3: "quarantine", 4: "quarantine", 5: "quarantine", 6: "quarantine"}


def test_splits_keep_groups_together_and_ignore_row_order(spark):
    rows = spark.range(600).select(F.col("id"), (F.col("id") % 90).alias("g"), F.when(F.col("id") % 90 < 50, "a").otherwise("b").alias("s"))
    first = sampling.grouped_split(rows, "g", "s", "1")
    assert first.groupBy("g").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    again = sampling.grouped_split(rows.orderBy(F.desc("id")).repartition(7), "g", "s", "1")
    assert first.exceptAll(again.select(*first.columns)).count() == 0
    sizes = {(r["s"], r["split"]): r["n"] for r in first.groupBy("s", "split").agg(F.count_distinct("g").alias("n")).collect()}
    assert sizes["a", "dev"] == 4 and sizes["a", "test"] == 4 and sizes["b", "dev"] == 3


def test_temperature_is_recovered(spark):
    random.seed(1)
    rows = []
    for i in range(3000):
        z = [random.gauss(0, 1) for _ in range(4)]
        w = [math.exp(x) for x in z]
        rows.append((f"s{i % 3}", [2.0 * x for x in z], random.choices(range(4), w)[0]))
    got = calibrate.fit_temperature(spark.createDataFrame(rows, "suite string, logits array<double>, gold_idx int"))
    assert abs(got["temperature"] - 2.0) < 0.2 and got["nll_after"] <= got["nll_before"]


def test_rational_solvers(spark):
    from fractions import Fraction

    rows = spark.createDataFrame([(5, 7, 3), (40, 38, 4), (2, 1, 3)], "red int, blue int, draws int")
    for r in rows.select("*", rational.without_replacement(F.col("red"), F.col("blue"), F.col("draws")).alias("p")).collect():
        for i, p in enumerate(r["p"]):
            ways = math.comb(r["red"], i) * (math.comb(r["blue"], r["draws"] - i) if r["draws"] - i <= r["blue"] else 0)
            assert Fraction(p["n"], p["d"]) == Fraction(ways, math.comb(r["red"] + r["blue"], r["draws"]))
    assert one(spark, rational.written(rational.fraction(F.lit(6).cast("long"), F.lit(8).cast("long")))) == "3/4"


def test_validation_names_what_failed(spark):
    rows = spark.createDataFrame(
        [("ok", 5, [0.5, 0.5], 0), ("ok", 5, [0.5, 0.5], 1), ("ok", 5, [0.6, 0.5], 0), ("ok", 5, [float("nan"), 0.5], 0), ("unsupported_length", 9000, None, None), ("other", 1, None, None)],
        "status string, length int, probs array<double>, pred_idx int",
    )
    got = [r["e"] for r in rows.select(validate.failed(validate.prediction_checks()).alias("e")).collect()]
    assert got[0] == [] and got[1] == ["pred_idx"] and got[2] == ["probs"] and "probs" in got[3] and got[4] == [] and "status" in got[5]


def test_languages(spark):
    cases = {
        "the cat is on the mat and it was good": ("latin", "en", True), "le chat est dans la maison avec nous et vous": ("latin", "fr", False), "Это русский текст": ("cyrillic", None, False),
        "1234 !!": ("unknown", None, True), "ża łóć gęś ją kość": ("latin", None, False), "hello world": ("latin", None, True),
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", lang.analysis(F.col("t")).alias("a"))
    assert {r["t"]: (r["a"]["script"], r["a"]["language"], r["a"]["is_english"]) for r in rows.collect()} == cases


def test_mail(spark):
    body = "Hi,\n\nplease send it.\nThis mail is confidential. Call me.\n\nBest regards,\nAnn\n\nOn Monday Bob wrote:\n> old\n> older"
    assert one(spark, mail.clean_body(F.col("b")), b=body) == "Hi,\n\nplease send it.\nThis mail is confidential. Call me.".replace("please send it.\nThis mail is confidential. Call me.", "please send it. Call me.")


def test_routes(spark):
    none = F.lit(None).cast("string")
    flow = F.array(*[F.lit(x) for x in ("urgency", "severity", "disposition", "true_positive", "credential_compromise")])
    assert one(spark, route.workflow(flow)) == "security_incidents"
    assert one(spark, route.decision(F.lit("Привет"), flow, none, none, none)["model"]) == "multilingual"
    assert one(spark, route.decision(F.lit("Привет"), flow, none, none, F.lit("en-US"))["model"]) == "english"
    assert one(spark, route.decision(F.lit("x"), flow, F.lit("ML"), none, F.lit("en"))["model"]) == "multilingual"
    assert one(spark, route.decision(F.lit("the"), flow, none, none, none, by_workflow=True)["model"]) == "typed-decisions"


def test_text_functions(spark):
    assert one(spark, text.normal(F.col("t")), t="  Große\t STRASSE \n") == "grosse strasse"
    assert one(spark, text.normal_exact(F.col("t")), t="ﬁne  Ⅳ") == "fine iv"
    assert one(spark, text.shingles(F.col("t"), 3), t=["a", "b"]) == []
    assert sorted(one(spark, text.shingles(F.col("t"), 2), t=["a", "b", "a", "b"])) == ["a b", "b a"]
    assert one(spark, text.quoted(F.col("t")), t="a b/c") == "a%20b%2Fc"
    assert one(spark, text.leaves(F.col("t")), t='{"b": ["x", 1], "a": "y"}') == ["y", "x", "1"]


def test_option_order_is_kept(spark):
    rows = spark.createDataFrame([("choice", [("z", "last"), ("a", None), ("m", "")])], "q string, o array<struct<key:string,desc:string>>")
    assert rows.select(options.rendered(F.col("q"), F.col("o"))).first()[0] == ["z: last", "a", "m"]
    shuffled = [r[0] for r in rows.select(F.transform(options.shuffled(F.col("o"), F.lit("s")), lambda x: x["key"])).collect()]
    assert sorted(shuffled[0]) == ["a", "m", "z"]


def test_shortlist_passes_all_options_through(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0], 0), ("b", [0.0, 0.0], 1), ("c", [0.6, 0.8], 2)], "o string, vector array<double>, pos int")
    queries = spark.createDataFrame([(1, [1.0, float("nan")])], "q int, vector array<double>")
    assert [r["o"] for r in shortlist.top_k(queries, vectors, "q", "o", 5).orderBy("rank").collect()] == ["a", "b", "c"]
    top = shortlist.top_k(queries, vectors, "q", "o", 2).orderBy("rank").collect()
    assert [(r["o"], round(r["score"], 6)) for r in top] == [("a", 1.0), ("c", 0.6)]


def test_spans():
    state = {"document": "Title: one two three four\nlabels: a b c d\nbody: now\n\nfive six seven", "options": "not this one here"}
    found = {s[0]: s[1] for s in spans.spans_of(state)}
    assert "not this one here" not in found.values() and "a b c d" not in " ".join(found.values())
    assert "five six seven" in found.values() and any(p.startswith("state:content") for p in found)


def test_set_checks(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert {(r["k"], r["problem"]) for r in joins.missing_foreign(a, b, "k").collect()} == {(1, "missing"), (3, "foreign")}
    assert tuple(joins.same_rows(a, b).first()) == (2, 1)


def test_td_targets_with_decay(spark):
    rows = spark.createDataFrame([(1, 1, 0.2, 0.0), (1, 2, 0.6, 0.0), (1, 3, 0.9, 1.0)], "e int, s int, p double, y double")
    got = {r["s"]: r["td_target"] for r in windows.td_targets(rows, "e", "s", "p", "y", 0.5).collect()}
    assert got[3] == 1.0 and abs(got[2] - 0.95) < 1e-12 and abs(got[1] - (0.5 * 0.6 + 0.5 * 0.95)) < 1e-12


def test_states_lie_flat():
    from decidra.functions import states

    value = {"b": [1, True, None, {"z": "last", "a": "x"}], "a": "one two three four five six seven eight", "e": {}, "f": []}
    assert states.flat("t") == [((), "t")] and states.flat({}) == []
    assert states.leaf_texts(value) == ["one two three four five six seven eight", "1", "true", "x", "last"]
    assert states.units(value) == ["one two three four five six seven eight 1 true x last", "one two three four five six seven eight"]
    assert states.units("short") == ["short"] and states.units({}) == []
    assert states.compact({"B": " X  y", "a": ["ß"]}, states.folded) == '{"B":"x y","a":["ss"]}'
    deep = "v"
    for _ in range(400):
        deep = [{"k": deep}]
    assert states.leaf_texts(deep) == ["v"]


def test_hidden_sections():
    from decidra.operators import spans

    text = "before it\nTask: do this now please\nmore of the task\nFacts: one two three\n\nfour five six\nLabel:\nhidden words in here"
    assert spans.sections(text) == [("unlabelled", 1, ["before it"]), ("4:Facts", 4, ["one two three", "", "four five six"])]
    found = [(p, t) for p, t, *_ in spans.spans_of({"document": text, "rules": "never seen at all"})]
    assert [p for p, _ in found] == ["state:content", "state.document:line:4", "state.document:line:6", "state.document:section:4:Facts", "state.document:paragraph:1"]


def test_exact_normal_form(spark, tmp_path):
    from decidra.functions import states
    from decidra.plans import catalog

    texts = ["Ａﬁ ß", "plain Text ", "İstanbul ΌΣΟΣ ς", None, "", "x\u2003y ① ½"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r[0]: r[1] for r in catalog.QUERIES["text_normalize_exact"](spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else states.folded(t) for i, t in enumerate(texts)}


def test_texts_that_pass_as_plain_have_their_full_normal_form(spark):
    """Each character alone and between letters, which decides about a final sigma; long texts are gone through without recursion."""
    from decidra.functions import states
    from decidra.functions import text as T

    chars = [chr(c) for c in range(0x20, 0x2030) if not 0xD800 <= c < 0xE000]
    texts = [f"{c} a{c}b{c} Σ".replace("Σ", "" if i % 2 else "z") for i, c in enumerate(chars)] + ["wait…", "ΟΔΟΣ", "Ǆ ĳ ŀ", "e\u0301", "х\u0483", "straße Öl Привет", "aÄя‐" * 50_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.needs_exact(T.F.col("t")).alias("needs"), T.normal(T.F.col("t")).alias("n")).collect()
    assert [texts[r.i] for r in rows if not r.needs and r.n != states.folded(texts[r.i])] == []
    assert {r.i - len(chars) for r in rows if r.needs and r.i >= len(chars)} == {0, 1, 2, 3, 4}
    assert not any(r.needs for r in rows if texts[r.i].isascii())


def test_near_pairs_are_those_of_brute_force(spark):
    import random

    from decidra.operators import similarity

    rng = random.Random(3)
    base = [[f"w{rng.randrange(40)}" for _ in range(rng.choice([12, 20, 40]))] for _ in range(12)]
    common = [f"c{i}" for i in range(15)]

    def varied(t):
        t = list(t)
        for _ in range(rng.randrange(3)):
            t[rng.randrange(len(t))] = "x"
        return (common if rng.random() < 0.5 else []) + t + (t if rng.random() < 0.2 else [])

    left = [(i, varied(rng.choice(base))) for i in range(40)] + [(90, []), (91, common)]
    right = [(i, varied(rng.choice(base))) for i in range(70)] + [(92, common)]
    cut = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)} if len(t) >= 12 else set()
    wanted = set()
    for i, t in left:
        for j, u in right:
            a, b = cut(t), cut(u)
            if a and b:
                c = len(a & b)
                if c / len(a | b) >= 0.8 or (c / min(len(a), len(b)) >= 0.9 and len(set(t) & set(u)) >= 12):
                    wanted.add((i, j))
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, tokens array<string>")
    for a, b in ((left, right), (right, left)):
        got = {tuple(r) for r in similarity.near_pairs(frame(a, "p"), frame(b, "q"), "p", "q").select("p", "q").collect()}
        assert got == (wanted if a is left else {(j, i) for i, j in wanted})
    assert wanted


def test_only_shared_shingles_of_the_larger_side_are_written(spark, monkeypatch):
    from decidra.operators import similarity

    kept = {}
    monkeypatch.setattr(similarity, "stored", lambda df, name, real=similarity.stored: kept.setdefault(name, []).append(out := real(df, name)) or out)
    few = spark.createDataFrame([(0, [f"w{i}" for i in range(30)]), (1, ["short"])], "p long, tokens array<string>")
    many = spark.createDataFrame([(i, [f"w{j}" if i < 2 else f"x{i}_{j}" for j in range(30)] + [f"y{j}" for j in range(i)]) for i in range(9)], "q long, tokens array<string>")
    for left, right in ((few, many), (many, few)):
        kept.clear()
        found = similarity.near_pairs(left, right, *left.columns[:1], *right.columns[:1]).select("p", "q", "jaccard").collect()
        assert sorted(map(tuple, found)) == [(0, 0, 1.0), (0, 1, 26 / 27)]
        assert sorted((r["q"], r["n"], len(r["s"])) for t in kept["sets"] if "q" in t.columns for r in t.collect()) == [(0, 26, 26), (1, 27, 26)]


def test_words_are_those_of_the_normal_form(spark):
    from decidra.functions import text as T

    texts = ["Straße\u2003A_b\x1c\x85c-d", " \tÀ\x0bB ", "", None, "e\u0301 1½ x\u00a0Y"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.words(T.F.col("t")).alias("w"), T.F.regexp_extract_all(T.normal(T.F.col("t")), T.F.lit(T.WORD), T.F.lit(0)).alias("v"))
    assert [r.w for r in rows.collect()] == [r.v for r in rows.collect()]


def test_spans_of_few_texts_are_held_at_once(spark, monkeypatch):
    from decidra.operators import spans

    monkeypatch.setattr(spans, "TEXTS", 2)
    rows = [(i, None if i == 3 else f"one two three four {i}\nfive six seven {i}\n\neight nine ten") for i in range(7)]
    frame = spark.createDataFrame(rows, "id long, state string").coalesce(1)
    got = spans.with_spans(frame, "id", "state").select("id", "field", "normalized").collect()
    assert [(r.id, r.field, r.normalized) for r in got] == [(i, s[0], s[2]) for i, t in rows if t for s in spans.spans_of(t)]


def test_evidence_cuts_only_exposures_that_share_words(spark, monkeypatch):
    """With and without the runs of words the evidence is the same; spans of other exposures aren't written."""
    import json
    import random

    from decidra.operators import audit

    rng = random.Random(8)
    base = [[f"w{rng.randrange(60)}" for _ in range(rng.choice([3, 4, 14, 30]))] for _ in range(14)]
    rows = [(str(i), " ".join(t)) for i, t in enumerate(base)] + [("90", "alpha beta gamma"), ("91", json.dumps({"a": "One two, three four", "b": " ".join(base[5])}))]
    apart = [(f"z{i}", "\n".join(" ".join(f"q{rng.randrange(99)}" for _ in range(9)) for _ in range(4))) for i in range(20)]
    mixed = [(str(i), "\n".join([" ".join(rng.choice(base)).upper(), "Note: " + " ".join(rng.choice(base)[:-1] + ["x"]), "", "q1 q2 q3"])) for i in range(30)]
    more = [("e1", "ALPHA\u00a0beta gamma\nother words here"), ("e2", json.dumps({"x": ["one two, three four"], "policy": " ".join(base[3])})), ("e3", None), ("e4", "alpha beta"), ("e5", rows[-1][1])]
    frame = lambda r, key: spark.createDataFrame(r, f"{key} string, state string").selectExpr("*", "cast(null AS string) AS raw", "lower(state) AS state_key")
    kept = []
    monkeypatch.setattr(audit, "stored", lambda df, name, real=audit.stored: kept.append(out := real(df, name)) or out)
    found = []
    for most in (audit.MOST_RUNS, 0):
        monkeypatch.setattr(audit, "MOST_RUNS", most)
        found.append(sorted(map(tuple, audit.evidence(frame(rows, "id"), frame(apart + mixed + more, "exposure"))[0].fillna(0).collect())))
    assert found[0] == found[1] and {r[2] for r in found[0]} == {"exact_whole_state", "exact_content", "near_content"}
    owners = [{r["exposure"] for r in t.select("exposure").collect()} for t in kept if "exposure" in t.columns]
    assert not any(e.startswith("z") for e in owners[0]) and any(e.startswith("z") for e in owners[1])
