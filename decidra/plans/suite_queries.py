"""Queries over raw layouts of suites, made of whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import suites
from .common import register, table

DUE = "1996-01-01"


def _named(*pairs):
    return F.struct(*[c.alias(n) for n, c in pairs])


@register("""WITH r AS (SELECT o_orderkey AS i, o_orderstatus AS st, o_orderkey % 4 = 0 AS prob FROM orders),
x AS (SELECT *, CASE WHEN i % 23 = 5 THEN 'X' WHEN prob AND i % 8 = 0 THEN NULL ELSE st END AS expected, prob OR i % 29 = 7 AS has FROM r)
SELECT 'jevbench_public_hard/' || i AS id, 'jevbench_public_hard/' || CASE WHEN i % 5 = 0 THEN 'g' || (i // 100) ELSE i::VARCHAR END AS group_id, 'F,O,P' AS option_ids, list_position(['F', 'O', 'P'], nullif(expected, 'X')) - 1 AS gold_idx,
CASE WHEN has THEN CASE WHEN i % 37 = 4 THEN '0.5,0.5,0.25' ELSE '0.5,0.25,0.25' END END AS soft,
CASE WHEN i % 31 = 3 THEN 'not_public' WHEN i % 17 = 2 THEN 'labels_differ' WHEN expected = 'X' THEN 'bad_expected' WHEN has AND NOT prob THEN 'unclassified_distribution' WHEN has AND i % 37 = 4 THEN 'distribution' END AS reason FROM x""")
def suite_jevbench(spark, d):
    i = F.col("o_orderkey")
    prob = i % 4 == 0
    probs = _named(("P", F.lit(0.25)), ("F", F.lit(0.5)), ("O", F.when(i % 37 == 4, 0.5).otherwise(0.25)))
    record = _named(
        ("id", i.cast("string")), ("split", F.when(i % 31 == 3, "sealed").otherwise("public")), ("family", F.when(prob, "probability").otherwise(F.col("o_orderpriority"))), ("state", _named(("customer", F.col("o_custkey")))),
        ("question", _named(("type", F.lit("choice")), ("instructions", F.lit("Which status?")), ("criteria", F.create_map(F.lit("F"), F.lit("final"), F.lit("O"), F.lit("open"), F.lit("P"), F.lit("partial"))))),
        ("labels", F.when(i % 17 == 2, F.array(F.lit("O"), F.lit("F"))).otherwise(F.array(F.lit("P"), F.lit("O"), F.lit("F")))), ("expected", F.when(i % 23 == 5, "X").when(prob & (i % 8 == 0), None).otherwise(F.col("o_orderstatus"))),
        ("group", F.when(i % 5 == 0, F.concat(F.lit("g"), F.floor(i / 100).cast("string")))), ("provenance", F.when(prob | (i % 29 == 7), _named(("gold_probs", probs)))),
    )
    found = suites.jevbench(table(spark, d, "orders").select(F.to_json(record).alias("line_text")), "hard")
    return found.select("id", "group_id", F.array_join("option_ids", ",").alias("option_ids"), "gold_idx", F.array_join(F.transform("soft", lambda x: x.cast("string")), ",").alias("soft"), "reason")


@register("""WITH f AS (SELECT n_name AS label, min(c_custkey) AS first FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal >= 0 GROUP BY 1), o AS (SELECT label, row_number() OVER (ORDER BY first) - 1 AS place, count(*) OVER () AS n FROM f),
r AS (SELECT c_custkey AS i, c_acctbal >= 0 AS inside, CASE WHEN c_acctbal >= 0 OR c_custkey % 19 = 3 THEN n_name ELSE 'oos' END AS label FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT 'c/' || CASE WHEN inside THEN 'test' ELSE 'oos_test' END || '/' || i AS id, CASE WHEN r.label = 'oos' THEN (SELECT max(n) FROM o) ELSE place END AS gold_idx, CASE WHEN NOT inside AND r.label <> 'oos' THEN 'unknown_label' END AS reason FROM r LEFT JOIN o ON o.label = r.label""")
def suite_clinc(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    inside = F.col("c_acctbal") >= 0
    label = F.when(inside | (F.col("c_custkey") % 19 == 3), F.col("n_name")).otherwise("oos")
    raw = rows.select(F.when(inside, "test").otherwise("oos_test").alias("split"), F.col("c_custkey").alias("index"), F.col("c_name").alias("text"), label.alias("label"))
    return suites.clinc(raw, "c").select("id", F.col("gold_idx").cast("long").alias("gold_idx"), "reason")


_HYPOTHESES = [("h1", "The text is long."), ("h2", "The text is short."), ("h3", "The text says nothing.")]


@register("""WITH h AS (SELECT doc_id, n_chars, unnest([1, 2, 3]) AS k FROM documents)
SELECT 'contractnli/test/' || doc_id || '/h' || k AS id, 'contractnli/test/' || doc_id AS group_id,
CASE WHEN doc_id % 31 = 4 OR (doc_id % 29 = 5 AND k = 3) OR (doc_id % 23 = 6 AND k = 1) THEN NULL ELSE CASE k WHEN 1 THEN CASE WHEN n_chars > 1000 THEN 0 ELSE 1 END WHEN 2 THEN CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END ELSE 2 END END AS gold_idx,
CASE WHEN doc_id % 31 = 4 THEN 'annotation_sets' WHEN doc_id % 29 = 5 THEN 'hypotheses' WHEN doc_id % 23 = 6 AND k = 1 THEN 'choice' END AS reason FROM h""")
def suite_contracts(spark, d):
    long = F.col("n_chars") > 1000
    yes, no, none = F.lit("Entailment"), F.lit("Contradiction"), F.lit("NotMentioned")
    first = F.when(F.col("doc_id") % 23 == 6, F.lit("Perhaps")).when(long, yes).otherwise(no)
    notes = F.create_map(F.lit("h1"), first, F.lit("h2"), F.when(long, no).otherwise(yes), F.lit("h3"), none)
    sets = F.when(F.col("doc_id") % 31 == 4, F.array().cast("array<map<string,string>>")).when(F.col("doc_id") % 29 == 5, F.array(F.map_filter(notes, lambda k, v: k != "h3"))).otherwise(F.array(notes))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", sets.alias("annotation_sets"))
    return suites.contract_nli(docs, _HYPOTHESES).select("id", "group_id", "gold_idx", "reason")


@register(f"""WITH q AS (SELECT c_custkey AS c, c_custkey % 3 = 0 AS listed, c_custkey % 11 = 2 AS late FROM customer WHERE c_custkey % 7 <> 6 OR c_custkey >= 0),
r AS (SELECT o_custkey + CASE WHEN o_orderkey % 43 = 1 THEN 1000000 ELSE 0 END AS c, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey AS o, o_orderstatus FROM orders),
m AS (SELECT *, count(*) OVER (PARTITION BY c, day) AS n FROM r)
SELECT o AS resolution, 'forecastbench/{DUE}/' || 'events' || '/%22' || m.c || '%22' AS group_id,
CASE WHEN q.c IS NULL THEN 'unknown_question' WHEN n > 1 THEN 'repeated_resolution' WHEN o_orderstatus = 'P' THEN 'unresolved' WHEN listed AND day <= '{DUE}' THEN 'horizon' WHEN late THEN 'frozen_later' END AS reason
FROM m LEFT JOIN q ON q.c = m.c""")
def suite_forecasts(spark, d):
    customer, order = table(spark, d, "customer"), table(spark, d, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    c = F.col("c_custkey")
    context = F.struct(c.cast("string").alias("id"), *[F.when(c % 11 == 2, "1997-05-05").otherwise("1995-01-01").alias(f) if f == "freeze_datetime" else F.lit("On {resolution_date}?" if f == "question" else "").alias(f) for f in suites.FORECAST_CONTEXT])
    days = order.groupBy("o_custkey").agg(F.collect_set(day).alias("days"))
    asked = customer.join(days, c == F.col("o_custkey"), "left").select(F.lit("events").alias("source"), c.cast("string").alias("id"), F.when(c % 3 == 0, F.coalesce("days", F.array().cast("array<string>"))).otherwise(F.when(F.lit(False), F.col("days"))).alias("resolution_dates"), context.alias("context"))
    # A question without listed dates may not leave one open.
    plain = F.col("context").withField("question", F.when(F.col("resolution_dates").isNull(), F.lit("When?")).otherwise(F.col("context.question")))
    asked = asked.select("source", "id", "resolution_dates", F.array(plain).alias("contexts"))
    known = F.col("o_custkey") + F.when(F.col("o_orderkey") % 43 == 1, 1_000_000).otherwise(0)
    resolved = order.select(F.lit("events").alias("source"), known.cast("string").alias("id"), F.lit(None).cast("array<int>").alias("direction"), day.alias("resolution_date"), (F.col("o_orderstatus") != "P").alias("resolved"), F.when(F.col("o_orderstatus") != "P", (F.col("o_orderstatus") == "F").cast("double")).alias("resolved_to"), F.col("o_orderkey").alias("resolution"))
    found = suites.forecastbench(asked, resolved.drop("resolution"), DUE).select("id", "group_id", "reason").distinct()
    # Resolutions by their ids.
    pair = F.concat(F.lit('["'), F.col("resolution_date"), F.lit('",null]'))
    group = F.concat(F.lit(f"forecastbench/{DUE}/events/%22"), "id", F.lit("%22"))
    named = resolved.select("resolution", F.concat_ws("/", group, suites.quoted(pair)).alias("id"))
    return named.join(found, "id").select("resolution", "group_id", "reason")


@register("""WITH e AS (SELECT p_partkey AS i, p_size, unnest(range(2)) AS q FROM part)
SELECT '["' || i || '","' || CASE q WHEN 0 THEN 'size/é' ELSE 'big' END || '"]' AS plain_id, i::VARCHAR AS record, CASE q WHEN 0 THEN 'size/é' ELSE 'big' END AS question, CASE WHEN q = 1 THEN (p_size > 25)::INT WHEN i % 13 = 5 THEN NULL ELSE CASE WHEN p_size > 25 THEN 1 ELSE 0 END END AS gold_idx,
CASE WHEN i % 17 = 3 THEN 'variant' WHEN q = 0 AND i % 13 = 5 THEN 'label' END AS reason FROM e""")
def suite_breadth(spark, d):
    big = F.col("p_size") > 25
    size = _named(("type", F.lit("choice")), ("instructions", F.lit("Which size?")), ("criteria", F.create_map(F.lit("small"), F.lit(None).cast("string"), F.lit("large"), F.lit(None).cast("string"))), ("label", F.when(F.col("p_partkey") % 13 == 5, "huge").when(big, "large").otherwise("small")), ("src", F.lit("part")))
    yes = _named(("type", F.lit("noul")), ("instructions", F.lit("Is it big?")), ("label", big), ("src", F.lit("part")))
    questions = F.concat(F.lit('{"size/é":'), F.to_json(size, {"ignoreNullFields": "false"}), F.lit(',"big":'), F.to_json(yes), F.lit("}"))
    meta = _named(("id", F.col("p_partkey").cast("string")), ("group_id", F.col("p_brand")), ("source", F.lit("part")), ("variant", F.when(F.col("p_partkey") % 17 == 3, "noisy").otherwise("clean")))
    found = suites.breadth(table(spark, d, "part").select(meta.alias("meta"), F.col("p_name").alias("state"), questions.alias("questions")))
    parts = suites.parts_of(F.col("id"))
    return found.select(F.concat(F.lit('["'), parts[0], F.lit('","'), parts[1], F.lit('"]')).alias("plain_id"), parts[0].alias("record"), parts[1].alias("question"), "gold_idx", "reason")


@register("""WITH c AS (SELECT s_suppkey AS s, row_number() OVER (ORDER BY s_suppkey) - 1 AS k, s_acctbal FROM supplier), q AS (SELECT *, unnest(range(CASE WHEN s % 9 = 4 THEN 4 ELSE 5 END)) AS j FROM c)
SELECT 'typed_decisions/' || k || '/q' || j AS id, 'typed_decisions/' || k AS group_id, (s + j) % 2 AS gold_idx, CASE WHEN s % 9 = 4 THEN 'questions' WHEN s % 7 = 2 THEN 'workflow' END AS reason FROM q""")
def suite_legacy_cases(spark, d):
    s = F.col("s_suppkey")
    one = lambda j: F.concat(F.lit(f'"q{j}":'), F.to_json(_named(("type", F.lit("noul")), ("instructions", F.lit(f"Question {j}?")))))
    gold = lambda j: F.concat(F.lit(f'"q{j}":{{"idx":'), ((s + j) % 2).cast("string"), F.lit(',"soft":[0.5,0.5]}'))
    every = lambda f: F.concat(F.lit("{"), F.concat_ws(",", *[f(j) for j in range(4)], F.when(s % 9 != 4, f(4))), F.lit("}"))
    cases = table(spark, d, "supplier").select(s.alias("n"), F.col("s_name").alias("state"), every(one).alias("questions"), every(gold).alias("gold"), F.when(s % 7 == 2, "").otherwise("flow").alias("workflow"))
    return suites.typed_decisions(cases, "n").select("id", "group_id", F.col("gold_idx").cast("long").alias("gold_idx"), "reason")


@register("""SELECT 'nimble/summeval/' || p_partkey AS id, 'nimble/summeval/' || p_brand AS group_id, CASE WHEN p_partkey % 11 = 3 THEN NULL ELSE (p_size % 5)::INT END AS gold_idx, CASE WHEN p_partkey % 2 = 0 THEN p_size % 5 + 0.25 WHEN p_partkey % 11 <> 3 THEN (p_size % 5)::DOUBLE END AS gold_score,
CASE WHEN p_partkey % 19 = 4 THEN 'unexpected_distribution' WHEN p_partkey % 11 = 3 THEN 'hard_label' END AS reason FROM part""")
def suite_nimble(spark, d):
    i, size = F.col("p_partkey"), F.col("p_size") % 5
    question = _named(("type", F.lit("score")), ("instructions", F.lit("How good?")), ("criteria", F.array(*[F.lit(f"level {k}") for k in range(5)])))
    reference = _named(("target", F.when(i % 11 == 3, "none").otherwise(size.cast("string"))), ("expert_mean", F.when(i % 2 == 0, size + 1.25)), ("distribution", F.when(i % 19 == 4, F.create_map(F.lit("0"), F.lit(1.0)))))
    record = _named(("id", i.cast("string")), ("family", F.col("p_brand")), ("input", _named(("state", F.col("p_name")), ("questions", _named(("decision", question))))), ("reference", reference))
    return suites.nimble(table(spark, d, "part").select(F.to_json(record).alias("line_text")), "summeval").select("id", "group_id", "gold_idx", "gold_score", "reason")
