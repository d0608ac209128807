"""Adapters from the raw layouts of public suites to evaluation rows.

Every adapter maps DataFrames to rows of

    id, suite, group_id, task_id, state, qtype, instructions, options (key, desc), option_ids, gold_idx, soft, gold_score, reason

`state` is a text or JSON; `reason` says why a row is no evaluation row (null: it is one), so nothing is dropped and `sources.sinks.quarantine` can have the rest.
Options keep the source's order; a hard label is only what upstream gives as one, never the likeliest of a distribution; a distribution is never rescaled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import quoted
from ..operators.windows import ranked

COLUMNS = ("id", "suite", "group_id", "task_id", "state", "qtype", "instructions", "options", "option_ids", "gold_idx", "soft", "gold_score", "reason")
PAIR = "struct<key:string,desc:string>"
QUESTION = "type string, instructions string, criteria string"
#: A label list is data of the job, not of the rows.
MOST_LABELS = 100_000

# The adapters' own questions, and the context fields of a forecast.
CLINC_ASKS = "Classify the intent of this utterance. Select oos if it matches none of the supported intents."
CLINC_OOS = "Out of scope: the utterance matches none of the {} supported intents."
CONTRACT_ASKS = "Classify the hypothesis using the full contract."
CONTRACT_CHOICES = {"Entailment": "entailment", "Contradiction": "contradiction", "NotMentioned": "not-mentioned"}
CONTRACT_CRITERIA = {
    "entailment": "The contract entails the hypothesis.", "contradiction": "The contract contradicts the hypothesis.", "not-mentioned": "The hypothesis is neither entailed nor contradicted by the contract.",
}
FORECAST_CONTEXT = (
    "question", "background", "resolution_criteria", "market_info_open_datetime", "market_info_close_datetime", "market_info_resolution_criteria", "url",
    "freeze_datetime", "freeze_datetime_value", "freeze_datetime_value_explanation",
)
FORECAST_ASKS = "As of forecast_as_of_date, assess whether the supplied question resolves as Yes under its resolution criteria. True means the event occurs; false means it does not. Use only the supplied frozen context."
FORECAST_ASKS_ALL = "As of forecast_as_of_date, assess one event: every component question resolves to its corresponding required_component_answer. True means this entire conjunction occurs; false means it does not. Use only the supplied frozen context."


def options_of(qtype: Column, criteria: Column) -> Column:
    """Options of a question whose criteria are JSON: an ordered object or a list for choices, a list of levels for scores, false and true for nouls (with their texts, if given)."""
    named = F.from_json(criteria, "map<string,string>")
    listed = F.from_json(criteria, "array<string>")
    is_list = F.ltrim(criteria).startswith("[")
    pair = lambda k, d: F.struct(k.alias("key"), d.cast("string").alias("desc"))
    levels = F.transform(listed, lambda x, i: pair(i.cast("string"), x))
    choices = F.when(is_list, F.transform(listed, lambda x: pair(x, F.lit(None)))).otherwise(F.transform(F.map_entries(named), lambda e: pair(e["key"], e["value"])))
    text = lambda k: F.when(F.ltrim(criteria).startswith("{"), F.try_element_at(named, F.lit(k)))
    return F.when(qtype == "noul", F.array(*[pair(F.lit(k), text(k)) for k in ("false", "true")])).when(qtype == "score", levels).when(qtype == "choice", choices)


def keys_of(options: Column) -> Column:
    return F.transform(options, lambda o: o["key"])


def place(keys: Column, label: Column) -> Column:
    """The label's place among the keys, from 0; null if it's none of them."""
    return (F.nullif(F.array_position(keys, label), F.lit(0)) - 1).cast("int")


def target_reason(qtype: Column, options: Column, gold: Column, soft: Column) -> Column:
    """What is wrong with options or target of any evaluation row."""
    keys = keys_of(options)
    total = F.aggregate(soft, F.lit(0.0), lambda a, x: a + x)
    fair = (F.size(soft) == F.size(keys)) & F.forall(soft, lambda p: p.isNotNull() & ~F.isnan(p) & p.between(0.0, 1.0)) & (F.abs(total - 1) <= 1e-6)
    return (
        F.when(~F.coalesce(qtype.isin("choice", "score", "noul"), F.lit(False)), "primitive").when(F.coalesce((F.size(keys) < 2) | F.exists(keys, lambda k: F.trim(k) == "") | (F.size(F.array_distinct(keys)) < F.size(keys)), F.lit(True)), "options")
        .when(gold.isNotNull() & ~gold.between(0, F.size(keys) - 1), "hard_label").when(soft.isNotNull() & ~F.coalesce(fair, F.lit(False)), "distribution").when(gold.isNull() & soft.isNull(), "no_target")
    )


def evaluation_rows(rows: DataFrame, **cells: Column) -> DataFrame:
    """`rows` with the cells given as evaluation rows; `reason` in the cells comes before what `target_reason` finds."""
    none = {"gold_idx": "int", "soft": "array<double>", "gold_score": "double", "task_id": "string", "reason": "string"}
    cells = {n: F.lit(None).cast(t) for n, t in none.items()} | cells
    cells["option_ids"] = keys_of(cells["options"])
    cells["options"] = cells["options"].cast(f"array<{PAIR}>")
    cells["reason"] = F.coalesce(cells["reason"], target_reason(cells["qtype"], cells["options"], cells["gold_idx"], cells["soft"]))
    return rows.select(*[cells[c].cast(none[c]).alias(c) if c in none else cells[c].alias(c) for c in COLUMNS])


def jevbench(lines: DataFrame, tier: str, line: str = "line_text") -> DataFrame:
    """A public tier: JSON lines of id, split, family, state, question, labels, expected, group and provenance with gold_probs.

    Labels are in their own order and are mapped to the criteria's; a noul's are no and yes; a score's expected is a level's number.
    Reasons: not_public, labels_differ, bad_expected, unclassified_distribution (of a family other than probability), distribution_labels.
    """
    schema = f"id string, split string, family string, state string, question struct<type:string,instructions:string,criteria:string>, labels array<string>, expected string, `group` string, provenance struct<gold_probs:map<string,double>>"
    rows = lines.select(F.from_json(line, schema).alias("r")).select("r.*", F.col("r.question.type").alias("q")).withColumn("options", options_of(F.col("q"), F.col("question.criteria")))
    names = F.when(F.col("q") == "noul", F.array(F.lit("no"), F.lit("yes"))).otherwise(keys_of(F.col("options")))
    number = F.col("expected").try_cast("int")
    gold = F.when(F.col("q") == "score", number).otherwise(place(names, F.col("expected")))
    probs = F.col("provenance.gold_probs")
    soft = F.when(probs.isNotNull(), F.transform(names, lambda n: F.try_element_at(probs, n)))
    same = lambda a, b: F.array_sort(a).eqNullSafe(F.array_sort(b))
    suite = f"jevbench_public_{tier}"
    reason = (
        F.when(~F.coalesce(F.col("split") == "public", F.lit(False)), "not_public").when(~same(F.col("labels"), names), "labels_differ").when(F.col("expected").isNotNull() & gold.isNull(), "bad_expected")
        .when(probs.isNotNull() & ~F.coalesce(F.col("family") == "probability", F.lit(False)), "unclassified_distribution").when(probs.isNotNull() & ~same(F.map_keys(probs), names), "distribution_labels")
    )
    return evaluation_rows(
        rows, id=F.concat(F.lit(f"{suite}/"), "id"), suite=F.lit(suite), group_id=F.concat(F.lit(f"{suite}/"), F.coalesce(F.nullif("group", F.lit("")), "id")), task_id=F.col("family"), state=F.col("state"), qtype=F.col("q"),
        instructions=F.col("question.instructions"), options=F.col("options"), gold_idx=gold, soft=soft, reason=reason,
    )


def jabr(cases: DataFrame, suite: str = "jabr_v2") -> DataFrame:
    """Tasks with inline cases, as `strict.toml_cases` reads them: task_id, type, question (JSON or a text), pos, state and expected (JSON)."""
    asked = F.from_json("question", QUESTION)
    rows = cases.withColumn("q", asked).withColumn("options", options_of(F.col("type"), F.col("q.criteria")))
    plain = F.get_json_object(F.concat(F.lit('{"x":'), "expected", F.lit("}")), "$.x")
    gold = F.when(F.col("type") == "noul", F.when(F.col("expected") == "true", 1).when(F.col("expected") == "false", 0)).when(F.col("type") == "score", F.col("expected").try_cast("int")).otherwise(place(keys_of(F.col("options")), plain))
    key = F.concat_ws("/", F.lit(suite), "task_id", F.col("pos").cast("string"))
    return evaluation_rows(rows, id=key, suite=F.lit(suite), group_id=key, task_id=F.col("task_id"), state=F.col("state"), qtype=F.col("type"), instructions=F.col("q.instructions"), options=F.col("options"), gold_idx=gold, reason=F.when(gold.isNull(), "bad_expected"))


def clinc(rows: DataFrame, suite: str = "clinc150_oos_seen_source") -> DataFrame:
    """Utterances as split (test or oos_test), index, text, label: one choice among the labels of test in order of first occurrence, and oos.

    Reasons: split, unknown_label (a label of oos_test other than oos, or oos in test).
    """
    firsts = rows.where("split = 'test' AND label <> 'oos'").groupBy("label").agg(F.min("index").alias("first"))
    names = [r["label"] for r in firsts.orderBy("first", "label").limit(MOST_LABELS + 1).collect()]
    if len(names) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    options = F.array(*[F.struct(F.lit(n).alias("key"), F.lit(None).cast("string").alias("desc")) for n in names], F.struct(F.lit("oos").alias("key"), F.lit(CLINC_OOS.format(len(names))).alias("desc")))
    key = F.concat_ws("/", F.lit(suite), "split", F.col("index").cast("string"))
    reason = F.when(~F.coalesce(F.col("split").isin("test", "oos_test"), F.lit(False)), "split").when(F.coalesce((F.col("split") == "oos_test") != (F.col("label") == "oos"), F.lit(True)), "unknown_label")
    return evaluation_rows(rows, id=key, suite=F.lit(suite), group_id=key, task_id=F.lit("intent_classification"), state=F.col("text"), qtype=F.lit("choice"), instructions=F.lit(CLINC_ASKS), options=options, gold_idx=place(keys_of(options), F.col("label")), reason=reason)


def nimble(lines: DataFrame, suite: str, line: str = "line_text") -> DataFrame:
    """Records of id, family, input (state and one question, decision) and reference (target, distribution, annotations, expert_mean).

    Votes are taken as they are in multinli (five annotators, else the reason annotations) and civil_comments, and refused elsewhere (unexpected_distribution); a score's gold is the target, its gold score the
    expert mean from 0.
    """
    schema = f"id string, family string, input struct<state:string,questions:struct<decision:struct<type:string,instructions:string,criteria:string>>>, reference struct<target:string,distribution:map<string,double>,annotations:int,expert_mean:double>"
    rows = lines.select(F.from_json(line, schema).alias("r")).select("r.*", F.col("r.input.questions.decision").alias("q")).withColumn("options", options_of(F.col("q.type"), F.col("q.criteria")))
    target, votes = F.col("reference.target"), F.col("reference.distribution")
    kind = F.col("q.type")
    gold = F.when(kind == "noul", F.when(target.isin("true", "1"), 1).when(target.isin("false", "0"), 0)).when(kind == "score", target.try_cast("int")).otherwise(place(keys_of(F.col("options")), target))
    soft = F.when(votes.isNotNull(), F.transform(keys_of(F.col("options")), lambda k: F.try_element_at(votes, k)))
    score = F.when(kind == "score", F.coalesce(F.col("reference.expert_mean") - 1, target.try_cast("double")))
    reason = F.when(votes.isNotNull() & F.lit(suite not in ("multinli", "civil_comments")), "unexpected_distribution").when(votes.isNotNull() & F.lit(suite == "multinli") & ~F.coalesce(F.col("reference.annotations") == 5, F.lit(False)), "annotations").when(gold.isNull(), "hard_label")
    return evaluation_rows(
        rows, id=F.concat(F.lit(f"nimble/{suite}/"), "id"), suite=F.lit(suite), group_id=F.concat(F.lit(f"nimble/{suite}/"), "family"), task_id=F.lit(suite), state=F.col("input.state"), qtype=kind, instructions=F.col("q.instructions"),
        options=F.col("options"), gold_idx=gold, soft=soft, gold_score=score, reason=reason,
    )


def contract_nli(documents: DataFrame, hypotheses: list[tuple[str, str]], split: str = "test", suite: str = "contractnli") -> DataFrame:
    """Documents (id, text, annotation_sets: array of maps from hypothesis to choice) with each of a stated list of hypotheses (key, text).

    Reasons: annotation_sets (not exactly one), hypotheses (its annotations are of other hypotheses), choice (an unknown one).
    """
    each = F.array(*[F.struct(F.lit(k).alias("h"), F.lit(t).alias("hypothesis")) for k, t in hypotheses])
    notes = F.get("annotation_sets", F.lit(0))
    # Judged once per document, before it meets its hypotheses.
    judged = documents.withColumn("__bad", F.when(F.coalesce(F.size("annotation_sets"), F.lit(0)) != 1, "annotation_sets").when(~F.array_sort(F.map_keys(notes)).eqNullSafe(F.array_sort(F.array(*[F.lit(k) for k, _ in hypotheses]))), "hypotheses"))
    rows = judged.select("id", "text", "annotation_sets", "__bad", F.explode(each).alias("x")).select("*", "x.*")
    choice = reduce(lambda c, n: c.when(F.try_element_at(notes, F.col("h")) == n[1][0], n[0]), enumerate(CONTRACT_CHOICES.items()), F.when(F.lit(False), F.lit(None)))
    options = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(d).alias("desc")) for k, d in CONTRACT_CRITERIA.items()])
    group = F.concat_ws("/", F.lit(suite), F.lit(split), F.col("id").cast("string"))
    return evaluation_rows(
        rows, id=F.concat_ws("/", group, "h"), suite=F.lit(suite), group_id=group, task_id=F.col("h"), state=F.to_json(F.struct(F.col("text").alias("contract"), "hypothesis")), qtype=F.lit("choice"), instructions=F.lit(CONTRACT_ASKS),
        options=options, gold_idx=choice.cast("int"), reason=F.coalesce("__bad", F.when(choice.isNull(), "choice")),
    )


def _bound(text: Column, due: str, horizon: Column) -> Column:
    """A context's text with its dates put in."""
    dated = F.replace(text, F.lit("{forecast_due_date}"), F.lit(due))
    return F.when(horizon.isNull(), dated).otherwise(F.replace(dated, F.lit("{resolution_date}"), F.coalesce(horizon, F.lit(""))))


def forecastbench(questions: DataFrame, resolutions: DataFrame, due: str, suite: str = "forecastbench") -> DataFrame:
    """Resolved decisions of one round.  Questions: source, id (a JSON text or array of ids), resolution_dates (array, null where N/A), contexts (one struct of texts for a single question, one a component for a
    compound one, in order, each with its `id`).  Resolutions: source, id, direction (array of 1 and -1, null for a single question), resolution_date, resolved, resolved_to.

    Reasons: unknown_question, ambiguous_question (twice), repeated_resolution (all rows of one question, date and direction), unresolved, target, horizon (not scheduled, or not after the round), direction (not one of 1 and -1 for each
    component), components, unbound (a date is left open), frozen_later.
    """
    dates = F.col("resolution_dates")
    texts = F.col("contexts")
    known = questions.groupBy("source", "id").agg(F.count(F.lit(1)).alias("__n"), F.first("resolution_dates").alias("resolution_dates"), F.first("contexts").alias("contexts"))
    again = resolutions.groupBy("source", "id", "resolution_date", F.to_json(F.struct("direction")).alias("__d")).agg(F.count(F.lit(1)).alias("__m"))
    rows = resolutions.withColumn("__d", F.to_json(F.struct("direction"))).join(again, ["source", "id", "resolution_date", "__d"]).join(known, ["source", "id"], "left")
    compound = F.ltrim("id").startswith("[")
    horizon = F.when(dates.isNotNull(), F.col("resolution_date"))
    shown = F.transform(texts, lambda c: F.struct(*[_bound(c[f], due, horizon).alias(f) for f in FORECAST_CONTEXT]))
    parts = F.from_json("id", "array<string>")
    directions = F.col("direction")
    fair = F.when(compound, (F.size(directions) == F.size(parts)) & F.forall(directions, lambda d: d.isin(1, -1))).otherwise(directions.isNull())
    whole = F.when(compound, F.transform(texts, lambda c: c["id"]).eqNullSafe(parts)).otherwise(F.size(texts) == 1)
    reason = (
        F.when(F.col("__n").isNull(), "unknown_question").when(F.col("__n") > 1, "ambiguous_question").when(F.col("__m") > 1, "repeated_resolution").when(~F.coalesce("resolved", F.lit(False)), "unresolved").when(~F.coalesce(F.col("resolved_to").isin(0.0, 1.0), F.lit(False)), "target")
        .when(dates.isNotNull() & ~F.coalesce(F.array_contains(dates, F.col("resolution_date")) & (F.col("resolution_date") > due), F.lit(False)), "horizon").when(~F.coalesce(fair, F.lit(False)), "direction").when(~F.coalesce(whole, F.lit(False)), "components")
        .when(F.exists(shown, lambda c: reduce(lambda a, b: a | b, [c[f].contains("{resolution_date}") for f in FORECAST_CONTEXT])), "unbound").when(F.exists(shown, lambda c: F.coalesce(F.left(c["freeze_datetime"], F.lit(10)) > due, F.lit(True))), "frozen_later")
    )
    answers = F.transform(directions, lambda d: F.when(d == 1, "yes").otherwise("no"))
    when_ = F.when(horizon.isNotNull(), horizon).alias("scheduled_resolution_date")
    as_of = F.lit(due).alias("forecast_as_of_date")
    state = F.when(compound, F.to_json(F.struct(as_of, when_, shown.alias("components"), F.struct(F.lit("and").alias("operator"), answers.alias("required_component_answers")).alias("event")))).otherwise(F.to_json(F.struct(as_of, when_, shown[0].alias("question_context"))))
    written = F.when(compound, F.col("id")).otherwise(F.to_json(F.array(F.col("id"))).substr(F.lit(2), F.length(F.to_json(F.array(F.col("id")))) - 2))
    group = F.concat_ws("/", F.lit(suite), F.lit(due), quoted(F.col("source")), quoted(written))
    # A JSON pair of the date and the direction.
    pair = F.concat(F.lit('["'), F.col("resolution_date"), F.lit('",'), F.coalesce(F.to_json("direction"), F.lit("null")), F.lit("]"))
    return evaluation_rows(
        rows, id=F.concat_ws("/", group, quoted(pair)), suite=F.lit(suite), group_id=group, task_id=F.col("source"), state=state, qtype=F.lit("noul"), instructions=F.when(compound, FORECAST_ASKS_ALL).otherwise(FORECAST_ASKS),
        options=options_of(F.lit("noul"), F.lit(None).cast("string")), gold_idx=F.col("resolved_to").cast("int"), reason=reason,
    )


def typed_decisions(cases: DataFrame, order: str, suite: str = "typed_decisions", each: int = 5) -> DataFrame:
    """Legacy cases (state, questions, gold: JSON; workflow) as one row a question, in the questions' order: id SUITE/CASE/QUESTION, grouped by case.

    Cases are numbered from 0 by `order`.  Gold is a map from question to idx, soft and gold_score.  Reasons: questions (not `each` of them), gold (other questions than the case has), workflow (none).
    """
    rows = ranked(cases.withColumn("__all", F.lit(0)), ["__all"], [order], "case_idx")
    asked = F.from_json("questions", f"map<string,struct<{', '.join(f'{a}:{b}' for a, b in (x.split() for x in QUESTION.split(', ')))}>>")
    gold = F.from_json("gold", "map<string,struct<idx:int,soft:array<double>,gold_score:double>>")
    rows = rows.select("case_idx", "state", "workflow", asked.alias("a"), gold.alias("g"))
    bad = F.when(~F.coalesce(F.size("a") == each, F.lit(False)), "questions").when(~F.array_sort(F.map_keys("a")).eqNullSafe(F.array_sort(F.map_keys("g"))), "gold").when(F.coalesce(F.trim("workflow"), F.lit("")) == "", "workflow")
    out = rows.select("case_idx", "state", "workflow", "g", bad.alias("__bad"), F.explode("a").alias("qid", "q")).withColumn("t", F.try_element_at("g", F.col("qid"))).withColumn("options", options_of(F.col("q.type"), F.col("q.criteria")))
    group = F.concat_ws("/", F.lit(suite), F.col("case_idx").cast("string"))
    return evaluation_rows(
        out, id=F.concat_ws("/", group, "qid"), suite=F.lit(suite), group_id=group, task_id=F.col("workflow"), state=F.col("state"), qtype=F.col("q.type"), instructions=F.col("q.instructions"), options=F.col("options"), gold_idx=F.col("t.idx"),
        soft=F.col("t.soft"), gold_score=F.col("t.gold_score"), reason=F.col("__bad"),
    )


def ascii_json(text: Column) -> Column:
    """A JSON string in ASCII: every other character as \\u and its UTF-16 number."""
    plain = F.substring(F.to_json(F.array(text)), F.lit(2), F.length(F.to_json(F.array(text))) - 2)
    units = F.transform(F.split(F.regexp_replace(F.lower(F.hex(F.encode(plain, "UTF-16BE"))), "(....)", "$1 "), " "), lambda u: F.when(u < "0080", F.decode(F.unhex(F.substring(u, 3, 2)), "US-ASCII")).otherwise(F.concat(F.lit("\\u"), u)))
    return F.when(plain.rlike(r"[^\x00-\x7F]"), F.array_join(F.filter(units, lambda u: u != F.lit("\\u")), "")).otherwise(plain)


def pair_id(record: Column, question: Column) -> Column:
    """An id that can be taken apart again, whatever characters both have: a JSON pair."""
    return F.concat(F.lit("["), ascii_json(record), F.lit(","), ascii_json(question), F.lit("]"))


def parts_of(identity: Column) -> Column:
    """[record, question] of a pair id."""
    return F.from_json(identity, "array<string>")


def breadth(records: DataFrame) -> DataFrame:
    """Records (meta: id, group_id, source, variant; state; questions: JSON) as one row a question, with the question's label as gold.

    Reasons: variant (not clean), primitive (a score), label.
    """
    asked = F.from_json("questions", "map<string,struct<type:string,instructions:string,criteria:string,label:string,src:string>>")
    rows = records.select("meta", "state", F.explode(asked).alias("qid", "q")).withColumn("options", options_of(F.col("q.type"), F.col("q.criteria")))
    label = F.col("q.label")
    gold = F.when(F.col("q.type") == "noul", F.when(label.isin("true", "1"), 1).when(label.isin("false", "0"), 0)).otherwise(place(keys_of(F.col("options")), label))
    reason = F.when(~F.coalesce(F.col("meta.variant") == "clean", F.lit(False)), "variant").when(F.col("q.type") == "score", "primitive").when(gold.isNull(), "label")
    return evaluation_rows(
        rows, id=pair_id(F.col("meta.id"), F.col("qid")), suite=F.col("meta.source"), group_id=F.col("meta.group_id"), task_id=F.col("q.src"), state=F.col("state"), qtype=F.col("q.type"), instructions=F.col("q.instructions"), options=F.col("options"),
        gold_idx=gold, reason=reason,
    )
