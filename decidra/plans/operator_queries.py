"""Queries that apply one operator each: sources, sinks, filters, joins, options, validation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import options as O
from ..functions import probs as P
from ..functions import rational
from ..functions import text as T
from ..operators import audit, components, joins, metrics, route, shortlist, validate
from ..operators.tables import shared_root, stored
from ..sources import manifests, sinks, strict
from .common import DECISIONS, decisions, register, rounded, table
from .text_queries import _normal


def _fresh(spark, name: str) -> str:
    return f"{shared_root(spark)}/tables/{name}-{uuid.uuid4().hex}"


def _lit(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# Sources and sinks


@register("SELECT o_orderkey AS id, o_orderstatus AS status, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority || ' \"x\" é' END AS note FROM orders")
def jsonl_round_trip(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 5 != 0, F.concat("o_orderpriority", F.lit(' "x" é'))).alias("note"))
    path = _fresh(spark, "jsonl")
    sinks.json_lines(rows, path, ["id"])
    return strict.strict_json_lines(spark, path, "id long, status string, note string")


@register("""SELECT coalesce(CASE event_id % 4 WHEN 1 THEN 'malformed_json' WHEN 2 THEN 'record_not_object' WHEN 3 THEN 'blank_line' END, 'good') AS reason, count(*) AS n FROM events GROUP BY 1""")
def jsonl_bad_lines(spark, d):
    i = F.col("event_id") % 4
    path = _fresh(spark, "lines")
    table(spark, d, "events").select(F.when(i == 1, F.concat(F.lit("{"), "props")).when(i == 2, "[1]").when(i == 3, " ").otherwise(F.col("props")).alias("value")).write.text(path)
    read = strict.json_lines(spark, path, "k long")
    return read.groupBy(F.coalesce("reason", F.lit("good")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@register("SELECT count(*) AS lines, count(*) FILTER (event_id % 3 = 0) AS bad FROM events")
def jsonl_line_counts(spark, d):
    path = _fresh(spark, "lines")
    table(spark, d, "events").select(F.when(F.col("event_id") % 3 == 0, F.lit('{"x":')).otherwise(F.col("props")).alias("value")).write.text(path)
    return strict.line_counts(spark, path).agg(F.sum("lines").alias("lines"), F.sum("bad").alias("bad"))


@register("""SELECT p_partkey AS id, p_name || ', "' || p_type || '"' || chr(10) || p_brand AS text FROM part""")
def csv_round_trip(spark, d):
    text = F.concat("p_name", F.lit(', "'), "p_type", F.lit('"\n'), "p_brand")
    path = _fresh(spark, "csv")
    table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.alias("text")).write.options(header=True, quote='"', escape='"').csv(path)
    return strict.csv(spark, path, "id long, text string")


@register("SELECT count(*) AS n_rows FROM part")
def csv_row_count(spark, d):
    path = _fresh(spark, "csv")
    table(spark, d, "part", "p_partkey", "p_name").write.options(header=True).csv(path)
    return spark.range(1).select(F.lit(strict.csv_rows(spark, path, "p_partkey long, p_name string")).cast("long").alias("n_rows"))


@register("SELECT o_orderkey AS id, o_orderpriority AS p FROM orders")
def gzip_lines(spark, d):
    path = _fresh(spark, "gzip")
    table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("p")).write.option("compression", "gzip").json(path)
    return strict.strict_json_lines(spark, path, "id long, p string")


@register("""SELECT n_regionkey AS region, sum(CASE WHEN n_nationkey % 7 = 0 THEN 0 ELSE 1 END)::BIGINT AS kept FROM nation GROUP BY 1""")
def published_table(spark, d):
    path = _fresh(spark, "published")
    rows = table(spark, d, "nation").withColumn("keep", F.col("n_nationkey") % 7 != 0)
    sinks.publish(spark, lambda staging: rows.write.parquet(staging), path)
    return strict.parquet(spark, path, ["n_regionkey", "keep"]).groupBy(F.col("n_regionkey").alias("region")).agg(F.count_if("keep").alias("kept"))


@register("""SELECT CASE WHEN o_orderkey % 9 = 0 THEN 'first' ELSE 'second' END AS reason, count(*) AS n FROM orders WHERE o_orderkey % 9 = 0 OR o_orderkey % 10 = 0 GROUP BY 1""")
def quarantine_counts(spark, d):
    i = F.col("o_orderkey")
    return sinks.quarantine(table(spark, d, "orders").withColumn("reason", F.when(i % 9 == 0, "first").when(i % 10 == 0, "second")), _fresh(spark, "quarantine"))


@register("""SELECT o_orderkey AS id, '{"alpha":"' || o_orderstatus || '","beta":null}' AS options, '[' || o_orderkey % 3 || ',null]' AS target FROM orders""")
def compatible_export(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.struct(F.col("o_orderstatus").alias("alpha"), F.lit(None).cast("string").alias("beta")).alias("options"), F.array(F.col("o_orderkey") % 3, F.lit(None)).alias("target"))
    path = _fresh(spark, "compatible")
    sinks.compatible(rows, ["options", "target"]).write.parquet(path)
    return strict.parquet(spark, path)


@register(f"WITH {DECISIONS} SELECT (SELECT count(*) FROM d) AS inputs, (SELECT count(gold_idx) FROM d) AS hard, (SELECT count(DISTINCT group_id) FROM d) AS groups, 0::BIGINT AS only_left, 0::BIGINT AS only_right")
def bundle_round_trip(spark, d):
    none = F.lit(None).cast("string")
    rows = decisions(spark, d).withColumns({"state": F.col("suite"), "instructions": none, "options": F.array(F.col("qtype")), "option_ids": F.array(F.col("qtype")), "source": none})
    path = _fresh(spark, "bundle")
    sinks.write_bundle(rows, path)
    parts = {n: spark.read.parquet(f"{path}/{n}") for n in ("inputs", "targets", "provenance")}
    gap = sinks.read_back(sinks.bundle_tables(rows)["targets"], f"{path}/targets")
    counts = parts["inputs"].agg(F.count(F.lit(1)).alias("inputs")).crossJoin(parts["targets"].agg(F.count("gold_idx").alias("hard"))).crossJoin(parts["provenance"].agg(F.count_distinct("group_id").alias("groups")))
    # Each side is one row.
    return counts.crossJoin(gap.select(F.col("only_left").cast("long").alias("only_left"), F.col("only_right").cast("long").alias("only_right")))


@register("""SELECT n_regionkey AS namespace, n_nationkey % 3 AS record_id, min(n_name) AS exposure, string_agg(n_name, ',' ORDER BY n_name) AS refs FROM nation GROUP BY 1, 2""")
def exposure_coalescing(spark, d):
    rows = table(spark, d, "nation").select(F.col("n_regionkey").alias("namespace"), (F.col("n_nationkey") % 3).alias("record_id"), F.lit("train").alias("split"), F.lit("s").alias("state"), F.col("n_name").alias("exposure"))
    return strict.coalesced_exposures(rows).select("namespace", "record_id", "exposure", F.array_join("references", ",").alias("refs"))


@register("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'revision' WHEN s_suppkey % 4 = 0 THEN 'license' WHEN s_name LIKE '%7' THEN 'lineage' END AS problem FROM supplier WHERE s_suppkey % 3 = 0 OR s_suppkey % 4 = 0 OR s_name LIKE '%7'""")
def provenance_problems(spark, d):
    i = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select(i, F.when(i % 3 != 0, "r1").alias("revision"), F.when(i % 4 == 0, "").otherwise("mit").alias("license"), F.col("s_name").alias("upstream"))
    return strict.provenance_offenders(rows, "7$").select("s_suppkey", "problem")


@register("""WITH r AS (SELECT event_id, user_id, CASE WHEN event_id % 50 = 0 THEN '' ELSE user_id::VARCHAR END AS record_id, CASE WHEN event_id % 7 = 0 THEN 'test' ELSE 'train' END AS split FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY event_id::VARCHAR) AS k FROM r)
SELECT event_id, CASE WHEN record_id = '' THEN 'missing_record_id' WHEN split <> 'train' THEN 'non_train_split' WHEN k > 1 THEN 'duplicate_source_id' END AS reason FROM n""")
def record_quarantine(spark, d):
    i = F.col("event_id")
    rows = table(spark, d, "events").select("event_id", F.when(i % 50 == 0, "").otherwise(F.col("user_id").cast("string")).alias("record_id"), F.when(i % 7 == 0, "test").otherwise("train").alias("split"), F.lit("f").alias("file"), i.cast("string").alias("line_text"), F.lit(None).cast("string").alias("reason"))
    return strict.quarantined(rows, "record_id", "split").select("event_id", "reason")


_LABELS = ["FURNITURE", "BUILDING", "AUTOMOBILE", "MACHINERY", "HOUSEHOLD"]


@register(f"""SELECT sha256('segments|' || c_name) AS id, c_name AS state, CASE WHEN c_mktsegment IN {str(tuple(_LABELS))} THEN list_position({_lit(_LABELS)}, c_mktsegment) - 1 END::INT AS gold_idx, 5::INT AS k FROM customer""")
def suite_adapter(spark, d):
    rows = strict.suite_rows(table(spark, d, "customer"), "segments", "c_name", "c_mktsegment", _LABELS, "Which segment?")
    return rows.select("id", "state", "gold_idx", F.size("options").alias("k"))


# Filters

_QUESTIONS = ("Which is right?", "Is answer A and B right?", "What does the figure show?", "Why are all of the above wrong?", "Pick (A) or (B)", "Is it depicted?", "Who did it?")
_OPTIONS = ("Paris", "none of them.", "All", "a chart", "the statement 3 holds", "both sides", "Neither A nor B")


@register(f"""WITH q AS (SELECT o_orderkey AS id, {_lit(_QUESTIONS)}[(o_orderkey % 7)::INT + 1] AS q, [{_lit(_OPTIONS)}[((o_orderkey // 7) % 7)::INT + 1], o_orderpriority] AS o FROM orders),
t AS (SELECT *, list_prepend(q, o) AS t FROM q)
SELECT id, CASE WHEN len(list_filter(t, lambda x: regexp_matches(x, '{validate.OPTION_REFERENCE}'))) > 0 OR len(list_filter(o, lambda x: regexp_matches(x, '{validate.BARE_OPTION_REFERENCE}'))) > 0 THEN 'option_or_position_reference'
WHEN len(list_filter(t, lambda x: regexp_matches(x, '{validate.VISUAL_REFERENCE}'))) > 0 THEN 'possible_missing_visual_context' END AS reason FROM t""")
def question_filters(spark, d):
    i = F.col("o_orderkey")
    pick = lambda values, at: F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))
    rows = table(spark, d, "orders").select(i.alias("id"), pick(_QUESTIONS, i % 7).alias("q"), F.array(pick(_OPTIONS, F.floor(i / 7) % 7), F.col("o_orderpriority")).alias("o"))
    return rows.select("id", validate.question_reason(F.col("q"), F.col("o")).alias("reason"))


@register("""SELECT doc_id, contains(text, '<|endoftext|>') OR contains(text, '[MASK]') OR contains(text, 'password') AS masked,
CASE WHEN length(text) > 4096 THEN 'unsupported_length' WHEN contains(text, '<|endoftext|>') OR contains(text, '[MASK]') OR contains(text, 'password') THEN 'unsupported_source_mask' ELSE 'ok' END AS status FROM documents WHERE text IS NOT NULL""")
def literal_and_length_status(spark, d):
    rows = table(spark, d, "documents", "doc_id", "text").where(F.col("text").isNotNull())
    masked = validate.has_literal(F.col("text"), ["<|endoftext|>", "[MASK]", "password"])
    return rows.select("doc_id", masked.alias("masked"), validate.length_status(F.length("text"), masked, 4096).alias("status"))


@register("""SELECT c_custkey AS id, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'domain' WHEN c_nationkey = 3 THEN 'out_of_scope' WHEN c_custkey % 2 = 0 THEN 'not_single_label' END AS reason FROM customer""")
def domain_filters(spark, d):
    labels = F.when(F.col("c_nationkey") == 3, F.array(F.lit("oos"))).when(F.col("c_custkey") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), validate.domain_reason(F.col("c_mktsegment"), ["BUILDING", "MACHINERY"], labels).alias("reason"))


# Joins and sets


@register("""WITH f AS (SELECT o_custkey, min(o_orderkey) AS canonical FROM orders GROUP BY 1)
SELECT a.o_orderkey AS later, b.o_orderkey AS earlier, canonical, a.o_orderstatus = b.o_orderstatus AS target_same FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey > b.o_orderkey JOIN f ON f.o_custkey = a.o_custkey""")
def duplicate_decision_pairs(spark, d):
    return joins.all_earlier_pairs(table(spark, d, "orders"), "o_custkey", "o_orderkey", "o_orderstatus")


@register("""SELECT o_orderkey AS later, min(o_orderkey) OVER w AS canonical, o_orderstatus = first(o_orderstatus) OVER w AS target_same FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey) QUALIFY o_orderkey > min(o_orderkey) OVER w""")
def duplicate_decision_first(spark, d):
    return joins.earlier_pairs(table(spark, d, "orders"), "o_custkey", "o_orderkey", "o_orderstatus")


@register("SELECT c_nationkey AS key, count(*) AS n_rows, count(DISTINCT c_mktsegment) AS n_targets FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment) > 1")
def ambiguous_target_keys(spark, d):
    return joins.ambiguous_keys(table(spark, d, "customer"), "c_nationkey", "c_mktsegment").withColumnRenamed("c_nationkey", "key")


@register("SELECT c_custkey AS id, c_name, s_suppkey AS pos FROM customer JOIN supplier ON c_custkey = (s_suppkey * 13) % 97")
def manifest_order(spark, d):
    ids = table(spark, d, "supplier").select(((F.col("s_suppkey") * 13) % 97).alias("id"), F.col("s_suppkey").alias("pos"))
    return joins.in_manifest_order(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name"), ids, "id")


@register("""WITH k AS (SELECT n_nationkey AS k FROM nation UNION ALL SELECT n_nationkey FROM nation WHERE n_regionkey = 1), c AS (SELECT k, count(*) AS n FROM k GROUP BY 1)
SELECT s_suppkey, CASE WHEN n IS NULL THEN 'unknown' ELSE 'ambiguous' END AS reason FROM supplier LEFT JOIN c ON k = s_nationkey + 2 WHERE coalesce(n, 0) <> 1""")
def unknown_services(spark, d):
    names = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_regionkey")
    known = names.select("k").unionByName(names.where("n_regionkey = 1").select("k"))
    return joins.unknown_references(table(spark, d, "supplier").select("s_suppkey", (F.col("s_nationkey") + 2).alias("k")), known, "k").select("s_suppkey", "reason")


@register("""SELECT n_nationkey, h.hypothesis, h.hypothesis_text FROM nation, (VALUES ('a', 'It is large.'), ('b', 'It is small.'), ('c', 'It is old.')) AS h(hypothesis, hypothesis_text)""")
def document_hypotheses(spark, d):
    return joins.with_hypotheses(table(spark, d, "nation", "n_nationkey"), [("a", "It is large."), ("b", "It is small."), ("c", "It is old.")])


@register("""SELECT 'status' AS "column", count(*) FILTER (o_orderkey % 6 = 0 AND o_orderstatus <> 'X') AS n_differ FROM orders UNION ALL SELECT 'priority', count(*) FILTER (o_orderkey % 4 = 0) FROM orders UNION ALL SELECT 'same', 0 FROM region WHERE r_regionkey = 0""")
def artifact_reconciliation(spark, d):
    i = F.col("o_orderkey")
    ours = table(spark, d, "orders").select(i.alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.lit(None).cast("string").alias("same"))
    theirs = table(spark, d, "orders").select(i.alias("id"), F.when(i % 6 == 0, "X").otherwise(F.col("o_orderstatus")).alias("status"), F.when(i % 4 != 0, F.col("o_orderpriority")).alias("priority"), F.lit(None).cast("string").alias("same"))
    return joins.reconcile(ours, theirs, "id", ["status", "priority", "same"])


@register("""WITH s AS (SELECT l_orderkey AS id, CASE WHEN bool_and(l_linestatus = 'F') THEN 'F' WHEN bool_and(l_linestatus = 'O') THEN 'O' ELSE 'P' END AS derived FROM lineitem GROUP BY 1)
SELECT o_orderkey AS id, o_orderstatus AS label, derived, CASE WHEN s.id IS NULL THEN 'no_source' ELSE 'label_differs' END AS problem FROM orders LEFT JOIN s ON s.id = o_orderkey WHERE s.id IS NULL OR o_orderstatus IS DISTINCT FROM derived""")
def label_rederivation(spark, d):
    line = lambda s: F.bool_and(F.col("l_linestatus") == s)
    source = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.when(line("F"), "F").when(line("O"), "O").otherwise("P").alias("derived"))
    return joins.rederived(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("label")), source, "id", "label", "derived")


@register("""SELECT c_custkey AS id FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')""")
def without_earlier_groups(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("record"), F.col("c_nationkey").alias("grp"))
    groups = table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("grp"), F.lit(None).cast("long").alias("record"))
    records = table(spark, d, "orders").where("o_orderpriority LIKE '1%'").select(F.lit(None).cast("int").alias("grp"), F.col("o_custkey").alias("record"))
    return joins.without_groups(rows, groups.unionByName(records), ["grp", "record"]).select(F.col("record").alias("id"))


@register("""WITH n AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) SELECT c_custkey AS k, coalesce(n, 0) AS n FROM customer LEFT JOIN n ON k = c_custkey WHERE coalesce(n, 0) <> 1""")
def resolution_matches(spark, d):
    right = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    return joins.exactly_one(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), right, ["k"])[1]


@register("""SELECT k, 'union' AS op FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT k, 'intersect' FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier)
UNION ALL SELECT k, 'except' FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier)""")
def source_sets(spark, d):
    a, b = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    named = lambda rows, op: rows.select("k", F.lit(op).alias("op"))
    return named(a.unionByName(b).distinct(), "union").unionByName(named(a.intersect(b), "intersect")).unionByName(named(joins.uncovered(a, b), "except"))


@register("""SELECT (SELECT count(*) FROM orders WHERE o_orderkey % 100 = 3)::BIGINT AS only_left, 0::BIGINT AS only_right""")
def set_equality(spark, d):
    a = table(spark, d, "orders", "o_orderkey", "o_orderstatus")
    found = joins.same_rows(a, a.where("o_orderkey % 100 <> 3"))
    return found.select(F.col("only_left").cast("long").alias("only_left"), F.col("only_right").cast("long").alias("only_right"))


@register("""WITH k AS (SELECT s_nationkey AS c, count(*) AS n, bool_or(s_acctbal < -800) AS x, bool_or(s_acctbal > 9500) AS q FROM supplier GROUP BY 1)
SELECT s_suppkey, CASE WHEN x THEN 'exclude' WHEN q THEN 'quarantine' ELSE 'retain' END AS decided FROM supplier JOIN k ON c = s_nationkey""")
def group_decisions(spark, d):
    rows = table(spark, d, "supplier")
    members = components.components(rows, components.star_edges(rows, "s_suppkey", ["s_nationkey"]), "s_suppkey")
    own = F.when(F.col("s_acctbal") < -800, "exclude").when(F.col("s_acctbal") > 9500, "quarantine").otherwise("retain")
    return components.propagated(rows.join(members, "s_suppkey").withColumn("own", own), "component", "own").select("s_suppkey", "decided")


@register("SELECT count(*) AS n_components, count(*) FILTER (n > 1) AS n_shared, max(n) AS largest FROM (SELECT count(*) AS n FROM supplier GROUP BY s_nationkey)")
def component_report(spark, d):
    rows = table(spark, d, "supplier")
    return components.report(components.components(rows, components.star_edges(rows, "s_suppkey", ["s_nationkey"]), "s_suppkey"))


@register("""SELECT event_type, CASE event_id % 3 WHEN 0 THEN 'malformed_json' ELSE 'record_not_object' END AS reason, count(*) AS n FROM events WHERE event_id % 3 <> 2 GROUP BY 1, 2""")
def rejection_tallies(spark, d):
    i = F.col("event_id") % 3
    rows = table(spark, d, "events").select("event_type", strict.reason(F.when(i == 0, "{").when(i == 1, "3").otherwise(F.col("props"))).alias("reason"))
    return metrics.rejection_tally(rows, "event_type")


@register("""WITH a AS (SELECT c_custkey AS id, [c_name, c_mktsegment, 'google/boolq', 'https://huggingface.co/datasets/tals/vitaminc/', 'multi_nli'][(c_custkey % 5)::INT + 1] AS n, CASE c_custkey % 4 WHEN 1 THEN 'fixed_suite' WHEN 2 THEN 'own_paws' ELSE 'other' END AS s FROM customer)
SELECT id, CASE WHEN s = 'fixed_suite' THEN 'clinc' WHEN s = 'own_paws' THEN 'paws' WHEN n = 'google/boolq' THEN 'boolq' WHEN n LIKE '%vitaminc/' THEN 'vitaminc' WHEN n = 'multi_nli' THEN 'multinli' ELSE 'unmapped:' || lower(n) END AS namespace FROM a""")
def dataset_namespaces(spark, d):
    i = F.col("c_custkey")
    name = F.get(F.array(F.col("c_name"), F.col("c_mktsegment"), F.lit("google/boolq"), F.lit("https://huggingface.co/datasets/tals/vitaminc/"), F.lit("multi_nli")), (i % 5).cast("int"))
    suite = F.when(i % 4 == 1, "fixed_suite").when(i % 4 == 2, "own_paws").otherwise("other")
    return table(spark, d, "customer").select(i.alias("id"), audit.namespace(name, suite=suite, fixed={"fixed_suite": "clinc"}, prefix="own_").alias("namespace"))


# States, labels and ids


@register("""SELECT p_partkey AS id, '{"b":"' || p_type || '","a":[' || p_size || ',"' || upper(p_name) || '"]}' AS state, '{"b":"' || lower(p_type) || '","a":[' || p_size || ',"' || lower(p_name) || '"]}' AS ordered,
'{"a":[' || p_size || ',"' || upper(p_name) || '"],"b":"' || p_type || '"}' AS sorted, p_size || '|' || upper(p_name) || '|' || p_type AS leaves, p_size || ' ' || upper(p_name) || ' ' || p_type AS units FROM part""")
def state_forms(spark, d):
    state = F.format_string('{"b":"%s","a":[%d,"%s"]}', "p_type", "p_size", F.upper("p_name"))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), state.alias("state"))
    s = F.col("state")
    return rows.select("id", "state", T.ordered_state(s).alias("ordered"), T.sorted_state(s).alias("sorted"), F.array_join(T.leaves(s), "|").alias("leaves"), F.array_join(T.text_units(s), "|").alias("units"))


@register("""WITH c AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS said, count(*) AS n FROM conversations WHERE text IS NOT NULL GROUP BY 1)
SELECT conv_id, sha256(CASE WHEN conv_id % 3 = 0 THEN 'facts ' || n WHEN conv_id % 3 = 1 THEN said ELSE 'one state' END) AS digest FROM c""")
def content_selectors(spark, d):
    turns = table(spark, d, "conversations").where("text IS NOT NULL").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("said"))
    i = F.col("conv_id") % 3
    made = turns.select("conv_id", T.content_units(F.lit('{"a":"one","b":"state"}'), F.when(i == 0, "synthetic").otherwise("other"), F.when(i == 1, F.col("said")), F.concat(F.lit("facts "), F.size("said"))).alias("u"))
    return made.select("conv_id", F.sha2(F.array_join("u", "|"), 256).alias("digest"))


@register("SELECT p_partkey AS id, url_encode(p_type || '/' || p_name || '*é') AS part FROM part")
def quoted_ids(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.quoted(F.concat("p_type", F.lit("/"), "p_name", F.lit("*é"))).alias("part"))


@register("""SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'english' WHEN 1 THEN 'multilingual' WHEN 2 THEN 'typed-decisions' END AS model,
CASE WHEN o_orderkey % 3 = 0 THEN 'invoice_processing' END AS workflow FROM orders""")
def workflow_match(spark, d):
    i = F.col("o_orderkey")
    name = F.get(F.array(F.lit(" EN"), F.lit("ml"), F.lit("Decisions"), F.lit("other")), (i % 4).cast("int"))
    ids = F.when(i % 3 == 0, F.array(*[F.lit(x) for x in ("urgency", "duplicate", "disposition", "matches_order", "discrepancy_severity")])).otherwise(F.array(F.lit("urgency")))
    return table(spark, d, "orders").select(i.alias("id"), route.model_name(name).alias("model"), route.workflow(ids).alias("workflow"))


@register("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'multilingual' WHEN o_orderkey % 5 = 1 THEN 'typed-decisions' WHEN o_orderkey % 5 = 2 THEN 'typed-decisions' WHEN o_orderkey % 5 = 3 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'english' ELSE 'multilingual' END ELSE 'english' END AS model,
CASE o_orderkey % 5 WHEN 0 THEN 'explicit model' WHEN 1 THEN 'explicit task' WHEN 2 THEN 'workflow' WHEN 3 THEN 'explicit language' ELSE 'English text' END AS reason FROM orders""")
def route_precedence(spark, d):
    i = F.col("o_orderkey")
    none = F.lit(None).cast("string")
    ids = F.when(i % 5 <= 2, F.array(*[F.lit(x) for x in route.WORKFLOWS["customer_service"]]))
    language = F.when(i % 2 == 0, "en-GB").otherwise("de")
    found = route.decision(F.lit("the order was sent to you and it is late"), ids, F.when(i % 5 == 0, "multi").otherwise(none), F.when(i % 5 == 1, "typed-decisions").otherwise(none), F.when(i % 5 <= 3, language), by_workflow=True)
    return table(spark, d, "orders").select(i.alias("id"), found.alias("r")).select("id", "r.model", "r.reason")


# Options, targets and probabilities


@register("""SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'f:choice:' || o_orderstatus || ',f:choice:x' WHEN 1 THEN 'f:score:0,f:score:1' ELSE 'f:noul:false,f:noul:true' END AS ids FROM orders""")
def option_id_lists(spark, d):
    i = F.col("o_orderkey")
    qtype = F.when(i % 3 == 0, "choice").when(i % 3 == 1, "score").otherwise("noul")
    return table(spark, d, "orders").select(i.alias("id"), F.array_join(O.option_ids(F.lit("f"), qtype, O.from_list(F.array(F.col("o_orderstatus"), F.lit("x")))), ",").alias("ids"))


_SIX = ("a", "b", "c", "d", "e", "f")


@register(f"""WITH h AS (SELECT o_orderkey AS id, unnest({_lit(_SIX)}) AS k FROM orders) SELECT id, string_agg(k, '' ORDER BY sha256('7|' || id || '|' || k)) AS shuffled FROM h GROUP BY 1""")
def seeded_shuffle(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    made = O.shuffled(O.from_list(F.array(*[F.lit(x) for x in _SIX])), F.lit("7"), F.col("id").cast("string"))
    return rows.select("id", F.array_join(F.transform(made, lambda o: o["key"]), "").alias("shuffled"))


@register(f"""WITH h AS (SELECT o_orderkey AS id, unnest({_lit(_SIX)}) AS k FROM orders), o AS (SELECT id, list(k ORDER BY sha256('s|' || id || '|' || k)) AS l FROM h GROUP BY 1),
p AS (SELECT id, l || l AS l2, (list_position(l, {_lit(_SIX)}[(id % 6)::INT + 1]) - 1 - ('0x' || sha256('s|' || id)[1:8])::BIGINT % (3 + id % 3) + 6) % 6 AS s, 3 + id % 3 AS k FROM o) SELECT id, array_to_string(l2[s + 1:s + k], '') AS candidates FROM p""")
def candidate_windows(spark, d):
    """Candidate sets of a balanced schedule of sizes: circular windows of a seeded directory around the target."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    directory = F.array(*[F.lit(x) for x in _SIX])
    at = lambda k: O.candidate_set(F.get(directory, (F.col("id") % 6).cast("int")), directory, k, F.lit("s"), F.col("id").cast("string"))
    made = F.when(F.col("id") % 3 == 0, at(3)).when(F.col("id") % 3 == 1, at(4)).otherwise(at(5))
    return rows.select("id", F.array_join(made, "").alias("candidates"))


@register(f"""WITH {DECISIONS} SELECT id, CASE WHEN qtype = 'noul' THEN ['false', 'true'] ELSE ['a', 'b', 'c', 'd', 'e'] END[list_position(probs, list_max(probs))] AS label,
round(CASE WHEN qtype = 'noul' THEN probs[2] WHEN qtype = 'score' THEN list_sum(list_transform(range(k), lambda i: i * probs[i + 1])) END, 8) AS value FROM d""")
def answer_shaping(spark, d):
    rows = decisions(spark, d).withColumn("options", O.from_list(F.array(*[F.lit(x) for x in "abcde"])))
    return rounded(rows.select("id", O.answer(F.col("qtype"), F.col("options"), F.col("probs")).alias("a")).select("id", "a.label", "a.value"))


@register("""WITH t AS (SELECT o_orderkey AS id, list_transform(range(4), lambda i: (CASE WHEN o_orderkey % 6 = 0 THEN 0 ELSE (o_orderkey * (i + 1)) % 5 END)::DOUBLE) AS w FROM orders)
SELECT id, i::INT AS i, round(CASE WHEN list_sum(w) > 0 THEN w[i + 1] / list_sum(w) ELSE 0.25 END, 8) AS p FROM t, range(4) AS r(i)""")
def target_normalization(spark, d):
    i = F.col("o_orderkey")
    w = F.array(*[F.when(i % 6 == 0, 0).otherwise((i * (j + 1)) % 5).cast("double") for j in range(4)])
    return rounded(table(spark, d, "orders").select(i.alias("id"), F.posexplode(P.normalized(w)).alias("i", "p")))


@register(f"""WITH {DECISIONS} SELECT id, id % 5 <> 2 AND id % 7 <> 3 AS strict, id % 7 <> 3 AS loose FROM d""")
def distribution_checks(spark, d):
    i = F.col("id")
    p = F.transform("probs", lambda x, at: x + F.when((i % 5 == 2) & (at == 0), 4e-6).when((i % 7 == 3) & (at == 1), float("nan")).otherwise(0.0))
    made = decisions(spark, d).withColumn("p", F.transform(p, lambda x, at: x + F.when((i % 7 == 3) & (at == 1), float("nan")).otherwise(0.0)))
    return made.select("id", P.is_distribution(F.col("p"), 1e-6).alias("strict"), P.is_distribution(F.col("p"), P.rounding_tolerance(F.col("k"), 5)).alias("loose"))


@register("""WITH c AS (SELECT o_orderkey AS id, [(o_orderkey % 9) * 6, 12 + (o_orderkey % 4) * 3, 18] AS c FROM orders), g AS (SELECT *, gcd(gcd(c[1], c[2]), c[3]) AS g FROM c) SELECT id, c[1] // g AS a, c[2] // g AS b, c[3] // g AS c FROM g""")
def reduced_counts(spark, d):
    i = F.col("o_orderkey")
    r = rational.reduced(F.array((i % 9) * 6, 12 + (i % 4) * 3, F.lit(18)))
    return table(spark, d, "orders").select(i.alias("id"), r.alias("r")).select("id", F.col("r")[0].alias("a"), F.col("r")[1].alias("b"), F.col("r")[2].alias("c"))


@register("""WITH o AS (SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS due, strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') AS h1, strftime(o_orderdate - INTERVAL 1 DAY, '%Y-%m-%d') AS h0 FROM orders)
SELECT id, CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'horizon' WHEN 2 THEN 'horizon' WHEN 3 THEN 'unscheduled_horizon' ELSE 'frozen_later' END AS reason,
'By ' || CASE id % 5 WHEN 1 THEN h0 WHEN 2 THEN '2999-01-01' WHEN 4 THEN '' ELSE h1 END || ', as of ' || due || '?' AS question, false AS unbound FROM o""")
def forecast_guards(spark, d):
    i = F.col("o_orderkey")
    text = lambda days: F.date_format(F.date_add("o_orderdate", days), "yyyy-MM-dd")
    rows = table(spark, d, "orders").select(
        i.alias("id"), text(0).alias("due"), F.when(i % 5 == 1, text(-1)).when(i % 5 == 2, "2999-01-01").when(i % 5 != 4, text(30)).alias("horizon"),
        F.when(~(i % 5).isin(3, 4), F.array(text(-1), text(30))).alias("dates"), F.concat(F.when(i % 5 == 4, text(1)).otherwise(text(0)), F.lit("T00:00:00")).alias("freeze"),
    )
    context = O.allowed_context(F.create_map(F.lit("question"), F.lit("By {resolution_date}, as of {forecast_due_date}?"), F.lit("secret"), F.lit("x")), ["question"])
    question = O.substituted(context["question"], {"resolution_date": F.col("horizon"), "forecast_due_date": F.col("due")})
    return rows.select("id", O.forecast_reason(F.col("due"), F.col("horizon"), F.col("dates"), F.col("freeze")).alias("reason"), question.alias("question"), O.unbound(question).alias("unbound"))


@register("""WITH o AS (SELECT c_custkey AS id, list_transform(range(5), lambda i: ((c_custkey * (i + 2)) % 7)::DOUBLE) AS q, CASE c_custkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 6 ELSE 5 END AS n FROM customer),
v AS (SELECT id, q, n, j, list_transform(range(5), lambda i: ((j + 1) * (i + 3) % 5 + CASE WHEN i = j THEN 3 ELSE 0 END)::DOUBLE) AS w FROM o, range(6) AS r(j) WHERE j < n),
s AS (SELECT id, n, j, CASE WHEN list_sum(list_transform(q, lambda x: x * x)) > 0 AND list_sum(list_transform(w, lambda x: x * x)) > 0 THEN round(list_sum(list_transform(range(1, 6), lambda i: q[i] * w[i])) / (sqrt(list_sum(list_transform(q, lambda x: x * x))) * sqrt(list_sum(list_transform(w, lambda x: x * x)))), 8) ELSE 0 END AS score FROM v),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, j) AS k FROM s)
SELECT id, n::INT AS n, n <= 3 AS passthrough, CASE WHEN n <= 3 THEN 'o0,o1' ELSE string_agg('o' || j, ',' ORDER BY k) FILTER (k <= 3) END AS labels, CASE WHEN n <= 3 THEN 2 ELSE 3 END::INT AS kept, CASE WHEN n > 3 THEN sum(score) FILTER (k <= 3) END AS score FROM r GROUP BY id, n""")
def predict_shortlist(spark, d):
    i = F.col("c_custkey")
    n = F.when(i % 3 == 0, 2).when(i % 3 == 1, 6).otherwise(5)
    one = lambda j: F.array(*[(F.lit((j + 1) * (x + 3) % 5 + (3 if x == j else 0))).cast("double") for x in range(5)])
    rows = table(spark, d, "customer").select(
        i.alias("id"), F.lit("choice").alias("qtype"), F.array(*[((i * (x + 2)) % 7).cast("double") for x in range(5)]).alias("vector"),
        F.slice(O.from_list(F.array(*[F.lit(f"o{j}") for j in range(6)])), 1, n).alias("options"), F.slice(F.array(*[one(j) for j in range(6)]), 1, n).alias("vectors"),
    )
    made = shortlist.reduced_choices(rows, 3)
    score = F.aggregate(F.transform("shortlist.scores", lambda x: F.round(x, 8)), F.lit(0.0), lambda a, x: a + x)
    return rounded(made.select("id", "shortlist.n", "shortlist.passthrough", F.array_join("shortlist.labels", ",").alias("labels"), F.size("options").alias("kept"), score.alias("score")))


# Validation


@register(f"""WITH {DECISIONS}, v AS (SELECT *, CASE WHEN id % 13 = 0 THEN ' ' ELSE id::VARCHAR END AS name, CASE WHEN id % 17 = 0 THEN 9 ELSE gold_idx END AS g FROM d)
SELECT id, array_to_string(list_filter([CASE WHEN trim(name) = '' THEN 'id_blank' END, CASE WHEN g IS NULL AND soft IS NULL AND gold_score IS NULL THEN 'target_missing' END, CASE WHEN g >= k THEN 'gold_range' END,
CASE WHEN gold_score IS NOT NULL AND gold_score > k - 1 THEN 'gold_score' END], lambda x: x IS NOT NULL), ',') AS errors FROM v""")
def row_validation(spark, d):
    i = F.col("id")
    rows = decisions(spark, d).withColumn("order", i)
    keys = F.transform(F.sequence(F.lit(1), F.col("k")), lambda x: x.cast("string"))
    made = rows.withColumns({"options": O.from_list(keys), "option_ids": keys, "gold_idx": F.when(i % 17 == 0, 9).otherwise(F.col("gold_idx"))})
    made = made.withColumn("id", F.when(F.col("order") % 13 == 0, " ").otherwise(F.col("order").cast("string"))).withColumn("group_id", F.col("group_id").cast("string"))
    return made.select(F.col("order").alias("id"), F.array_join(validate.failed(validate.row_checks()), ",").alias("errors"))


@register(f"""WITH {DECISIONS} SELECT id, array_to_string(list_filter([CASE WHEN id % 6 = 1 THEN 'source_blank' END, CASE WHEN id % 9 = 2 THEN 'split' END, CASE WHEN id % 10 = 3 THEN 'language' END, CASE WHEN id % 4 = 0 THEN 'options_twice' END,
CASE WHEN gold_idx IS NULL THEN 'target_distribution' END, CASE WHEN gold_idx IS NULL THEN 'target_hard' END], lambda x: x IS NOT NULL), ',') AS errors FROM d WHERE qtype <> 'noul'""")
def decision_validation(spark, d):
    i = F.col("id")
    keys = F.transform(F.sequence(F.lit(1), F.col("k")), lambda x: F.when((i % 4 == 0) & (x == 2), "1").otherwise(x.cast("string")))
    text = i.cast("string")
    hot = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda x: F.when(x == F.col("gold_idx"), 1.0).otherwise(0.0))
    made = decisions(spark, d).where("qtype <> 'noul'").withColumns({
        "case_id": text, "group_id": text, "view_id": text, "source": F.when(i % 6 == 1, "\t").otherwise("s"), "instructions": text, "state_json": text, "split": F.when(i % 9 == 2, "all").otherwise("dev"),
        "language": F.when(i % 10 == 3, "de").otherwise("en"), "options": O.from_list(keys), "target": hot, "target_kind": F.lit("hard"), "option_ids": F.transform(F.sequence(F.lit(1), F.col("k")), lambda x: x.cast("string")),
    })
    return made.select("id", F.array_join(validate.failed(validate.decision_checks()), ",").alias("errors"))


@register(f"""WITH {DECISIONS} SELECT id, CASE WHEN id % 8 = 5 THEN 'softmax' ELSE '' END AS native, CASE WHEN id % 9 = 4 THEN 'close' ELSE '' END AS parity FROM d""")
def native_and_parity_checks(spark, d):
    i = F.col("id")
    made = decisions(spark, d).select("id", "probs", F.transform("probs", lambda p, at: F.log(p) + F.when((i % 8 == 5) & (at == 0), 0.01).otherwise(0.0)).alias("logits"), F.lit(1.0).alias("temperature"))
    made = made.withColumn("other", F.transform("probs", lambda p: p + F.when(i % 9 == 4, 1e-9).otherwise(0.0)))
    named = lambda checks: F.array_join(validate.failed(checks), ",")
    return made.select("id", named(validate.native_checks()).alias("native"), named(validate.parity_checks()).alias("parity"))


@register("""WITH r AS (SELECT o_orderkey % 700 AS case_id, o_orderkey % 3 AS view_id, o_custkey AS group_id, o_orderkey AS record_id FROM orders)
SELECT 'case_view' AS "check", case_id || '/' || view_id AS key, count(*) AS n FROM r GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'case_group', case_id::VARCHAR, count(DISTINCT group_id) FROM r GROUP BY case_id HAVING count(DISTINCT group_id) > 1""")
def identity_problems(spark, d):
    i = F.col("o_orderkey")
    rows = table(spark, d, "orders").select((i % 700).alias("case_id"), (i % 3).alias("view_id"), F.col("o_custkey").alias("group_id"), F.lit("s").alias("source"), i.alias("record_id"))
    return validate.identity_offenders(rows)


@register("""WITH s AS (SELECT n_regionkey AS r, list(n_name ORDER BY n_nationkey) AS l FROM nation GROUP BY 1) SELECT r::VARCHAR AS service, CASE r WHEN 0 THEN 'duplicate_service' WHEN 1 THEN 'duplicate_intent' WHEN 2 THEN 'duplicate_display' END AS reason FROM s WHERE r < 3 UNION ALL SELECT '0', 'duplicate_service' FROM region WHERE r_regionkey = 0""")
def service_schemas(spark, d):
    r = F.col("n_regionkey")
    rows = table(spark, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("l"))
    more = F.when(r == 1, F.array(F.col("l")[0])).when(r == 2, F.array(F.lower(F.replace(F.col("l")[0], F.lit("_"), F.lit(" "))))).otherwise(F.array().cast("array<string>"))
    schema = rows.select(r.cast("string").alias("service"), F.transform(F.concat("l", more), lambda n: F.struct(n.alias("name"))).alias("intents"))
    return validate.services(schema.unionByName(schema.where("service = '0'")))[1].select("service", "reason")


@register(f"""SELECT doc_id, {_normal('text')} AS normalized FROM documents""")
def text_normalize_exact(spark, d):
    """Full NFKC and case folding where the JVM's form could differ; texts that need it are a part of the plan of their own."""
    rows = table(spark, d, "documents", "doc_id", "text")
    needs = F.coalesce(T.needs_exact(F.col("text")), F.lit(False))
    return rows.where(needs).select("doc_id", T.normal_exact(F.col("text")).alias("normalized")).unionByName(rows.where(~needs).select("doc_id", T.normal(F.col("text")).alias("normalized")))


@register("""WITH f AS (SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1)
SELECT 'out/' || s || '.jsonl' AS target, CASE s WHEN 'F' THEN 'rows' WHEN 'O' THEN 'bytes' END AS problem FROM f WHERE s IN ('F', 'O') UNION ALL SELECT 'out/X.jsonl', 'missing' UNION ALL SELECT 'out/P.jsonl/inner.jsonl', 'overlapping_target' UNION ALL SELECT 'copy.jsonl', 'copy_source'""")
def manifest_problems(spark, d):
    """Orders written as one file a status, and a manifest of them in which something is wrong."""
    root = _fresh(spark, "manifest")
    rows = table(spark, d, "orders").select("o_orderstatus", F.to_json(F.struct("o_orderkey", "o_totalprice")).alias("value"))
    rows.withColumn("o_orderstatus", F.concat("o_orderstatus", F.lit(".jsonl"))).repartition("o_orderstatus").write.partitionBy("o_orderstatus").text(root)
    found = manifests.files(spark, root).where("path LIKE '%.txt'")
    status = F.regexp_extract("path", r"o_orderstatus=(\w)\.jsonl", 1)
    counts = rows.groupBy(F.col("o_orderstatus").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    sized = stored(found.withColumn("s", status).join(counts, "s"), "sized")
    # The written files under names that a manifest may have.
    for r in sized.select("path", "s").collect():
        sinks.rename(spark, f"{root}/{r['path']}", f"{root}/{r['s']}.jsonl")
    text = lambda v: F.lit(v).cast("string")
    listed = sized.select(
        F.concat("s", F.lit(".jsonl")).alias("path"), F.concat(F.lit("out/"), "s", F.lit(".jsonl")).alias("target"), text("jsonl").alias("format"), text("none").alias("compression"),
        (F.col("bytes") + F.when(F.col("s") == "O", 1).otherwise(0)).alias("bytes"), (F.col("n") + F.when(F.col("s") == "F", 1).otherwise(0)).alias("rows"), text(None).alias("copy_of"),
    )
    more = spark.createDataFrame([("X.jsonl", "out/X.jsonl", "jsonl", "none", 1, 1, None), ("Y.jsonl", "out/P.jsonl/inner.jsonl", "jsonl", "none", 1, 1, None), (None, "copy.jsonl", None, None, None, None, "out/none.jsonl")], manifests.ENTRY)
    return manifests.problems(spark, root, stored(listed, "listed").unionByName(more)).select("target", "problem")
