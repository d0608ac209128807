"""Queries over nested values: where two runs differ, and which old predictions may be reused."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reconcile
from .common import register, table

#: A state per order, as two runs have it: some lines are lost, numbers turn into text or decimals, keys change places.
STATES = """l AS (SELECT l_orderkey AS id, list('{"part":' || l_partkey || ',"qty":' || l_quantity::INT || '}' ORDER BY l_linenumber, l_partkey, l_quantity) AS ls FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey AS id, o_orderstatus AS st, o_orderpriority AS pr, o_custkey AS c, coalesce(ls, []) AS ls FROM orders LEFT JOIN l ON l.id = o_orderkey),
ours AS (SELECT id, '{"status":"' || st || '","lines":[' || array_to_string(ls, ',') || '],"by":{"customer":' || c || ',"priority":"' || pr || '"}}' AS state FROM o),
theirs AS (SELECT id, CASE id % 13 WHEN 1 THEN '{"lines":[' || array_to_string(ls, ',') || '],"status":"' || st || '","by":{"customer":' || c || ',"priority":"' || pr || '"}}'
  WHEN 2 THEN '{"status":"' || st || '","lines":[' || array_to_string(ls[2:], ',') || '],"by":{"customer":' || c || ',"priority":"' || pr || '"}}'
  WHEN 3 THEN '{"status":"' || st || '","lines":[' || array_to_string(ls, ',') || '],"by":{"customer":"' || c || '","priority":"' || pr || '"}}'
  WHEN 4 THEN '{"status":"' || st || '","lines":[' || array_to_string(ls, ',') || '],"by":{"customer":' || c || '.0,"priority":null}}'
  WHEN 5 THEN '{ "status": "' || st || '", "lines": [' || array_to_string(ls, ', ') || '], "by":{"customer":' || c || ',"priority":"' || pr || '"}}'
  WHEN 6 THEN '{"status":"' || st || '","lines":[' || array_to_string(ls, ',') || '],"by":[]}'
  ELSE '{"status":"' || st || '","lines":[' || array_to_string(ls, ',') || '],"by":{"customer":' || c || ',"priority":"' || pr || '"}}' END AS state FROM o)"""
#: Nodes of the states, by DuckDB's own walk over JSON.
NODES = """SELECT s.id, t.fullkey AS path, CASE t.type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'NULL' THEN 'null' WHEN 'DOUBLE' THEN 'float' ELSE 'int' END AS kind,
CASE t.type WHEN 'OBJECT' THEN json_keys(t.value)::JSON::VARCHAR WHEN 'ARRAY' THEN json_array_length(t.value)::VARCHAR WHEN 'VARCHAR' THEN t.value->>'$' WHEN 'NULL' THEN NULL WHEN 'DOUBLE' THEN (t.value::VARCHAR)::DOUBLE::VARCHAR ELSE t.value::VARCHAR END AS value"""


def _states(spark, d):
    line = F.concat(F.lit('{"part":'), F.col("l_partkey"), F.lit(',"qty":'), F.col("l_quantity").cast("int"), F.lit("}"))
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", line.alias("x")))), lambda s: s["x"]).alias("ls"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("st"), F.col("o_orderpriority").alias("pr"), F.col("o_custkey").cast("string").alias("c"))
    rows = orders.join(lines, "id", "left").withColumn("ls", F.coalesce("ls", F.array().cast("array<string>")))
    status = F.concat(F.lit('"status":"'), "st", F.lit('"'))
    listed = lambda items, sep=",": F.concat(F.lit('"lines":['), F.array_join(items, sep), F.lit("]"))
    by = lambda c, p: F.concat(F.lit('"by":{"customer":'), c, F.lit(',"priority":'), p, F.lit("}"))
    priority, customer = F.concat(F.lit('"'), "pr", F.lit('"')), F.col("c")
    usual = by(customer, priority)
    whole = lambda *parts: F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    every = F.col("ls")
    case = F.col("id") % 13
    spaced = F.concat(F.lit('{ "status": "'), "st", F.lit('", "lines": ['), F.array_join(every, ", "), F.lit("], "), usual, F.lit("}"))
    theirs = (
        F.when(case == 1, whole(listed(every), status, usual)).when(case == 2, whole(status, listed(F.slice(every, 2, F.greatest(F.size(every), F.lit(1)))), usual))
        .when(case == 3, whole(status, listed(every), by(F.concat(F.lit('"'), customer, F.lit('"')), priority))).when(case == 4, whole(status, listed(every), by(F.concat(customer, F.lit(".0")), F.lit("null"))))
        .when(case == 5, spaced).when(case == 6, whole(status, listed(every), F.lit('"by":[]'))).otherwise(whole(status, listed(every), usual))
    )
    return rows.select("id", whole(status, listed(every), usual).alias("state")), rows.select("id", theirs.alias("state"))


@register(f"""WITH {STATES},
a AS ({NODES} FROM ours s, json_tree(s.state::JSON) t), b AS ({NODES} FROM theirs s, json_tree(s.state::JSON) t),
m AS (SELECT coalesce(a.id, b.id) AS id, coalesce(a.path, b.path) AS path, a.kind AS ka, b.kind AS kb, a.value AS va, b.value AS vb FROM a FULL JOIN b ON a.id = b.id AND a.path = b.path)
SELECT id, 'state' AS field, path, CASE WHEN ka IS NULL THEN 'missing' WHEN kb IS NULL THEN 'extra' WHEN ka <> kb THEN 'kind_differs' WHEN ka = 'object' THEN 'keys_differ' WHEN ka = 'array' THEN 'size_differs' ELSE 'value_differs' END AS problem, va AS ours, vb AS theirs
FROM m WHERE ka IS DISTINCT FROM kb OR va IS DISTINCT FROM vb""")
def structural_differences(spark, d):
    ours, theirs = _states(spark, d)
    return reconcile.differences(ours, theirs, "id", ["state"])


@register(f"""WITH {STATES}, n AS (SELECT id, id % 13 AS v FROM o),
r AS (SELECT id + CASE WHEN id % 37 = 0 THEN 10000000 ELSE 0 END AS id, id AS was, v FROM n), p AS (SELECT id + CASE WHEN id % 41 = 0 THEN 20000000 ELSE 0 END AS id FROM n)
SELECT r.id, CASE WHEN r.id <> was THEN 'unknown_id' WHEN was % 41 = 0 THEN 'missing_prediction' WHEN v IN (1, 3, 4, 6) OR (v = 2 AND len(o.ls) > 0) THEN 'input_differs' WHEN was % 17 = 3 THEN 'target_differs' WHEN was % 19 = 4 THEN 'artifact_differs' END AS reason
FROM r JOIN o ON o.id = was
UNION ALL SELECT id, 'foreign_prediction' FROM p WHERE id >= 20000000""")
def reused_predictions(spark, d):
    original, retained = _states(spark, d)
    i = F.col("id")
    target = lambda other: F.concat(F.lit('{"gold_idx":'), F.when(other, "1.0").otherwise("1"), F.lit(',"soft":null,"option_ids":["a","b"]}')).alias("target")
    original = original.select("id", "state", target(F.lit(False)), F.lit('["yes", "no"]').alias("options"))
    retained = retained.select(F.when(i % 37 == 0, i + 10_000_000).otherwise(i).alias("id"), "state", target(i % 17 == 3))
    run = original.select(F.when(i % 41 == 0, i + 20_000_000).otherwise(i).alias("id"), F.when(i % 19 == 4, '["no", "yes"]').otherwise('["yes","no"]').alias("options"))
    checks = [("input_differs", "retained", ["state"]), ("target_differs", "retained", ["target"]), ("artifact_differs", "run", ["options"])]
    return reconcile.reconciled(retained, original, run, "id", checks)
