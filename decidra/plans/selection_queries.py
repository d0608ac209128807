"""Queries of selections that depend on what was selected before."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import coverage, selection, similarity
from ..operators.tables import stored
from .common import DECISIONS, decisions, register, table
from .text_queries import _words

SPREAD_LIMIT, SPREAD_SEED = 500, "spread"


@register(f"""WITH RECURSIVE {DECISIONS},
items AS (SELECT id, group_id, suite, qtype, CASE WHEN soft IS NULL THEN 'hard' ELSE 'soft' END AS kind, k, CASE WHEN qtype = 'score' THEN coalesce(least(2, (3 * gold_idx) // 4), -1) ELSE -1 END AS level FROM d),
g AS (SELECT group_id, count(*) AS size, sha256('{SPREAD_SEED}|' || group_id) AS draw, list_distinct(list([suite, qtype, kind, k::VARCHAR, level::VARCHAR])) AS strata,
      list_distinct(flatten(list(['k=' || k, 'qtype=' || qtype, 'kind=' || kind]))) AS vals FROM items GROUP BY group_id),
least_of AS (SELECT value, arg_min(group_id, (size, draw)) AS g, arg_min(size, (size, draw)) AS size, arg_min(vals, (size, draw)) AS vals FROM (SELECT *, unnest(vals) AS value FROM g) GROUP BY value),
req AS (SELECT *, row_number() OVER (ORDER BY CASE string_split(value, '=')[1] WHEN 'k' THEN 0 WHEN 'qtype' THEN 1 ELSE 2 END, value) AS i FROM least_of),
cov AS (
  SELECT 0::BIGINT AS i, []::BIGINT[] AS sel, []::VARCHAR[] AS seen, {SPREAD_LIMIT}::BIGINT AS rem
  UNION ALL
  SELECT r.i, CASE WHEN list_contains(seen, value) THEN sel ELSE list_append(sel, r.g) END, CASE WHEN list_contains(seen, value) THEN seen ELSE list_concat(seen, vals) END,
         CASE WHEN list_contains(seen, value) THEN rem ELSE rem - size END
  FROM cov JOIN req r ON r.i = cov.i + 1
),
each AS (SELECT group_id, size, draw, unnest(strata) AS key FROM g),
keys AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS at, count(*) OVER () AS nk FROM (SELECT DISTINCT key FROM each)),
turns AS (
  SELECT 0::BIGINT AS i, sel, rem, 0::BIGINT AS idle FROM cov WHERE i = (SELECT max(i) FROM req)
  UNION ALL
  SELECT i + 1, CASE WHEN pick IS NULL THEN sel ELSE list_append(sel, pick) END, rem - coalesce(n, 0), CASE WHEN pick IS NULL THEN idle + 1 ELSE 0 END
  FROM (SELECT t.i, t.sel, t.rem, t.idle, arg_min(e.group_id, e.draw) AS pick, arg_min(e.size, e.draw) AS n
        FROM turns t JOIN keys ON keys.at = t.i % keys.nk AND t.idle < keys.nk LEFT JOIN each e ON e.key = keys.key AND e.size <= t.rem AND NOT list_contains(t.sel, e.group_id)
        GROUP BY t.i, t.sel, t.rem, t.idle)
)
SELECT id, items.group_id FROM items JOIN (SELECT unnest(sel) AS group_id FROM turns WHERE i = (SELECT max(i) FROM turns)) USING (group_id)""")
def covering_spread(spark, d):
    level = F.when(F.col("qtype") == "score", F.coalesce(F.least(F.lit(2), F.floor(3 * F.col("gold_idx") / 4).cast("int")), F.lit(-1))).otherwise(-1)
    items = decisions(spark, d).select("id", "group_id", "suite", "qtype", F.when(F.col("soft").isNull(), "hard").otherwise("soft").alias("kind"), "k", level.alias("level"))
    return coverage.covering_spread(items, "group_id", ["suite", "qtype", "kind", "k", "level"], ["k", "qtype", "kind"], SPREAD_LIMIT, SPREAD_SEED).select("id", "group_id")


@register(f"""WITH RECURSIVE w AS (SELECT doc_id, lang, n_chars, {_words('text')} AS w FROM documents), i AS (SELECT {_words('text')} AS w FROM benchmark),
u AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY w) AS unit, w FROM w),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM u WHERE len(w) >= 12 AND doc_id = unit)), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
h AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
near AS (SELECT a, b FROM h JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c / (x.n + y.n - c)::DOUBLE >= 0.8),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 8)), dn AS (SELECT doc_id, count(*) AS n FROM ds GROUP BY 1),
bu AS (SELECT row_number() OVER () AS u, w FROM i), bs AS (SELECT DISTINCT u, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT u, w, unnest(range(1, len(w) - 1)) AS i FROM bu WHERE len(w) >= 8)), bn AS (SELECT u, count(*) AS n FROM bs GROUP BY 1),
ext AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, u, count(*) AS c FROM ds JOIN bs USING (s) GROUP BY 1, 2) JOIN dn USING (doc_id) JOIN bn USING (u) WHERE c / (dn.n + bn.n - c)::DOUBLE >= 0.85 UNION SELECT doc_id FROM w WHERE w IN (SELECT w FROM i)),
r AS MATERIALIZED (SELECT w.doc_id, lang, n_chars, unit, len(w.w) < 12 AS short, ext.doc_id IS NOT NULL AS ext, row_number() OVER (ORDER BY w.doc_id) AS i, (2 * count(*) OVER (PARTITION BY lang)) // 5 AS quota,
      coalesce(list_append(p.b, unit), [unit]) AS beside
      FROM w JOIN u USING (doc_id) LEFT JOIN ext USING (doc_id) LEFT JOIN (SELECT a, list(b) AS b FROM near GROUP BY a) p ON p.a = unit),
pass AS (
  SELECT 0::BIGINT AS i, NULL::BIGINT AS doc_id, NULL::VARCHAR AS reason, []::BIGINT[] AS units, []::BIGINT[] AS sizes, []::VARCHAR[] AS langs
  UNION ALL
  SELECT i, doc_id, reason, CASE WHEN reason IS NULL THEN list_append(units, unit) ELSE units END, CASE WHEN reason IS NULL THEN list_append(sizes, n_chars) ELSE sizes END, CASE WHEN reason IS NULL THEN list_append(langs, lang) ELSE langs END
  FROM (SELECT r.i, r.doc_id, r.unit, r.n_chars, r.lang, units, sizes, langs,
               CASE WHEN len(list_filter(langs, lambda x: x = r.lang)) >= quota THEN 'quota_surplus' WHEN short THEN 'too_short' WHEN list_contains(sizes, r.n_chars) THEN 'repeated_key' WHEN ext THEN 'external'
                    WHEN list_has_any(units, beside) THEN 'near_duplicate' END AS reason
        FROM pass JOIN r ON r.i = pass.i + 1)
)
SELECT doc_id, reason FROM pass WHERE i > 0""")
def ordered_selection(spark, d):
    # Words are cut once; equal texts are found by digests.
    docs = stored(table(spark, d, "documents").select("doc_id", "lang", "n_chars", T.words(F.col("text")).alias("tokens")).withColumn("digest", F.sha2(F.array_join("tokens", " "), 256)), "docs")
    units = docs.groupBy("digest").agg(F.min("doc_id").alias("unit"))
    named = stored(docs.select("doc_id", "digest").join(units, "digest").select("doc_id", "unit"), "named")
    inside = similarity.firewall(docs.select("doc_id", "tokens"), table(spark, d, "benchmark").select(T.words(F.col("text")).alias("tokens")), "doc_id").select("doc_id", F.lit(True).alias("free"))
    slim = docs.select("doc_id", "lang", "n_chars", F.size("tokens").alias("n"))
    rows = slim.join(named, "doc_id").join(inside, "doc_id", "left").select(
        "doc_id", "lang", "n_chars", "unit", F.when(F.col("n") < 12, "too_short").alias("early"), F.when(F.col("free").isNull(), "external").alias("late")
    )
    quotas = docs.groupBy("lang").agg(F.floor(2 * F.count(F.lit(1)) / 5).alias("quota"))
    firsts = similarity.without_copies(docs.select(F.col("doc_id").alias("unit"), "tokens"), named.where("doc_id <> unit").select("doc_id"), "unit")
    pairs = similarity.jaccard_pairs(firsts, "unit")
    return selection.in_order(rows, "doc_id", "lang", quotas, ["n_chars"], "unit", pairs, "early", "late").select("doc_id", "reason")
