"""Queries over decisions: probabilities, metrics, reports, splits and samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import options as O
from ..functions import probs as P
from ..functions.arrays import first_argmax, one_hot
from ..operators import calibrate, dedup, infer, joins, sampling, validate, windows
from ..operators import metrics as M
from .common import DECISIONS, SCORED, SUMMARY, decisions, register, rounded, table


def scored(spark, d):
    return M.scored(decisions(spark, d))


@register(f"WITH {SCORED} SELECT {SUMMARY} FROM s")
def metrics_all(spark, d):
    return rounded(M.summarize(scored(spark, d)))


@register(f"WITH {SCORED} SELECT suite, qtype, {SUMMARY} FROM s GROUP BY suite, qtype")
def metrics_by_suite(spark, d):
    return rounded(M.summarize(scored(spark, d), "suite", "qtype"))


@register(f"WITH {SCORED} SELECT suite, qtype, {SUMMARY}, grouping(suite, qtype)::BIGINT AS level FROM s GROUP BY GROUPING SETS ((), (suite), (qtype), (suite, qtype))")
def metrics_report_grouping_sets(spark, d):
    return rounded(M.report(scored(spark, d), [[], ["suite"], ["qtype"], ["suite", "qtype"]], ["suite", "qtype"]))


@register(f"WITH {DECISIONS} SELECT suite, status, count(*) AS n FROM d GROUP BY suite, status")
def status_counts(spark, d):
    counts = M.status_counts(decisions(spark, d), "suite")
    return counts.select("suite", F.explode("status_counts").alias("status", "n"))


_ECE = "round(sum(CASE WHEN b >= 0 THEN abs(c - h) ELSE 0 END) / sum(n), 8)"


@register(f"WITH {SCORED}, b AS (SELECT suite, ceil(confidence * 15) - 1 AS b, count(*) AS n, sum(confidence) AS c, sum(correct::INT) AS h FROM s WHERE correct IS NOT NULL GROUP BY 1, 2) SELECT suite, sum(n)::BIGINT AS n, {_ECE} AS ece FROM b GROUP BY suite")
def metrics_ece_right(spark, d):
    return rounded(M.ece(scored(spark, d), ["suite"]))


@register(f"WITH {SCORED}, b AS (SELECT suite, least(14, floor(confidence * 15)) AS b, count(*) AS n, sum(confidence) AS c, sum(correct::INT) AS h FROM s WHERE correct IS NOT NULL GROUP BY 1, 2) SELECT suite, sum(n)::BIGINT AS n, {_ECE} AS ece FROM b GROUP BY suite")
def metrics_ece_floor(spark, d):
    return rounded(M.ece(scored(spark, d), ["suite"], closed="left"))


@register(f"WITH {SCORED}, b AS (SELECT suite, least(9, floor(confidence * 10)) AS b, count(*) AS n, sum(confidence) AS c, sum(correct::INT) AS h FROM s WHERE correct IS NOT NULL GROUP BY 1, 2) SELECT suite, sum(n)::BIGINT AS n, {_ECE} AS ece FROM b GROUP BY suite")
def metrics_ece_ten(spark, d):
    return rounded(M.ece(scored(spark, d), ["suite"], 10, "left"))


@register(f"""WITH {SCORED}, l AS (SELECT suite, correct, unnest(list_distinct([gold_idx, pred_idx])) AS label FROM s WHERE correct IS NOT NULL),
f AS (SELECT suite, label, count(*) FILTER (correct) AS tp, count(*) FILTER (NOT correct) AS wrong FROM l GROUP BY 1, 2)
SELECT suite, round(avg(2.0 * tp / greatest(1, 2 * tp + wrong)), 8) AS macro_f1, count(*) AS n_labels FROM f GROUP BY suite""")
def metrics_macro_f1(spark, d):
    return rounded(M.macro_f1(scored(spark, d), ["suite"]))


@register(f"""WITH {SCORED}, r AS (SELECT suite, correct, row_number() OVER (PARTITION BY suite ORDER BY confidence DESC, id) AS r, count(*) OVER (PARTITION BY suite) AS n FROM s WHERE correct IS NOT NULL)
SELECT suite, round(avg(correct::INT), 8) AS accuracy_at, count(*) AS n FROM r WHERE r <= greatest(1, n // 2) GROUP BY suite""")
def metrics_acc_at_50(spark, d):
    return rounded(M.accuracy_at(scored(spark, d), ["suite"], "id"))


@register(f"""WITH {SCORED}, full_n AS (SELECT group_id, count(*) + CASE WHEN group_id % 9 = 0 THEN 1 ELSE 0 END AS full_n FROM d GROUP BY 1),
g AS (SELECT group_id, count(*) AS n, count(gold_idx) AS g, bool_and(coalesce(attempt_correct, false)) AS a FROM s GROUP BY 1),
w AS (SELECT g.*, coalesce(n = full_n AND g.g = n, false) AS fit FROM g LEFT JOIN full_n USING (group_id))
SELECT round(avg(CASE WHEN fit THEN a::INT END), 8) AS group_complete_accuracy, count(*) FILTER (fit) AS n_groups_eligible, count(*) FILTER (NOT fit) AS n_groups_excluded FROM w""")
def metrics_group_complete(spark, d):
    rows = scored(spark, d)
    # Every ninth group is said to have one row more than it has.
    sizes = rows.groupBy("group_id").agg((F.count(F.lit(1)) + F.when(F.col("group_id") % 9 == 0, 1).otherwise(0)).alias("full_n"))
    return rounded(M.group_complete(rows, sizes))


@register(f"""WITH {SCORED}, c AS (SELECT suite, count(*) AS n, count(*) FILTER (pred_idx = 1 AND gold_idx = 1) AS tp, count(*) FILTER (pred_idx = 1 AND gold_idx = 0) AS fp, count(*) FILTER (pred_idx = 0 AND gold_idx = 1) AS fn
FROM s WHERE qtype = 'noul' AND correct IS NOT NULL GROUP BY suite)
SELECT *, round(tp::DOUBLE / nullif(tp + fp, 0), 8) AS "precision", round(tp::DOUBLE / nullif(tp + fn, 0), 8) AS recall, round(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 8) AS f1 FROM c""")
def metrics_noul_prf(spark, d):
    return rounded(M.noul_prf(scored(spark, d), "suite"))


@register(f"""WITH {DECISIONS}, e AS (SELECT *, list_sum(list_transform(range(k), lambda i: i * probs[i + 1])) AS x, list_sum(list_transform(range(k), lambda i: i * soft[i + 1])) AS y FROM d WHERE qtype = 'score' AND status = 'ok')
SELECT suite, round(avg(abs(x - gold_idx)), 8) AS mae_hard, round(avg((abs(x - gold_idx) <= 1.0)::INT), 8) AS within_one, round(avg(abs(x - y)), 8) AS mae_soft, count(gold_idx) AS n_hard, count(soft) AS n_soft FROM e GROUP BY suite""")
def metrics_level_errors(spark, d):
    return rounded(M.level_errors(decisions(spark, d), "suite"))


@register(f"""WITH {DECISIONS} SELECT suite, round(avg(list_sum(list_transform(range(1, k + 1), lambda i: probs[i] * soft[i]))), 8) AS soft_accuracy,
round(avg(list_sum(list_transform(range(1, k + 1), lambda i: pow(probs[i] - soft[i], 2)))), 8) AS brier_vs_soft, count(*) AS n_soft FROM d WHERE soft IS NOT NULL AND status = 'ok' GROUP BY suite""")
def metrics_soft_accuracy(spark, d):
    return rounded(M.soft_accuracy(decisions(spark, d), "suite"))


@register(f"WITH {SCORED} SELECT suite, round(avg(probs[gold_idx + 1]), 8) AS mean_gold_probability, count(*) AS n FROM s WHERE correct IS NOT NULL GROUP BY suite")
def metrics_one_hot(spark, d):
    return rounded(M.one_hot_metrics(scored(spark, d), "suite"))


@register(f"""WITH {SCORED}, g AS (SELECT suite, avg(correct::INT) AS accuracy, avg(nll) AS nll, count(correct) AS n_hard FROM s GROUP BY suite)
SELECT count(*) AS n_suites, sum(n_hard)::BIGINT AS n, round(avg(accuracy), 8) AS macro_accuracy, round(avg(nll), 8) AS macro_nll, round(sum(accuracy * n_hard) / sum(n_hard), 8) AS weighted_accuracy, round(sum(nll * n_hard) / sum(n_hard), 8) AS weighted_nll FROM g""")
def macro_suite_mean(spark, d):
    return rounded(M.suite_means(M.summarize(scored(spark, d), "suite"), ["accuracy", "nll"], "n_hard"))


@register(f"""WITH {SCORED}, g AS (SELECT group_id % 14 AS language, avg(correct::INT) AS accuracy FROM s GROUP BY 1)
SELECT round(avg(accuracy), 8) AS macro_accuracy, count(*) FILTER (accuracy > 0.2) AS n_above_random, count(*) AS n FROM g""")
def above_random(spark, d):
    rows = scored(spark, d).withColumn("language", F.col("group_id") % 14)
    return rounded(M.above_random(M.summarize(rows, "language"), "accuracy", 0.2))


@register(f"""WITH {DECISIONS}, x AS (SELECT suite, k, list_max(soft) AS m, soft, unnest(range(k)) AS place FROM d WHERE soft IS NOT NULL)
SELECT suite, place::INT AS place, round(sum(soft[place + 1]), 6) AS mass, count(*) FILTER (soft[place + 1] = m) AS n_argmax, count(*) AS n FROM x GROUP BY 1, 2""")
def target_statistics_ties(spark, d):
    return rounded(M.target_statistics(decisions(spark, d), "soft", "suite"), 6)


@register(f"WITH {DECISIONS} SELECT suite, qtype, count(*) AS decisions, count(DISTINCT group_id) AS groups, array_to_string(list_sort(list(DISTINCT k)), ',') AS option_counts, count(DISTINCT gold_idx) AS gold_classes FROM d GROUP BY 1, 2")
def suite_coverage(spark, d):
    return M.suite_coverage(decisions(spark, d)).withColumn("option_counts", F.array_join(F.col("option_counts").cast("array<string>"), ","))


@register(f"""WITH {DECISIONS} SELECT id, list_position(probs, list_max(probs))::INT - 1 AS pred, round(list_sort(probs)[-1] - list_sort(probs)[-2], 10) AS gap,
round(CASE WHEN k < 2 THEN 1 ELSE greatest(0, least(1, 1 - list_sum(list_transform(probs, lambda x: -x * ln(x))) / ln(k))) END, 8) AS confidence,
qtype || ':' || CASE WHEN k <= 2 THEN '2' WHEN k <= 5 THEN '3-5' WHEN k <= 10 THEN '6-10' ELSE '11+' END AS bucket FROM d""")
def choice_argmax_confidence(spark, d):
    rows = decisions(spark, d)
    p = F.col("probs")
    return rows.select("id", first_argmax(p).alias("pred"), F.round(P.top_gap(p)["gap"], 10).alias("gap"), F.round(P.confidence(p), 8).alias("confidence"), P.temperature_bucket(F.col("qtype"), F.size(p)).alias("bucket"))


_LOGITS = "list_transform(range(k), lambda i: ((id * (i + 2) * 31) % 200 - 100) / 25::DOUBLE)"


def logits(rows):
    return rows.withColumn("logits", F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: ((F.col("id") * (i + 2) * 31) % 200 - 100) / F.lit(25.0)))


@register(f"""WITH {DECISIONS}, z AS (SELECT id, k, {_LOGITS} AS z FROM d), u AS (SELECT id, k, list_transform(z, lambda x: exp((x - list_max(z)) / 1.7)) AS u FROM z),
v AS (SELECT id, unnest(range(k)) AS i, unnest(list_transform(u, lambda x: x / list_sum(u))) AS p FROM u) SELECT id, i::INT AS i, round(p, 8) AS p FROM v""")
def choice_softmax(spark, d):
    rows = logits(decisions(spark, d))
    return rounded(rows.select("id", F.posexplode(P.softmax(F.col("logits"), 1.7)).alias("i", "p")))


@register(f"""WITH {DECISIONS}, z AS (SELECT id, k, {_LOGITS} AS z FROM d), u AS (SELECT id, list_transform(z, lambda x: exp((x - list_max(z)) * 2.5 / 0.5)) AS u FROM z)
SELECT id, round(list_max(u) / list_sum(u), 8) AS top, CASE WHEN id % 3 = 0 THEN 0.5 WHEN id % 3 = 1 THEN 5.0 ELSE 1.0 END::DOUBLE AS clamped FROM u""")
def temperature_rescale(spark, d):
    rows = logits(decisions(spark, d))
    raw = F.when(F.col("id") % 3 == 0, F.lit(0.1)).when(F.col("id") % 3 == 1, F.lit(9.0)).otherwise(F.lit(float("nan")))
    return rounded(rows.select("id", F.array_max(P.reheated(F.col("logits"), 2.5, 0.5)).alias("top"), P.clamped_temperature(raw).alias("clamped")).withColumn("top", F.col("top")))


@register(f"""WITH {DECISIONS}, z AS (SELECT id, qtype, k, {_LOGITS} AS z FROM d),
y AS (SELECT id, qtype, CASE WHEN qtype = 'noul' THEN [-z[1], z[1]] ELSE list_transform(z, lambda x: 2 * x) END AS l FROM z), u AS (SELECT id, qtype, list_transform(l, lambda x: exp(x - list_max(l))) AS u FROM y)
SELECT id, round(u[1] / list_sum(u), 8) AS first, round(u[-1] / list_sum(u), 8) AS last FROM u""")
def yes_no_readout(spark, d):
    rows = logits(decisions(spark, d)).withColumn("pairs", F.transform("logits", lambda z: F.struct(z.alias("yes"), (-z).alias("no"))))
    p = rows.select("id", P.yes_no_readout(F.col("pairs"), F.col("qtype")).alias("p"))
    return rounded(p.select("id", F.col("p")[0].alias("first"), F.element_at("p", -1).alias("last")))


@register(None)
def temperature_fit(spark, d):
    rows = logits(decisions(spark, d)).where("gold_idx IS NOT NULL")
    return spark.createDataFrame([calibrate.fit_temperature(rows)])


@register(None)
def bootstrap_means(spark, d):
    return calibrate.bootstrap(scored(spark, d).where("nll IS NOT NULL"), "group_id", "nll")


@register(f"""WITH {DECISIONS}, c AS (SELECT count(DISTINCT group_id) AS n FROM d) SELECT unnest(range(300)) AS draw, n::BIGINT AS clusters FROM c""")
def bootstrap_clusters(spark, d):
    """Every resample picks as many clusters as there are."""
    return calibrate.bootstrap(decisions(spark, d).withColumn("one", F.lit(1)), "group_id", "one", 300, block=64).select("draw", "clusters")


_TARGET = "coalesce(soft, CASE WHEN gold_idx IS NOT NULL THEN list_transform(range(k), lambda i: CASE WHEN i = gold_idx THEN 1::DOUBLE ELSE 0::DOUBLE END) END)"
_IDS = "CASE WHEN qtype = 'noul' THEN ['false', 'true'] ELSE ['a', 'b', 'c', 'd', 'e'] END"


def _ids() -> Column:
    return F.when(F.col("qtype") == "noul", F.array(F.lit("false"), F.lit("true"))).otherwise(F.array(*[F.lit(x) for x in "abcde"]))


@register(f"""WITH {DECISIONS}, t AS (SELECT suite, qtype, {_IDS} AS ids, {_TARGET} AS t FROM d), e AS (SELECT suite, qtype, t, unnest(ids) AS option_id, unnest(range(len(ids))) AS i FROM t)
SELECT suite, qtype, option_id, count(*) AS displayed, round(coalesce(sum(t[i + 1]), 0), 6) AS target_mass, count(*) FILTER (t[i + 1] = list_max(t)) AS n_argmax FROM e GROUP BY ALL""")
def class_coverage(spark, d):
    rows = decisions(spark, d)
    target = F.coalesce("soft", F.when(F.col("gold_idx").isNotNull(), one_hot(F.col("gold_idx"), F.col("k"))))
    return rounded(M.class_coverage(rows.select("suite", "qtype", _ids().alias("option_ids"), target.alias("target")), "suite", "qtype"), 6)


@register(f"""WITH {DECISIONS}, l AS (SELECT id, group_id, qtype, {_IDS} AS ids, list_transform(probs, lambda x: ln(x) / 2) AS z, [(id % 7) / 4::DOUBLE, (id % 5) / 4::DOUBLE] AS act, 1 + id % 9 AS n FROM d),
p AS (SELECT *, list_transform(z, lambda x: exp(x) / list_sum(list_transform(z, lambda y: exp(y)))) AS p FROM l)
SELECT group_id, id::VARCHAR AS question, qtype AS type, CASE WHEN qtype = 'choice' THEN ids[list_position(p, list_max(p))] END AS choice, CASE WHEN qtype = 'score' THEN round(list_sum(list_transform(range(len(p)), lambda i: i * p[i + 1])), 4) END AS score,
CASE WHEN qtype = 'noul' THEN round(p[2], 4) END AS noul, round(CASE WHEN qtype = 'noul' THEN list_max(p) ELSE 1 + list_sum(list_transform(p, lambda x: x * ln(x))) / ln(len(p)) END, 4) AS confidence,
round(exp(act[1]) / (exp(act[1]) + exp(act[2])), 4) AS act_probability, (sum(n) OVER (PARTITION BY group_id))::BIGINT AS input_tokens FROM p""")
def grouped_answers(spark, d):
    rows = decisions(spark, d)
    asked = rows.select(
        "group_id", F.col("id").cast("string").alias("question"), "qtype", F.transform(_ids(), lambda k: F.struct(k.alias("key"), F.lit(None).cast("string").alias("desc"))).alias("options"), F.transform("probs", lambda x: F.log(x)).alias("logits"),
        F.lit(2.0).alias("temperature"), F.array((F.col("id") % 7) / F.lit(4.0), (F.col("id") % 5) / F.lit(4.0)).alias("act"), (1 + F.col("id") % 9).alias("n_tokens"),
    )
    each = infer.answers(asked, "group_id", "question").select("group_id", "input_tokens", F.explode("answers").alias("question", "a"))
    return each.select("group_id", "question", *[F.col("a")[c].alias(c) for c in ("type", "choice", "score", "noul", "confidence", "act_probability")], "input_tokens")


@register("""WITH k AS (SELECT o_orderkey AS id, o_orderstatus || '|' || o_orderpriority || '|' || (o_orderkey % 3 = 0) || '|' || o_custkey AS key, CASE WHEN o_orderkey % 41 = 7 THEN 'b' ELSE 'a' END AS t FROM orders),
f AS (SELECT key, min(id) AS first, arg_min(t, id) AS ft FROM k GROUP BY key), m AS (SELECT k.*, first, t = ft AS target_same FROM k JOIN f USING (key))
SELECT id, CASE WHEN NOT bool_and(target_same) OVER (PARTITION BY key) THEN 'quarantine' WHEN id = first THEN 'retain' ELSE 'exclude' END AS decision, first AS canonical, target_same FROM m""")
def within_duplicates(spark, d):
    """Equal decisions in one benchmark: strings in other case and spacing are equal, keys in another order aren't."""
    i = F.col("o_orderkey")
    pair = lambda k, v: F.concat(F.lit(f'"{k}":"'), v, F.lit('"'))
    status = pair("status", F.when(i % 2 == 0, F.concat(F.lit("  "), F.lower("o_orderstatus"))).otherwise(F.col("o_orderstatus")))
    customer = F.concat(F.lit('"customer":'), F.col("o_custkey"))
    state = F.concat(F.lit("{"), F.when(i % 3 == 0, F.concat_ws(",", customer, status)).otherwise(F.concat_ws(",", status, customer)), F.lit("}"))
    rows = table(spark, d, "orders").select(i.alias("id"), state.alias("state"), F.concat(F.lit("{"), pair("instructions", F.col("o_orderpriority")), F.lit("}")).alias("question"), F.when(i % 41 == 7, "b").otherwise("a").alias("target"))
    return dedup.within_benchmark(rows, "id", "id", "state", "question", "target").select("id", "decision", "canonical", "target_same")


@register("""WITH o AS (SELECT n_name AS label, r_name AS domain FROM nation JOIN region ON n_regionkey = r_regionkey),
c AS (SELECT c_custkey AS id, n_name AS target, [2, 4, 8, 16, 25][(row_number() OVER (ORDER BY sha256('k|' || c_custkey), c_custkey) - 1) % 5 + 1] AS k, ('0x' || sha256('side|' || c_custkey)[1:8])::BIGINT % 2 = 1 AS clustered FROM customer JOIN nation ON n_nationkey = c_nationkey),
l AS (SELECT id, target, k, clustered, list(label ORDER BY CASE WHEN clustered THEN sha256('s|' || id || '|domain|' || domain) ELSE '' END, sha256('s|' || id || '|' || label), label) AS l FROM c, o GROUP BY ALL),
p AS (SELECT *, (list_position(l, target) - 1 - ('0x' || sha256('s|' || id || '|back')[1:8])::BIGINT % k + 25) % 25 AS s FROM l)
SELECT id, k::INT AS k, clustered, array_to_string((l || l)[s + 1:s + k], ',') AS candidates FROM p""")
def balanced_candidates(spark, d):
    """Every size for as many rows as any other; candidates are a window of all nations, region by region for one half of the rows."""
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    # The ontology, a stated list.
    labels = F.array(*[F.struct(F.lit(r["n_name"]).alias("label"), F.lit(r["r_name"]).alias("domain")) for r in nations.collect()])
    rows = table(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), F.col("n_name").alias("target"))
    sized = sampling.balanced(rows, "id", [2, 4, 8, 16, 25], "k", "k").withColumn("clustered", F.conv(F.left(sampling.drawn("side", "id"), F.lit(8)), 16, 10).cast("long") % 2 == 1)
    salt = (F.lit("s"), F.col("id").cast("string"))
    window = O.window_of(F.col("target"), O.directory(labels, F.col("clustered"), *salt), F.col("k"), *salt)
    return sized.select("id", "k", "clustered", F.array_join(window, ",").alias("candidates"))


@register(f"WITH {DECISIONS}, r AS (SELECT id, suite, row_number() OVER (PARTITION BY suite ORDER BY id) AS r FROM d) SELECT id, suite FROM r WHERE r <= 25")
def suite_prefix(spark, d):
    return windows.suite_prefix(decisions(spark, d).select("id", "suite"), "suite", ["id"], 25)


@register(f"WITH {DECISIONS} SELECT id, suite, (row_number() OVER (PARTITION BY suite ORDER BY id) - 1) // 32 AS batch FROM d")
def batch_windows(spark, d):
    return windows.batch_windows(decisions(spark, d).select("id", "suite"), "suite", ["id"], 32)


@register("""WITH RECURSIVE t AS (SELECT lang AS suite, doc_id, length(text)::BIGINT AS tokens, row_number() OVER (PARTITION BY lang ORDER BY length(text), doc_id) AS r FROM documents WHERE text IS NOT NULL),
b AS (SELECT suite, doc_id, tokens, r, 0::BIGINT AS batch, 1 AS n FROM t WHERE r = 1 UNION ALL
SELECT t.suite, t.doc_id, t.tokens, t.r, b.batch + CASE WHEN (b.n + 1) * t.tokens > 20000 OR b.n >= 64 THEN 1 ELSE 0 END, CASE WHEN (b.n + 1) * t.tokens > 20000 OR b.n >= 64 THEN 1 ELSE b.n + 1 END FROM b JOIN t ON t.suite = b.suite AND t.r = b.r + 1)
SELECT suite, doc_id, tokens, batch FROM b""")
def token_budget_batches(spark, d):
    rows = table(spark, d, "documents").select(F.col("lang").alias("suite"), "doc_id", F.length("text").cast("long").alias("tokens")).where("tokens IS NOT NULL")
    return windows.token_batches(rows, "suite", "doc_id", "tokens", 20_000, 64)


@register("""WITH t AS (SELECT o_custkey AS episode, o_orderkey AS step, (o_orderkey % 10) / 10::DOUBLE AS p, (o_orderkey % 2)::DOUBLE AS y FROM orders)
SELECT episode, step, last_value(y) OVER (PARTITION BY episode ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS td_target FROM t""")
def td_lambda(spark, d):
    return windows.td_targets(_episodes(spark, d), "episode", "step", "p", "y").select("episode", "step", "td_target")


def _episodes(spark, d):
    i = F.col("o_orderkey")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("episode"), i.alias("step"), ((i % 10) / F.lit(10.0)).alias("p"), (i % 2).cast("double").alias("y"))


@register("""WITH RECURSIVE t AS (SELECT o_custkey AS episode, o_orderkey AS step, (o_orderkey % 8) / 8::DOUBLE AS p, (o_orderkey % 2)::DOUBLE AS y,
row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders),
g AS (SELECT episode, step, r, p, y AS g FROM t WHERE r = 1 UNION ALL SELECT t.episode, t.step, t.r, t.p, 0.5::DOUBLE * g.p + 0.5::DOUBLE * g.g FROM t JOIN g ON t.episode = g.episode AND t.r = g.r + 1)
SELECT episode, step, g AS td_target FROM g""")
def td_lambda_decayed(spark, d):
    rows = _episodes(spark, d).withColumn("p", (F.col("step") % 8) / F.lit(8.0))
    return windows.td_targets(rows, "episode", "step", "p", "y", 0.5).select("episode", "step", "td_target")


_BAD = """CASE WHEN id % 13 = 0 THEN list_transform(probs, lambda x: x * 1.5) WHEN status <> 'ok' AND id % 2 = 0 THEN NULL ELSE probs END"""


@register(f"""WITH {DECISIONS}, b AS (SELECT id, status, {_BAD} AS p, list_position(probs, list_max(probs)) - 1 + CASE WHEN id % 17 = 0 THEN 1 ELSE 0 END AS pred FROM d)
SELECT (CASE WHEN status = 'ok' AND NOT coalesce(abs(list_sum(p) - 1) <= 1.001e-5 AND list_max(p) <= 1, false) THEN 1 ELSE 0 END + CASE WHEN status = 'ok' AND NOT coalesce(pred = list_position(p, list_max(p)) - 1, false) THEN 2 ELSE 0 END
 + CASE WHEN status <> 'ok' AND p IS NOT NULL THEN 4 ELSE 0 END) AS bits, count(*) AS n FROM b GROUP BY 1""")
def prediction_validation(spark, d):
    p = F.when(F.col("id") % 13 == 0, F.transform("probs", lambda x: x * 1.5)).when((F.col("status") != "ok") & (F.col("id") % 2 == 0), None).otherwise(F.col("probs"))
    pred = first_argmax(F.col("raw")) + F.when(F.col("id") % 17 == 0, 1).otherwise(0)
    rows = decisions(spark, d).withColumn("raw", F.col("probs")).withColumn("probs", p).withColumn("pred_idx", F.when((F.col("status") == "ok") | F.col("probs").isNotNull(), pred)).withColumn("length", F.lit(10))
    bad = rows.withColumn("errors", validate.failed(validate.prediction_checks()))
    bits = F.when(F.array_contains("errors", "probs"), 1).otherwise(0) + F.when(F.array_contains("errors", "pred_idx"), 2).otherwise(0) + F.when(F.array_contains("errors", "unsupported_empty"), 4).otherwise(0)
    return bad.groupBy(bits.alias("bits")).agg(F.count(F.lit(1)).alias("n"))


_SIGS = "SELECT group_id, string_agg(DISTINCT suite, ',' ORDER BY suite) AS sig FROM d GROUP BY 1"


@register(f"""WITH {DECISIONS}, g AS ({_SIGS}), r AS (SELECT group_id, row_number() OVER (PARTITION BY sig ORDER BY sha256('7|' || group_id)) AS i, count(*) OVER (PARTITION BY sig) AS n FROM g),
h AS (SELECT *, CASE WHEN n >= 3 THEN greatest(1, n // 12) ELSE 0 END AS h FROM r)
SELECT d.id, d.group_id, CASE WHEN i <= h THEN 'dev' WHEN i <= 2 * h THEN 'test' ELSE 'train' END AS split FROM d JOIN h USING (group_id)""")
def group_split(spark, d):
    return sampling.grouped_split(decisions(spark, d).select("id", "group_id", "suite"), "group_id", "suite", "7").select("id", "group_id", "split")


@register("""WITH g AS (SELECT DISTINCT o_custkey AS g FROM orders), r AS (SELECT g, row_number() OVER (ORDER BY sha256('3|' || g), g) AS i, count(*) OVER () AS n FROM g)
SELECT g, CASE WHEN i <= round_even(n * 100 / 1100::DOUBLE, 0) THEN 'dev' ELSE 'train' END AS split FROM r""")
def proportional_split(spark, d):
    groups = table(spark, d, "orders").select(F.col("o_custkey").alias("g")).distinct()
    return sampling.proportional_split(groups, "g", 1000, 100, "3").select("g", "split")


@register("SELECT c_custkey, c_nationkey FROM (SELECT c_custkey, c_nationkey FROM customer ORDER BY sha256('11|' || c_custkey), c_custkey LIMIT 200)")
def reservoir_hash(spark, d):
    return sampling.reservoir(table(spark, d, "customer", "c_custkey", "c_nationkey"), "c_custkey", 200, "11")


@register("SELECT c_nationkey, c_custkey FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256('5|' || c_custkey), c_custkey) AS r FROM customer) WHERE r = 1")
def one_per_group(spark, d):
    return sampling.one_per_group(table(spark, d, "customer", "c_nationkey", "c_custkey"), "c_nationkey", "c_custkey", "5")


@register("SELECT c_nationkey, c_custkey FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256('6|' || c_custkey), c_custkey) AS r FROM customer) WHERE r <= 8")
def view_cap(spark, d):
    return sampling.view_cap(table(spark, d, "customer", "c_nationkey", "c_custkey"), "c_nationkey", "c_custkey", 8, "6")


@register("""WITH c AS (SELECT * FROM (SELECT c_custkey, c_mktsegment, c_nationkey, c_custkey // 3 AS record, row_number() OVER (PARTITION BY c_custkey // 3 ORDER BY sha256('9|view|' || c_custkey), c_custkey) AS q FROM customer) WHERE q <= 2),
v AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY sha256('9|' || c_custkey), c_custkey) AS v FROM c),
t AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY v, sha256('9|' || c_nationkey), c_nationkey) AS turn FROM v)
SELECT c_custkey, c_mktsegment, turn FROM t ORDER BY turn, sha256('9|' || c_mktsegment), c_mktsegment LIMIT 300""")
def round_robin_strata(spark, d):
    rows = table(spark, d, "customer", "c_custkey", "c_mktsegment", "c_nationkey").withColumn("record", F.floor(F.col("c_custkey") / 3))
    return sampling.round_robin(rows, "c_mktsegment", "c_nationkey", "record", "c_custkey", 300, "9").select("c_custkey", "c_mktsegment", F.col("turn").cast("long").alias("turn"))


@register("""WITH q AS (SELECT n_nationkey AS c_nationkey, 10 + n_nationkey * 7 AS quota FROM nation), r AS (SELECT c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer),
k AS (SELECT c_nationkey, count(*) AS n FROM r JOIN q USING (c_nationkey) WHERE r <= quota GROUP BY 1)
SELECT c_nationkey, quota, coalesce(n, 0) AS n, quota - coalesce(n, 0) AS missing FROM q LEFT JOIN k USING (c_nationkey)""")
def quota_select(spark, d):
    quotas = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), (10 + F.col("n_nationkey") * 7).alias("quota"))
    return sampling.quota_select(table(spark, d, "customer", "c_nationkey", "c_custkey"), ["c_nationkey"], ["c_custkey"], quotas)[1]


@register("SELECT c_custkey, ['yes', 'no', 'maybe'][((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 + 1) % 3 + 1)::INT] AS task FROM customer")
def alternating_schedule(spark, d):
    return sampling.alternating(table(spark, d, "customer", "c_custkey", "c_nationkey"), ["c_nationkey"], ["c_custkey"], ["yes", "no", "maybe"], "task", 1).select("c_custkey", "task")


@register("SELECT s_suppkey FROM supplier WHERE (SELECT count(*) FROM supplier) % 2 = 0 OR s_suppkey < (SELECT max(s_suppkey) FROM supplier)")
def parity_trim(spark, d):
    return sampling.even_count(table(spark, d, "supplier", "s_suppkey"), "s_suppkey")


@register("""WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS r FROM customer)
SELECT c_custkey, c_mktsegment FROM r WHERE r <= 3 ORDER BY r, c_mktsegment LIMIT 30""")
def review_sample(spark, d):
    return sampling.review_sample(table(spark, d, "customer", "c_custkey", "c_mktsegment"), ["c_mktsegment"], ["c_custkey"])


@register("""WITH g AS (SELECT o_custkey AS g, min(o_orderstatus) AS stratum, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('4|' || g), g) AS t, sha256('4|' || stratum) AS s FROM g),
r AS (SELECT *, row_number() OVER (ORDER BY t, s, stratum) AS r FROM t), c AS (SELECT *, sum(n) OVER (ORDER BY r) AS total FROM r WHERE r <= 500) SELECT g, stratum, n FROM c WHERE total <= 500""")
def stratified_spread(spark, d):
    groups = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("g")).agg(F.min("o_orderstatus").alias("stratum"), F.count(F.lit(1)).alias("n"))
    return sampling.spread(groups, "g", "stratum", "n", 500, "4")


@register(f"""WITH {DECISIONS}, a AS (SELECT CASE WHEN id % 29 = 0 THEN 'a' ELSE '' END || id AS id, probs FROM d), b AS (SELECT CASE WHEN id % 37 = 0 THEN 'b' ELSE '' END || id AS id, CASE WHEN id % 31 = 0 THEN list_reverse(probs) ELSE probs END AS probs FROM d),
j AS (SELECT a.id AS x, b.id AS y, a.probs AS p, b.probs AS q FROM a FULL JOIN b ON a.id = b.id),
g AS (SELECT *, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN list_transform(range(1, len(p) + 1), lambda i: abs(p[i] - q[i])) END AS gaps FROM j)
SELECT count(*) FILTER (x IS NULL) AS missing, count(*) FILTER (y IS NULL) AS extra, 0::BIGINT AS shape_differs, count(gaps) AS compared, round(max(list_max(gaps)), 8) AS max_abs, round(sum(list_sum(gaps)) / sum(len(gaps)), 8) AS mean_abs,
count(*) FILTER (gaps IS NOT NULL AND list_position(p, list_max(p)) <> list_position(q, list_max(q))) AS argmax_differs FROM g""")
def pred_compare(spark, d):
    rows = decisions(spark, d).select("id", "probs")
    # Some ids are unknown to the other side.
    named = lambda side, every: F.concat(F.when(F.col("id") % every == 0, side).otherwise(""), F.col("id").cast("string")).alias("id")
    other = rows.select(named("b", 37), F.when(F.col("id") % 31 == 0, F.reverse("probs")).otherwise(F.col("probs")).alias("probs"))
    return rounded(joins.compare_predictions(rows.select(named("a", 29), "probs"), other, ["id"]))


@register("""WITH r AS (SELECT o_orderkey AS id, (o_orderkey // 4) % 3 AS model, (o_orderkey % 29 <> 0) AS ok FROM orders), x AS (SELECT id // 12 AS id, model, bool_and(ok) AS ok FROM r GROUP BY 1, 2)
SELECT id FROM x GROUP BY id HAVING count(*) FILTER (ok) = 3""")
def common_success(spark, d):
    i = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(F.floor(i / 12).alias("id"), (F.floor(i / 4) % 3).alias("model"), (i % 29 != 0).alias("ok"))
    return joins.common_success(rows.groupBy("id", "model").agg(F.bool_and("ok").alias("ok")), 3)


@register(f"""WITH {DECISIONS}, k AS (SELECT id, group_id, (id // 5) % 1000 AS key, gold_idx FROM d),
n AS (SELECT key, min(gold_idx) <> max(gold_idx) OR (count(gold_idx) > 0 AND count(gold_idx) < count(*)) AS clash, min(id) AS f FROM k GROUP BY key)
SELECT id, CASE WHEN coalesce(clash, false) THEN 'quarantine' WHEN id = f THEN 'retain' ELSE 'exclude' END AS decision, f AS canonical FROM k JOIN n USING (key)""")
def dup_conflict_quarantine(spark, d):
    rows = decisions(spark, d).select("id", (F.floor(F.col("id") / 5) % 1000).alias("key"), "gold_idx")
    return dedup.conflict_decisions(rows, "key", ["id"], "gold_idx").select("id", "decision", "canonical")
