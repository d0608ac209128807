"""What the registered queries share: tables, rounding, and decisions made from `orders`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
SQL: dict = {}


def register(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return rows.select(*columns) if columns else rows


def rounded(rows: DataFrame, digits: int = 8) -> DataFrame:
    """Doubles rounded, so that the order of sums doesn't show."""
    return rows.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])


def _weights(k: Column, step: int, prime: int, size: int) -> Column:
    w = F.transform(F.sequence(F.lit(0), k - 1), lambda i: (1 + (F.col("id") * (i + step) * prime) % size).cast("double"))
    total = F.aggregate(w, F.lit(0.0), lambda a, x: a + x)
    return F.transform(w, lambda x: x / total)


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions with probabilities and targets made by arithmetic from `orders`."""
    orders = table(spark, sf_dir, "orders")
    i = F.col("o_orderkey")
    base = orders.select(
        i.alias("id"), F.col("o_custkey").alias("group_id"), F.col("o_orderstatus").alias("suite"),
        F.when(i % 3 == 0, "choice").when(i % 3 == 1, "score").otherwise("noul").alias("qtype"), F.when(i % 3 == 2, 2).otherwise(5).alias("k"),
        F.when(i % 11 == 5, "unsupported_length").otherwise("ok").alias("status"), (F.left("o_orderpriority", F.lit(1)).cast("int") - 1).alias("prio"),
    )
    rows = base.withColumn("probs", _weights(F.col("k"), 3, 7919, 97)).withColumn("soft", F.when(F.col("id") % 4 == 0, _weights(F.col("k"), 5, 104729, 89)))
    gold = F.when(F.col("id") % 7 == 3, None).when(F.col("k") == 2, (F.floor(F.col("id") / 7) % 2).cast("int")).otherwise(F.col("prio"))
    score = F.when((F.col("qtype") == "score") & (F.col("id") % 10 == 1), (F.col("id") % 41) / F.lit(10.0))
    return rows.withColumn("gold_idx", gold).withColumn("gold_score", score).drop("prio")


DECISIONS = """
base AS (
  SELECT o_orderkey AS id, o_custkey AS group_id, o_orderstatus AS suite,
         CASE o_orderkey % 3 WHEN 0 THEN 'choice' WHEN 1 THEN 'score' ELSE 'noul' END AS qtype,
         CASE WHEN o_orderkey % 3 = 2 THEN 2 ELSE 5 END AS k,
         CASE WHEN o_orderkey % 11 = 5 THEN 'unsupported_length' ELSE 'ok' END AS status,
         o_orderpriority[1]::INT - 1 AS prio
  FROM orders
), weights AS (
  SELECT *, list_transform(range(k), lambda i: (1 + (id * (i + 3) * 7919) % 97)::DOUBLE) AS w,
         list_transform(range(k), lambda i: (1 + (id * (i + 5) * 104729) % 89)::DOUBLE) AS v FROM base
), d AS (
  SELECT id, group_id, suite, qtype, k, status, list_transform(w, lambda x: x / list_sum(w)) AS probs,
         CASE WHEN id % 4 = 0 THEN list_transform(v, lambda x: x / list_sum(v)) END AS soft,
         CASE WHEN id % 7 = 3 THEN NULL WHEN k = 2 THEN ((id // 7) % 2)::INT ELSE prio END AS gold_idx,
         CASE WHEN qtype = 'score' AND id % 10 = 1 THEN (id % 41) / 10::DOUBLE END AS gold_score
  FROM weights
)"""

#: Contributions of each row, as in operators.metrics.scored.
SCORED = DECISIONS + """, e AS (
  SELECT *, CASE WHEN status = 'ok' THEN probs END AS p, CASE WHEN status = 'ok' THEN list_position(probs, list_max(probs)) - 1 END AS pred_idx,
         CASE WHEN status = 'ok' THEN coalesce(soft, CASE WHEN gold_idx IS NOT NULL THEN list_transform(range(k), lambda i: CASE WHEN i = gold_idx THEN 1::DOUBLE ELSE 0::DOUBLE END) END) END AS t
  FROM d
), s AS (
  SELECT *, CASE WHEN gold_idx IS NOT NULL AND p IS NOT NULL THEN pred_idx = gold_idx END AS correct,
         CASE WHEN gold_idx IS NOT NULL THEN status = 'ok' AND coalesce(pred_idx = gold_idx, false) END AS attempt_correct,
         CASE WHEN gold_idx IS NOT NULL AND p IS NOT NULL THEN list_max(p) END AS confidence,
         CASE WHEN gold_idx IS NOT NULL AND p IS NOT NULL THEN list_sum(list_transform(range(k), lambda i: pow(p[i + 1] - CASE WHEN i = gold_idx THEN 1 ELSE 0 END, 2))) END AS brier,
         CASE WHEN gold_idx IS NOT NULL AND p IS NOT NULL THEN -ln(greatest(p[gold_idx + 1], 1e-12)) END AS nll,
         CASE WHEN soft IS NOT NULL AND p IS NOT NULL THEN -list_sum(list_transform(range(1, k + 1), lambda i: soft[i] * ln(greatest(p[i], 1e-12)))) END AS soft_ce,
         CASE WHEN soft IS NOT NULL AND p IS NOT NULL THEN list_sum(list_transform(range(1, k + 1), lambda i: pow(p[i] - soft[i], 2))) END AS soft_brier,
         CASE WHEN qtype = 'noul' AND t IS NOT NULL THEN pow(p[2] - t[2], 2) END AS ptrue_mse,
         CASE WHEN qtype = 'score' AND p IS NOT NULL THEN abs(list_sum(list_transform(range(k), lambda i: i * p[i + 1])) - coalesce(gold_score, list_sum(list_transform(range(k), lambda i: i * t[i + 1])))) END AS score_mae,
         CASE WHEN qtype = 'score' AND t IS NOT NULL THEN list_sum(list_transform(range(1, k), lambda j: pow(list_sum(p[1:j]) - list_sum(t[1:j]), 2))) END AS score_rps,
         CASE WHEN t IS NOT NULL THEN -list_sum(list_transform(range(1, k + 1), lambda i: t[i] * ln(greatest(p[i], 1e-12)))) END AS ce,
         CASE WHEN t IS NOT NULL THEN list_sum(list_transform(range(1, k + 1), lambda i: CASE WHEN t[i] > 0 THEN -t[i] * ln(t[i]) ELSE 0 END)) END AS entropy,
         CASE WHEN t IS NOT NULL THEN list_sum(list_transform(range(1, k + 1), lambda i: t[i] * greatest(ln(greatest(p[i], 1e-12)), -9.21)))
              + 0.5 * list_sum(list_transform(range(1, k + 1), lambda i: t[i] * p[i])) / greatest(sqrt(list_sum(list_transform(p, lambda x: x * x))), 1e-9)
              - CASE WHEN qtype = 'score' THEN list_sum(list_transform(range(1, k + 1), lambda j: pow(list_sum(p[1:j]) - list_sum(t[1:j]), 2))) / greatest(k - 1, 1) ELSE 0 END END AS reward
  FROM e
)"""

SUMMARY = """count(*) AS attempted, count(*) FILTER (status = 'ok') AS completed, round((count(*) FILTER (status = 'ok'))::DOUBLE / nullif(count(*), 0), 8) AS coverage,
  count(correct) AS n_hard, round(avg(correct::INT), 8) AS accuracy, count(attempt_correct) AS attempted_hard, round(avg(attempt_correct::INT), 8) AS all_attempted_accuracy,
  round(avg(confidence), 8) AS mean_confidence, round(avg(brier), 8) AS brier, round(avg(nll), 8) AS nll, round(avg(soft_ce), 8) AS soft_ce, round(avg(soft_brier), 8) AS soft_brier,
  round(avg(ptrue_mse), 8) AS ptrue_mse, round(avg(score_mae), 8) AS score_mae, round(avg(score_rps), 8) AS score_rps, round(avg(score_rps / (k - 1)), 8) AS score_nrps,
  round(avg(ce), 8) AS ce, round(avg(ce - entropy), 8) AS kl, round(avg(reward), 8) AS reward, count(soft_ce) AS n_soft"""
