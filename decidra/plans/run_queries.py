"""Queries that run a model: in collated batches, and as a log that grows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import options as O
from ..functions.lang import FUNCTION_WORDS
from ..operators import infer
from ..operators.tables import shared_root
from ..streaming import progress
from .common import register, table
from .operator_queries import _fresh

MAX_TOKENS, MAX_ROWS, LIMIT = 6000, 16, 2000


LANGUAGES = ("en", "fr", "de", "es")


def _scorer():
    """Which language a text is in, by function words."""
    return infer.WordScorer({n: set(FUNCTION_WORDS[n].split()) for n in LANGUAGES}, LIMIT)


def _asked(docs):
    options = O.from_list(F.array(*[F.lit(x) for x in LANGUAGES]))
    state = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("suite"), state.alias("state"), F.lit("choice").alias("qtype"), options.alias("options"), F.regexp_count(state, F.lit(r"\S+")).alias("n"))


_HITS = ", ".join("1 + len(list_filter(w, lambda x: list_contains([" + ", ".join(f"'{x}'" for x in FUNCTION_WORDS[n].split()) + "], x)))" for n in LANGUAGES)


@register(rf"""WITH d AS (SELECT doc_id::VARCHAR AS id, lang AS suite, len(regexp_extract_all(coalesce(text, ''), '\S+'))::INT AS n, regexp_extract_all(lower(coalesce(text, '')), '\p{{L}}+') AS w FROM documents), h AS (SELECT *, [{_HITS}] AS hits FROM d)
SELECT id, suite, CASE WHEN n > {LIMIT} THEN 'unsupported_length' ELSE 'ok' END AS status, n AS length, CASE WHEN n <= {LIMIT} THEN list_position(hits, list_max(hits)) - 1 END AS pred_idx, CASE WHEN n <= {LIMIT} THEN round(list_max(hits) / list_sum(hits)::DOUBLE, 8) END AS confidence, 0 AS n_errors FROM h""")
def infer_protocol(spark, d):
    found = infer.checked(infer.predict(_asked(table(spark, d, "documents")), _scorer))
    return found.select("id", "suite", "status", "length", "pred_idx", F.round(F.array_max("probs"), 8).alias("confidence"), F.size("errors").alias("n_errors"))


@register(f"""WITH RECURSIVE d AS (SELECT doc_id::VARCHAR AS id, lang AS suite, len(regexp_extract_all(coalesce(text, ''), '\\S+'))::BIGINT AS n FROM documents),
t AS (SELECT *, row_number() OVER (PARTITION BY suite ORDER BY n, id) AS r FROM d WHERE n <= {LIMIT}),
b AS (SELECT suite, id, n, r, 0::BIGINT AS batch, 1 AS k FROM t WHERE r = 1 UNION ALL
SELECT t.suite, t.id, t.n, t.r, b.batch + CASE WHEN (b.k + 1) * t.n > {MAX_TOKENS} OR b.k >= {MAX_ROWS} THEN 1 ELSE 0 END, CASE WHEN (b.k + 1) * t.n > {MAX_TOKENS} OR b.k >= {MAX_ROWS} THEN 1 ELSE b.k + 1 END FROM b JOIN t ON t.suite = b.suite AND t.r = b.r + 1)
SELECT id, suite, 'ok' AS status, n::INT AS length, batch, count(*) OVER w AS batch_size, (count(*) OVER w) * (max(n) OVER w) AS padded_tokens FROM b WINDOW w AS (PARTITION BY suite, batch)
UNION ALL SELECT id, suite, 'unsupported_length', n::INT, NULL, NULL, NULL FROM d WHERE n > {LIMIT}""")
def collated_predictions(spark, d):
    found = infer.collated(_asked(table(spark, d, "documents")), _scorer, "n", LIMIT, MAX_TOKENS, MAX_ROWS)
    return found.select("id", "suite", "status", "length", "batch", "batch_size", "padded_tokens")


@register(f"""SELECT doc_id::VARCHAR AS id, lang AS suite, CASE WHEN len(regexp_extract_all(coalesce(text, ''), '\\S+')) > {LIMIT} THEN 'unsupported_length' ELSE 'ok' END AS status, len(regexp_extract_all(coalesce(text, ''), '\\S+'))::INT AS length FROM documents""")
def progressive_log(spark, d):
    docs = table(spark, d, "documents")
    root = _fresh(spark, "run")
    # A pattern: a stream takes no single file otherwise.
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 64).parquet(f"{d}/documents[.]parquet")
    progress.run(infer.predict(_asked(stream), _scorer), root, {"model": "function words", "limit": LIMIT, "shared": shared_root(spark)})
    return progress.logged(spark, root, infer.PREDICTION).select("id", "suite", "status", "length")
