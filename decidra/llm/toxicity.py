"""Toxicity by non-negative positive-unlabelled learning.

The confirmed toxic rows of the training fold are the positives; all rows of it, labelled or
not and the confirmed ones among them, are the unlabelled ones, so that the prior holds for them.  A logistic classifier is trained in numpy by minimising
pi * R_p(+) + max(0, R_u(-) - pi * R_p(-)), with the class prior pi taken from the labelled
rows of the training fold; where the second part falls below zero, its gradient is taken
back (the non-negative correction).

Features say that a word, or words of one beginning, occur at least 1, 2, 3 or 4 times.
Only those that stand out among the positives are used; the scoring of a text then costs
one dictionary look-up per word.

The fit uses a bounded sample: the SAMPLE positives and SAMPLE unlabelled rows whose
doc_id hashes lowest, each read whole.  The model has at most FEATURES features, those that
stand out most.  Scoring covers every row.

Defined cases: a null or empty text scores the classifier's bias; rows without a doc_id are
never learned from and count as training rows (held_out false); a label row repeated for a
document counts as toxic if one of them is; null labels are no labels; without positives
every score is 0; repeated rows are scored alike; an empty table gives an empty result;
only the named columns are read, so extra columns can't clash.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Rows of either kind that are learned from, at most.
SAMPLE = 3_000
BEGINNINGS, TIMES, FEATURES, SUPPORT = (4, 5, 6, 7), 4, 512, 5
FOLDS, HELD_OUT = 5, 0
WORD_BYTES = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def keys_of(word: bytes) -> list[int]:
    """The word itself and its beginnings, as 30-bit hashes."""
    s = word.decode()
    return [zlib.crc32(b"w" + word) >> 2, *(zlib.crc32(f"{k}{s[:k]}".encode()) >> 2 for k in BEGINNINGS if len(s) >= k)]


def counts_of(text: str | None) -> Counter:
    return Counter((text or "").encode().translate(WORD_BYTES).split())


def features_of(text: str | None) -> np.ndarray:
    """Sorted features of a text: key * TIMES + t - 1 for each t up to the key's count."""
    out: Counter = Counter()
    for word, n in counts_of(text).items():
        for key in keys_of(word):
            out[key] += n
    keys = np.fromiter(out.keys(), dtype=np.uint32, count=len(out))
    times = np.minimum(np.fromiter(out.values(), dtype=np.int64, count=len(out)), TIMES)
    return np.sort(np.concatenate([keys[times >= t] * np.uint32(TIMES) + np.uint32(t - 1) for t in range(1, TIMES + 1)]))


def matrix(rows: list[np.ndarray], chosen: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), len(chosen)), dtype=np.float32)
    order = np.argsort(chosen)
    for r, row in enumerate(rows):
        at = np.searchsorted(chosen, row, sorter=order)
        there = at < len(chosen)
        there[there] = chosen[order[at[there]]] == row[there]
        out[r, order[at[there]]] = 1
    return out


def chosen_features(positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> np.ndarray:
    """The features that stand out among the positives, by a two-sample z value."""
    known, n = np.unique(np.concatenate(positive), return_counts=True)
    known, n = known[n >= SUPPORT], n[n >= SUPPORT]
    others = np.zeros(len(known), dtype=np.int64)
    for row in unlabelled:
        at = np.minimum(np.searchsorted(known, row), max(len(known) - 1, 0))
        if len(known):
            others[at[known[at] == row]] += 1
    p, u = max(len(positive), 1), max(len(unlabelled), 1)
    a, b = n / p, others / u
    z = (a - b) / np.sqrt(a * (1 - a) / p + b * (1 - b) / u + 1e-6)
    best = np.lexsort((known, -z))[:FEATURES]
    return known[best[z[best] > 2]]


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 300, rate: float = 0.05, decay: float = 3e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic classifier with the least non-negative risk (Adam)."""
    a, b = positive, unlabelled
    w, bias = np.zeros(a.shape[1], dtype=np.float32), np.float32(-2.0)
    m, v = np.zeros(len(w) + 1, dtype=np.float32), np.zeros(len(w) + 1, dtype=np.float32)
    for step in range(1, steps + 1):
        zp, zu = a @ w + bias, b @ w + bias
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        as_negative, of_unlabelled = -prior * sp / len(a), su / len(b)
        if negative >= 0:
            gp, gu = prior * (sp - 1) / len(a) + as_negative, of_unlabelled
        else:
            gp, gu = -as_negative, -of_unlabelled
        g = np.append(a.T @ gp.astype(np.float32) + b.T @ gu.astype(np.float32) + np.float32(decay) * w, gp.sum() + gu.sum()).astype(np.float32)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, bias = (w - move[:-1]).astype(np.float32), bias - move[-1]
    return w, float(bias)


def fold(doc_id):
    """crc32(doc_id as text) mod FOLDS."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[dict[int, list[float]], float]:
    """(weights of a feature by its count from 1 to TIMES, bias) from the training fold."""
    bounded_batches(docs.sparkSession)
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("__toxic"))
    marks = marks.where(fold(F.col("doc_id")) != HELD_OUT)
    total, toxic = marks.agg(F.count(F.lit(1)), F.coalesce(F.sum("__toxic"), F.lit(0))).first()
    if not toxic:
        return {}, -50.0
    rows = docs.select("doc_id", F.col("text").alias("__text")).where(F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    confirmed = marks.where(F.col("__toxic") == 1).orderBy(*order).limit(sample).select("doc_id")
    ids = rows.select("doc_id").distinct().orderBy(*order).limit(sample)
    flags = lambda frame, p: frame.select("doc_id", F.lit(p).alias("__p"), F.lit(not p).alias("__u"))
    wanted = flags(confirmed, True).unionByName(flags(ids, False)).groupBy("doc_id").agg(F.max("__p").alias("__p"), F.max("__u").alias("__u"))
    # 2 * sample ids of 8 bytes: bounded, so the texts need no shuffle.
    found = rows.join(F.broadcast(wanted), "doc_id").select("doc_id", "__p", "__u", "__text")
    kind = found.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            features = [features_of(text).tobytes() for text in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(features, pa.binary())], names=["doc_id", "p", "u", "f"])

    positive, unlabelled = [], []
    # One row an id, however many the table has: 2 * sample rows of about 5 kB.
    one = found.mapInArrow(run, f"doc_id {kind}, p boolean, u boolean, f binary").groupBy("doc_id").agg(F.max("p"), F.max("u"), F.min("f"))
    for row in one.drop("doc_id").collect():
        features = np.frombuffer(row[2], dtype=np.uint32)
        if row[0]:
            positive.append(features)
        if row[1]:
            unlabelled.append(features)
    return train(positive, unlabelled, toxic / total)


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> tuple[dict[int, list[float]], float]:
    if not positive or not unlabelled:
        return {}, -50.0
    best = chosen_features(positive, unlabelled)
    w, bias = fit(matrix(positive, best), matrix(unlabelled, best), prior)
    weights: dict[int, list[float]] = {}
    for feature, x in zip(best.tolist(), w.tolist(), strict=True):
        weights.setdefault(feature // TIMES, [0.0] * TIMES)[feature % TIMES] = x
    return {k: np.cumsum(x).tolist() for k, x in weights.items()}, bias


class Scorer:
    """Scores texts; remembers which features the words it has met have, in a bounded table."""

    MEMORY = 100_000

    def __init__(self, weights: dict[int, list[float]], bias: float):
        self.weights, self.bias, self.known = weights, bias, {}

    def score(self, text: str | None) -> float:
        known, hits = self.known, {}
        for word, n in counts_of(text).items():
            keys = known.get(word)
            if keys is None:
                keys = tuple(k for k in keys_of(word) if k in self.weights)
                if len(known) >= self.MEMORY:
                    known.clear()
                known[word] = keys
            for key in keys:
                hits[key] = hits.get(key, 0) + n
        z = self.bias + sum(self.weights[k][min(n, TIMES) - 1] for k, n in sorted(hits.items()))
        return float(1 / (1 + np.exp(-z)))


def score(docs: DataFrame, model: tuple[dict[int, list[float]], float], keep: list[str]) -> DataFrame:
    """The columns `keep` of `docs` (renamed to __0, __1, ...) and `score`."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(keep)], F.col("text").alias("__text"))
    weights, bias = model

    def run(batches):
        scorer = Scorer(weights, bias)
        for batch in batches:
            scores = [scorer.score(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "score"])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{head}, score double")


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that score below 0.5, all columns as they are."""
    names = docs.columns
    kept = score(docs, learn(docs, labels), names).where(F.col("score") < 0.5)
    return kept.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(names)])


def op10(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs, learn(docs, labels), ["doc_id"])
    held = F.coalesce(fold(F.col("__0")) == HELD_OUT, F.lit(False))
    return scored.select(F.col("__0").alias("doc_id"), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


