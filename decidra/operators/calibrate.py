"""Temperature: one global value for several suites; intervals by resampling whole clusters."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import dot, let, total
from ..functions.probs import nll, softmax
from .tables import stored
from .windows import ranked


def slope(rows: DataFrame, beta: float) -> tuple[float, float]:
    """(derivative by beta = 1 / T, value) of the mean over suites of the mean hard NLL."""

    def of(z):
        e = F.transform(z, lambda x: F.exp((x - F.array_max(z)) * beta))
        return let(e, lambda w: dot(w, z) / total(w))

    marked = rows.select("suite", (let(F.col("logits"), of) - F.get("logits", F.col("gold_idx"))).alias("d"), nll(softmax(F.col("logits"), 1.0 / beta), F.col("gold_idx")).alias("n"))
    suites = marked.groupBy("suite").agg(F.avg("d").alias("d"), F.avg("n").alias("n"))
    row = suites.agg(F.avg("d"), F.avg("n")).first()
    return float(row[0]), float(row[1])


def fit_temperature(rows: DataFrame, low: float = 0.05, high: float = 20.0, steps: int = 40) -> dict[str, float]:
    """The T of least mean NLL (suites alike), by bisection of the derivative by 1 / T.

    The mean is convex in 1 / T.  Every step is one aggregation over a stored table.  Rows:
    suite, logits, gold_idx.
    """
    kept = stored(rows.where(F.col("gold_idx").isNotNull() & F.col("logits").isNotNull()).select("suite", "logits", "gold_idx"), "logits")
    a, b = 1.0 / high, 1.0 / low
    if slope(kept, a)[0] >= 0:
        b = a
    elif slope(kept, b)[0] <= 0:
        a = b
    for _ in range(steps):
        if b - a <= 1e-9 * b:
            break
        mid = (a + b) / 2
        if slope(kept, mid)[0] < 0:
            a = mid
        else:
            b = mid
    beta = (a + b) / 2
    return {"temperature": 1.0 / beta, "nll_before": slope(kept, 1.0)[1], "nll_after": slope(kept, beta)[1]}


def _picks(seed: str, draw: int, n: int, size: int, mine: int) -> int:
    """How many of a draw's n picks fall into a block of `size` clusters: one path down a binary tree over the blocks.

    Each node splits its picks binomially by the clusters of its halves, with a generator of its own, so every task that passes a node finds the same split.
    """
    low, high, picks = 0, -(-n // size), n
    while high - low > 1 and picks:
        mid = (low + high) // 2
        left, whole = (mid - low) * size, min(high * size, n) - low * size
        went = int(_generator(seed, draw, low, high).binomial(picks, left / whole))
        low, high, picks = (low, mid, went) if mine < mid else (mid, high, picks - went)
    return picks


def _generator(*key) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64(int.from_bytes(hashlib.sha256("|".join(map(str, key)).encode()).digest()[:16], "big")))


def cluster_weights(here: int, draws: int, seed: str, mine: int, n: int, size: int) -> np.ndarray:
    """draws x here weights of a block's clusters: the block's picks, dealt evenly at random."""
    return np.stack([_generator(seed, d, "block", mine).multinomial(_picks(seed, d, n, size, mine), np.full(here, 1.0 / here)) for d in range(draws)])


def bootstrap(rows: DataFrame, cluster: str, value: str, draws: int = 2000, seed: str = "0", block: int = 4096) -> DataFrame:
    """draw, clusters (picked, with repetitions: always as many as there are) and mean, of resamples of whole clusters with replacement.

    Clusters are summed up first and lie in blocks by the order of their keys; a block is one task's work, whatever rows its clusters have.  Nulls of `value` don't count.
    """
    sums = rows.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.coalesce(F.sum(F.col(value).cast("double")), F.lit(0.0)).alias("s"), F.count(value).alias("n")).withColumn("all", F.lit(0))
    placed = stored(ranked(sums, ["all"], [cluster], "at").select(F.floor(F.col("at") / block).cast("long").alias("block"), "at", "s", "n"), "clusters")
    n_clusters = placed.count()

    def drawn_sums(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("at")
        w = cluster_weights(len(frame), draws, seed, int(frame["block"].iloc[0]), n_clusters, block)
        return pd.DataFrame({"draw": np.arange(draws), "picked": w.sum(axis=1), "s": w @ frame["s"].to_numpy(), "n": w @ frame["n"].to_numpy()})

    each = placed.groupBy("block").applyInPandas(drawn_sums, "draw long, picked long, s double, n long")
    return each.groupBy("draw").agg(F.sum("picked").alias("clusters"), F.try_divide(F.sum("s"), F.sum("n").cast("double")).alias("mean"))


def interval(draws: DataFrame, level: float = 0.95) -> DataFrame:
    """One row: low, high (linear percentiles of the draws' means) and their number."""
    tail = (1 - level) / 2
    return draws.agg(F.percentile("mean", tail).alias("low"), F.percentile("mean", 1 - tail).alias("high"), F.count("mean").alias("n_draws"))
