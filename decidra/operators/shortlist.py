"""Shortlists: the k options most similar to a query by cosine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import dot, let


def cleaned(vector: Column) -> Column:
    """NaN and infinities as 0."""
    return F.transform(vector.cast("array<double>"), lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x))


def cosine(a: Column, b: Column) -> Column:
    """0 if a vector is all zeros."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def top_k(queries: DataFrame, options: DataFrame, query: str, option: str, k: int, most: int = 100_000, most_bytes: int = 64 << 20) -> DataFrame:
    """query, option, rank (from 1) and score of the k best options; ties by option order.

    `options` (option, vector, pos) is a stated list, counted and measured before every query meets it; in
    its own order and without scores where k isn't below its size.
    """
    if k < 1:
        raise ValueError("k must be positive")
    n, size = options.agg(F.count(F.lit(1)), F.coalesce(F.sum(64 + 8 * F.size("vector")), F.lit(0))).first()
    if n > most or size > most_bytes:
        raise ValueError(f"{n} options of {size} bytes; at most {most} of {most_bytes} are a list")
    wanted = options.select(F.struct(F.col("pos"), F.col(option).alias("o"), cleaned(F.col("vector")).alias("v")).alias("x"))
    listed = F.broadcast(wanted.agg(F.array_sort(F.collect_list("x")).alias("__options")))
    both = queries.join(listed)
    if k >= n:
        each = both.select(query, F.posexplode("__options").alias("__i", "__x"))
        return each.select(query, F.col("__x.o").alias(option), (F.col("__i") + 1).alias("rank"), F.lit(None).cast("double").alias("score"))

    def best(q: Column) -> Column:
        scored = F.transform("__options", lambda x: F.struct((-cosine(q, x["v"])).alias("s"), x["pos"].alias("p"), x["o"].alias("o")))
        return F.slice(F.sort_array(scored), 1, k)

    each = both.select(query, F.posexplode(let(cleaned(F.col("vector")), best)).alias("__i", "__x"))
    return each.select(query, F.col("__x.o").alias(option), (F.col("__i") + 1).alias("rank"), (-F.col("__x.s")).alias("score"))


def nearest(queries: DataFrame, rows: DataFrame, query: str, option: str, k: int, block: int = 100, most_bytes: int = 256 << 20) -> DataFrame:
    """query, option, rank and score (to eight digits) of the k rows most similar to each of a stated set of queries; ties by option.

    `rows` is searched whole, a batch at a time against blocks of the queries, by matrix products.
    Each task keeps the k best of each query; those are ranked afterwards.  The queries go to
    every task, so their size is checked.
    """
    import numpy as np
    import pandas as pd

    listed = queries.select(query, cleaned(F.col("vector")).alias("v"))
    n, size = listed.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    if size * 8 > most_bytes:
        raise ValueError(f"{n} queries take {size * 8} bytes; at most {most_bytes} are a stated set")
    found = listed.collect()
    shared = queries.sparkSession.sparkContext.broadcast(([r[0] for r in found], np.array([r[1] for r in found], dtype=np.float64)))

    def unit(m):
        norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)

    def run(frames):
        ids, vectors = shared.value
        if not ids:
            return
        wanted, best = unit(vectors), [([], [])] * len(ids)
        for frame in frames:
            names, m = frame["o"].to_numpy(), unit(np.stack(frame["v"].to_numpy()))
            for at in range(0, len(ids), block):
                scores = np.round(wanted[at : at + block] @ m.T, 8)
                for i, line in enumerate(scores, at):
                    s, o = np.concatenate([best[i][0], line]), np.concatenate([best[i][1], names])
                    first = np.lexsort((o, -s))[:k]
                    best[i] = (s[first], o[first])
        yield pd.DataFrame([(ids[i], o, s) for i, (ss, os) in enumerate(best) for s, o in zip(ss, os, strict=True)], columns=["q", "o", "s"])

    kinds = {name: frame.schema[name].dataType.simpleString() for name, frame in ((query, queries), (option, rows))}
    each = rows.select(F.col(option).alias("o"), cleaned(F.col("vector")).alias("v")).mapInPandas(run, f"q {kinds[query]}, o {kinds[option]}, s double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "o"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("q").alias(query), F.col("o").alias(option), "rank", F.col("s").alias("score"))


def ranked(scores: DataFrame, query: str, k: int, order: str) -> DataFrame:
    """The k best rows of a query from a table of scores."""
    by = Window.partitionBy(query).orderBy(F.desc("score"), order)
    return scores.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def reduced_choices(rows: DataFrame, k: int, vector: str = "vector", options: str = "options", vectors: str = "vectors") -> DataFrame:
    """Adds `shortlist` (labels by rank, scores, k, n, passthrough) to choice rows and cuts their options to it.

    `vectors` has an option's vector each.  Other questions and those of k options or fewer stay
    as they are; the former have no shortlist.  One prediction for each row may follow.
    """
    if k < 1:
        raise ValueError("k must be positive")
    whole = F.col(options)
    keys = F.transform(whole, lambda o: o["key"])
    passes = F.size(whole) <= k

    def best(q: Column) -> Column:
        scored = F.zip_with(F.sequence(F.lit(0), F.size(whole) - 1), F.col(vectors), lambda i, v: F.struct((-cosine(q, cleaned(v))).alias("s"), i.alias("i")))
        return F.slice(F.sort_array(scored), 1, k)

    chosen = F.when((F.col("qtype") == "choice") & ~passes, let(cleaned(F.col(vector)), best))
    made = rows.withColumn("__chosen", chosen)
    labels = F.when(passes, keys).otherwise(F.transform("__chosen", lambda x: F.get(keys, x["i"])))
    meta = F.struct(labels.alias("labels"), F.transform("__chosen", lambda x: -x["s"]).alias("scores"), F.lit(k).alias("k"), F.size(whole).alias("n"), passes.alias("passthrough"))
    cut = F.when(F.col("__chosen").isNull(), whole).otherwise(F.transform("__chosen", lambda x: F.get(whole, x["i"])))
    return made.withColumn("shortlist", F.when(F.col("qtype") == "choice", meta)).withColumn(options, cut).drop("__chosen")


def embedded(rows: DataFrame, text: str, embed, name: str = "vector") -> DataFrame:
    """Adds embeddings by a function from a list of texts to vectors, in Arrow batches."""
    import pandas as pd
    from pyspark.sql.types import ArrayType, DoubleType

    @F.pandas_udf(ArrayType(DoubleType()))
    def vectors(texts: pd.Series) -> pd.Series:
        return pd.Series([[float(x) for x in v] for v in embed(texts.tolist())])

    return rows.withColumn(name, vectors(F.col(text)))
