"""Connected components and the propagation of decisions over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored


def star_edges(rows: DataFrame, node: str, keys: list[str]) -> DataFrame:
    """(a, b) with b the smallest node of a's key: one edge per row and key, not all pairs.

    Null keys connect nothing.
    """

    def of(key: str) -> DataFrame:
        known = rows.where(F.col(key).isNotNull()).select(node, key)
        least = known.groupBy(key).agg(F.min(node).alias("b"))
        return known.join(least, key).select(F.col(node).alias("a"), "b").where("a <> b")

    return reduce(DataFrame.unionByName, [of(k) for k in keys]).distinct()


def components(nodes: DataFrame, edges: DataFrame, node: str, rounds: int = 60) -> DataFrame:
    """node and component (its smallest member) of every node.

    Labels go to the smallest neighbour's label and then jump to that label's own label, so a
    chain takes logarithmically many rounds.  Each round is a written table.  The number of
    rounds is limited only to fail loudly.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    start = both.select(F.col("a").alias("n"), F.col("a").alias("l")).distinct()
    labels = stored(start, "labels")
    for _ in range(rounds):
        near = both.join(labels, both["b"] == labels["n"]).groupBy("a").agg(F.min("l").alias("m"))
        lower = labels.join(near, labels["n"] == near["a"]).select("n", F.col("l").alias("was"), F.least("l", "m").alias("l"))
        lower = stored(lower, "labels")
        up = lower.select(F.col("n").alias("__n"), F.col("l").alias("__l"))
        after = stored(lower.join(up, lower["l"] == up["__n"]).select("n", "was", F.col("__l").alias("l")), "labels")
        labels = after.select("n", "l")
        if not after.where("was <> l").limit(1).count():
            known = labels.select(F.col("n").alias(node), F.col("l").alias("component"))
            return nodes.select(node).distinct().join(known, node, "left").select(node, F.coalesce("component", node).alias("component"))
    raise RuntimeError(f"no fixed point after {rounds} rounds")


def propagated(rows: DataFrame, component: str, decision: str) -> DataFrame:
    """The strictest decision of each component (exclude, quarantine, retain) as `decided`."""
    worst = rows.groupBy(component).agg(F.bool_or(F.col(decision) == "exclude").alias("__any_x"), F.bool_or(F.col(decision) == "quarantine").alias("__any_q"))
    joined = rows.join(worst, component)
    return joined.withColumn("decided", F.when(F.col("__any_x"), "exclude").when(F.col("__any_q"), "quarantine").otherwise("retain")).drop("__any_x", "__any_q")


def report(members: DataFrame, component: str = "component") -> DataFrame:
    """One row: how many components there are, how many have several members, and the largest's size."""
    sizes = members.groupBy(component).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("n_components"), F.count_if(F.col("n") > 1).alias("n_shared"), F.max("n").alias("largest"))
