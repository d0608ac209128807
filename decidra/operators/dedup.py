"""Deduplication: first kept, conflicting targets quarantined, greedy with an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ordered_state
from .selection import TAKEN, settled
from .tables import stored


def keep_first(rows: DataFrame, key: str | Column, order: list) -> DataFrame:
    """The first row of each key."""
    by = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(by)).where("__r = 1").drop("__r")


def conflict_decisions(rows: DataFrame, key: str, order: list[str], target: str) -> DataFrame:
    """Adds `decision`: quarantine for every row of a key whose targets disagree; otherwise
    retain for the first row of the key and exclude for later ones; and `canonical`, the
    first row's `order[0]`.

    Targets are aggregated per key before they meet the rows again.
    """
    n = rows.groupBy(key).agg(F.min(F.col(target)).alias("__x"), F.max(F.col(target)).alias("__y"), F.count(F.lit(1)).alias("__n"), F.count(target).alias("__k"), F.min(F.struct(*order)).alias("__f"))
    joined = rows.join(n, key)
    clash = (F.col("__x") != F.col("__y")) | ((F.col("__k") > 0) & (F.col("__k") < F.col("__n")))
    first = F.struct(*order) == F.col("__f")
    decision = F.when(F.coalesce(clash, F.lit(False)), "quarantine").when(first, "retain").otherwise("exclude")
    return joined.withColumn("decision", decision).withColumn("canonical", F.col(f"__f.{order[0]}")).drop("__x", "__y", "__n", "__k", "__f")


def within_benchmark(rows: DataFrame, id: str, order: str, state: str, question: str, target: str) -> DataFrame:
    """Adds `decision`, `canonical` (the first equal row's id) and `target_same` (as the first row's): equal decisions of a benchmark.

    Rows are equal if state and question (JSON texts) are once strings are normal and keys in their own order; order of options counts.  The first in `order` is retained and later ones are
    excluded, unless targets of equal rows differ: then all of them are quarantined.  Each row is compared with the first one, not with every other.
    """
    # The length parts the two, so no two pairs read alike.
    a, b = ordered_state(F.col(state)), ordered_state(F.col(question))
    keyed = stored(rows.withColumn("__key", F.sha2(F.concat(F.coalesce(F.length(a).cast("string"), F.lit("")), F.lit(":"), F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))), 256)), "keyed")
    first = keyed.groupBy("__key").agg(F.min(F.struct(F.col(order).alias("o"), F.col(id).alias("i"))).alias("__f"), F.min_by(F.struct(F.col(target).alias("t")), F.struct(order, id)).alias("__t"))
    marked = stored(keyed.join(stored(first, "firsts"), "__key").withColumn("target_same", F.col(target).eqNullSafe(F.col("__t.t"))), "marked")
    mixed = marked.groupBy("__key").agg((~F.bool_and("target_same")).alias("__mixed"))
    out = marked.join(stored(mixed, "mixed"), "__key")
    decision = F.when(F.col("__mixed"), "quarantine").when(F.col(id).eqNullSafe(F.col("__f.i")), "retain").otherwise("exclude")
    return out.select(*rows.columns, decision.alias("decision"), F.col("__f.i").alias("canonical"), "target_same")


def canonical_facts(facts: Column) -> Column:
    """A key of an array of facts that doesn't depend on their order."""
    return F.sha2(F.to_json(F.array_sort(facts)), 256)


def first_independent(nodes: DataFrame, conflicts: DataFrame, node: str, order: str) -> DataFrame:
    """The rows that a pass in `order` accepts, a row being refused if an accepted earlier
    row conflicts with it: the first maximal independent set.

    `conflicts` has columns a and b (values of `node`); `selection.settled` decides them, chains of any length in few rounds.
    """
    ranks = nodes.select(F.col(node).alias("__n"), F.col(order).alias("__o"))
    by = lambda side: ranks.select(F.col("__n").alias(side), F.struct("__o", "__n").alias(f"__{side}"))
    both = conflicts.select("a", "b").where("a <> b").join(by("a"), "a").join(by("b"), "b")
    later = F.col("__a") > F.col("__b")
    edges = both.select(F.when(later, F.col("a")).otherwise(F.col("b")).alias("node"), F.when(later, F.col("b")).otherwise(F.col("a")).alias("on"), F.lit(TAKEN).alias("state"))
    return nodes.join(settled(edges).withColumnRenamed("node", node), node, "left_anti")
