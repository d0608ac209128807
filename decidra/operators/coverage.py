"""Whole groups under a limit, spread over strata, with every required value covered.

A group of rows belongs to every stratum that one of its rows has.  Groups are first taken so that each required value
occurs (the smallest group that has it), and then in turns over the strata, one group a stratum and turn, as long as one fits.
Chance is a hash of the group, so the picks are the same on any partitioning.

Only groups that can be next meet the driver: the first few of each stratum by their draw, found by a limited rank that Spark applies
before the shuffle, so a stratum with most groups is no hot key.  A turn needs no rows but these; when a
stratum's few are used up, its next ones are fetched.  The driver holds the picks (at most `limit`) and a few groups of each stratum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sampling import drawn
from .tables import stored


class Uncovered(ValueError):
    """No whole group that has a required value fits under the limit."""


def group_facts(items: DataFrame, group: str, strata: list[str], require: list[str], seed: str) -> DataFrame:
    """One row per group: size, draw, its strata and its required values ('column=value'); a written table."""
    named = F.array(*[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in require])
    facts = items.groupBy(group).agg(
        F.count(F.lit(1)).alias("size"),
        F.collect_set(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in strata])).alias("strata"),
        F.array_distinct(F.flatten(F.collect_set(named))).alias("values"),
    )
    return stored(facts.select(F.col(group).alias("g"), "size", drawn(seed, group).alias("draw"), "strata", "values"), "groups")


def covering_spread(items: DataFrame, group: str, strata: list[str], require: list[str], limit: int, seed: str, at_once: int = 16) -> DataFrame:
    """The rows of the picked groups: at most `limit`; all rows if there are no more.

    Required values are covered column by column in the order of `require`, values ascending; one that can't be covered raises
    `Uncovered`.  Groups equal in size go by their draw.  Groups of a null key are one group.
    """
    if items.limit(limit + 1).count() <= limit:
        return items
    facts = group_facts(items, group, strata, require, seed)
    picked, left = _covered(facts, require, limit)
    picked = _in_turns(facts, picked, left, at_once)
    spark = items.sparkSession
    kind = items.schema[group].dataType.simpleString()
    # At most `limit` keys.
    keys = spark.createDataFrame([(k,) for k in picked], f"__g {kind}")
    return items.join(F.broadcast(keys), F.col(group).eqNullSafe(F.col("__g")), "left_semi")


def _covered(facts: DataFrame, require: list[str], limit: int) -> tuple[list, int]:
    """The smallest group of each required value, unless an earlier pick has it: one row per value reaches the driver."""
    smallest = facts.select(F.explode("values").alias("value"), F.struct("size", "draw", "g", "values").alias("x")).groupBy("value").agg(F.min("x").alias("x"))
    found = {r["value"]: r["x"] for r in smallest.collect()}
    rank = {c: i for i, c in enumerate(require)}
    picked, seen, left = [], set(), limit
    for value in sorted(found, key=lambda v: (rank[v.partition("=")[0]], v)):
        if value in seen:
            continue
        least = found[value]
        if least["size"] > left:
            raise Uncovered(f"no whole group with {value} fits in {left} rows")
        picked.append(least["g"])
        left -= least["size"]
        seen.update(least["values"])
    return picked, left


def _in_turns(facts: DataFrame, picked: list, left: int, at_once: int) -> list:
    """A group that doesn't fit now never will, so a stratum's next group is always its first by draw that is free and fits."""
    spark = facts.sparkSession
    keys = sorted(tuple(r["s"]) for r in facts.select(F.explode("strata").alias("s")).distinct().collect())
    taken = set(picked)
    queues: dict[tuple, list] = {}
    ended: set[tuple] = set()
    many = at_once

    def fetch() -> None:
        """The next groups of all strata."""
        nonlocal many
        chosen = spark.createDataFrame([(k,) for k in picked], f"g {facts.schema['g'].dataType.simpleString()}")
        # At most `limit` keys.
        free = facts.where(F.col("size") <= left).alias("f").join(F.broadcast(chosen.alias("c")), F.col("f.g").eqNullSafe(F.col("c.g")), "left_anti")
        each = free.select(F.explode("strata").alias("s"), "g", "size", "draw")
        first = each.withColumn("r", F.row_number().over(Window.partitionBy("s").orderBy("draw", "g"))).where(F.col("r") <= many)
        queues.clear()
        for r in sorted(first.collect(), key=lambda r: r["r"]):
            queues.setdefault(tuple(r["s"]), []).append((r["g"], r["size"]))
        ended.clear()
        ended.update(k for k in keys if len(queues.get(k, ())) < many)
        many *= 2

    fetch()
    progress = True
    while progress:
        progress = False
        for key in keys:
            while True:
                queue = queues.get(key, [])
                while queue and (queue[0][0] in taken or queue[0][1] > left):
                    queue.pop(0)
                if queue or key in ended:
                    break
                fetch()
            if queue:
                g, size = queue.pop(0)
                taken.add(g)
                picked.append(g)
                left -= size
                progress = True
    return picked
