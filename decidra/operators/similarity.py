"""Similarity joins over shingle sets: candidates by equal shingles, exact afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import shingle_hashes
from .components import components
from .tables import stored


#: Ids up to this number are broadcast, after they were counted; more are joined by a shuffle.
MOST_IDS = 1_000_000
#: One unit in so many is looked at for shingles that many units have, and at most so many of these are known to every task.
EVERY, LEAST_SEEN, MOST_COMMON = 16, 3, 200_000
#: Similar sets share so many of their prefixes' shingles, or all that they need to share.
MEET = 3


def shingle_sets(units: DataFrame, key: str, tokens: str, k: int, least: int) -> DataFrame:
    """key, s (hashes of the distinct shingles) and n of each unit that has some: a written table."""
    cut = units.select(key, shingle_hashes(F.col(tokens), k, least).alias("s"))
    # Empty ones are left out of what was written: before, the condition would cut all texts a second time.
    return stored(cut.select(key, "s", F.size("s").alias("n")), "sets").where("n > 0")


def _among(rows: DataFrame, key: str, ids: DataFrame, how: str) -> DataFrame:
    ids = stored(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), "ids")
    return rows.join(F.broadcast(ids) if ids.count() <= MOST_IDS else ids, key, how)


def of_ids(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows of some ids, without a shuffle of all rows if the ids aren't too many to broadcast."""
    return _among(rows, key, ids, "left_semi")


def without_copies(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of other ids, likewise."""
    return _among(rows, key, ids, "left_anti")


def matched_sets(units: DataFrame, key: str, tokens: str, k: int, least: int, other: DataFrame) -> DataFrame:
    """Likewise, but s has only the shingles that `other` sets have, n still counts all, and units without any are left out."""
    cut = units.select(key, shingle_hashes(F.col(tokens), k, least).alias("s"))
    # The outer form, as for the inner one the optimizer asks for the size first, and the texts would be cut twice.
    each = cut.select(key, F.size("s").alias("n"), F.explode_outer("s").alias("x"))
    found = of_ids(each, "x", other.select(F.explode("s").alias("x")))
    return stored(found.groupBy(key, "n").agg(F.collect_list("x").alias("s")).select(key, "s", "n"), "sets")


def facing_sets(left: DataFrame, right: DataFrame, left_key: str, right_key: str, tokens: str, k: int, least: int) -> tuple[DataFrame, DataFrame]:
    """Sets of both sides, of which the larger side's have only the shingles that the smaller side has: what two sets share is still all there."""
    if left.count() > right.count():
        return facing_sets(right, left, right_key, left_key, tokens, k, least)[::-1]
    a = shingle_sets(left, left_key, tokens, k, least)
    return a, matched_sets(right, right_key, tokens, k, least, a)


def meetings(left: DataFrame, right: DataFrame, left_key: str, right_key: str, share: float, fits=None) -> DataFrame:
    """Pairs (left_key, right_key) of sets that may have `share` of the smaller one in common.

    Such pairs share one of the smaller set's n - ceil(share * n) + 1 first shingles in any order.
    The order is by how many sets of the other side have a shingle: those that none has come
    first, use up most of the places, and join with nothing, and what many have is seldom among them.
    """

    if left.count() > right.count():
        return meetings(right, left, right_key, left_key, share, fits)
    each = lambda side, key: side.select(key, "n", F.explode("s").alias("x"))
    often = lambda rows: rows.groupBy("x").agg(F.count(F.lit(1)).alias("df"))
    # Written, so that its size is known: the larger side's shingles are only shuffled if the smaller side's are too many to broadcast.
    of_left = stored(often(each(left, left_key)), "often")
    b = stored(each(right, right_key).join(of_left, "x").select(right_key, "n", "x", "df"), "shared")
    a = stored(each(left, left_key).join(often(b), "x").select(left_key, "n", "x", "df"), "shared")

    def first(found: DataFrame, key: str) -> DataFrame:
        by = Window.partitionBy(key)
        ranked = found.withColumn("r", F.row_number().over(by.orderBy("df", "x"))).withColumn("c", F.count(F.lit(1)).over(by))
        return ranked.where(F.col("r") <= F.col("c") - F.ceil(F.col("n") * share) + 1).select(key, "n", "x")

    other = lambda side, key: side.select(F.col(key), F.col("n").alias("m"), "x")
    ab = first(a, left_key).join(other(b, right_key), "x").where("n <= m")
    ba = first(b, right_key).join(other(a, left_key), "x").where("n < m")
    met = ab.select(left_key, right_key, "n", "m").unionByName(ba.select(left_key, right_key, F.col("m").alias("n"), F.col("n").alias("m")))
    return (met if fits is None else met.where(fits)).select(left_key, right_key).distinct()


def counted(pairs: DataFrame, left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """The pairs with their sizes __na and __nb and how many shingles they share, by whole sets."""
    pairs = stored(pairs, "met")
    a = of_ids(left, left_key, pairs.select(left_key)).select(left_key, F.col("s").alias("__sa"), F.col("n").alias("__na"))
    b = of_ids(right, right_key, pairs.select(right_key)).select(right_key, F.col("s").alias("__sb"), F.col("n").alias("__nb"))
    both = pairs.join(a, left_key).join(b, right_key)
    return both.select(*pairs.columns, "__na", "__nb", F.size(F.array_intersect("__sa", "__sb")).alias("shared_shingles"))


def near_pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str, tokens: str = "tokens", k: int = 5, least: int = 12, jaccard: float = 0.8, containment: float = 0.9, shared_words: int = 12) -> DataFrame:
    """Pairs with jaccard at or above its threshold, or with containment in the smaller set
    and enough distinct words in common.  Uncapped; keys must differ in name.
    """
    a, b = facing_sets(left, right, left_key, right_key, tokens, k, least)
    hits = counted(meetings(a, b, left_key, right_key, min(jaccard, containment)), a, b, left_key, right_key)
    scored = hits.select(
        left_key, right_key, "shared_shingles",
        (F.col("shared_shingles") / (F.col("__na") + F.col("__nb") - F.col("shared_shingles"))).alias("jaccard"),
        (F.col("shared_shingles") / F.least("__na", "__nb")).alias("containment"),
    )
    likely = stored(scored.where((F.col("jaccard") >= jaccard) | (F.col("containment") >= containment)), "likely")
    words = lambda side, key, name: of_ids(side, key, likely.select(key)).select(key, F.array_distinct(tokens).alias(name))
    both = likely.join(words(left, left_key, "__wa"), left_key).join(words(right, right_key, "__wb"), right_key)
    both = both.withColumn("shared_words", F.size(F.array_intersect("__wa", "__wb")))
    return both.where((F.col("jaccard") >= jaccard) | (F.col("shared_words") >= shared_words)).select(left_key, right_key, "jaccard", "containment", "shared_words")


def common(sets: DataFrame, key: str) -> tuple:
    """Shingles that many units have, in order, and how often each was seen in one unit of EVERY: a hint for the order of shingles, which any hint leaves right."""
    import numpy as np

    seen = sets.where(F.pmod(F.xxhash64(key), F.lit(EVERY)) == 0).select(F.explode("s").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= LEAST_SEEN)
    found = sorted((r["x"], r["c"]) for r in seen.orderBy(F.desc("c"), "x").limit(MOST_COMMON).collect())
    return np.array([x for x, _ in found], dtype=np.int64), np.array([c for _, c in found], dtype=np.int64)


def prefixes(sets: DataFrame, key: str, jaccard: float) -> DataFrame:
    """key, n and x: the first n - ceil(jaccard * n) + MEET shingles of each set, `common` ones last, and else by hash.

    The order is the same for all sets, so that similar ones share MEET of these: they share ceil(jaccard * n) or more, of which all but MEET - 1 may come later in either.
    It needs no count of every shingle.
    """
    import numpy as np
    import pyarrow as pa

    shared = sets.sparkSession.sparkContext.broadcast(common(sets, key))

    def first(batch):
        known, often = shared.value
        lists = batch.column(1)
        n, values = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(n)), n)
        weight = np.zeros(len(values), dtype=np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, values), len(known) - 1)
            weight = np.where(known[at] == values, often[at], 0)
        order = np.lexsort((values, weight, owner))
        place = np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)
        kept = order[place < np.repeat(n - np.ceil(n * jaccard).astype(np.int64) + MEET, n)]
        mine = owner[kept]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(mine)), pa.array(n[mine].astype(np.int32)), pa.array(values[kept])], names=[key, "n", "x"])

    def run(batches):
        for batch in batches:
            # A few units at a time, as sorting takes several times their size.
            for at in range(0, batch.num_rows, 256):
                yield first(batch.slice(at, 256))

    return sets.select(key, "s").mapInArrow(run, f"`{key}` {sets.schema[key].dataType.simpleString()}, n int, x bigint")


def enough(pairs: DataFrame, jaccard: float) -> DataFrame:
    """a and b that meet by as many of their prefixes' shingles as similar sets do, given a row (a, b, n, m) for each one."""
    least = F.least(F.lit(MEET), F.ceil(F.greatest("n", "m") * jaccard))
    return pairs.where(F.least("n", "m") >= jaccard * F.greatest("n", "m")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("__c"), F.max("n").alias("n"), F.max("m").alias("m")).where(F.col("__c") >= least).select("a", "b")


def rarest(units: DataFrame, key: str, tokens: str, k: int, least: int, jaccard: float) -> tuple[DataFrame, DataFrame]:
    """(sets of shingles, their `prefixes` that others have too): two similar sets have `enough` of these in common.  Both are written tables."""
    sets = shingle_sets(units, key, tokens, k, least)
    dealt = prefixes(sets, key, jaccard).repartition("x")
    # All columns are aggregated, so that both sides of the join read one shuffle.
    often = dealt.groupBy("x").agg(F.min(key).alias("__a"), F.max(key).alias("__z"), F.max("n").alias("__n")).where("__a <> __z").select("x")
    return sets, stored(dealt.join(often, "x").select(key, "n", "x"), "prefixes")


def similar(pairs: DataFrame, sets: DataFrame, key: str, jaccard: float) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar."""
    pairs = stored(pairs, "met")
    some = of_ids(sets, key, pairs.select("a").union(pairs.select("b")))
    side = lambda name, column: some.select(F.col(key).alias(name), F.col("s").alias(column))
    both = pairs.join(side("a", "__x"), "a").join(side("b", "__y"), "b").withColumn("__c", F.size(F.array_intersect("__x", "__y")))
    return both.where(F.col("__c") / (F.size("__x") + F.size("__y") - F.col("__c")) >= jaccard).select("a", "b")


def jaccard_pairs(units: DataFrame, key: str, tokens: str = "tokens", k: int = 5, least: int = 12, jaccard: float = 0.8) -> DataFrame:
    """Pairs (a, b), a < b, of units with at least that jaccard similarity.  Uncapped.

    Units meet by the first shingles of a common order, in which those that many units have come last.  Whole sets are
    compared of the pairs that meet.  Equal units should be one before.  Where only groups of similar units are wanted, `near_components` does without all pairs.
    """
    sets, rare = rarest(units, key, tokens, k, least, jaccard)
    other = rare.select(F.col(key).alias("b"), F.col("n").alias("m"), "x")
    met = rare.join(other, "x").where(F.col(key) < F.col("b")).select(F.col(key).alias("a"), "b", "n", "m")
    return similar(enough(met, jaccard), sets, key, jaccard)


def near_components(units: DataFrame, key: str, tokens: str = "tokens", k: int = 5, least: int = 12, jaccard: float = 0.8) -> DataFrame:
    """key and component (its smallest unit) of every unit: units are connected by similar ones.  Exact, without pairing a group's members with each other.

    First each unit is compared with the smallest one it meets by a shingle, which connects the most of a group of near copies.  Only units that meet and aren't connected yet
    are compared then: they are found by the components that meet, so what is connected is not paired again.
    """
    sets, rare = rarest(units, key, tokens, k, least, jaccard)
    hubs = stored(rare.groupBy("x").agg(F.min(F.struct(F.col(key).alias("a"), F.col("n").alias("m"))).alias("h")).select("x", "h.*"), "hubs")
    first = enough(rare.join(hubs, "x").where(F.col(key) != F.col("a")).select("a", F.col(key).alias("b"), "n", "m"), jaccard)
    edges = stored(similar(first, sets, key, jaccard), "links")
    parts = stored(components(units.select(key), edges, key), "parts")
    placed = stored(rare.join(parts, key).select(F.col(key).alias("u"), "n", "x", F.col("component").alias("c")), "placed")
    sides = placed.select("x", "c").distinct()
    apart = stored(sides.join(sides.select("x", F.col("c").alias("d")), "x").where("c < d"), "apart")
    left = placed.join(apart, ["x", "c"]).select("x", F.col("u").alias("a"), "n", "d")
    right = placed.select("x", F.col("c").alias("d"), F.col("u").alias("b"), F.col("n").alias("m"))
    more = similar(enough(left.join(right, ["x", "d"]), jaccard), sets, key, jaccard)
    of = lambda side: parts.select(F.col(key).alias(side), F.col("component").alias(f"c{side}"))
    between = more.join(of("a"), "a").join(of("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    whole = components(parts.select(F.col("component").alias("part")).distinct(), between.distinct(), "part")
    return parts.withColumnRenamed("component", "part").join(whole, "part").select(key, "component")


def exact_pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str, normalized: str = "normalized") -> DataFrame:
    """Pairs of equal normal text."""
    return left.select(left_key, normalized).join(right.select(right_key, normalized), normalized).select(left_key, right_key)


def firewall(candidates: DataFrame, index: DataFrame, key: str, tokens: str = "tokens", k: int = 3, least: int = 8, jaccard: float = 0.85, posting_cap: int | None = None) -> DataFrame:
    """Candidates without an exact or near match in the index.

    A posting cap drops shingles that more index units have, as a bounded index does; by
    default there is none, and then no match is lost.
    """
    # Texts meet by 256-bit digests, not by themselves.
    text = lambda rows: rows.select("*", F.sha2(F.array_join(tokens, " "), 256).alias("__t"))
    left = text(candidates)
    exact = left.join(text(index).select("__t").distinct(), "__t", "left_semi").select(key)
    units = stored(index.select(F.monotonically_increasing_id().alias("__u"), tokens), "units")
    a, b = facing_sets(candidates, units, key, "__u", tokens, k, least)
    if posting_cap is not None:
        each = b.select("__u", F.posexplode("s").alias("p", "x"))
        usual = each.groupBy("x").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") <= posting_cap).select("x")
        b = stored(each.join(usual, "x").groupBy("__u").agg(F.collect_list("x").alias("s")).join(b.select("__u", "n"), "__u"), "capped")
    sizes = F.least("n", "m") >= jaccard * F.greatest("n", "m")
    hits = counted(meetings(a, b, key, "__u", jaccard, sizes), a, b, key, "__u")
    near = hits.where(F.col("shared_shingles") / (F.col("__na") + F.col("__nb") - F.col("shared_shingles")) >= jaccard).select(key)
    return candidates.join(exact.unionByName(near).distinct(), key, "left_anti")
