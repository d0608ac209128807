"""Selection in order: a row is taken unless its bucket is full, or an earlier taken row excludes it.

Two things make this sequential, and neither is run row by row.

*Exclusion.*  What decides a row is kept as edges (node, on, state): the node is refused if `on` has that state.  Rows that share a key (at most
one of them is taken) would need an edge a pair; instead each row of a key is followed by a gate that says whether the key is still free, open if the
gate before it is open and the row isn't taken, and a row needs the gate before it: three edges a row, however many
rows have the key.  Rows of near contents are linked alike: equal contents are one unit, near ones are pairs of units, and a row needs the last gate
before it of each partner of its unit, so copies are never paired with copies.  `settled` decides all nodes in rounds: known states are put in, and
a node with a single edge is replaced by what it depends on, with the state turned where need be, so that chains of any length halve
in every round and don't take a round a link.

That is for what is left after some plain rounds, in each of which the rows that come first among all that could exclude them are taken: chains are seldom long.

*Quotas.*  A selection without quotas is cut per bucket at its quota.  What follows a cut and excluded nothing in another bucket needs no further
look; else everything before the first row so excluded is final, and the rest is selected again without the closed buckets.  Each
such phase closes one bucket at least.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored

TAKEN, REFUSED = 1, 0
#: Rows of a key are linked inside blocks of so many ranks, and the blocks are then linked to each other.
BLOCK = 1 << 16
#: Rounds in which first rows are taken before what is left is settled by edges.
ROUNDS = 12


def settled(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """node of all nodes that are refused, given edges (node, on, state); every other node is taken.

    `on` must come before the node in some order, so that there are no cycles.  Each round is a written table; the number of rounds is
    limited only to fail loudly.  An edge without `on` refuses its node.
    """
    now = stored(edges.select("node", "on", F.col("state").cast("int")), "edges")
    nothing = F.lit(None).cast(edges.schema["node"].dataType)
    for _ in range(rounds):
        pairs = now.groupBy("node", "on").agg(F.min("state").alias("low"), F.max("state").alias("high"))
        both = F.bool_or(F.col("on").isNull() | (F.col("low") < F.col("high")))
        facts = stored(pairs.groupBy("node").agg(both.alias("refused"), F.count(F.lit(1)).alias("n"), F.min("on").alias("via"), F.min("low").alias("turn")), "facts")
        open_edges = now.join(facts.where("refused").select("node"), "node", "left_anti")
        if open_edges.isEmpty():
            return facts.where("refused").select("node")
        known = facts.select(F.col("node").alias("on"), F.col("refused").alias("__refused"), "n", "via", "turn")
        met = open_edges.join(known, "on", "left")
        state = F.when(F.col("n").isNull(), TAKEN).when(F.col("__refused"), REFUSED)
        hit, passed = state == F.col("state"), state != F.col("state")
        single = state.isNull() & (F.col("n") == 1)
        # The node in between is taken if and only if `via` hasn't the state `turn`.
        turned = F.when(F.col("state") == TAKEN, 1 - F.col("turn")).otherwise(F.col("turn"))
        after = met.where(~F.coalesce(passed, F.lit(False))).select(
            "node",
            F.when(F.coalesce(hit, F.lit(False)), nothing).when(single, F.col("via")).otherwise(F.col("on")).alias("on"),
            F.when(F.coalesce(hit, F.lit(False)), REFUSED).when(single, turned).otherwise(F.col("state")).alias("state"),
        )
        ended = facts.where("refused").select("node", nothing.alias("on"), F.lit(REFUSED).alias("state"))
        now = stored(after.unionByName(ended).distinct(), "edges")
    raise RuntimeError(f"undecided after {rounds} rounds")


def last_before(events: DataFrame, by: list[str], rank: str, source: str, name: str) -> DataFrame:
    """Adds `name`: the highest lower rank of the same `by` whose boolean `source` is true.

    Ranks are first looked up inside blocks, and the blocks' last ones are then handed on, so no task holds a whole `by`.
    """
    rows = events.withColumn("__b", F.floor(F.col(rank) / BLOCK)).withColumn("__s", F.when(F.col(source), F.col(rank)))
    earlier = lambda *k: Window.partitionBy(*k).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.max("__s").over(earlier(*by, "__b").orderBy(rank))
    lasts = rows.groupBy(*by, "__b").agg(F.max("__s").alias("__last"))
    lasts = lasts.select(*by, "__b", F.max("__last").over(earlier(*by).orderBy("__b")).alias("__before"))
    return rows.withColumn("__in", inside).join(lasts, [*by, "__b"]).select(*events.columns, F.coalesce("__in", "__before").alias(name))


def one_of_each(rows: DataFrame, rank: str, key: str, slot: int, slots: int) -> DataFrame:
    """Edges by which at most one row of each key is taken; null keys exclude nothing.

    Nodes are rank * slots for rows and rank * slots + slot for the gates behind them.
    """
    known = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(rank).alias("r"), F.lit(True).alias("all"))
    linked = last_before(known, ["k"], "r", "all", "p")
    gate = lambda c: F.col(c) * slots + slot
    edge = lambda node, on, state: F.struct(node.alias("node"), on.alias("on"), F.lit(state).alias("state"))
    row = F.col("r") * slots
    three = F.array(edge(row, gate("p"), REFUSED), edge(gate("r"), gate("p"), REFUSED), edge(gate("r"), row, TAKEN))
    return linked.select(F.explode(three).alias("e")).where("e.on IS NOT NULL").select("e.*")


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select("a", "b").unionByName(pairs.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def near_edges(rows: DataFrame, rank: str, unit: str, pairs: DataFrame, slot: int, slots: int) -> DataFrame:
    """Edges from rows to the last gates before them of their units' partners."""
    members = rows.select(F.col(unit).alias("u"), F.col(rank).alias("r"))
    sides = both_ways(pairs)
    needs = sides.join(members, F.col("a") == F.col("u")).select("a", "b", "r", F.lit(False).alias("other"))
    gives = sides.join(members, F.col("b") == F.col("u")).select("a", "b", "r", F.lit(True).alias("other"))
    linked = last_before(needs.unionByName(gives), ["a", "b"], "r", "other", "p").where("NOT other AND p IS NOT NULL")
    return linked.select((F.col("r") * slots).alias("node"), (F.col("p") * slots + slot).alias("on"), F.lit(REFUSED).alias("state"))


def independent(rows: DataFrame, rank: str, keys: list[str], unit: str, pairs: DataFrame) -> DataFrame:
    """The rows that a pass in order of `rank` (a long from 0, unique) takes: one of each key and unit, and none near an earlier one.

    In each round the rows are taken that come first among the open rows of all their keys, their unit and its partners, and whatever they exclude is closed: most
    rows are in few rounds.  What is open after ROUNDS of them, as in long chains of exclusions, is `settled`.
    """
    kinds = rows.select(rank, *keys, unit)
    sides = both_ways(pairs)
    taken, live = [], kinds
    for _ in range(ROUNDS):
        firsts = [live.where(F.col(c).isNotNull()).groupBy(c).agg(F.min(rank).alias(f"__f{i}")) for i, c in enumerate([*keys, unit])]
        beside = sides.join(firsts[-1].select(F.col(unit).alias("b"), F.col(f"__f{len(keys)}").alias("__p")), "b").groupBy(F.col("a").alias(unit)).agg(F.min("__p").alias("__p"))
        met = reduce(lambda left, f: left.join(f, f.columns[0], "left"), [*firsts, beside], live)
        own = [F.coalesce(F.col(f"__f{i}") == F.col(rank), F.lit(True)) for i in range(len(firsts))]
        first = reduce(lambda a, b: a & b, own, F.coalesce(F.col("__p") > F.col(rank), F.lit(True)))
        marked = stored(met.select(rank, *keys, unit, first.alias("__first")), "marked")
        now = marked.where("__first").drop("__first")
        taken.append(now.select(rank))
        units = now.select(F.col(unit).alias("b")).where("b IS NOT NULL")
        closed = [now.select(k).where(F.col(k).isNotNull()) for k in keys] + [units.unionByName(sides.join(units, "b").select(F.col("a").alias("b"))).distinct().withColumnRenamed("b", unit)]
        live = stored(reduce(lambda left, c: left.join(c, c.columns[0], "left_anti"), closed, marked.where("NOT __first").drop("__first")), "live")
        if live.isEmpty():
            break
    else:
        taken.append(chained(live, rank, keys, unit, pairs).select(rank))
    return rows.join(reduce(DataFrame.unionByName, taken), rank, "left_semi")


def chained(rows: DataFrame, rank: str, keys: list[str], unit: str, pairs: DataFrame) -> DataFrame:
    """As `independent`, by edges that are `settled`: few rounds also for long chains."""
    slots = len(keys) + 2
    edges = [one_of_each(rows, rank, k, i, slots) for i, k in enumerate([*keys, unit], 1)]
    edges.append(near_edges(rows, rank, unit, pairs, slots - 1, slots))
    refused = settled(reduce(DataFrame.unionByName, edges))
    rows_refused = refused.where(F.col("node") % slots == 0).select((F.col("node") / slots).cast("long").alias(rank))
    return rows.join(rows_refused, rank, "left_anti")


def cuts(taken: DataFrame, rank: str, bucket: str, quotas: DataFrame) -> DataFrame:
    """bucket and the rank of the row that fills it, of buckets that are filled.  A quota of none is filled before all ranks."""
    most = quotas.agg(F.max("quota")).first()[0] or 0
    place = F.row_number().over(Window.partitionBy(bucket).orderBy(rank))
    filled = taken.withColumn("__i", place).where(F.col("__i") <= most).join(quotas, bucket).where(F.col("__i") == F.col("quota")).select(bucket, F.col(rank).alias("cut"))
    return filled.unionByName(quotas.where("quota <= 0").select(bucket, F.lit(-1).cast("long").alias("cut")))


def in_order(rows: DataFrame, rank: str, bucket: str, quotas: DataFrame, keys: list[str], unit: str, pairs: DataFrame, early: str, late: str) -> DataFrame:
    """Adds `reason` (null: taken) as a pass in order of `rank` gives it, the first of these that holds:

    quota_surplus (the bucket has its quota; one that isn't in `quotas` has none), what the column `early` says, repeated_key (an
    earlier taken row shares one of `keys`), what `late` says, near_duplicate (an earlier taken row has the same `unit`, or one that `pairs`, with columns a
    and b, puts beside it).  `early` and `late` are reasons that don't depend on other rows (null: none).
    """
    quotas = stored(quotas.select(bucket, F.col("quota").cast("long").alias("quota")), "quotas")
    rows = stored(rows, "rows")
    pairs = stored(pairs.select("a", "b"), "pairs")
    able = rows.where(F.col(early).isNull() & F.col(late).isNull()).select(rank, bucket, *keys, unit).join(quotas.select(bucket), bucket, "left_semi")
    able = stored(able, "able")
    closed = None
    while True:
        live = able if closed is None else able.join(closed, bucket, "left").where(F.col("cut").isNull() | (F.col(rank) <= F.col("cut"))).drop("cut")
        taken = stored(independent(live, rank, keys, unit, pairs), "taken")
        filled = stored(cuts(taken, rank, bucket, quotas), "cuts")
        beyond = stored(taken.join(filled, bucket).where(F.col(rank) > F.col("cut")).drop("cut"), "beyond")
        lost = live.join(taken.select(rank), rank, "left_anti").join(filled, bucket, "left").where(F.col("cut").isNull() | (F.col(rank) <= F.col("cut"))).drop("cut")
        first = excluded_by(stored(lost, "lost"), beyond, rank, keys, unit, pairs).agg(F.min(rank)).first()[0]
        if first is None:
            break
        closed = stored(filled.where(F.col("cut") < F.lit(first)), "closed")
    kept = stored(taken.join(beyond.select(rank), rank, "left_anti"), "kept")
    return with_reasons(rows, kept, filled, quotas, rank, bucket, keys, unit, pairs, early, late)


def excluded_by(rows: DataFrame, owners: DataFrame, rank: str, keys: list[str], unit: str, pairs: DataFrame) -> DataFrame:
    """rank, how ('key' or 'near') of rows that an earlier row of `owners` excludes; owners have at most one row of each key and unit."""

    def through(side: DataFrame, column: str, how: str) -> DataFrame:
        theirs = owners.where(F.col(column).isNotNull()).select(F.col(column).alias("__v"), F.col(rank).alias("__by"))
        return side.join(theirs, side["__w"] == theirs["__v"]).where(F.col("__by") < F.col(rank)).select(rank, F.lit(how).alias("how"))

    found = [through(rows.select(rank, F.col(k).alias("__w")), k, "key") for k in keys]
    found.append(through(rows.select(rank, F.col(unit).alias("__w")), unit, "near"))
    beside = rows.select(rank, F.col(unit).alias("a")).join(both_ways(pairs), "a").select(rank, F.col("b").alias("__w"))
    found.append(through(beside, unit, "near"))
    return reduce(DataFrame.unionByName, found)


def with_reasons(rows: DataFrame, kept: DataFrame, filled: DataFrame, quotas: DataFrame, rank: str, bucket: str, keys: list[str], unit: str, pairs: DataFrame, early: str, late: str) -> DataFrame:
    hits = excluded_by(rows, kept, rank, keys, unit, pairs).groupBy(rank).agg(F.bool_or(F.col("how") == "key").alias("__key"), F.bool_or(F.col("how") == "near").alias("__near"))
    limits = stored(quotas.join(filled, bucket, "left").select(bucket, F.lit(True).alias("__has"), "cut"), "limits")
    marked = rows.join(hits, rank, "left").join(limits, bucket, "left").join(kept.select(rank, F.lit(True).alias("__kept")), rank, "left")
    full = F.coalesce(F.col("__has").isNull() | (F.col(rank) > F.col("cut")), F.lit(False))
    reason = F.when(full, "quota_surplus").otherwise(F.coalesce(F.col(early), F.when(F.col("__key"), "repeated_key"), F.col(late), F.when(F.col("__near"), "near_duplicate")))
    return marked.select(*rows.columns, F.when(F.col("__kept").isNull(), reason).alias("reason"))
