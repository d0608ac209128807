"""The trie of conversation prefixes: shared turns, subtree sizes and what a prefix cache would save.

Conversations are rebuilt (they begin with turns of another one), and every distinct sequence of their first turns is a node.
Nodes are found by fingerprints: a turn is known by the SHA-256 of its role and text, and a prefix by the polynomial
sum of its turns' numbers times powers of a base, modulo two primes, which numpy scans along range-sorted
turns give for all prefixes at once (`scan`).  Prefixes of equal depth and fingerprint are a candidate group, its
smallest conversation the representative.  Every group is verified turn by turn: by induction over the depth it is one prefix if
all members have the representative's last turn, that is if smallest and largest of each quarter of the digests
agree.  Turns of a group that doesn't hold are given a second number that tells them apart, which joins the fingerprints of
all longer prefixes, and groups are formed and verified again until all hold; fingerprints never decide alone.

The parent's fingerprint is the node's without its last term, so parents are found by one join.  Each conversation owns
the nodes it is smallest in: a path, as deeper prefixes have fewer members, hung from a node of a smaller conversation.  Sums
over subtrees are sums along paths plus those of hung paths: totals of hung paths are rolled up by
pointer doubling (as many rounds as the logarithm of how often paths hang from paths), and a scan from the deep end adds them up.

The hash over a node's member list is sequential by definition: sorted members are written as pieces of text by all tasks,
and one task for each node reads the pieces in order, holding one at a time.

Defined cases: null roles and texts are empty; a row without conv_id belongs to no conversation; turns of equal number (or none)
are ordered by role, text's first 64 characters and digest; repeated rows are repeated turns; an empty table has no
nodes, not even a root; only named columns are read, so extra ones can't clash; texts of any length are hashed whole, and
neither a conversation's turns nor a node's members are ever held by one task.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release
from .scan import running_sums

FAMILY, MOST_HEAD = 20, 4
PRIMES, BASES = (2147483647, 2147483629), (1000003, 998244353)
QUARTERS = ["q0", "q1", "q2", "q3"]
KEY, PARENT = ["depth", "g1", "g2", "s"], ["depth", "pg1", "pg2", "ps"]
ROUNDS = 40
#: A piece of a member list holds so many ids at most.
IDS = 4096


def numbers(role: Column, text: Column) -> list[Column]:
    """A turn's SHA-256 as four longs; role and text can't be read another way, as the role's length comes first."""
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 16 * i, 16), 16, -10).cast("long").alias(q) for i, q in enumerate(QUARTERS)]


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), the turn's numbers and its words."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    words = F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long")
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.substring(text, 1, 64).alias("begin"), *numbers(role, text), words.alias("words"))
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("begin"), *map(F.asc, QUARTERS)]
    ranked = running_sums(rows, "conv_id", order, lambda batch: {"pos": np.ones(batch.num_rows, np.int64)}, ["pos"], "trie-turns", salt=True)
    return materialize(ranked.select("conv_id", "pos", *QUARTERS, "words"), "trie-numbered")


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, depth, numbers, words, is_end: all turns of the rebuilt conversations, and a textless one of depth 0."""
    turn = F.struct("pos", *QUARTERS, "words")
    firsts = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < MOST_HEAD)).groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("first")).withColumnRenamed("conv_id", "base")
    own = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_HEAD
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumn("h", own.cast("int")).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    head = F.coalesce(F.slice("first", 1, F.col("h")), F.slice(F.array(turn_of_nothing()), 1, 0))
    convs = convs.join(firsts, "base", "left").select("conv_id", "h", "n", head.alias("head"))
    convs = materialize(convs.withColumn("length", F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "trie-conversations")
    zero = F.lit(0).cast("long")
    roots = convs.select("conv_id", zero.alias("depth"), *[zero.alias(c) for c in (*QUARTERS, "words")], "length")
    heads = convs.select("conv_id", "length", F.posexplode("head").alias("i", "t")).select("conv_id", (F.col("i") + 1).cast("long").alias("depth"), *[F.col("t")[c].alias(c) for c in (*QUARTERS, "words")], "length")
    rest = turns.join(convs.select("conv_id", "h", "length", F.size("head").alias("taken")), "conv_id").where("pos > h")
    rest = rest.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), *QUARTERS, "words", "length")
    every = roots.unionByName(heads).unionByName(rest)
    return every.select("conv_id", "depth", *QUARTERS, "words", (F.col("depth") == F.col("length")).alias("is_end"), zero.alias("split"))


def turn_of_nothing() -> Column:
    return F.struct(*[F.lit(0).cast("long").alias(c) for c in ("pos", *QUARTERS, "words")])


def power(base: int, exponents: np.ndarray, prime: int) -> np.ndarray:
    out, square = np.ones(len(exponents), np.uint64), np.uint64(base % prime)
    left, p = exponents.astype(np.uint64), np.uint64(prime)
    while left.any():
        out = np.where(left & np.uint64(1), out * square % p, out)
        square, left = square * square % p, left >> np.uint64(1)
    return out


def fingerprints(rows: DataFrame, primes: tuple[int, int]) -> DataFrame:
    """The rows with the fingerprint of their prefix: g1, g2 of the turns, s of what tells collided groups apart."""

    def terms(batch):
        depth = batch.column(1).to_numpy()
        number, split = (batch.column(i).to_numpy().view(np.uint64) for i in (2, 8))
        term = lambda x, b, p: (x % np.uint64(p) * power(b, depth, p) % np.uint64(p)).astype(np.int64)
        return {"g1": term(number, BASES[0], primes[0]), "g2": term(number, BASES[1], primes[1]), "s": term(split, BASES[1], PRIMES[0])}

    summed = running_sums(rows, "conv_id", [F.asc("depth")], terms, ["g1", "g2", "s"], "trie-prefixes")
    moduli = {"g1": primes[0], "g2": primes[1], "s": PRIMES[0]}
    return summed.select(*rows.columns, *[F.pmod(F.col(n), F.lit(p)).alias(n) for n, p in moduli.items()])


def groups_of(prefixes: DataFrame) -> DataFrame:
    spread = [f(q).alias(f"{q}_{n}") for q in QUARTERS for n, f in (("low", F.min), ("high", F.max))]
    return prefixes.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"), F.min("split").alias("split"), *spread)


def verified(turns: DataFrame, primes: tuple[int, int] = PRIMES) -> tuple[DataFrame, DataFrame]:
    """The prefixes with keys that stand for one sequence each, and their groups; both are written tables."""
    rows = rebuilt(turns)
    for turn in range(ROUNDS):
        prefixes = materialize(fingerprints(rows, primes), "trie-fingerprints")
        groups = materialize(groups_of(prefixes), "trie-groups")
        mixed = groups.where(" OR ".join(f"{q}_low <> {q}_high" for q in QUARTERS))
        if mixed.isEmpty():
            return prefixes, groups
        told = prefixes.join(mixed.select(*KEY, F.lit(True).alias("mixed")), KEY, "left")
        split = F.when(F.col("mixed"), F.xxhash64(*QUARTERS, F.lit(turn))).otherwise(F.col("split"))
        rows = told.withColumn("split", split).select(*rows.columns)
    raise RuntimeError("prefix fingerprints could not be told apart")


def parents_of(groups: DataFrame, primes: tuple[int, int]) -> DataFrame:
    """conv_id, depth, n_convs, words, parent_conv_id of every node; a node's key without its last term is its parent's."""

    @F.pandas_udf("struct<pg1: long, pg2: long, ps: long>")
    def before(depth, number, split, g1, g2, s):
        import pandas as pd

        out = {}
        for name, x, g, b, p in (("pg1", number, g1, BASES[0], primes[0]), ("pg2", number, g2, BASES[1], primes[1]), ("ps", split, s, BASES[1], PRIMES[0])):
            term = x.to_numpy(np.int64).view(np.uint64) % np.uint64(p) * power(b, depth.to_numpy(np.int64), p) % np.uint64(p)
            out[name] = (g.to_numpy(np.int64) - term.astype(np.int64)) % p
        return pd.DataFrame(out)

    nodes = groups.withColumn("before", before("depth", "q0_low", "split", "g1", "g2", "s")).select(*KEY, "conv_id", "n_convs", "words", "before.*")
    nodes = materialize(nodes, "trie-keyed")
    above = groups.select((F.col("depth") + 1).alias("depth"), F.col("g1").alias("pg1"), F.col("g2").alias("pg2"), F.col("s").alias("ps"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(above, PARENT, "left").select("conv_id", "depth", "n_convs", "words", "parent_conv_id")
    return materialize(out, "trie-parents")


def rolled_up(hung: DataFrame, values: list[str]) -> DataFrame:
    """conv_id and, of each value, the sum over the path and all paths that hang from it, directly or not."""
    now = materialize(hung.select("conv_id", F.col("parent_conv_id").alias("above"), *values), "trie-hung")
    while not now.where("above IS NOT NULL").isEmpty():
        added = now.where("above IS NOT NULL").groupBy(F.col("above").alias("conv_id")).agg(*[F.sum(v).alias(f"add_{v}") for v in values])
        ups = now.where("above IS NOT NULL").select(F.col("conv_id").alias("above"), F.col("above").alias("next"))
        grown = now.join(added, "conv_id", "left").select("conv_id", "above", *[(F.col(v) + F.coalesce(f"add_{v}", F.lit(0))).alias(v) for v in values])
        after = materialize(grown.join(ups, "above", "left").select("conv_id", F.col("next").alias("above"), *values), "trie-hung")
        release(now)
        now = after
    return now.drop("above")


def member_hashes(prefixes: DataFrame, groups: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256 of the nodes at which conversations end."""
    ends = prefixes.where("is_end").select(*KEY, F.col("conv_id").alias("member")).join(groups.select(*KEY, "conv_id"), KEY).select("conv_id", "depth", "member")

    def pieces(batches):
        task, k = TaskContext.get().partitionId(), itertools.count()
        for batch in batches:
            conv, depth, member = (c.to_numpy() for c in batch.columns)
            starts = np.flatnonzero(np.concatenate([[True], (conv[1:] != conv[:-1]) | (depth[1:] != depth[:-1])])) if len(conv) else []
            for a, b in zip(starts, [*starts[1:], len(conv)], strict=True):
                cuts = list(range(a, b, IDS))
                texts = [",".join(map(str, member[i : min(i + IDS, b)])) for i in cuts]
                yield pa.RecordBatch.from_arrays([pa.array(conv[cuts]), pa.array(depth[cuts]), pa.array([task] * len(cuts), pa.int64()), pa.array([next(k) for _ in cuts], pa.int64()), pa.array(texts, pa.string())], names=["conv_id", "depth", "task", "k", "ids"])

    def hashed(batches):
        node = state = None
        for batch in batches:
            done = []
            for conv, depth, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 4)), strict=True):
                if (conv, depth) != node:
                    if node:
                        done.append((*node, state.hexdigest()))
                    node, state = (conv, depth), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["conv_id", "depth", "ends_sha256"])
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.int64()), pa.array([state.hexdigest()])], names=["conv_id", "depth", "ends_sha256"])

    sorted_ends = ends.repartitionByRange("conv_id", "depth", "member").sortWithinPartitions("conv_id", "depth", "member")
    cut = sorted_ends.mapInArrow(pieces, "conv_id long, depth long, task long, k long, ids string")
    return cut.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "task", "k").mapInArrow(hashed, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """All nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    prefixes, groups = verified(numbered_turns(conversations), primes)
    nodes = parents_of(groups, primes)
    children = nodes.where("parent_conv_id IS NOT NULL").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = materialize(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("words")).withColumn("leaves", (F.col("n_children") == 0).cast("long")), "trie-nodes")

    paths = nodes.groupBy("conv_id").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    tops = nodes.where("parent_conv_id IS NULL OR parent_conv_id <> conv_id").select("conv_id", "parent_conv_id", (F.col("depth") - 1).alias("at"))
    hung = materialize(tops.join(paths, "conv_id"), "trie-paths")
    totals = rolled_up(hung, ["saved", "leaves"])
    below = hung.select("conv_id", "parent_conv_id", "at").where("parent_conv_id IS NOT NULL").join(totals, "conv_id")
    below = below.groupBy(F.col("parent_conv_id").alias("conv_id"), F.col("at").alias("depth")).agg(F.sum("saved").alias("saved_below"), F.sum("leaves").alias("leaves_below"))
    own = nodes.join(below, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("saved") + F.coalesce("saved_below", F.lit(0))).alias("saved"), (F.col("leaves") + F.coalesce("leaves_below", F.lit(0))).alias("leaves"),
    )
    summed = running_sums(own, "conv_id", [F.desc("depth")], lambda b: {"saved_tokens": b.column(5).to_numpy(), "n_leaves": b.column(6).to_numpy()}, ["saved_tokens", "n_leaves"], "trie-subtrees")
    out = summed.join(member_hashes(prefixes, groups), ["conv_id", "depth"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def op12(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = r"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
         {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS x
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT c, list(x ORDER BY pos) AS xs FROM t GROUP BY c
), h AS (
  SELECT c, xs, (xor(4294967295, list_reduce(list_transform(range(1, len(c::VARCHAR) + 1), lambda i: ascii((c::VARCHAR)[i])::BIGINT),
           lambda a, b: list_reduce(range(8), lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END, xor(a, b)), 4294967295)) % 4)::BIGINT AS h
  FROM own
), r AS (
  SELECT h.c, coalesce(b.xs, [])[1:h] || h.xs[h + 1:] AS xs FROM h LEFT JOIN own b ON b.c = h.c - h.c % 20
), p AS (
  SELECT c, d, xs[1:d] AS k, xs[d].text AS last, d = len(xs) AS is_end FROM (SELECT c, xs, unnest(range(len(xs) + 1)) AS d FROM r)
), n AS (
  SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, any_value(coalesce(len(regexp_extract_all(last, '[^ \t\n\x0B\f\r]+')), 0)) AS words,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (is_end), '')) AS ends_sha256
  FROM p GROUP BY d, k
), e AS (
  SELECT n.*, q.conv_id AS parent_conv_id FROM n LEFT JOIN n q ON q.d = n.d - 1 AND q.k = n.k[1:n.d - 1] AND n.d > 0
), f AS (
  SELECT e.*, coalesce(m, 0) AS n_children FROM e LEFT JOIN (SELECT parent_conv_id AS c, d - 1 AS d, count(*) AS m FROM e WHERE d > 0 GROUP BY ALL) g ON g.c = e.conv_id AND g.d = e.d
), s AS (
  SELECT u.conv_id, u.d, sum((CASE WHEN w.n_children = 0 THEN 1 ELSE 0 END)) AS n_leaves, sum((w.n_convs - 1) * w.words) AS saved_tokens
  FROM (SELECT *, unnest(range(d + 1)) AS j FROM f) w JOIN n u ON u.d = w.j AND u.k = w.k[1:w.j]
  GROUP BY u.conv_id, u.d
)
SELECT f.conv_id, f.d::BIGINT AS depth, parent_conv_id, n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM f JOIN s ON s.conv_id = f.conv_id AND s.d = f.d
"""
