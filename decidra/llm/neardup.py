"""Near-duplicate detection by fast similarity sketching, banding and exact verification.

A document's set is its distinct shingles of K words.  The sketch has T coordinates.  In
round i < T every element is thrown into one bin by a hash of the round; an empty bin keeps
the smallest value of the first round that reached it; in the rounds T + j every element is
thrown into bin j.  So every coordinate gets filled, and the share of equal coordinates of two
sketches is as concentrated around the similarity as with independent permutations.

BANDS bands of T / BANDS coordinates select candidates: a pair at the threshold of 0.8 is
missed with a chance of (1 - 0.8 ** 4) ** 32 < 5e-8, a closer one with less.  Links are
confirmed on the full sets.

Equal sets are one node from the start, so exact copies cost no pairs.  A bucket (the nodes
of equal band) is not expanded into its pairs: each node is compared with one node of the
bucket, its hub: the node whose buckets hold most nodes in all, which is what a family's copies
have in common.  First every node is compared with the best of its hubs; then, where that left
a node and another of its hubs in different components, with those.  What then still has
different components in a bucket is settled in pairs of bounded blocks of the bucket: sketches
of 1024 coordinates meet in numpy, and only pairs of different components whose sizes allow
a link and whose sketches agree well enough are emitted, in the first band they share alone,
and confirmed on the full sets.  A
link inside a component can't change the result, so none that matters is left out.

Nothing is collected to the driver but counts.

Defined cases: a text without words has an empty set and links with nothing; null texts
are empty; a text of fewer than K words is one shingle; rows of equal doc_id have each the
component of their own text, and rows equal in both share their fate (in `near_duplicates`; `drop_near_duplicates`
leaves one row of a group); a null doc_id is never the smallest of a component that has another; equal texts are ties and the smallest doc_id stays; an
empty table gives an empty result; only the named columns are read, so extra columns
can't clash; texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, release

K, THRESHOLD = 5, 80
T, BANDS = 128, 32
#: Ids up to this many are broadcast (16 bytes each: 32 MB), more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Coordinates of the sketches that are compared inside unsettled buckets, a byte of each, and
#: the share of equal bytes that lets a pair through.  At a similarity of 0.8 that share has a
#: mean of 0.8 and a deviation of 0.0125: fewer than one such pair in 10 ** 6 is stopped.
FINE, FINE_SHARE = 1024, 0.735
#: Nodes of a block of a bucket; two blocks of a bucket meet in one task.
BLOCK = 512

_U = np.uint64
MULTIPLY = _U(0x9E3779B97F4A7C15)


def stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Words(dict):
    """Hashes of words; forgets all of them when it has met LIMIT words."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, words: Words, k: int = K) -> np.ndarray:
    """The sorted distinct hashes of a text's k-word shingles."""
    ws = (text or "").encode().lower().split()
    if not ws:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter((words[w] for w in ws), dtype=np.uint64, count=len(ws))
    size = min(k, len(h))
    out = np.full(len(h) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        out = stirred(out * MULTIPLY + h[i : len(h) - size + 1 + i])
    return np.unique(out)


LOW = _U(0xFFFFFFFF)
EMPTY = _U(0xFFFFFFFFFFFFFFFF)


class Sketcher:
    """Fast similarity sketches of `t` coordinates, a power of two."""

    def __init__(self, t: int):
        self.t, self.shift = t, _U(64 - (t - 1).bit_length())
        self.rounds = stirred(np.arange(1, 2 * t + 1, dtype=np.uint64) * MULTIPLY)

    def sketch(self, elements: np.ndarray) -> np.ndarray:
        """Of a set that isn't empty: the round in the high bits, then the value."""
        t, out = self.t, np.full(self.t, EMPTY)
        # Rounds are made together, so that small sets don't cost t single ones.
        together = max(1, min(t, 12_000 // len(elements)))
        for first in range(0, t, together):
            rounds = np.arange(first, min(t, first + together))
            h = stirred(elements[None, :] ^ self.rounds[rounds, None])
            value = (rounds.astype(np.uint64)[:, None] << _U(32)) | (h & LOW)
            at = (h >> self.shift).astype(np.int64)
            if first:
                new = out[at] >= (_U(first) << _U(32))
                at, value = at[new], value[new]
            np.minimum.at(out, at.ravel(), value.ravel())
            if (out != EMPTY).all():
                return out
        for j in np.flatnonzero(out == EMPTY):
            out[j] = (_U(t + j) << _U(32)) | (stirred(elements ^ self.rounds[t + j]) & LOW).min()
        return out


SKETCHER = Sketcher(T)


def sketch(elements: np.ndarray) -> np.ndarray:
    return SKETCHER.sketch(elements)


def bands(coordinates: np.ndarray) -> np.ndarray:
    rows = coordinates.reshape(BANDS, -1)
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * MULTIPLY
    for i in range(rows.shape[1]):
        out = stirred(out * MULTIPLY + rows[:, i])
    return out.view(np.int64)


def sketched(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, node (digest of the set, null if it's empty) and bands of each row."""
    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").alias("__text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import xxhash

        words = Words()
        for batch in batches:
            sizes, nodes, cut = [], [], []
            for text in batch.column(2).to_pylist():
                s = shingles(text, words, k)
                sizes.append(len(s))
                nodes.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                cut.append(bands(sketch(s)) if len(s) else None)
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(cut, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "n_shingles", "node", "bands"])

    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, n_shingles long, node binary, bands array<long>")


def by_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of `docs` with a doc_id of `ids`; texts are only shuffled if the counted ids are too many."""
    ids = ids.select(F.col("doc_id").alias("__id"))
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.join(side, docs["doc_id"].eqNullSafe(side["__id"]), "left_semi")


def matched(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows of `docs` whose doc_id and text hash are (left_semi) or aren't (left_anti) those of a row of `keys`."""
    keys = keys.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    side = F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys
    return docs.join(side, docs["doc_id"].eqNullSafe(side["__id"]) & (F.xxhash64(docs["text"]) == side["__hash"]), how)


def sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """node, n and set (sorted hashes as bytes) of the nodes in `wanted` (doc_id, node)."""
    rows = by_ids(docs.select("doc_id", F.col("text").alias("__text")), wanted).select("__text")

    def run(batches):
        import xxhash

        words = Words()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                s = shingles(text, words, k)
                data = s.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(data)], pa.binary()), pa.array([len(s)], pa.int64()), pa.array([data], pa.binary())], names=["node", "n", "set"])

    return rows.mapInArrow(run, "node binary, n long, set binary").dropDuplicates(["node"])


def linked(candidates: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) of `candidates` that the full sets confirm."""
    a = sets.select(F.col("node").alias("a"), F.col("n").alias("__na"), F.col("set").alias("__sa"))
    b = sets.select(F.col("node").alias("b"), F.col("n").alias("__nb"), F.col("set").alias("__sb"))
    both = candidates.select("a", "b").join(a, "a").join(b, "b")
    likely = both.where(100 * F.least("__na", "__nb") >= threshold * F.greatest("__na", "__nb"))

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                shared = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(100 * shared >= threshold * (len(x) + len(y) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return likely.select("a", "b", "__sa", "__sb").mapInArrow(run, "a binary, b binary")


def near_in_buckets(rest: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) of different components in a bucket whose fine sketches agree.

    `rest`: band, node, c (component) of buckets with more than one component.
    """
    nodes = rest.select("node").distinct()

    def finer(batches):
        sketcher = Sketcher(FINE)
        for batch in batches:
            sets_ = [np.frombuffer(x, dtype=np.uint64) for x in batch.column(2).to_pylist()]
            cut = [sketcher.sketch(x).astype(np.uint8).tobytes() for x in sets_]
            own = [bands(sketch(x)).tobytes() for x in sets_]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cut, pa.binary()), pa.array(own, pa.binary())], names=["node", "n", "fine", "own"])

    fine = materialize(sets.join(nodes, "node", "left_semi").select("node", "n", "set").mapInArrow(finer, "node binary, n long, fine binary, own binary"), "fine")
    # Nodes of a bucket's largest component fill the blocks behind those of all others, and don't meet each other.
    groups = rest.groupBy("band", "c").agg(F.count(F.lit(1)).alias("k")).groupBy("band").agg(F.max(F.struct("k", "c")).alias("main"), F.sum("k").alias("all"))
    blocks = lambda k: F.ceil(k / BLOCK).cast("int")
    groups = groups.select("band", F.col("main.c").alias("main"), blocks(F.col("main.k")).alias("inner"), blocks(F.col("all") - F.col("main.k")).alias("outer"))
    placed = rest.join(groups, "band").join(fine, "node").withColumn("own_", F.col("c") == F.col("main"))
    at = F.pmod(F.xxhash64("node"), F.when(F.col("own_"), F.col("inner")).otherwise(F.col("outer")))
    placed = placed.withColumn("i", (at + F.when(F.col("own_"), F.col("outer")).otherwise(0)).cast("int"))
    last = F.when(F.col("own_"), F.col("outer")).otherwise(F.col("outer") + F.col("inner")) - 1
    met = placed.select("band", "node", "c", "n", "fine", "own", "i", F.explode(F.sequence(F.lit(0), last)).alias("j"))
    met = met.select("band", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), "i", "node", "c", "n", "fine", "own")

    def meet(table: pa.Table) -> pa.Table:
        block, node, comp = table["i"].to_numpy(), table["node"].to_pylist(), table["c"].to_pylist()
        n, data = table["n"].to_numpy(), np.frombuffer(b"".join(table["fine"].to_pylist()), dtype=np.uint8).reshape(-1, FINE)
        own = np.frombuffer(b"".join(table["own"].to_pylist()), dtype=np.int64).reshape(-1, BANDS)
        place = int(np.flatnonzero(own[0] == table["band"][0].as_py())[0])
        numbers = {c: k for k, c in enumerate(dict.fromkeys(comp))}
        comp = np.array([numbers[c] for c in comp])
        x, y = table["x"][0].as_py(), table["y"][0].as_py()
        left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
        out = ([], [])
        for at, r in enumerate(left):
            others = right if x != y else right[at + 1 :]
            fit = (comp[others] != comp[r]) & (100 * np.minimum(n[others], n[r]) >= threshold * np.maximum(n[others], n[r]))
            others = others[fit]
            if len(others):
                others = others[np.argmax(own[others] == own[r], axis=1) == place]
                near = others[(data[others] == data[r]).sum(axis=1) >= FINE_SHARE * FINE]
                for q in near:
                    a, b = sorted((node[r], node[q]))
                    out[0].append(a)
                    out[1].append(b)
        return pa.table({"a": pa.array(out[0], pa.binary()), "b": pa.array(out[1], pa.binary())})

    return met.groupBy("band", "x", "y").applyInArrow(meet, "a binary, b binary").distinct()


def components(links: DataFrame) -> DataFrame:
    """node and label (the smallest node of its component) of all nodes that have a link.

    Alternating large and small stars: each step moves links towards the smallest neighbour,
    until every component is one star.  Steps are written tables; the only thing that the
    driver gets is a count and a checksum.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    mark = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
        mark = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large, "stars")
        near = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(near, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        after = materialize(small.where("a <> b").distinct(), "links")
        release(edges)
        release(large)
        edges = after


def joined(rows: DataFrame, labels: DataFrame, node: str, name: str) -> DataFrame:
    """Add the label of the column `node`: itself where it has no link."""
    known = labels.select(F.col("node").alias(node), F.col("label").alias("__l"))
    return rows.join(known, node, "left").withColumn(name, F.coalesce("__l", node)).drop("__l")


def grouped(docs: DataFrame, k: int = K, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, text_hash, n_shingles, __c (the component's name, null for an empty set) and component_id of each row of `docs`."""
    rows = materialize(sketched(docs, k), "sketches")
    full = rows.where(F.col("node").isNotNull())
    nodes = full.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"), F.min("bands").alias("bands"))
    cut = materialize(nodes.select("node", "doc_id", "n", F.explode("bands").alias("band")), "bands")
    # Written tables on one side let adaptive execution split a join's hot keys on the other.
    sizes = materialize(cut.groupBy("band").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "sizes")
    shared = materialize(cut.join(sizes, "band"), "shared")
    company = materialize(shared.groupBy("node").agg(F.sum("c").alias("w")), "company")
    hubs = shared.join(company, "node").groupBy("band").agg(F.max(F.struct("w", F.xxhash64("node").alias("o"), F.col("node").alias("hub"), F.col("n").alias("m"))).alias("h"))
    hubs = materialize(hubs.select("band", "h.hub", "h.m", "h.w"), "hubs")
    stars = materialize(shared.join(hubs, "band").select("node", "doc_id", "n", "band", "hub", "m", "w"), "buckets")
    wanted = stars.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    sets = materialize(sets_of(docs, materialize(wanted, "wanted"), k), "sets")
    pair = lambda rows: rows.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).where("a <> b").distinct()
    spokes = stars.where((F.col("node") != F.col("hub")) & (100 * F.least("n", "m") >= threshold * F.greatest("n", "m")))
    first = pair(spokes.groupBy("node").agg(F.max_by("hub", F.struct("w", F.xxhash64("hub"))).alias("hub")))
    links = materialize(linked(first, sets, threshold), "confirmed")
    labels = materialize(components(links), "labels")
    apart = lambda pairs: joined(joined(pairs, labels, "a", "__ca"), labels, "b", "__cb").where("__ca <> __cb").select("a", "b")
    links = links.unionByName(materialize(linked(apart(pair(spokes)), sets, threshold), "confirmed"))
    labels = materialize(components(links), "labels")
    member = joined(stars.select("band", "node", "n"), labels, "node", "c")
    mixed = member.groupBy("band").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("band")
    rest = materialize(member.join(mixed, "band").select("band", "node", "c"), "rest")
    last = near_in_buckets(rest, sets, threshold)
    links = links.unionByName(materialize(linked(last, sets, threshold), "confirmed"))
    labels = materialize(components(links), "labels")
    named = joined(rows.select("doc_id", "text_hash", "n_shingles", "node"), labels, "node", "__c")
    smallest = materialize(named.where(F.col("__c").isNotNull()).groupBy("__c").agg(F.min("doc_id").alias("__least")), "smallest")
    out = named.join(smallest, "__c", "left").withColumn("component_id", F.when(F.col("__c").isNull(), F.col("doc_id")).otherwise(F.col("__least")))
    return out.select("doc_id", "text_hash", "n_shingles", "__c", "component_id")


def near_duplicates(docs: DataFrame, k: int = K, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and kept of each row of `docs`."""
    out = grouped(docs, k, threshold)
    return out.select("doc_id", "text_hash", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, k: int = K, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of `docs` that stay: one of each group, that of the smallest doc_id and then text hash; of equal rows any.

    Rows without words are in no group and stay.
    """
    rows = materialize(grouped(docs, k, threshold).where(F.col("__c").isNotNull()), "near")
    least = rows.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("__c").agg(F.min("text_hash").alias("__h"))
    least = materialize(least, "least")
    marked = rows.join(least, "__c").withColumn("__stays", F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("__h")))
    keys = materialize(marked.groupBy("doc_id", "text_hash", "__stays").agg(F.count(F.lit(1)).alias("n")).where("NOT __stays OR n > 1"), "gone")
    left = matched(docs, keys.where("NOT __stays"), "left_anti")
    repeated = keys.where("__stays")
    if not repeated.limit(1).count():
        return left
    # Only rows that came several times are compared by their texts.
    return matched(left, repeated, "left_anti").unionByName(matched(left, repeated, "left_semi").dropDuplicates(["doc_id", "text"]))


def op9(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4).drop("text_hash")
