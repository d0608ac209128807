"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

A row descends the tree by one weighted draw a level: every child of the current node
draws -ln(u) / weight, u being a hash of the row's key and the child's name in (0, 1), and
the smallest draw wins.  A child's draw depends on its own name and weight alone, so when
a weight grows, a row can only move into that child's subtree, and when it shrinks, only
out of it; within unchanged subtrees nothing moves.

`tree(shards, base)` arranges the first `base` shards evenly in regions and racks and gives
each further shard a region of its own.  With `base` fixed, one more shard is then one more
region: it takes rows only into itself, and no other weight changes.

Defined cases: a null key hashes as the text `null`; a null text has no bytes, a size of 16
and checksum 0; repeated rows share a shard and get different slots; an empty table gives
an empty result; only `doc_id` and `text` are read, so extra columns can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gapless_rank, let, materialize

SHARDS = 40
REGION_SHARDS, RACK_SHARDS = 10, 5
DRAW_RANGE = float(1 << 53)


@dataclass(frozen=True)
class Node:
    """A subtree: its name, its own weight, and its children, or the shard of a leaf."""

    name: str
    weight: float
    children: tuple = field(default=())
    shard: int = -1


def tree(shards: int, base: int = SHARDS) -> Node:
    """The tree of `shards` shards of equal weight, of which the first `base` fill regions."""
    leaf = lambda s: Node(f"s{s}", 1.0, (), s)
    total = lambda name, kids: Node(name, sum(k.weight for k in kids), tuple(kids))
    first = min(shards, base)
    regions = []
    for a in range(0, first, REGION_SHARDS):
        inside = range(a, min(a + REGION_SHARDS, first))
        racks = [total(f"k{b}", [leaf(s) for s in inside[b - a : b - a + RACK_SHARDS]]) for b in range(a, inside[-1] + 1, RACK_SHARDS)]
        regions.append(total(f"r{a}", racks))
    regions += [total(f"r+{s}", [total(f"k+{s}", [leaf(s)])]) for s in range(base, shards)]
    return total("root", regions)


def draw(key: Column, name: Column, weight: Column) -> Column:
    """-ln(u) / weight with u from the upper 53 bits of a hash of the key and the child's name."""
    bits = F.shiftrightunsigned(F.xxhash64(key, name), 11).cast("double")
    return -F.log((bits + 0.5) / DRAW_RANGE) / weight


def children(root: Node) -> tuple[Column, int]:
    """The inner nodes' children as one constant table, and the tree's depth.

    Entry i lists the children of inner node i, the root being 0: name, weight and where a
    descent goes on, an inner node's number or, for the leaf of shard s, -1 - s.
    """
    inner, depth, level = [root], 0, [root]
    while level:
        level = [c for n in level for c in n.children if c.children]
        inner += level
        depth += 1
    number = {id(n): i for i, n in enumerate(inner)}
    entry = lambda c: F.struct(F.lit(c.name).alias("name"), F.lit(c.weight).alias("weight"), F.lit(number[id(c)] if c.children else -1 - c.shard).alias("to"))
    return F.array(*[F.array(*[entry(c) for c in n.children]) for n in inner]), depth


def place(key: Column, root: Node) -> Column:
    """The shard that `key` descends to.  Only the children of nodes on its way draw."""
    table, depth = children(root)

    def descend(at: Column) -> Column:
        draws = F.transform(F.get(table, at), lambda c: F.struct(draw(key, c["name"], c["weight"]).alias("d"), c["to"].alias("to")))
        return F.when(at < 0, at).otherwise(F.array_min(draws)["to"])

    at = F.lit(0)
    for _ in range(depth):
        at = let(at, descend)
    return -1 - at


def assign(docs: DataFrame, shards: int = SHARDS, base: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (gapless in the shard) and grown_shard of each row."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        place(key, tree(shards, base)).alias("shard"),
        place(key, tree(shards + 1, base)).alias("grown_shard"),
    )
    return gapless_rank(materialize(rows, "shards"), ["shard"], ["doc_id", "text_crc32"], "slot")


def op8(spark, sf_dir: str) -> DataFrame:
    rows = assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
