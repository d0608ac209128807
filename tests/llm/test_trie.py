"""Conversation trie: against a plain trie of Python dicts, also with colliding fingerprints and hot conversations."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from decidra.llm import catalog, scan, trie

from .helpers import sf

TURNS = "conv_id long, turn long, role string, text string"
FIELDS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def by_hand(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    members = {}
    ends = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        family = c - int(c / 20) * 20 if abs(c) < 2**50 else 0
        whole = tuple(own.get(c - family, [])[:h] + turns[h:])
        ends.setdefault(whole, []).append(c)
        for d in range(len(whole) + 1):
            members.setdefault(whole[:d], []).append(c)
    out = set()
    for node, of in members.items():
        below = [n for n in members if n[: len(node)] == node]
        words = lambda n: len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        childless = lambda n: not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in members)
        out.add((
            min(of), len(node), min(members[node[:-1]]) if node else None, len(of), sum(len(m) == len(node) + 1 for m in below), sum(map(childless, below)),
            sum((len(members[n]) - 1) * words(n) for n in below), hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest(),
        ))
    return out


def got(frame, **how):
    rows = trie.prefix_trie(frame, **how).collect()
    out = {tuple(r[f] for f in FIELDS) for r in rows}
    assert len(out) == len(rows)
    return out


def some(seed, n=40, longest=6, words=("a", "b c", "")):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant"]), rng.choice(words)) for c in rng.sample(range(-30, 90), n) for t in range(rng.randint(1, longest))]


def test_equals_sql(same):
    same(catalog.QUERIES["op12_prefix_trie"], catalog.SQL["op12_prefix_trie"])


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_plain_trie(spark, seed):
    rows = some(seed)
    assert got(spark.createDataFrame(rows, TURNS)) == by_hand(rows)


def test_collisions_are_split(spark):
    """Primes of 3 and 5 make nearly every group of a depth one candidate."""
    rows = some(3, words=("a", "b c", "", "d", "e f g"))
    assert got(spark.createDataFrame(rows, TURNS), primes=(3, 5)) == by_hand(rows)


def test_odd_rows(spark):
    rows = [
        (1, None, None, None), (1, None, "", ""), (1, 2, "user", "x"), (2, 1, "user", "x"), (2, 1, "user", "x"), (None, 1, "user", "x"), (None, None, None, None),
        (7, 3, "system", "long " * 20_000), (9, 3, "system", "long " * 20_000), (20, 1, "a:b", "c"), (23, 1, "a", "b:c"), (24, 5, "r", "t"), (40, 1, "é", "\x00 漢 字"),
    ]
    frame = spark.createDataFrame(rows, TURNS)
    for name in ("depth", "n", "words", "g1", "split", "above"):
        frame = frame.withColumn(name, F.lit("clash"))
    assert got(frame) == by_hand(rows)
    empty = trie.prefix_trie(spark.createDataFrame([], TURNS))
    assert empty.count() == 0 and empty.columns == list(FIELDS)


def test_paths_that_hang_from_paths(spark):
    """Conversation i leaves the one before it after i turns, so that paths hang in a chain."""
    rows = [(20 * i, t, "user", f"turn {t}" if t < i or i == 1 else f"own {i} {t}") for i in range(1, 14) for t in range(16)]
    assert got(spark.createDataFrame(rows, TURNS)) == by_hand(rows)


def test_a_conversation_over_many_tasks(spark):
    """One conversation has most of the rows, many of them equal."""
    rows = [(5, t % 40 if t % 3 else None, "user", f"w{t % 7}") for t in range(300)] + some(4, n=10)
    spark.conf.set("spark.sql.shuffle.partitions", 13)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 11)
    try:
        rows = [r for r in rows if r[0] == 5] + [r for r in rows if r[0] != 5 and r[0] is not None]
        assert got(spark.createDataFrame(rows, TURNS)) == by_hand(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_member_lists_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "IDS", 3)
    rows = [(20 * c, 1, "user", "same") for c in range(-20, 50)]
    assert got(spark.createDataFrame(rows, TURNS)) == by_hand(rows)


@pytest.mark.parametrize("n_partitions", [1, 5, 40])
def test_running_sums(spark, n_partitions):
    import numpy as np

    rng = random.Random(n_partitions)
    rows = [(rng.choice([1, 1, 1, 2, 3, 4]), i, rng.randint(-5, 5)) for i in range(400)]
    want, so_far = {}, {}
    for k, i, v in rows:
        so_far[k] = so_far.get(k, 0) + v
        want[i] = so_far[k]
    frame = spark.createDataFrame(rows, "k long, i long, v long")
    spark.conf.set("spark.sql.shuffle.partitions", n_partitions)
    try:
        out = scan.running_sums(frame, "k", [F.asc("i")], lambda b: {"sum": b.column(2).to_numpy().astype(np.int64)}, ["sum"], "test")
        assert {r["i"]: r["sum"] for r in out.collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
