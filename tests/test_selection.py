"""Selections that depend on earlier ones, against plain passes."""

import random

import pytest
from pyspark.sql import functions as F

from decidra.operators import coverage, dedup, sampling, selection, similarity

REQUIRE, STRATA = ["k", "kind"], ["source", "k", "kind"]


def plain_spread(rows, draw, limit):
    """A pass over all groups, one at a time."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    if len(rows) <= limit:
        return set(groups)
    at = {"source": 2, "k": 3, "kind": 4}
    values = {g: {f"{c}={r[at[c]]}" for r in rs for c in REQUIRE} for g, rs in groups.items()}
    strata = {g: {tuple(str(r[at[c]]) for c in STRATA) for r in rs} for g, rs in groups.items()}
    picked, left = [], limit
    for value in sorted(set().union(*values.values()), key=lambda v: (REQUIRE.index(v.split("=")[0]), v)):
        if any(value in values[g] for g in picked):
            continue
        g = min((g for g in groups if value in values[g]), key=lambda g: (len(groups[g]), draw[g]))
        if len(groups[g]) > left:
            raise coverage.Uncovered
        picked.append(g)
        left -= len(groups[g])
    progress = True
    while progress:
        progress = False
        for key in sorted(set().union(*strata.values())):
            fits = [g for g in groups if key in strata[g] and g not in picked and len(groups[g]) <= left]
            if fits:
                g = min(fits, key=draw.get)
                picked.append(g)
                left -= len(groups[g])
                progress = True
    return set(picked)


@pytest.mark.parametrize("seed,limit,at_once", [(1, 40, 1), (2, 25, 16), (3, 70, 2), (4, 1000, 16)])
def test_spread_equals_a_plain_pass(spark, seed, limit, at_once):
    rng = random.Random(seed)
    rows = [(i, rng.randint(0, 60), rng.choice("abc"), rng.choice([2, 5, 120]), rng.choice(["hard", "soft"])) for i in range(200)]
    items = spark.createDataFrame(rows, "id long, g long, source string, k int, kind string")
    draw = {r["g"]: r["d"] for r in items.select("g", sampling.drawn("s", "g").alias("d")).distinct().collect()}
    got = coverage.covering_spread(items, "g", STRATA, REQUIRE, limit, "s", at_once).collect()
    want = plain_spread(rows, draw, limit)
    assert {r["g"] for r in got} == want and len(got) == sum(r[1] in want for r in rows) <= max(limit, 200)


def test_spread_that_cannot_cover(spark):
    items = spark.createDataFrame([(i, i // 5, "a", i // 5, "hard") for i in range(20)], "id long, g long, source string, k int, kind string")
    with pytest.raises(coverage.Uncovered):
        coverage.covering_spread(items, "g", STRATA, REQUIRE, 7, "s")


def test_a_group_without_key_and_null_values(spark):
    rows = [(i, None if i < 4 else i, None, None, "hard") for i in range(12)]
    items = spark.createDataFrame(rows, "id long, g long, source string, k int, kind string")
    assert coverage.covering_spread(items, "g", STRATA, REQUIRE, 11, "s").count() <= 11


def plain_pass(rows, pairs, quotas):
    """rows: rank, bucket, key, unit, early, late."""
    beside = {(a, b) for a, b in pairs} | {(b, a) for a, b in pairs}
    taken, out = [], {}
    for r in sorted(rows):
        rank, bucket, key, unit, early, late = r
        if bucket not in quotas or sum(t[1] == bucket for t in taken) >= quotas[bucket]:
            reason = "quota_surplus"
        elif early:
            reason = early
        elif key is not None and any(t[2] == key for t in taken):
            reason = "repeated_key"
        elif late:
            reason = late
        elif unit is not None and any(t[3] is not None and (t[3] == unit or (t[3], unit) in beside) for t in taken):
            reason = "near_duplicate"
        else:
            reason = None
            taken.append(r)
        out[rank] = reason
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_selection_equals_a_plain_pass(spark, seed, monkeypatch):
    monkeypatch.setattr(selection, "BLOCK", 16)
    rng = random.Random(seed)
    some = lambda values, often: rng.choice(values) if rng.random() < often else None
    rows = [(i, rng.choice("abc"), some(range(40), 0.6), some(range(30), 0.8), some(["short"], 0.1), some(["external"], 0.1)) for i in rng.sample(range(500), 120)]
    rows += [(600, "d", None, None, None, None), (601, None, None, None, None, None)]
    pairs = [(rng.randrange(30), rng.randrange(30)) for _ in range(25)]
    quotas = {"a": 6, "b": 15, "c": 1000, "e": 0}
    frame = spark.createDataFrame(rows, "rank long, bucket string, key long, unit long, early string, late string")
    got = selection.in_order(frame, "rank", "bucket", spark.createDataFrame([*quotas.items()], "bucket string, quota long"), ["key"], "unit", spark.createDataFrame(pairs, "a long, b long"), "early", "late")
    assert {r["rank"]: r["reason"] for r in got.collect()} == plain_pass([r for r in rows if r[1]], pairs, quotas) | {601: "quota_surplus"}


def test_a_long_chain_takes_few_rounds(spark):
    """Each of 1,000 rows excludes the next one: every other row is refused."""
    chain = spark.range(1, 1000).select(F.col("id").alias("node"), (F.col("id") - 1).alias("on"), F.lit(selection.TAKEN).alias("state"))
    assert {r["node"] for r in selection.settled(chain, rounds=20).collect()} == set(range(1, 1000, 2))


def test_a_hot_key_takes_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(selection, "BLOCK", 100)
    rows = spark.range(1, 2000).select(F.col("id").alias("rank"), F.lit("same").alias("key"), F.lit(None).cast("long").alias("unit"))
    none = spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(selection.settled, "__defaults__", (20,))
    assert [r["rank"] for r in selection.independent(rows, "rank", ["key"], "unit", none).collect()] == [1]


@pytest.mark.parametrize("seed", [1, 2])
def test_first_independent_equals_a_plain_pass(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(60)]
    order = {n: rng.randint(0, 20) for n in names}
    conflicts = [tuple(rng.sample(names, 2)) for _ in range(90)] + [("n1", "n1")]
    beside = {frozenset(p) for p in conflicts}
    kept = []
    for n in sorted(names, key=lambda n: (order[n], n)):
        if not any(frozenset((n, k)) in beside for k in kept):
            kept.append(n)
    nodes = spark.createDataFrame([*order.items()], "name string, at long")
    got = dedup.first_independent(nodes, spark.createDataFrame(conflicts, "a string, b string"), "name", "at")
    assert {r["name"] for r in got.collect()} == set(kept)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_components_equal_all_pairs(spark, seed):
    """Chains and clusters of near copies, among them some that only meet through others."""
    from decidra.operators import similarity

    rng = random.Random(seed)
    texts = []
    for _ in range(6):
        base = rng.choices([f"w{i}" for i in range(200)], k=rng.choice([14, 30, 60]))
        for _ in range(rng.randint(1, 9)):
            texts.append(list(base))
            base = [*base[:-1], f"x{rng.random()}"] if rng.random() < 0.5 else [*base, f"y{rng.random()}"]
    texts += [["a", "b"], ["a", "b"]]
    shingle = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)} if len(t) >= 12 else set()
    sets = [shingle(t) for t in texts]
    label = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(a):
                if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, tokens array<string>")
    assert {r["id"]: r["component"] for r in similarity.near_components(frame, "id").collect()} == dict(enumerate(label))


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_by_prefixes_equal_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(similarity, "EVERY", 1)
    rng = random.Random(seed)
    base = [[rng.choice("abcdefghij") for _ in range(rng.choice([12, 13, 40, 90]))] for _ in range(6)]
    texts = [["a"] * 12, ["a"] * 14, ["a", "b"] * 8, ["b", "a"] * 9]
    for _ in range(50):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2])):
            words[rng.randrange(len(words))] = rng.choice("abcxyz")
        texts.append(words + ["common", "line", "of", "all", "these", "texts"] * rng.choice([0, 1]))
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    wanted = {(a, b) for b in range(len(sets)) for a in range(b) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    frame = spark.createDataFrame([*enumerate(texts)], "id long, tokens array<string>")
    assert {tuple(r) for r in similarity.jaccard_pairs(frame, "id").collect()} == wanted
    whole = similarity.shingle_sets(frame, "id", "tokens", 5, 12)
    assert similarity.prefixes(whole, "id", 0.8).count() <= sum(len(s) // 5 + similarity.MEET for s in sets)


def test_plain_selections_need_no_edges(spark, monkeypatch):
    """Rows of few keys are decided in rounds; long chains are left to the edges, with the same result."""
    rows = [(i, i % 7, i % 11) for i in range(300)]
    frame = spark.createDataFrame(rows, "rank long, key long, unit long")
    pairs = spark.createDataFrame([(i, i + 1) for i in range(0, 10)], "a long, b long")
    got = lambda: sorted(r["rank"] for r in selection.independent(frame, "rank", ["key"], "unit", pairs).collect())
    taken = []
    for rank, key, unit in rows:
        if not any(key == k or abs(unit - u) <= 1 for k, u in taken):
            taken.append((key, unit))
    monkeypatch.setattr(selection, "ROUNDS", 1)
    chained = got()
    monkeypatch.setattr(selection, "ROUNDS", 12)
    monkeypatch.setattr(selection, "settled", None)
    assert got() == chained and [(r % 7, r % 11) for r in chained] == taken


def test_hubs_meet_units_of_like_size_only(spark, monkeypatch):
    """Parts of a text share all their shingles with it and are compared with it no more than with others."""
    whole = [f"w{i}" for i in range(100)]
    frame = spark.createDataFrame([(0, whole), *[(i + 1, whole[20 * i : 20 * i + 20]) for i in range(5)]], "id long, tokens array<string>")
    met, similar = [], similarity.similar
    monkeypatch.setattr(similarity, "similar", lambda pairs, *a: met.append(pairs.count()) or similar(pairs, *a))
    assert similarity.near_components(frame, "id").where("id <> component").isEmpty() and met == [0, 0]


def test_scores_of_few_queries_are_held_at_once():
    """A block of queries with a batch of 10,000 rows takes no more than 8 MB of scores."""
    import inspect

    from decidra.operators import shortlist

    assert inspect.signature(shortlist.nearest).parameters["block"].default * 10_000 * 8 <= 8_000_000
