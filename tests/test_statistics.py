"""Intervals, percentiles, schedules and duplicates: against numpy and plain passes."""

import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from decidra.functions import options as O
from decidra.functions import text as T
from decidra.operators import calibrate, dedup, metrics, sampling


def test_weights_add_up_and_are_even():
    """Every draw picks n clusters in all, and over many draws each one about as often as any other."""
    n, size, draws = 1000, 64, 400
    blocks = [calibrate.cluster_weights(min(size, n - i), draws, "s", i // size, n, size) for i in range(0, n, size)]
    w = np.concatenate(blocks, axis=1)
    assert w.shape == (draws, n) and (w.sum(axis=1) == n).all()
    # A multinomial weight has mean 1 and variance 1 - 1 / n; weights of two clusters are nearly independent.
    assert abs(w.var() - 1) < 0.02 and np.abs(w.mean(axis=0) - 1).max() < 5 / np.sqrt(draws)
    assert abs(np.corrcoef(w[:, 0], w[:, 500])[0, 1]) < 0.2


@pytest.mark.parametrize("block", [16, 4096])
def test_interval_is_near_numpy_s(spark, block):
    rng = np.random.default_rng(5)
    rows = [(int(g), float(v) if i % 9 else None) for i, (g, v) in enumerate(zip(rng.integers(0, 120, 900), rng.normal(2, 1, 900), strict=True))]
    draws = calibrate.bootstrap(spark.createDataFrame(rows, "g long, v double"), "g", "v", 600, "x", block)
    got = calibrate.interval(draws).first()
    sums = {}
    for g, v in rows:
        s, n = sums.get(g, (0, 0))
        sums[g] = (s + (v or 0), n + (v is not None))
    s, n = (np.array(x) for x in zip(*sums.values(), strict=True))
    picks = rng.integers(0, len(s), (4000, len(s)))
    means = s[picks].sum(axis=1) / n[picks].sum(axis=1)
    width = np.percentile(means, 97.5) - np.percentile(means, 2.5)
    assert abs(got["low"] - np.percentile(means, 2.5)) < 0.15 * width and abs(got["high"] - np.percentile(means, 97.5)) < 0.15 * width
    assert got["n_draws"] == 600 and {r["clusters"] for r in draws.collect()} == {len(s)}


def test_bootstrap_of_nothing(spark):
    none = spark.createDataFrame([], "g long, v double")
    assert calibrate.bootstrap(none, "g", "v", 5).count() == 0
    assert calibrate.interval(calibrate.bootstrap(none, "g", "v", 5)).first()["n_draws"] == 0


@pytest.mark.parametrize("n_partitions", [1, 9])
def test_percentiles_equal_numpy_s(spark, n_partitions):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *[round(rng.random(), 2) for _ in range(9)]])) for _ in range(500)] + [("one", 7.0), ("none", None)]
    spark.conf.set("spark.sql.shuffle.partitions", n_partitions)
    try:
        got = {r["k"]: (r["low"], r["p95"]) for r in metrics.percentiles(spark.createDataFrame(rows, "k string, v double"), "v", {"low": 0.0, "p95": 0.95}, "k").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    values = {k: [v for q, v in rows if q == k and v is not None] for k, _ in rows}
    assert set(got) == {k for k, v in values.items() if v}
    for k, (low, p95) in got.items():
        assert low == min(values[k]) and abs(p95 - np.percentile(values[k], 95)) < 1e-12


def test_sizes_are_balanced(spark):
    rows = spark.range(103).withColumn("id", F.when(F.col("id") < 100, F.col("id")))
    n = [r["count"] for r in sampling.balanced(rows, "id", [2, 4, 8], "k", "s").groupBy("k").count().collect()]
    assert sum(n) == 103 and max(n) - min(n) <= 1


def test_directories_keep_domains_together(spark):
    labels = F.array(*[F.struct(F.lit(f"{d}{i}").alias("label"), F.lit(d).alias("domain")) for d in "abc" for i in range(4)])
    rows = spark.range(60).withColumn("side", F.col("id") % 2 == 0).withColumn("order", O.directory(labels, F.col("side"), F.lit("s"), F.col("id").cast("string")))
    window = O.window_of(F.lit("b2"), F.col("order"), F.lit(5), F.lit("s"), F.col("id").cast("string"))
    made = rows.withColumn("w", window).collect()
    for r in made:
        assert sorted(r["order"]) == sorted(f"{d}{i}" for d in "abc" for i in range(4)) and "b2" in r["w"] and len(set(r["w"])) == 5
        runs = sum(a[0] != b[0] for a, b in zip(r["order"], r["order"][1:], strict=False))
        assert not r["side"] or runs == 2
    assert len({r["w"].index("b2") for r in made}) == 5 and len({tuple(r["order"]) for r in made}) == 60


def test_equal_decisions_of_a_benchmark(spark):
    rows = [
        (1, '{"a": "X  y"}', '{"q":"?"}', "t"), (2, '{"a":"x Y"}', '{"q": "?"}', "t"), (3, '{"a":"x y"}', '{"q":"!"}', "t"), (4, '{"a":1,"b":2}', "{}", "t"), (5, '{"b":2,"a":1}', "{}", "t"),
        (6, "[1]", "{}", "t"), (7, "[1]", "{}", "u"), (8, "[1]", "{}", "t"), (9, None, "{}", None), (10, None, "{}", None),
    ]
    got = {r["id"]: (r["decision"], r["canonical"]) for r in dedup.within_benchmark(spark.createDataFrame(rows, "id long, s string, q string, t string"), "id", "id", "s", "q", "t").collect()}
    assert got[1] == ("retain", 1) and got[2] == ("exclude", 1) and got[3] == ("retain", 3) and got[4] == ("retain", 4) and got[5] == ("retain", 5)
    assert got[6] == got[7] == got[8] == ("quarantine", 6) and got[9] == ("retain", 9) and got[10] == ("exclude", 9)


def test_coverage_of_classes(spark):
    rows = [("x", ["a", "b"], [0.5, 0.5]), ("x", ["b", "c"], [0.25, 0.75]), ("x", ["a", "c"], None), ("x", ["a", "c"], [1.0])]
    got = {r["option_id"]: (r["displayed"], r["target_mass"], r["n_argmax"]) for r in metrics.class_coverage(spark.createDataFrame(rows, "s string, option_ids array<string>, target array<double>"), "s").collect()}
    assert got == {"a": (3, 0.5, 1), "b": (2, 0.75, 1), "c": (3, 0.75, 1)}


def test_temperature_is_numpy_s_minimum(spark):
    rng = np.random.default_rng(1)
    rows = [("s" if i % 3 else "t", rng.normal(0, 2, 4).tolist(), int(rng.integers(0, 4))) for i in range(200)]
    rows = [(s, (np.array(z) + 3 * np.eye(4)[g] * (rng.random() < 0.6)).tolist(), g) for s, z, g in rows]
    fit = calibrate.fit_temperature(spark.createDataFrame(rows, "suite string, logits array<double>, gold_idx int"))

    def loss(t):
        nll = {"s": [], "t": []}
        for s, z, g in rows:
            z = np.array(z) / t
            nll[s].append(np.log(np.exp(z - z.max()).sum()) + z.max() - z[g])
        return np.mean([np.mean(v) for v in nll.values()])

    best = min(np.exp(np.linspace(np.log(0.05), np.log(20), 4000)), key=loss)
    assert abs(fit["temperature"] / best - 1) < 0.003 and abs(fit["nll_after"] - loss(best)) < 1e-6


def test_exact_normal_form_of_whole_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(60).collect()
    odd = ["ﬁ Ⅳ ℌ", "ẞ ß ΑΣ Σ", "İ ı", "a b\x1cc\x85d", "é é", "①½", "\U0001d400 ﷺ", "", "　", "ŉ ǰ ΐ", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*odd, *[r["text"] for r in docs]])], "i long, t string")
    plain = lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split())
    for r in rows.select("t", T.normal_exact(F.col("t")).alias("x")).collect():
        assert r["x"] == plain(r["t"])
