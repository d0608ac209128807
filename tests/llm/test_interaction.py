"""Filter audit: duplicates against plain comparison, counters against running every order."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from decidra.llm import catalog, interaction

from .helpers import docs, sf

LABELS = "doc_id long, quality int, toxic int"


def mask_of(row, rows):
    text = row["text"] or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    fails = [
        len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search(r"[#$%&*|]", text)),
        row["doc_id"] is not None and any(r["doc_id"] is not None and r["doc_id"] < row["doc_id"] and (r["text"] or "") == text for r in rows),
    ]
    return sum(f << i for i, f in enumerate(fails))


def masks(frame):
    rows = frame.select("doc_id", "source", "text").collect()
    return sorted(((-99 if r["doc_id"] is None else r["doc_id"]), r["source"] or "", mask_of(r, rows)) for r in rows)


def got_masks(frame):
    return sorted((-99 if r["doc_id"] is None else r["doc_id"], r["part"], r["mask"]) for r in interaction.failure_masks(frame).collect())


def test_equals_sql(same):
    same(catalog.QUERIES["op11_filter_audit"], catalog.SQL["op11_filter_audit"])


def test_odd_rows(spark):
    assert got_masks(docs(spark)) == masks(docs(spark))


@pytest.mark.parametrize("n_partitions", [1, 3, 16])
def test_groups_of_copies_over_many_tasks(spark, n_partitions):
    """Two thirds of all rows are copies of three texts; ids repeat and are missing."""
    rng = random.Random(n_partitions)
    rows = [(rng.choice([None, *range(-50, 400)]), rng.choice(["same text", "", None, "Other ONE", f"text {rng.randint(0, 60)}"]), "en", rng.choice(["a", "b", None]), 1) for _ in range(600)]
    frame = docs(spark, rows)
    spark.conf.set("spark.sql.shuffle.partitions", n_partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got_masks(frame) == masks(frame)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_equal_fingerprints_are_told_apart_by_their_texts(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, f"text {rng.randint(0, 40)}", "en", "a", 1) for i in range(200)]
    monkeypatch.setattr(interaction.F, "xxhash64", lambda *c: F.length(c[0]).cast("long"))
    assert got_masks(docs(spark, rows)) == masks(docs(spark, rows))


def test_small_batches(spark):
    """Runs go on from one Arrow batch to the next."""
    rows = [(i % 90, f"text {i % 4}", "en", "a", 1) for i in range(300)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert got_masks(docs(spark, rows)) == masks(docs(spark, rows))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_words_of_long_texts(monkeypatch):
    text = ("one two  three\nfour é five one " * 40).encode()
    whole = interaction.word_counts(text)
    monkeypatch.setattr(interaction, "PIECE", 11)
    assert interaction.word_counts(text) == whole == (280, 6)


def test_orders_are_as_if_run(spark):
    rng = random.Random(1)
    rows = [(m, part, rng.randint(0, 9), rng.randint(0, 3), rng.randint(0, 3)) for m in range(32) for part in ("", "x") if rng.random() < 0.8]
    counters = spark.createDataFrame(rows, "mask int, part string, n long, good long, toxic long")
    got = {(r["part"], r["filter_order"], r["step"]): r.asDict() for r in interaction.orders_table(counters).collect()}
    assert len(got) == 2 * 600
    removed_of = {}
    for part in ("", "x"):
        own = [r for r in rows if r[1] == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                gone, left = [r for r in left if r[0] & bit], [r for r in left if not r[0] & bit]
                out = got[part, "".join(order), step]
                total = lambda some, k=2: sum(r[k] for r in some)
                failing = [r for r in own if r[0] & bit]
                assert [out[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")] == [
                    total(left), total(gone), total(failing) - total(gone), total(r for r in own if r[0] == bit), total(gone, 3), total(gone, 4)]
                removed_of[part, letter] = removed_of.get((part, letter), 0) + total(gone)
    assert all(r["shapley"] == removed_of[r["part"], r["filter_order"][r["step"] - 1]] for r in got.values())


def test_repeated_labels_count_once(spark):
    frame = docs(spark, [(1, "a", "en", "s", 1), (1, "a", "en", "s", 1), (2, "b", "en", "s", 1), (None, "c", "en", "s", 1)])
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (1, None, None), (None, 1, 1), (3, 1, 1)], LABELS)
    row = interaction.audit(frame, labels).where("filter_order = 'ABCDE' AND step = 1").first()
    assert (row["removed"], row["good_lost"], row["toxic_lost"]) == (4, 2, 2)
    assert interaction.audit(docs(spark, []), labels).count() == 0
