"""Bounded samples and unique places, whatever repeats."""

from pyspark.sql import functions as F

from decidra.llm import common, toxicity


def test_a_repeated_id_brings_one_row(spark, monkeypatch):
    """A doc_id that comes 100,000 times, a third of them toxic by its label, is one document of the sample."""
    rows = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("vile word "), (F.col("id") % 50).cast("string")).alias("text"))
    rows = rows.unionByName(spark.range(1000, 1400).select(F.col("id").alias("doc_id"), F.concat(F.lit("calm text "), F.col("id").cast("string")).alias("text")))
    rows = rows.unionByName(spark.range(2000, 2200).select(F.col("id").alias("doc_id"), F.concat(F.lit("vile rude words "), F.col("id").cast("string")).alias("text")))
    labels = spark.range(2000, 2200).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic")).unionByName(spark.range(1000, 1100).select(F.col("id").alias("doc_id"), F.lit(0).alias("toxic")))
    labels = labels.unionByName(spark.createDataFrame([(7, 1)], "doc_id long, toxic int"))
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda positive, unlabelled, prior: seen.append((len(positive), len(unlabelled))) or ({}, 0.0))
    toxicity.learn(rows, labels)
    positive, unlabelled = seen[0]
    assert 100 < positive <= 201 and 300 < unlabelled <= 601


def test_equal_rows_of_several_files_have_places_of_their_own(spark, tmp_path):
    path = str(tmp_path / "equal")
    spark.range(200).select(F.lit(1).alias("key"), F.lit("same").alias("v")).repartition(8).write.parquet(path)
    table = spark.read.parquet(path)
    places = [r["place"] for r in common.gapless_rank(table, ["key"], ["v"], "place").collect()]
    assert sorted(places) == list(range(200))


def test_more_texts_than_places_can_name_are_refused(spark, monkeypatch):
    import pytest

    from decidra.llm import lines

    rows = spark.createDataFrame([(i, f"a line of text, number {i}, that is long enough to be looked at. " * 3) for i in range(9)], "doc_id long, text string")
    assert lines.dedup_lines(rows).count() == 9
    monkeypatch.setattr(lines, "PLACE_BITS", 60)
    with pytest.raises(ValueError, match="9 texts"):
        lines.dedup_lines(rows)
