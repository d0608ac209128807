"""Running metrics of a prediction stream, from sums that add up over micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import scored


def running(stream: DataFrame, *keys: str) -> DataFrame:
    """n, accuracy and mean NLL so far: for the output modes complete and update."""
    marked = scored(stream)
    return marked.groupBy(*keys).agg(F.count("correct").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.avg("nll").alias("nll"))


def windowed(events: DataFrame, time: str, late: str, width: str, *keys: str) -> DataFrame:
    """Counts and sums of `value` per time window; rows later than `late` are left out."""
    kept = events.withWatermark(time, late)
    return kept.groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")
