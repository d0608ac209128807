"""A prediction run as a stream: a log that grows batch by batch, a status that can be read at any time, and a restart that goes on.

    ROOT/manifest.json   what the run is (model, profile and so on); a restart must bring the same
    ROOT/rows/batch_id=  the predictions of a batch; written over if the batch runs again
    ROOT/batches/        one line per finished batch: id, attempted, ok
    ROOT/status.json     running, complete or failed, with the error
    ROOT/checkpoint      where Structured Streaming keeps the offsets

A batch is finished once its line is written.  If the run dies between its rows and its line, or before its offsets are committed, the
restart gives the same rows the same batch id, and both are written over: every row is in the log once.  Readers see finished batches only.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import sinks


class OtherRun(ValueError):
    """The folder holds a run with another manifest, or one that is complete."""


def begin(spark: SparkSession, root: str, manifest: dict) -> None:
    """Write the manifest of a new run, or make sure that the one to go on with is the same and not complete."""
    manifest = json.loads(json.dumps(manifest))
    old = sinks.read_document(spark, f"{root}/manifest.json")
    if old is None:
        sinks.document(spark, manifest, f"{root}/manifest.json")
    elif old != manifest:
        raise OtherRun(f"{root} holds another run")
    elif (sinks.read_document(spark, f"{root}/status.json") or {}).get("status") == "complete":
        raise OtherRun(f"{root} is complete")


def write_batch(root: str, batch: DataFrame, batch_id: int) -> None:
    """The rows first, then the line that makes them count."""
    spark = batch.sparkSession
    path = f"{root}/rows/batch_id={batch_id}"
    batch.write.mode("overwrite").parquet(path)
    n = spark.read.schema(batch.schema).parquet(path).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "ok").alias("ok")).first()
    finish_batch(spark, root, {"batch": batch_id, "attempted": n["n"], "ok": n["ok"]})


def finish_batch(spark: SparkSession, root: str, line: dict) -> None:
    sinks.document(spark, line, f"{root}/batches/{line['batch']:08d}.json", replace=True)


def run(predictions: DataFrame, root: str, manifest: dict) -> dict:
    """Run a stream of predictions (with a column status) to its end, from where an earlier run has stopped; returns the status."""
    spark = predictions.sparkSession
    begin(spark, root, manifest)
    sinks.document(spark, {"status": "running"}, f"{root}/status.json", replace=True)
    query = predictions.writeStream.foreachBatch(lambda batch, i: write_batch(root, batch, i)).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except Exception as error:
        sinks.document(spark, {"status": "failed", "error": f"{type(error).__name__}: {error}"[:2000]}, f"{root}/status.json", replace=True)
        raise
    sinks.document(spark, {"status": "complete"}, f"{root}/status.json", replace=True)
    return status(spark, root)


def finished(spark: SparkSession, root: str) -> DataFrame:
    """batch, attempted, ok of every finished batch."""
    p, fs = sinks._fs(spark, f"{root}/batches")
    if not fs.exists(p):
        return spark.createDataFrame([], "batch long, attempted long, ok long")
    return spark.read.schema("batch long, attempted long, ok long").option("multiLine", True).json(f"{root}/batches")


def status(spark: SparkSession, root: str) -> dict:
    """status (and error) with the sums over finished batches."""
    n = finished(spark, root).agg(F.count(F.lit(1)).alias("batches"), F.coalesce(F.sum("attempted"), F.lit(0)).alias("attempted"), F.coalesce(F.sum("ok"), F.lit(0)).alias("ok")).first()
    return (sinks.read_document(spark, f"{root}/status.json") or {"status": "absent"}) | n.asDict()


def logged(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The log: `schema` and batch_id of all rows of finished batches."""
    rows = spark.read.schema(f"{schema}, batch_id long").parquet(f"{root}/rows")
    return rows.join(finished(spark, root).select(F.col("batch").alias("batch_id")), "batch_id", "left_semi")
