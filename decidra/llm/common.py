"""Shared plumbing of the training-data operators.

Anything an operator reads more than once is written once as a Parquet table in the
folder that ``spark.checkpoint.dir`` names, and read back.  Such a table is shared by
all executors, so losing one never loses a result, and the lineage behind it is cut.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Arrow batches that reach Python hold at most so many bytes, however long the texts are.
BATCH_BYTES = 4 << 20


def shared_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; only where none is configured and one process does all, a local one."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "decidra-shared")
    return root.rstrip("/")


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write `df` to the shared folder once, if asked in folders by a column, and return the table."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/tables/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def release(table: DataFrame, part: str = "") -> None:
    """Delete a table made by `materialize`, or one of its folders, that nothing reads any more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{table.written_to}/{part}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch, so that very long texts can't fill a Python worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        if int(spark.conf.get(key)) <= BATCH_BYTES:
            return
    except Exception:  # the setting is unset or written with a unit
        pass
    spark.conf.set(key, str(BATCH_BYTES))


def tidy() -> None:
    """Give freed memory back to the system: Python workers live on and would keep it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once, also where `body` uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, op) -> Column:
    """The first value, `op` of the first two, of the first three and so on; in blocks, as an array grows by being copied."""

    def along(a: Column) -> Column:
        return F.aggregate(F.slice(a, 2, F.size(a)), F.slice(a, 1, 1), lambda acc, x: F.array_append(acc, op(F.element_at(acc, -1), x)))

    starts = F.filter(F.sequence(F.lit(1), F.size(values) + 1, F.lit(64)), lambda i: i <= F.size(values))

    def laid(blocks: Column) -> Column:
        with_carried = lambda carried: F.flatten(F.transform(blocks, lambda b, i: F.when(i == 0, b).otherwise(let(F.get(carried, i - 1), lambda c: F.transform(b, lambda x: op(c, x))))))
        return let(along(F.transform(blocks, lambda b: F.element_at(b, -1))), with_carried)

    return let(F.transform(starts, lambda i: along(F.slice(values, i, F.lit(64)))), lambda blocks: let(blocks, laid))


def gapless_rank(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Number the rows of each key from 0 without gaps, in a column `name` (long).

    `rows` must be a materialized table, as it is read twice, and its keys not null.  A key's rows are numbered in
    buckets by a hash of `order`, and the buckets of a key are then laid end to end, so no
    task holds a whole key, however hot it is.  Equal rows are told apart by their file and their place in it, which a task that runs again finds alike.
    """
    buckets = max(8, partitions(rows.sparkSession))
    salted = rows.withColumn("__row", F.col("_metadata.row_index")).withColumn("__file", F.xxhash64("_metadata.file_name")).withColumn("__bucket", F.pmod(F.xxhash64(*order, "__row", "__file"), F.lit(buckets)))
    each = [*keys, "__bucket"]
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy(*each).agg(F.count(F.lit(1)).alias("__n"))
    starts = starts.select(*each, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy(*each).orderBy(*order, "__row", "__file"))
    numbered = salted.withColumn("__inside", inside)
    out = numbered.join(starts, each).select(*[numbered[c] for c in rows.columns], (F.col("__inside") - 1 + F.col("__start")).cast("long").alias(name))
    return out
