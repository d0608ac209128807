"""Writers: they refuse to overwrite, keep a given order, and can be read back and compared."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import same_rows


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def json_lines(rows: DataFrame, path: str, order: list[str]) -> None:
    """JSON lines in the files' order by `order`, nulls written; the path must be new."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def document(spark: SparkSession, value: dict, path: str, replace: bool = False) -> None:
    """A small pretty JSON document; NaN is refused, and so is a path in use unless it's to be replaced."""
    text = json.dumps(value, ensure_ascii=False, indent=2, allow_nan=False) + "\n"
    p, fs = _fs(spark, path)
    stream = fs.create(p, replace)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def compatible(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Nested columns as JSON strings."""
    as_json = lambda c: F.to_json(F.col(c), {"ignoreNullFields": "false"}).alias(c)
    return rows.select(*[as_json(c) if c in columns else F.col(c) for c in rows.columns])


def bundle_tables(rows: DataFrame) -> dict[str, DataFrame]:
    """inputs, targets and provenance of evaluation rows, keyed by id."""
    return {
        "inputs": rows.select("id", "suite", "state", "qtype", "instructions", "options"),
        "targets": rows.select("id", "gold_idx", "soft", "gold_score", "option_ids"),
        "provenance": rows.select("id", "group_id", "suite", "source"),
    }


def write_bundle(rows: DataFrame, path: str) -> None:
    for name, table in bundle_tables(rows).items():
        table.write.mode("errorifexists").parquet(f"{path}/{name}")


def publish(spark: SparkSession, write, path: str) -> None:
    """`write(staging)` and then a rename to `path`, which must be new."""
    staging = f"{path}.staging"
    target, fs = _fs(spark, path)
    source, _ = _fs(spark, staging)
    if fs.exists(target):
        raise FileExistsError(path)
    fs.delete(source, True)
    write(staging)
    if not fs.rename(source, target):
        raise OSError(f"{path} can't be published")


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Give a file another name, which must be new."""
    a, fs = _fs(spark, source)
    b, _ = _fs(spark, target)
    if fs.exists(b) or not fs.rename(a, b):
        raise FileExistsError(target)


def quarantine(rows: DataFrame, path: str) -> DataFrame:
    """Write rejected rows and return their counts by reason."""
    bad = rows.where(F.col("reason").isNotNull())
    bad.write.mode("errorifexists").parquet(path)
    return rows.sparkSession.read.parquet(path).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def read_back(rows: DataFrame, path: str) -> DataFrame:
    """How many rows the written table and the given one don't share."""
    return same_rows(rows, rows.sparkSession.read.schema(rows.schema).parquet(path))


def markdown(rows: list[dict], columns: list[str]) -> str:
    """A table of a few result rows."""
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in rows]) + "\n"


def read_document(spark: SparkSession, path: str) -> dict | None:
    """A document's value; none if there is no such file."""
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return None
    return json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))
