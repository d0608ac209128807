"""Strict JSON lines, CSV and Parquet.

A JSON line is good if it's an object without repeated keys (at any depth), without NaN or
infinite numbers, written ones included, and not blank.  `json_lines` keeps bad lines with a
reason; `strict_json_lines` refuses them.
"""

from __future__ import annotations

import hashlib
import tomllib
import zipfile
from io import BytesIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.joins import duplicates, require_empty

#: A number in JSON text whose exponent takes it beyond the range of doubles.
HUGE = r"[eE]\+?0*(309|3[1-9][0-9]|[4-9][0-9]{2}|[1-9][0-9]{3,})"


def reason(line: Column) -> Column:
    """Why a line is bad; null for good ones."""
    value = F.try_parse_json(line)
    outside = F.regexp_replace(line, r'"(?:[^"\\]|\\.)*+"', '""')
    return (
        F.when(F.coalesce(F.trim(line), F.lit("")) == "", "blank_line")
        .when(value.isNull(), "malformed_json")
        .when(~F.schema_of_variant(value).startswith("OBJECT"), "record_not_object")
        .when(outside.rlike(HUGE), "number_not_finite")
    )


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The schema's columns with `line_text`, `file` and `reason` (null for good lines)."""
    lines = spark.read.text(path).select(F.col("value").alias("line_text"), F.input_file_name().alias("file"))
    ddl = schema if isinstance(schema, str) else schema.simpleString()
    parsed = F.from_json("line_text", ddl, {"mode": "PERMISSIVE", "allowNonNumericNumbers": "false"})
    marked = lines.withColumn("reason", reason(F.col("line_text")))
    return marked.withColumn("__r", F.when(F.col("reason").isNull(), parsed)).select("__r.*", "line_text", "file", "reason")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1) and line_text.  A file is read by one task, so that lines can be
    numbered: for source files of bounded size."""
    files = spark.read.format("binaryFile").load(path)
    lines = F.posexplode(F.split(F.regexp_replace(F.decode("content", "UTF-8"), "\n$", ""), "\n", -1))
    return files.select(F.col("path").alias("file"), lines.alias("line", "line_text")).withColumn("line", F.col("line") + 1)


def strict_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    rows = json_lines(spark, path, schema)
    require_empty(rows.where(F.col("reason").isNotNull()).select("file", "reason", "line_text"), "bad lines")
    return rows.drop("line_text", "file", "reason")


def quarantined(rows: DataFrame, record_id: str, split: str | None = None) -> DataFrame:
    """Adds reasons of records: no id, not of the train split, an id that came before.

    "Before" is by file and line text, as there is no order across files.
    """
    from pyspark.sql import Window

    again = F.row_number().over(Window.partitionBy(record_id).orderBy("file", "line_text")) > 1
    more = F.when(F.coalesce(F.col(record_id).cast("string"), F.lit("")) == "", "missing_record_id")
    if split:
        more = more.when(F.coalesce(F.col(split), F.lit("train")) != "train", "non_train_split")
    return rows.withColumn("reason", F.coalesce("reason", more.when(again, "duplicate_source_id")))


def line_counts(spark: SparkSession, path: str) -> DataFrame:
    """file, lines, bad: every line of JSON lines files is checked."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), reason(F.col("value")).alias("r"))
    return lines.groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.count("r").alias("bad"))


def csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a header, quoted line breaks and doubled quotes; bad rows are errors."""
    return spark.read.schema(schema).options(header=True, multiLine=True, quote='"', escape='"', mode="FAILFAST", enforceSchema=False).csv(path)


def csv_rows(spark: SparkSession, path: str, schema: StructType | str) -> int:
    return csv(spark, path, schema).count()


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.select(*columns) if columns else rows


def zip_lines(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """file, line, line_text of the only member of each archive that ends with `suffix`."""

    def run(frames):
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(BytesIO(content)) as archive:
                    members = [m for m in archive.namelist() if m.endswith(suffix)]
                    if len(members) != 1:
                        raise ValueError(f"{name}: {len(members)} members end with {suffix!r}")
                    with archive.open(members[0]) as stream:
                        batch = []
                        for number, line in enumerate(stream, 1):
                            batch.append((name, number, line.decode().rstrip("\r\n")))
                            if len(batch) >= 10_000:
                                yield pd.DataFrame(batch, columns=["file", "line", "line_text"])
                                batch = []
                        yield pd.DataFrame(batch, columns=["file", "line", "line_text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, line int, line_text string")


def toml_cases(spark: SparkSession, text: str) -> DataFrame:
    """One row per case of a TOML document of tasks: task_id, type, question, pos, state, expected."""
    import json

    rows = []
    for task in tomllib.loads(text).get("task", []):
        for pos, case in enumerate(task.get("cases", [])):
            question = task.get("question")
            rows.append((str(task["id"]), task.get("type"), question if question is None or isinstance(question, str) else json.dumps(question, ensure_ascii=False), pos, json.dumps(case.get("state"), ensure_ascii=False), json.dumps(case.get("expected"), ensure_ascii=False)))
    return spark.createDataFrame(rows, "task_id string, type string, question string, pos int, state string, expected string")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes and SHA-256 of whole files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def contained(root: str, relative: str) -> str:
    """root/relative, refused if it's absolute, climbs out or is empty."""
    parts = relative.split("/")
    if not relative or relative.startswith("/") or "\\" in relative or any(p in ("", ".", "..") for p in parts):
        raise ValueError(f"not a path inside: {relative!r}")
    return f"{root.rstrip('/')}/{relative}"


def profile(spark: SparkSession, root: str, suites: list[dict], schema: StructType | str) -> DataFrame:
    """All suites of a profile with `suite` and `suite_ord`.

    Each suite is {name, path, expected_count}; wrong counts and ids used twice are errors.
    """
    every = None
    for at, suite in enumerate(suites):
        rows = strict_json_lines(spark, contained(root, suite["path"]), schema).withColumn("suite", F.lit(suite["name"])).withColumn("suite_ord", F.lit(at))
        every = rows if every is None else every.unionByName(rows)
    counts = {r["suite"]: r["n"] for r in every.groupBy("suite").agg(F.count(F.lit(1)).alias("n")).collect()}
    for suite in suites:
        if counts.get(suite["name"], 0) != suite["expected_count"]:
            raise ValueError(f"{suite['name']}: {counts.get(suite['name'], 0)} rows, not {suite['expected_count']}")
    require_empty(duplicates(every, "id"), "ids used twice")
    return every


def manifest(spark: SparkSession, root: str, entries: list[dict]) -> dict[str, DataFrame]:
    """Files of a manifest by target: {target, path, format, rows, schema} or {target, copy_of}.

    Targets are unique; extensions fit the formats; row counts are checked.
    """
    out: dict[str, DataFrame] = {}
    for e in entries:
        if e["target"] in out:
            raise ValueError(f"target twice: {e['target']}")
        if "copy_of" in e:
            out[e["target"]] = out[e["copy_of"]]
            continue
        path, kind = contained(root, e["path"]), e["format"]
        if not path.removesuffix(".gz").endswith(f".{kind}"):
            raise ValueError(f"{path} isn't named like {kind}")
        rows = {"jsonl": strict_json_lines, "csv": csv}[kind](spark, path, e["schema"]) if kind != "parquet" else parquet(spark, path)
        if rows.count() != e["rows"]:
            raise ValueError(f"{path}: not {e['rows']} rows")
        out[e["target"]] = rows
    return out


def provenance_offenders(sources: DataFrame, forbidden: str) -> DataFrame:
    """Sources without revision or licence, or whose upstream matches a forbidden pattern."""
    missing = F.when(F.coalesce("revision", F.lit("")) == "", "revision").when(F.coalesce("license", F.lit("")) == "", "license").when(F.coalesce("upstream", F.lit("")).rlike(forbidden), "lineage")
    return sources.withColumn("problem", missing).where(F.col("problem").isNotNull())


def coalesced_exposures(rows: DataFrame) -> DataFrame:
    """Equal (namespace, record_id, split, state) once, with the references of all."""
    keys = ["namespace", "record_id", "split", "state"]
    return rows.groupBy(*keys).agg(F.min("exposure").alias("exposure"), F.array_sort(F.collect_set("exposure")).alias("references"))


def text_hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def suite_rows(rows: DataFrame, suite: str, text: str, label: str, labels: list[str], question: str, qtype: str = "choice") -> DataFrame:
    """A labelled table as evaluation rows: id, suite, group_id, state, qtype, instructions,
    options, option_ids, gold_idx.  Labels are numbers or names."""
    names = F.array(*[F.lit(x) for x in labels])
    number = F.col(label).cast("string").try_cast("int")
    gold = F.coalesce(number, (F.nullif(F.array_position(names, F.col(label).cast("string")), F.lit(0)) - 1).cast("int"))
    options = F.transform(names, lambda n: F.struct(n.alias("key"), F.lit(None).cast("string").alias("desc")))
    key = F.sha2(F.concat_ws("|", F.lit(suite), F.col(text)), 256)
    return rows.select(key.alias("id"), F.lit(suite).alias("suite"), key.alias("group_id"), F.col(text).alias("state"), F.lit(qtype).alias("qtype"), F.lit(question).alias("instructions"), options.alias("options"), names.alias("option_ids"), gold.alias("gold_idx"))


def label_conflicts(rows: DataFrame, label: str, domain: str) -> DataFrame:
    """Labels with more than one domain."""
    return rows.groupBy(label).agg(F.count_distinct(domain).alias("n")).where("n > 1")


def contiguous(rows: DataFrame, order: str, suite_ord: str) -> DataFrame:
    """Rows that come after a row of a later suite: offenders against suite order."""
    from pyspark.sql import Window

    firsts = rows.groupBy(suite_ord).agg(F.min(order).alias("first"), F.max(order).alias("last"))
    # One row per suite.
    w = Window.orderBy(suite_ord)
    return firsts.withColumn("__l", F.lag("last").over(w)).where(F.col("first") <= F.col("__l")).drop("__l")
