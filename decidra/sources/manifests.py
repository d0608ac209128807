"""Manifests of many files: what is wrong with the entries, and with the files, found in one listing and one scan.

Entries are rows: path, target, format (jsonl, csv, parquet), compression (none, gzip), bytes, rows, copy_of (a target, for copies).  Row counts of all files of a format come from one scan that counts by file, so a
manifest of thousands of files is a few jobs; targets that lie in each other are found by the folders on the way to each target.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import stored

ENTRY = "path string, target string, format string, compression string, bytes long, rows long, copy_of string"


def inside(path: Column) -> Column:
    """Whether a path is relative, normal and stays inside: no empty part, no . or .., no backslash."""
    parts = F.split(path, "/", -1)
    return path.isNotNull() & ~path.contains("\\") & ~F.exists(parts, lambda p: p.isin("", ".", ".."))


def overlapping(entries: DataFrame, target: str = "target") -> DataFrame:
    """target, other: targets of two entries of which one is the other, or a folder on the way to it."""
    named = entries.select(F.monotonically_increasing_id().alias("i"), F.col(target).alias("t")).where("t IS NOT NULL")
    named = stored(named, "targets")
    parts = F.split("t", "/", -1)
    folders = named.select("i", "t", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("f"))
    met = folders.join(named.select(F.col("i").alias("j"), F.col("t").alias("other")), F.col("f") == F.col("other")).where("i <> j")
    return met.select(F.col("t").alias(target), "other").distinct()


def entry_problems(entries: DataFrame) -> DataFrame:
    """path, target, problem of entries that can't be right whatever the files are.

    path, target (not inside), duplicate_source, overlapping_target, format, compression, extension, negative, copy_source (no such target).
    """
    copy = F.col("copy_of").isNotNull()
    suffix = F.concat(F.lit("."), "format", F.when(F.col("compression") == "gzip", ".gz").otherwise(""))
    named = F.col("path").endswith(suffix) & F.col("target").endswith(F.concat(F.lit("."), "format"))
    own = F.array_compact(F.array(
        F.when(~copy & ~F.coalesce(inside(F.col("path")), F.lit(False)), "path"), F.when(~F.coalesce(inside(F.col("target")), F.lit(False)), "target"),
        F.when(~copy & ~F.coalesce(F.col("format").isin("jsonl", "csv", "parquet"), F.lit(False)), "format"), F.when(~copy & ~F.coalesce(F.col("compression").isin("none", "gzip"), F.lit(False)), "compression"),
        F.when(~copy & ~F.coalesce(named, F.lit(False)), "extension"), F.when(~copy & ~F.coalesce((F.col("bytes") >= 0) & (F.col("rows") >= 0), F.lit(False)), "negative"),
    ))
    each = entries.select("path", "target", F.explode(own).alias("problem"))
    twice = entries.where(~copy).groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("path")
    again = entries.where(~copy).join(twice, "path").select("path", "target", F.lit("duplicate_source").alias("problem"))
    met = entries.join(overlapping(entries).select("target").distinct(), "target").select("path", "target", F.lit("overlapping_target").alias("problem"))
    known = entries.where(~copy).select(F.col("target").alias("copy_of")).distinct()
    lost = entries.where(copy).join(known, "copy_of", "left_anti").select("path", "target", F.lit("copy_source").alias("problem"))
    return reduce(DataFrame.unionByName, [each, again, met, lost])


def files(spark: SparkSession, root: str) -> DataFrame:
    """path (relative to `root`) and bytes of all files below it; contents aren't read."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    uri = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toUri().toString().rstrip("/") + "/"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return found.select(relative(F.col("path"), uri).alias("path"), F.col("length").alias("bytes"))


def relative(path: Column, uri: str) -> Column:
    """What follows the root's path in a file's address, schemes of one or three slashes alike."""
    plain = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")
    return F.substr(plain(path), F.length(plain(F.lit(uri))) + 1)


def row_counts(spark: SparkSession, root: str, names: dict[str, list[str]]) -> DataFrame:
    """path and rows of text files by format: one scan for all JSON lines, one for all CSV (whose header doesn't count, and whose fields may have line breaks), one for Parquet's footers."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    uri = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toUri().toString().rstrip("/") + "/"
    out = []
    for kind, paths in sorted(names.items()):
        full = [f"{root.rstrip('/')}/{p}" for p in paths]
        if not full:
            continue
        if kind == "jsonl":
            rows = spark.read.text(full)
        elif kind == "csv":
            rows = spark.read.option("header", True).option("multiLine", True).csv(full, enforceSchema=True)
        else:
            rows = spark.read.parquet(*full)
        out.append(rows.select(relative(F.url_decode(F.col("_metadata.file_path")), uri).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("n")))
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], "path string, n long")


def problems(spark: SparkSession, root: str, entries: DataFrame) -> DataFrame:
    """path, target, problem of all entries: those of `entry_problems`, and for entries without any: missing, bytes, rows."""
    entries = stored(entries, "entries")
    wrong = stored(entry_problems(entries), "problems")
    sound = stored(entries.where("copy_of IS NULL").join(wrong.select("path", "target"), ["path", "target"], "left_anti"), "sound")
    there = sound.join(files(spark, root).withColumnRenamed("bytes", "found"), "path", "left")
    sized = stored(there.select("path", "target", "format", "rows", F.when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("bytes"), "bytes").alias("problem")), "sized")
    names: dict[str, list[str]] = {}
    # A manifest's entries: a stated list.
    for r in sized.where("problem IS NULL").select("format", "path").collect():
        names.setdefault(r["format"], []).append(r["path"])
    counted = sized.where("problem IS NULL").join(row_counts(spark, root, names), "path", "left")
    other = counted.where(F.coalesce("n", F.lit(0)) != F.col("rows")).select("path", "target", F.lit("rows").alias("problem"))
    return wrong.unionByName(sized.where("problem IS NOT NULL").select("path", "target", "problem")).unionByName(other)


def partition_report(spark: SparkSession, path: str, spec: dict) -> DataFrame:
    """name, expected, found, ok of a frozen partition (JSON lines of _meta.id, _meta.source and questions) against its spec: sha256, records, questions, by_source, and ids used twice.

    The file's digest is one pass; everything else is one scan that counts by source.
    """
    digest = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("found")).select(F.lit("sha256").alias("name"), F.lit(spec["sha256"]).alias("expected"), "found")
    rows = spark.read.text(path).select(F.from_json("value", "_meta struct<id:string,source:string>, questions map<string,string>").alias("r"))
    rows = stored(rows.select(F.col("r._meta.id").alias("id"), F.col("r._meta.source").alias("source"), F.coalesce(F.size("r.questions"), F.lit(0)).alias("q")), "records")
    sources = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("q").alias("q"))
    sums = sources.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("q"), F.lit(0)).alias("q"))
    totals = sums.select(F.explode(F.array(F.struct(F.lit("records").alias("name"), F.lit(str(spec["records"])).alias("expected"), F.col("n").cast("string").alias("found")), F.struct(F.lit("questions").alias("name"), F.lit(str(spec["questions"])).alias("expected"), F.col("q").cast("string").alias("found")))).alias("x")).select("x.*")
    wanted = spark.createDataFrame(sorted(spec["by_source"].items()), "source string, expected long")
    each = sources.join(wanted, "source", "full_outer").select(F.concat(F.lit("source:"), F.coalesce("source", F.lit(""))).alias("name"), F.coalesce("expected", F.lit(0)).cast("string").alias("expected"), F.coalesce("n", F.lit(0)).cast("string").alias("found"))
    again = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR id IS NULL").agg(F.count(F.lit(1)).cast("string").alias("found")).select(F.lit("repeated_ids").alias("name"), F.lit("0").alias("expected"), "found")
    every = reduce(DataFrame.unionByName, [digest, totals, each, again])
    return every.withColumn("ok", F.col("expected").eqNullSafe(F.col("found")))
