"""Line dedup by hashed runs of lines (native: DataFrame functions only).

A line ends at a line break; long lines are wrapped behind punctuation, so that a passage
that another text takes up in the middle of a line still has whole lines in common with it.
Lines are compared without the white space around them, and lines of white space are passed over.

A gram is a run of lines of MIN_CHARS characters or more, about 20 words, that would have fewer
without its last line or without its first one.  Both kinds are hashed at every place, none is left
out.  Whatever run of MIN_CHARS characters two places have in common is covered by grams that both
have, and any gram is long enough to be deleted, so a gram's first occurrence in the corpus (by
doc_id, then text hash, then place) decides: every later one is deleted.  The lines that go are
therefore exactly those in runs of MIN_CHARS characters or more that came before.  A run is only
deleted in favour of an earlier one, so one copy always stays.  Grams have 64-bit hashes: among
4 * 10^9 distinct ones, about 0.4 pairs share one.

Defined cases: null texts stay null, texts without repeated runs stay as they are to the
letter; null doc_ids come first; rows equal in doc_id and text are one text and repeat each
other's fate; an empty table gives an empty result; only `doc_id`, `text` and `n_chars`
have a meaning, other columns are carried along; inside, names start with two underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, materialize

MIN_CHARS = 120
#: Lines to look at first for a gram's end; MIN_CHARS lines always hold one, as none is empty.
AHEAD, FURTHER = 6, 20
LINE = r"[^\n.,;:!?]*+(?:[.,;:!?]++[ \n]*+|\n++|\z)"
#: Tables of texts' names and of what goes from them are broadcast up to so many bytes.
BROADCAST_BYTES = 32 << 20
#: Places in a text have so many bits, the texts' ranks the rest of 63; more texts are refused.
PLACE_BITS = 31


def lines_of(text: Column) -> Column:
    """The lines, each with the white space behind it; together they are the text."""
    return F.regexp_extract_all(text, F.lit(LINE), F.lit(0))


def ends(sizes: Column) -> Column:
    """For each line the place of the line with which the lines from it on reach MIN_CHARS characters, or null."""
    # A total below 2 ** 32 and, above it, how many lines it has, in one number.
    one, low = F.lit(1 << 32), F.lit((1 << 32) - 1)

    def end(size: Column, i: Column) -> Column:
        found, total = F.when(size >= MIN_CHARS, i), size
        for k in range(1, AHEAD):
            total = total + F.get(sizes, i + k)
            found = found.when(total >= MIN_CHARS, i + k)
        # Still shorter lines; near the text's end there is none.
        more = lambda a, x: F.when(a.bitwiseAND(low) >= MIN_CHARS, a).otherwise(a + one + x)
        last = lambda a: F.when(a.bitwiseAND(low) >= MIN_CHARS, i + F.shiftright(a, 32).cast("int") - 1)
        within = lambda n: F.aggregate(F.slice(sizes, i + 1, F.lit(n)), F.lit(0).cast("long"), more, last)
        return found.when(F.size(sizes) > i + AHEAD, F.coalesce(within(FURTHER), within(MIN_CHARS)))

    return F.transform(sizes, end)


def fingerprints(lines: Column) -> Column:
    """Structs f (hash), p (first place) and n (the last one's distance) of all grams; `lines` has structs x (hash), n (size) and p (place)."""

    def grams(hashes: Column, places: Column, last: Column) -> Column:
        def of(end: Column, i: Column) -> Column:
            # Until the next line's gram ends, longer ones begin here that would be too short without their first line.
            longest = F.greatest(end, F.coalesce(F.get(last, i + 1), F.size(last)) - 1)
            gram = lambda e: F.struct(F.xxhash64(F.slice(hashes, i + 1, e - i + 1)).alias("f"), F.get(places, i).alias("p"), (F.get(places, e) - F.get(places, i)).alias("n"))
            return F.when(longest == end, F.array(gram(end))).otherwise(F.transform(F.sequence(end, longest), gram))

        return F.flatten(F.transform(F.filter(last, lambda e: e.isNotNull()), of))

    sizes = let(F.transform(lines, lambda x: x["n"]), ends)
    return let(F.transform(lines, lambda x: x["x"]), lambda hashes: let(F.transform(lines, lambda x: x["p"]), lambda places: let(sizes, lambda last: grams(hashes, places, last))))


def ranked(docs: DataFrame) -> DataFrame:
    """__d, __h (the text's name) and __rank, from 0 without gaps, of each text of MIN_CHARS characters or more."""
    names = docs.where(F.length("text") >= MIN_CHARS).select(F.col("doc_id").alias("__d"), F.xxhash64("text").alias("__h")).distinct()
    # Written before the sort, which reads its rows twice.  Sorted partitions follow each other; the number has the partition above 33 bits.
    rows = materialize(materialize(names, "unsorted").orderBy("__d", "__h").withColumn("__m", F.monotonically_increasing_id()), "names")
    part = F.shiftright("__m", 33)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n")).select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    return rows.join(F.broadcast(starts), part == F.col("__part")).select("__d", "__h", (F.col("__start") + F.col("__m").bitwiseAND((1 << 33) - 1)).alias("__rank"))


def hashed(docs: DataFrame, names: DataFrame) -> DataFrame:
    """__rank and fingerprints of each text."""
    lines = F.transform(lines_of(F.col("text")), lambda x: F.btrim(x, F.lit(" \t\r\n")))
    n = names.count()
    if n >= 1 << (63 - PLACE_BITS):
        raise ValueError(f"{n} texts; a place names at most {(1 << (63 - PLACE_BITS)) - 1}")
    side = F.broadcast(names) if n * 40 <= BROADCAST_BYTES else names
    rows = docs.where(F.length("text") >= MIN_CHARS).join(side, (F.xxhash64("text") == F.col("__h")) & F.col("doc_id").eqNullSafe(F.col("__d"))).select("__rank", "text")
    split = rows.select("__rank", F.filter(F.transform(lines, lambda x, i: F.struct(F.xxhash64(x).alias("x"), F.length(x).alias("n"), i.alias("p"))), lambda x: x["n"] > 0).alias("lines"))
    return split.select("__rank", fingerprints(F.col("lines")).alias("prints"))


def repeats(table: DataFrame) -> DataFrame:
    """__rank, start and end (inclusive) of every gram that came before."""
    found = table.select("__rank", F.explode("prints").alias("x")).select(F.col("x.f").alias("f"), (F.shiftleft("__rank", PLACE_BITS) + F.col("x.p")).alias("at"), F.col("x.n").alias("n"))
    first = found.groupBy("f").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").select("f", "first")
    # A written table, so that both sides of the join are shuffled alike and a hot hash can be split.
    first = materialize(first, "firsts")
    later = found.join(first, "f").where(F.col("at") > F.col("first"))
    start = F.col("at").bitwiseAND((1 << PLACE_BITS) - 1).cast("int")
    return later.select(F.shiftright("at", PLACE_BITS).alias("__rank"), start.alias("start"), (start + F.col("n")).alias("end"))


def merged(runs: Column) -> Column:
    """Sorted runs with those that overlap or follow each other made one."""
    kind = "struct<done:array<struct<start:int,end:int>>,start:int,end:int>"
    one = lambda a: F.struct(a["start"].alias("start"), a["end"].alias("end"))
    acc = lambda done, start, end: F.struct(done.alias("done"), start.alias("start"), end.alias("end")).cast(kind)

    def step(a: Column, r: Column) -> Column:
        return F.when(r["start"] <= a["end"] + 1, acc(a["done"], a["start"], F.greatest(a["end"], r["end"]))).otherwise(acc(F.concat(a["done"], F.array(one(a))), r["start"], r["end"]))

    start = acc(F.array().cast("array<struct<start:int,end:int>>"), runs[0]["start"], runs[0]["end"])
    return F.aggregate(runs, start, step, lambda a: F.concat(a["done"], F.array(one(a))))


def deletions(docs: DataFrame) -> DataFrame:
    """__d, __h and __runs of every text that loses lines."""
    names = materialize(ranked(docs), "ranks")
    runs = repeats(materialize(hashed(docs, names), "grams"))
    gone = runs.groupBy("__rank").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs"))
    return gone.select("__rank", merged(F.col("runs")).alias("__runs")).join(names, "__rank").select("__d", "__h", "__runs")


def _cut(docs: DataFrame) -> DataFrame:
    """The columns of `docs` as __0, __1, ..., the new text as __new and __removed, the lines that went."""
    gone = materialize(deletions(docs.select("doc_id", "text")), "deletions")
    gone = gone.select(F.col("__d").alias("__gone_d"), F.col("__h").alias("__gone_h"), F.col("__runs").alias("__gone_runs"))
    size = gone.agg(F.sum(64 + 32 * F.size("__gone_runs"))).first()[0] or 0
    side = F.broadcast(gone) if size <= BROADCAST_BYTES else gone
    named = docs.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(docs.columns)])
    text, key = (F.col(f"__{docs.columns.index(c)}") for c in ("text", "doc_id"))
    joined = named.join(side, (F.xxhash64(text) == F.col("__gone_h")) & key.eqNullSafe(F.col("__gone_d")), "left")

    def kept(lines: Column) -> Column:
        stays = F.filter(F.transform(lines, lambda x, i: F.when(~F.exists("__gone_runs", lambda r: (r["start"] <= i) & (i <= r["end"])), x)), lambda x: x.isNotNull())
        return F.struct(F.array_join(stays, "").alias("t"), (F.size(lines) - F.size(stays)).cast("long").alias("n"))

    cut = F.when(F.col("__gone_runs").isNotNull(), let(lines_of(text), kept))
    found = joined.select(*named.columns, cut.alias("__cut"))
    new = F.when(F.col("__cut").isNotNull(), F.col("__cut.t")).otherwise(text)
    return found.select(*named.columns, new.alias("__new"), F.coalesce(F.col("__cut.n"), F.lit(0).cast("long")).alias("__removed"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """`docs` with repeated runs deleted from `text`, and `n_removed`, the lines that went.

    A column `n_removed` of `docs` is replaced.
    """
    own = [F.col("__new").alias(c) if c == "text" else F.col(f"__{i}").alias(c) for i, c in enumerate(docs.columns) if c != "n_removed"]
    return _cut(docs).select(*own, F.col("__removed").alias("n_removed"))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """`docs` without repeated runs, with `n_chars` brought up to date; texts that lose all go."""
    rows = _cut(docs).where((F.col("__removed") == 0) | (F.trim("__new") != ""))
    size = F.when(F.col("__removed") > 0, F.length("__new").cast("long"))
    own = lambda i, c: F.col("__new") if c == "text" else F.coalesce(size, f"__{i}") if c == "n_chars" else F.col(f"__{i}")
    return rows.select(*[own(i, c).alias(c) for i, c in enumerate(docs.columns)])


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_lines(docs.select("doc_id", "text"))
