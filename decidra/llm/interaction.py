"""How filters interact: what each removes, alone and behind others, in every order.

Five filters judge whole texts: A few words, B few distinct words, C capitals, D symbols, E a text that a smaller
doc_id has too.  Every document gets one mask of failed filters; masks are counted once per part, and
whatever order the filters run in is read off those counters (at most 32 per part), so no order is executed.

Duplicates are found by sorting.  Rows are range-partitioned by the text's fingerprint and doc_id (a group of
copies of any size is so dealt over many tasks), sorted inside by fingerprint, full text and doc_id,
and compared with their predecessors: a row of the same text as the run's first, but another doc_id, is a copy.  Only the
first id of a run that may go on in another task is open: where a task's first or last fingerprint lies, each
run's text and smallest id are written as an edge, and edges of equal text are compared afterwards.  The other filters
are measured in the same pass, and only ids, parts and masks are written.

Defined cases: a null text is empty; a null source is the part of the empty string; a null doc_id is smaller than none and
larger than none, so such a row neither fails E nor makes another fail it, and has no label; rows of one doc_id and text are
no copies of each other, and fail E together if a smaller id has the text; a document is good or toxic if any label row
of its id says so; an empty table gives no rows; only named columns are read, so extra ones can't clash; texts of any length
are measured and compared whole.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize

NAMES = "ABCDE"
COPY = 1 << NAMES.index("E")
ORDERS = ["".join(p) for p in itertools.permutations(NAMES)]
MIN_WORDS, DISTINCT_SHARE, CAPITAL_SHARE = 200, 50, 2
UPPER, INNER = bytes(range(65, 91)), bytes(range(0x80, 0xC0))
SYMBOL = re.compile(rb"[#$%&*|]")
SPACE = re.compile(rb"[ \t-\r]")
#: A longer text is split into words in pieces.
PIECE = 1 << 20


def word_counts(text: bytes) -> tuple[int, int]:
    """All words and distinct words; of a very long text only the distinct ones are held."""
    if len(text) <= PIECE:
        words = text.split()
        return len(words), len(set(words))
    n, seen, at = 0, set(), 0
    while at < len(text):
        space = SPACE.search(text, at + PIECE)
        end = space.end() if space else len(text)
        words = text[at:end].split()
        n, at = n + len(words), end
        seen.update(words)
    return n, len(seen)


def own_mask(text: bytes) -> int:
    """The failed filters among A to D, which need nothing but the text."""
    n, distinct = word_counts(text)
    capitals = len(text) - len(text.translate(None, UPPER))
    points = len(text.translate(None, INNER))
    return (n < MIN_WORDS) | (100 * distinct < DISTINCT_SHARE * n) << 1 | (100 * capitals > CAPITAL_SHARE * points) << 2 | (SYMBOL.search(text) is not None) << 3


def compared(batches):
    """Masks of one sorted partition: doc_id, part, mask, and for open rows an edge (its first row has fingerprint and text).

    A row is open if its id is the smallest of its run, and the run's fingerprint is the partition's first or last.
    Those of the latest fingerprint are held until another one follows.
    """
    task = TaskContext.get().partitionId()
    first = last = before = low = held = None
    runs = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, parts, texts, prints = (batch.column(i) for i in range(4))
        n, f, raw = batch.num_rows, prints.to_numpy(), texts.cast(pa.large_binary()).to_pylist()
        masks = np.fromiter(map(own_mask, raw), np.int32, n)
        first = int(f[0]) if first is None else first
        goes_on = last is not None and int(f[0]) == last and raw[0] == before
        starts = np.ones(n, bool)
        starts[0] = not goes_on
        starts[1:] = [a != b for a, b in itertools.pairwise(raw)]
        starts[1:] |= f[1:] != f[:-1]
        run = np.cumsum(starts)
        lows = pa.concat_arrays([pa.array([low], ids.type), ids.filter(pa.array(starts))]).take(pa.array(run))
        least = pc.fill_null(pc.equal(ids, lows), False).to_numpy(zero_copy_only=False)
        masks[~least & pc.is_valid(ids).to_numpy(zero_copy_only=False)] |= COPY

        def rows(where, is_open, ids=ids, parts=parts, texts=texts, prints=prints, masks=masks, run=run, starts=starts, runs=runs):
            at = pa.array(np.flatnonzero(where))
            edges = pa.array((run + runs)[where] | np.int64(task) << 40, pa.int64(), mask=None if is_open else np.ones(len(at), bool))
            names = pa.array(np.ones(len(at), bool) if not is_open else ~starts[where])
            text = pc.if_else(names, pa.scalar(None, texts.type), texts.take(at))
            return pa.RecordBatch.from_arrays([ids.take(at), parts.take(at), pa.array(masks[where]), edges, prints.take(at), text], names=["doc_id", "part", "mask", "edge", "print", "text"])

        if held and int(f[0]) != last:
            yield from (closed for _, closed in held)
            held = None
        opening = least & (f == first)
        latest = least & (f == f[-1]) & ~opening
        yield rows(opening, True)
        yield rows(~opening & ~latest, False)
        if latest.any():
            held = [*(held or []), (rows(latest, True), rows(latest, False))]
        last, before, low, runs = int(f[-1]), raw[-1], lows[-1].as_py(), runs + int(run[-1])
    yield from (opened for opened, _ in held or [])


def failure_masks(docs: DataFrame) -> DataFrame:
    """doc_id, part and the mask of failed filters of every row of `docs`."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("__part"), F.coalesce("text", F.lit("")).alias("__text")).withColumn("__print", F.xxhash64("__text"))
    dealt = rows.repartitionByRange("__print", "doc_id", F.xxhash64("__part", F.monotonically_increasing_id()))
    in_order = dealt.sortWithinPartitions("__print", "__text", F.asc_nulls_last("doc_id"))
    slim = materialize(in_order.mapInArrow(compared, f"doc_id {kind}, part string, mask int, edge long, print long, text string"), "filter-masks")

    edges = slim.where(F.col("text").isNotNull())
    lowest = edges.groupBy("print", "text").agg(F.min("doc_id").alias("__low"))
    late = edges.join(lowest, ["print", "text"]).where(F.col("doc_id") > F.col("__low")).select("edge", F.lit(COPY).alias("__copy"))
    opened = slim.where(F.col("edge").isNotNull()).join(late, "edge", "left")
    settled = opened.select("doc_id", "part", F.col("mask").bitwiseOR(F.coalesce("__copy", F.lit(0))).alias("mask"))
    return slim.where(F.col("edge").isNull()).select("doc_id", "part", "mask").unionByName(settled)


def part_counters(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, and how many documents, good ones and toxic ones have it; counters of disjoint inputs add up."""
    yes = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long"))
    marked = labels.where(F.col("doc_id").isNotNull() & ((F.col("quality") == 1) | (F.col("toxic") == 1))).groupBy("doc_id").agg(yes("quality").alias("__good"), yes("toxic").alias("__toxic"))
    none = F.lit(0).cast("long")
    totals = masks.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n")).select("*", none.alias("good"), none.alias("toxic"))
    per_id = masks.where(F.col("doc_id").isNotNull()).groupBy("doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    of_labels = per_id.join(marked, "doc_id").select("part", "mask", none.alias("n"), (F.col("n") * F.col("__good")).alias("good"), (F.col("n") * F.col("__toxic")).alias("toxic"))
    return totals.unionByName(of_labels).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def orders_table(counters: DataFrame) -> DataFrame:
    """One row per part, order of filters and step, read off a part's counters (an array of at most 32)."""
    entry = F.struct("mask", "n", "good", "toxic")
    parts = counters.groupBy("part").agg(F.collect_list(entry).alias("__c"))
    steps = parts.withColumn("filter_order", F.explode(F.split(F.lit(",".join(ORDERS)), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(NAMES)))))
    bit_of = lambda letters: sum((F.when(F.instr(letters, x) > 0, 1 << i).otherwise(0) for i, x in enumerate(NAMES)), F.lit(0))
    steps = steps.withColumn("__bit", bit_of(F.substring("filter_order", F.col("step"), F.lit(1)))).withColumn("__past", bit_of(F.substring("filter_order", F.lit(1), F.col("step") - 1)))

    def total(where, what: str = "n", weigh=lambda x: F.lit(1)) -> Column:
        zero = F.lit(0).cast("long")
        return F.aggregate("__c", zero, lambda acc, x: acc + F.when(where(x["mask"]), x[what] * weigh(x["mask"])).otherwise(zero))

    meets = lambda m, c: m.bitwiseAND(F.col(c)) != 0
    removed = lambda m: meets(m, "__bit") & ~meets(m, "__past")
    before_others = lambda m: F.lit(len(ORDERS)).cast("long") / F.bit_count(m)
    return steps.select(
        "part", "filter_order", "step",
        total(lambda m: ~meets(m, "__bit") & ~meets(m, "__past")).alias("kept"),
        total(removed).alias("removed"),
        total(lambda m: meets(m, "__bit") & meets(m, "__past")).alias("redundant"),
        total(lambda m: m == F.col("__bit")).alias("unique_fails"),
        total(removed, "good").alias("good_lost"),
        total(removed, "toxic").alias("toxic_lost"),
        total(lambda m: meets(m, "__bit"), "n", lambda m: before_others(m).cast("long")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return orders_table(part_counters(failure_masks(docs), labels))


def op11(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS ws
  FROM documents
), low AS (
  SELECT t, min(doc_id) AS low FROM d GROUP BY t
), l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         MAP {'A': len(ws) < 200, 'B': 100 * len(list_distinct(ws)) < 50 * len(ws), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
              'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(doc_id > low, false)} AS f
  FROM d LEFT JOIN low USING (t) LEFT JOIN l USING (doc_id)
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), masks AS (
  SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, f
), steps AS (
  SELECT part, filter_order, s::INTEGER AS step, filter_order[s] AS letter, f[filter_order[s]] AS fails, n, good, toxic,
         len(list_filter(range(1, s), lambda i: f[filter_order[i]])) > 0 AS gone, len(list_filter(map_values(f), lambda v: v)) AS n_failed
  FROM masks, orders, range(1, 6) AS r(s)
), summed AS (
  SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails AND n_failed = 1), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM steps GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM summed
"""
