"""Best-fit packing of token sequences in bulk-synchronous supersteps.

Documents are tokenized and cut into pieces of at most `CAPACITY` tokens.  Pieces and the
gaps of open sequences are tables, range-sorted by size.  As sizes are whole numbers up to the
capacity, a sorted table is kept as runs of equal size, and a piece's place in it is its run
and its rank in the run.

A superstep takes the next range of lengths, longest first, and meets it with the table of gaps.
Its sweep gives each run of pieces the smallest gap that is large enough (its successor);
where several want the same gaps, those of lower rank come first and the others go on to the
next successor; each sequence takes as many as its gap holds, and its gap shrinks and returns to
its new place; pieces without a successor open new sequences.  The superstep writes the
new table of gaps and the rank intervals it has placed, and the next one reads them.  The runs are
bounded by the capacity, not by the corpus; the pieces themselves are ranked in hash buckets and
joined with the intervals, and never meet in one task.  The result is that of best-fit decreasing.

Defined cases: a null text is empty, so its document is one piece, the end token; a null
doc_id is a document like any other; repeated rows are packed once each; pieces of equal
length are ranked by a hash, doc_id and piece; an empty table gives an empty result; only
the named columns are read, so extra columns can't clash; texts are tokenized whole.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, gapless_rank, materialize

CAPACITY, END = 1024, 2
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: A text with this in it is left to the slower library, which reads it as one special token.
SPECIAL = "<|endoftext|>"


class Encoder:
    """Token ids of the tokenizer file, by the faster of two libraries with the same vocabulary."""

    _own: dict = {}

    def __init__(self, vocabulary: str | None = None, ranks: str | None = None):
        import base64

        import public_tokenizers
        import tiktoken

        self.vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
        with open(ranks or public_tokenizers.path(RANKS), "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.slow = None

    @classmethod
    def of(cls, vocabulary: str | None = None, ranks: str | None = None) -> Encoder:
        """One encoder a Python worker."""
        key = (vocabulary, ranks)
        if key not in cls._own:
            cls._own[key] = cls(vocabulary, ranks)
        return cls._own[key]

    def ids(self, text: str) -> list[int]:
        if SPECIAL in text:
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.vocabulary)
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, ranks: str | None = None, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").alias("__text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encoder = Encoder.of(vocabulary, ranks)
        for batch in batches:
            taken, out = [], ([], [], [], [], [])
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = np.array([*encoder.ids(text or ""), END], dtype="<u4")
                n = -(-len(ids) // capacity)
                first = len(ids) - (n - 1) * capacity
                for k in range(n):
                    a = first + (k - 1) * capacity if k else 0
                    part = ids[a : first + k * capacity]
                    taken.append(row)
                    for column, value in zip(out, (k, a, len(part), zlib.crc32(part.tobytes()), part if keep_ids else None), strict=True):
                        column.append(value)
            columns = [batch.column(0).take(pa.array(taken, pa.int64())), pa.array(out[0], pa.int32()), *(pa.array(x, pa.int64()) for x in out[1:4])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns.append(pa.array(out[4], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)


class Gaps:
    """The range-sorted gaps: runs of sequences (first, count) by the size of their gap."""

    def __init__(self):
        self.sizes: list[int] = []
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def add(self, size: int, first: int, count: int) -> None:
        if size > 0 and count > 0:
            if size not in self.runs:
                bisect.insort(self.sizes, size)
                self.runs[size] = []
            self.runs[size].append((first, count))

    def take(self, least: int) -> tuple[int, int, int] | None:
        """The successor of `least`: (size, first, count) of a run with the smallest such gap."""
        at = bisect.bisect_left(self.sizes, least)
        if at == len(self.sizes):
            return None
        size = self.sizes[at]
        first, count = self.runs[size].pop()
        if not self.runs[size]:
            del self.runs[size]
            del self.sizes[at]
        return size, first, count


def sweep(runs: list[tuple[int, int]], gaps: Gaps, opened: int, capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Place runs (length, count), longest first; `gaps` is brought up to date.

    Rank intervals (length, low, high, sequence, each, offset), and how many sequences are open now.
    The piece of rank r in [low, high) goes to sequence + (r - low) // each, at the place
    offset + (r - low) % each * length.
    """
    out = []
    for length, left in sorted(runs, reverse=True):
        low = 0
        while left:
            run = gaps.take(length)
            if run is None:
                count = -(-left // (capacity // length))
                run = (capacity, opened, count)
                opened += count
            size, first, count = run
            each = size // length
            full = min(count, left // each)
            if full:
                out.append((length, low, low + full * each, first, each, capacity - size))
                gaps.add(size - each * length, first, full)
                low, left = low + full * each, left - full * each
            if left and full < count:
                out.append((length, low, low + left, first + full, left, capacity - size))
                gaps.add(size - left * length, first + full, 1)
                full, low, left = full + 1, low + left, 0
            gaps.add(size, first + full, count - full)
    return out, opened


#: What a superstep writes: `place` rows have the fields of an interval, `gap` rows size, first and count, one `open` row the number of sequences.
STATE = "kind string, a long, b long, c long, d long, e long, f long"


def superstep(runs: pa.Table, state: pa.Table, capacity: int) -> pa.Table:
    """One superstep over the runs of its range (length, count) and the state before (STATE)."""
    gaps, opened = Gaps(), 0
    before = zip(*(state[c].to_pylist() for c in ("kind", "a", "b", "c")), strict=True)
    for kind, a, b, c in sorted(before, key=lambda r: r[:3]):
        if kind == "gap":
            gaps.add(a, b, c)
        elif kind == "open":
            opened = a
    placed, opened = sweep(list(zip(runs["length"].to_pylist(), runs["count"].to_pylist(), strict=True)), gaps, opened, capacity)
    rows = [("place", *x) for x in placed]
    rows += [("gap", size, first, count, None, None, None) for size, of in gaps.runs.items() for first, count in of]
    rows.append(("open", opened, None, None, None, None, None))
    return pa.table({n: pa.array([r[i] for r in rows], pa.string() if n == "kind" else pa.int64()) for i, n in enumerate(("kind", *"abcdef"))})


def supersteps(runs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rank intervals of all supersteps; `runs` is a materialized table of length and count."""
    spark = runs.sparkSession
    # 0: the capacity itself, 1: half of it and more, 2: a quarter and more, and so on.
    at = F.when(F.col("length") < capacity, F.length(F.bin(F.floor(F.lit(capacity) / (F.col("length") + 1)).cast("long")))).otherwise(0)
    levels = runs.select(F.lit(1).alias("one"), "length", "count", at.alias("level"))
    # A level for each halving of the capacity at most.
    present = sorted(r[0] for r in levels.select("level").distinct().collect())
    state = spark.createDataFrame([], STATE).withColumn("one", F.lit(1))
    every = None
    for k in present:
        step = levels.where(F.col("level") == k).groupBy("one").cogroup(state.groupBy("one"))
        # Both sides are bounded by the capacity, so one task can hold them.
        after = materialize(step.applyInArrow(lambda runs, state: superstep(runs, state, capacity), STATE), "superstep")
        state = after.where("kind <> 'place'").withColumn("one", F.lit(1))
        placed = after.where("kind = 'place'")
        every = placed if every is None else every.unionByName(placed)
    if every is None:
        every = spark.createDataFrame([], STATE)
    return every.select(*[F.col(x).alias(n) for x, n in zip("abcdef", ("__l", "__low", "__high", "__seq", "__each", "__at"), strict=True)])


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to a materialized table of pieces."""
    ranked = gapless_rank(parts, ["length"], ["doc_id", "piece", "start"], "__rank")
    # One row per length: at most `capacity` rows.
    runs = materialize(parts.groupBy("length").count(), "runs")
    plan = supersteps(runs, capacity)
    # The intervals of a length are as many as the gaps it was swept over: the capacity bounds them, too.
    on = (F.col("length") == F.col("__l")) & (F.col("__rank") >= F.col("__low")) & (F.col("__rank") < F.col("__high"))
    placed = ranked.join(F.broadcast(plan), on)
    step = F.col("__rank") - F.col("__low")
    sequence = (F.col("__seq") + F.floor(step / F.col("__each"))).cast("long")
    return placed.select(*parts.columns, sequence.alias("sequence_id"), (F.col("__at") + F.pmod(step, F.col("__each")) * F.col("length")).cast("long").alias("offset"))


def best_fit(docs: DataFrame, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places; `keep_ids` keeps the token ids."""
    return pack(materialize(pieces(docs, capacity, keep_ids=keep_ids), "pieces"), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id and ids, of a result with `ids`."""
    parts = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))


def op2(spark, sf_dir: str) -> DataFrame:
    placed = best_fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
