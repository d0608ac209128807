"""Benchmark decontamination with suffix arrays of the training shards.

A shard is a block of training documents of bounded size.  Its word-level suffix array
holds the suffixes that can begin a match, sorted by their first `WINDOW` words; every distinct
window that a benchmark suffix begins with is binary-searched in it, all of them at once.  A search ends in the
range of training suffixes that share the window.  Equal windows are searched once and know their items, so a
training suffix has one match for each window length at most, however often texts repeat themselves.

How far a match goes on is read off the benchmark's own suffix array: the longest verbatim match that begins at a hit place is the longer
one of those with the two suffixes between which the place's words sort.  Common prefixes are compared in
steps of powers of two, by numbers that equal runs of words share (prefix doubling), so repeated words cost no more than others.

A training suffix can only begin a match if its first `PREFIX` words begin a benchmark
suffix, so the others are left out of the sort; that loses no match.

The benchmark goes to the executors in blocks of at most `BLOCK_WORDS` words.  There is one
such block unless the benchmark is larger than that; otherwise the corpus is searched once a
block and the blocks' results of a document are merged.

Defined cases: null texts and texts without words have no words, hits or windows; items
with the same text each count; of equally long matches the first place counts, and then the smaller item_id as a string; a null item_id counts by the text `null`; repeated documents
stay repeated; empty tables give empty results (no benchmark: nothing is hit); only the
named columns are read, so extra columns can't clash; texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize

WINDOW, PREFIX = 10, 3
#: Words of a training shard, and of a block of the benchmark.
SHARD_WORDS, BLOCK_WORDS = 2_000_000, 1_500_000

#: Bytes of words stay (letters lower-cased), all other ASCII becomes a space.
WORD_BYTES = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


class Benchmark:
    """The suffixes of a block of benchmark items, as keys that compare like their words.

    A word's number is its place among the block's words, from 1; 0 stands for the end of a
    text and for words that the block doesn't have.
    """

    def __init__(self, items: list[tuple[str, str | None]]):
        texts = [(name, words_of(text)) for name, text in items]
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for _, ws in texts for w in ws}))}
        self.names: list[str] = []
        numbers, ends, owner, short = [], [], [], []
        for name, ws in texts:
            if ws:
                self.names.append(name)
                start = len(numbers)
                numbers += [self.vocabulary[w] for w in ws]
                ends += [start + len(ws)] * len(ws)
                owner += [len(self.names) - 1] * len(ws)
                short += [len(ws)] * len(ws)
        self.words, self.end, self.owner, size = (np.array(x, dtype=np.int64) for x in (numbers, ends, owner, short))
        at = np.arange(len(self.words))
        need = np.minimum(WINDOW, size)
        starts = at[at + need <= self.end]
        # An item of fewer words than a window is one window of all its words.
        starts = starts[(size[starts] >= WINDOW) | (starts == self.end[starts] - size[starts])]
        rows = np.zeros((len(starts), WINDOW + 1), dtype=np.int32)
        rows[:, 0] = need[starts]
        for k in range(WINDOW):
            inside = k < rows[:, 0]
            rows[inside, k + 1] = self.words[starts[inside] + k]
        windows, which = np.unique(rows, axis=0, return_inverse=True)
        self.need, self.columns = windows[:, 0].astype(np.int64), windows[:, 1:]
        # The items of each window, window by window.
        items = np.unique(which.reshape(-1).astype(np.int64) * max(1, len(self.names)) + self.owner[starts])
        self.items = items % max(1, len(self.names))
        self.first_item = np.searchsorted(items // max(1, len(self.names)), np.arange(len(windows) + 1))
        self._statistics = None
        self.prefixes = {}
        for k in range(1, PREFIX + 1):
            mine = self.need >= PREFIX if k == PREFIX else self.need == k
            self.prefixes[k] = np.unique(pack(self.columns[mine][:, :k]))

    def items_of(self, windows: np.ndarray) -> np.ndarray:
        """The items that have one of some distinct windows."""
        low, n = self.first_item[windows], self.first_item[windows + 1] - self.first_item[windows]
        return np.unique(self.items[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)])

    def longest(self, words: np.ndarray, at: np.ndarray) -> tuple[int, str, int]:
        """Words, item and place of the longest verbatim match that begins at one of the places `at` of a document."""
        if self._statistics is None:
            self._statistics = Statistics(self.words, self.end)
        size, place, starts = self._statistics.longest(words, at)
        return size, min(self.names[i] for i in np.unique(self.owner[starts])), place


class Statistics:
    """Matching statistics against a suffix array of the benchmark's words.

    Level j numbers runs of 2 ** j words inside an item, equal runs alike and in their order; 0 stands for a run that an item's end cuts.
    """

    def __init__(self, words: np.ndarray, end: np.ndarray):
        self.words, self.end = words, end
        most = int((end - np.arange(len(words))).max())
        self.levels, self.pairs = [words.copy()], []
        rank, at, j = words.copy(), np.arange(len(words)), 0
        while 1 << j < most:
            h = 1 << j
            later = np.where(at + h < end, rank[np.minimum(at + h, len(words) - 1)], 0)
            _, rank = np.unique(rank * (len(words) + 2) + later, return_inverse=True)
            rank = rank.reshape(-1).astype(np.int64) + 1
            below, whole = self.levels[j], at + 2 * h <= end
            level = np.where(whole, rank, 0)
            keys = below[whole] * (len(words) + 2) + below[at[whole] + h]
            keys, place = np.unique(keys, return_index=True)
            self.pairs.append((keys, level[whole][place]))
            self.levels.append(level)
            j += 1
        # Suffixes that are equal to their ends come in any order.
        self.order = np.argsort(rank, kind="stable")

    def numbered(self, words: np.ndarray) -> list[np.ndarray]:
        """The levels' numbers of a document's runs; 0 where the benchmark hasn't the run."""
        out = [words]
        for j, (keys, numbers) in enumerate(self.pairs):
            h, below = 1 << j, out[-1]
            level = np.zeros(len(words), dtype=np.int64)
            here = np.flatnonzero(below[: max(0, len(words) - h)])
            here = here[below[here + h] > 0]
            if len(here) and len(keys):
                key = below[here] * (len(self.words) + 2) + below[here + h]
                found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                level[here] = np.where(keys[found] == key, numbers[found], 0)
            out.append(level)
        return out

    def common(self, runs: list[np.ndarray], at: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        """How many words places of a document and benchmark suffixes have in common."""
        n, off = len(runs[0]), np.zeros(len(at), dtype=np.int64)
        for j in range(len(runs) - 1, -1, -1):
            p, i = at + off, suffix + off
            inside = (p < n) & (i < self.end[suffix])
            p, i = np.minimum(p, n - 1), np.minimum(i, len(self.words) - 1)
            off += np.where(inside & (runs[j][p] > 0) & (runs[j][p] == self.levels[j][i]), 1 << j, 0)
        return off

    def longest(self, words: np.ndarray, at: np.ndarray) -> tuple[int, int, np.ndarray]:
        """Length and first place of the longest match, and the benchmark suffixes that begin with it."""
        runs = self.numbered(words)
        low, high = np.zeros(len(at), dtype=np.int64), np.full(len(at), len(self.order), dtype=np.int64)
        while (low < high).any():
            mid = np.minimum((low + high) // 2, len(self.order) - 1)
            suffix = self.order[mid]
            off = self.common(runs, at, suffix)
            ours = np.where(at + off < len(words), words[np.minimum(at + off, len(words) - 1)], 0)
            theirs = np.where(suffix + off < self.end[suffix], self.words[np.minimum(suffix + off, len(self.words) - 1)], 0)
            right = (ours >= theirs) & (low < high)
            low, high = np.where(right, mid + 1, low), np.where(right | (low >= high), high, mid)
        sides = [np.clip(low + d, 0, len(self.order) - 1) for d in (-1, 0)]
        sizes = [self.common(runs, at, self.order[s]) for s in sides]
        size = np.maximum(*sizes)
        best = np.lexsort((at, -size))[0]
        most, place = int(size[best]), int(at[best])
        centre = int(sides[0][best] if sizes[0][best] == most else sides[1][best])
        reach = 1
        while True:
            near = self.order[max(0, centre - reach) : centre + reach + 1]
            same = self.common(runs, np.full(len(near), place), near) >= most
            if not (same[0] and centre > reach) and not (same[-1] and centre + reach + 1 < len(self.order)):
                return most, place, near[same]
            reach *= 2


def pack(columns: np.ndarray) -> np.ndarray:
    """A hash of rows of numbers: it only sorts out suffixes, so equal hashes of other rows do no harm."""
    out = np.zeros(len(columns), dtype=np.uint64)
    for k in range(columns.shape[1]):
        out = (out + columns[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), dtype=bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def search(bench: Benchmark, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in `words`, distinct window) of all matches in a shard: at most one for each position and window length.

    `words`: the shard's word numbers; documents are parted by zeros, of which WINDOW end it.
    """
    none = np.zeros(0, dtype=np.int64)
    if len(words) <= WINDOW or not len(bench.need):
        return none, none
    head = len(words) - WINDOW
    live = np.flatnonzero(words[:head])
    begins = np.zeros(len(live), dtype=bool)
    for k, table in bench.prefixes.items():
        if len(table):
            begins |= member(pack(np.stack([words[live + i] for i in range(k)], axis=1)), table)
    suffixes = live[begins]
    if not len(suffixes):
        return none, none
    rows = words[suffixes[:, None] + np.arange(WINDOW)].astype(np.int32)
    # Words behind the end of a document don't belong to its suffixes.
    rows[np.cumsum(rows == 0, axis=1) > 0] = 0
    order = np.lexsort(rows.T[::-1])
    suffixes, rows = suffixes[order], rows[order]
    low = bound(rows, bench.columns, bench.need, False)
    high = bound(rows, bench.columns, bench.need, True)
    n = high - low
    which = np.repeat(np.arange(len(n)), n)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return suffixes[np.repeat(low, n) + inside], which


def bound(rows: np.ndarray, queries: np.ndarray, need: np.ndarray, upper: bool) -> np.ndarray:
    """Binary search of all queries in the sorted rows, by each query's first `need` columns."""
    low, high = np.zeros(len(queries), dtype=np.int64), np.full(len(queries), len(rows), dtype=np.int64)
    used = np.arange(queries.shape[1])[None, :] < need[:, None]
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high) // 2
        row = rows[np.minimum(mid, len(rows) - 1)]
        differs = (row != queries) & used
        first = np.argmax(differs, axis=1)
        equal = ~differs[np.arange(len(queries)), first]
        less = np.where(equal, upper, row[np.arange(len(queries)), first] < queries[np.arange(len(queries)), first])
        low, high = np.where(open_ & less, mid + 1, low), np.where(open_ & ~less, mid, high)


SCHEMA = "n_words long, hits array<struct<start:int,stop:int>>, items array<string>, longest int, longest_item string, longest_start int"
ARROW = pa.schema([
    ("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), ("items", pa.list_(pa.string())),
    ("longest", pa.int32()), ("longest_item", pa.string()), ("longest_start", pa.int32()),
])


def searched(bench: Benchmark, texts: list[str | None]) -> pa.RecordBatch:
    """One row per text: its words, the spans of hit words, the items found, the longest match."""
    get = bench.vocabulary.get
    counts, docs = [], []
    for text in texts:
        ws = words_of(text)
        counts.append(len(ws))
        docs.append(np.fromiter((get(w, 0) for w in ws), dtype=np.int64, count=len(ws)))
    # Words and gaps are both written as zero here; positions tell them apart.
    gap = np.zeros(1, dtype=np.int64)
    whole = np.concatenate([x for d in docs for x in (d, gap)] + [np.zeros(WINDOW, dtype=np.int64)])
    starts = np.cumsum([0] + [n + 1 for n in counts])[:-1] if counts else np.zeros(0, dtype=np.int64)
    at, which = search(bench, whole)
    of = np.searchsorted(starts, at, side="right") - 1
    order = np.argsort(of, kind="stable")
    at, which, of = at[order], which[order], of[order]
    first = np.searchsorted(of, np.arange(len(texts)))
    last = np.searchsorted(of, np.arange(len(texts)), side="right")
    hits, items, longest = [], [], []
    for d in range(len(texts)):
        a, b = first[d], last[d]
        if a == b:
            hits.append([])
            items.append([])
            longest.append((0, None, None))
            continue
        p, w = at[a:b] - starts[d], which[a:b]
        places = np.argsort(p, kind="stable")
        left, right = p[places], np.maximum.accumulate((p + bench.need[w])[places])
        cut = np.flatnonzero(np.append(True, left[1:] > right[:-1]))
        hits.append([{"start": int(s), "stop": int(e)} for s, e in zip(left[cut], right[np.append(cut[1:], len(right)) - 1], strict=True)])
        items.append(sorted({bench.names[i] for i in bench.items_of(np.unique(w))}))
        full = np.unique(p[bench.need[w] == WINDOW])
        if len(full):
            longest.append(bench.longest(docs[d], full))
        else:
            size = int(bench.need[w].max())
            place = int(p[bench.need[w] == size].min())
            here = w[(p == place) & (bench.need[w] == size)]
            longest.append((size, min(bench.names[i] for i in bench.items_of(np.unique(here))), place))
    columns = [counts, hits, items, *([x[i] for x in longest] for i in range(3))]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)


def blocks_of(items):
    """Lists of items of at most BLOCK_WORDS words in all, or one longer item."""
    block, size = [], 0
    for item in items:
        n = len(words_of(item[1]))
        if block and size + n > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append(item)
        size += n
    yield block


def match(docs: DataFrame, benchmark: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of `docs` (renamed to __0, __1, ...) with the columns of SCHEMA.

    The benchmark's rows are streamed to the driver block by block.  If there are several
    blocks, each one's results are written before the next block is read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    names = [f"__{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col("text").alias("__text"))
    items = ((r[0] if r[0] is not None else "null", r[1]) for r in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator())
    blocks = blocks_of(items)
    block, after = next(blocks), next(blocks, None)
    if after is None:
        return one_block(rows, spark.sparkContext.broadcast(block))
    rows = materialize(rows.select(F.monotonically_increasing_id().alias("__id"), "*"), "decontaminate")
    every = None
    while block is not None:
        shared = spark.sparkContext.broadcast(block)
        part = materialize(one_block(rows, shared).where(F.size("hits") > 0).select("__id", "hits", "items", "longest", "longest_item", "longest_start"), "block")
        shared.destroy()
        every = part if every is None else every.unionByName(part)
        block, after = after, next(blocks, None)
    best = F.min(F.struct((-F.col("longest")).alias("n"), "longest_start", "longest_item", "longest"))
    found = every.groupBy("__id").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), best.alias("b"))
    counted = one_block(rows, spark.sparkContext.broadcast([])).select("__id", *names, "n_words")
    none = lambda c: F.coalesce(c, F.array().cast(found.schema[c].dataType)).alias(c)
    out = counted.join(found, "__id", "left")
    return out.select(*names, "n_words", none("hits"), none("items"), F.coalesce("b.longest", F.lit(0)).alias("longest"), "b.longest_item", "b.longest_start")


def one_block(rows: DataFrame, shared) -> DataFrame:
    def run(batches):
        bench = Benchmark(shared.value)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            a = 0
            while a < len(texts):
                b, size = a, 0
                while b < len(texts) and (b == a or size + len(texts[b] or "") // 2 <= SHARD_WORDS):
                    size += len(texts[b] or "") // 2
                    b += 1
                found = searched(bench, texts[a:b])
                kept = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*kept.columns[:-1], *found.columns], names=[*kept.schema.names[:-1], *ARROW.names])
                a = b

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{head}, {SCHEMA}")


def hit_words(hits):
    """How many words the spans cover; the spans of one block don't overlap, those of several may."""
    def step(acc, span):
        new = F.greatest(span["stop"] - F.greatest(span["start"], acc["end"]), F.lit(0))
        return F.struct((acc["n"] + new).alias("n"), F.greatest(acc["end"], span["stop"]).alias("end"))

    return F.aggregate(F.sort_array(hits), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda a: a["n"]).cast("long")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` without a word in an occurrence of a window, all columns as they are."""
    names = docs.columns
    kept = match(docs, benchmark, names).where(F.size("hits") == 0)
    return kept.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(names)])


def op5(spark, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = match(docs, bench, ["doc_id"])
    items = F.array_join(F.sort_array("items"), ",")
    return found.select(
        F.col("__0").alias("doc_id"), "n_words", hit_words(F.col("hits")).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(items, 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
        F.col("longest").cast("long").alias("longest"), "longest_item", F.col("longest_start").cast("long").alias("longest_start"),
    )


SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), items AS (
  SELECT item_id, ws, least(len(ws), 10) AS n
  FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark)
  WHERE len(ws) > 0
), wanted AS (
  SELECT item_id, n, i AS j, array_to_string(ws[i:i + n - 1], ' ') AS k
  FROM (SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM items)
), seen AS (
  SELECT r, i, n, array_to_string(ws[i:i + n - 1], ' ') AS k
  FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM words, (SELECT DISTINCT n FROM wanted) WHERE len(ws) >= n)
), hits AS (
  SELECT r, i, j, n, item_id FROM seen JOIN wanted USING (n, k)
), covered AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r
), found AS (
  SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY r
), runs AS (
  SELECT r, item_id, min(i) AS i, count(*) + 9 AS size
  FROM (SELECT r, item_id, i, j, i - row_number() OVER (PARTITION BY r, item_id, i - j ORDER BY i) AS run FROM hits WHERE n = 10)
  GROUP BY r, item_id, i - j, run
  UNION ALL
  SELECT r, item_id, i, n FROM hits WHERE n < 10
), best AS (
  SELECT r, arg_min(size, (-size, i, item_id::VARCHAR)) AS longest, arg_min(item_id::VARCHAR, (-size, i, item_id::VARCHAR)) AS longest_item, min_by(i, (-size, i, item_id::VARCHAR)) - 1 AS longest_start FROM runs GROUP BY r
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       coalesce(longest, 0)::BIGINT AS longest, longest_item, longest_start::BIGINT AS longest_start
FROM words LEFT JOIN covered USING (r) LEFT JOIN found USING (r) LEFT JOIN best USING (r)
"""

