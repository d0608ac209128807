"""Language-model scoring by deleted interpolation.

P(w | h) mixes the bigram and the unigram maximum-likelihood estimates and a uniform floor.
The weights depend on how often the context h was seen, in buckets of powers of two.  They
are learned by expectation-maximisation on held-out counts: a tenth of the training
documents, chosen by a hash of their text so that copies stay together, is deleted from the
counts while the weights are learned, and returned to them for scoring.

Counts cover the whole corpus and are never on the driver.  Documents are gathered into
blocks of about BLOCK_TOKENS tokens.  A block sends each of its distinct n-grams once, as
sorted 64-bit hashes cut into ranges; a range's reducer adds up all blocks' counts and answers
every block with the totals of the n-grams it asked for.  Only the answers and the block's
own tokens are needed to score it.  Shuffled rows are compressed arrays, not single n-grams.

What the weights need of the held-out blocks is a histogram over (context bucket, ratio of
the bigram to the uniform estimate, ratio of the unigram to it), the ratios rounded to an
eighth of a factor of two.  Its size doesn't depend on the corpus.

Defined cases: a null text is empty and has the end token only; a null doc_id is not held
out and is learned from; repeated rows count each; without training text N and V are 0;
an empty table gives an empty result; only `doc_id` and `text` are read, so extra columns
can't clash.  A text is never cut: one longer than a block is a block of its own.
"""

from __future__ import annotations

import uuid
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, partitions, release, tidy

BLOCK_TOKENS = 600_000
#: Characters of text whose n-grams fall into one range of hashes, about; its reducer needs some three times as many bytes.
RANGE_CHARS = 48_000_000
FOLDS, SCORED_ONLY, DELETED = 5, 1, 10
#: Context buckets: never seen, once, 2-3, 4-7 and so on; the last one has all above.
BUCKETS = 16
#: Bits of a bigram's hash; words have all 64.  Of 10 ** 12 bigrams one in 300 would share a hash.
PAIR_BITS = 48
#: Steps of a ratio's logarithm to base two, and levels of a ratio.
STEPS, LEVELS = 8, 512
START, END = b"\n\n", b"\n"


def lowered(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def squeeze(values: np.ndarray) -> bytes:
    """An array as compressed byte planes: small numbers cost little."""
    import zstandard

    wide = np.ascontiguousarray(values)
    planes = wide.view(np.uint8).reshape(-1, wide.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def expand(data: bytes, kind) -> np.ndarray:
    import zstandard

    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(size, -1).T).reshape(-1).view(kind)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of pairs of hashes, of PAIR_BITS bits."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29)))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(64 - PAIR_BITS)


def pairs(vocabulary: np.ndarray, tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every token: its bigram's hash, and its context's place in the vocabulary (0: start)."""
    context = np.empty_like(tokens)
    context[1:] = tokens[:-1]
    context[np.cumsum(sizes) - sizes] = 0
    return mixed(vocabulary[context], vocabulary[tokens]), context


class Block:
    """Documents gathered until they are sent; `deleted` ones are kept in blocks of their own."""

    def __init__(self, deleted: bool):
        self.deleted, self.ids, self.held, self.sizes, self.tokens = deleted, [], [], [], []
        self.places: defaultdict = defaultdict()
        self.places.default_factory = self.places.__len__
        self.end = self.places[START], self.places[END]
        self.count = 0

    def add(self, doc_id, held: bool, text: str | None) -> None:
        places = self.places
        tokens = [places[w] for w in lowered(text)]
        tokens.append(self.end[1])
        self.ids.append(doc_id)
        self.held.append(held)
        self.sizes.append(len(tokens))
        self.tokens.append(np.array(tokens, dtype=np.uint32))
        self.count += len(tokens)

    def rows(self, bits: int, id_type) -> pa.RecordBatch:
        """The block as rows: first its body, then its n-grams by order and range of hashes."""
        import xxhash

        vocabulary = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.places), dtype=np.uint64, count=len(self.places))
        self.places.clear()
        tokens, sizes = np.concatenate(self.tokens), np.array(self.sizes, dtype=np.int64)
        self.tokens = []
        taught = np.repeat(~np.array(self.held), sizes)
        ones = np.bincount(tokens[taught], minlength=len(vocabulary)).astype(np.uint32)
        ones[0] = sum(not h for h in self.held)
        order = np.argsort(vocabulary)
        keys, _ = pairs(vocabulary, tokens, sizes)
        known, inverse = np.unique(keys, return_inverse=True)
        twos = np.bincount(inverse[taught], minlength=len(known)).astype(np.uint32)
        asked = [*cut(1, vocabulary[order], ones[order], 64, bits), *cut(2, known, twos, PAIR_BITS, bits)]
        gap = [None] * len(asked)
        name = [uuid.uuid4().hex] * (1 + len(asked))
        columns = {
            "kind": (["body", *["asked"] * len(asked)], pa.string()), "block": (name, pa.string()), "deleted": ([self.deleted] * len(name), pa.bool_()),
            "ids": ([self.ids, *gap], pa.list_(id_type)), "held": ([self.held, *gap], pa.list_(pa.bool_())), "sizes": ([squeeze(sizes), *gap], pa.binary()),
            "vocabulary": ([squeeze(vocabulary), *gap], pa.binary()), "tokens": ([squeeze(tokens), *gap], pa.binary()),
        }
        for k, (field, kind) in enumerate((("order", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()))):
            columns[field] = ([None, *(x[k] for x in asked)], kind)
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))


def cut(order: int, keys: np.ndarray, counts: np.ndarray, width: int, bits: int) -> list[tuple[int, int, bytes, bytes]]:
    """The sorted keys of `width` bits in 2 ** bits ranges: (order, part, keys, counts)."""
    edges = [*np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(width - bits)).tolist(), len(keys)]
    return [(order, p, squeeze(np.diff(keys[a:b], prepend=np.uint64(0))), squeeze(counts[a:b])) for p, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]


def blocks(docs: DataFrame, bits: int) -> DataFrame:
    spark = docs.sparkSession
    bounded_batches(spark)
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))
    rows = docs.select("doc_id", F.coalesce(remainder == SCORED_ONLY, F.lit(False)).alias("__held"), F.col("text").alias("__text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        open_ = {False: Block(False), True: Block(True)}
        for batch in batches:
            id_type = batch.column(0).type
            for doc_id, held, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                deleted = not held and zlib.crc32((text or "").encode()) % DELETED == 0
                block = open_[deleted]
                if block.count and block.count + len(text or "") // 5 > BLOCK_TOKENS:
                    yield block.rows(bits, id_type)
                    block = open_[deleted] = Block(deleted)
                    tidy()
                block.add(doc_id, held, text)
        for block in open_.values():
            if block.count:
                yield block.rows(bits, id_type)

    body = f"kind string, block string, deleted boolean, ids array<{kind}>, held array<boolean>, sizes binary, vocabulary binary, tokens binary"
    return rows.mapInArrow(run, f"{body}, order int, part int, keys binary, counts binary")


ANSWER = "block string, order int, part int, kept binary, deleted binary, n_kept long, v_kept long, n_all long, v_all long"
TOTALS = ("n_kept", "v_kept", "n_all", "v_all")


def answered(table: pa.Table) -> pa.Table:
    """The totals of one range of keys, for every block that asked for some of them."""
    import xxhash

    rows = table.to_pylist()
    keys = [np.cumsum(expand(r["keys"], np.uint64), dtype=np.uint64) for r in rows]
    counts = [expand(r["counts"], np.uint32) for r in rows]
    known, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    sums = {}
    for deleted in (False, True):
        weight = np.concatenate([c if r["deleted"] == deleted else np.zeros(len(c)) for r, c in zip(rows, counts, strict=True)])
        sums[deleted] = np.bincount(inverse, weights=weight, minlength=len(known)).astype(np.uint64)
    out, at = [], 0
    for row, k in zip(rows, keys, strict=True):
        mine = inverse[at : at + len(k)]
        at += len(k)
        out.append({"block": row["block"], "order": row["order"], "part": row["part"], "kept": squeeze(sums[False][mine]), "deleted": squeeze(sums[True][mine])})
    if rows[0]["order"] == 1:
        words = known != np.uint64(xxhash.xxh3_64_intdigest(START))
        kept, every = sums[False][words], sums[False][words] + sums[True][words]
        out.append({"n_kept": int(kept.sum()), "v_kept": int((kept > 0).sum()), "n_all": int(every.sum()), "v_all": int((every > 0).sum())})
    kinds = {"order": pa.int32(), "part": pa.int32(), "kept": pa.binary(), "deleted": pa.binary(), "block": pa.string()}
    names = ["block", "order", "part", "kept", "deleted", *TOTALS]
    del keys, counts, known, inverse, sums
    tidy()
    return pa.table({n: pa.array([r.get(n) for r in out], kinds.get(n, pa.int64())) for n in names})


class Counted:
    """A block with the answers to it: counts of each token, its context and its bigram."""

    def __init__(self, block: pa.Table, answers: pa.Table, with_deleted: bool):
        row = block.slice(0, 1).to_pylist()[0]
        self.ids, self.held = row["ids"], row["held"]
        self.sizes, vocabulary, tokens = (expand(row[k], t) for k, t in (("sizes", np.int64), ("vocabulary", np.uint64), ("tokens", np.uint32)))
        parts: dict[int, list] = {1: [], 2: []}
        for r in answers.to_pylist():
            total = expand(r["kept"], np.uint64)
            parts[r["order"]].append((r["part"], (total + expand(r["deleted"], np.uint64) if with_deleted else total).astype(np.int64)))
        joined = {k: np.concatenate([x for _, x in sorted(v, key=lambda p: p[0])]) for k, v in parts.items()}
        keys, context = pairs(vocabulary, tokens, self.sizes)
        of_word = np.empty(len(vocabulary), dtype=np.int64)
        of_word[np.argsort(vocabulary)] = joined[1]
        _, inverse = np.unique(keys, return_inverse=True)
        self.word, self.context, self.pair = of_word[tokens], of_word[context], joined[2][inverse]


def bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))) + 1, 0), BUCKETS - 1).astype(np.int64)


def estimates(c: Counted, n: int, v: int) -> tuple[np.ndarray, np.ndarray, float]:
    return c.pair / np.maximum(c.context, 1), c.word / max(n, 1), 1.0 / (v + 1)


def evidence(block: pa.Table, answers: pa.Table, n: int, v: int) -> pa.Table:
    """The histogram of a deleted block's tokens, from counts without the deleted ones."""
    c = Counted(block, answers, False)
    two, one, floor = estimates(c, n, v)
    level = lambda p: np.where(p > 0, np.clip(np.rint(np.log2(np.maximum(p, 1e-300) / floor) * STEPS), -LEVELS // 2 + 1, LEVELS // 2 - 1) + LEVELS // 2, 0).astype(np.int64)
    cell, times = np.unique((bucket(c.context) * LEVELS + level(two)) * LEVELS + level(one), return_counts=True)
    return pa.table({"cell": cell, "times": times.astype(np.int64)})


def weights_of(cells: np.ndarray, times: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Weights (bigram, unigram, floor) per context bucket, by expectation-maximisation."""
    out = np.tile([0.4, 0.4, 0.2], (BUCKETS, 1))
    ratio = lambda x: np.where(x > 0, 2.0 ** ((x - LEVELS // 2) / STEPS), 0.0)
    of, two, one = cells // LEVELS**2, ratio(cells // LEVELS % LEVELS), ratio(cells % LEVELS)
    for b in range(BUCKETS):
        mine = of == b
        if not mine.any():
            continue
        terms = np.stack([two[mine], one[mine], np.ones(mine.sum())], axis=1)
        # A little of each keeps unseen words possible and never-used weights alive.
        w, n = out[b], times[mine][:, None]
        for _ in range(rounds):
            share = terms * w
            share = share / share.sum(axis=1, keepdims=True)
            w = (share * n).sum(axis=0) + 0.01
            w = w / w.sum()
        out[b] = w
    out[0] = [0.0, out[0][1], 1.0 - out[0][1]]
    return out


def scored(block: pa.Table, answers: pa.Table, n: int, v: int, weights: np.ndarray) -> pa.Table:
    c = Counted(block, answers, True)
    two, one, floor = estimates(c, n, v)
    tidy()
    w = weights[bucket(c.context)]
    log = np.log10(np.maximum(w[:, 0] * two + w[:, 1] * one + w[:, 2] * floor, 1e-300))
    base = np.log10((c.word + 0.5) / (n + 0.5 * (v + 1)))
    starts = np.cumsum(c.sizes) - c.sizes
    add = lambda x: np.add.reduceat(x, starts)
    return pa.table({
        "doc_id": pa.array(c.ids, block.schema.field("ids").type.value_type), "held_out": pa.array(c.held, pa.bool_()), "n_tokens": c.sizes,
        "n_known": add((c.word > 0).astype(np.int64)), "train_tokens": np.full(len(c.sizes), n, dtype=np.int64), "base_score": add(base), "score": add(log),
    })


def interpolate(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row."""
    spark = docs.sparkSession
    # Twice as many ranges as shuffle partitions at least, and more where the corpus would fill them beyond RANGE_CHARS.
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = max(5, (partitions(spark) - 1).bit_length() + 1, (chars // RANGE_CHARS).bit_length())
    made = materialize(blocks(docs, bits), "lm-blocks", "kind")
    asked = made.where("kind = 'asked'").select("block", "deleted", "order", "part", "keys", "counts")
    answers = materialize(asked.groupBy("order", "part").applyInArrow(answered, ANSWER), "lm-answers")
    release(made, "kind=asked")
    totals = answers.where(F.col("block").isNull()).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in TOTALS]).first()
    n_kept, v_kept, n_all, v_all = (int(x) for x in totals)
    answers = answers.where(F.col("block").isNotNull()).drop(*TOTALS)
    body = made.where("kind = 'body'").select("block", "deleted", "ids", "held", "sizes", "vocabulary", "tokens")
    deleted = body.where("deleted").select("block")
    # One row per deleted block: far fewer than documents, so the semi join may stay a shuffle.
    told = answers.join(deleted, "block", "left_semi")

    def learn(left: pa.Table, right: pa.Table) -> pa.Table:
        return evidence(left, right, n_kept, v_kept)

    cells = body.where("deleted").groupBy("block").cogroup(told.groupBy("block")).applyInArrow(learn, "cell long, times long")
    # At most BUCKETS * LEVELS ** 2 cells, whatever the corpus.
    found = cells.groupBy("cell").agg(F.sum("times").alias("times")).collect()
    weights = weights_of(np.array([r[0] for r in found], dtype=np.int64), np.array([r[1] for r in found], dtype=np.float64))

    def rate(left: pa.Table, right: pa.Table) -> pa.Table:
        return scored(left, right, n_all, v_all, weights)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return body.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(rate, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op4(spark, sf_dir: str) -> DataFrame:
    return interpolate(spark.read.parquet(f"{sf_dir}/documents.parquet"))
