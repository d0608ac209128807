"""Quality rules as a bitmask ledger (native: DataFrame functions only).

Every rule is evaluated once per document.  The ledger stores one bit per failed rule
and the measurements behind the bits; policies, which are versioned sets of rules, and
ablations are then applied to the ledger without reading the texts again.

Defined cases: a null text has no words and fails the length rule like an empty one; a
null doc_id stays a row of its own; repeated rows stay repeated; ties can't arise, as
each row is judged by itself; an empty table gives an empty ledger; of extra columns
only `doc_id` and `text` are read, so clashing names do no harm; texts of any length
are measured whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

SPACE = r"[ \t\n\x0B\f\r]"
SYMBOLS = r"[#*$%&|<>]"
#: A window of a text of up to 2**21 words packs its place into the low bits of its hash.
PLACE_BITS = 21


@dataclass(frozen=True)
class Rule:
    """A named bit; `fails` maps the ledger's measurement columns to a boolean column."""

    bit: int
    name: str
    fails: object


RULES = (
    Rule(0, "too_few_words", lambda: F.col("n_words") < 50),
    Rule(1, "repeated_words", lambda: 100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    Rule(2, "symbols_per_word", lambda: 10 * F.col("n_symbols") > 3 * F.col("n_words")),
    Rule(3, "repeated_lines", lambda: 100 * F.col("n_dup_lines") > 50 * F.col("n_lines")),
    Rule(4, "word_length", lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 14 * F.col("n_words"))),
)
#: Versioned policies: the rules that reject a document.
POLICIES = {"base": (0, 1), "v1": (0, 1, 2), "v2": (0, 1, 2, 3, 4)}


def mask_of(policy: str) -> int:
    return sum(1 << bit for bit in POLICIES[policy])


def repeated_positions(words: Column) -> Column:
    """How many words stand in a three-word window that the array `words` has twice or more.

    Windows are sorted as longs (hash in the high bits, place in the low ones).  Only
    windows with a neighbour of the same high bits are looked at again, by their words.
    """
    size = F.size(words)
    places = F.sequence(F.lit(0), size - 3)
    low = F.lit((1 << PLACE_BITS) - 1).cast("long")

    def packed(i: Column) -> Column:
        return F.shiftleft(F.xxhash64(words[i], words[i + 1], words[i + 2]), PLACE_BITS).bitwiseOR(i.cast("long"))

    def neighbours(s: Column) -> Column:
        same = lambda x, y: F.shiftrightunsigned(x.bitwiseXOR(y), PLACE_BITS) == 0
        near = F.filter(s, lambda x, i: F.coalesce(same(x, F.get(s, i + 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, i - 1)), F.lit(False)))
        return F.transform(near, lambda x: x.bitwiseAND(low).cast("int"))

    few = let(F.sort_array(F.transform(places, packed)), neighbours)
    likely = F.when(size <= (1 << PLACE_BITS), few).otherwise(places)

    def exact(at: Column) -> Column:
        named = F.sort_array(F.transform(at, lambda i: F.struct(F.concat_ws("\n", words[i], words[i + 1], words[i + 2]).alias("w"), i.alias("i"))))
        twice = let(named, lambda s: F.filter(s, lambda x, k: F.coalesce(F.get(s, k + 1)["w"] == x["w"], F.lit(False)) | F.coalesce(F.get(s, k - 1)["w"] == x["w"], F.lit(False))))
        cover = F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
        return F.size(F.array_distinct(cover))

    counted = let(likely, lambda at: F.when(F.size(at) > 0, exact(at)).otherwise(F.lit(0)))
    return F.when(size >= 3, counted).otherwise(F.lit(0))


def measures(text: Column) -> Column:
    """A struct of all measurements of a text, from one split into words and one into lines."""
    whole = F.coalesce(text, F.lit(""))

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeated_positions(words).cast("long").alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    words = let(F.filter(F.split(whole, SPACE + "+", -1), lambda w: w != ""), of_words)
    lines = let(F.filter(F.split(whole, "\n", -1), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]")), of_lines)
    symbols = (F.length(whole) - F.length(F.regexp_replace(whole, SYMBOLS, ""))).cast("long")
    return let(F.struct(words.alias("w"), lines.alias("l"), symbols.alias("s")), lambda m: F.struct(
        m["w"]["n_words"].alias("n_words"), m["w"]["word_chars"].alias("word_chars"), m["s"].alias("n_symbols"),
        m["l"]["n_dup_lines"].alias("n_dup_lines"), m["w"]["n_repeat_words"].alias("n_repeat_words"), m["l"]["n_lines"].alias("n_lines"),
    ))


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and `failed_bits`, of every row of `docs`."""
    rows = docs.select("doc_id", measures(F.col("text")).alias("__m")).select("doc_id", "__m.*")
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(rule.fails(), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return rows.withColumn("failed_bits", bits)


def apply_policy(entries: DataFrame, policy: str, name: str = "kept") -> DataFrame:
    """Add a boolean `name`: no rule of the policy has failed."""
    return entries.withColumn(name, F.col("failed_bits").bitwiseAND(F.lit(mask_of(policy)).cast("long")) == 0)


def ablations(entries: DataFrame, policy: str) -> DataFrame:
    """Per rule of a policy: how many documents it fails, and how many would return without it.

    One pass: each document is first reduced to its failed bits, then equal bit sets are
    counted (at most 2 ** rules rows), and the rules are read off those counts.
    """
    failed = F.col("failed_bits").bitwiseAND(F.lit(mask_of(policy)).cast("long"))
    sets = entries.groupBy(failed.alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    has = lambda bit: F.col("bits").bitwiseAND(F.lit(1 << bit).cast("long")) != 0
    sums = []
    for bit in POLICIES[policy]:
        sums.append(F.coalesce(F.sum(F.when(has(bit), F.col("n"))), F.lit(0)).alias(f"f{bit}"))
        sums.append(F.coalesce(F.sum(F.when(F.col("bits") == (1 << bit), F.col("n"))), F.lit(0)).alias(f"o{bit}"))
    one = sets.agg(*sums)
    names = {r.bit: r.name for r in RULES}
    each = F.array(*[F.struct(F.lit(names[b]).alias("rule"), F.col(f"f{b}").alias("n_failed"), F.col(f"o{b}").alias("n_only")) for b in POLICIES[policy]])
    return one.select(F.explode(each).alias("x")).select("x.*")


def op6(spark, sf_dir: str) -> DataFrame:
    entries = apply_policy(apply_policy(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")), "base", "__base"), "v1")
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("__base")).alias("base_failed"), "kept", "failed_bits")


SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS ls
  FROM documents
), g AS (
  SELECT r, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS k
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), p AS (
  SELECT r, count(DISTINCT i + d) AS n
  FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM g), (VALUES (0), (1), (2)) AS v(d)
  WHERE c > 1 GROUP BY r
), m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words,
         length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         len(ls)::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN p USING (r)
), b AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END
           + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
           + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END
           + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
           + CASE WHEN word_chars < 2 * n_words OR word_chars > 14 * n_words THEN 16 ELSE 0 END)::BIGINT AS failed_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed_bits & 3) <> 0 AS base_failed, (failed_bits & 7) = 0 AS kept, failed_bits
FROM b
"""
