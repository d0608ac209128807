"""Text functions: normal forms, words, shingles, spans, digests, labels.

The normal forms here run in the JVM and equal the Unicode ones wherever NFKC changes
nothing; `normal_exact` does the full NFKC and case folding in an Arrow UDF, and
`needs_exact` tells cheaply where the two could differ.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from . import states
from .arrays import let

#: Python's str.split() also parts at \x1c-\x1f and \x85, Unicode's spaces included.
SPACES = r"[\s\x0B\x1c-\x1f\x85\p{Z}]+"
WORD = r"[\p{L}\p{N}_]+"
# Ranges of characters whose lower case (sharp s folded) is their full normal form, next to each other too.
PLAIN = (
    r"\x00-\x7F", r"\xC0-\x{131}", r"\x{134}-\x{13E}", r"\x{141}-\x{148}", r"\x{14A}-\x{17E}", r"\x{180}-\x{1C3}", r"\x{1CD}-\x{1EF}", r"\x{1F4}-\x{24F}", r"\x{400}-\x{482}", r"\x{488}-\x{4FF}",
    r"\x{370}-\x{373}", r"\x{375}-\x{379}", r"\x{37B}-\x{37D}", r"\x{37F}-\x{383}", r"\x{386}", r"\x{388}-\x{38F}", r"\x{391}-\x{3A2}", r"\x{3A4}-\x{3AF}", r"\x{3B1}-\x{3C1}", r"\x{3C3}-\x{3CF}",
    r"\x{3D7}-\x{3EF}", r"\x{3F3}-\x{3F4}", r"\x{3F6}-\x{3F8}", r"\x{3FA}-\x{3FF}", r"\x{2010}", r"\x{2012}-\x{2016}", r"\x{2018}-\x{2023}", r"\x{2027}",
)


def normal(text: Column) -> Column:
    """Lower case with sharp s folded, white space collapsed and trimmed."""
    return F.btrim(F.regexp_replace(_lower(text), SPACES, " "))


def _lower(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def needs_exact(text: Column) -> Column:
    """There are characters that NFKC or case folding may change otherwise.

    Runs of one range each are skipped: a class of many ranges takes ten times as long for every character.
    """
    return ~text.rlike(r"\A(?:" + "|".join(f"[{r}]++" for r in PLAIN) + r")*+\z")


@F.pandas_udf(StringType())
def normal_exact(text: pd.Series) -> pd.Series:
    """NFKC, case folding, white space collapsed and trimmed."""
    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))


@F.pandas_udf(StringType())
def composed(text: pd.Series) -> pd.Series:
    """NFC, white space collapsed and trimmed, case kept."""
    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFC", t).split()))


def words(text: Column) -> Column:
    """The words of the normal form, in order.  White space parts them, collapsed or not."""
    return F.regexp_extract_all(_lower(text), F.lit(WORD), F.lit(0))


def normal_words(text: Column) -> Column:
    """The words of the normal form joined by spaces: punctuation is gone."""
    return F.array_join(words(text), " ")


def shingles(tokens: Column, k: int, least: int | None = None) -> Column:
    """Distinct runs of k tokens, joined by spaces; none below `least` (or k) tokens."""
    def cut(t: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(t) - k + 1), lambda i: F.array_join(F.slice(t, i, k), " "))
        return F.when(F.size(t) >= max(k, least or k), F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))

    # Bound once: the tokens may be an expression, and lambdas would work it out per run.
    return let(tokens, cut)


def shingle_hashes(tokens: Column, k: int, least: int | None = None) -> Column:
    """64-bit hashes of the distinct `shingles`, without their texts."""
    def cut(t: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(t) - k + 1), lambda i: F.xxhash64(F.slice(t, i, k)))
        return F.when(F.size(t) >= max(k, least or k), F.array_distinct(runs)).otherwise(F.array().cast("array<bigint>"))

    return let(tokens, cut)


def paragraphs(text: Column) -> Column:
    return F.split(text, r"\n\s*\n", -1)


def digest(*parts: Column) -> Column:
    """SHA-256 of the compact JSON array of the parts."""
    return F.sha2(F.to_json(F.array(*parts)), 256)


def display_label(label: Column, aliases: dict[str, str] | None = None) -> Column:
    """A known alias, or the label with spaces for underscores."""
    plain = F.replace(label, F.lit("_"), F.lit(" "))
    if not aliases:
        return plain
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(F.try_element_at(table, label), plain)


def quoted(part: Column) -> Column:
    """Percent-encoding of one part of an id: no reserved character stays."""
    return F.replace(F.replace(F.url_encode(part), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))


def truncated(text: Column, size: int) -> Column:
    return F.when(F.length(text) > size, F.concat(F.left(text, F.lit(size)), F.lit(" [truncated]"))).otherwise(text)


def policy_key(text: Column) -> Column:
    """Only lower-case ASCII letters and digits."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


# Structured states are JSON strings; these parse them once per value in Arrow batches.


@F.pandas_udf(StringType())
def ordered_state(state: pd.Series) -> pd.Series:
    """A JSON state with normal strings and its keys in their own order, compact."""
    return state.map(lambda s: None if s is None else states.compact(states.parse_or_keep(s), states.folded))


@F.pandas_udf(StringType())
def sorted_state(state: pd.Series) -> pd.Series:
    """A JSON state with composed strings and sorted keys, compact."""
    tidy = lambda t: " ".join(unicodedata.normalize("NFC", t).split())
    return state.map(lambda s: None if s is None else states.compact(states.parse_or_keep(s), tidy, sort=True))


@F.pandas_udf(ArrayType(StringType()))
def leaves(state: pd.Series) -> pd.Series:
    """String leaves of a JSON state, by sorted keys; other scalars as JSON."""
    return state.map(lambda s: [] if s is None else states.leaf_texts(states.parse_or_keep(s)))


@F.pandas_udf(ArrayType(StringType()))
def text_units(state: pd.Series) -> pd.Series:
    """Distinct units to compare: all leaves joined, then each leaf of eight words or more."""
    return state.map(lambda s: [] if s is None else states.units(states.parse_or_keep(s)))


def content_units(state: Column, kind: Column, dialogue: Column, facts: Column) -> Column:
    """Units by the kind of source: a synthetic row's canonical facts, a dialogue's utterances
    joined by spaces, and otherwise the text units of the state."""
    return F.when(kind == "synthetic", F.array(facts)).when(dialogue.isNotNull(), F.array(F.array_join(dialogue, " "))).otherwise(text_units(state))
