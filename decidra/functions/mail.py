"""E-mail cleaning: quoted history, signatures and disclaimers go; all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let

# Patterns of quote headers, signature lines and disclaimer sentences.
QUOTE_HEADER = r"(?i)^\s*On .{0,300}wrote:\s*$|^\s*-{2,}\s*(Original|Forwarded) Message\s*-{2,}|^\s*_{8,}\s*$|^\s*From:\s.+$"
SIGNATURE = r"(?i)^\s*--\s*$|^\s*(best|kind|warm|many thanks|thanks|thank you|regards|cheers|sincerely)[\w ,!.]*$|^\s*sent from my (iphone|android|mobile|ipad)"
DISCLAIMER = r"(?i)confidential|intended (solely )?for the (use of the )?(named )?(addressee|recipient)|if you (have )?received this (e-?mail|message) in error"
SENTENCE_END = r"(?<=[.!?])\s+"
SIGNATURE_CHARS, MOST_CHARS = 40, 3000


def _first(flags: Column, otherwise: Column) -> Column:
    """Place of the first true flag, from 0."""
    at = F.array_position(flags, True)
    return F.when(at > 0, at - 1).otherwise(otherwise).cast("int")


def _unquoted(lines: Column) -> Column:
    """Lines before the first quote header that has a kept line above it, without `>` lines."""
    quoted = lambda x: F.ltrim(x).startswith(">")
    above = let(F.transform(lines, lambda x: ~quoted(x) & ~x.rlike(QUOTE_HEADER)), lambda f: _first(f, F.size(f)))

    def cut(first: Column) -> Column:
        # A header with only quoted lines above it is kept as a line itself and then counts as one.
        heads = F.transform(lines, lambda x, i: x.rlike(QUOTE_HEADER))
        start = let(heads, lambda h: F.least(first, _first(F.transform(h, lambda b, i: b & ~quoted(lines[i])), F.size(h))))
        end = let(F.transform(heads, lambda b, i: b & (i > start)), lambda f: _first(f, F.size(f)))
        return let(end, lambda e: F.transform(F.filter(F.slice(lines, 1, e), lambda x: ~quoted(x)), lambda x: F.regexp_replace(x, r"\s+$", "")))

    return let(above, cut)


def _unsigned(lines: Column) -> Column:
    """Lines before the first signature in the last two fifths (or eight lines) of the mail."""
    size = F.size(lines)
    low = F.greatest(F.lit(1), F.least(F.floor(size * F.lit(0.6)).cast("int"), size - 8))
    flags = F.transform(lines, lambda x, i: (i >= low) & (F.length(F.trim(x)) <= SIGNATURE_CHARS) & x.rlike(SIGNATURE))
    return let(flags, lambda f: F.slice(lines, 1, _first(f, size)))


def _plain(paragraph: Column) -> Column:
    """A paragraph without its disclaimer sentences; unchanged if it has none."""
    trim = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    parts = F.filter(F.transform(F.split(paragraph, SENTENCE_END, -1), trim), lambda s: (s != "") & ~s.rlike(DISCLAIMER))
    return trim(F.when(paragraph.rlike(DISCLAIMER), F.array_join(parts, " ")).otherwise(paragraph))


def clean_body(body: Column, most: int = MOST_CHARS) -> Column:
    """The new text of a mail; at most `most` characters, as the model's input has a bound."""
    text = F.coalesce(body, F.lit(""))
    for old in ("\r\n", "\r", "\\n"):
        text = F.replace(text, F.lit(old), F.lit("\n"))
    kept = let(let(F.split(text, "\n", -1), _unquoted), _unsigned)
    paragraphs = F.filter(F.transform(F.split(F.array_join(kept, "\n"), r"\n\s*\n", -1), _plain), lambda p: p != "")
    return F.left(F.regexp_replace(F.array_join(paragraphs, "\n\n"), r"[ \t]+", " "), F.lit(most))


def mail_state(subject: Column, body: Column, sender: Column | None = None) -> Column:
    """subject, body and from of a mail, cleaned."""
    parts = [F.trim(F.coalesce(subject, F.lit(""))).alias("subject"), clean_body(body).alias("body")]
    if sender is not None:
        parts.append(F.when(sender != "", sender).alias("from"))
    return F.struct(*parts)
