"""Token counts by a shortcut for whole tokens.

The tokenizer normalises a text (NFC, lower case), cuts it into pre-tokens and merges each one's bytes.  Most pre-tokens
of running text are one token.  Which they are is proved before the job: every string of the vocabulary that ends
a word is put through the whole tokenizer, and counts as proven only if it comes back alone, as its own id.  A
pre-token among the proven strings is one token without merging; the model merges only the rest.

Texts are cut at ASCII white space, which no pre-token spans and next to which no character is normalised
otherwise, so a chunk between two spaces counts the same wherever it stands.  The chunks of an Arrow batch are cut and
made distinct by vectorised functions, each distinct chunk is counted once, and counts are added up by offsets.

A special token's string is one token wherever it stands in a raw text, as the library has it by default; a text with
such a string is cut there first.

Defined cases: a null text is empty and has no bytes and no tokens; a null doc_id stays a row of its own; repeated
rows stay repeated; ties can't arise, as each row is counted by itself; an empty table gives an empty result; of extra
columns only `doc_id` and `text` are read, so clashing names do no harm; texts of any length are counted whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
WORD_END = "</w>"
#: Chunks of these characters are in normal form whatever stands beside them; the library itself cuts all others.
SIMPLE = re.compile("[!-~\xa1-\xac\xae-\xff]+")
#: The pre-tokens of lower-case simple chunks, by the tokenizer file's own pattern (fixed value): letters, numbers and the rest of Latin-1.
PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")
#: A worker forgets its short chunks once it has so many; they are then counted anew.
REMEMBERED = 1 << 19


def load(path: str | None = None):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path or public_tokenizers.path(VOCABULARY))


def proven(path: str | None = None) -> list[str]:
    """The pre-tokens (as the model sees them, bytes written as characters) that the tokenizer gives as one token.

    A vocabulary string that the merges can't reach, that normalisation changes or that is cut into several
    pre-tokens doesn't come back alone and so isn't proven.  The list is at most as long as the vocabulary.
    """
    from tokenizers.decoders import ByteLevel

    tokenizer = load(path)
    ends = {piece.removesuffix(WORD_END): i for piece, i in tokenizer.get_vocab(with_added_tokens=False).items() if piece.endswith(WORD_END)}
    pieces = [p for p in ends if p]
    texts = [ByteLevel().decode([p]) for p in pieces]
    coded = tokenizer.encode_batch(texts, add_special_tokens=False)
    return [p for p, c in zip(pieces, coded, strict=True) if c.ids == [ends[p]]]


class Counter:
    """Counts the tokens of chunks; `single` are the proven pre-tokens."""

    _own: dict = {}

    def __init__(self, single: list[str], path: str | None = None):
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = load(path)
        self.single = frozenset(single)
        self.special = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.special)
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))))
        self.bytes = {i: ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(i))[0][0] for i in range(0xA1, 0x100)}
        self.known: dict[str, int] = {}
        self.merged = 0

    @classmethod
    def of(cls, single: list[str], path: str | None = None) -> Counter:
        """One counter a Python worker."""
        if path not in cls._own:
            cls._own[path] = cls(single, path)
        return cls._own[path]

    def merge(self, part: str) -> int:
        """Tokens of one pre-token that isn't proven to be a single one."""
        self.merged += 1
        return len(self.tokenizer.model.tokenize(part))

    def parts(self, chunk: str) -> list[str]:
        if SIMPLE.fullmatch(chunk):
            parts = PARTS.findall(chunk.lower())
            return parts if chunk.isascii() else [p.translate(self.bytes) for p in parts]
        whole = self.tokenizer.normalizer.normalize_str(chunk)
        return [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(whole)]

    def chunk(self, chunk: str) -> int:
        n = 0
        for part in self.parts(chunk):
            n += 1 if part in self.single else self.merge(part)
        if len(chunk) < 64:
            self.known[chunk] = n
        return n

    def weights(self, chunks: list[str]) -> np.ndarray:
        """Tokens of each chunk."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        seen = map(self.known.get, chunks)
        return np.fromiter((self.chunk(c) if n is None else n for c, n in zip(chunks, seen, strict=True)), np.int64, len(chunks))

    def plain(self, texts: pa.Array) -> np.ndarray:
        """Tokens of texts that hold no special token's string; nulls have none."""
        chunks = pc.split_pattern_regex(texts.cast(pa.large_string()), r"[ \t\n\x0B\f\r]+")
        coded = chunks.flatten().dictionary_encode()
        weights = self.weights(coded.dictionary.to_pylist())
        before = np.concatenate([[0], np.cumsum(weights[coded.indices.to_numpy(zero_copy_only=False)])])
        ends = np.cumsum(pc.fill_null(pc.list_value_length(chunks), 0).to_numpy(zero_copy_only=False))
        return before[ends] - before[np.concatenate([[0], ends[:-1]]).astype(np.int64)] if len(ends) else ends

    def count(self, texts: pa.Array) -> np.ndarray:
        out = self.plain(pc.if_else(self.holds_special(texts), pa.scalar("", texts.type), texts))
        for i in np.flatnonzero(self.holds_special(texts).to_numpy(zero_copy_only=False)):
            text = texts[i].as_py()
            out[i] = len(self.cut.findall(text)) + self.plain(pa.array(self.cut.split(text), pa.large_string())).sum()
        return out

    def holds_special(self, texts: pa.Array) -> pa.Array:
        found = pa.array(np.zeros(len(texts), bool))
        for s in self.special:
            found = pc.or_(found, pc.fill_null(pc.match_substring(texts, s), False))
        return found


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of `docs`.

    The proven strings reach the workers as a broadcast variable: they are at most the vocabulary's, whatever the data.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    single = spark.sparkContext.broadcast(proven(path))

    def counted(batches):
        for batch in batches:
            texts = batch.column(1)
            n = Counter.of(single.value, path).count(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__text")).withColumn("n_bytes", F.octet_length("__text").cast("long"))
    out = rows.mapInArrow(counted, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op13(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
