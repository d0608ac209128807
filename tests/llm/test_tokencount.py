"""Token counts: against the library, text by text."""

import random

import duckdb
import pyarrow as pa
import pytest

from decidra.llm import tokencount

from .helpers import docs, sf

ODD_TEXTS = [
    "", "<|endoftext|>", "a<|endoftext|>b <|startoftext|><|endoftext|>", "<|endoftext", "é é ́a b", "ΑΣ ΣΑΣ. İstanbul ß ŉ", "don't I'LL we'd !'s 'S 123 4½ ²",
    "\x00\x01 \x1c\x1f \x7f\x85", "漢字かな 한국어 가", "a" * 5000, "ﬁ ﻿ x​y z", "K Å Ω", "line\r\n\x0b\x0cline", "' s 're're",
]


@pytest.fixture(scope="module")
def library():
    tokenizer = tokencount.load()
    return lambda text: len(tokenizer.encode(text or "", add_special_tokens=False).ids)


def test_every_proven_string_is_one_token(library):
    from tokenizers.decoders import ByteLevel

    single = tokencount.proven()
    assert 30_000 < len(single) < 49_408
    assert {library(ByteLevel().decode([p])) for p in single[::50]} == {1}


def test_equals_the_library(library):
    counter = tokencount.Counter(tokencount.proven())
    rng = random.Random(3)
    wide = [chr(i) for r in ((9, 127), (0xA0, 0x250), (0x300, 0x400), (0x600, 0x680), (0x900, 0x980), (0x1E00, 0x2100), (0xAC00, 0xAC40), (0x1F600, 0x1F640)) for i in range(*r)]
    narrow = [chr(i) for i in range(256)]
    texts = [*ODD_TEXTS, *("".join(rng.choices(rng.choice((wide, narrow)), k=rng.randint(1, 30))) for _ in range(3000))]
    assert counter.count(pa.array([*texts, None])).tolist() == [*map(library, texts), 0]


def test_only_the_rest_is_merged():
    counter = tokencount.Counter(tokencount.proven())
    counter.count(pa.array(["the house and the table, don't!"] * 3))
    assert counter.merged == 0
    counter.count(pa.array(["zzqxj the zzqxj"]))
    assert counter.merged == 1


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(tokencount, "REMEMBERED", 5)
    counter = tokencount.Counter(tokencount.proven())
    for text in ("one two three four five six seven", "one two, three! four?", "eight one"):
        assert counter.count(pa.array([text])).tolist() == [library(text)]


def test_query_equals_the_library_on_whole_tables(spark, library):
    rows = duckdb.execute(f"SELECT doc_id, text FROM '{sf()}/documents.parquet'").fetchall()
    got = {r["doc_id"]: tuple(r)[1:] for r in tokencount.op13(spark, sf()).collect()}
    assert got == {i: (len((t or "").encode()), library(t), library(t) > 2048) for i, t in rows}


def test_odd_rows(spark, library):
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokencount.token_counts(docs(spark)).collect())
    want = sorted((r["doc_id"] or 0, len((r["text"] or "").encode()), library(r["text"]), library(r["text"]) > 2048) for r in docs(spark).collect())
    assert got == want
    empty = tokencount.token_counts(docs(spark, []))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
