"""Every registered query of the library, against DuckDB where it has SQL."""

import pytest

from decidra.plans import catalog

from .conftest import SF


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(same, name):
    same(catalog.QUERIES[name], catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 40
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_does_not_need_llm():
    """Nothing outside the subpackage imports it."""
    import pathlib

    root = pathlib.Path(catalog.__file__).parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "llm" not in path.read_text(), path


def test_whole_texts_are_profiled(spark, tmp_path):
    text = "... " * 1000 + "le chat est dans la maison avec nous et vous"
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert catalog.QUERIES["script_profile"](spark, str(tmp_path)).first()[1:] == ("latin", 35)
    assert catalog.QUERIES["latin_language"](spark, str(tmp_path)).first()["language"] == "fr"


def test_lines_like_a_signature_stay_in_mails(spark, tmp_path):
    import duckdb

    texts = ["Der und.\nBest die.\nÖschber pfge.", "Best ist.", "Kind regards", "> Best\nthanks", *["\n".join([f"line {i}" for i in range(n)] + ["Cheers"]) for n in range(30)], "a\n" * 11 + "> b\n" * 9 + "warm"]
    spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(texts)], "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    ours = {(r.conv_id, r.body) for r in catalog.QUERIES["email_clean"](spark, str(tmp_path)).collect()}
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert ours == {(i, body) for i, _, body in duck.execute(catalog.SQL["email_clean"]).fetchall()}


def test_scripts_are_counted_in_one_pass_over_a_text(spark):
    """Whole texts are gone through once, not once a script; counts are those of a walk over the characters."""
    import re
    import unicodedata

    from decidra.functions import lang

    texts = ["", None, "12 !?", "Straße, œuvre", "Привет мир, hello", "αβγ ἀρχή x", "漢字かな交じり文 ab", "한국어 text 1", "שלום سلام नमस्ते ไทย ሰላም", "e\u0301 \U00020000 ⅳ ª", "ქართული" * 50 + "latin" * 60]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", lang.script_counts(lang.F.col("t")).alias("c"))
    inside = {name: re.compile("[" + re.sub(r"\\x\{(\w+)\}", lambda m: f"\\u{m[1]}", ranges) + "]") for name, ranges in (*lang.SCRIPTS.items(), ("latin", lang.LATIN))}
    for r in rows.collect():
        letters = [c for c in texts[r.i] or "" if unicodedata.category(c).startswith("L")]
        want = [(name, n) for name, p in inside.items() if (n := sum(bool(p.match(c)) for c in letters))]
        assert [tuple(c) for c in r.c] == want, texts[r.i]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(t#") == 1
