"""Extraction: articles made of known blocks, split templates, and deep nesting."""

import random
import time

import pytest

from decidra.llm import htmltext

WORDS = "Sand and stone carry little water, so rivers here run short before the autumn rain comes down again".split()


def words(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


def article(rng):
    """(html, blocks): an article of many kinds of blocks."""
    parts, blocks = [f"<h1>{(title := words(rng, 5))}</h1>"], [title]
    for _ in range(rng.randint(3, 9)):
        kind = rng.choice(["p", "p", "p", "ul", "table", "blockquote", "pre", "div", "h2", "dl"])
        texts = [words(rng, rng.randint(6, 40)) for _ in range(1 if kind in ("p", "blockquote", "pre", "div", "h2") else 3)]
        blocks += texts
        if kind == "ul":
            parts.append("<ul>" + "".join(f"<li>{t}" for t in texts) + "</ul>")
        elif kind == "table":
            parts.append("<table>" + "".join(f"<tr><td>{t}</td></tr>" for t in texts) + "</table>")
        elif kind == "dl":
            parts.append("<dl>" + "".join(f"<dd>{t}</dd>" for t in texts) + "</dl>")
        else:
            parts.append(f"<{kind}>{texts[0]}</{kind}>")
    return parts, blocks


def test_known_blocks_come_back(spark):
    """Three hosts with a template each: what is outside the article goes, every block of the article stays."""
    rng = random.Random(11)
    rows, want = [], {}
    for i in range(90):
        parts, blocks = article(rng)
        body = "\n".join(parts)
        junk = f"<nav><a href=x>{words(rng, 3)}</a></nav>", f"<div class='sidebar'><p>{words(rng, 30)}</p></div>", f"<footer>{words(rng, 9)}</footer>", f"<section class='comments'><p>{words(rng, 60)}</p></section>"
        page = (
            f"{junk[0]}<div class='post-{i}'>{body}</div>{junk[1]}{junk[2]}",
            f"<div class='page'>{junk[1]}<article>{body}{junk[3]}</article></div>{junk[2]}",
            f"<main>{junk[0]}<div class='text'><div class='inner'>{body}</div></div>{junk[3]}</main>{junk[2]}",
        )[i % 3]
        rows.append((i, f"https://h{i % 3}.org/{i}", f"<html><body>{page}</body></html>"))
        want[i] = "\n\n".join(blocks)
    got = {r["page_id"]: r["text"] for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


@pytest.mark.parametrize("rest", ["<div>{}</div>", "<ul><li>{}</li></ul>", "<table><tr><td>{}</td></tr></table>", "<div><div>{}</div></div>", "<p>{}</p>"])
def test_the_rest_of_a_split_article_stays(spark, rest):
    """The popular path holds a part of the article; the rest stands beside it in blocks of any kind."""
    rows = [(i, "https://h.org/a", f"<body><div class='intro'><p>{'word ' * (30 + i)}</p></div><div class='offers'>{'buy now ' * (i % 3)}</div></body>") for i in range(20)]
    rows.append((20, "https://h.org/b", f"<body><div class='intro'><p>{'intro ' * 20}</p></div>{rest.format('more ' * 80)}<div class='offers'>{'buy now ' * 40}</div></body>"))
    got = {r["page_id"]: r["text"] for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[20] == ("intro " * 20).strip() + "\n\n" + ("more " * 80).strip()
    assert got[5] == ("word " * 35).strip()


def test_the_path_that_holds_most_is_read():
    source = "<body><div class='a'><p>" + "x " * 100 + "</p></div><div class='b'><p>y</p></div></body>"
    page = htmltext.Page(source)
    assert page.read(["body>div.b", "body>div.a"]) == ("x " * 100).strip()


@pytest.mark.parametrize("source", ["<div>" * 100_000 + "deep", "<b>" * 100_000 + "<p>x" * 1000, "<i>" * 50_000 + "</b>" * 50_000, "<b>x<div>y</div>" * 50_000, "<table><tr><td>z" * 30_000])
def test_time_does_not_grow_with_the_square_of_the_depth(source):
    began = time.process_time()
    page = htmltext.Page(source)
    page.votes(), page.beside()
    page.read(["div>div"], ["17"])
    assert time.process_time() - began < 10
