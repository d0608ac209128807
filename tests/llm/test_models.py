"""Packing, language model, decontamination, shards, near duplicates, toxicity, html, pipeline."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from decidra.llm import decontaminate, htmltext, lm, neardup, packing, shards, toxicity

from .helpers import docs, sf, table


# Packing


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_both_tokenizers_agree(text):
    from tokenizers import Tokenizer

    encoder = packing.Encoder.of()
    slow = Tokenizer.from_file(encoder.vocabulary)
    assert encoder.ids(text) == slow.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=80))
def test_sweeps_are_best_fit_decreasing(lengths):
    capacity, counts = 50, collections.Counter(lengths)
    intervals, n = packing.sweep(list(counts.items()), packing.Gaps(), 0, capacity)
    used = collections.defaultdict(list)
    for length, low, high, first, each, at in intervals:
        for r in range(low, high):
            used[first + (r - low) // each].append((at + (r - low) % each * length, length))
    assert sum(map(len, used.values())) == len(lengths) and sorted(used) == list(range(n))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    gaps = []
    for length in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= length]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - length)
        else:
            gaps.append(capacity - length)
    assert n == len(gaps)


@pytest.mark.parametrize("seed,most", [(1, 1024), (2, 300), (3, 40)])
def test_supersteps_in_spark_pack_like_one_sweep(spark, seed, most):
    rng = random.Random(seed)
    counts = collections.Counter(min(1024, int(rng.paretovariate(0.7) * 3) % most + 1) for _ in range(3000))
    runs = packing.materialize(spark.createDataFrame(list(counts.items()), "length long, count long"), "runs")
    intervals = [tuple(r) for r in packing.supersteps(runs).collect()]
    used = collections.defaultdict(list)
    for length, low, high, first, each, at in intervals:
        for r in range(low, high):
            used[first + (r - low) // each].append((at + (r - low) % each * length, length))
    assert collections.Counter(n for parts in used.values() for _, n in parts) == counts
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(used) == packing.sweep(list(counts.items()), packing.Gaps(), 0, 1024)[1]


def test_packing_round_trip(spark):
    rows = packing.best_fit(docs(spark), 64, keep_ids=True)
    encoder = packing.Encoder.of()
    sequences = collections.defaultdict(dict)
    pieces = collections.Counter()
    for r in rows.collect():
        ids = r["ids"]
        assert len(ids) == r["length"] <= 64 and zlib.crc32(np.array(ids, dtype="<u4").tobytes()) == r["ids_crc32"]
        sequences[r["sequence_id"]][r["offset"]] = r["length"]
        pieces[r["doc_id"]] += r["length"]
    for parts in sequences.values():
        at = 0
        for offset in sorted(parts):
            assert offset == at
            at += parts[offset]
        assert at <= 64
    want = collections.Counter()
    for doc_id, text, *_ in [tuple(r) for r in docs(spark).select("doc_id", "text").collect()]:
        want[doc_id] += len(encoder.ids(text or "")) + 1
    assert pieces == want
    joined = {r["sequence_id"]: len(r["ids"]) for r in packing.sequences(rows).collect()}
    assert sum(joined.values()) == sum(want.values())
    assert packing.best_fit(docs(spark, []), 64).count() == 0


def test_slots_of_equal_rows_are_gapless(spark):
    from decidra.llm import common

    rows = common.materialize(spark.range(1000).selectExpr("id % 2 AS k", "'same' AS v"), "equal")
    got = collections.defaultdict(list)
    for r in common.gapless_rank(rows, ["k"], ["v"], "at").collect():
        got[r["k"]].append(r["at"])
    assert all(sorted(v) == list(range(500)) for v in got.values()) and len(got) == 2


def test_running_totals_and_maxima(spark):
    from decidra.llm import common
    from pyspark.sql import functions as F

    some = [[random.Random(n).randrange(99) for _ in range(n)] for n in (0, 1, 63, 64, 65, 200, 5000)]
    frame = spark.createDataFrame([(x,) for x in some], "x array<int>")
    for got, x in zip(frame.select(common.running(F.col("x"), lambda a, b: a + b), common.running(F.col("x"), F.greatest)).collect(), some, strict=True):
        assert got[0] == np.cumsum(x).tolist() and got[1] == np.maximum.accumulate(x or [0])[: len(x)].tolist()


# Language model


def test_base_scores_and_weights(spark):
    rows = table("documents")
    tokens = {i: (t or "").encode().lower().split() + [None] for i, t, *_ in rows}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    c = collections.Counter(w for i in tokens if not held[i] for w in tokens[i])
    n, v = sum(c.values()), len(c)
    got = lm.interpolate(spark.read.parquet(f"{sf()}/documents.parquet")).collect()
    assert len(got) == len(rows)
    for r in got:
        ws = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(ws), sum(c[w] > 0 for w in ws), n)
        assert abs(r["base_score"] - sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) < 1e-6
    assert sum(r["score"] for r in got if r["held_out"]) > sum(r["base_score"] for r in got if r["held_out"])


def test_scores_are_those_of_plain_interpolation(spark, monkeypatch):
    fixed = np.tile([0.5, 0.3, 0.2], (lm.BUCKETS, 1))
    monkeypatch.setattr(lm, "weights_of", lambda *a: fixed)
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 500)
    rows = table("documents")
    tokens = {i: (t or "").encode().lower().split() + ["END"] for i, t, *_ in rows}
    taught = [ws for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    one = collections.Counter(w for ws in taught for w in ws)
    two = collections.Counter(p for ws in taught for p in zip(["START", *ws], ws, strict=False))
    context = collections.Counter(h for ws in taught for h in ["START", *ws[:-1]])
    n, v = sum(one.values()), len(one)
    for r in lm.interpolate(spark.read.parquet(f"{sf()}/documents.parquet")).collect():
        ws, want = tokens[r["doc_id"]], 0.0
        for h, w in zip(["START", *ws], ws, strict=False):
            want += math.log10(0.5 * (two[h, w] / context[h] if context[h] else 0) + 0.3 * one[w] / n + 0.2 / (v + 1))
        assert abs(r["score"] - want) < 1e-6


def test_em_finds_planted_weights():
    rng = np.random.default_rng(0)
    half = lm.LEVELS // 2
    cells = (3 * lm.LEVELS + half + 40) * lm.LEVELS + np.array([0, half + 8])
    w = lm.weights_of(cells, rng.integers(500, 1000, 2).astype(float))
    assert abs(w.sum(axis=1) - 1).max() < 1e-9 and w[3][0] > 0.9 and w[0][0] == 0


def test_odd_rows_of_language_model(spark):
    got = lm.interpolate(docs(spark)).collect()
    assert len(got) == 9 and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)
    assert lm.interpolate(docs(spark, [])).count() == 0


def test_counts_beyond_32_bits():
    import pyarrow as pa

    keys = np.array([5, 9, 12], dtype=np.uint64)
    row = lambda block, deleted, counts: {"block": block, "deleted": deleted, "order": 2, "part": 0, "keys": lm.squeeze(np.diff(keys, prepend=np.uint64(0))), "counts": lm.squeeze(np.array(counts, dtype=np.uint32))}
    got = lm.answered(pa.Table.from_pylist([row("a", False, [4_000_000_000, 1, 0]), row("b", False, [4_000_000_000, 2, 7]), row("c", True, [3, 0, 0])])).to_pylist()
    assert len(got) == 3 and all(lm.expand(r["kept"], np.uint64).tolist() == [8_000_000_000, 3, 7] for r in got)
    assert all(lm.expand(r["deleted"], np.uint64).tolist() == [3, 0, 0] for r in got)


# Decontamination


def brute(texts, items):
    out = []
    windows = []
    for name, text in items:
        ws = decontaminate.words_of(text)
        n = min(10, len(ws))
        if n:
            windows += [(tuple(ws[i : i + n]), name) for i in range(len(ws) - n + 1)]
    by = collections.defaultdict(set)
    for w, name in windows:
        by[w].add(name)
    for text in texts:
        ws, hit, found = decontaminate.words_of(text), set(), set()
        for n in {len(w) for w in by}:
            for i in range(len(ws) - n + 1):
                if tuple(ws[i : i + n]) in by:
                    hit |= set(range(i, i + n))
                    found |= by[tuple(ws[i : i + n])]
        out.append((len(ws), len(hit), sorted(found)))
    return out


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=30), max_size=5), st.lists(st.lists(st.sampled_from("abc"), max_size=16), max_size=4))
def test_suffix_array_search(texts, items):
    texts, items = [" ".join(t) for t in texts], [(str(i), " ".join(t)) for i, t in enumerate(items)]
    got = decontaminate.searched(decontaminate.Benchmark(items), texts).to_pylist()
    for r, (n, hit, found) in zip(got, brute(texts, items), strict=True):
        assert (r["n_words"], sum(h["stop"] - h["start"] for h in r["hits"]), r["items"]) == (n, hit, found)


def test_longest_match():
    item = " ".join(f"w{i}" for i in range(20))
    text = "x y " + " ".join(f"w{i}" for i in range(3, 18)) + " z " + " ".join(f"w{i}" for i in range(10))
    r = decontaminate.searched(decontaminate.Benchmark([("7", item)]), [text]).to_pylist()[0]
    assert (r["longest"], r["longest_item"], r["longest_start"]) == (15, "7", 2)


def test_several_blocks_give_the_same(spark, monkeypatch):
    bench, rows = spark.read.parquet(f"{sf()}/benchmark.parquet"), spark.read.parquet(f"{sf()}/documents.parquet")
    key = lambda frame: sorted((r["__0"], r["n_words"], r["n"], tuple(sorted(r["items"]))) for r in frame.withColumn("n", decontaminate.hit_words("hits")).collect())
    whole = key(decontaminate.match(rows, bench, ["doc_id"]))
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 300)
    assert key(decontaminate.match(rows, bench, ["doc_id"])) == whole


def test_odd_rows_of_decontamination(spark):
    bench = spark.createDataFrame([(1, "three four five"), (2, None), (None, "")], "item_id long, text string")
    kept = decontaminate.decontaminate(docs(spark), bench)
    assert kept.columns == docs(spark).columns and sorted(r[0] for r in kept.select("n_chars").collect() if r[0] is not None) == [0, 1, 1, 1, 1]
    assert decontaminate.decontaminate(docs(spark), bench.limit(0)).count() == 9
    assert decontaminate.decontaminate(docs(spark, []), bench).count() == 0


# Shards


def test_one_more_shard_takes_rows_only_into_itself(spark):
    rows = spark.range(4000).selectExpr("id AS doc_id", "repeat('x', cast(id % 50 as int)) AS text")
    for n in (40, 41, 44):
        got = shards.assign(rows, n).collect()
        assert all(r["grown_shard"] in (r["shard"], n) for r in got) and any(r["grown_shard"] == n for r in got)
        sizes = collections.Counter(r["shard"] for r in got)
        assert len(sizes) == n and max(sizes.values()) < 2 * 4000 / n
        for s in sizes:
            assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    first = {r["doc_id"]: r for r in shards.assign(rows).collect()}
    for i in (0, 7, 49):
        assert first[i]["size"] == 16 + i % 50 and first[i]["text_crc32"] == zlib.crc32(b"x" * (i % 50))


def test_heavier_subtree_only_gains(spark):
    from pyspark.sql import functions as F

    leaf = lambda s, w: shards.Node(f"s{s}", w, (), s)
    group = lambda name, *kids: shards.Node(name, sum(k.weight for k in kids), kids)
    light = group("root", group("a", leaf(0, 1.0), leaf(1, 1.0)), group("b", leaf(2, 1.0), leaf(3, 1.0)))
    heavy = group("root", group("a", leaf(0, 2.0), leaf(1, 1.0)), group("b", leaf(2, 1.0), leaf(3, 1.0)))
    key = F.col("id").cast("string")
    moved = spark.range(3000).select(shards.place(key, light).alias("x"), shards.place(key, heavy).alias("y")).where("x <> y").collect()
    assert moved and all(r["y"] in (0, 1) for r in moved) and not any(r["x"] == 0 for r in moved)


def test_draws_are_recomputed(spark):
    """Every row's shard by a plain descent of both trees, with Spark's hash from another library."""
    import math

    import xxhash
    from pyspark.sql import functions as F

    def hashed(key, name):
        seed = xxhash.xxh64_intdigest(key.encode(), 42)
        return xxhash.xxh64_intdigest(name.encode(), seed)

    def descend(key, node):
        while node.children:
            draw = lambda c: -math.log(((hashed(key, c.name) >> 11) + 0.5) / shards.DRAW_RANGE) / c.weight
            node = min(node.children, key=draw)
        return node.shard

    rows = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    for r in shards.assign(rows).collect():
        assert r["shard"] == descend(str(r["doc_id"]), shards.tree(40))
        assert r["grown_shard"] == descend(str(r["doc_id"]), shards.tree(41))


def test_odd_rows_of_shards(spark):
    got = shards.assign(docs(spark)).collect()
    assert len(got) == 9 and {(r["size"], r["text_crc32"]) for r in got if r["doc_id"] in (3, 4)} == {(16, 0)}
    assert shards.assign(docs(spark, [])).count() == 0


# Near duplicates


def shingle_set(text, k):
    ws = (text or "").encode().lower().split()
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else ({tuple(ws)} if ws else set())


def linked_by_hand(rows, k):
    sets, parent = [shingle_set(t, k) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        r = find(i)
        least[r] = min(least.get(r, doc_id), doc_id)
    return {doc_id: (len(sets[i]), least[find(i)]) for i, (doc_id, _) in enumerate(rows)}


def family(seed, size, words, edits):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(size):
        ws = list(base)
        for _ in range(rng.randrange(edits + 1)):
            ws[rng.randrange(len(ws))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(ws))
    return out


def test_near_duplicates_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    texts = family(1, 60, 120, 9) + family(2, 30, 40, 3) + ["a b", "a b", "A  b", "x", "", None] + [r[1] for r in table("documents")][:60]
    order = list(range(len(texts)))
    random.Random(4).shuffle(order)
    rows = [(order[i], t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(frame, k=4).collect()}
    assert got == linked_by_hand(rows, 4)
    kept = {r[0] for r in neardup.drop_near_duplicates(frame, k=4).select("doc_id").collect()}
    assert kept == {i for i, (_, c) in got.items() if i == c}


def test_a_doc_id_with_two_texts_loses_only_the_copy(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    frame = spark.createDataFrame([(0, b), (1, a), (1, b)], "doc_id long, text string")
    assert sorted(tuple(r) for r in neardup.drop_near_duplicates(frame).collect()) == [(0, b), (1, a)]


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    for size in (1, 5, 60, 3000):
        a = rng.integers(0, 2**63, size).astype(np.uint64)
        assert (neardup.sketch(a) != neardup.EMPTY).all()
    a = rng.integers(0, 2**63, 2000).astype(np.uint64)
    b = np.concatenate([a[:1600], rng.integers(0, 2**63, 400).astype(np.uint64)])
    fine = neardup.Sketcher(1024)
    assert abs((fine.sketch(a) == fine.sketch(b)).mean() - 1600 / 2400) < 0.06


def test_odd_rows_of_near_duplicates(spark):
    got = neardup.near_duplicates(docs(spark)).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 9 and by[2]["component_id"] == 1 and not by[2]["kept"] and by[4]["n_shingles"] == 0 and by[4]["kept"] and by[3]["kept"]
    assert neardup.near_duplicates(docs(spark, [])).count() == 0


# Toxicity


def test_held_out_accuracy(spark):
    scored = {r["doc_id"]: r for r in toxicity.op10(spark, sf("sf0.1")).collect()}
    held = [(scored[i]["predicted"], t) for i, _, t in table("labels", "sf0.1") if scored[i]["held_out"]]
    right = sum(p == t for p, t in held)
    assert right / len(held) > 0.97 and sum(p and t for p, t in held) / sum(t for _, t in held) > 0.85
    assert all(0 <= r["score"] <= 1 for r in scored.values())


def test_risk_is_corrected_where_it_would_be_negative():
    rng = np.random.default_rng(0)
    positive = np.ones((50, 3), dtype=np.float32)
    unlabelled = (rng.random((400, 3)) < 0.05).astype(np.float32)
    w, bias = toxicity.fit(positive, unlabelled, 0.1)
    assert 1 / (1 + np.exp(-(w.sum() + bias))) > 0.5 > 1 / (1 + np.exp(-bias))


def test_odd_rows_of_toxicity(spark):
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, None), (None, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    kept = toxicity.reject_toxic(docs(spark), labels)
    assert kept.columns == docs(spark).columns
    assert toxicity.reject_toxic(docs(spark), labels.limit(0)).count() == 9
    assert toxicity.reject_toxic(docs(spark, []), labels).count() == 0


# Pages

PAGES = [
    ("<html><body><nav><a>m</a></nav><article><h1>T &amp; x</h1><p>One\n two<p>Three<script>var a='</p>'</script></article><footer>f</footer>", "T & x\n\nOne two\n\nThree"),
    ("<div class='ad-3'>buy</div><div class='content has-sidebar'><h2>H</h2><div>direct <b>text</b> here</div><ul><li>a<li>b</ul></div><div id=comments><p>nice nice nice</p></div>", "H\n\ndirect text here\n\na\n\nb"),
    ("<main><header><nav>x</nav><h1>Head</h1><span>by me</span></header><p>Long enough prose.</p><form><p>Mail?</p></form><aside>s</aside></main>", "Head\n\nLong enough prose."),
    ("<article><p>a<!-- no --> b</p><table><tr><td>c1<td>c2</table><pre>x\n\ty</pre></article><div class='cookie-notice'>ok?</div>", "a b\n\nc1\n\nc2\n\nx y"),
    ("<main><article class='story'><h1>A</h1><p>" + "word " * 30 + "</p><section class='comments'><article class='comment'><p>" + "hm " * 90 + "</p></article></section></article><article class='teaser'><p>" + "tease " * 15 + "</p></article></main>", "A\n\n" + ("word " * 30).strip()),
    ("plain text only", "plain text only"), ("", ""), (None, ""), ("<p", ""), ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"), ("<article><p>1 < 2 &lt; 3</article>", "1 < 2 < 3"),
    ("<article><p>Open</p><div class='share-price'><p>Up two.</p></div><div class='menu-de-la-semaine'>Soup</div><div class='share-links'><a>mail</a></div><div class='share-price'><a>buy it</a></div><div class='ad'>x</div></article>", "Open\n\nUp two.\n\nSoup"),
]


@pytest.mark.parametrize("source,text", PAGES)
def test_pages(source, text):
    page = htmltext.Page(source)
    assert page.read([p for p, _ in page.votes()][:1]) == text
    assert page.read(None) == text


def test_hosts_agree_on_a_path(spark):
    page = lambda body, more: f"<body><div class='x{len(body) % 7}'><div class='post'><p>{body}</p></div></div><div class='junk'>{more}</div></body>"
    rows = [(i, "https://H.example.org/a", page("word " * (30 + i), "")) for i in range(20)]
    # One page has more text beside the article than in it.
    rows += [(20, "http://h.example.org:80/b", page("word " * 30, "noise " * 28)), (21, None, "<p>no host</p>"), (22, "::", None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in htmltext.extract(frame).collect()}
    assert got[20]["text"] == ("word " * 30).strip() and got[21]["text"] == "no host" and got[22]["text"] == "" and got[22]["n_chars"] == 0
    assert htmltext.extract(frame.limit(0)).count() == 0


def test_a_winning_path_does_not_replace_a_page_s_own_article(spark):
    plain = lambda body: f"<body><div class='story'><p>{body}</p></div></body>"
    rows = [(i, "https://h.org/a", plain("word " * (30 + i))) for i in range(20)]
    # Another template: its junk must not come back with the whole body.
    rows.append((20, "https://h.org/b", f"<body><div class='junkbox'>{'<a>go</a> ' * 9}</div><div class='tale'><h1>T</h1><p>{'tale ' * 60}</p></div></body>"))
    # A fifth of the article on the popular path, the rest beside it.
    rows.append((21, "https://h.org/c", f"<body><div class='story'><p>{'intro ' * 20}</p></div><div class='rest'><p>{'more ' * 80}</p></div></body>"))
    deep = "<div>" * 12
    rows += [(30 + i, "https://deep.org/", f"<body>{deep}<div class='x'><p>{'deep ' * 40}</p></div></body>") for i in range(3)]
    # Repeated rows, clashing columns and a very long page.
    rows += [(40, "https://long.org/", "<article>" + "<p>word word</p>" * 40_000 + "</article>")] * 2
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS paths", "'x' AS text", "'x' AS __html")
    got = {r["page_id"]: r["text"] for r in htmltext.extract(frame).collect()}
    assert got[20] == "T\n\n" + ("tale " * 60).strip()
    assert got[21] == ("intro " * 20).strip() + "\n\n" + ("more " * 80).strip()
    assert all(got[30 + i] == ("deep " * 40).strip() for i in range(3)) and len(got[40]) == 40_000 * 11 - 2
    # The vote by a plain count.
    tally = collections.Counter()
    for _, url, html in rows:
        for path, share in htmltext.Page(html).votes():
            tally[url.split("/")[2], path] += round(share * 1000)
    every = collections.Counter()
    for (name, _), n in tally.items():
        every[name] += n
    wanted = {h: [p for (g, p), n in sorted(tally.items(), key=lambda x: (-x[1], x[0])) if g == h and n >= htmltext.SHARE * every[h]] for h in every}
    votes = htmltext.materialize(htmltext.ballots(frame), "ballots")
    assert {r["host"]: r["paths"] for r in htmltext.winners(votes).collect()} == wanted


# Pipeline


@pytest.mark.parametrize("stage", range(5))
def test_odd_rows_of_stages(spark, stage, tmp_path):
    """Nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""
    import corpus_pipeline as P

    labels = spark.createDataFrame([(1, 1, 0), (2, 0, None), (None, 1, 1), (5, 1, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([("i1", "one two three four five six seven eight nine ten"), (None, None)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = P.materialize(docs(spark), "odd")
    name, call = P.STAGES[stage]
    out = call(spark, rows, str(tmp_path))
    got = sorted((repr(r["doc_id"]) for r in out.collect()))
    everyone = sorted(repr(r["doc_id"]) for r in rows.collect())
    if name == "packing":
        assert set(got) == set(everyone) and len(got) > len(everyone)
    else:
        assert out.columns == rows.columns
        # Of the two equal rows of id 1 and the equal text of id 2 one stays; the benchmark's passage is in all three; line dedup empties the later one.
        gone = {"toxicity": [], "line_dedup": ["2"], "near_duplicates": ["1", "2"], "decontamination": ["1", "1", "2"]}[name]
        assert collections.Counter(everyone) - collections.Counter(got) == collections.Counter(gone), name
    assert call(spark, docs(spark, []), str(tmp_path)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "packing"]
    before = spark.read.parquet(f"{sf()}/documents.parquet")
    rows = before
    for _, stage in P.STAGES[:-1]:
        after = stage(spark, rows, sf())
        assert after.columns == before.columns and after.count() <= rows.count()
        rows = P.materialize(after, "stage")
    packed = P.run(spark, sf())
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in rows.select("doc_id").collect()}
    clean = decontaminate.match(rows, spark.read.parquet(f"{sf()}/benchmark.parquet"), ["doc_id"])
    assert clean.where("size(hits) > 0").count() == 0
