"""Longest verbatim matches: against plain comparison, and on texts that repeat themselves."""

import random
import subprocess
import sys

import pytest

from decidra.llm import decontaminate


def plain(text, items):
    words, hit, names, best = decontaminate.words_of(text), set(), set(), None
    for name, other in items:
        theirs = decontaminate.words_of(other)
        need = min(10, len(theirs))
        if not need:
            continue
        for i in range(len(words) - need + 1):
            for j in range(len(theirs) - need + 1):
                if words[i : i + need] == theirs[j : j + need]:
                    names.add(name)
                    hit.update(range(i, i + need))
                    size = need
                    while len(theirs) >= 10 and i + size < len(words) and j + size < len(theirs) and words[i + size] == theirs[j + size]:
                        size += 1
                    best = min(best or (0, 0, ""), (-size, i, name))
    size, start, item = best or (0, None, None)
    return len(words), len(hit), sorted(names), -size, item, start


@pytest.mark.parametrize("seed", range(30))
def test_equals_plain_comparison(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range((2, 4, 30)[seed % 3])]
    items = [(str(i), " ".join(rng.choices(words, k=rng.choice([0, 1, 3, 9, 10, 11, 25, 40])))) for i in range(rng.randint(0, 6))]
    texts = [None]
    for _ in range(6):
        text = rng.choices([*words, "zz"], k=rng.randint(0, 60))
        for _, item in rng.sample(items, min(2, len(items))):
            at, cut = rng.randint(0, len(text)), rng.randint(0, 20)
            text[at : at + 1] = item.split()[cut : cut + rng.randint(0, 40)]
        texts.append(" ".join(text))
    for text, r in zip(texts, decontaminate.searched(decontaminate.Benchmark(items), texts).to_pylist(), strict=True):
        assert (r["n_words"], sum(h["stop"] - h["start"] for h in r["hits"]), r["items"], r["longest"], r["longest_item"], r["longest_start"]) == plain(text, items)


def test_repeated_words_take_little_memory():
    """40,000 equal words against items of 2,000 of them; a process of its own, so that its memory can be told."""
    code = (
        "import resource, time; from decidra.llm import decontaminate as d; b = d.Benchmark([(str(i), 'a ' * 2000) for i in range(20)]); t = time.time()\n"
        "r = d.searched(b, ['a ' * 40000, 'b ' * 40000]).to_pylist()\n"
        "assert r[0]['longest'] == 2000 and r[0]['longest_item'] == '0' and len(r[0]['items']) == 20 and not r[1]['hits']\n"
        "assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 1_000_000 and time.time() - t < 30"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=decontaminate.__file__.rsplit("/", 3)[0])
