"""Spans of a state: whole leaves, lines, labelled sections and paragraphs."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.states import flat, folded, parse_or_keep
from .tables import stored

# Fields that hold instructions rather than content, and fields of documents.
IGNORED = frozenset(
    "instructions instruction criteria candidates options option_ids labels label rubric rules policy task task_description system system_prompt choices answer_choices".split()
)
DOCUMENTS = frozenset("document article passage context contract text source_text source premise dialogue dialogue_prefix".split())
LABEL = re.compile(r"^\s*([A-Za-z][A-Za-z _-]{0,45}):\s*(.*)$")
WORDS = re.compile(r"\w+")
#: Texts whose spans are held at once.
TEXTS = 32
#: Words of the runs by which states may meet; similar spans share runs of as many.
RUN = 5
FIELDS = "field string, text string, normalized string, tokens array<string>, group_link boolean"


def _name(label: str) -> str:
    return folded(label).replace(" ", "_")


def _hidden(label: str) -> bool:
    return _name(label) in IGNORED


def leaves(value):
    """(path, field, text) of all strings outside ignored fields.  The field is the last key on the path."""
    for path, text in flat(value):
        keys = [k for k in path if isinstance(k, str)]
        if isinstance(text, str) and not any(map(_hidden, keys)):
            name = "".join(f".{k}" if isinstance(k, str) else f"[{k}]" for k in path)
            yield f"state{name}", keys[-1] if keys else "state", text


def sections(text: str) -> list[tuple[str, int, list[str]]]:
    """(title, number of its first line, lines) of the sections that aren't hidden.

    A `Label:` line begins a section and is its first line without the label; what comes
    before the first one is `unlabelled`.  A section whose label is an ignored field is hidden.
    """
    lines = text.splitlines()
    labels = {i: m for i, m in enumerate(map(LABEL.match, lines)) if m}
    edges = sorted({0, *labels})
    out = []
    for a, b in zip(edges, [*edges[1:], len(lines)], strict=True):
        if a not in labels:
            out.append(("unlabelled", a + 1, lines[a:b]))
        elif not _hidden(labels[a][1]):
            out.append((f"{a + 1}:{labels[a][1]}", a + 1, [labels[a][2], *lines[a + 1 : b]]))
    return [x for x in out if x[2]]


def parts_of(path: str, found: list[tuple[str, int, list[str]]]) -> list[tuple[str, str]]:
    """(path, text) of the lines and sections, in order, and then of the paragraphs."""
    out = []
    for title, first, lines in found:
        out += [(f"{path}:line:{first + i}", x) for i, x in enumerate(lines) if not x.isspace() and x]
        out.append((f"{path}:section:{title}", "\n".join(lines)))
    whole = "\n".join(x for _, _, lines in found for x in lines)
    return out + [(f"{path}:paragraph:{i}", p) for i, p in enumerate(re.split(r"\n\s*\n", whole), 1)]


def spans_of(state, exact_words: int = 3, group_words: int = 40) -> list[tuple[str, str, str, list[str], bool]]:
    """Distinct spans with enough words, whole leaves first: path, text, normal form, words,
    and whether an equal span links two rows into one group."""
    cut = [(path, field, sections(text)) for path, field, text in leaves(state)]
    whole = [(path, field, "\n".join(x for _, _, lines in found for x in lines)) for path, field, found in cut]
    content = "\n".join(text for _, _, text in whole)
    named = [("state:content", None, content), *whole]
    named += [(path, "", text) for leaf, _, found in cut for path, text in parts_of(leaf, found)]
    # The first of equal spans stands for all.
    first: dict[str, tuple[str, str | None, str]] = {}
    for row in named:
        first.setdefault(folded(row[2]), row)
    size = len(WORDS.findall(folded(content)))
    out = []
    for key, (path, field, text) in first.items():
        tokens = WORDS.findall(key)
        if len(tokens) >= exact_words:
            document = field and folded(field) in DOCUMENTS and len(tokens) >= group_words and 2 * len(tokens) >= size
            out.append((path, text, key, tokens, field is None or bool(document)))
    return out


def content_words(state) -> list[str]:
    """The words of all of a state's text.  Each of its spans is a part of that text, so the span's words are a run of these."""
    return WORDS.findall(folded("\n".join(x for _, _, text in leaves(state) for _, _, lines in sections(text) for x in lines)))


def runs_of(spans: DataFrame, most: int) -> dict[int, set] | None:
    """Runs of up to RUN words, by length: all of the longer spans' and the shorter spans themselves.  None if there are more than `most`."""
    n = F.size("tokens")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(n - RUN, F.lit(0))), lambda i: F.slice("tokens", i + 1, RUN))
    found = stored(spans.where(n > 0).select(F.explode(cut).alias("r")).distinct(), "runs")
    if found.count() > most:
        return None
    out: dict[int, set] = {}
    for r in found.toLocalIterator():
        out.setdefault(len(r["r"]), set()).add(tuple(r["r"]))
    return out


def may_meet(words: list[str], runs: dict[int, set]) -> bool:
    return any(not found.isdisjoint(zip(*(words[i:] for i in range(k)), strict=False)) for k, found in runs.items())


def with_spans(rows: DataFrame, key: str, state: str, exact_words: int = 3, group_words: int = 40, meeting: dict[int, set] | None = None) -> DataFrame:
    """One row per span: the key and the columns of FIELDS.  States are JSON or plain text; with `meeting`, only those that have one of these runs of words."""
    kind = rows.schema[key].dataType.simpleString()
    wanted = None if meeting is None else rows.sparkSession.sparkContext.broadcast(meeting)

    def run(batches):
        for batch in batches:
            # The spans of a few texts at a time: they take many times the texts' size.
            for at in range(0, batch.num_rows, TEXTS):
                yield spans(batch.slice(at, TEXTS))

    def spans(batch):
        taken, out = [], ([], [], [], [], [])
        for i, text in enumerate(batch.column(1).to_pylist()):
            if text is None:
                continue
            value = parse_or_keep(text)
            if wanted is not None and not may_meet(content_words(value), wanted.value):
                continue
            for span in spans_of(value, exact_words, group_words):
                taken.append(i)
                for column, x in zip(out, span, strict=True):
                    column.append(x)
        kinds = (pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.bool_())
        columns = [batch.column(0).take(pa.array(taken, pa.int64())), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))]
        return pa.RecordBatch.from_arrays(columns, names=[key, "field", "text", "normalized", "tokens", "group_link"])

    return rows.select(F.col(key), F.col(state).cast("string").alias("__state")).mapInArrow(run, f"`{key}` {kind}, {FIELDS}")
