"""Structured states: JSON values laid flat as a table of scalars with their paths.

Everything else about states (leaves, units to compare, spans) is read off that table.
"""

from __future__ import annotations

import json
import unicodedata

#: A step of a path is a key of an object or a place in a list.
Row = tuple[tuple, object]


def parse_or_keep(text: str | None):
    """The JSON value of a text, or the text if it's none."""
    try:
        return json.loads(text) if text is not None else None
    except ValueError:
        return text


def flat(value) -> list[Row]:
    """(path, scalar) of all scalars in document order: containers are opened level by level."""
    rows: list[Row] = [((), value)]
    while any(isinstance(v, dict | list) for _, v in rows):
        opened: list[Row] = []
        for path, v in rows:
            if isinstance(v, dict):
                opened.extend((path + (k,), x) for k, x in v.items())
            elif isinstance(v, list):
                opened.extend((path + (i,), x) for i, x in enumerate(v))
            else:
                opened.append((path, v))
        rows = opened
    return rows


def as_leaf(scalar) -> str | None:
    """Strings as they are, numbers and booleans as JSON, null as nothing."""
    if scalar is None or isinstance(scalar, str):
        return scalar
    return json.dumps(scalar, allow_nan=False)


def leaf_texts(value) -> list[str]:
    """All leaves, objects by sorted keys.  Two paths first differ inside one container, so they compare."""
    table = sorted(flat(value), key=lambda row: row[0])
    return [t for t in (as_leaf(v) for _, v in table) if t is not None]


def folded(text: str) -> str:
    """NFKC, case folding, white space collapsed and trimmed."""
    return " ".join(unicodedata.normalize("NFKC", text).casefold().split())


def units(value, least: int = 8) -> list[str]:
    """Distinct units to compare: all leaves joined by spaces, then each leaf of `least` words or more."""
    leaves = leaf_texts(value)
    long = [t for t in leaves if folded(t).count(" ") >= least - 1]
    return list({t: None for t in [" ".join(leaves), *long] if t})


def changed(value, change):
    """The value with `change` applied to every string in it."""
    if isinstance(value, dict):
        return dict(zip(value, (changed(v, change) for v in value.values()), strict=True))
    if isinstance(value, list):
        return [changed(v, change) for v in value]
    return change(value) if isinstance(value, str) else value


def compact(value, change, sort: bool = False) -> str:
    return json.dumps(changed(value, change), ensure_ascii=False, separators=(",", ":"), sort_keys=sort)
