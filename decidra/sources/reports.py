"""Markdown reports of finished runs, from small tables of counts and metrics; nothing is computed again here but sums.

Each takes DataFrames of one row a suite, system or dataset, which are read whole, and returns the text.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

#: A report's table has a line for each suite or system; more isn't one.
MOST_LINES = 10_000


def lines_of(frame: DataFrame, order: list[str]) -> list[dict]:
    rows = [r.asDict() for r in frame.orderBy(*order).limit(MOST_LINES + 1).collect()]
    if len(rows) > MOST_LINES:
        raise ValueError(f"more than {MOST_LINES} lines")
    return rows


def cell(value, digits: int = 4) -> str:
    """Nothing as a dash; no cell breaks the table."""
    if value is None:
        return "-"
    if isinstance(value, float):
        return f"{value:.{digits}f}"
    return str(value).replace("|", "\\|").replace("\n", " ").replace("\r", " ")


def table(rows: list[dict], columns: dict[str, str], digits: int = 4) -> str:
    """A table with a title for each column; numbers stand to the right."""
    number = lambda c: bool(rows) and all(isinstance(r.get(c), int | float | None) for r in rows)
    head = "| " + " | ".join(columns.values()) + " |\n| " + " | ".join("---:" if number(c) else "---" for c in columns) + " |"
    return "\n".join([head, *("| " + " | ".join(cell(r.get(c), digits) for c in columns) + " |" for r in rows)])


def audit(decisions: DataFrame, evidence: DataFrame, profile: str, limitations: list[str]) -> str:
    """The overlap audit: decisions by suite (suite, suite_ord, retain, exclude, quarantine), evidence by kind (kind, n)."""
    suites, kinds = lines_of(decisions, ["suite_ord", "suite"]), lines_of(evidence, ["kind"])
    every = {d: sum(s[d] for s in suites) for d in ("retain", "exclude", "quarantine")}
    parts = [
        "# Overlap audit", f"Profile: `{profile}`. Decisions: {sum(every.values())}; retained: {every['retain']}, excluded: {every['exclude']}, quarantined: {every['quarantine']}.",
        "An audit of wording; it doesn't certify that anything is unseen.", "## Decisions", table([*suites, {"suite": "all", **every}], {"suite": "Suite", "retain": "Retain", "exclude": "Exclude", "quarantine": "Quarantine"}),
        "## Evidence", table(kinds, {"kind": "Kind", "n": "Records"}), "## Limitations", "\n".join(f"- {x}" for x in limitations) or "- none stated",
    ]
    return "\n\n".join(parts) + "\n"


def suites(metrics: DataFrame, means: DataFrame, conditions: dict) -> str:
    """A run's metrics by suite (as `metrics.summarize` has them, with suite), and means over suites (scope, n_suites and macro_ columns)."""
    rows = lines_of(metrics, ["suite"])
    for r in rows:
        r["done"] = f"{r['completed']}/{r['attempted']}"
    shown = {"suite": "Suite", "done": "Completed / attempted", "n_hard": "Hard n", "coverage": "Coverage", "accuracy": "Accuracy", "nll": "NLL", "brier": "Brier (sum)", "all_attempted_accuracy": "All-attempted accuracy"}
    ordinal = [r for r in rows if r.get("score_mae") is not None]
    parts = ["# Run summary", "From stored artifacts; no inference and no scoring.", "## Conditions", "```json\n" + json.dumps(conditions, indent=2, sort_keys=True, allow_nan=False) + "\n```", "## Suites", table(rows, shown)]
    scopes = lines_of(means, ["scope"])
    if scopes:
        parts += ["## Means over suites", table(scopes, {c: c.replace("_", " ") for c in means.columns})]
    if ordinal:
        parts += ["## Ordinal targets", "MAE compares the expected level with the target; RPS isn't normalised.", table(ordinal, {"suite": "Suite", "score_mae": "MAE", "score_rps": "RPS"})]
    return "\n\n".join(parts) + "\n"


def comparison(systems: DataFrame, datasets: DataFrame, uncertainty: dict) -> str:
    """Systems side by side: overall (system, provenance and any columns), and by dataset (dataset, area, system and any columns); six digits."""
    first = ["system", "provenance"]
    overall = lines_of(systems, ["system"])
    titles = lambda columns: {c: c.replace("_", " ").capitalize() for c in columns}
    parts = ["# Comparison", "Values are shown as reported; nothing is computed again.", "## Overall", table(overall, titles([*first, *[c for c in systems.columns if c not in first]]), 6), "## Datasets"]
    groups: dict[tuple, list[dict]] = {}
    for r in lines_of(datasets, ["area", "dataset", "system"]):
        groups.setdefault((r["area"], r["dataset"]), []).append(r)
    columns = [c for c in datasets.columns if c not in ("area", "dataset")]
    for (area, dataset), rows in groups.items():
        parts += [f"### {cell(dataset)} ({cell(area)})", table(rows, titles(columns), 6)]
    return "\n\n".join([*parts, "## Uncertainty", "```json\n" + json.dumps(uncertainty, indent=2, sort_keys=True, allow_nan=False) + "\n```"]) + "\n"
