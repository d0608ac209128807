"""Routing of requests: explicit model, then task, workflow, language, detection, default."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.lang import analysis

# Names that stand for a model, and the question ids of known workflows.
ALIASES = {
    "en": "english", "default": "english", "english": "english", "multi": "multilingual", "ml": "multilingual", "multilingual": "multilingual",
    "typed": "typed-decisions", "typed_decisions": "typed-decisions", "decisions": "typed-decisions", "typed-decisions": "typed-decisions",
}
WORKFLOWS = {
    "agent_trace_observability": ("action", "needs_review", "outcome", "risk", "urgency"),
    "customer_service": ("action", "category", "churn_risk", "needs_human", "urgency"),
    "invoice_processing": ("discrepancy_severity", "disposition", "duplicate", "matches_order", "urgency"),
    "security_incidents": ("credential_compromise", "disposition", "severity", "true_positive", "urgency"),
}
ENGLISH = ("en", "eng", "english")


def model_name(name: Column) -> Column:
    """The model that a name stands for; null for unknown names."""
    table = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    return F.try_element_at(table, F.lower(F.trim(name)))


def workflow(question_ids: Column) -> Column:
    """The workflow whose question ids are exactly these; null otherwise."""
    ids = F.array_sort(F.array_distinct(question_ids))
    found = F.lit(None).cast("string")
    for name, signature in WORKFLOWS.items():
        found = F.when(ids == F.array(*[F.lit(x) for x in signature]), F.lit(name)).otherwise(found)
    return found


def decision(text: Column, question_ids: Column, model: Column, task: Column, lang: Column, default: str = "english", by_workflow: bool = False) -> Column:
    """A struct: model, reason and the workflow."""
    flow = workflow(question_ids)
    spoken = F.when(F.split(F.lower(lang), "-")[0].isin(*ENGLISH), "english").otherwise("multilingual")

    def detected(a: Column) -> Column:
        chosen = F.when(a["script"] == "unknown", F.lit(default)).when(a["is_english"], "english").otherwise("multilingual")
        why = F.when(a["script"] == "unknown", "no letters").when(a["script"] != "latin", F.concat(F.lit("script "), a["script"])).when(a["is_english"], "English text").when(a["language"].isNotNull(), F.concat(F.lit("language "), a["language"])).otherwise("foreign letters")
        return F.struct(chosen.alias("model"), why.alias("reason"))

    def ladder(d: Column) -> Column:
        steps = [(model.isNotNull(), model_name(model), "explicit model"), (task.isNotNull(), model_name(F.replace(task, F.lit("-"), F.lit("_"))), "explicit task")]
        if by_workflow:
            steps.append((flow.isNotNull(), F.lit("typed-decisions"), "workflow"))
        steps.append((lang.isNotNull(), spoken, "explicit language"))
        chosen, why = d["model"], d["reason"]
        for condition, value, reason in reversed(steps):
            chosen, why = F.when(condition, value).otherwise(chosen), F.when(condition, F.lit(reason)).otherwise(why)
        return F.struct(chosen.alias("model"), why.alias("reason"), flow.alias("workflow"))

    return let(let(analysis(text), detected), ladder)


def routed(rows: DataFrame, text: str, default: str = "english") -> DataFrame:
    """Adds `route` to rows with `text` alone."""
    none = F.lit(None).cast("string")
    return rows.withColumn("route", decision(F.col(text), F.lit(None).cast("array<string>"), none, none, none, default))
