"""Validation as columns: `errors` holds the names of failed checks, and nothing is raised.

`split_valid` parts rows into valid ones and a quarantine with reasons.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import probs as P
from ..functions.arrays import first_argmax, one_hot
from ..functions.options import rendered

TYPES = ("choice", "score", "noul")
STATUSES = ("ok", "unsupported_length", "unsupported_source_mask")
# What refers to other options or their places, and to visuals that a text doesn't have.
OPTION_REFERENCE = (
    r"(?i)\b(?:all|none|both|neither|either)\s+(?:of\s+)?(?:the\s+)?(?:above|below|these|those|options|answers|choices|statements)\b"
    r"|\b(?:all|none)\s+of\s+(?:them|these|those)\b"
    r"|\b(?:both|neither|either)\s+[A-E1-5]\s*(?:,|and|or|&)\s*[A-E1-5]\b"
    r"|\b[A-E1-5]\s*(?:and|or|&)\s*[A-E1-5]\b"
    r"|\([A-E1-5]\)\s*(?:,|and|or|&)\s*\([A-E1-5]\)"
    r"|\b(?:option|choice|answer|statement)\s+[A-E1-5]\b"
    r"|\b(?:above|below)\b"
)
BARE_OPTION_REFERENCE = r"(?i)^\s*(?:all|none|both|neither)(?:\s+of\s+them)?[.!]?\s*$"
VISUAL_REFERENCE = r"(?i)\b(?:figure|diagram|image|illustration|photograph|picture|table|graph|chart)\b|\b(?:shown|pictured|depicted|illustrated)\b|<img\b"


def question_reason(question: Column, options: Column) -> Column:
    """Why a question with its option texts can't stand alone; null if it can.

    Options refer to others if one of them, or the question, names options or places, or an
    option consists of such a word.  Visual references come second.
    """
    texts = F.concat(F.array(question), options)
    refers = F.exists(texts, lambda t: t.rlike(OPTION_REFERENCE)) | F.exists(options, lambda t: t.rlike(BARE_OPTION_REFERENCE))
    return F.when(refers, "option_or_position_reference").when(F.exists(texts, lambda t: t.rlike(VISUAL_REFERENCE)), "possible_missing_visual_context")


def domain_reason(domain: Column, allowed: list[str], labels: Column, oos: str = "oos") -> Column:
    """Why a labelled record isn't used: its domain, an out-of-scope label, or more labels than one."""
    return F.when(~F.coalesce(domain.isin(*allowed), F.lit(False)), "domain").when(F.array_contains(labels, oos), "out_of_scope").when(F.size(labels) != 1, "not_single_label")


def failed(checks: dict[str, Column]) -> Column:
    """Names of the checks that aren't true, in order; a null counts as failed."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]))


def blank(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"^[\s\x1c-\x1f\x85\p{Z}]*$")


def target_checks(target: Column, kind: Column, options: Column, tolerance: float = 1e-8) -> dict[str, Column]:
    """A target is a distribution over the options, and one-hot if it is hard."""
    hot = F.size(F.filter(target, lambda x: x == 1.0)) == 1
    return {
        "target_size": F.size(target) == options,
        "target_distribution": P.is_distribution(target, tolerance),
        "target_hard": (kind != "hard") | hot,
        "target_kind": kind.isin("hard", "known_distribution"),
    }


def decision_checks() -> dict[str, Column]:
    """Checks of canonical decisions: ids, type, question, options and target.

    Columns: case_id, group_id, view_id, split, source, language, state_json, qtype,
    instructions, options (array of key, desc), target, target_kind, option_ids.
    """
    c, options = F.col, F.col("options")
    keys = F.transform(options, lambda o: o["key"])
    text = {f"{n}_blank": ~blank(c(n)) for n in ("case_id", "group_id", "view_id", "source", "instructions", "state_json")}
    size = F.when(c("qtype") == "noul", F.lit(2)).otherwise(F.size(options))
    return {
        **text,
        "split": c("split").isin("train", "dev", "test"),
        "language": c("language") == "en",
        "qtype": c("qtype").isin(*TYPES),
        "options_few": size >= 2,
        "options_twice": F.size(F.array_distinct(keys)) == F.size(keys),
        "noul_keys": (c("qtype") != "noul") | F.forall(keys, lambda k: k.isin("false", "true")),
        "option_ids": (F.size("option_ids") == size) & (F.size(F.array_distinct("option_ids")) == size),
        **target_checks(c("target"), c("target_kind"), size),
    }


def row_checks() -> dict[str, Column]:
    """Checks of evaluation rows: id, group_id, qtype, options, gold_idx, soft, gold_score, option_ids."""
    c = F.col
    size = F.when(c("qtype") == "noul", F.lit(2)).otherwise(F.size("options"))
    return {
        "id_blank": ~blank(c("id")), "group_id_blank": ~blank(c("group_id")), "qtype": c("qtype").isin(*TYPES), "options_few": size >= 2,
        "option_ids": F.size("option_ids") == size,
        "target_missing": c("gold_idx").isNotNull() | c("soft").isNotNull() | c("gold_score").isNotNull(),
        "gold_range": c("gold_idx").isNull() | c("gold_idx").between(0, size - 1),
        "soft": c("soft").isNull() | ((F.size("soft") == size) & P.is_distribution(c("soft"), 1e-6)),
        "gold_score": c("gold_score").isNull() | ((c("qtype") == "score") & c("gold_score").between(0, size - 1)),
    }


def prediction_checks(max_length: int = 4096, tolerance: float = 1.001e-5) -> dict[str, Column]:
    """Checks of predictions: status, length, probs, pred_idx.

    Only `ok` rows have probabilities: finite, within [0, 1], of sum 1; and the prediction is
    the first largest.  Unsupported rows have none.
    """
    c, ok = F.col, F.col("status") == "ok"
    inside = F.forall("probs", lambda x: x.between(0.0, 1.0))
    return {
        "status": c("status").isin(*STATUSES),
        "length": c("length").isNull() | (c("length") >= 0) & (~ok | (c("length") <= max_length)),
        "probs_missing": ~ok | c("probs").isNotNull(),
        "probs": ~ok | (P.is_distribution(c("probs"), tolerance) & inside),
        "pred_idx": ~ok | (c("pred_idx") == first_argmax(c("probs"))),
        "unsupported_empty": ok | (c("probs").isNull() & c("pred_idx").isNull()),
    }


def native_checks(tolerance: float = 1e-5) -> dict[str, Column]:
    """Probabilities agree with the softmax of the logits at the row's temperature."""
    gap = F.array_max(F.zip_with("probs", P.softmax(F.col("logits"), F.col("temperature")), lambda x, y: F.abs(x - y)))
    return {"sizes": F.size("probs") == F.size("logits"), "distribution": P.is_distribution(F.col("probs"), P.rounding_tolerance(F.size("probs"), 5)), "softmax": gap <= tolerance}


def parity_checks(ours: str = "probs", theirs: str = "other", tolerance: float = 1e-12) -> dict[str, Column]:
    """Two transports of one answer: equal probabilities, and equal argmax but for exact ties."""
    a, b = F.col(ours), F.col(theirs)
    tie = F.size(F.filter(a, lambda x: x == F.array_max(a))) > 1
    return {"close": F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y))) <= tolerance, "argmax": (first_argmax(a) == first_argmax(b)) | tie}


def identity_offenders(rows: DataFrame) -> DataFrame:
    """(case_id, view_id) twice, cases in several groups or sources, records with a view twice."""
    twice = rows.groupBy(F.concat_ws("/", "case_id", "view_id").alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("case_view").alias("check"), "key", "n")
    cases = rows.groupBy(F.col("case_id").cast("string").alias("key")).agg(F.count_distinct(F.struct("group_id", "source")).alias("n")).where("n > 1").select(F.lit("case_group").alias("check"), "key", "n")
    views = rows.groupBy(F.concat_ws("/", "source", "record_id", "view_id").alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("record_view").alias("check"), "key", "n")
    return twice.unionByName(cases).unionByName(views)


def has_literal(text: Column, literals: list[str]) -> Column:
    """One of the special-token literals stands in the text."""
    return F.exists(F.array(*[F.lit(x) for x in literals]), lambda x: F.contains(text, x))


def length_status(length: Column, masked: Column, max_length: int) -> Column:
    return F.when(length > max_length, "unsupported_length").when(masked, "unsupported_source_mask").otherwise("ok")


def services(schema: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable services, rejected ones with a reason): names and intents must be unique."""
    n = schema.groupBy("service").agg(F.count(F.lit(1)).alias("__n"))
    joined = schema.join(n, "service")
    names, shown = F.transform("intents", lambda i: i["name"]), F.transform("intents", lambda i: F.lower(F.replace(i["name"], F.lit("_"), F.lit(" "))))
    reason = F.when(F.col("__n") > 1, "duplicate_service").when(F.size(F.array_distinct(names)) < F.size(names), "duplicate_intent").when(F.size(F.array_distinct(shown)) < F.size(shown), "duplicate_display")
    marked = joined.withColumn("reason", reason).drop("__n")
    return marked.where(F.col("reason").isNull()).drop("reason"), marked.where(F.col("reason").isNotNull())


def split_valid(rows: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows without errors, rows with their `errors`)."""
    marked = rows.withColumn("errors", failed(checks))
    return marked.where(F.size("errors") == 0).drop("errors"), marked.where(F.size("errors") > 0)


def consistent(p: Column, gold: Column) -> Column:
    """A hard target's gold index and its one-hot form agree."""
    return p == one_hot(gold, F.size(p))


def rendered_reason(prompt: Column, qtype: Column, options: Column, target: Column, mask: str = "[MASK]") -> Column:
    """What is wrong with a rendered question, or null: options (fewer than two, or one shown twice), masks (not one an option, one in all for a noul; a mask in the text itself counts), target (not a chance for each
    option, or not summing to 1)."""
    lines = rendered(qtype, options)
    masks = (F.length(prompt) - F.length(F.replace(prompt, F.lit(mask), F.lit("")))) / len(mask)
    wanted = F.when(qtype == "noul", 1).otherwise(F.size(options))
    total = F.aggregate(target, F.lit(0.0), lambda a, x: a + x)
    fair = (F.size(target) == F.when(qtype == "noul", 2).otherwise(F.size(options))) & F.forall(target, lambda p: p.isNotNull() & p.between(0.0, 1.0)) & (F.abs(total - 1) <= 1e-6)
    few = (F.size(lines) < 2) | (F.size(F.array_distinct(lines)) < F.size(lines))
    return F.when(F.coalesce(few, F.lit(True)), "options").when(~F.coalesce(masks == wanted, F.lit(False)), "masks").when(~F.coalesce(fair, F.lit(False)), "target")
