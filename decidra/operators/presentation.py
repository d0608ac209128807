"""What a model sees of a synthetic decision: a state, instructions and options, rendered from facts; and back again.

`presented` renders the facts of nine families.  `solved` works from the visible text alone: it parses the observations, the numbers in the process' sentence and the
person or colour that the question names, and computes the target of each option as an exact fraction.  `problem` compares a stored record with both, so that
a target that doesn't follow from what is shown is found, whatever facts and fractions were stored beside it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rational as R
from ..functions.arrays import let

# Pools, rubrics, policies, questions and criteria that a model is trained on.
POOL_OF = {
    "eligibility": "synthetic_constraints", "preservation": "synthetic_constraints", "ownership": "synthetic_constraints", "shipment": "synthetic_ordinal", "laboratory": "synthetic_ordinal",
    "deployment": "synthetic_ordinal", "finite_draw": "synthetic_probability", "latent_mixture": "synthetic_probability", "without_replacement": "synthetic_probability",
}
RUBRICS = {
    "shipment": (
        "Not ready: packing quantity, seal, or inspection requirement is unmet.",
        "Ready: packing quantity, seal, and inspection requirements met, but carrier handoff incomplete or receipt validation not passed.",
        "Dispatched: ready and carrier handoff complete with passed receipt validation.",
    ),
    "laboratory": (
        "Collection incomplete: fewer than the required usable samples.",
        "Collected: enough usable samples; current-batch assay not yet qualified.",
        "Qualified: collection and assay qualified; current-assay review not passed.",
        "Released: collection, assay qualification, and current-assay review passed.",
    ),
    "deployment": (
        "Unbuilt: current-version build has not passed.",
        "Built: current build passed, but current-version testing is incomplete.",
        "Tested: build and tests complete, but current-version approval not passed.",
        "Approved: build, tests, approval complete, but current rollout incomplete.",
        "Deployed: build, tests, approval, and rollout all complete for current version.",
    ),
}
RULES = {
    "eligibility": "A candidate is eligible exactly when certified is true, capacity is at least minimum_capacity, and delay is at most maximum_delay. Select the eligible candidate with the lowest cost. This task guarantees a unique minimum.",
    "preservation": "In this synthetic resource policy, balance, change, reserve, and ceiling are measured in integer resource units, not money. The proposed change is allowed exactly when authorized is true, frozen is false, and balance + change is between reserve and ceiling, including both boundaries.",
    "ownership": "Process events in listed chronological order. A transfer changes ownership to its recipient only if its sender is the current owner and accepted is true. Otherwise ignore it. These are all ownership events.",
    "shipment": "Ready requires packed >= required, seal_intact true, and inspection passed. Dispatched additionally requires handed_over true and receipt_validation passed. Pending and failed validations do not pass. Later evidence cannot bypass readiness.",
    "laboratory": "Use the highest contiguous milestone from collection to qualification to release. Collection requires collected - damaged >= required. Qualification additionally requires assay status passed for batch_version and control in [control_low, control_high], inclusive. Release additionally requires review status passed for assay_version. Pending, failed, and older-version checks do not pass.",
    "deployment": "Use the highest contiguous milestone: build, tests, approval, rollout. Each check must have status passed and version equal to current_version. Tests additionally require tests_passed = tests_required. Rollout additionally requires healthy_zones = required_zones. Pending, failed, and older-version checks do not pass. Later checks cannot bypass an earlier incomplete milestone.",
    "finite_draw": "Draw one token uniformly from this finite bag. Counts include every token.",
    "latent_mixture": "Choose one mechanism with probability proportional to prior_weight; its identity is not observed. Under that mechanism, a uniform draw from signal_total tickets produces an alert on signal_count tickets. Independently conditional on the same mechanism, a uniform draw from outcome_total tickets succeeds on success_count tickets. An alert was observed. Predict the outcome conditional on that alert. The table lists every possible mechanism, not a secretly selected mechanism.",
    "without_replacement": "Draw {draws} tokens uniformly without replacement from a bag containing exactly {red} red tokens and {blue} blue tokens. Every subset of that size is equally likely.",
}
_LEVEL = ("Select the highest operational level justified by the observations and rubric.", "Which rubric level has been reached without skipping any prerequisite?")
#: Two wordings of each question; {} is the person or colour asked for.
QUESTIONS = {
    ("eligibility", "choice"): ("Which candidate does the policy select?", "Select the cheapest candidate satisfying every eligibility rule."),
    ("preservation", "noul"): ("Is the proposed change allowed under every policy condition?", "Does the proposed operation satisfy the stated authorization and balance policy?"),
    ("ownership", "noul"): ("After all events, is {} the current owner?", "Does {} own the item after applying the transfer policy?"),
    ("ownership", "choice"): ("Who is the current owner after all events?", "Select the owner obtained by applying the event policy."),
    ("shipment", "score"): _LEVEL, ("laboratory", "score"): _LEVEL, ("deployment", "score"): _LEVEL,
    ("finite_draw", "noul"): ("Will the randomly drawn token be {}? Predict this uncertain event.",) * 2,
    ("finite_draw", "choice"): ("What color will the random token have? Predict the distribution over outcomes.",) * 2,
    ("latent_mixture", "noul"): ("Given the observed alert, will the outcome draw succeed? Predict this uncertain event.",) * 2,
    ("latent_mixture", "choice"): ("Given the alert, predict the distribution of the outcome draw: success or failure.",) * 2,
    ("without_replacement", "score"): ("How many red tokens will be drawn? Predict the distribution over counts.", "Predict the uncertain count of red tokens in the sample, using the count rubric."),
}
ALLOWED = {"false": "The operation is forbidden.", "true": "The operation is allowed."}
COUNTED = "Exactly {} red tokens in the sample."

#: The observations of each family.
_CHECK = "struct<status:string,version:int>"
OBSERVATIONS = {
    "eligibility": "candidates array<struct<name:string,capacity:int,delay:int,certified:boolean,cost:int>>, minimum_capacity int, maximum_delay int",
    "preservation": "authorized boolean, frozen boolean, balance int, change int, reserve int, ceiling int",
    "ownership": "initial_owner string, events array<struct<sender:string,recipient:string,accepted:boolean>>",
    "shipment": "packed int, required int, seal_intact boolean, inspection string, handed_over boolean, receipt_validation string",
    "laboratory": f"collected int, damaged int, required int, control int, control_low int, control_high int, batch_version int, assay_version int, assay {_CHECK}, review {_CHECK}",
    "deployment": f"current_version int, build {_CHECK}, tests {_CHECK}, approval {_CHECK}, rollout {_CHECK}, tests_passed int, tests_required int, healthy_zones int, required_zones int",
    "finite_draw": "counts map<string,int>",
    "latent_mixture": "mechanisms array<struct<name:string,prior_weight:bigint,signal_count:bigint,signal_total:bigint,success_count:bigint,outcome_total:bigint>>",
    "without_replacement": "red int, blue int, draws int",
}
PAIR = "struct<key:string,desc:string>"
FAMILIES = tuple(POOL_OF)


def _by(column: Column, cases: dict, otherwise: Column | None = None) -> Column:
    """The case of a column's value."""
    start = None
    for value, result in cases.items():
        start = F.when(column == value, result) if start is None else start.when(column == value, result)
    if start is None:
        return F.lit(None) if otherwise is None else otherwise
    return start if otherwise is None else start.otherwise(otherwise)


def _facts(family: str, text: Column) -> Column:
    return F.from_json(text, OBSERVATIONS[family])


def _filled(template: str, **parts: Column) -> Column:
    """A template with its braces replaced."""
    return reduce(lambda text, part: F.replace(text, F.lit("{" + part[0] + "}"), part[1].cast("string")), parts.items(), F.lit(template))


def _pairs(items) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("key"), F.lit(d).cast("string").alias("desc")) for k, d in items])


def state_of(family: Column, facts: Column, families: tuple[str, ...] = FAMILIES) -> Column:
    """The visible state: the observations, and the policy or process."""
    rules = {f: F.to_json(F.struct(F.lit(r).alias("x"))) for f, r in RULES.items() if f in families}
    counted = lambda draw: _filled(RULES["without_replacement"], draws=draw["draws"], red=draw["red"], blue=draw["blue"])
    if "without_replacement" in families:
        rules["without_replacement"] = F.to_json(F.struct(let(_facts("without_replacement", facts), counted).alias("x")))
    name = F.when(family.isin(*[f for f, p in POOL_OF.items() if p == "synthetic_probability"]), "process").otherwise("policy")
    rule = _by(family, rules)
    return F.concat(F.lit('{"observations":'), facts, F.lit(',"'), name, F.lit('":'), F.substring(rule, F.lit(6), F.length(rule) - 6), F.lit("}"))


def instructions_of(family: Column, qtype: Column, wording: Column, asked: Column, families: tuple[str, ...] = FAMILIES) -> Column:
    cases = {f"{f}/{q}": F.when(wording == 0, texts[0]).otherwise(texts[1]) for (f, q), texts in QUESTIONS.items() if f in families}
    return F.replace(_by(F.concat_ws("/", family, qtype), cases), F.lit("{}"), F.coalesce(asked, F.lit("")))


def options_of(family: Column, qtype: Column, order: Column, facts: Column, families: tuple[str, ...] = FAMILIES) -> Column:
    """The displayed options: the order given for a choice, the rubric for a score, false and true for a noul."""
    count = F.transform(F.sequence(F.lit(0), F.get_json_object(facts, "$.draws").cast("int")), lambda i: F.struct(i.cast("string").alias("key"), F.replace(F.lit(COUNTED), F.lit("{}"), i.cast("string")).alias("desc")))
    scores = {f: _pairs([(str(i), text) for i, text in enumerate(texts)]) for f, texts in RUBRICS.items() if f in families}
    plain = F.transform(order, lambda k: F.struct(k.alias("key"), F.lit(None).cast("string").alias("desc")))
    noul = F.when(family == "preservation", _pairs(ALLOWED.items())).otherwise(_pairs([("false", None), ("true", None)]))
    return F.when(qtype == "noul", noul).when(qtype == "choice", plain).when(family == "without_replacement", count).otherwise(_by(family, scores)).cast(f"array<{PAIR}>")


def presented(rows: DataFrame, families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """Adds state, instructions and options to rows of family, facts (JSON), qtype, wording (0 or 1), asked (a person or colour, or null) and order (keys, or null).

    Where the rows are known to be of some families only, naming them leaves the others' expressions out; so in `solved` and `problem`.
    """
    f, q = F.col("family"), F.col("qtype")
    return rows.select("*", state_of(f, F.col("facts"), families).alias("state"), instructions_of(f, q, F.col("wording"), F.col("asked"), families).alias("instructions"), options_of(f, q, F.col("order"), F.col("facts"), families).alias("options"))


def asked_of(family: Column, instructions: Column) -> Column:
    """The person or colour that a question names, parsed from either wording."""
    found = [F.when(family == f, F.nullif(F.regexp_extract(instructions, "^" + text.replace("?", r"\?").replace(".", r"\.").replace("{}", "(.+)") + "$", 1), F.lit(""))) for (f, q), texts in QUESTIONS.items() if q == "noul" and "{}" in texts[0] for text in dict.fromkeys(texts)]
    return F.coalesce(*found)


def _one() -> Column:
    return F.lit(1).cast("long")


def _hard(keys: Column, answer: Column) -> Column:
    """All on one key; null without an answer."""
    return F.when(answer.isNotNull(), F.transform(keys, lambda k: F.struct(F.when(k == answer, 1).otherwise(0).cast("long").alias("n"), _one().alias("d"))))


def _event(p: Column, keys: Column, yes: str) -> Column:
    """The chance of a fraction for the key `yes`, the rest for the other."""
    return F.transform(keys, lambda k: F.when(k == yes, p).otherwise(F.struct((p["d"] - p["n"]).alias("n"), p["d"].alias("d"))))


#: Families of whose states one value is all that a target needs: an answer, or the chance of the latent mixture.
TOLD = tuple(f for f in FAMILIES if f not in ("finite_draw", "without_replacement"))


def _observed(family: str) -> Column:
    return F.when(F.col("family") == family, F.from_json("state", f"observations struct<{OBSERVATIONS[family]}>")["observations"])


def told(rows: DataFrame, name: str, family: str) -> DataFrame:
    """Adds `name`: what the states of one family of TOLD come to (a text; of the latent mixture a fraction), from the state alone.

    Rows that share a state can so share its parsing, and rows whose states come to the same can be solved as one: see `known` in `solved`.
    """
    seen, kept = f"__seen_{family}", [c for c in rows.columns if c != name]
    return rows.select("*", _observed(family).alias(seen)).select(*kept, _told(family, F.col(seen)).alias(name))


def _told(family: str, seen: Column) -> Column:
    of = lambda names: [seen[c] for c in names.split()]
    if family == "eligibility":
        return R.eligible(*of("candidates minimum_capacity maximum_delay"))
    if family == "preservation":
        return F.when(R.preserved(*of("authorized frozen balance change reserve ceiling")), "true").otherwise("false")
    if family == "ownership":
        return R.final_owner(*of("initial_owner events"))
    if family == "shipment":
        return R.shipment_level(*of("packed required seal_intact inspection handed_over receipt_validation")).cast("string")
    if family == "laboratory":
        return R.laboratory_level(seen).cast("string")
    if family == "deployment":
        return R.deployment_level(seen).cast("string")
    if family == "latent_mixture":
        return R.latent_mixture(seen["mechanisms"])
    raise ValueError(f"more than one value: {family}")


def solved(rows: DataFrame, name: str = "exact", families: tuple[str, ...] = FAMILIES, known: str | None = None) -> DataFrame:
    """Adds `name`: of each option its exact chance as a fraction (n, d), from state, instructions and options alone; null where the text can't be solved.

    `known` names a column with what the state comes to, as `told` has it, where that is there already; rows are of one family of TOLD then and need no state.
    """
    family, qtype, keys, asked, answer = (F.col(c) for c in ("family", "qtype", "__keys", "__asked", "__answer"))
    # A state is parsed once, into a column of its own for each family, and each key sees an answer that is already there.
    unseen = [f for f in families if f != "without_replacement"] if known is None else []
    process = [F.when(family == "without_replacement", F.from_json("state", "process string")["process"]).alias("__process")] if "without_replacement" in families else []
    parsed = rows.select("*", F.transform("options", lambda o: o["key"]).alias("__keys"), asked_of(family, F.col("instructions")).alias("__asked"), *process, *[_observed(f).alias(f"__seen_{f}") for f in unseen])
    seen = {f: F.col(f"__seen_{f}") for f in unseen}
    yes = lambda c: F.when(c, "true").otherwise("false")
    total = lambda counts: F.aggregate(F.map_values(counts), F.lit(0).cast("long"), lambda a, x: a + x)
    pattern = RULES["without_replacement"].replace(".", r"\.").replace("{draws}", r"(\d+)").replace("{red}", r"(\d+)").replace("{blue}", r"(\d+)")
    number = lambda i: F.nullif(F.regexp_extract("__process", pattern, i), F.lit("")).cast("int")

    # By family, what its facts come to: an answer for hard targets, a number or a fraction for others.
    first = {f: _told(f, seen[f]) if known is None else F.col(known) for f in families if f in TOLD}
    mixture = first.pop("latent_mixture", None)
    known_columns = [_by(family, first).cast("string").alias("__answer")]
    if "finite_draw" in families:
        known_columns.append(total(seen["finite_draw"]["counts"]).alias("__total"))
    if mixture is not None:
        known_columns.append(mixture.alias("__mixture"))
    if "without_replacement" in families:
        known_columns += [number(i + 1).alias(f"__{c}") for i, c in enumerate(("draws", "red", "blue"))]
    rows_known = parsed.select("*", *known_columns)

    chance = lambda color: R.fraction(F.coalesce(F.try_element_at(seen["finite_draw"]["counts"], color), F.lit(0)).cast("long"), F.col("__total"))
    last = {
        "ownership": lambda: F.when(qtype == "noul", F.when(asked.isNotNull(), let(yes(answer == asked), lambda a: _hard(keys, a)))).otherwise(_hard(keys, answer)),
        "finite_draw": lambda: F.when(qtype == "noul", F.when(asked.isNotNull(), let(chance(asked), lambda p: _event(p, keys, "true")))).otherwise(F.transform(keys, chance)),
        "latent_mixture": lambda: F.when(F.col("__mixture").isNotNull(), F.when(qtype == "noul", _event(F.col("__mixture"), keys, "true")).otherwise(_event(F.col("__mixture"), keys, "Success"))),
        "without_replacement": lambda: F.when(F.col("__draws").isNotNull(), R.without_replacement(F.col("__red"), F.col("__blue"), F.col("__draws"))),
    }
    cases = {f: last[f]() if f in last else _hard(keys, answer) for f in families}
    kept = [F.col(c) for c in rows.columns if c != name]
    return rows_known.select(*kept, _by(family, cases).alias(name))


def fractions_text(exact: Column) -> Column:
    return F.transform(exact, R.written)


def records(rows: DataFrame) -> DataFrame:
    """Stored records of presented and solved rows: kind, template, stratum, option ids, probabilities by key, and the written fractions."""
    keys = F.col("__keys")
    soft = F.col("pool") == "synthetic_probability"
    best = F.get(keys, (F.array_position(F.transform("exact", lambda f: f["n"]), _one()) - 1).cast("int"))
    return rows.select("*", F.transform("options", lambda o: o["key"]).alias("__keys")).select(
        *rows.columns, F.when(soft, "known_distribution").otherwise("hard").alias("kind"), keys.alias("keys"), F.transform("exact", lambda f: f["n"] / f["d"]).alias("probabilities"), fractions_text(F.col("exact")).alias("fractions"),
        F.transform(keys, lambda k: F.concat_ws(":", "family", "qtype", k)).alias("option_ids"), F.concat_ws(".", "family", "qtype", F.concat(F.lit("v"), (F.col("wording") + 1).cast("string"))).alias("template_id"),
        F.when(soft, F.concat_ws("/", "family", "qtype")).otherwise(F.concat_ws("/", "family", "qtype", best)).alias("sampling_stratum"),
    )


def shown(families: tuple[str, ...] = FAMILIES) -> Column:
    """Whether a state is what the facts render to."""
    return state_of(F.col("family"), F.col("facts"), families).eqNullSafe(F.col("state"))


def problem(rows: DataFrame, name: str = "problem", families: tuple[str, ...] = FAMILIES, known: str | None = None, seen: str | None = None) -> DataFrame:
    """Adds `name`: the first thing wrong with a stored record, or null.

    Where facts and states are no longer there, `known` and `seen` name columns with what the stored state came to (as in `solved`) and whether it was as it is shown.

    pool, presentation (state, instructions or options aren't what the facts render to), template, options (fewer than two, or ids that don't fit), unsolvable, kind, keys (of the probabilities, in order),
    not_one_hot, target (a probability isn't the chance that follows from the visible text), fractions, sum.
    """
    f, q = F.col("family"), F.col("qtype")
    keys = F.col("__keys")
    differs = lambda a, b: ~a.eqNullSafe(b)
    solved_rows = solved(rows, "__exact", families, known).select("*", F.transform("options", lambda o: o["key"]).alias("__keys"))
    exact = F.col("__exact")
    off = F.exists(F.zip_with("probabilities", exact, lambda p, x: F.coalesce(F.abs(p - x["n"] / x["d"]) > 1e-12, F.lit(True))), lambda bad: bad)
    total = F.aggregate("probabilities", F.lit(0.0), lambda a, x: a + x)
    soft = F.col("pool") == "synthetic_probability"
    first = (
        F.when(differs(_by(f, {k: F.lit(v) for k, v in POOL_OF.items() if k in families}), F.col("pool")), "pool")
        .when(~(shown(families) if seen is None else F.col(seen)) | differs(instructions_of(f, q, F.col("wording"), F.col("asked"), families), F.col("instructions")) | differs(options_of(f, q, F.col("order"), F.col("facts"), families), F.col("options")), "presentation")
        .when(differs(F.concat_ws(".", f, q, F.concat(F.lit("v"), (F.col("wording") + 1).cast("string"))), F.col("template_id")) | (F.coalesce("sampling_stratum", F.lit("")) == ""), "template")
        .when((F.size(keys) < 2) | differs(F.transform(keys, lambda k: F.concat_ws(":", f, q, k)), F.col("option_ids")) | (F.size(F.array_distinct(keys)) < F.size(keys)), "options")
        .when(exact.isNull() | F.exists(exact, lambda x: x.isNull()), "unsolvable")
        .when(differs(F.when(soft, "known_distribution").otherwise("hard"), F.col("kind")), "kind")
        .when(differs(F.col("keys"), keys) | (F.size("probabilities") != F.size(keys)), "keys")
        .when(~soft & (F.size(F.filter(exact, lambda x: x["n"] == x["d"])) != 1), "not_one_hot")
        .when(off, "target").when(differs(F.col("fractions"), fractions_text(exact)), "fractions").when(~F.coalesce(F.abs(total - 1) <= 1e-12, F.lit(False)), "sum")
    )
    return solved_rows.withColumn(name, first).drop("__exact", "__keys")
