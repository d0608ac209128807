"""Questions and their options: rendering, prompts, answers.

Options are `array<struct<key:string,desc:string>>`, as their order carries meaning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a yes/no question's options say when they have no description.
FALSE_TEXT, TRUE_TEXT = "no, the statement does not hold", "yes, the statement holds"
OPTION = "array<struct<key:string,desc:string>>"


def from_list(keys: Column) -> Column:
    """Options without descriptions, from a list of labels."""
    return F.transform(keys, lambda k: F.struct(k.alias("key"), F.lit(None).cast("string").alias("desc")))


def as_text(value: Column, kind: str) -> Column:
    """A criterion as text: strings as they are, everything else as JSON."""
    return value if kind == "string" else F.to_json(value, {"ignoreNullFields": "false"})


def _described(desc: Column) -> Column:
    return desc.isNotNull() & (desc != "")


def rendered(qtype: Column, options: Column) -> Column:
    """Option texts in label order.

    Choice: key, or `key: description`.  Score: `level i: description`.  Yes/no: always
    [false, true], with stock descriptions where there are none.
    """
    choice = F.transform(options, lambda o: F.when(_described(o["desc"]), F.concat(o["key"], F.lit(": "), o["desc"])).otherwise(o["key"]))
    score = F.transform(options, lambda o, i: F.concat(F.lit("level "), i.cast("string"), F.lit(": "), F.coalesce(o["desc"], o["key"])))

    def side(key: str, text: str) -> Column:
        own = F.try_element_at(F.filter(options, lambda o: (o["key"] == key) & _described(o["desc"])), F.lit(1))["desc"]
        return F.concat(F.lit(f"{key}: "), F.coalesce(own, F.lit(text)))

    noul = F.array(side("false", FALSE_TEXT), side("true", TRUE_TEXT))
    return F.when(qtype == "noul", noul).when(qtype == "score", score).otherwise(choice)


def prompt(state: Column, instructions: Column, qtype: Column, options: Column, mask: str = "[MASK]") -> Column:
    """State, question, and a line for each option with a mask (one mask for yes/no)."""
    lines = F.transform(rendered(qtype, options), lambda o: F.concat(F.lit("- "), o, F.lit(f" {mask}")))
    body = F.when(qtype == "noul", F.lit(mask)).otherwise(F.array_join(lines, "\n"))
    return F.concat(F.lit("State:\n"), state, F.lit("\n\nQuestion: "), instructions, F.lit("\n"), body)


def state_text(state: Column, is_text: Column) -> Column:
    """A state as a model reads it: a text as it is, JSON with a space behind commas and colons and none elsewhere between its parts."""
    parts = F.regexp_extract_all(state, F.lit(r'"(?:[^"\\]|\\.)*+"|[^"]+'), F.lit(0))
    spaced = F.transform(parts, lambda x: F.when(x.startswith('"'), x).otherwise(F.regexp_replace(F.regexp_replace(x, r"\s+", ""), "([,:])", "$1 ")))
    return F.when(is_text, state).otherwise(F.array_join(spaced, ""))


def query_text(state: Column, instructions: Column) -> Column:
    """Instructions, if there are any, and the state below."""
    return F.when(F.coalesce(instructions, F.lit("")) == "", state).otherwise(F.concat(instructions, F.lit("\n"), state))


def substituted(text: Column, values: dict[str, Column]) -> Column:
    """Placeholders {name} replaced by columns."""
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return text


def shuffled(options: Column, *seed: Column) -> Column:
    """Options in an order that depends on the seed and their keys alone."""
    salt = F.concat_ws("|", *seed)
    keyed = F.transform(options, lambda o: F.struct(F.sha2(F.concat_ws("|", salt, o["key"]), 256).alias("h"), o.alias("o")))
    return F.transform(F.sort_array(keyed), lambda x: x["o"])


def subset(options: Column, keys: Column) -> Column:
    """The options of `keys`, in the order of `keys`."""
    return F.transform(keys, lambda k: F.filter(options, lambda o: o["key"] == k)[0])


def answer(qtype: Column, options: Column, p: Column) -> Column:
    """What a caller gets, as a struct: label, value (yes/no: chance of yes; score: expected
    level) and the options' probabilities as a map in option order."""
    keys = F.when(qtype == "noul", F.array(F.lit("false"), F.lit("true"))).otherwise(F.transform(options, lambda o: o["key"]))
    level = F.aggregate(F.transform(p, lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    best = F.get(keys, (F.array_position(p, F.array_max(p)) - 1).cast("int"))
    value = F.when(qtype == "noul", F.get(p, F.lit(1))).when(qtype == "score", level)
    return F.struct(best.alias("label"), value.alias("value"), F.map_from_arrays(keys, p).alias("probabilities"))


def option_ids(family: Column, qtype: Column, options: Column) -> Column:
    keys = F.when(qtype == "noul", F.array(F.lit("false"), F.lit("true"))).when(qtype == "score", F.transform(options, lambda o, i: i.cast("string"))).otherwise(F.transform(options, lambda o: o["key"]))
    return F.transform(keys, lambda k: F.concat_ws(":", family, qtype, k))


def candidate_set(target: Column, directory: Column, size: int, *seed: Column) -> Column:
    """`size` labels that contain `target`: a circular window of the seeded directory."""
    salt = F.concat_ws("|", *seed)
    keyed = F.transform(directory, lambda d: F.struct(F.sha2(F.concat_ws("|", salt, d), 256).alias("h"), d.alias("d")))
    order = F.transform(F.sort_array(keyed), lambda x: x["d"])
    twice = F.concat(order, order)
    back = F.pmod(F.conv(F.substring(F.sha2(salt, 256), 1, 8), 16, 10).cast("long"), F.lit(size))
    start = F.pmod(F.array_position(order, target) - 1 - back, F.size(order)) + 1
    return F.slice(twice, start.cast("int"), F.lit(size))


def directory(labels: Column, clustered: Column, *seed: Column) -> Column:
    """Labels (structs of label and domain) in a seeded order: any order, or domain by domain, domains and their labels shuffled."""
    salt = F.concat_ws("|", *seed)
    hashed = lambda x: F.sha2(F.concat_ws("|", salt, x), 256)
    keyed = F.transform(labels, lambda x: F.struct(F.when(clustered, hashed(F.concat(F.lit("domain|"), x["domain"]))).otherwise("").alias("d"), hashed(x["label"]).alias("h"), x["label"].alias("label")))
    return F.transform(F.array_sort(keyed), lambda x: x["label"])


def window_of(target: Column, order: Column, size: Column, *seed: Column) -> Column:
    """`size` labels of a circular order, among them the target, each of whose places in the window is equally likely."""
    back = F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("|", *seed, F.lit("back")), 256), 1, 8), 16, 10).cast("long"), size.cast("long"))
    start = F.pmod(F.array_position(order, target) - 1 - back, F.size(order).cast("long")) + 1
    return F.slice(F.concat(order, order), start.cast("int"), size)


def forecast_reason(due: Column, horizon: Column, dates: Column, freeze: Column) -> Column:
    """Why a forecast row is refused; dates are ISO texts.  The horizon is one of the scheduled
    dates (null where there are none) and lies behind the due date; the context was frozen by then."""
    scheduled = dates.isNotNull() & ~F.coalesce(F.array_contains(dates, horizon) & (horizon > due), F.lit(False))
    return F.when(scheduled, "horizon").when(dates.isNull() & horizon.isNotNull(), "unscheduled_horizon").when(~F.coalesce(F.left(freeze, F.lit(10)) <= due, F.lit(False)), "frozen_later")


def unbound(text: Column) -> Column:
    """A placeholder in braces is left."""
    return text.rlike(r"\{[a-z_]+\}")


def allowed_context(context: Column, fields: list[str]) -> Column:
    """Only the named fields of a map, in the order given."""
    return F.map_from_entries(F.transform(F.array(*[F.lit(f) for f in fields]), lambda f: F.struct(f, F.element_at(context, f))))
