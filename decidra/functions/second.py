"""Second solvers of the nine families, by other ways than `rational`: sorting, histories, enumeration, and a dynamic programme over draws.

They agree with the first ones or one of them is wrong; each takes a struct of facts and returns what the first solver does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let
from .rational import fraction


def eligible(f: Column) -> Column:
    """By sorting: the first of the eligible, unless the second costs as much."""
    fit = F.filter(f["candidates"], lambda c: c["certified"] & ~((c["capacity"] < f["minimum_capacity"]) | (c["delay"] > f["maximum_delay"])))
    by_cost = F.array_sort(F.transform(fit, lambda c: F.struct(c["cost"].alias("cost"), c["name"].alias("name"))))
    return let(by_cost, lambda s: F.when((F.size(s) > 0) & ~F.coalesce(F.get(s, F.lit(1))["cost"] == F.get(s, F.lit(0))["cost"], F.lit(False)), F.get(s, F.lit(0))["name"]))


def preserved(f: Column) -> Column:
    """By counting violations."""
    end = f["balance"] + f["change"]
    broken = F.array(~f["authorized"], f["frozen"], end < f["reserve"], end > f["ceiling"])
    return ~F.exists(broken, lambda b: b)


def final_owner(f: Column) -> Column:
    """By the history of owners, of whom the last is it."""
    step = lambda owners, e: F.when(e["accepted"] & (e["sender"] == F.element_at(owners, -1)), F.array_append(owners, e["recipient"])).otherwise(owners)
    return F.element_at(F.aggregate(f["events"], F.array(f["initial_owner"]), step), -1)


def highest(stages: Column) -> Column:
    """The longest prefix of stages that all hold."""
    return F.aggregate(stages, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, s: F.struct((a["n"] + (a["on"] & s).cast("int")).alias("n"), (a["on"] & s).alias("on")), lambda a: a["n"])


def shipment_level(f: Column) -> Column:
    ready = (f["packed"] >= f["required"]) & f["seal_intact"] & (f["inspection"] == "passed")
    return F.when(~ready, 0).when(f["handed_over"] & (f["receipt_validation"] == "passed"), 2).otherwise(1)


def _good(check: Column, version: Column) -> Column:
    return F.struct(check["status"], check["version"]).eqNullSafe(F.struct(F.lit("passed"), version))


def laboratory_level(f: Column) -> Column:
    inside = ~((f["control"] < f["control_low"]) | (f["control"] > f["control_high"]))
    return highest(F.array(f["collected"] >= f["required"] + f["damaged"], _good(f["assay"], f["batch_version"]) & inside, _good(f["review"], f["assay_version"])))


def deployment_level(f: Column) -> Column:
    now = f["current_version"]
    checks = [_good(f[c], now) for c in ("build", "tests", "approval", "rollout")]
    checks[1] &= f["tests_passed"] == f["tests_required"]
    checks[3] &= f["healthy_zones"] == f["required_zones"]
    return highest(F.array(*checks))


def finite_draw(f: Column, keys: Column) -> Column:
    """By counting tickets one by one."""
    tickets = F.flatten(F.transform(F.map_entries(f["counts"]), lambda e: F.array_repeat(e["key"], e["value"])))
    return let(tickets, lambda t: F.transform(keys, lambda k: fraction(F.size(F.filter(t, lambda x: x == k)).cast("long"), F.size(t).cast("long"))))


def latent_mixture(f: Column) -> Column:
    """By enumerating every mechanism's pairs of tickets; the mass of a pair is put over the common denominator."""
    one = F.lit(1).cast("long")
    common = F.aggregate(f["mechanisms"], one, lambda a, m: a * m["signal_total"] * m["outcome_total"])

    def joint(m: Column, whole: Column) -> Column:
        pairs = F.flatten(F.transform(F.sequence(one, m["signal_total"]), lambda s: F.transform(F.sequence(one, m["outcome_total"]), lambda o: F.struct(s.alias("s"), o.alias("o")))))
        alerts = F.filter(pairs, lambda p: p["s"] <= m["signal_count"])
        mass = m["prior_weight"] * F.call_function("div", whole, m["signal_total"] * m["outcome_total"])
        return F.struct((F.size(F.filter(alerts, lambda p: p["o"] <= m["success_count"])) * mass).alias("n"), (F.size(alerts) * mass).alias("d"))

    def total(each: Column) -> Column:
        add = lambda field: F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x[field])
        return fraction(add("n"), add("d"))

    return let(common, lambda whole: let(F.transform(f["mechanisms"], lambda m: joint(m, whole)), total))


def without_replacement(f: Column) -> Column:
    """By a dynamic programme over draws: ways to have drawn so many red tokens, drawing one after another."""
    red, blue = f["red"].cast("long"), f["blue"].cast("long")
    zero = F.lit(0).cast("long")
    start = F.transform(F.sequence(F.lit(0), f["draws"]), lambda r: F.when(r == 0, 1).otherwise(0).cast("long"))

    def draw(ways: Column, i: Column) -> Column:
        # Before draw i (from 0), i tokens are gone, r of them red.
        took_red = lambda r: F.coalesce(F.get(ways, r - 1), zero) * F.greatest(red - (r - 1), zero)
        took_blue = lambda w, r: w * F.greatest(blue - (i - r), zero)
        return F.transform(ways, lambda w, r: took_blue(w, r) + F.when(r > 0, took_red(r)).otherwise(zero))

    ways = F.aggregate(F.sequence(F.lit(0), f["draws"] - 1), start, draw)
    return let(ways, lambda w: let(F.aggregate(w, zero, lambda a, x: a + x), lambda t: F.transform(w, lambda x: fraction(x, t))))
