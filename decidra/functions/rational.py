"""Exact solvers of the synthetic families; rationals are pairs of longs (n, d), reduced."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two longs that aren't negative, by a function of the commons-math library that Spark ships; null with a null."""
    found = F.java_method(F.lit("org.apache.commons.math3.util.ArithmeticUtils"), F.lit("gcd"), F.coalesce(a.cast("long"), F.lit(0).cast("long")), F.coalesce(b.cast("long"), F.lit(0).cast("long"))).cast("long")
    return F.when(a.isNotNull() & b.isNotNull(), found)


def fraction(n: Column, d: Column) -> Column:
    """n / d in lowest terms as a struct; null for d = 0."""
    lowest = lambda f: let(gcd(F.abs(f["n"]), F.abs(f["d"])), lambda g: F.struct(_exact(f["n"], F.lit(1), g).alias("n"), _exact(f["d"], F.lit(1), g).alias("d")))
    return let(F.struct(n.alias("n"), d.alias("d")), lambda f: F.when(f["d"] != 0, lowest(f)))


def written(f: Column) -> Column:
    return F.concat_ws("/", f["n"].cast("string"), f["d"].cast("string"))


def reduced(counts: Column) -> Column:
    """Counts over their common divisor."""
    return let(F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: gcd(a, x.cast("long"))), lambda g: F.transform(counts, lambda x: F.when(g > 1, _exact(x, F.lit(1), g)).otherwise(x.cast("long"))))


def choose(n: Column, k: Column) -> Column:
    """Binomial coefficient, by exact products (n up to 60)."""
    steps = F.sequence(F.lit(1), F.greatest(k, F.lit(1)))
    product = F.aggregate(steps, F.lit(1).cast("long"), lambda a, i: _exact(a, n - k + i, i))
    return F.when((k < 0) | (k > n), F.lit(0).cast("long")).when(k == 0, F.lit(1).cast("long")).otherwise(product)


def _exact(a: Column, up: Column, down: Column) -> Column:
    return F.call_function("div", a * up.cast("long"), down.cast("long"))


def eligible(candidates: Column, capacity: Column, delay: Column) -> Column:
    """Name of the cheapest certified candidate with enough capacity and little enough delay.

    Null without one, and where two are cheapest.
    """
    fit = F.filter(candidates, lambda c: c["certified"] & (c["capacity"] >= capacity) & (c["delay"] <= delay))

    def cheapest(f: Column) -> Column:
        least = F.array_min(F.transform(f, lambda c: c["cost"]))
        best = F.filter(f, lambda c: c["cost"] == least)
        return F.when(F.size(best) == 1, best[0]["name"])

    return let(fit, cheapest)


def preserved(authorized: Column, frozen: Column, balance: Column, change: Column, reserve: Column, ceiling: Column) -> Column:
    return authorized & ~frozen & (balance + change).between(reserve, ceiling)


def final_owner(first: Column, events: Column) -> Column:
    """The owner after all transfers (sender, recipient, accepted) in order."""
    return F.aggregate(events, first, lambda o, e: F.when((e["sender"] == o) & e["accepted"], e["recipient"]).otherwise(o))


def gate_level(gates: Column) -> Column:
    """How many gates are passed before the first that isn't."""
    at = F.array_position(gates, False)
    return F.when(at > 0, at - 1).otherwise(F.size(gates)).cast("int")


def passed(check: Column, version: Column) -> Column:
    return (check["status"] == "passed") & (check["version"] == version)


def shipment_level(packed: Column, required: Column, sealed: Column, inspection: Column, handed: Column, receipt: Column) -> Column:
    return gate_level(F.array((packed >= required) & sealed & (inspection == "passed"), handed & (receipt == "passed")))


def laboratory_level(f: Column) -> Column:
    qualified = passed(f["assay"], f["batch_version"]) & f["control"].between(f["control_low"], f["control_high"])
    return gate_level(F.array(f["collected"] - f["damaged"] >= f["required"], qualified, passed(f["review"], f["assay_version"])))


def deployment_level(f: Column) -> Column:
    now = f["current_version"]
    tested = passed(f["tests"], now) & (f["tests_passed"] == f["tests_required"])
    rolled = passed(f["rollout"], now) & (f["healthy_zones"] == f["required_zones"])
    return gate_level(F.array(passed(f["build"], now), tested, passed(f["approval"], now), rolled))


def finite_draw(counts: Column) -> Column:
    """Chances of each colour, as fractions."""
    n = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return let(n, lambda t: F.transform(counts, lambda x: fraction(x.cast("long"), t)))


def latent_mixture(mechanisms: Column) -> Column:
    """Chance of success given the signal, as a fraction.

    Mechanisms: prior_weight, signal_count, signal_total, success_count, outcome_total.  All
    terms are put over the product of the totals, so that sums stay whole numbers.
    """
    one = F.lit(1).cast("long")
    product = lambda field: F.aggregate(mechanisms, one, lambda a, m: a * m[field])

    def answer(p: Column) -> Column:
        weight = lambda m: m["prior_weight"] * m["signal_count"] * _exact(p["s"], F.lit(1), m["signal_total"])
        n = F.aggregate(mechanisms, F.lit(0).cast("long"), lambda a, m: a + weight(m) * m["success_count"] * _exact(p["o"], F.lit(1), m["outcome_total"]))
        d = F.aggregate(mechanisms, F.lit(0).cast("long"), lambda a, m: a + weight(m)) * p["o"]
        return F.struct(n.alias("n"), d.alias("d"))

    return let(let(F.struct(product("signal_total").alias("s"), product("outcome_total").alias("o")), answer), lambda x: fraction(x["n"], x["d"]))


def without_replacement(red: Column, blue: Column, draws: Column) -> Column:
    """Chances of 0 .. draws red tokens, as fractions."""
    ways = lambda i: F.when(draws - i <= blue, choose(red, i) * choose(blue, draws - i)).otherwise(F.lit(0).cast("long"))
    return let(choose(red + blue, draws), lambda all_ways: F.transform(F.sequence(F.lit(0), draws), lambda i: fraction(ways(i), all_ways)))
