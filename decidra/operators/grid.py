"""A grid of synthetic decisions: for each root of a given table and each family, two linked views with their targets.

Chance is counter-based: every number is a hash of the seed, the root and the number's name, and what differs between the views also of the view.  So any part of the grid can be
made anywhere, alone and again, and a view's facts are its root's.  Both views share the facts; they differ in wording, in the order of options, and where a family has two kinds of
question, in the kind.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import apart
from .presentation import POOL_OF, presented, records, solved
from .sampling import drawn
from .synth import COLORS, PEOPLE, chance

STATUSES = ("passed", "pending", "failed")


def facts_of(family: str, seed: str, root: Column) -> Column:
    """The facts of a root as a struct."""
    at = lambda name, size: chance(f"{seed}/{family}", root, name, size)
    person = lambda name: F.array(*[F.lit(p) for p in PEOPLE])[at(name, len(PEOPLE))]
    status = lambda name: F.when(at(name, 4) > 0, STATUSES[0]).otherwise(F.array(F.lit(STATUSES[1]), F.lit(STATUSES[2]))[at(f"{name}?", 2)])
    check = lambda name, now: F.struct(status(name).alias("status"), (now - F.when(at(f"{name}v", 6) == 0, 1).otherwise(0)).alias("version"))
    often = lambda name, of=5: at(name, of) > 0
    if family == "eligibility":
        # One candidate, by chance, is eligible whatever the others are; costs are different.
        sure, shift = at("sure", 4), at("cost", 29)
        each = [F.struct(F.lit(p).alias("name"), F.when(sure == i, 80 + at(f"cap{i}", 20)).otherwise(20 + at(f"cap{i}", 80)).alias("capacity"), F.when(sure == i, 1 + at(f"delay{i}", 8)).otherwise(1 + at(f"delay{i}", 20)).alias("delay"), (often(f"cert{i}", 4) | (sure == i)).alias("certified"), (100 + F.pmod(shift + 7 * i, F.lit(29))).alias("cost")) for i, p in enumerate(PEOPLE)]
        return F.struct(F.array(*each).alias("candidates"), (20 + at("min", 40)).alias("minimum_capacity"), (8 + at("max", 12)).alias("maximum_delay"))
    if family == "preservation":
        return F.struct(often("a").alias("authorized"), (at("f", 5) == 0).alias("frozen"), at("b", 100).alias("balance"), (at("c", 80) - 40).alias("change"), at("r", 30).alias("reserve"), (60 + at("l", 60)).alias("ceiling"))
    if family == "ownership":
        events = [F.struct(person(f"s{i}").alias("sender"), person(f"r{i}").alias("recipient"), often(f"a{i}", 4).alias("accepted")) for i in range(5)]
        return F.struct(person("o").alias("initial_owner"), F.array(*events).alias("events"))
    need, now = 3 + at("need", 6), 2 + at("now", 7)
    if family == "shipment":
        return F.struct((need - 1 + at("packed", 4)).alias("packed"), need.alias("required"), often("seal").alias("seal_intact"), status("insp").alias("inspection"), often("hand", 3).alias("handed_over"), status("rec").alias("receipt_validation"))
    if family == "laboratory":
        assay = now + at("av", 2)
        return F.struct((need + 2 + at("col", 4)).alias("collected"), at("dam", 4).alias("damaged"), need.alias("required"), (40 + at("ctl", 30)).alias("control"), F.lit(42).alias("control_low"), F.lit(66).alias("control_high"), now.alias("batch_version"), assay.alias("assay_version"), check("assay", now).alias("assay"), check("review", assay).alias("review"))
    if family == "deployment":
        return F.struct(now.alias("current_version"), *[check(c, now).alias(c) for c in ("build", "tests", "approval", "rollout")], (10 - F.when(at("tp", 5) == 0, 1).otherwise(0)).alias("tests_passed"), F.lit(10).alias("tests_required"), (3 - F.when(at("hz", 4) == 0, 1).otherwise(0)).alias("healthy_zones"), F.lit(3).alias("required_zones"))
    if family == "finite_draw":
        return F.struct(F.create_map(*[x for c in COLORS for x in (F.lit(c), 1 + at(c, 9))]).alias("counts"))
    if family == "latent_mixture":
        def mechanism(i: int) -> Column:
            signal, outcome = 4 + at(f"st{i}", 5), 4 + at(f"ot{i}", 5)
            return F.struct(F.lit(f"M{i + 1}").alias("name"), (1 + at(f"w{i}", 4)).alias("prior_weight"), (1 + F.pmod(at(f"s{i}", 64), signal)).alias("signal_count"), signal.alias("signal_total"), F.pmod(at(f"o{i}", 64), outcome + 1).alias("success_count"), outcome.alias("outcome_total"))

        return F.struct(F.array(*[mechanism(i) for i in range(3)]).alias("mechanisms"))
    if family == "without_replacement":
        return F.struct((2 + at("red", 9)).alias("red"), (2 + at("blue", 9)).alias("blue"), (1 + at("draws", 4)).alias("draws"))
    raise ValueError(f"no such family: {family}")


#: Kinds of question of the first and the second view.
KINDS = {"eligibility": ("choice", "choice"), "preservation": ("noul", "noul"), "ownership": ("choice", "noul"), "shipment": ("score",) * 2, "laboratory": ("score",) * 2, "deployment": ("score",) * 2, "finite_draw": ("choice", "noul"), "latent_mixture": ("noul", "choice"), "without_replacement": ("score",) * 2}
CHOICES = {"eligibility": PEOPLE, "ownership": PEOPLE, "finite_draw": COLORS, "latent_mixture": ("Success", "Failure")}
#: Whom or what a noul asks for.
ASKED = {"ownership": PEOPLE, "finite_draw": COLORS}


def drafts(roots: DataFrame, root: str, seed: str, family: str) -> DataFrame:
    """What a family's two views are made of, one row for each root: root, facts (JSON), orders (of each view its order, or null) and asked."""
    text = F.col(root).cast("string")
    orders, asked = F.lit(None).cast("array<array<string>>"), F.lit(None).cast("string")
    if family in CHOICES:
        order = lambda v: F.sort_array(F.array(*[F.struct(drawn(f"{seed}/order", F.lit(family), text, F.lit(v), F.lit(n)).alias("h"), F.lit(n).alias("n")) for n in CHOICES[family]]))["n"]
        orders = F.array(*[order(v) if kind == "choice" else F.lit(None).cast("array<string>") for v, kind in enumerate(KINDS[family])])
    if family in ASKED:
        names = ASKED[family]
        asked = F.array(*[F.lit(n) for n in names])[chance(f"{seed}/asked", text, "name", len(names))]
    return roots.select(apart(text).alias("root"), F.to_json(facts_of(family, seed, text)).alias("facts"), orders.alias("orders"), asked.alias("asked"))


def spread(rows: DataFrame, family: str) -> DataFrame:
    """Two views for each draft of one family; what depends on the family is settled here, so that no row chooses among all families' expressions.

    Columns beside those of a draft are kept; views of drafts without a root (of which several may be one row) have no ids.
    """
    variant, kinds = F.col("variant"), KINDS[family]
    qtype = F.when(variant == 0, kinds[0]).otherwise(kinds[1]) if kinds[0] != kinds[1] else F.lit(kinds[0])
    kept = [c for c in rows.columns if c not in ("orders", "asked")]
    both = rows.select("*", F.lit(family).alias("family"), F.lit(POOL_OF[family]).alias("pool"), F.explode(F.array(F.lit(0), F.lit(1))).alias("variant"))
    group = F.concat_ws(":", "pool", "family", "root")
    ids = [group.alias("group_id"), F.concat(group, F.lit(":base")).alias("case_id"), F.concat(group, F.lit(":view"), variant.cast("string")).alias("view_id")] if "root" in kept else []
    order = F.when(qtype == "choice", F.get("orders", variant)) if family in CHOICES else F.col("orders")[0]
    return both.select(*kept, "family", "pool", "variant", qtype.alias("qtype"), *ids, variant.alias("wording"), F.when(qtype == "noul", F.col("asked")).alias("asked"), order.alias("order"))


def views(roots: DataFrame, root: str, seed: str, families: tuple[str, ...] = tuple(POOL_OF)) -> DataFrame:
    """Two rows for each value of `root` and family: root, family, pool, variant, ids, facts (JSON), qtype, wording, asked and order."""
    return reduce(DataFrame.unionByName, [spread(drafts(roots, root, seed, f), f) for f in families])


def grid(roots: DataFrame, root: str, seed: str, families: tuple[str, ...] = tuple(POOL_OF)) -> DataFrame:
    """The grid's records: views presented and solved from what they show, family by family."""
    return reduce(DataFrame.unionByName, [recorded(spread(drafts(roots, root, seed, f), f), f) for f in families])


def recorded(rows: DataFrame, family: str, known: str | None = None) -> DataFrame:
    """The records of one family's views; `known` as in `solved`."""
    return records(solved(presented(rows, (family,)), families=(family,), known=known))
