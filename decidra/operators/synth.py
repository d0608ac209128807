"""Synthetic decisions of nine families, derived from row numbers by hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rational as R
from ..functions.options import option_ids

COLORS = ("Red", "Blue", "Green")
PEOPLE = ("Ada", "Bram", "Cleo", "Dara")


def chance(seed: str, root: Column, name: str, size: int) -> Column:
    """A whole number in [0, size) that depends on seed, root and name alone."""
    return F.pmod(F.conv(F.left(F.sha2(F.concat_ws("|", F.lit(seed), root.cast("string"), F.lit(name)), 256), F.lit(8)), 16, 10).cast("long"), F.lit(size)).cast("int")


def draws(spark: SparkSession, n: int, seed: str = "0") -> DataFrame:
    """finite_draw: counts of three colours and their chances as fractions."""
    root = F.col("root")
    counts = F.array(*[1 + chance(seed, root, c, 9) for c in COLORS])
    rows = spark.range(n).select(F.col("id").alias("root")).withColumn("counts", R.reduced(counts))
    return rows.select("root", F.lit("finite_draw").alias("family"), "counts", R.finite_draw(F.col("counts")).alias("exact"))


def samples(spark: SparkSession, n: int, seed: str = "0") -> DataFrame:
    """without_replacement: red, blue, draws and the chances of each red count."""
    root = F.col("root")
    rows = spark.range(n).select(F.col("id").alias("root")).withColumn("red", 2 + chance(seed, root, "red", 38)).withColumn("blue", 2 + chance(seed, root, "blue", 38)).withColumn("draws", 1 + chance(seed, root, "draws", 4))
    kept = rows.withColumn("draws", F.least("draws", F.col("red") + F.col("blue")))
    return kept.select("root", F.lit("without_replacement").alias("family"), "red", "blue", "draws", R.without_replacement(F.col("red"), F.col("blue"), F.col("draws")).alias("exact"))


def mixtures(spark: SparkSession, n: int, seed: str = "0") -> DataFrame:
    """latent_mixture: three mechanisms and the chance of success given the signal."""
    root = F.col("root")

    def mechanism(i: int) -> Column:
        at = lambda name, size: chance(seed, root, f"{name}{i}", size)
        total, out = 4 + at("st", 5), 4 + at("ot", 5)
        return F.struct((1 + at("w", 4)).cast("long").alias("prior_weight"), (1 + F.pmod(at("s", 64), total)).cast("long").alias("signal_count"), total.cast("long").alias("signal_total"), F.pmod(at("o", 64), out + 1).cast("long").alias("success_count"), out.cast("long").alias("outcome_total"))

    rows = spark.range(n).select(F.col("id").alias("root")).withColumn("mechanisms", F.array(*[mechanism(i) for i in range(3)]))
    return rows.select("root", F.lit("latent_mixture").alias("family"), "mechanisms", R.latent_mixture(F.col("mechanisms")).alias("exact"))


def transfers(spark: SparkSession, n: int, steps: int = 5, seed: str = "0") -> DataFrame:
    """ownership: a first owner, transfers in order, and the last owner."""
    root, people = F.col("root"), F.array(*[F.lit(p) for p in PEOPLE])
    event = lambda i: F.struct(people[chance(seed, root, f"a{i}", 4)].alias("sender"), people[chance(seed, root, f"b{i}", 4)].alias("recipient"), (chance(seed, root, f"c{i}", 4) > 0).alias("accepted"))
    rows = spark.range(n).select(F.col("id").alias("root")).withColumn("initial_owner", people[chance(seed, root, "o", 4)]).withColumn("events", F.array(*[event(i) for i in range(steps)]))
    return rows.select("root", F.lit("ownership").alias("family"), "initial_owner", "events", R.final_owner(F.col("initial_owner"), F.col("events")).alias("owner"))


def record(rows: DataFrame, pool: str, qtype: str, options: Column, target: Column, hard: bool) -> DataFrame:
    """Canonical decisions of solved facts: ids, relation, stratum, options and target."""
    group = F.format_string("%s:%s:%04d", F.lit(pool), F.col("family"), F.col("root"))
    best = F.get(F.transform(options, lambda o: o["key"]), (F.array_position(target, F.array_max(target)) - 1).cast("int"))
    stratum = F.concat_ws("/", F.col("family"), F.lit(qtype), *([best] if hard else []))
    return rows.select(
        F.concat(group, F.lit(":base")).alias("case_id"), group.alias("group_id"), F.concat(group, F.lit(":view0")).alias("view_id"), F.lit(pool).alias("source"),
        "family", F.lit(qtype).alias("qtype"), options.alias("options"), option_ids(F.col("family"), F.lit(qtype), options).alias("option_ids"),
        target.alias("target"), F.lit("hard" if hard else "known_distribution").alias("target_kind"), stratum.alias("sampling_stratum"),
        F.lit("root").alias("relation"), F.concat_ws(".", F.col("family"), F.lit(qtype), F.lit("v1")).alias("template_id"),
    )


def choosing(spark: SparkSession, n: int, seed: str = "0") -> DataFrame:
    """eligibility: four candidates of different costs, limits, and the cheapest eligible one.

    Rows without an eligible candidate are left out.
    """
    root = F.col("root")
    order = chance(seed, root, "cost", 24)

    def candidate(i: int) -> Column:
        at = lambda name, size: chance(seed, root, f"{name}{i}", size)
        return F.struct(F.lit(PEOPLE[i]).alias("name"), (20 + at("cap", 80)).alias("capacity"), (1 + at("delay", 20)).alias("delay"), (at("cert", 4) > 0).alias("certified"), (F.pmod(order + i * 7, F.lit(29)) + 100).alias("cost"))

    rows = spark.range(n).select(F.col("id").alias("root")).withColumn("candidates", F.array(*[candidate(i) for i in range(4)]))
    rows = rows.withColumn("minimum_capacity", 20 + chance(seed, root, "min", 40)).withColumn("maximum_delay", 8 + chance(seed, root, "max", 12))
    solved = rows.withColumn("answer", R.eligible(F.col("candidates"), F.col("minimum_capacity"), F.col("maximum_delay")))
    return solved.where(F.col("answer").isNotNull()).select("root", F.lit("eligibility").alias("family"), "candidates", "minimum_capacity", "maximum_delay", "answer")


def changes(spark: SparkSession, n: int, seed: str = "0") -> DataFrame:
    """preservation: a proposed change and whether every condition allows it."""
    root = F.col("root")
    at = lambda name, size: chance(seed, root, name, size)
    rows = spark.range(n).select(F.col("id").alias("root")).select("root", (at("a", 5) > 0).alias("authorized"), (at("f", 5) == 0).alias("frozen"), at("b", 100).alias("balance"), (at("c", 80) - 40).alias("change"), at("r", 30).alias("reserve"), (60 + at("l", 60)).alias("ceiling"))
    return rows.select(F.lit("preservation").alias("family"), "*", R.preserved(*[F.col(c) for c in ("authorized", "frozen", "balance", "change", "reserve", "ceiling")]).alias("allowed"))


def levels(spark: SparkSession, n: int, seed: str = "0") -> DataFrame:
    """shipment, laboratory and deployment: facts as a struct and the level they reach."""
    root = F.col("root")
    at = lambda name, size: chance(seed, root, name, size)
    status = lambda name: F.when(at(name, 4) > 0, "passed").when(at(f"{name}?", 2) == 0, "pending").otherwise("failed")
    check = lambda name, now: F.struct(status(name).alias("status"), (now - F.when(at(f"{name}v", 6) == 0, 1).otherwise(0)).alias("version"))
    base = spark.range(n).select(F.col("id").alias("root"))
    need, batch, now = 3 + at("need", 6), 2 + at("batch", 5), 2 + at("now", 7)
    ship = base.select("root", need.alias("required"), (need - 1 + at("packed", 4)).alias("packed"), (at("seal", 5) > 0).alias("seal_intact"), status("insp").alias("inspection"), (at("hand", 3) > 0).alias("handed_over"), status("rec").alias("receipt_validation"))
    ship = ship.select("root", F.lit("shipment").alias("family"), R.shipment_level(*[F.col(c) for c in ("packed", "required", "seal_intact", "inspection", "handed_over", "receipt_validation")]).alias("level"))
    lab = F.struct((need + at("col", 4)).alias("collected"), at("dam", 3).alias("damaged"), need.alias("required"), (40 + at("ctl", 30)).alias("control"), F.lit(45).alias("control_low"), F.lit(65).alias("control_high"), batch.alias("batch_version"), (batch + at("av", 2)).alias("assay_version"), check("assay", batch).alias("assay"), check("review", batch + at("av", 2)).alias("review"))
    deploy = F.struct(now.alias("current_version"), *[check(c, now).alias(c) for c in ("build", "tests", "approval", "rollout")], (10 - F.when(at("tp", 5) == 0, 1).otherwise(0)).alias("tests_passed"), F.lit(10).alias("tests_required"), (3 - F.when(at("hz", 4) == 0, 1).otherwise(0)).alias("healthy_zones"), F.lit(3).alias("required_zones"))
    by = lambda facts, name, level: base.select("root", facts.alias("f")).select("root", F.lit(name).alias("family"), level(F.col("f")).alias("level"))
    return ship.unionByName(by(lab, "laboratory", R.laboratory_level)).unionByName(by(deploy, "deployment", R.deployment_level))


def ask(rows: DataFrame, questions: dict[str, dict]) -> DataFrame:
    """Every row with every preset question: question, qtype, instructions and options.

    Presets are {name: {type, instructions, criteria}}; criteria are an ordered dict, a list
    or None.
    """
    nothing = F.lit(None).cast("string")

    def options(criteria) -> Column:
        pairs = criteria.items() if isinstance(criteria, dict) else [(c, None) for c in criteria or ()]
        each = [F.struct(F.lit(str(k)).alias("key"), (nothing if v is None else F.lit(str(v))).alias("desc")) for k, v in pairs]
        return F.array(*each) if each else F.array().cast("array<struct<key:string,desc:string>>")

    asked = F.array(*[F.struct(F.lit(name).alias("question"), F.lit(q["type"]).alias("qtype"), F.lit(q["instructions"]).alias("instructions"), options(q.get("criteria")).alias("options")) for name, q in questions.items()])
    return rows.select("*", F.explode(asked).alias("__q")).select(*rows.columns, "__q.*")
