"""Metrics of decisions with probabilities.

Rows: id, group_id, suite, qtype (choice, score, noul), status, probs, gold_idx, soft,
gold_score.  `scored` adds what each row contributes; everything else is plain aggregation, so
partial sums are combined before any shuffle, and any grouping or grouping set works.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import probs as P
from ..functions.arrays import first_argmax, one_hot
from .tables import stored
from .windows import ranked


def scored(rows: DataFrame) -> DataFrame:
    """Adds per-row contributions; they are null where a row has no such target.

    Rows whose status isn't `ok` contribute to the counts of attempts only.
    """
    ok = F.col("status") == "ok"
    done = lambda c: F.when(ok, c)
    with_pred = rows.withColumn("pred_idx", done(first_argmax(F.col("probs")))).withColumn("__p", done(F.col("probs")))
    p, gold = F.col("__p"), F.col("gold_idx")
    target = F.coalesce(F.col("soft"), F.when(gold.isNotNull(), one_hot(gold, F.size(p))))
    hard = gold.isNotNull() & p.isNotNull()
    level = F.coalesce(F.col("gold_score"), P.expected_level(target))
    is_score = F.col("qtype") == "score"
    out = with_pred.withColumn("__t", F.when(p.isNotNull(), target))
    t = F.col("__t")
    return out.select(
        *rows.columns,
        "pred_idx",
        F.when(hard, F.col("pred_idx") == gold).alias("correct"),
        F.when(gold.isNotNull(), ok & F.coalesce(F.col("pred_idx") == gold, F.lit(False))).alias("attempt_correct"),
        F.when(hard, F.array_max(p)).alias("confidence"),
        F.when(hard, P.hard_brier(p, gold)).alias("brier"),
        F.when(hard, P.nll(p, gold)).alias("nll"),
        F.when(F.col("soft").isNotNull() & p.isNotNull(), P.cross_entropy(p, F.col("soft"))).alias("soft_ce"),
        F.when(F.col("soft").isNotNull() & p.isNotNull(), P.brier(p, F.col("soft"))).alias("soft_brier"),
        F.when((F.col("qtype") == "noul") & t.isNotNull(), (p[1] - t[1]) * (p[1] - t[1])).alias("ptrue_mse"),
        F.when(is_score & p.isNotNull(), F.abs(P.expected_level(p) - level)).alias("score_mae"),
        F.when(is_score & t.isNotNull(), P.rps(p, t)).alias("score_rps"),
        F.when(is_score & t.isNotNull(), P.normalized_rps(p, t)).alias("score_nrps"),
        F.when(t.isNotNull(), P.cross_entropy(p, t)).alias("ce"),
        F.when(t.isNotNull(), P.kl(p, t)).alias("kl"),
        F.when(t.isNotNull(), P.reward(p, t, F.col("qtype"))).alias("reward"),
    )


def summary(keys: bool = True) -> list[Column]:
    """The aggregates of `scored` rows."""
    mean = lambda c, name=None: F.avg(F.col(c).cast("double")).alias(name or c)
    return [
        F.count(F.lit(1)).alias("attempted"),
        F.count_if(F.col("status") == "ok").alias("completed"),
        F.try_divide(F.count_if(F.col("status") == "ok").cast("double"), F.count(F.lit(1)).cast("double")).alias("coverage"),
        F.count("correct").alias("n_hard"),
        mean("correct", "accuracy"),
        F.count("attempt_correct").alias("attempted_hard"),
        mean("attempt_correct", "all_attempted_accuracy"),
        mean("confidence", "mean_confidence"),
        *[mean(c) for c in ("brier", "nll", "soft_ce", "soft_brier", "ptrue_mse", "score_mae", "score_rps", "score_nrps", "ce", "kl", "reward")],
        F.count("soft_ce").alias("n_soft"),
    ]


def summarize(rows: DataFrame, *keys: str) -> DataFrame:
    return (rows.groupBy(*keys) if keys else rows.groupBy()).agg(*summary())


def report(rows: DataFrame, sets: list[list[str]], columns: list[str]) -> DataFrame:
    """The summary over several groupings in one pass; other keys are null, `level` tells which."""
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns])
    return grouped.agg(*summary(), F.grouping_id().alias("level"))


def status_counts(rows: DataFrame, *keys: str) -> DataFrame:
    counts = rows.groupBy(*keys, "status").agg(F.count(F.lit(1)).alias("n"))
    if not keys:
        return counts
    return counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("status_counts"))


def ece(rows: DataFrame, keys: list[str], bins: int = 15, closed: str = "right", confidence: str = "confidence", correct: str = "correct") -> DataFrame:
    """Expected calibration error: over the bins, share * |mean confidence - mean correct|.

    closed="right": bins (low, high], a confidence of 0 is in none.  closed="left": bins
    [low, high), 1 is in the last.
    """
    known = rows.where(F.col(correct).isNotNull())
    c = F.col(confidence)
    at = F.ceil(c * bins) - 1 if closed == "right" else F.least(F.lit(bins - 1), F.floor(c * bins))
    binned = known.groupBy(*keys, at.alias("__b")).agg(F.count(F.lit(1)).alias("n"), F.sum(confidence).alias("c"), F.sum(F.col(correct).cast("double")).alias("h"))
    gap = F.when(F.col("__b") >= 0, F.abs(F.col("c") - F.col("h"))).otherwise(0.0)
    return binned.groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum(gap) / F.sum("n")).alias("ece"))


def macro_f1(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over the labels seen as gold or predicted of 2tp / max(1, 2tp + fp + fn)."""
    known = rows.where(F.col("correct").isNotNull())
    both = known.select(*keys, "correct", F.explode(F.array_distinct(F.array("gold_idx", "pred_idx"))).alias("label"), "gold_idx", "pred_idx")
    tp = F.count_if(F.col("correct"))
    counts = both.groupBy(*keys, "label").agg(tp.alias("tp"), F.count_if(~F.col("correct")).alias("wrong"))
    f1 = 2.0 * F.col("tp") / F.greatest(F.lit(1), 2 * F.col("tp") + F.col("wrong"))
    return counts.groupBy(*keys).agg(F.avg(f1).alias("macro_f1"), F.count(F.lit(1)).alias("n_labels"))


def accuracy_at(rows: DataFrame, keys: list[str], order: str, share: float = 0.5, cells: int = 4096) -> DataFrame:
    """Accuracy of the most confident share of rows, one at least; ties go by `order`.

    Whole cells of confidence are taken as sums; only the cell in which the share ends is
    ranked row by row, so no task ranks a whole suite.
    """
    known = rows.where(F.col("correct").isNotNull()).select(*keys, "confidence", order, F.col("correct").cast("long").alias("__h"), F.floor(F.col("confidence") * cells).alias("__b"))
    sums = known.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"), F.sum("__h").alias("__h"))
    by = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("__n").over(by.orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = F.greatest(F.lit(1), F.floor(F.sum("__n").over(by) * share))
    left = sums.withColumn("__left", wanted - before).where(F.col("__left") > 0)
    whole = left.where(F.col("__left") >= F.col("__n")).select(*keys, "__n", "__h")
    last = known.join(left.where(F.col("__left") < F.col("__n")).select(*keys, "__b", "__left"), [*keys, "__b"])
    ranked = last.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(F.desc("confidence"), order))).where(F.col("__r") <= F.col("__left"))
    parts = whole.unionByName(ranked.select(*keys, F.lit(1).cast("long").alias("__n"), "__h"))
    return parts.groupBy(*keys).agg((F.sum("__h") / F.sum("__n")).alias("accuracy_at"), F.sum("__n").alias("n"))


def group_complete(rows: DataFrame, sizes: DataFrame, *keys: str) -> DataFrame:
    """Share of whole groups whose rows are all right.

    A group counts if all of its rows (`sizes`: group_id, full_n) are there and have a gold.
    """
    groups = rows.groupBy(*keys, "group_id").agg(F.count(F.lit(1)).alias("n"), F.count("gold_idx").alias("g"), F.bool_and(F.coalesce("attempt_correct", F.lit(False))).alias("all_right"))
    whole = groups.join(sizes, "group_id", "left").withColumn("fit", F.coalesce((F.col("n") == F.col("full_n")) & (F.col("g") == F.col("n")), F.lit(False)))
    return (whole.groupBy(*keys) if keys else whole.groupBy()).agg(
        F.avg(F.when(F.col("fit"), F.col("all_right").cast("double"))).alias("group_complete_accuracy"),
        F.count_if("fit").alias("n_groups_eligible"), F.count_if(~F.col("fit")).alias("n_groups_excluded"),
    )


def noul_prf(rows: DataFrame, *keys: str) -> DataFrame:
    """Precision, recall and F1 of `true` over hard yes/no rows; null for empty denominators."""
    hard = rows.where((F.col("qtype") == "noul") & F.col("correct").isNotNull())
    n = lambda p, g: F.count_if((F.col("pred_idx") == p) & (F.col("gold_idx") == g))
    counts = (hard.groupBy(*keys) if keys else hard.groupBy()).agg(F.count(F.lit(1)).alias("n"), n(1, 1).alias("tp"), n(1, 0).alias("fp"), n(0, 1).alias("fn"))
    ratio = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(*counts.columns, ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def level_errors(rows: DataFrame, *keys: str) -> DataFrame:
    """Of score rows: mean error of the expected level against hard levels, the share within
    one level, and the same error against soft targets."""
    s = rows.where((F.col("qtype") == "score") & (F.col("status") == "ok"))
    e = P.expected_level(F.col("probs"))
    marked = s.select(*keys, F.abs(e - F.col("gold_idx")).alias("h"), F.abs(e - P.expected_level(F.col("soft"))).alias("f"))
    return (marked.groupBy(*keys) if keys else marked.groupBy()).agg(F.avg("h").alias("mae_hard"), F.avg((F.col("h") <= 1.0).cast("double")).alias("within_one"), F.avg("f").alias("mae_soft"), F.count("h").alias("n_hard"), F.count("f").alias("n_soft"))


def soft_accuracy(rows: DataFrame, *keys: str) -> DataFrame:
    """Mean probability mass on the target, targets scaled to 1; Brier against the same."""
    s = rows.where(F.col("soft").isNotNull() & (F.col("status") == "ok")).withColumn("__t", P.normalized(F.col("soft")))
    marked = s.select(*keys, F.aggregate(F.zip_with("probs", "__t", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x).alias("a"), P.brier(F.col("probs"), F.col("__t")).alias("b"))
    return (marked.groupBy(*keys) if keys else marked.groupBy()).agg(F.avg("a").alias("soft_accuracy"), F.avg("b").alias("brier_vs_soft"), F.count(F.lit(1)).alias("n_soft"))


def one_hot_metrics(rows: DataFrame, *keys: str) -> DataFrame:
    """Mean probability of the gold option."""
    s = rows.where(F.col("correct").isNotNull()).select(*keys, F.get("probs", F.col("gold_idx")).alias("p"))
    return (s.groupBy(*keys) if keys else s.groupBy()).agg(F.avg("p").alias("mean_gold_probability"), F.count(F.lit(1)).alias("n"))


def suite_means(suites: DataFrame, metrics: list[str], weight: str, only: list[str] | None = None) -> DataFrame:
    """Means over suites: each suite alike, and weighted by `weight`."""
    kept = suites.where(F.col("suite").isin(only)) if only else suites
    means = [F.avg(m).alias(f"macro_{m}") for m in metrics]
    weighted = [F.try_divide(F.sum(F.col(m) * F.col(weight)), F.sum(F.when(F.col(m).isNotNull(), F.col(weight))).cast("double")).alias(f"weighted_{m}") for m in metrics]
    return kept.agg(F.count(F.lit(1)).alias("n_suites"), F.sum(weight).alias("n"), *means, *weighted)


def above_random(groups: DataFrame, metric: str, chance: float) -> DataFrame:
    return groups.agg(F.avg(metric).alias(f"macro_{metric}"), F.count_if(F.col(metric) > chance).alias("n_above_random"), F.count(F.lit(1)).alias("n"))


def target_statistics(rows: DataFrame, target: str, *keys: str) -> DataFrame:
    """Per option place: target mass, and how often it is a largest target (ties count all)."""
    each = rows.where(F.col(target).isNotNull()).select(*keys, F.array_max(target).alias("m"), F.posexplode(target).alias("place", "t"))
    return each.groupBy(*keys, "place").agg(F.sum("t").alias("mass"), F.count_if(F.col("t") == F.col("m")).alias("n_argmax"), F.count(F.lit(1)).alias("n"))


def length_stats(rows: DataFrame, length: str, *keys: str) -> DataFrame:
    """min, max, mean, and the order statistics at n // 2 and int((n - 1) * 0.95), from 0.

    Lengths are counted first, so that a group's window runs over distinct lengths.
    """
    counts = rows.where(F.col(length).isNotNull()).groupBy(*keys, length).agg(F.count(F.lit(1)).alias("__n"))
    by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    upto = counts.withColumn("__u", F.sum("__n").over(by.orderBy(length))).withColumn("__a", F.sum("__n").over(by))
    at = lambda rank: F.min(F.when(F.col("__u") > rank, F.col(length)))
    agg = [F.sum("__n").alias("n"), F.min(length).alias("min"), F.max(length).alias("max"), (F.sum(F.col(length) * F.col("__n")) / F.sum("__n")).alias("mean"), at(F.floor(F.col("__a") / 2)).alias("p50"), at(F.floor((F.col("__a") - 1) * F.lit(0.95))).alias("p95")]
    return (upto.groupBy(*keys) if keys else upto.groupBy()).agg(*agg)


def length_histogram(rows: DataFrame, length: str, width: int = 256) -> DataFrame:
    return rows.groupBy((F.floor(F.col(length) / width) * width).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def distributions(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of each value of each column, in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return rows.select(F.explode(pairs).alias("x")).groupBy("x.column", "x.value").agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.agg(*[F.count_distinct(c).alias(f"n_{c}") for c in columns])


def percentiles(rows: DataFrame, value: str, shares: dict[str, float], *keys: str) -> DataFrame:
    """keys and linear percentiles (name: share) of a value; nulls don't count.

    The values are ranked over many tasks, and of each group only the two beside a share come together.
    """
    known = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v")).withColumn("__g", F.struct(*keys) if keys else F.struct(F.lit(0)))
    placed = stored(ranked(known.select("__g", "__v"), ["__g"], ["__v"], "__at"), "ranks")
    # One row per group.
    sizes = placed.groupBy("__g").agg(F.count(F.lit(1)).alias("__n")).withColumnRenamed("__g", "__h")
    each = placed.join(stored(sizes, "sizes"), F.col("__g").eqNullSafe(F.col("__h")))
    out = []
    for name, share in shares.items():
        place = (F.col("__n") - 1) * F.lit(share)
        low, part = F.floor(place), place - F.floor(place)
        weight = F.when(F.col("__at") == low, 1 - part).when(F.col("__at") == low + 1, part)
        out.append(F.sum(F.when(weight > 0, F.col("__v") * weight)).alias(name))
    wanted = reduce(lambda a, b: a | b, [F.col("__at").between(F.floor((F.col("__n") - 1) * F.lit(s)), F.floor((F.col("__n") - 1) * F.lit(s)) + 1) for s in shares.values()])
    found = each.where(wanted).groupBy("__g").agg(*out)
    return found.select(*[F.col("__g")[k].alias(k) for k in keys], *shares)


def latency(rows: DataFrame, seconds: str, *keys: str) -> DataFrame:
    """p50 and p95 (linear), milliseconds a row, rows a second."""
    of = percentiles(rows, seconds, {"p50": 0.5, "p95": 0.95}, *keys).withColumn("__k", F.struct(*keys) if keys else F.struct(F.lit(0))).drop(*keys)
    means = (rows.groupBy(*keys) if keys else rows.groupBy()).agg((F.avg(seconds) * 1000).alias("ms_per_row"), F.try_divide(F.count(seconds).cast("double"), F.sum(seconds)).alias("rows_per_second"))
    joined = means.withColumn("__j", F.struct(*keys) if keys else F.struct(F.lit(0))).join(of, F.col("__j").eqNullSafe(F.col("__k")), "left")
    return joined.select(*keys, "p50", "p95", "ms_per_row", "rows_per_second")


def class_coverage(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, option_id, displayed (rows that show the option), target_mass, n_argmax (rows it has the largest target in, ties included): rows have option_ids and target.

    Targets that don't fit the options count as displayed only.
    """
    usable = F.col("target").isNotNull() & (F.size("target") == F.size("option_ids")) & F.forall("target", lambda p: p.isNotNull() & p.between(0.0, 1.0))
    each = rows.select(*keys, F.array_max("target").alias("__m"), usable.alias("__u"), "target", F.posexplode("option_ids").alias("__i", "option_id"))
    p = F.when(F.col("__u"), F.get("target", F.col("__i")))
    return each.groupBy(*keys, "option_id").agg(F.count(F.lit(1)).alias("displayed"), F.coalesce(F.sum(p), F.lit(0.0)).alias("target_mass"), F.count_if(p == F.col("__m")).alias("n_argmax"))


def padding(rows: DataFrame, batch: str, length: str) -> DataFrame:
    """Tokens and padded tokens of batches, and the share that is padding."""
    b = rows.groupBy(batch).agg(F.count(F.lit(1)).alias("n"), F.max(length).alias("m"), F.sum(length).alias("t"))
    return b.agg(F.count(F.lit(1)).alias("batches"), F.sum("t").alias("tokens"), F.sum(F.col("n") * F.col("m")).alias("padded"), (F.lit(1.0) - F.sum("t") / F.sum(F.col("n") * F.col("m"))).alias("pad_ratio"))


def suite_coverage(rows: DataFrame) -> DataFrame:
    """Per suite and type: decisions, groups, option counts and gold classes seen."""
    return rows.groupBy("suite", "qtype").agg(F.count(F.lit(1)).alias("decisions"), F.count_distinct("group_id").alias("groups"), F.array_sort(F.collect_set(F.size("probs"))).alias("option_counts"), F.count_distinct("gold_idx").alias("gold_classes"))


def decision_counts(rows: DataFrame, suite: str, decision: str, names: list[str]) -> DataFrame:
    """Per suite, how many rows have each decision; zeros are written, too."""
    return rows.groupBy(suite).agg(*[F.count_if(F.col(decision) == n).alias(n) for n in names])


def rejection_tally(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.where(F.col("reason").isNotNull()).groupBy(*keys, "reason").agg(F.count(F.lit(1)).alias("n"))


def ordered_checksum(rows: DataFrame, group: str, order: str, line: str) -> DataFrame:
    """SHA-256 of a group's lines in order, each ended by a line break.

    A group's lines come together in one row: for manifests of counted, small groups.
    """
    lines = F.transform(F.array_sort(F.collect_list(F.struct(order, line))), lambda x: F.concat(x[line], F.lit("\n")))
    return rows.groupBy(group).agg(F.sha2(F.array_join(lines, ""), 256).alias("sha256"), F.count(F.lit(1)).alias("n"))


def check_ledger(rows: DataFrame, checks: str = "checks") -> DataFrame:
    """Per check of an array of (check, ok): how many rows passed and failed it."""
    each = rows.select(F.explode(checks).alias("c"))
    return each.groupBy("c.check").agg(F.count(F.lit(1)).alias("checked"), F.count_if("c.ok").alias("passed"), F.count_if(~F.col("c.ok")).alias("failed"))


def flag_summary(rows: DataFrame, case: str, flags: list[str]) -> DataFrame:
    """Per flag: decisions and distinct cases."""
    sums = [x for f in flags for x in (F.count_if(f).alias(f"{f}_decisions"), F.count_distinct(F.when(F.col(f), F.col(case))).alias(f"{f}_cases"))]
    return rows.agg(*sums)


