"""Joins and set operations with their completeness checks.

Checks return small tables of offenders (empty when all is well) rather than raise, so that
they stay part of the plan; `require_empty` turns one into an error.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import first_argmax
from ..functions.text import policy_key


def require_empty(offenders: DataFrame, message: str) -> None:
    """Raise ValueError with a few offenders if there are any."""
    found = offenders.limit(3).collect()
    if found:
        raise ValueError(f"{message}: {[r.asDict() for r in found]}")


def total_join(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(inner join, keys that only one side has, with the side)."""
    both = left.select(key, F.lit(1).alias("__a")).join(right.select(key, F.lit(1).alias("__b")), key, "full_outer")
    alone = both.where(F.col("__a").isNull() | F.col("__b").isNull()).select(key, F.when(F.col("__a").isNull(), "right").otherwise("left").alias("only_in"))
    return left.join(right, key), alone


def missing_foreign(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Keys that are expected but not found (missing) or found but not expected (foreign)."""
    missing = expected.join(found, key, "left_anti").select(key, F.lit("missing").alias("problem"))
    return missing.unionByName(found.join(expected, key, "left_anti").select(key, F.lit("foreign").alias("problem")))


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def in_manifest_order(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of a manifest (key, pos), with `pos` to order by."""
    return ids.join(rows, key).select(*rows.columns, "pos")


def replay_membership(rows: DataFrame, excluded: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows less the excluded ids, and less the members `group_id || suffix` of excluded groups."""
    members = groups.select(F.col("group_id"), F.explode("member_suffixes").alias("s")).select(F.concat("group_id", "s").alias("id"))
    gone = excluded.select("id").unionByName(members).distinct()
    return rows.join(gone.withColumn("excluded", F.lit(True)), "id", "left").withColumn("excluded", F.coalesce("excluded", F.lit(False)))


def raw_identity(namespace: Column, split: Column, record: Column) -> Column:
    """A struct to join raw ids by: bare decimal ids only within their split; null without one."""
    local = record.rlike("^[0-9]+$")
    scope = F.when(~local, "nonlocal_id").when(F.coalesce(split, F.lit("")) != "", F.lower(split))
    return F.when(record.isNotNull() & scope.isNotNull(), F.struct(namespace.alias("ns"), scope.alias("scope"), record.alias("id")))


def key_matches(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str) -> DataFrame:
    """Ids of rows with an equal key: raw identities, whole states or spans."""
    a = left.where(F.col(key).isNotNull()).select(key, left_id).distinct()
    b = right.where(F.col(key).isNotNull()).select(key, right_id).distinct()
    return a.join(b, key).select(left_id, right_id)


def earlier_pairs(rows: DataFrame, key: str, order: str, target: str) -> DataFrame:
    """Each row with the first row of its key: both orders, and whether their targets agree."""
    first = Window.partitionBy(key).orderBy(order)
    seen = rows.withColumn("__o", F.first(order).over(first)).withColumn("__t", F.first(target).over(first))
    return seen.where(F.col(order) > F.col("__o")).select(F.col(order).alias("later"), F.col("__o").alias("canonical"), (F.col(target).eqNullSafe(F.col("__t"))).alias("target_same"))


def all_earlier_pairs(rows: DataFrame, key: str, order: str, target: str) -> DataFrame:
    """Every (later, earlier) pair of a key with the key's first row, and whether their targets agree.

    The pairs are the result: a key of n rows has n * (n - 1) / 2.  `earlier_pairs` and
    `ambiguous_keys` tell as much in n rows.
    """
    one = rows.select(key, F.col(order).alias("__o"), F.col(target).alias("__t"))
    first = one.groupBy(key).agg(F.min("__o").alias("canonical"))
    a, b = one.alias("a"), one.alias("b")
    met = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.__o") > F.col("b.__o")))
    pairs = met.select(F.col(f"a.{key}").alias(key), F.col("a.__o").alias("later"), F.col("b.__o").alias("earlier"), F.col("a.__t").eqNullSafe(F.col("b.__t")).alias("target_same"))
    return pairs.join(first, key).select("later", "earlier", "canonical", "target_same")


def rederived(ours: DataFrame, source: DataFrame, key: str, label: str, derived: str) -> DataFrame:
    """Rows whose label isn't the one derived from their source, or that have none: key, label, derived, problem."""
    both = ours.select(key, label).join(source.select(key, derived, F.lit(True).alias("__s")), key, "left")
    problem = F.when(F.col("__s").isNull(), "no_source").when(~F.col(label).eqNullSafe(F.col(derived)), "label_differs")
    return both.select(key, label, derived, problem.alias("problem")).where(F.col("problem").isNotNull())


def without_groups(rows: DataFrame, earlier: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that share none of `keys` with an earlier row."""
    for key in keys:
        rows = rows.join(earlier.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    return rows


def exactly_one(left: DataFrame, right: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(left rows with their only match, left keys with none or several and how many).  Every left key is to match once."""
    n = right.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    counted = left.select(*key).join(n, key, "left").select(*key, F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    single = n.where("n = 1").drop("n")
    return left.join(single, key, "left_semi").join(right, key), counted.where("n <> 1").distinct()


def ambiguous_keys(rows: DataFrame, key: str, target: str) -> DataFrame:
    """Keys whose rows disagree on the target: key, rows and distinct targets."""
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.to_json(F.struct(target))).alias("n_targets"))
    return n.where("n_targets > 1")


def compare_predictions(ours: DataFrame, theirs: DataFrame, keys: list[str]) -> DataFrame:
    """One row: missing, extra, shape differences, max and mean difference, other argmaxes."""
    a = ours.select(*keys, F.col("probs").alias("__p"), F.lit(1).alias("__a"))
    b = theirs.select(*keys, F.col("probs").alias("__q"), F.lit(1).alias("__b"))
    both = a.join(b, keys, "full_outer")
    matched = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    shaped = matched & (F.size("__p") == F.size("__q"))
    gaps = F.when(shaped, F.zip_with("__p", "__q", lambda x, y: F.abs(x - y)))
    marked = both.select(F.col("__a").isNull().alias("m"), F.col("__b").isNull().alias("x"), (matched & ~shaped).alias("s"), shaped.alias("ok"), F.array_max(gaps).alias("max"), F.aggregate(gaps, F.lit(0.0), lambda acc, v: acc + v).alias("sum"), F.size(gaps).alias("n"), (shaped & (first_argmax(F.col("__p")) != first_argmax(F.col("__q")))).alias("flip"))
    n = lambda c: F.count_if(F.col(c))
    return marked.agg(n("m").alias("missing"), n("x").alias("extra"), n("s").alias("shape_differs"), n("ok").alias("compared"), F.max("max").alias("max_abs"), F.try_divide(F.sum("sum"), F.sum(F.when(F.col("ok"), F.col("n"))).cast("double")).alias("mean_abs"), n("flip").alias("argmax_differs"))


def reconcile(ours: DataFrame, theirs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per column, how many shared keys differ in it (nulls equal nulls)."""
    both = ours.alias("a").join(theirs.alias("b"), key)
    counts = both.agg(*[F.count_if(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))).alias(c) for c in columns])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_differ")) for c in columns])).alias("x")).select("x.*")


def leaks(rows: DataFrame, keys: list[str], split: str) -> DataFrame:
    """Per key column: how many of its values lie in more than one split."""
    found = [rows.groupBy(F.col(k).cast("string").alias("v")).agg(F.count_distinct(split).alias("n")).agg(F.count_if(F.col("n") > 1).alias("n_leaks"), F.count(F.lit(1)).alias("n_values")).select(F.lit(k).alias("key"), "n_leaks", "n_values") for k in keys]
    return reduce(DataFrame.unionByName, found)


def common_success(runs: DataFrame, models: int) -> DataFrame:
    """Ids that every model answered: the denominator of comparisons between models."""
    return runs.groupBy("id").agg(F.count_if("ok").alias("n")).where(F.col("n") == models).select("id")


def uncovered(allowed: DataFrame, seen: DataFrame) -> DataFrame:
    """Values that are allowed and never seen."""
    return allowed.distinct().exceptAll(seen.distinct())


def unknown_references(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't known, or is known more than once."""
    n = known.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    return rows.join(n, key, "left").where(F.coalesce("__n", F.lit(0)) != 1).withColumn("reason", F.when(F.col("__n").isNull(), "unknown").otherwise("ambiguous")).drop("__n")


def excluded_by_policy(text: Column, names: tuple[str, ...]) -> Column:
    """One of the names occurs in the text when both have letters and digits only."""
    squeezed = policy_key(text)
    return reduce(lambda a, b: a | b, [squeezed.contains(n) for n in names])


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many rows (with repetitions) only one of them has."""
    sides = a.exceptAll(b).select(F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(b.exceptAll(a).select(F.lit(0).alias("l"), F.lit(1).alias("r")))
    return sides.agg(F.coalesce(F.sum("l"), F.lit(0)).alias("only_left"), F.coalesce(F.sum("r"), F.lit(0)).alias("only_right"))


def with_hypotheses(documents: DataFrame, hypotheses: list[tuple[str, str]]) -> DataFrame:
    """Every document with every hypothesis (key, text) of a stated list."""
    each = F.array(*[F.struct(F.lit(k).alias("hypothesis"), F.lit(t).alias("hypothesis_text")) for k, t in hypotheses])
    return documents.select("*", F.explode(each).alias("__h")).select(*documents.columns, "__h.*")


def merge_reports(reports: list[dict], key: str = "model") -> list[dict]:
    """Reports of several runs by name; one name twice is an error."""
    seen: dict[str, dict] = {}
    for report in reports:
        if report[key] in seen:
            raise ValueError(f"{report[key]!r} is reported twice")
        seen[report[key]] = report
    return [seen[k] for k in sorted(seen)]
