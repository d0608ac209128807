"""Splits and samples.  Chance is a hash of a seed and a key: repeatable on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import ranked


def drawn(seed: str, *keys) -> Column:
    """A random-looking sort key that depends on the seed and the keys alone."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]), 256)


def numbered(rows: DataFrame, by: list, order: list, name: str = "rn") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def first_n(rows: DataFrame, by: list, order: list, n: int) -> DataFrame:
    return numbered(rows, by, order, "__rn").where(F.col("__rn") <= n).drop("__rn")


def grouped_split(rows: DataFrame, group: str, source: str, seed: str, strata: str | None = None) -> DataFrame:
    """Adds `split`; whole groups go to dev, test or train.

    Groups with the same set of sources (and of strata, where they count) form a bucket; of
    n groups the first h = floor(n / 12), one at least from three groups up, are dev, the next
    h test.
    """
    sets = [F.array_join(F.array_sort(F.collect_set(source)), ",").alias("__sig")]
    sets.append(F.array_join(F.array_sort(F.collect_set(strata)), ",").alias("__str") if strata else F.lit("").alias("__str"))
    groups = rows.groupBy(group).agg(*sets)
    bucket = Window.partitionBy("__sig", "__str")
    ranked = groups.withColumn("__i", F.row_number().over(bucket.orderBy(drawn(seed, group)))).withColumn("__n", F.count(F.lit(1)).over(bucket))
    held = F.when(F.col("__n") >= 3, F.greatest(F.lit(1), F.floor(F.col("__n") / 12))).otherwise(F.lit(0))
    split = F.when(F.col("__i") <= held, "dev").when(F.col("__i") <= 2 * held, "test").otherwise("train")
    return rows.join(ranked.select(group, split.alias("split")), group)


def proportional_split(groups: DataFrame, group: str, train: int, dev: int, seed: str) -> DataFrame:
    """Adds `split`: round(n * dev / (train + dev)) groups, half to even, are dev.

    The groups are ranked within hash buckets whose sizes are then summed, so no task ranks all.
    """
    key = drawn(seed, group)
    each = groups.select(group).distinct().withColumn("__k", key).withColumn("__b", F.left("__k", F.lit(3)))
    sizes = each.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    # At most 4096 buckets.
    before = sizes.select("__b", F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy()).alias("__all"))
    ranked = each.withColumn("__i", F.row_number().over(Window.partitionBy("__b").orderBy("__k", group))).join(F.broadcast(before), "__b")
    n = F.bround(F.col("__all") * F.lit(dev) / F.lit(train + dev))
    return groups.join(ranked.select(group, F.when(F.col("__before") + F.col("__i") <= n, "dev").otherwise("train").alias("split")), group)


def reservoir(rows: DataFrame, key: str, cap: int, seed: str) -> DataFrame:
    """`cap` rows of distinct keys, each equally likely."""
    once = rows.groupBy(key).agg(F.min(F.struct(*[c for c in rows.columns if c != key])).alias("__r"))
    return once.orderBy(drawn(seed, key), key).limit(cap).select(key, "__r.*").select(*rows.columns)


def one_per_group(rows: DataFrame, group: str, key: str, seed: str) -> DataFrame:
    return first_n(rows, [group], [drawn(seed, key), F.col(key)], 1)


def view_cap(rows: DataFrame, group: str, key: str, cap: int, seed: str) -> DataFrame:
    return first_n(rows, [group], [drawn(seed, key), F.col(key)], cap)


def round_robin(rows: DataFrame, stratum: str, group: str, record: str, key: str, quota: int, seed: str, views: int = 2) -> DataFrame:
    """Up to `quota` rows, dealt in turns over strata and, in a stratum, over groups; at most
    `views` rows of a record.  Adds `turn`."""
    capped = first_n(rows, [record], [drawn(seed, F.lit("view"), F.col(key)), F.col(key)], views)
    inner = numbered(capped, [stratum, group], [drawn(seed, key), F.col(key)], "__v")
    turns = numbered(inner, [stratum], [F.col("__v"), drawn(seed, group), F.col(group)], "turn")
    return turns.orderBy("turn", drawn(seed, stratum), stratum).limit(quota).drop("__v")


def interleaved(rows: DataFrame, stratum: str, order: list) -> DataFrame:
    """Adds `turn`: rows ordered by (turn, stratum) take one of each stratum at a time."""
    return numbered(rows, [stratum], order, "turn")


def quota_select(rows: DataFrame, bucket: list, order: list, quotas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows within their bucket's quota, buckets with found and missing rows)."""
    kept = numbered(rows, bucket, order, "__rn").join(quotas, bucket).where(F.col("__rn") <= F.col("quota"))
    found = kept.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n"))
    report = quotas.join(found, bucket, "left").select(*bucket, "quota", F.coalesce("n", F.lit(0)).alias("n")).withColumn("missing", F.col("quota") - F.col("n"))
    return kept.select(*rows.columns), report


def alternating(rows: DataFrame, by: list, order: list, members: list[str], name: str, offset: int = 0) -> DataFrame:
    """Adds `name`: the members in turn within each group."""
    at = F.pmod(F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1 + F.lit(offset), F.lit(len(members)))
    return rows.withColumn(name, F.array(*[F.lit(m) for m in members])[at])


def balanced(rows: DataFrame, key: str, values: list, name: str, seed: str) -> DataFrame:
    """Adds `name`: each of the values for as many rows as any other, one more at most; which rows get which is chance.

    The values are dealt by the rows' places in an order by hash, which many tasks count together.
    """
    placed = ranked(rows.withColumn("__all", F.lit(0)).withColumn("__draw", drawn(seed, key)), ["__all"], ["__draw", key], "__at")
    return placed.withColumn(name, F.array(*[F.lit(v) for v in values])[(F.col("__at") % len(values)).cast("int")]).select(*rows.columns, name)


def even_count(rows: DataFrame, order: str) -> DataFrame:
    """Rows without the last one if their number is odd."""
    last = rows.agg(F.count(F.lit(1)).alias("__n"), F.max(order).alias("__m"))
    # One row.
    return rows.join(F.broadcast(last), (F.col("__n") % 2 == 0) | (F.col(order) < F.col("__m"))).drop("__n", "__m")


def spread(groups: DataFrame, group: str, stratum: str, size: str, limit: int, seed: str) -> DataFrame:
    """Whole groups in turns over the strata while their sizes fit under `limit` in all.

    The first group of each stratum comes first, so each is covered while the limit allows it.
    """
    turns = numbered(groups, [stratum], [drawn(seed, group), F.col(group)], "__t")
    return turns.orderBy("__t", drawn(seed, stratum), stratum).limit(limit).withColumn("__sum", F.sum(size).over(Window.orderBy("__t", drawn(seed, stratum), stratum).rowsBetween(Window.unboundedPreceding, 0))).where(F.col("__sum") <= limit).drop("__t", "__sum")


def review_sample(rows: DataFrame, bucket: list[str], order: list, each: int = 3, most: int = 30) -> DataFrame:
    """The first `each` rows of every bucket, one of each bucket at a time, `most` in all."""
    ranked = numbered(rows, bucket, order, "__r").where(F.col("__r") <= each)
    return ranked.orderBy("__r", *bucket).limit(most).drop("__r")
