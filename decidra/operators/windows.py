"""Window-like operators: prefixes, case and batch numbers, folds over ordered events."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored


def ranked(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """Adds `name`: the row's place from 0 among those of its `by`, in `order`.

    Rows are range-partitioned by both, so a hot `by` is dealt over many tasks; what earlier tasks hold of a `by` is then added.  Rows equal in both come in any order.
    """
    ranged = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    placed = stored(ranged.select("*", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().alias("__m")), "ranked")
    parts = placed.groupBy(*by, "__p").agg(F.count(F.lit(1)).alias("__rows"), F.min("__m").alias("__least"))
    before = F.coalesce(F.sum("__rows").over(Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = stored(parts.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__p").alias("__q"), "__least", before.alias("__before")), "starts")
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by], F.col("__p") == F.col("__q"))
    return placed.join(starts, on).select(*rows.columns, (F.col("__m") - F.col("__least") + F.col("__before")).alias(name))


def suite_prefix(rows: DataFrame, suite: str, order: list, n: int) -> DataFrame:
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(suite).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def canonical_first(rows: DataFrame, key: str, order: str, name: str = "canonical") -> DataFrame:
    """Adds the lowest `order` of each key.  Keys, which may be long texts, meet as digests, after they were aggregated."""
    marked = stored(rows.withColumn("__d", F.sha2(F.col(key).cast("string"), 256)), "keyed")
    first = stored(marked.groupBy("__d").agg(F.min(order).alias(name)).withColumnRenamed("__d", "__e"), "firsts")
    return marked.join(first, F.col("__d").eqNullSafe(F.col("__e"))).select(*rows.columns, name)


def case_index(rows: DataFrame, by: str, order: list, state: str, name: str = "case_idx") -> DataFrame:
    """Adds a number that grows whenever the state differs from the row before, from 0."""
    w = Window.partitionBy(by).orderBy(*order)
    before = F.lag(state).over(w)
    changed = (F.row_number().over(w) > 1) & ~F.col(state).eqNullSafe(before)
    return rows.withColumn("__c", changed.cast("int")).withColumn(name, F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__c")


def dialogue_prefix(turns: DataFrame, conversation: str, turn: str, text: Column, name: str = "prefix", sep: str = "\n") -> DataFrame:
    """Adds all of a dialogue up to and with the current turn."""
    w = Window.partitionBy(conversation).orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
    said = F.collect_list(F.struct(F.col(turn).alias("t"), text.alias("x"))).over(w)
    return turns.withColumn(name, F.array_join(F.transform(said, lambda s: s["x"]), sep))


def batch_windows(rows: DataFrame, suite: str, order: list, size: int, name: str = "batch") -> DataFrame:
    """Adds `name`: the number of the window of `size` rows that a row is in, from 0 in each suite."""
    return ranked(rows, [suite], order, "__at").withColumn(name, F.floor(F.col("__at") / size).cast("long")).drop("__at")


def batch_runs(counts: list[tuple[str, int, int]], max_tokens: int, max_rows: int) -> list[tuple[str, int, int, int, int, int]]:
    """(suite, length, low, high, batch, each): of a length's rows those of rank low .. high - 1
    fill batches from `batch` on with `each` rows apiece.

    Rows come by rising length; a batch is closed before a row that would make longest * rows
    exceed max_tokens, or rows exceed max_rows.  A row too long for any batch has its own.
    """
    out, now, batch, n = [], None, 0, 0
    for suite, length, count in sorted(counts):
        if suite != now:
            now, batch, n = suite, 0, 0
        fits = max(1, min(max_rows, max_tokens // max(length, 1)))
        low = 0
        if n:
            more = min(count, max(0, fits - n))
            if more:
                out.append((suite, length, 0, more, batch, more))
                low, n = more, n + more
            if low < count:
                batch, n = batch + 1, 0
        if low < count:
            out.append((suite, length, low, count, batch, fits))
            whole, rest = divmod(count - low, fits)
            batch, n = (batch + whole, rest) if rest else (batch + whole - 1, fits)
    return out


def token_batches(rows: DataFrame, suite: str, key: str, length: str, max_tokens: int, max_rows: int) -> DataFrame:
    """Adds `batch`: the batches of a greedy pass over each suite's rows by (length, key).

    The pass runs over the counts of each length, in one task a suite; a suite has as many counts as lengths, whatever its rows.  The
    rows then only need their rank in their length.
    """
    counts = rows.groupBy(F.col(suite).alias("s"), F.col(length).cast("long").alias("l")).agg(F.count(F.lit(1)).alias("n"))

    def runs(frame: pd.DataFrame) -> pd.DataFrame:
        found = batch_runs(list(zip([""] * len(frame), frame["l"], frame["n"], strict=True)), max_tokens, max_rows)
        out = pd.DataFrame([r[1:] for r in found], columns=["__l", "__low", "__high", "__b", "__each"])
        out.insert(0, "__s", frame["s"].iloc[0])
        return out

    kind = rows.schema[suite].dataType.simpleString()
    plan = stored(counts.groupBy("s").applyInPandas(runs, f"__s {kind}, __l long, __low long, __high long, __b long, __each long"), "runs")
    on = F.col(suite).eqNullSafe(F.col("__s")) & (F.col(length) == F.col("__l")) & (F.col("__r") >= F.col("__low")) & (F.col("__r") < F.col("__high"))
    # At most two runs per suite and length.
    placed = stored(ranked(rows, [suite, length], [key], "__r"), "placed").join(plan, on)
    batch = F.col("__b") + F.floor((F.col("__r") - F.col("__low")) / F.col("__each"))
    return placed.select(*rows.columns, batch.cast("long").alias("batch"))


def td_targets(steps: DataFrame, episode: str, step: str, chance: str, outcome: str, decay: float = 1.0) -> DataFrame:
    """Adds `td_target`: going back from the episode's last outcome,
    G = (1 - decay) * chance of the next step + decay * G."""
    if decay == 1.0:
        last = F.last(outcome).over(Window.partitionBy(episode).orderBy(step).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        return steps.withColumn("td_target", last)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(step).alias("s"), F.col(chance).alias("p"), F.col(outcome).alias("y"))))
    episodes = steps.groupBy(episode).agg(F.reverse(ordered).alias("__e"))
    entry = lambda s, g: F.struct(s.alias("s"), g.alias("g"))

    def back(a: Column, e: Column) -> Column:
        g = F.when(F.size(a["out"]) == 0, e["y"]).otherwise((1 - decay) * a["p"] + decay * a["g"])
        return F.struct(e["p"].alias("p"), g.alias("g"), F.array_append(a["out"], entry(e["s"], g)).alias("out"))

    kind = dict(steps.dtypes)[step]
    start = F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("g"), F.array().cast(f"array<struct<s:{kind},g:double>>").alias("out"))
    back_rows = episodes.select(episode, F.explode(F.aggregate("__e", start, back, lambda a: a["out"])).alias("x"))
    return steps.join(back_rows.select(episode, F.col("x.s").alias(step), F.col("x.g").alias("td_target")), [episode, step])


def evidence_numbers(rows: DataFrame, order: list, prefix: str = "candidate/") -> DataFrame:
    """Adds `candidate_id`, prefix and an eight-digit number from 1 over all rows.

    The rows are range-partitioned by the order, counted per partition, and numbered inside.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(ranged.select("*", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().alias("__m")), "evidence")
    sizes = placed.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"), F.min("__m").alias("__least"))
    # One row per partition.
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("__p", "__least", before.alias("__before")))
    number = F.col("__m") - F.col("__least") + F.col("__before") + 1
    return placed.join(starts, "__p").withColumn("candidate_id", F.concat(F.lit(prefix), F.lpad(number.cast("string"), 8, "0"))).drop("__p", "__m", "__least", "__before")
