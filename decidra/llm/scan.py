"""Running sums along keys of any size, by a range sort and numpy scans.

Rows are range-partitioned and sorted by key and order, so a hot key is dealt over many tasks.  Each task scans its rows
with `numpy.cumsum`, starting anew at each key.  Only a task's first key can have begun in earlier tasks, and in
each of them it is the last one: every task adds one row with its last key's total, and what these rows add up to is
added to the first key's rows of later tasks.  These totals are one or two rows a task, whatever the data.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialize


def running_sums(rows: DataFrame, key: str, order: list[Column], terms: Callable[[pa.RecordBatch], dict[str, np.ndarray]], names: list[str], table: str, salt: bool = False) -> DataFrame:
    """`rows` with a long column for each of `names`: the sum of a term over the key's rows up to this one.

    `key` is a long and not null.  `terms` maps a batch of `rows` to an int64 array for each name.  `salt` deals rows that are equal in
    key and order over several tasks; their order among each other is then arbitrary.
    """
    bounded_batches(rows.sparkSession)
    columns = rows.columns
    place = columns.index(key)

    def scanned(batches):
        task = TaskContext.get().partitionId()
        first = last = None
        carry = dict.fromkeys(names, 0)
        kinds = None

        def total(of, sums):
            cells = [pa.array([of], t) if i == place else pa.nulls(1, t) for i, t in enumerate(kinds)]
            return pa.RecordBatch.from_arrays([*cells, *[pa.array([sums[n]], pa.int64()) for n in names], pa.array([task], pa.int32()), pa.array([False]), pa.array([True])], names=[*columns, *names, "__task", "__edge", "__total"])

        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = kinds or [c.type for c in batch.columns]
            keys = batch.column(place).to_numpy(zero_copy_only=False)
            first = int(keys[0]) if first is None else first
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            segment = np.cumsum(np.concatenate([[0], (keys[1:] != keys[:-1]).astype(np.int64)]))
            sums, found = [], terms(batch)
            for n in names:
                along = np.cumsum(found[n])
                before = np.concatenate([[0], along])[starts]
                before[0] -= carry[n] if int(keys[0]) == last else 0
                sums.append(along - before[segment])
                carry[n] = int(sums[-1][-1])
            last = int(keys[-1])
            n_rows = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(s, pa.int64()) for s in sums], pa.array(np.full(n_rows, task, np.int32)), pa.array(keys == first), pa.array(np.zeros(n_rows, bool))], names=[*columns, *names, "__task", "__edge", "__total"])
        if last is not None:
            yield total(last, carry)
            if first != last:
                yield total(first, dict.fromkeys(names, 0))

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields] + [f"`{n}` long" for n in names] + ["__task int", "__edge boolean", "__total boolean"])
    dealt = rows.repartitionByRange(key, *order, *([F.monotonically_increasing_id()] if salt else [])).sortWithinPartitions(key, *order)
    written = materialize(dealt.mapInArrow(scanned, schema), table)
    earlier = Window.partitionBy(key).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written.where("__total").select("__task", F.lit(True).alias("__edge"), F.col(key).alias("__key"), *[F.coalesce(F.sum(n).over(earlier.partitionBy(key)), F.lit(0)).alias(f"__before_{n}") for n in names])
    # A task has one row for its first key; that of another last key is none of its edges'.
    offsets = offsets.where(" OR ".join(f"__before_{n} <> 0" for n in names))
    out = written.where("NOT __total").withColumn("__key", F.col(key)).join(F.broadcast(offsets), ["__task", "__edge", "__key"], "left")
    return out.select(*columns, *[(F.col(n) + F.coalesce(f"__before_{n}", F.lit(0))).alias(n) for n in names])
