"""Small array helpers the other function modules share (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    """Sum of an array of doubles; 0 if it's empty."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def first_argmax(values: Column) -> Column:
    """Place of the first largest element, from 0; null for null or empty arrays."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once, also where `body` uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def apart(value: Column) -> Column:
    """`value`, in a projection that isn't fused with others: its code is then split into methods that the JVM compiles (it leaves those of more than 8000 bytes uncompiled)."""
    return let(value, lambda x: x)


def running(values: Column) -> Column:
    """Prefix sums, in one pass over the array."""
    step = lambda a, x: F.struct((a["s"] + x).alias("s"), F.array_append(a["out"], a["s"] + x).alias("out"))
    start = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("out"))
    return F.aggregate(values, start, step, lambda a: a["out"])


def one_hot(index: Column, size: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.when(i == index, 1.0).otherwise(0.0))
