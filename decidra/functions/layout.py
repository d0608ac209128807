"""Token layouts of one question: head, options with a marker each, state, within budgets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let

#: Tokens of an option at most, of the head at least, and the room that options must leave it.
OPTION_TOKENS, HEAD_LEAST, HEAD_ROOM, OPTION_LEAST = 48, 8, 16, 4


def budgeted(head: Column, options: Column, head_max: int) -> Column:
    """A struct of head and options cut to `head_max` tokens in all (options count a marker).

    Options that leave the head less than HEAD_ROOM are cut evenly.
    """
    size = lambda o: F.aggregate(o, F.lit(0), lambda a, x: a + F.size(x) + 1)
    short = F.transform(options, lambda o: F.slice(o, 1, OPTION_TOKENS))
    each = F.greatest(F.lit(OPTION_LEAST), F.floor((F.lit(head_max) - HEAD_ROOM) / F.greatest(F.size(options), F.lit(1))).cast("int"))
    fit = let(short, lambda s: F.when(F.lit(head_max) - size(s) < HEAD_ROOM, F.transform(s, lambda o: F.slice(o, 1, each - 1))).otherwise(s))
    return let(fit, lambda o: F.struct(F.slice(head, 1, F.greatest(F.lit(HEAD_LEAST), F.lit(head_max) - size(o))).alias("head"), o.alias("options")))


def laid_out(head: Column, options: Column, state: Column, cls: int, sep: int, mask: int, max_len: int = 512, head_max: int = 192) -> Column:
    """[cls] head [sep] ([mask] option)* [sep] state [sep], cut to `max_len`.

    A struct: ids, markers (places of the masks), and what was truncated.
    """
    one = lambda x: F.array(F.lit(x))

    def build(b: Column) -> Column:
        marked = F.flatten(F.transform(b["options"], lambda o: F.concat(one(mask), o)))
        front = F.concat(one(cls), b["head"], one(sep), marked, one(sep))
        sizes = F.transform(b["options"], lambda o: F.size(o) + 1)
        markers = F.transform(sizes, lambda n, i: F.size(b["head"]) + 2 + F.aggregate(F.slice(sizes, 1, i), F.lit(0), lambda a, x: a + x))
        return F.struct(front.alias("front"), markers.alias("markers"), b["head"].alias("head"), b["options"].alias("options"))

    def finish(f: Column) -> Column:
        room = F.greatest(F.lit(0), F.lit(max_len - 1) - F.size(f["front"]))
        ids = F.slice(F.concat(f["front"], F.slice(state, 1, room), one(sep)), 1, max_len)
        return F.struct(
            ids.alias("ids"), F.filter(f["markers"], lambda m: m < max_len).alias("markers"),
            (F.size(f["head"]) < F.size(head)).alias("head_truncated"),
            F.exists(F.zip_with(f["options"], options, lambda x, y: F.size(x) < F.size(y)), lambda x: x).alias("option_truncated"),
            (F.size(state) > room).alias("state_truncated"),
            (F.size(f["options"]) - F.size(F.array_distinct(f["options"]))).alias("option_collisions"),
        )

    return let(let(budgeted(head, options, head_max), build), finish)
