"""Are two runs over the same structured values the same?  Nested JSON as rows of (key, path, kind, value), compared null-safely.

Values are exact: 1 isn't 1.0, "1" isn't 1, the order of an object's keys counts, white space between tokens doesn't.  Both sides' values are taken apart together,
level by level inside the JVM: a pair of containers is parsed once and gives the pairs of entries that differ, so nothing is joined by path and what agrees is left
out with all that it holds.  Each level is a written table.  Strings are marked in the text before anything is parsed, which tells them from numbers at any depth.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import stored

KINDS = ("object", "array", "string", "boolean", "null", "int", "float", "invalid")
#: A string of JSON, keys too; possessive and with or without its end, so that a text is gone through once and long strings need no stack.
STRING = r'"([^"\\]*+(?:\\.[^"\\]*+)*+"?+)'
#: First characters of coded values that aren't JSON as it stands.
IS_STRING, IS_NULL, IS_INVALID = "s", "n", "i"


def coded(rows: DataFrame, *fields: str) -> DataFrame:
    """JSON texts in `fields` as the walk has them: every string and key begins with s, a null is n, and what isn't JSON, or has a key twice, is i and the text."""
    for f in fields:
        rows = rows.withColumn("__v", F.try_parse_json(f)).withColumn("__m", F.trim(F.regexp_replace(f, STRING, f'"{IS_STRING}$1'), F.lit(" \t\r\n")))
        code = (
            F.when(F.col(f).isNull(), None).when(F.col("__v").isNull(), F.concat(F.lit(IS_INVALID), F.col(f)))
            .when(F.col("__m").startswith('"'), F.concat(F.lit(IS_STRING), F.col("__v").cast("string"))).when(F.col("__m").startswith("n"), IS_NULL).otherwise(F.col("__m"))
        )
        rows = rows.withColumn(f, code).drop("__v", "__m")
    return rows


def bare(name: Column) -> Column:
    return F.substr(name, F.lit(2))


def kind_of(code: Column) -> Column:
    first = F.left(code, F.lit(1))
    return (
        F.when(code.isNull(), None).when(first == "{", "object").when(first == "[", "array").when(first == IS_STRING, "string").when(first == IS_NULL, "null")
        .when(first.isin("t", "f"), "boolean").when(first == IS_INVALID, "invalid").when(code.rlike(r"^-?\d+$"), "int").otherwise("float")
    )


def step(name: Column) -> Column:
    """A key in a path: plain, or quoted where it isn't a word."""
    return F.when(name.rlike(r"^\w+$"), F.concat(F.lit("."), name)).otherwise(F.concat(F.lit('."'), F.replace(F.replace(name, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))


def shown(kind: Column, code: Column, named: Column, placed: Column) -> Column:
    """What is compared: keys in order, the number of elements, or the scalar; floats by their value."""
    keys = F.to_json(F.transform(F.map_keys(named), bare))
    plain = F.when(kind == "float", code.cast("double").cast("string")).when(kind.isin("string", "invalid"), bare(code)).otherwise(code)
    return F.when(kind == "object", keys).when(kind == "array", F.size(placed).cast("string")).when(kind == "null", F.lit(None)).otherwise(plain)


def nodes(pairs: DataFrame, key: str, below: bool) -> DataFrame:
    """One row per pair of codes a and b (null: absent): key, path, problem, kind (of a), ours, theirs, and `inside`, the entries that differ.

    Unless `below`, a pair with a problem isn't looked into.
    """
    some = lambda v: F.coalesce(v, F.lit(IS_NULL))
    no_map, no_array = F.create_map().cast("map<string,string>"), F.array().cast("array<string>")
    for c in ("a", "b"):
        named = F.transform_values(F.from_json(F.when(F.col(c).startswith("{"), F.col(c)), "map<string,string>"), lambda _, v: some(v))
        placed = F.transform(F.from_json(F.when(F.col(c).startswith("["), F.col(c)), "array<string>"), some)
        pairs = pairs.withColumns({f"o{c}": F.coalesce(named, no_map), f"p{c}": F.coalesce(placed, no_array), f"k{c}": kind_of(F.col(c))})
    pairs = pairs.withColumns({f"v{c}": shown(F.col(f"k{c}"), F.col(c), F.col(f"o{c}"), F.col(f"p{c}")) for c in ("a", "b")})
    problem = (
        F.when(F.col("ka").isNull(), "missing").when(F.col("kb").isNull(), "extra").when(F.col("ka") != F.col("kb"), "kind_differs")
        .when(F.col("va").eqNullSafe(F.col("vb")), None).when(F.col("ka") == "object", "keys_differ").when(F.col("ka") == "array", "size_differs").otherwise("value_differs")
    )
    unlike = lambda e: ~e["a"].eqNullSafe(e["b"])
    entry = lambda at, a, b: F.struct(at.alias("step"), a.alias("a"), b.alias("b"))
    by_key = F.map_filter(F.map_zip_with("oa", "ob", lambda _, a, b: F.struct(a.alias("a"), b.alias("b"))), lambda _, e: unlike(e))
    by_key = F.transform(F.map_entries(by_key), lambda e: entry(step(bare(e["key"])), e["value"]["a"], e["value"]["b"]))
    by_place = F.filter(F.transform(F.arrays_zip("pa", "pb"), lambda e, i: F.struct(i.alias("i"), e["pa"].alias("a"), e["pb"].alias("b"))), unlike)
    by_place = F.transform(by_place, lambda e: entry(F.concat(F.lit("["), e["i"].cast("string"), F.lit("]")), e["a"], e["b"]))
    pairs = pairs.withColumn("problem", problem)
    inside = F.concat(by_key, by_place) if below else F.when(F.col("problem").isNull(), F.concat(by_key, by_place))
    return pairs.select(key, "path", "problem", F.col("ka").alias("kind"), F.col("va").alias("ours"), F.col("vb").alias("theirs"), inside.alias("inside"))


def walked(pairs: DataFrame, key: str, below: bool = True) -> DataFrame:
    """`nodes` of unlike pairs of JSON texts a and b and of all that differs inside them; depth is bounded only by the data."""
    level = coded(pairs.select(key, "a", "b"), "a", "b").withColumn("path", F.lit("$"))
    found = []
    while True:
        done = stored(nodes(level, key, below), "level")
        found.append(done.drop("inside"))
        inside = done.where(F.size("inside") > 0)
        if inside.isEmpty():
            return reduce(DataFrame.unionByName, found)
        level = inside.select(key, "path", F.explode("inside").alias("e")).select(key, F.concat("path", "e.step").alias("path"), "e.a", "e.b")


def leaves(rows: DataFrame, key: str, field: str) -> DataFrame:
    """key, path, kind, value of every node of the JSON in `field`, the root's path being $.

    An SQL null has no nodes; a text that isn't JSON, or has a key twice, is one node of the kind invalid.
    """
    alone = rows.where(F.col(field).isNotNull()).select(F.col(key).alias("__k"), F.col(field).alias("a"), F.lit(None).cast("string").alias("b"))
    return walked(alone, "__k").select(F.col("__k").alias(key), "path", "kind", F.col("ours").alias("value"))


def differences(ours: DataFrame, theirs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field, path, problem, ours, theirs: where the JSON texts in `fields` of the two sides' shared keys differ.

    Problems are missing (only theirs has the path), extra (only ours), kind_differs, keys_differ (an object's keys, or their order), size_differs (an
    array's) and value_differs.  Keys are unique and not null on both sides.  A null text differs from a JSON null at the root.
    """
    both = ours.select(key, *[F.col(f).alias(f"a_{f}") for f in fields]).join(theirs.select(key, *[F.col(f).alias(f"b_{f}") for f in fields]), key)
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").alias("a"), F.col(f"b_{f}").alias("b")) for f in fields])
    unlike = both.select(key, F.explode(each).alias("x")).where("NOT x.a <=> x.b").select(F.struct(key, "x.field").alias("__k"), "x.a", "x.b")
    return walked(stored(unlike, "unlike"), "__k").where("problem IS NOT NULL").select("__k.*", "path", "problem", "ours", "theirs")


def reconciled(retained: DataFrame, original: DataFrame, run: DataFrame, key: str, checks: list[tuple[str, str, list[str]]]) -> DataFrame:
    """key and `reason` (null: the old prediction may be reused) of every retained row and every row of the run that is none of the original's.

    The first reason that holds: unknown_id (the original lacks it), missing_prediction (the run lacks it), then the `checks` in order, triples of
    a reason, the side it compares the original with ('retained' or 'run') and the fields, all JSON texts; last, foreign_prediction for
    a prediction of an id that the original lacks.
    """
    sides = {"retained": retained, "run": run}
    wanted = {side: sorted({f for _, s, fields in checks if s == side for f in fields}) for side in sides}
    texts = lambda side, fields, to: sides[side].select(key, F.lit(True).alias(f"__{side}"), *[F.col(f).alias(f"{to}_{f}") for f in fields])
    known = original.select(key, F.lit(True).alias("__original"), *[F.col(f).alias(f"o_{f}") for f in sorted({*wanted["retained"], *wanted["run"]})])
    both = texts("retained", wanted["retained"], "retained").join(known, key, "left").join(texts("run", wanted["run"], "run"), key, "left")
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"{side}_{f}").alias("a"), F.col(f"o_{f}").alias("b")) for i, (_, side, fields) in enumerate(checks) for f in fields])
    unlike = F.when(F.col("__original") & F.col("__run"), F.filter(each, lambda x: ~x["a"].eqNullSafe(x["b"])))
    met = stored(both.select(key, "__original", "__run", unlike.alias("unlike")), "met")
    hits = walked(met.select(key, F.explode("unlike").alias("x")).select(F.struct(key, "x.i").alias("__k"), "x.a", "x.b"), "__k", below=False)
    first = hits.where("problem IS NOT NULL").groupBy(F.col(f"__k.{key}").alias(key)).agg(F.min("__k.i").alias("i"))
    reason = reduce(lambda acc, c: acc.when(F.col("i") == c[0], c[1][0]), enumerate(checks), F.when(F.col("__original").isNull(), "unknown_id").when(F.col("__run").isNull(), "missing_prediction"))
    ours = met.select(key, "__original", "__run").join(first, key, "left").select(key, reason.alias("reason"))
    # Distinct keys alone: what was only joined to the original's rows isn't computed for them.
    foreign = run.select(key).join(original.select(key).distinct(), key, "left_anti").join(met.select(key), key, "left_anti").select(key, F.lit("foreign_prediction").alias("reason"))
    return ours.unionByName(foreign)
