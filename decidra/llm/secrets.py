"""Secret scan with corpus-wide ownership frequency (native: DataFrame functions only).

Three kinds of candidate are found in every whole text.  Each candidate's value is hashed
and the hashes are aggregated over the corpus by distinct repositories and owners.  A value
that many owners hold is a widely copied example; one that stays with few owners looks live.
The same frequency decides on opaque tokens (long runs with digits and both letter cases):
those that few owners hold are added as spans of the kind `opaque`.

Repositories are the values of `repo_cols`, owners those of `owner_cols`.

Defined cases: a null text is empty and has no span; null repositories or owners count as
one more repository or owner; a null doc_id stays a row of its own; repeated rows stay
repeated; spans of equal start are ordered by kind as listed; an empty table gives an empty
result; only the named columns are read, so extra columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize, running

# The kinds in their order and their patterns; the second group of `assign`
# has 6 characters or more, `access` 20 or more, `hex` 24 or more.
KINDS = ("assign", "access", "hex", "opaque")
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LONG_HEX = r"[0-9a-f]{24,}"
OPAQUE = r"[A-Za-z0-9+/_-]{24,}"
#: A value that more owners than this hold is a copied example.
MAX_OWNERS = 2


def located(text: Column, pattern: str, group: int, kind: int, passes) -> Column:
    """Matches of a pattern, leftmost and non-overlapping, as structs start, kind, end, value.

    Spark's regular expressions tell what matched but not where; the pieces between the
    matches do: a match starts behind all pieces and matches before it.
    """
    found = F.struct(
        F.split(text, pattern, -1).alias("gaps"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("values"),
    )

    def place(f: Column) -> Column:
        steps = F.transform(F.sequence(F.lit(0), F.size(f["hits"]) - 1), lambda i: F.length(f["gaps"][i]) + F.length(f["hits"][i]))
        starts = F.transform(running(steps, lambda x, y: x + y), lambda end, i: end - F.length(f["hits"][i]))
        rows = let(starts, lambda st: F.transform(st, lambda at, i: F.struct(
            at.alias("start"), F.lit(kind).alias("kind"), (at + F.length(f["hits"][i])).alias("end"), f["values"][i].alias("value"))))
        return F.filter(rows, lambda r: passes(r))

    return F.when(text.rlike(pattern), let(found, place)).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>"))


def candidates(text: Column) -> Column:
    """All spans of a text that are base spans or may become opaque ones, sorted."""
    size = lambda r: F.length(r["value"])
    base = F.concat(
        located(text, ASSIGN, 2, 0, lambda r: size(r) >= 6),
        located(text, ACCESS, 0, 1, lambda r: size(r) >= 20),
        # Runs of 24 and more characters are whole runs of the shorter pattern too.
        located(text, LONG_HEX, 0, 2, lambda r: size(r) >= 24),
    )
    more = located(text, OPAQUE, 0, 3, lambda r: r["value"].rlike("[0-9]") & r["value"].rlike("[a-z]") & r["value"].rlike("[A-Z]"))

    def joined(found: Column) -> Column:
        """Opaque spans stay where no base span overlaps: those before have ended, the next one begins later."""
        ends = running(F.transform(found, lambda r: F.when(r["kind"] < 3, r["end"]).otherwise(0)), F.greatest)
        begins = F.reverse(running(F.reverse(F.transform(found, lambda r: F.when(r["kind"] < 3, r["start"]).otherwise(1 << 30))), F.least))
        return let(ends, lambda e: let(begins, lambda n: F.filter(found, lambda r, i: (r["kind"] < 3) | ((e[i] <= r["start"]) & (n[i] >= r["end"])))))

    def merged(x: Column) -> Column:
        return F.when(F.size(x["more"]) == 0, F.sort_array(x["base"])).otherwise(let(F.sort_array(F.concat(x["base"], x["more"])), joined))

    return let(F.struct(base.alias("base"), more.alias("more")), merged)


def written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda r: F.concat_ws(":", names[r["kind"]], r["start"].cast("string"), r["end"].cast("string"))), ",")


def scan(docs: DataFrame, owner_cols=("source",), repo_cols=("source", "lang")) -> DataFrame:
    """One row per row of `docs`: doc_id, `spans` (array of start, kind, end, value), and per
    span in `owners` and `repos` how many distinct owners and repositories hold its value.
    Opaque spans that more than MAX_OWNERS owners hold are left out.
    """
    name = lambda cols: F.to_json(F.struct(*[F.col(c).cast("string") for c in cols]), {"ignoreNullFields": "false"})
    found = docs.select("doc_id", candidates(F.coalesce(F.col("text"), F.lit(""))).alias("__spans"), F.xxhash64(name(owner_cols)).alias("__owner"), F.xxhash64(name(repo_cols)).alias("__repo"))
    found = materialize(found, "secrets")
    with_any = found.where(F.size("__spans") > 0)
    key = F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.to_json("__spans")), 256)
    with_any = with_any.withColumn("__key", key)
    each = with_any.select(F.explode("__spans").alias("s"), "__owner", "__repo").select(F.sha2("s.value", 256).alias("__hash"), "__owner", "__repo")
    held = each.groupBy("__hash", "__owner", "__repo").agg(F.lit(1).alias("x")).groupBy("__hash", "__owner").agg(F.count("x").alias("r"))
    held = held.groupBy("__hash").agg(F.count(F.lit(1)).alias("__owners"), F.sum("r").alias("__repos"))
    # A written table, so that both sides of the join are shuffled alike and a hot hash can be split.
    held = materialize(held, "held")
    one = with_any.groupBy("__key").agg(F.first("__spans").alias("__spans"))
    one = one.select("__key", F.explode("__spans").alias("s")).withColumn("__hash", F.sha2("s.value", 256))
    known = one.join(held, "__hash").where((F.col("s.kind") < 3) | (F.col("__owners") <= MAX_OWNERS))
    back = known.groupBy("__key").agg(F.sort_array(F.collect_list(F.struct("s.start", "s.kind", "s.end", "s.value", F.col("__owners").alias("owners"), F.col("__repos").alias("repos")))).alias("spans"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string,owners:bigint,repos:bigint>>")
    hit = with_any.join(back, "__key", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))
    return hit.unionByName(found.where(F.size("__spans") == 0).select("doc_id", none.alias("spans")))


def op3(spark, sf_dir: str) -> DataFrame:
    rows = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("spans", lambda r: r["kind"] == k)).cast("long")
    base = F.filter("spans", lambda r: r["kind"] < 3)
    return rows.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda r: r["owners"] <= MAX_OWNERS)).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda r: r["owners"] > MAX_OWNERS)).cast("long").alias("n_copied"),
    )


def _found(kind: int, pattern: str, group: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
  SELECT r, {kind} AS kind, h, v, list_sum(list_transform(gaps[1:i], lambda x: length(x)))::BIGINT
         + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0)::BIGINT AS start
  FROM (SELECT r, gaps, hits, unnest(range(1, len(hits) + 1)) AS i, unnest(hits) AS h, unnest(vals) AS v
        FROM (SELECT r, string_split_regex(t, '{quoted}') AS gaps, regexp_extract_all(t, '{quoted}', 0) AS hits,
                     regexp_extract_all(t, '{quoted}', {group}) AS vals FROM d))
  WHERE length(v) >= {least}"""


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, source, lang FROM documents),
b AS ({_found(0, ASSIGN, 2, 6)} UNION ALL {_found(1, ACCESS, 0, 20)} UNION ALL {_found(2, LONG_HEX, 0, 24)}),
o AS ({_found(3, OPAQUE, 0, 24)} AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')),
n AS (SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.r = o.r AND b.start < o.start + length(o.h) AND o.start < b.start + length(b.h))),
a AS (SELECT * FROM b UNION ALL SELECT * FROM n),
f AS (SELECT v, count(DISTINCT coalesce(source, '')) AS owners FROM a JOIN d USING (r) GROUP BY v),
s AS (
  SELECT r, kind, start, owners, v,
         CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'opaque' END || ':' || start || ':' || (start + length(h)) AS w
  FROM a JOIN f USING (v) WHERE kind < 3 OR owners <= {MAX_OWNERS}
), g AS (
  SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg(w, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(w, ',' ORDER BY start, kind) AS spans,
         count(*) FILTER (owners <= {MAX_OWNERS}) AS n_live, count(*) FILTER (owners > {MAX_OWNERS}) AS n_copied
  FROM s GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_copied, 0)::BIGINT AS n_copied
FROM d LEFT JOIN g USING (r)
"""
