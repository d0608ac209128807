"""The overlap audit: which evaluation rows share content with what a model has seen.

Four kinds of evidence (raw ids, whole states, exact spans, near spans) are found by equi
joins, reviewed, and propagated over groups of related rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normal
from .components import components, propagated, star_edges
from .joins import key_matches
from .similarity import exact_pairs, near_pairs
from .spans import runs_of, with_spans
from .tables import stored
from .windows import evidence_numbers

# Public names of datasets and what they are called here.
ALIASES = {
    "clinc": ("clinc", "clinc150", "clinc_oos", "clinc/oos-eval", "clinc_oos/plus"), "boolq": ("boolq", "google/boolq", "super_glue/boolq"),
    "snli": ("snli", "stanfordnlp/snli"), "multinli": ("multinli", "multi_nli", "nyu-mll/multi_nli", "multinli_1.0"),
    "arc": ("arc", "ai2_arc", "allenai/ai2_arc", "arc_challenge", "arc_easy"), "sgd": ("sgd", "schema_guided_dstc8", "schema-guided-dialogue"),
    "dbpedia": ("dbpedia", "dbpedia_14", "fancyzhx/dbpedia_14"), "goemotions": ("goemotions", "go_emotions", "google-research-datasets/go_emotions"),
    "massive": ("massive", "massive-en-us", "massive-de-de", "amazon_massive", "amazon-massive-dataset-1.1", "amazon-science/massive", "amazon/massive"),
    "summeval": ("summeval", "summeval-relevance", "summeval-consistency", "mteb/summeval"), "vitaminc": ("vitaminc", "vitaminc-dev", "tals/vitaminc"),
    "squad2": ("squad2", "squad_v2", "rajpurkar/squad_v2"), "paws": ("paws", "google-research-datasets/paws"), "civil_comments": ("civil_comments", "google/civil_comments"),
    "aegis2": ("aegis2", "nvidia/aegis-ai-content-safety-dataset-2.0"), "helpsteer2": ("helpsteer2", "nvidia/helpsteer2"), "pubmedqa": ("pubmedqa", "qiaojin/pubmed_qa"),
    "contractnli": ("contractnli", "contract-nli", "stanfordnlp/contract-nli"), "forecastbench": ("forecastbench", "forecastingresearch/forecastbench-datasets"),
}
#: Up to so many different runs of words are known to every task; with more, the spans of all exposures are cut.
MOST_RUNS = 100_000
PRECEDENCE = ("raw_id", "exact_whole_state", "exact_content", "near_content")


@dataclass(frozen=True)
class Thresholds:
    exact_words: int = 3
    near_words: int = 12
    jaccard: float = 0.8
    containment: float = 0.9
    shared_words: int = 12
    group_words: int = 40


def _known(name: Column) -> Column:
    key = F.regexp_replace(F.lower(F.regexp_replace(name, "/+$", "")), r"^(https?://huggingface\.co/datasets|https://github\.com)/", "")
    table = F.create_map(*[F.lit(x) for own, names in ALIASES.items() for n in names for x in (n, own)])
    return F.try_element_at(table, key)


def namespace(*names: Column, suite: Column | None = None, fixed: dict[str, str] | None = None, prefix: str | None = None) -> Column:
    """The dataset that the first known of several names or addresses stands for.

    A suite's `fixed` namespace comes first, then what follows `prefix` in the suite's name if that is a known
    name.  Without a known name rows stay apart as `unmapped:` and the first name, or `unknown:` and the suite.
    """
    out = []
    if suite is not None and fixed:
        out.append(F.try_element_at(F.create_map(*[F.lit(x) for kv in fixed.items() for x in kv]), suite))
    if suite is not None and prefix:
        out.append(F.when(F.startswith(suite, F.lit(prefix)), _known(F.substr(suite, F.lit(len(prefix) + 1)))))
    out += [_known(n) for n in names]
    unmapped = F.concat(F.lit("unmapped:"), normal(F.coalesce(*names)))
    return F.coalesce(*out, unmapped, F.concat(F.lit("unknown:"), F.coalesce(suite, F.lit("")) if suite is not None else F.lit("")))


def evidence(rows: DataFrame, exposures: DataFrame, t: Thresholds = Thresholds()) -> tuple[DataFrame, DataFrame]:
    """(evidence, spans of the rows).  Evidence: id, exposure, kind, jaccard, containment,
    shared_words.

    rows: id, state, raw (an identity to join by, or null), state_key; exposures: exposure,
    state, raw, state_key.  Equal spans meet once and get their owners back afterwards.  Spans are
    cut only of exposures that share a run of words with a row: no other has equal or near ones.
    """
    ours = stored(with_spans(rows, "id", "state", t.exact_words, t.group_words), "spans")
    theirs = stored(with_spans(exposures, "exposure", "state", t.exact_words, t.group_words, runs_of(ours, MOST_RUNS)), "spans")
    pairs = []
    for kind, key in (("raw_id", "raw"), ("exact_whole_state", "state_key")):
        # Whole states are long, so keys meet by 256-bit digests.
        digests = lambda side: side.withColumn(key, F.sha2(F.col(key), 256))  # noqa: E731, B023
        pairs.append(key_matches(digests(rows), digests(exposures), key, "id", "exposure").select("id", "exposure", F.lit(kind).alias("kind"), F.lit(1.0).alias("jaccard"), F.lit(1.0).alias("containment"), F.lit(None).cast("int").alias("shared_words")))
    unit = lambda spans, name: spans.groupBy("normalized").agg(F.first("tokens").alias("tokens")).withColumn(name, F.col("normalized"))
    a, b = stored(unit(ours, "ours"), "units"), stored(unit(theirs, "theirs"), "units")
    exact = exact_pairs(a, b, "ours", "theirs").select("ours", "theirs", F.lit("exact_content").alias("kind"), F.lit(1.0).alias("jaccard"), F.lit(1.0).alias("containment"), F.lit(None).cast("int").alias("shared_words"))
    near = near_pairs(a, b, "ours", "theirs", least=t.near_words, jaccard=t.jaccard, containment=t.containment, shared_words=t.shared_words)
    near = near.where("ours <> theirs").select("ours", "theirs", F.lit("near_content").alias("kind"), "jaccard", "containment", "shared_words")
    met = exact.unionByName(near)
    owned = met.join(ours.select("id", F.col("normalized").alias("ours")), "ours").join(theirs.select("exposure", F.col("normalized").alias("theirs")), "theirs")
    pairs.append(owned.select("id", "exposure", "kind", "jaccard", "containment", "shared_words"))
    every = pairs[0].unionByName(pairs[1]).unionByName(pairs[2])
    return every.groupBy("id", "exposure", "kind").agg(F.max("jaccard").alias("jaccard"), F.max("containment").alias("containment"), F.max("shared_words").alias("shared_words")), ours


def reviewed(found: DataFrame, reviews: DataFrame | None = None) -> DataFrame:
    """Adds candidate_id and disposition.  Only content candidates can be reviewed; without a
    review they are quarantined, identities and whole states are overlaps."""
    place = F.array_position(F.array(*[F.lit(k) for k in PRECEDENCE]), F.col("kind"))
    numbered = evidence_numbers(found.withColumn("__k", place), ["__k", "id", "exposure"]).drop("__k")
    content = F.col("kind").isin("exact_content", "near_content")
    default = F.when(content, "quarantine").otherwise("confirm_overlap")
    if reviews is None:
        return numbered.withColumn("disposition", default)
    said = reviews.select("candidate_id", F.col("disposition").alias("__d"))
    return numbered.join(said, "candidate_id", "left").withColumn("disposition", F.when(content, F.coalesce("__d", default)).otherwise(default)).drop("__d")


def decisions(rows: DataFrame, found: DataFrame, spans: DataFrame, base: str | None = None, group_words: int = 40) -> DataFrame:
    """id, component, base, decided: the strictest decision of each component of related rows.

    Rows are related by (suite, group_id), by upstream family in a namespace, and by linking
    spans: long ones anywhere, short ones within a namespace.
    """
    links = spans.where("group_link").select("id", "normalized", F.size("tokens").alias("n")).join(rows.select("id", "namespace"), "id")
    shared = links.select("id", F.xxhash64(F.when(F.col("n") >= group_words, F.lit("")).otherwise(F.col("namespace")), "normalized").alias("content"))
    keyed = rows.select("id", F.xxhash64("suite", "group_id").alias("group"), F.when(F.col("family").isNotNull(), F.xxhash64("namespace", "family")).alias("family"))
    edges = star_edges(keyed, "id", ["group", "family"]).unionByName(star_edges(shared, "id", ["content"]))
    labels = components(rows, edges, "id")
    hit = found.where("disposition <> 'dismiss'").groupBy("id").agg(F.bool_or(F.col("disposition") == "confirm_overlap").alias("__x"))
    own = rows.select("id", F.lit(base).alias("b") if base else F.col("base").alias("b")).join(hit, "id", "left").join(labels, "id")
    direct = F.when((F.col("b") == "exclude") | F.col("__x"), "exclude").when((F.col("b") == "quarantine") | F.col("__x").isNotNull(), "quarantine").otherwise("retain")
    spread = F.when(F.col("__x"), "exclude").when(F.col("__x").isNotNull(), "quarantine").otherwise("retain")
    all_ = propagated(own.withColumn("direct", direct).withColumn("spread", spread), "component", "spread")
    worst = F.when(F.array_contains(F.array("direct", "decided"), "exclude"), "exclude").when(F.array_contains(F.array("direct", "decided"), "quarantine"), "quarantine").otherwise("retain")
    return all_.select("id", "component", "direct", worst.alias("decided"))
