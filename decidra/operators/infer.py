"""The boundary to a model: inputs only go in, one prediction per row comes out."""

from __future__ import annotations

import json
import re
import time
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.probs import binary_confidence, confidence, softmax
from .validate import failed, prediction_checks
from .windows import token_batches

INPUTS = ("id", "suite", "state", "qtype", "options")
PREDICTION = "id string, suite string, status string, length int, probs array<double>, pred_idx int, forward_seconds double"


def model_inputs(rows: DataFrame) -> DataFrame:
    """Only what a model may see: never a target column."""
    return rows.select(*INPUTS)


def as_inputs(part: pd.DataFrame) -> list[dict]:
    """What a backend gets of some rows: state, qtype and options as plain values."""
    plain = lambda opts: [dict(o.asDict() if hasattr(o, "asDict") else o) for o in (opts if opts is not None else [])]
    return [{"state": s, "qtype": t, "options": plain(o)} for s, t, o in zip(part["state"], part["qtype"], part["options"], strict=True)]


def answered(backend, part: pd.DataFrame) -> pd.DataFrame:
    """One prediction a row, in the rows' order."""
    inputs = as_inputs(part)
    began = time.perf_counter()
    answers = backend.predict_batch(inputs)
    took = (time.perf_counter() - began) / max(1, len(inputs))
    if len(answers) != len(inputs):
        raise ValueError("a backend must answer every input")
    probs = [a.get("probs") for a in answers]
    best = [None if p is None else max(range(len(p)), key=lambda i: (p[i], -i)) for p in probs]
    cells = (part["id"].to_list(), part["suite"].to_list(), [a["status"] for a in answers], [a.get("length") for a in answers], probs, best, [took] * len(inputs))
    return pd.DataFrame(dict(zip([c.split()[0] for c in PREDICTION.split(", ")], cells, strict=True)))


def predict(rows: DataFrame, factory, batch_size: int = 32) -> DataFrame:
    """Predictions of `factory()`, which each worker calls once.

    The result has a method predict_batch(inputs) -> list of dicts with status, length and,
    for status ok, probs.  Inputs are dicts of state, qtype and options.
    """

    def run(frames):
        backend = factory()
        for frame in frames:
            for at in range(0, len(frame), batch_size):
                yield answered(backend, frame.iloc[at : at + batch_size])

    return model_inputs(rows).mapInPandas(run, PREDICTION)


def collated(rows: DataFrame, factory, length: str, limit: int, max_tokens: int, max_rows: int) -> DataFrame:
    """Predictions made in batches of similar lengths: with the batch's number in its suite, its size, and its tokens with padding.

    Rows of each suite are taken by rising (length, id) into batches of at most `max_rows` rows and, padded to the longest, `max_tokens` tokens.  A batch is never
    split: its rows go to one partition, where they follow each other, and one call answers them, whatever the size of Arrow batches.  Rows longer than `limit` aren't
    shown to the model: their status is unsupported_length and they have no batch.  The result is in no order; ids tell where rows belong.
    """
    fits = F.col(length) <= limit
    ready = rows.where(fits).select(*INPUTS, F.col(length).cast("long").alias("__tokens"))
    placed = token_batches(ready, "suite", "id", "__tokens", max_tokens, max_rows)
    together = placed.repartition("suite", "batch").sortWithinPartitions("suite", "batch", "__tokens", "id")

    def run(frames):
        backend = factory()
        held: list[pd.DataFrame] = []

        def call() -> pd.DataFrame:
            part = pd.concat(held, ignore_index=True)
            out = answered(backend, part)
            out["batch"], out["batch_size"], out["padded_tokens"] = part["batch"], len(part), len(part) * int(part["__tokens"].max())
            return out

        for frame in frames:
            new = (frame["suite"] != frame["suite"].shift()) | (frame["batch"] != frame["batch"].shift())
            for _, piece in frame.groupby(new.cumsum(), sort=False):
                if held and (held[0]["suite"].iloc[0], held[0]["batch"].iloc[0]) != (piece["suite"].iloc[0], piece["batch"].iloc[0]):
                    yield call()
                    held = []
                held.append(piece)
        if held:
            yield call()

    done = together.mapInPandas(run, f"{PREDICTION}, batch long, batch_size long, padded_tokens long")
    names = [c.split() for c in PREDICTION.split(", ")]
    known = {"id": F.col("id").cast("string"), "suite": F.col("suite").cast("string"), "status": F.lit("unsupported_length"), "length": F.col(length).cast("int")}
    long = rows.where(~F.coalesce(fits, F.lit(False))).select(*[known.get(n, F.lit(None)).cast(t).alias(n) for n, t in names], *[F.lit(None).cast("long").alias(n) for n in ("batch", "batch_size", "padded_tokens")])
    return done.unionByName(long)


class WordScorer:
    """Scores options by their words: an option's chance is in proportion to one more than how often its words occur in the state.

    A baseline that needs no weights, and the least a backend must do: one answer an input, none for inputs of more than `max_length` words.
    """

    def __init__(self, words: dict[str, set[str]], max_length: int = 4096):
        self.words, self.max_length = words, max_length

    def predict_batch(self, inputs: list[dict]) -> list[dict]:
        out = []
        for item in inputs:
            text = item["state"] or ""
            n = len(re.findall(r"[^ \t\n\x0B\f\r]+", text))
            if n > self.max_length:
                out.append({"status": "unsupported_length", "length": n})
                continue
            found = Counter(re.findall(r"[^\W\d_]+", text.lower()))
            keys = ["false", "true"] if item["qtype"] == "noul" else [o["key"] for o in item["options"]]
            weights = [1 + sum(found[w] for w in self.words.get(k, ())) for k in keys]
            out.append({"status": "ok", "length": n, "probs": [w / sum(weights) for w in weights]})
        return out


def checked(predictions: DataFrame) -> DataFrame:
    """Adds `errors` of each prediction."""
    return predictions.withColumn("errors", failed(prediction_checks()))


def regrouped(rows: DataFrame, case: str, question: str) -> DataFrame:
    """Answers of several questions of one case in one row: a map from question to answer."""
    entry = F.struct(F.col(question), F.struct("pred_idx", "probs", confidence(F.col("probs")).alias("confidence")))
    return rows.groupBy(case).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("answers"))


def answers(rows: DataFrame, case: str, question: str) -> DataFrame:
    """case, answers (a map from question to answer), input_tokens: what several questions of one case get in one call.

    Rows: the case and question, qtype, options, logits, temperature, act (two logits, the first of acting) and n_tokens.  An answer has type, choice (the likeliest key), score (the expected
    level), noul (the chance of true), probabilities by key, legend (levels of a score), confidence and act_probability, numbers to four digits; fields that a type doesn't have are null.
    Choices and scores are confident by their entropy, nouls by the likelier side.  Ties go to the first option.
    """
    p, keys = F.col("__p"), F.transform("options", lambda o: o["key"])
    four = lambda c: F.round(c, 4)
    choice, score, noul = (F.col("qtype") == t for t in ("choice", "score", "noul"))
    expected = F.aggregate(F.transform(p, lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    named = F.map_from_arrays(F.when(choice, keys).otherwise(F.transform(p, lambda x, i: i.cast("string"))), F.transform(p, four))
    answer = F.struct(
        F.col("qtype").alias("type"), F.when(choice, F.get(keys, (F.array_position(p, F.array_max(p)) - 1).cast("int"))).alias("choice"), F.when(score, four(expected)).alias("score"), F.when(noul, four(p[1])).alias("noul"),
        F.when(~noul, named).alias("probabilities"), F.when(score, F.map_from_arrays(F.transform(p, lambda x, i: i.cast("string")), F.transform("options", lambda o: F.coalesce(o["desc"], o["key"])))).alias("legend"),
        four(F.when(noul, binary_confidence(p)).otherwise(confidence(p))).alias("confidence"), four(softmax(F.col("act"))[0]).alias("act_probability"),
    )
    ready = rows.withColumn("__p", softmax(F.col("logits"), F.col("temperature")))
    entry = F.struct(F.col(question).alias("q"), answer.alias("a"))
    return ready.groupBy(case).agg(F.map_from_entries(F.array_sort(F.collect_list(entry), lambda x, y: F.when(x["q"] < y["q"], -1).when(x["q"] > y["q"], 1).otherwise(0))).alias("answers"), F.sum("n_tokens").alias("input_tokens"))


def http_status(body: str, limit: int = 1_000_000, models: tuple[str, ...] = ("default",)) -> tuple[int, str]:
    """What a service answers to a request body: 200, 400, 413 or 422, and why."""
    if len(body.encode()) > limit:
        return 413, "too large"
    try:
        request = json.loads(body, parse_constant=lambda x: (_ for _ in ()).throw(ValueError(x)))
    except ValueError:
        return 400, "not JSON"
    if not isinstance(request, dict) or set(request) != {"state", "model", "questions"}:
        return 400, "wrong fields"
    if request["model"] not in models:
        return 422, "unknown model"
    questions = request["questions"]
    if not isinstance(questions, dict) or not questions:
        return 422, "no questions"
    for q in questions.values():
        if not isinstance(q, dict) or q.get("type") not in ("choice", "score", "noul") or not isinstance(q.get("instructions"), str) or not q["instructions"].strip():
            return 422, "bad question"
        if q["type"] != "noul" and (not isinstance(q.get("criteria"), dict | list) or len(q["criteria"]) < 2):
            return 422, "too few options"
    return 200, "ok"


def http_response(body: str, answer, limit: int = 1_000_000, models: tuple[str, ...] = ("default",)) -> tuple[int, dict]:
    """Status and document that a service answers with: what `answer(request)` returns for a valid request, 500 if it fails; why the model failed isn't shown."""
    status, reason = http_status(body, limit, models)
    if status != 200:
        return status, {"error": reason}
    try:
        return 200, answer(json.loads(body))
    except Exception as error:  # whatever a model raises is the service's failure
        return 500, {"error": type(error).__name__}
