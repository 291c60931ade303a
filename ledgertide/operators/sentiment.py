"""Scores of texts by a classifier: one of word frequencies that is learned from labelled texts, or any that workers load."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgertide.operators.evaluation import CLASSES as LABELS
from ledgertide.working import stored

#: Words that a model of word frequencies knows, the most frequent ones; so it is broadcast with a bound.
MOST_WORDS = 20_000

Scorer = Callable[[list[str]], list[object]]


def words_of(tokens: Column) -> Column:
    return F.filter(F.transform(tokens, F.lower), lambda w: w != "")


def fit_words(rows: DataFrame, most: int = MOST_WORDS) -> tuple[DataFrame, dict[str, float]]:
    """(model, priors) of rows (tokens, label): for each known word (word, hawkish, dovish, neutral) the logarithms of its smoothed share among a label's
    words, and of each label's share among the rows. Rows with another label don't count; without rows all shares are equal.

    Counts merge before the shuffle; the driver gets one row of totals.
    """
    own = stored(rows.where(F.col("label").isin(*LABELS)).select("label", words_of(F.col("tokens")).alias("words")), "words-to-learn")
    counts = own.select("label", F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("label") == x).alias(x) for x in LABELS])
    top = stored(counts.orderBy(F.desc("n"), "word").limit(most), "known-words")
    total = top.agg(F.count(F.lit(1)).alias("kinds"), *[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in LABELS]).first()
    docs = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}
    priors = {x: math.log((docs.get(x, 0) + 1) / (sum(docs.values()) + len(LABELS))) for x in LABELS}
    return top.select("word", *[F.log((F.col(x) + 1) / F.lit(max(1, total[x] + total["kinds"])).cast("double")).alias(x) for x in LABELS]), priors


def score_words(chunks: DataFrame, model: DataFrame, priors: dict[str, float]) -> DataFrame:
    """(doc_id, chunk, label, score) of (doc_id, chunk, tokens): each label's probability by the model, words counting independently. Chunks without a
    known word get the priors."""
    flat = chunks.select("doc_id", "chunk", F.explode_outer(words_of(F.col("tokens"))).alias("word"))
    known = flat.join(F.broadcast(model), "word", "left")  # MOST_WORDS at most
    sums = known.groupBy("doc_id", "chunk").agg(*[(F.coalesce(F.sum(x), F.lit(0.0)) + F.lit(priors[x])).alias(x) for x in LABELS])
    most = F.greatest(*[F.col(x) for x in LABELS])
    parts = {x: F.exp(F.col(x) - most) for x in LABELS}
    whole = sum(list(parts.values())[1:], parts[LABELS[0]])
    return sums.select("doc_id", "chunk", F.explode(F.array(*[F.struct(F.lit(x).alias("label"), (parts[x] / whole).alias("score")) for x in LABELS])).alias("s")).select("doc_id", "chunk", "s.*")


def word_scorer(model: DataFrame, priors: dict[str, float]) -> Callable[[], Scorer]:
    """The same model as a classifier that workers load; it reaches them with the code, MOST_WORDS rows at most."""
    table = {r["word"]: [r[x] for x in LABELS] for r in model.collect()}

    def load() -> Scorer:
        def score(texts: list[str]) -> list[object]:
            out = []
            for t in texts:
                known = [table[w] for x in t.split(" ") if (w := x.lower()) in table]
                sums = [priors[x] + math.fsum(k[i] for k in known) for i, x in enumerate(LABELS)]
                parts = [math.exp(s - max(sums)) for s in sums]
                out.append([{"label": x, "score": p / sum(parts)} for x, p in zip(LABELS, parts, strict=True)])
            return out

        return score

    return load


def label_scores(raw: Column) -> Column:
    """array<struct<label, score>> of a classifier's output as JSON: a list of objects, or a list that holds such a list first. What is no object is left out, a
    missing label is empty and a missing or odd score 0; any other output has none."""
    items = F.when(raw.rlike(r"^\s*\["), F.from_json(raw, "array<string>"))  # objects stay text
    first = F.get(items, F.lit(0))
    items = F.when(first.rlike(r"^\s*\["), F.from_json(first, "array<string>")).otherwise(items)
    objects = F.transform(F.filter(items, lambda x: x.rlike(r"^\s*\{")), lambda x: F.from_json(x, "label string, score string"))
    score = lambda x: F.coalesce(x["score"].try_cast("double"), F.lit(0.0))
    return F.coalesce(F.transform(objects, lambda x: F.struct(F.coalesce(x["label"], F.lit("")).alias("label"), score(x).alias("score"))), F.array().cast("array<struct<label: string, score: double>>"))


def first_that_loads(*loaders: Callable[[], Scorer]) -> Callable[[], Scorer]:
    """A loader that tries others in order; if none loads, the last failure is raised."""

    def load() -> Scorer:
        failure: Exception = ValueError("no loaders")
        for loader in loaders:
            try:
                return loader()
            except Exception as e:  # a checkpoint or device that isn't there, of whatever kind
                failure = e
        raise failure

    return load


def score_chunks(chunks: DataFrame, make_scorer: Callable[[], Scorer]) -> DataFrame:
    """(doc_id, chunk, label, score) of (doc_id, chunk, tokens) by a classifier's outputs; each worker loads it once for each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for batch in batches:
            raw = [json.dumps(x) for x in scorer([" ".join(t) for t in batch["tokens"]])]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "chunk": batch["chunk"], "raw": raw})

    outputs = chunks.mapInPandas(run, "doc_id long, chunk int, raw string")
    return outputs.select("doc_id", "chunk", F.explode(label_scores(F.col("raw"))).alias("s")).select("doc_id", "chunk", "s.*")


def label_order() -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LABELS]), F.col("label"))
