"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence scores sigmoid(bias + weights of its words); the sentence scores combine by
noisy-or to the document's score, 1 - product(1 - sentence). The weights are trained from document labels alone, by gradient
steps on the likelihood of the noisy-or; the sentence scores then say where the offence lies. Beginnings of four and five letters
count beside whole words.

The model is fitted on a sample bounded by ``TRAIN_ROWS`` labelled rows (smallest hashes of their ids; whole texts of any length),
held-out rows excluded; its vocabulary holds at most ``VOCABULARY`` words, so model and broadcast are of bounded size. Words are
counted, and sentences turned into numbers of chosen words, in parallel; only those numbers meet in the one task that takes the
gradient steps. Scoring covers every whole text.

Defined results: null, empty and blank texts are one empty sentence; words are lower-cased runs of letters; rows without or
with a null label take no part in training; of several labels of one id the largest counts, of several texts
the one with the least hash; without any label or without
both classes all scores are 0.5 of the prior, i.e. 0; repeated rows score alike; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admeridian.llm.common import one_by_one, small_batches, staged, text_or_empty, tidy_all

TRAIN_ROWS, VOCABULARY, FOLDS, STEPS = 8_000, 20_000, 5, 300
#: A word is chosen if it stands in so many documents and its share of toxic ones is so many deviations off.
LEAST_DOCUMENTS, DEVIATIONS = 4, 3.0
SENTENCES = re.compile(r"[.!?\n]+").split
TERMS = re.compile(r"[^\W\d_]+").findall


def fold(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % FOLDS


def _with_stems(words: set[str]) -> set[str]:
    """The words and, marked by their length, the beginnings of the longer ones, so that inflected forms share evidence."""
    return words | {"4" + w[:4] for w in words if len(w) > 4} | {"5" + w[:5] for w in words if len(w) > 5}


def _sentences(text: str) -> list[set[str]]:
    return [_with_stems(set(TERMS(x))) for x in SENTENCES(text.lower()) if x.strip()] or [set()]


def fit(labels: np.ndarray, plain: np.ndarray, doc_of: np.ndarray, sentence_of: np.ndarray, word_of: np.ndarray, n_words: int, steps: int = STEPS, ridge: float = 1e-5) -> np.ndarray:
    """Weights of the words, then the bias. ``plain``: sentences of each document without chosen words; ``doc_of``: the document of
    each other sentence; ``sentence_of`` and ``word_of``: which word stands in which of these."""
    labels, plain = np.asarray(labels, float), np.asarray(plain, float)
    w, s = np.zeros(n_words + 1), len(doc_of)
    w[-1] = -6.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, steps + 1):
        p, p_plain = sigmoid(w[-1] + np.bincount(sentence_of, w[word_of], minlength=s)), sigmoid(w[-1])
        keep = np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(labels)) + plain * np.log1p(-min(p_plain, 1 - 1e-12))
        none = np.clip(np.exp(keep), 1e-9, 1 - 1e-9)
        pull = labels * none / (1 - none) - (1 - labels)
        by_sentence = p * pull[doc_of]
        g = np.append(np.bincount(word_of, by_sentence[sentence_of], minlength=n_words), by_sentence.sum() + p_plain * (plain * pull).sum()) / len(labels)
        g[:-1] -= ridge * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def chosen_words(sample: DataFrame, n: int, n_toxic: int, vocabulary: int = VOCABULARY) -> list[str]:
    """The words whose share of toxic documents is furthest from the overall share, at most ``vocabulary``, in order."""

    def words(batches):
        for batch in batches:
            for text, y in zip(one_by_one(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                own = sorted(_with_stems(set(TERMS(text.lower()))))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([y] * len(own), pa.float64())], names=["word", "y"])
        tidy_all()

    rate = n_toxic / n
    counts = sample.select("text", "y").mapInArrow(words, "word string, y double").groupBy("word").agg(F.count("*").alias("n"), F.sum("y").alias("k")).filter(F.col("n") >= LEAST_DOCUMENTS)
    z = F.abs((F.col("k") - F.col("n") * rate) / F.sqrt(F.col("n") * (rate * (1 - rate))))
    return sorted(r["word"] for r in counts.select("word", z.alias("z")).filter(F.col("z") > DEVIATIONS).orderBy(F.desc("z"), "word").limit(vocabulary).collect())


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS, vocabulary: int = VOCABULARY) -> DataFrame:
    """(word, weight) of a model fitted to at most ``rows`` labelled documents that are not held out."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).dropna()
    known = known.filter(fold(F.col("id")) != 0).groupBy("id").agg(F.max("y").alias("y"))
    chosen = known.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(rows)
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(F.col(text_col)).alias("text")).join(F.broadcast(chosen), "id")
    sample = texts.groupBy("id").agg(F.min(F.struct(F.xxhash64("text").alias("tie"), "text", "y")).alias("s")).select("id", "s.text", "s.y")
    sample = staged(sample, "sample")
    n, n_toxic = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    names = chosen_words(sample, n, n_toxic, vocabulary) if 0 < n_toxic < n else []
    place = {w: i for i, w in enumerate(names)}

    def bags(batches):
        for batch in batches:
            for i, text in enumerate(one_by_one(batch.column(2))):
                hits = [[place[w] for w in sorted(place.keys() & x)] for x in _sentences(text)]
                own = [x for x in hits if x]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([len(hits) - len(own)], pa.int64()), pa.array([own], pa.list_(pa.list_(pa.int32())))], names=["id", "y", "plain", "hits"])
        tidy_all()

    def fitted(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        hits = part["hits"].tolist()
        sizes = np.array([len(x) for bag in hits for x in bag], np.int64)
        doc_of = np.repeat(np.arange(len(part)), [len(bag) for bag in hits])
        word_of = np.array([w for bag in hits for x in bag for w in x], np.int64)
        w = fit(part["y"].to_numpy(), part["plain"].to_numpy(), doc_of, np.repeat(np.arange(len(sizes)), sizes), word_of, len(names))
        return pd.DataFrame({"word": ["", *names], "weight": [w[-1], *w[:-1]]})

    if not names:
        empty = "CAST('' AS STRING) AS word", "CAST(-30.0 AS DOUBLE) AS weight"  # nothing to learn from
        return docs.sparkSession.range(1).selectExpr(*empty)
    kind = sample.schema["id"].dataType.simpleString()
    table = sample.select("id", "y", "text").mapInArrow(bags, f"id {kind}, y double, plain long, hits array<array<int>>").withColumn("all", F.lit(1))
    learned = table.groupBy("all").applyInPandas(fitted, "word string, weight double")
    return staged(learned.filter("word = '' OR abs(weight) > 0.001"), "toxicity")


def model_of(table: DataFrame) -> dict[str, float]:
    """The fitted weights, at most ``VOCABULARY`` + 1, on the driver."""
    return {r["word"]: r["weight"] for r in table.collect()} or {"": -30.0}


def sentence_scores(text: str, model: dict[str, float]) -> list[float]:
    bias = model[""]
    return [1 / (1 + math.exp(-max(-30.0, min(30.0, bias + sum(model.get(w, 0.0) for w in s))))) for s in _sentences(text)]


def document_scores(text: Column, model: dict[str, float]) -> Column:
    """score, worst (the sentence with the highest score), worst_score."""
    weights, bias = {k: v for k, v in model.items() if k}, model[""]
    whole, four, five = {k for k in weights if k[0] not in "45"}, {k[1:]: k for k in weights if k[0] == "4"}, {k[1:]: k for k in weights if k[0] == "5"}

    def score(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        base = math.log1p(-1 / (1 + math.exp(-bias)))
        for batch in texts:
            out = []
            for text in batch:
                keep, worst, high, n = 0.0, "", bias, 0
                for sentence in SENTENCES(text.lower()):
                    words = set(TERMS(sentence))
                    hits = whole & words
                    hits |= {four[w] for w in four.keys() & {w[:4] for w in words if len(w) > 4}}
                    hits |= {five[w] for w in five.keys() & {w[:5] for w in words if len(w) > 5}}
                    if hits:
                        z = min(30.0, bias + sum(weights[w] for w in sorted(hits)))
                        keep -= math.log1p(math.exp(z))
                        if z > high:
                            worst, high = sentence, z
                    elif sentence and not sentence.isspace():
                        n += 1
                keep += base * max(n, 1 if not keep else 0)
                out.append((-math.expm1(keep), worst.strip(), 1 / (1 + math.exp(-high))))
            yield pd.DataFrame(out, columns=["score", "worst", "worst_score"])
        tidy_all()

    return F.pandas_udf(score, "score double, worst string, worst_score double")(text_or_empty(text))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted, worst, worst_score``."""
    small_batches(docs.sparkSession)
    model = model_of(train(docs, labels, id_col, text_col))
    out = docs.select(F.col(id_col).alias("doc_id"), (fold(F.col(id_col)) == 0).alias("held_out"), document_scores(F.col(text_col), model).alias("s"))
    return out.select("doc_id", "held_out", "s.score", (F.col("s.score") >= 0.5).cast("int").alias("predicted"), "s.worst", "s.worst_score")


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score under 0.5, with all their columns."""
    small_batches(docs.sparkSession)
    model = model_of(train(docs, labels, id_col, text_col))
    return docs.filter(document_scores(F.col(text_col), model)["score"] < 0.5)
