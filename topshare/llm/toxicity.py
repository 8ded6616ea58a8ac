"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

The presence of each n-gram (three to five characters, hashed) counts with its
log-count ratio r = log((p / |p|) / (q / |q|)) of toxic to other training texts;
n-grams with |r| below ``MIN_RATIO`` or in few texts tell little and are left out.  The
scaled vectors have unit length, so long texts do not drown a few strong
n-grams, and logistic regression learns a weight for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topshare.llm.common import prepare_workers, texts_of, written
from topshare.llm.ngrams import ngram_codes

SHORTEST, LONGEST = 3, 5
BITS = 18
SIZE = 1 << BITS
#: The model learns from at most so many labelled texts, the first in order of a hash of their ids.
MAX_TRAINING_ROWS = 12_000
_TRAINING_TASKS = 8
MIN_RATIO = 1.5
MIN_TEXTS = 5
_SMOOTHING = 1.0
_PENALTY = 1e-4
_ROUNDS = 80


class Model(NamedTuple):
    weights: np.ndarray  # of the scaled n-grams
    squares: np.ndarray  # of the ratios
    bias: float

    def scores(self, texts: Iterator[str]) -> np.ndarray:
        seen = np.zeros(SIZE, bool)
        margins = []
        for text in texts:
            found = _distinct(text, seen)
            length = np.sqrt(self.squares[found].sum(dtype=np.float64))
            margins.append(self.weights[found].sum(dtype=np.float64) / length if length else 0.0)
        return _logistic(np.array(margins, np.float64) + self.bias)


def _logistic(margins: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margins, -500, 500)))


def _distinct(text: str, seen: np.ndarray) -> np.ndarray:
    codes = ngram_codes(text, SHORTEST, LONGEST, BITS)
    seen[codes] = True
    found = np.flatnonzero(seen)
    seen[codes] = False
    return found


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAINING_ROWS) -> DataFrame:
    """``text, toxic`` of at most ``limit`` labelled documents (this starts a job).

    Ids that the labels repeat count once, with label 1 if any row says so; rows
    without id or label do not count.  The ids are few enough to broadcast: that
    is what ``limit`` bounds.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    return written(rows.select("text", "toxic").repartition(_TRAINING_TASKS), "toxicity-training")


def train(rows: DataFrame) -> Model:
    """Learn from ``text, toxic`` rows of a bounded number (this starts jobs).

    Without rows of both labels the model gives every text their mean label.
    """
    spark = rows.sparkSession
    prepare_workers(spark)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, texts, seen = np.zeros((2, SIZE), np.int32), [0, 0], np.zeros(SIZE, bool)
        for batch in batches:
            for text, toxic in zip(texts_of(batch["text"]), batch["toxic"]):
                counts[int(toxic), _distinct(text, seen)] += 1
                texts[int(toxic)] += 1
        yield pd.DataFrame({"others": [texts[0]], "toxic": [texts[1]], "counts": [counts.tobytes()]})

    # One row of two vectors for each of a fixed number of tasks.
    parts = rows.mapInPandas(count, "others long, toxic long, counts binary").collect()
    others, toxic = sum(p["others"] for p in parts), sum(p["toxic"] for p in parts)
    if not others or not toxic:
        mean = toxic / (others + toxic) if others + toxic else 0.0
        bias = float(np.log((mean + 1e-6) / (1 - mean + 1e-6)))
        return Model(np.zeros(SIZE, np.float32), np.zeros(SIZE, np.float32), bias)
    counts = sum(np.frombuffer(p["counts"], np.int32).reshape(2, SIZE).astype(np.int64) for p in parts)
    ratios = np.log((counts[1] + _SMOOTHING) / (toxic + 2 * _SMOOTHING)) - np.log(
        (counts[0] + _SMOOTHING) / (others + 2 * _SMOOTHING)
    )
    ratios[(np.abs(ratios) < MIN_RATIO) | (counts.sum(axis=0) < MIN_TEXTS)] = 0
    ratios = ratios.astype(np.float32)

    def strong(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(SIZE, bool)
        for batch in batches:
            found = [_distinct(t, seen) for t in texts_of(batch["text"])]
            kept = [f[ratios[f] != 0].astype(np.int32).tobytes() for f in found]
            yield pd.DataFrame({"toxic": batch["toxic"].astype("int32"), "codes": kept})

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(batches))
        weights, bias = _logistic_regression([np.frombuffer(c, np.int32) for c in table["codes"]], table["toxic"], ratios)
        yield pd.DataFrame({"weights": [weights.astype(np.float32).tobytes()], "bias": [bias]})

    strong_rows = rows.mapInPandas(strong, "toxic int, codes binary").repartition(1)
    found = strong_rows.mapInPandas(fit, "weights binary, bias double").first()
    weights = np.frombuffer(found["weights"], np.float32) * ratios
    return Model(weights, ratios * ratios, found["bias"])


def _logistic_regression(codes: list[np.ndarray], labels: pd.Series, ratios: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the scaled n-grams and the bias, by gradient steps of adaptive size."""
    n = len(codes)
    y = labels.to_numpy(np.float64)
    order = sorted(range(n), key=lambda i: (y[i], codes[i].tobytes()))  # sums then don't depend on arrival
    codes, y = [codes[i] for i in order], y[order]
    column = np.concatenate(codes)
    row = np.repeat(np.arange(n), [len(c) for c in codes])
    value = ratios[column].astype(np.float64)
    value /= np.sqrt(np.bincount(row, value * value, n))[row]
    weights, bias = np.zeros(SIZE), float(np.log(y.mean() / (1 - y.mean())))
    seen, seen_bias = np.full(SIZE, 1e-8), 1e-8
    for _ in range(_ROUNDS):
        error = (_logistic(np.bincount(row, weights[column] * value, n) + bias) - y) * (10 / n)
        slope = np.bincount(column, error[row] * value, SIZE) + _PENALTY * weights
        seen += slope * slope
        weights -= 0.5 * slope / np.sqrt(seen)
        seen_bias += error.sum() ** 2
        bias -= 0.5 * error.sum() / np.sqrt(seen_bias)
    return weights, bias


def score(text: Column, model: Model) -> Column:
    """The probability of label 1 for every whole text; null counts as empty and gets the bias alone."""

    @F.pandas_udf("double")
    def scored(column: pd.Series) -> pd.Series:
        return pd.Series(model.scores(texts_of(column)))

    return scored(text)


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, predicted`` (1 from a score of 0.5 on) of every row; other columns are not looked at."""
    prepare_workers(docs.sparkSession)
    scored = docs.select("doc_id", score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose text scores below 0.5, with all their columns."""
    prepare_workers(docs.sparkSession)
    return docs.where(score(F.col("text"), model) < 0.5)
