"""Language identification with string kernels, Nyström landmarks and kernel ridge regression.

The blended-spectrum presence kernel of two texts counts the n-grams of one to
three characters that both contain, k(x, y) = |x and y| / sqrt(|x| |y|).  N-grams
are hashed, so a batch of texts is a sparse matrix of zeros and ones and its
kernel with a fixed number of landmark texts is one matrix product.  Nyström
features are that kernel times the inverse root of the landmarks' own kernel;
ridge regression on them, one against the rest, gives a score for each language
by a second product.  To score, both right-hand factors are multiplied first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topshare.llm.common import prepare_workers, texts_of, written
from topshare.llm.ngrams import ngram_codes

SHORTEST, LONGEST = 1, 3
BITS = 20
SIZE = 1 << BITS
#: The model learns from at most so many texts of each language, the first in order of a hash of their ids.
TEXTS_PER_LANGUAGE = 400
#: Landmarks of all languages together.
LANDMARKS = 128
UNKNOWN = "und"
_RIDGE = 1e-2
_SHARPNESS = 5.0
_CHARACTERS_AT_ONCE = 250_000


class Model(NamedTuple):
    languages: list[str]
    marks: bytes  # presence of landmarks by code, one bit each, compressed
    weights: np.ndarray  # landmark by language
    bias: np.ndarray

    @property
    def landmarks(self) -> np.ndarray:
        """Unit rows of presence."""
        return _unit_rows(_unpacked(self.marks))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language of each text and how sure that is, 0 to 1; ``und`` and 0 for texts without a letter."""
        return next(self.predictions([texts]))

    def predictions(self, batches: Iterable[list[str]]) -> Iterator[tuple[list[str], np.ndarray]]:
        """``predict`` for many batches, with the weights of codes made once."""
        marks = _unpacked(self.marks)
        place = _places(marks)
        # The product of landmarks and weights; its first row stands for the n-grams of no landmark.
        by_code = np.zeros((int(place.max(initial=0)) + 1, len(self.languages)))
        for codes, weights in zip(marks, self.weights):
            by_code[place[codes]] += weights / np.sqrt(len(codes))
        for texts in batches:
            lettered = np.array([any(map(str.isalpha, t)) for t in texts], bool)
            if not self.languages or not lettered.any():
                yield [UNKNOWN] * len(texts), np.zeros(len(texts))
                continue
            margins = np.concatenate([_product(part, place, by_code) for part in _parts(texts)]) + self.bias
            powers = np.exp(_SHARPNESS * (margins - margins.max(axis=1, keepdims=True)))
            best = margins.argmax(axis=1)
            chance = powers[np.arange(len(texts)), best] / powers.sum(axis=1)
            yield [self.languages[b] if known else UNKNOWN for b, known in zip(best, lettered)], chance * lettered


def _grams(text: str) -> np.ndarray:
    """The different codes of a text, in order."""
    codes = np.sort(ngram_codes(text, SHORTEST, LONGEST, BITS).astype(np.int32))
    return codes[np.r_[True, codes[1:] != codes[:-1]]]


def _unit_rows(rows: Sequence[np.ndarray]) -> np.ndarray:
    present = np.zeros((len(rows), SIZE), np.float32)
    for row, codes in zip(present, rows):
        row[codes] = 1 / np.sqrt(len(codes))
    return present


def _unit_presence(texts: Iterable[str]) -> np.ndarray:
    """A dense row for each text: its n-grams, scaled to length one."""
    return _unit_rows([_grams(t) for t in texts])


def _packed(marks: Sequence[np.ndarray]) -> bytes:
    present = np.zeros((len(marks), SIZE), bool)
    for row, codes in zip(present, marks):
        row[codes] = True
    return zlib.compress(np.packbits(present, axis=1).tobytes(), 1)


def _unpacked(marks: bytes) -> list[np.ndarray]:
    """The codes of each landmark."""
    rows = np.frombuffer(zlib.decompress(marks), np.uint8).reshape(-1, SIZE // 8) if marks else ()
    return [np.flatnonzero(np.unpackbits(row)).astype(np.int32) for row in rows]


def _places(marks: Sequence[np.ndarray]) -> np.ndarray:
    """For every code 1, 2, 3 .. if a landmark has it, else 0."""
    found = np.zeros(SIZE, bool)
    for codes in marks:
        found[codes] = True
    return np.where(found, np.cumsum(found), 0).astype(np.int32)


def _parts(texts: Sequence[str]) -> Iterator[list[str]]:
    """Runs of texts of about ``_CHARACTERS_AT_ONCE`` characters; a longer text is one by itself."""
    part: list[str] = []
    size = 0
    for text in texts:
        if part and size + len(text) > _CHARACTERS_AT_ONCE:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def _product(texts: Sequence[str], place: np.ndarray, by_code: np.ndarray) -> np.ndarray:
    """The product of the texts' sparse unit rows with a row of numbers for each code."""
    rows = [_grams(t) for t in texts]
    sizes = np.array([len(r) for r in rows])
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    return np.add.reduceat(by_code[place[np.concatenate(rows)]], starts, axis=0) / np.sqrt(sizes)[:, None]


def _kernel(texts: Iterable[str], marks: Sequence[np.ndarray]) -> np.ndarray:
    """Text by landmark."""
    place = _places(marks)
    present = np.zeros((int(place.max(initial=0)) + 1, len(marks)), np.float32)
    for i, codes in enumerate(marks):
        present[place[codes], i] = 1 / np.sqrt(len(codes))
    return np.stack([_product([t], place, present)[0] for t in texts]).astype(np.float64)


def training_rows(docs: DataFrame, usable: Column, per_language: int = TEXTS_PER_LANGUAGE) -> DataFrame:
    """``text, lang`` of at most ``per_language`` usable documents of each language (this starts a job).

    Rows without id, text or language are not used, and of rows that share an
    id the least by language and text is.  Rows are counted by octaves of the
    hash first, at most 65 of them a language; those up to the octave in which the
    number is reached hold about twice that number of ids, however many rows a
    language has, and only these ids are ranked, each as one row.
    """
    known = docs.where(usable & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    mark = F.xxhash64("doc_id")
    ids = known.select("doc_id", "lang", F.floor(F.log2(mark.cast("double") + F.lit(2.0**63 + 1))).alias("octave"))
    so_far = F.sum("n").over(Window.partitionBy("lang").orderBy("octave"))
    octaves = ids.groupBy("lang", "octave").agg(F.count(F.lit(1)).alias("n")).withColumn("before", so_far - F.col("n"))
    # A row for each language and octave that is needed.
    octaves = written(octaves.where(F.col("before") < per_language).select("lang", "octave"), "language-octaves")
    counted = ids.join(octaves, ["lang", "octave"]).groupBy("lang", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    rank = F.sum("n").over(Window.partitionBy("lang").orderBy(mark, "doc_id")) - F.col("n")
    chosen = counted.withColumn("before", rank).where(F.col("before") < per_language)
    chosen = written(chosen.select("doc_id", "lang"), "language-ids")
    rows = known.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])
    least = rows.groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("row"))
    return written(least.select("row.text", "row.lang").repartition(1), "language-training")


def train(rows: DataFrame, landmarks: int = LANDMARKS) -> Model:
    """Learn from a bounded number of ``text, lang`` rows, in one task; without rows every text is ``und``."""
    prepare_workers(rows.sparkSession)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = pd.concat([pd.DataFrame({"text": [], "lang": []}), *batches])
        if not len(table):
            return
        table = table.sort_values(["lang", "text"], ignore_index=True)
        model = _fit(list(texts_of(table["text"])), table["lang"].astype(str).to_numpy(), landmarks)
        yield pd.DataFrame(
            {
                "languages": [model.languages],
                "marks": [model.marks],
                "weights": [model.weights.astype(np.float64).tobytes()],
                "bias": [model.bias.astype(np.float64).tobytes()],
            }
        )

    found = rows.repartition(1).mapInPandas(fit, "languages array<string>, marks binary, weights binary, bias binary")
    found = found.first()
    if found is None:
        return Model([], b"", np.empty((0, 0)), np.empty(0))
    languages = list(found["languages"])
    weights = np.frombuffer(found["weights"], np.float64).reshape(-1, len(languages))
    return Model(languages, bytes(found["marks"]), weights, np.frombuffer(found["bias"], np.float64))


def _fit(texts: list[str], labels: np.ndarray, landmarks: int) -> Model:
    languages = sorted(set(labels))
    each = max(1, landmarks // len(languages))
    # The texts of a language are spread over its range of lengths.
    chosen = []
    for language in languages:
        own = sorted(np.flatnonzero(labels == language), key=lambda i: len(texts[i]))
        chosen += [own[i] for i in np.unique(np.linspace(0, len(own) - 1, min(each, len(own))).astype(int))]
    marks = [_grams(texts[i]) for i in chosen]
    values, vectors = np.linalg.eigh(_kernel((texts[i] for i in chosen), marks))
    kept = values > 1e-6 * values.max()
    root = vectors[:, kept] / np.sqrt(values[kept])  # inverse root of the landmarks' kernel
    features = _kernel(texts, marks) @ root
    goals = np.where(labels[:, None] == np.array(languages), 1.0, -1.0)
    middle, level = features.mean(axis=0), goals.mean(axis=0)
    centred = features - middle
    ridge = _RIDGE * len(texts) / len(features[0]) * np.eye(len(features[0]))
    slopes = np.linalg.solve(centred.T @ centred + ridge, centred.T @ (goals - level))
    return Model(languages, _packed(marks), root @ slopes, level - middle @ slopes)


def identify(text: Column, model: Model) -> Column:
    """A struct of ``lang_pred`` and ``score`` for every whole text; null is ``und`` with score 0."""

    @F.pandas_udf("lang_pred string, score double")
    def identified(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for languages, sure in model.predictions(list(texts_of(c)) for c in columns):
            yield pd.DataFrame({"lang_pred": languages, "score": sure})

    return identified(text)


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row; other columns are not looked at."""
    prepare_workers(docs.sparkSession)
    return docs.select("doc_id", identify(F.col("text"), model).alias("found")).select("doc_id", "found.*")


def keep_identified(docs: DataFrame, model: Model, least_score: float = 0.35) -> DataFrame:
    """The rows whose text has a known language with at least ``least_score``, with all their columns.

    Null, empty and letterless texts go; repeated rows get the same answer.  A
    model that learned no language rejects nothing.
    """
    if not model.languages:
        return docs
    prepare_workers(docs.sparkSession)
    return docs.where(identify(F.col("text"), model)["score"] >= least_score)
