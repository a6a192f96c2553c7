"""Quality by supervised subword embeddings: averaged word and character n-gram vectors, softmax, numpy SGD."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from msgrisk.llm import ngrams
from msgrisk.llm.shared import labelled_sample

SAMPLE_PER_CLASS = 1500     # labelled rows of each class that a fit reads
BUCKETS = 1 << 16           # rows of the embedding table; their numbers fit 16 bits
DIMENSIONS = 8
EPOCHS = 8
RATE = 0.5
REPEAT_WEIGHT = 8           # features that a repeated word counts as
SIZES = (3, 4, 5)           # of character n-grams
EMPTY, REPEATED = 0, 1      # buckets of a text without words, and of the bigram of a word with itself
_OWN = 2                    # buckets that no hash meets
_DIGITS = str.maketrans("123456789", "000000000")


def buckets(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of all features of a text, by stretches of words: each word, the character n-grams of 3 to 5
    letters with its ends marked, and one for each word that follows itself.  Digits are alike."""
    words = (text or "").lower().translate(_DIGITS).split()
    if not words:
        yield np.array([EMPTY])
    last = None
    for some in ngrams.chunks(words):
        codes = ngrams.codes_of(some)
        hashes = ngrams.word_hashes(codes)
        grams = [hashes, *(ngrams.gram_hashes(codes, n)[0] for n in SIZES)]
        yield np.concatenate(grams).astype(np.int64) % (BUCKETS - _OWN) + _OWN
        repeats = int((hashes[1:] == hashes[:-1]).sum()) + (some[0] == last)
        last = some[-1]
        if repeats:
            yield np.full(repeats * REPEAT_WEIGHT, REPEATED)


@dataclass
class QualityModel:
    """Scores of the feature buckets for each class, which is what the averaged vectors and the softmax weights give."""

    weights: np.ndarray        # bucket x class
    offset: np.ndarray
    classes: tuple[str, ...]

    def probability(self, text: str | None, wanted: str) -> float:
        """Probability of a class; 0.5 for a model without classes, 0 for a class that it doesn't know."""
        if wanted not in self.classes:
            return 0.0 if self.classes else 0.5
        total, size = np.zeros(len(self.classes)), 0
        for ids in buckets(text):
            total += np.array([column[ids].sum() for column in self.weights.T])
            size += len(ids)
        z = total / size + self.offset
        z = np.exp(z - z.max())
        return float(z[self.classes.index(wanted)] / z.sum())


def _features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text and their shares."""
    ids, counts = np.unique(np.concatenate(list(buckets(text))), return_counts=True)
    return ids, (counts / counts.sum()).astype(np.float32)


def fit(texts: list[str], labels: list[str], seed: int = 7) -> QualityModel:
    """Train embedding table and softmax weights by stochastic gradient descent, every class weighing alike."""
    classes = tuple(sorted(set(labels)))
    if len(classes) < 2:
        return QualityModel(np.zeros((BUCKETS, len(classes))), np.zeros(len(classes)), classes)
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    out, offset = np.zeros((DIMENSIONS, len(classes)), np.float32), np.zeros(len(classes), np.float32)
    ids_of, values_of, ends = bytearray(), bytearray(), [0]     # all rows one after another, in few bytes each
    for text in texts:
        ids, values = _features(text)
        ids_of += ids.astype("<u2").tobytes()
        values_of += values.tobytes()
        ends.append(ends[-1] + len(ids))
    all_ids, all_values = np.frombuffer(ids_of, "<u2"), np.frombuffer(values_of, np.float32)
    marks = np.array([classes.index(x) for x in labels])
    share = len(marks) / (len(classes) * np.bincount(marks, minlength=len(classes)))
    steps, done = EPOCHS * len(marks), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(marks)):
            ids, values = all_ids[ends[i] : ends[i + 1]], all_values[ends[i] : ends[i + 1]]
            vector = values @ table[ids]
            z = vector @ out + offset
            error = np.exp(z - z.max())
            error /= error.sum()
            error[marks[i]] -= 1
            error *= share[marks[i]] * RATE * (1 - done / steps)
            done += 1
            back = out @ error
            out -= np.outer(vector, error)
            offset -= 0.1 * error
            # a feature's step follows its share of the text, raised so that rare features learn too
            table[ids] -= np.outer(np.sqrt(values), back)
    return QualityModel(np.asfortranarray(table @ out, np.float64), offset.astype(np.float64), classes)


def learn(docs: DataFrame, labels: DataFrame, usable: Column, per_class: int = SAMPLE_PER_CLASS) -> QualityModel:
    rows = labelled_sample(docs, labels, "quality", per_class, usable)
    return fit(rows["text"].tolist(), rows["label"].tolist())


def scored(docs: DataFrame, model: QualityModel, wanted: str = "1", column: str = "quality_score") -> DataFrame:
    """``docs`` with the probability of the wanted label in ``column``; 0.5 without any labelled row.

    A column of that name is replaced, all others stay.  Null, empty and blank texts have one feature of their
    own, so they get one score, whatever it is.  Long texts are read whole, repeated rows scored alike.
    """

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([model.probability(t, wanted) for t in texts], dtype="float64")

    return docs.withColumn(column, score(F.col("text")))
