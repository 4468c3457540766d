"""Quality by logistic regression over hashed word n-grams, trained with FTRL-proximal updates.

Features of a text are its words and pairs of neighbouring words, lower-cased, the shapes of words and of
such pairs (a letter case, digit or sign stands once for a row of its kind), and whether a pair repeats one
word, all hashed to DIMENSIONS weights.  A feature that makes up the share f of them has the value sqrt(f),
so every text has length one.  The weights come from EPOCHS passes of follow-the-regularised-leader steps (McMahan et al., "Ad click prediction: a view
from the trenches", 2013) over at most SAMPLE texts of each label, in the order of their hashes; they
go on as the few thousand that L1 leaves.  Scoring takes the sparse dot product of every whole text.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.llm.common import labelled_sample, small_batches

BITS = 20
DIMENSIONS = 1 << BITS
SAMPLE = 4096
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.02
THRESHOLD = 0.3
CACHE = 200_000
TOGETHER = 200_000  # words whose features are sorted together
_MIX = np.uint64(0x9E3779B97F4A7C15)
# Words have letters as a, A and, beyond ASCII, u; digits as 0; all other characters stay.
_KINDS = bytes(ord("u") if c >= 128 else ord("a") if chr(c).islower() else ord("A") if chr(c).isupper() else ord("0") if chr(c).isdigit() else c
               for c in range(256))
_ROW = re.compile(rb"(.)\1+", re.S)


class _Words(dict):
    """Numbers of words; ``table`` has the hashes of the word and of its shape under each number."""

    def __init__(self) -> None:
        super().__init__()
        self.table = np.empty((CACHE, 2), dtype=np.uint64)

    def __missing__(self, word: bytes) -> int:
        number = len(self)
        if number == len(self.table):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        shape = _ROW.sub(rb"\1", word.translate(_KINDS))
        self.table[number] = xxhash.xxh64_intdigest(word.lower(), 1), xxhash.xxh64_intdigest(shape, 2)
        self[word] = number
        return number


class Hasher:
    """Features of texts; the hashes of words are kept between calls."""

    def __init__(self) -> None:
        self.words = _Words()

    def __call__(self, texts: Iterable[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(texts, text number, feature, value) of consecutive parts, by text and feature."""
        held: list[bytes] = []
        sizes: list[int] = []
        for text in texts:
            own = (text or "").encode("utf-8", "surrogatepass").split()
            if sizes and (len(held) + len(own) > TOGETHER or len(sizes) == 1 << 31 - BITS):
                yield self._features(held, sizes)
                held, sizes = [], []
            held += own
            sizes.append(len(own))
        if sizes:
            yield self._features(held, sizes)

    def _features(self, words: list[bytes], sizes: list[int]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        if len(self.words) > CACHE:
            self.words = _Words()
        numbers = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        single = self.words.table[numbers]
        text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        inside = text[:-1] == text[1:]
        left, right = single[:-1][inside], single[1:][inside]
        mixed = np.concatenate([single[:, 0], single[:, 1], *((left * _MIX) ^ right).T * _MIX, (left[:, 0] == right[:, 0]).astype(np.uint64)])
        of = np.concatenate([text, text, *[text[1:][inside]] * 3])
        keys = np.sort((of << BITS) | ((mixed * _MIX) >> np.uint64(64 - BITS)).astype(np.int32))
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        counts, keys = np.diff(np.append(first, len(keys))), keys[first]
        of = keys >> BITS
        share = counts / np.bincount(of, weights=counts, minlength=len(sizes))[of]
        return len(sizes), of, keys & (DIMENSIONS - 1), np.sqrt(share).astype(np.float32)


def leader(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The weights that minimise the regularised sum so far."""
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def train(samples: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, float]:
    """(weights, bias) after EPOCHS passes over (feature numbers, values, label 0 or 1) in the order given."""
    z, n = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)
    for _ in range(EPOCHS):
        for features, values, label in samples:
            at = np.append(features, DIMENSIONS)  # the last is the bias
            value = np.append(values, 1.0)
            w = leader(z[at], n[at])
            g = (1 / (1 + np.exp(-np.clip(w @ value, -30, 30))) - label) * value
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = leader(z, n)
    return w[:-1], float(w[-1])


def fit(sample: DataFrame) -> DataFrame:
    """(feature, weight): the weights that are not 0, the bias under DIMENSIONS, from rows (label, draw, text).

    The rows are a bounded sample (``labelled_sample``); tasks hash them, one task takes the steps.  With
    one label only the bias learns; without rows the table has a bias of 0.
    """
    small_batches(sample.sparkSession)

    @F.pandas_udf("at array<int>, value array<float>")
    def hashed(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for texts in parts:
            out = []
            for n, of, features, values in hasher(texts):
                ends = np.searchsorted(of, np.arange(1, n))
                out += zip(np.split(features, ends), np.split(values, ends))
            yield pd.DataFrame(out, columns=["at", "value"], dtype=object)

    def learned(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [r for part in parts for r in zip(part["draw"], part["label"], part["at"], part["value"])]
        rows.sort(key=lambda r: (r[0], r[1]))
        one = len({label for _, label, _, _ in rows}) < 2
        weights, bias = train([(at[:0] if one else at, value[:0] if one else value, int(label)) for _, label, at, value in rows])
        found = np.flatnonzero(weights)
        yield pd.DataFrame({"feature": np.append(found, DIMENSIONS), "weight": np.append(weights[found], bias)})

    ready = sample.select("label", "draw", hashed("text").alias("f")).select("label", "draw", "f.*")
    return ready.coalesce(1).mapInPandas(learned, "feature int, weight double")  # at most SAMPLE rows a label


def score(docs: DataFrame, model: DataFrame, text: str = "text", out: str = "score") -> DataFrame:
    """Add the quality score (0 to 1, higher: label 1 likelier) of a text column.

    NULL and blank texts score as the bias says.  A column named ``out`` is replaced; all rows and other
    columns stay as they are; an empty table gives none.
    """
    small_batches(docs.sparkSession)
    table = {r.feature: r.weight for r in model.collect()}  # at most DIMENSIONS + 1 numbers
    bias = table.pop(DIMENSIONS, 0.0)
    shared = docs.sparkSession.sparkContext.broadcast((np.array(list(table), dtype=np.int32), np.array(list(table.values()), dtype=np.float32), bias))

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features, values, bias = shared.value
        weights = np.zeros(DIMENSIONS, dtype=np.float32)
        weights[features] = values
        hasher = Hasher()
        for texts in parts:
            z = np.concatenate([np.zeros(0), *(bias + np.bincount(of, weights=weights[features] * values, minlength=n)
                                               for n, of, features, values in hasher(texts))])
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return docs.withColumn(out, scored(F.col(text)))


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the ids that no label may be learned from (NULL ids included)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """Documents with held_out, score and predicted (1 at THRESHOLD or above), learned from ``labels``.

    Only labels 0 and 1 of ids that are not held out teach.  All columns stay; those named held_out, score
    or predicted are replaced.  Repeated ids take each of their labels; a text with both teaches both.
    """
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col(label).alias("label"))
    model = fit(labelled_sample(docs, known, SAMPLE, doc_id, text))
    return score(docs, model, text).withColumns({
        "held_out": held_out(F.col(doc_id)), "predicted": (F.col("score") >= THRESHOLD).cast("int")})


cloudpickle.register_pickle_by_value(sys.modules[__name__])
