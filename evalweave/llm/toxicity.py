"""Toxicity by compression distance: two zstandard dictionaries, windows, a calibrated threshold.

Zstandard saves only a byte or two on a short word, less than the noise of the words around it
(measured: the area under the curve stays below 0.67 on plain text).  So every distinct word of a
text is written as two 16-byte codes, the hashes of the word and of its first four letters; a code
costs 16 bytes where a dictionary lacks it and about three where it has it.  Both dictionaries hold
the codes of the common words at the same places, followed by the codes over-represented in the
toxic or in the ordinary sample.  A window of words has the margin "length with the ordinary
dictionary less length with the toxic one"; the largest window margin and the sum of the positive
ones go through a logistic calibration, fitted on sampled texts that trial dictionaries have not seen.

The fit uses at most SAMPLE texts of each label and COMMON + CONTRAST codes per dictionary: trial
dictionaries of one half are calibrated on the other half, the final ones learn from both.  Scoring
reads every word of every text.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalweave.llm.common import bounded_sample, held_out, small_batches
from evalweave.plans.shared import cut

SAMPLE = 8192
COMMON = 4096
CONTRAST = 1024
CODE = 16
WINDOW = 16
LEVEL = 3
STEM = 4
RATIO = 10.0
EVIDENCE = 20.0
EVIDENCE_SHARE = 0.04
THRESHOLD = 0.7
CACHE = 200_000
# The ASCII characters that do not belong to a word, as a table to blanks.
_BLANKS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Distinct lower-case words in order of first appearance, as UTF-8."""
    return list(dict.fromkeys((text or "").lower().encode("utf-8", "surrogatepass").translate(_BLANKS).split()))


def features(word: bytes) -> tuple[bytes, bytes]:
    return word, word.decode("utf-8", "surrogatepass")[:STEM].encode("utf-8", "surrogatepass") + b"~"


def code(feature: bytes) -> bytes:
    return xxhash.xxh3_128_digest(feature)[:CODE]


@dataclass(frozen=True)
class Model:
    """Two dictionaries and the calibration: score = sigmoid(bias + weights . features)."""

    toxic: bytes
    ordinary: bytes
    weights: tuple[float, float]
    bias: float


class Meter:
    """Window margins of texts under one pair of dictionaries."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.codes: dict[bytes, bytes] = {}
        self.sides = []
        for content in (ordinary, toxic):
            words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(level=LEVEL)
            self.sides.append(zstandard.ZstdCompressor(
                level=LEVEL, dict_data=words, write_content_size=False, write_dict_id=False).compress)

    def __call__(self, text: str | None) -> tuple[float, float]:
        """(largest margin, sum of positive margins) in codes; (0, 0) without words."""
        if len(self.codes) > CACHE:
            self.codes.clear()
        coded = []
        for w in words_of(text):
            both = self.codes.get(w)
            if both is None:
                both = self.codes[w] = b"".join(map(code, features(w)))
            coded.append(both)
        ordinary, toxic = self.sides
        most = total = 0
        for k in range(0, len(coded), WINDOW):
            window = b"".join(coded[k : k + WINDOW])
            margin = len(ordinary(window)) - len(toxic(window))
            most, total = max(most, margin), total + max(margin, 0)
        return most / CODE, total / CODE


def _vector(most: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.stack([np.minimum(most, 8.0), np.log1p(total)], axis=1)


def _margins(toxic: bytes, ordinary: bytes):
    @F.pandas_udf("most double, total double")
    def measured(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        meter = Meter(toxic, ordinary)
        for texts in parts:
            yield pd.DataFrame([meter(t) for t in texts], columns=["most", "total"], dtype=float)
    return measured


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def _features(texts: pd.Series) -> pd.Series:
    return pd.Series([list({f for w in words_of(t) for f in features(w)}) for t in texts])


def _dictionary(common: list[bytes], own: list[bytes], name: str) -> bytes:
    filler = [b"%s %d" % (name.encode(), i) for i in range(CONTRAST - len(own))]  # codes no word has
    return b"".join(map(code, [*common[::-1], *filler, *own[::-1]]))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + keep + 1e-9 * np.eye(len(w)), x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(rows: DataFrame) -> Model:
    """Learn from rows (text, label): label 1 toxic, 0 ordinary, other labels and NULLs ignored.

    With one label only, the score is constant: 1 for toxic alone, else 0.
    """
    small_batches(rows.sparkSession)
    sample = cut(bounded_sample(rows.where("label in (0, 1)"), SAMPLE))
    sizes = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Model(b"", b"", (0.0, 0.0), 30.0 if sizes.get(1) and not sizes.get(0) else -30.0)
    half = F.pmod(F.xxhash64("draw"), F.lit(2))
    trial = _dictionaries(sample.where(half == 0))
    seen = sample.where(half == 1).select("label", _margins(*trial)("text").alias("m")).select("label", "m.*").toPandas()
    weights = _logistic(_vector(seen["most"].to_numpy(), seen["total"].to_numpy()), seen["label"].to_numpy(float)) if len(
        seen) else np.array([4.0, 0.0, -4.0])
    return Model(*_dictionaries(sample), (float(weights[0]), float(weights[1])), float(weights[2]))


def _dictionaries(sample: DataFrame) -> tuple[bytes, bytes]:
    """The toxic and the ordinary dictionary of sampled rows (text, label)."""
    sizes = {r[0]: float(r[1]) for r in sample.groupBy("label").count().collect()}
    n, m = sizes.get(1, 0.5), sizes.get(0, 0.5)
    found = cut(sample.select("label", F.explode(_features("text")).alias("f")).groupBy("f").agg(
        F.sum("label").cast("double").alias("a"), F.sum(1 - F.col("label")).cast("double").alias("b")))

    def over(mine: str, other: str, n: float, m: float) -> list[bytes]:
        """The features over-represented in one sample, strongest first (log-likelihood ratio).

        EVIDENCE keeps out chance in small samples, EVIDENCE_SHARE of the strongest one the words of
        texts with many near copies in large ones.
        """
        x, y, all_ = F.col(mine), F.col(other), F.col(mine) + F.col(other)
        part = lambda v, share: F.when(v > 0, v * F.log(v / (all_ * share))).otherwise(0.0)
        weight = 2 * (part(x, n / (n + m)) + part(y, m / (n + m)))
        top = found.withColumn("g", weight).where(
            (F.col("g") > EVIDENCE) & (x / n > RATIO * (y + 0.5) / m)).orderBy(F.desc("g"), "f").limit(CONTRAST)
        best = top.select("f", "g").collect()
        return [bytes(r.f) for r in best if r.g > EVIDENCE_SHARE * best[0].g]

    own, other = over("a", "b", n, m), over("b", "a", m, n)
    skip = set(own) | set(other)
    top = found.orderBy(F.desc(F.col("a") + F.col("b")), "f").limit(COMMON + 2 * CONTRAST)
    common = [f for f in (bytes(r.f) for r in top.select("f").collect()) if f not in skip][:COMMON]
    return _dictionary(common, own, "toxic"), _dictionary(common, other, "ordinary")


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add the toxicity score (0 to 1) of a text column; NULL and wordless texts score as no evidence.

    A column named ``out`` is replaced; all rows and other columns stay as they are.
    """
    small_batches(docs.sparkSession)
    # two dictionaries of (COMMON + CONTRAST) * CODE bytes
    shared = docs.sparkSession.sparkContext.broadcast((model.toxic, model.ordinary, model.weights, model.bias))

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        toxic, ordinary, weights, bias = shared.value
        meter = Meter(toxic, ordinary) if toxic else None
        for texts in parts:
            margins = np.array([meter(t) for t in texts], dtype=float).reshape(-1, 2) if meter else np.zeros((len(texts), 2))
            z = _vector(margins[:, 0], margins[:, 1]) @ np.array(weights) + bias
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return docs.withColumn(out, scored(F.col(text)))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, label) of the documents whose labels may be learned; ids join, texts stay in place.

    The labels meet a narrow (id, text hash) list first; only the sampled texts are read again.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").alias("label"))
    marked = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("draw")).join(known, "doc_id")
    chosen = marked.groupBy("label", F.pmod("draw", F.lit(SAMPLE)).alias("bucket")).agg(F.min("draw").alias("draw"))
    # two labels of SAMPLE rows
    fixed = cut(chosen.select("label", "draw"))
    return docs.where(F.col("text").isNotNull()).select("text", F.xxhash64("text").alias("draw")).join(
        F.broadcast(fixed), "draw").groupBy("label", "draw").agg(F.min("text").alias("text")).select("text", "label")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents with score and predicted (1 at THRESHOLD or above), learned from ``labels``.

    doc_id, text and the other columns stay; columns named score or predicted are replaced.
    Repeated ids take any of their labels; documents without label are scored like all others.
    """
    model = fit(training_rows(docs, labels))
    return score(docs, model).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
