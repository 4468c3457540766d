"""The quality classifier: steps against the plain formula, held-out accuracy, edges."""

import os
import zlib

import numpy as np
import pytest

from evalweave.llm import quality, queries

DATA = "/root/testdata/sf0.1"


def test_steps_against_the_plain_formula(monkeypatch):
    monkeypatch.setattr(quality, "DIMENSIONS", 6)
    rng = np.random.default_rng(2)
    samples = [(np.sort(rng.choice(6, 3, replace=False)), rng.random(3), int(rng.random() < 0.5)) for _ in range(40)]
    z, n = [0.0] * 7, [0.0] * 7

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * quality.L1) / ((quality.BETA + n[i] ** 0.5) / quality.ALPHA + quality.L2)

    for _ in range(quality.EPOCHS):
        for at, value, label in samples:
            x = [*zip(at, value), (6, 1.0)]
            w = {i: weight(i) for i, _ in x}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in x)))
            for i, v in x:
                g = (p - label) * v
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / quality.ALPHA * w[i]
                n[i] += g * g
    weights, bias = quality.train(samples)
    assert np.allclose([*weights, bias], [weight(i) for i in range(7)])


def features(text):
    n, of, at, value = next(quality.Hasher()([text]))
    assert n == 1 and not of.any() and (np.diff(at) > 0).all()
    return set(at.tolist()), value


def test_features(monkeypatch):
    at, value = features("One one TWO two?? 12")
    assert np.isclose((value**2).sum(), 1) and 0 <= min(at) and max(at) < quality.DIMENSIONS
    assert features(None)[0] == features(" \n")[0] == set()
    assert len(features("Wow!!")[0] & features("Hey!")[0]) == 1  # the shape
    assert len(features("no no")[0] & features("ça ça")[0]) == 1  # the repetition
    texts = ["a b", None, "c " * 50, "", "a b c d"] * 30
    whole = list(quality.Hasher()(texts))
    monkeypatch.setattr(quality, "TOGETHER", 60)
    parts = list(quality.Hasher()(texts))
    assert len(whole) == 1 < len(parts) and sum(p[0] for p in parts) == len(texts)
    assert np.array_equal(whole[0][2], np.concatenate([p[2] for p in parts])) and np.array_equal(whole[0][3], np.concatenate([p[3] for p in parts]))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_query(spark):
    got = queries.op13_quality(spark, DATA).toPandas()
    labels = spark.read.parquet(f"{DATA}/labels.parquet").toPandas()
    assert len(got) == spark.read.parquet(f"{DATA}/documents.parquet").count() and got.score.between(0, 1).all()
    assert list(got.held_out) == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]
    assert list(got.predicted) == [int(s >= 0.3) for s in got.score]
    both = got.merge(labels, on="doc_id")
    both = both[both.held_out]
    good, poor = both[both.quality == 1], both[both.quality == 0]
    assert len(poor) > 50 and good.predicted.mean() > 0.99 and poor.predicted.mean() < 0.1
    assert (good.score.to_numpy()[:, None] > poor.score.to_numpy()).mean() > 0.99


def test_held_out_labels_teach_nothing(spark):
    out = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]
    docs = spark.createDataFrame([(i, f"text {i}", 0.1) for i in range(200)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in out], "doc_id long, quality int")
    assert {r.score for r in quality.classify(docs, labels).select("score").collect()} == {0.5}


def test_edges(spark):
    data = [(1, "good text here", "x"), (2, "BAD!! BAD!!", "y"), (2, "BAD!! BAD!!", "y"), (None, None, None), (3, "", "z"), (4, "w " * 60_000, "z")]
    docs = spark.createDataFrame(data, "doc_id long, text string, predicted string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1), (4, 7), (99, 1)], "doc_id long, quality int")
    got = quality.classify(docs, labels)
    assert got.count() == 6 and got.where("score between 0 and 1").count() == 6 and set(docs.columns) <= set(got.columns)
    assert quality.classify(docs.where("1 = 0"), labels).count() == 0
    assert {r.predicted for r in quality.classify(docs, labels.where("quality = 1")).collect()} == {1}
