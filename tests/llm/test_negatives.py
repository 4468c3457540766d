"""Hard negatives against full sorts of all scores."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalweave.llm import negatives, queries

DATA = "/root/testdata/sf0.1"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, anchors, positives=5, count=5, low=80, high=100):
    """``rows``: (id, label, whole-number vector); anchors: row numbers."""
    dims = max(len(v) for *_, v in rows)
    q = np.array([list(v) + [0] * (dims - len(v)) for *_, v in rows], dtype=object).reshape(len(rows), dims)
    ids, labels, out = [r[0] for r in rows], [r[1] for r in rows], []
    for a in anchors:
        s = [int(sum(q[a] * x)) for x in q]
        order = sorted((i for i in range(len(rows)) if i != a), key=lambda i: (-s[i], ids[i], i))
        for p in [i for i in order if labels[i] == labels[a]][:positives]:
            near = [i for i in order if labels[i] != labels[a] and low * s[p] <= 100 * s[i] <= high * s[p]][:count]
            out += [(ids[a], ids[p], k + 1, ids[i], s[p], s[i]) for k, i in enumerate(near)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select(COLUMNS).collect())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_query(spark):
    v = spark.read.parquet(f"{DATA}/embeddings.parquet").toPandas()
    q = np.floor(np.stack(v.embedding.to_list()).astype(float) * 256).astype(np.int64)
    ids, label = v.vec_id.to_numpy(), np.where(v.vec_id % 7 == 0, (v.label + 1) % 10, v.label)
    want = []
    for i in np.flatnonzero(ids % 100 == 0):
        s = q @ q[i]
        order = np.lexsort((ids, -s))
        order = order[order != i]
        for p in order[label[order] == label[i]][:5]:
            near = order[(label[order] != label[i]) & (80 * s[p] <= 100 * s[order]) & (100 * s[order] <= 100 * s[p])][:5]
            want += [(ids[i], ids[p], k + 1, ids[j], s[p], s[j]) for k, j in enumerate(near)]
    assert found(queries.op12_hard_negatives(spark, DATA)) == sorted(want)


def test_ties_repeats_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 17)
    monkeypatch.setattr(negatives, "ANCHOR_ROWS", 3)
    monkeypatch.setattr(negatives, "CELL", 1)
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(0, 60)), str(rng.integers(0, 3)), [int(x) for x in rng.integers(-2, 4, 3)]) for _ in range(150)]
    rows += [(int(k), "1", [1, 1, 1]) for k in range(60, 100)]  # one very common vector
    rows.sort()
    data = [(i, lab, [x / 256 for x in v], 1) for i, lab, v in rows]
    df = spark.createDataFrame(data, "vec_id long, label string, embedding array<double>, rank int").coalesce(1)
    for shape in ({}, {"positives": 2, "negatives": 3, "low": 50, "high": 90}):
        got = found(negatives.mine(df, F.col("vec_id") % 5 == 0, **shape))
        anchors = [k for k, r in enumerate(rows) if r[0] % 5 == 0]
        want = brute(rows, anchors, shape.get("positives", 5), shape.get("negatives", 5), shape.get("low", 80), shape.get("high", 100))
        assert got == want and got


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    data = [(100, "a", [1.0, 0.0]), (1, "a", [1.0]), (2, "b", [0.9, 0.5]), (3, "b", [0.8]), (4, None, [1.0, 1.0]), (5, "b", None), (6, "b", [nan, 1.0]),
            (7, "b", [1.0, None]), (8, "b", [inf, 1.0]), (None, "b", [1.0, 0.0]), (200, "c", [1.0, 0.0]), (300, "d", [])]
    df = spark.createDataFrame(data, "vec_id long, label string, embedding array<double>")
    got = found(negatives.mine(df, F.col("vec_id") % 100 == 0))
    assert got == [(100, 1, 1, 200, 65536, 65536), (100, 1, 2, 2, 65536, 58880), ]
    assert found(negatives.mine(df, F.col("vec_id") < 0)) == [] == found(negatives.mine(df.where("1 = 0"), F.col("vec_id") % 100 == 0))
    for wrong in ({"low": 90, "high": 80}, {"high": 120}):
        with pytest.raises(ValueError):
            negatives.mine(df, F.col("vec_id") % 100 == 0, **wrong)


def test_exact_products_of_large_numbers():
    a = np.array([[3 * 10**8, -1], [1, 1]])
    assert negatives.products(a, a).tolist() == [[9 * 10**16 + 1, 3 * 10**8 - 1], [3 * 10**8 - 1, 2]]
    with pytest.raises(ValueError):
        negatives.products(a * 100, a * 100)
