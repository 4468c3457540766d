"""Periodic runs against a search over all periods."""

import hashlib
import os
import zlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalweave.llm import queries, runs

DATA = "/root/testdata/sf0.01"


def brute(words, least=12):
    """(start, length, period) by start, then period."""
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1) if j == i else j + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), min_size=1, max_size=5), st.sampled_from([2, 3, 5, 12]))
def test_small_alphabets(texts, least):
    bounds = np.cumsum([len(t) for t in texts])
    got = [[] for _ in texts]
    for s, n, q in zip(*runs.find(np.array(sum(texts, []), dtype=np.int64), bounds, least)):
        k = int(np.searchsorted(bounds, s, side="right"))
        got[k].append((int(s - bounds[k] + len(texts[k])), int(n), int(q)))
    assert [sorted(g, key=lambda r: (r[0], r[2])) for g in got] == [sorted(brute(t, least), key=lambda r: (r[0], r[2])) for t in texts]


def test_very_long_texts():
    texts = pd.Series(["a " * 300_000, " ".join(["x y z"] * 100_000) + " w", None, ""])
    got = [(list(map(tuple, zip(s, n, q))), t) for s, n, q, t in runs.judged(texts)]
    assert got == [([(0, 300_000, 1)], "a"), ([(0, 300_000, 3)], "x y z w"), ([], ""), ([], "")]


def test_edges(spark):
    data = [(1, "a b " * 8, "x"), (1, "a b " * 8, "x"), (None, None, "x"), (2, "", None), (3, " \t\n", "x"), (4, "é É é É é É é É é É é É", "y")]
    docs = spark.createDataFrame(data, "doc_id long, text string, runs string")
    got = sorted((r.doc_id or 0, [tuple(x) for x in r.runs], r.collapsed) for r in runs.with_runs(docs).collect())
    assert got == [(0, [], ""), (1, [(0, 16, 2)], "a b"), (1, [(0, 16, 2)], "a b"), (2, [], ""), (3, [], ""), (4, [(0, 12, 2)], "é É")]
    assert runs.with_runs(docs.where("1 = 0")).count() == 0 and set(docs.columns) <= set(runs.with_runs(docs).columns)
    assert runs.with_runs(docs.where("doc_id = 1").limit(1), least=17).first().runs == []
    with pytest.raises(ValueError):
        runs.with_runs(docs, least=1)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").where(F.length("text") < 8000).toPandas()
    got = queries.op11_runs(spark, DATA).toPandas().set_index("doc_id")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    some = 0
    for d in docs.itertuples():
        words, h = d.text.encode().split(), zlib.crc32(str(d.doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = sorted(brute(words), key=lambda r: (r[0], r[2]))
        row = got.loc[d.doc_id]
        assert (row.n_runs, row.runs_sha256) == (len(found), sha("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()))
        assert row.collapsed_sha256 == sha(b" ".join(collapsed(words, found)))
        if found:
            some += 1
            s, m, q = min(found, key=lambda r: (-r[1], r[0], r[2]))
            assert (row.start, row.length, row.period, row.exponent_milli) == (s, m, q, 1000 * m // q)
        else:
            assert pd.isna(row.start) and pd.isna(row.exponent_milli)
    assert some > 50
