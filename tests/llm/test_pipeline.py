"""The pipeline from end to end and its stages on edge cases, against plain versions."""

import base64
import os
from collections import Counter, defaultdict

import pytest
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from evalweave.llm import near, secrets, toxicity

DATA = "/root/testdata/sf0.01"


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))) if words else frozenset()


def kept_by_brute_force(rows):
    """Ids that stay of rows (id, text): the smallest of each component of likeness 0.8 or more."""
    by_set = defaultdict(list)
    for i, t in rows:
        by_set[shingles(t)].append(i)
    sets = list(by_set)
    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for k, s in enumerate(sets):
        for other, both in Counter(j for x in s for j in holders[x] if j < k).items():
            if both / (len(s) + len(sets[other]) - both) >= 0.8:
                up[find(k)] = find(other)
    least = {}
    for k, s in enumerate(sets):
        least[find(k)] = min([least.get(find(k), by_set[s][0]), *by_set[s]])
    return set(least.values())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_run(spark):
    import tiktoken

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    scored = toxicity.classify(docs.select("doc_id", "text"), spark.read.parquet(f"{DATA}/labels.parquet"))
    clean = [(r.doc_id, r.text) for r in scored.where("predicted = 0").select("doc_id", "text").collect()]
    want = kept_by_brute_force(clean)
    assert len(want) < len(clean) < docs.count()
    out = corpus_pipeline.run(spark, DATA).toPandas()
    assert sorted(out.doc_id) == sorted(want) and out.round_trip.all()
    assert sorted(out.position) == list(range(len(out))) and list(out.n_tokens) == [len(i) for i in out.ids]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    masked = {r.doc_id: r.text for r in secrets.redact(docs.where(F.col("doc_id").isin(sorted(want)))).select("doc_id", "text").collect()}
    original, changed = dict(clean), 0
    for r in out.itertuples():
        text = enc.decode_bytes(list(map(int, r.ids))).decode()
        assert text == masked[r.doc_id] and list(r.ids) == enc.encode_ordinary(text)
        changed += text != original[r.doc_id]
    assert 0 < changed < len(out) / 2
    # Sources alternate: the first rows hold many sources, as the schedule has it.
    head = out.sort_values("position").head(len(out) // 4)
    assert head.source.nunique() >= min(5, out.source.nunique())


ROWS = [(1, "a b c d e f g", "en", "s", 13), (1, "a b c d e f g", "en", "s", 13), (2, None, None, None, None), (None, "", "en", "s", 0),
        (3, "password=exampleexample1 x", "en", "t", 26)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["position", "score", "predicted", "row", "key", "spans", "size", "fp", "label"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_edges(spark, name, stage):
    """An empty table, NULLs, repeats and columns named as the stage's own."""
    docs = spark.createDataFrame(ROWS, SCHEMA)
    wide = docs.withColumns({c: F.lit(7) for c in CLASHES})
    empty = stage(spark, wide.where("1 = 0"), DATA)
    assert empty.count() == 0
    out = stage(spark, wide, DATA)
    rows = out.collect()
    if name == "tokens":
        assert len(rows) == 5 and all(r.round_trip for r in rows) and sorted(r.position for r in rows) == list(range(5))
        return
    assert out.columns == wide.columns and all(r[c] == 7 for r in rows for c in CLASHES)
    assert sorted((r.doc_id or 0) for r in rows) == ([1, 2, 3] if name == "near_copies" else [0, 1, 1, 2, 3])


def test_pages_of_one_template(spark):
    """Wide buckets of pages that share half of their words: no page is lost, near copies among them are found."""
    frame = [f"frame{i}" for i in range(120)]
    texts = []
    for k in range(60):
        own = [f"own{k}x{i}" for i in range(90)]
        texts.append(frame + own)
        if k % 6 == 0:  # a near copy of a page
            texts.append(frame + own[:45] + ["changed"] + own[46:])
    # Sets that share most words pairwise, but are not alike: the rarest shingles are shared, too.
    pool = [[f"p{j}w{i}" for i in range(30)] for j in range(12)]
    for a in range(12):
        for b in range(a):
            texts.append([w for j in range(12) if j not in (a, b) for w in pool[j]] + [f"z{a}y{b}i{i}" for i in range(60)])
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in near.keep_one(docs).collect()}
    assert kept == kept_by_brute_force(rows) and len(kept) < len(rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_near_copies_of_the_given_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {r.doc_id for r in near.keep_one(docs).collect()}
    assert kept == kept_by_brute_force([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
