"""Planted cases for the parts of the job that the corpus operators once left out."""

import math
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from evalweave.llm import mixing, near, secrets, topk
import corpus_pipeline


def likeness(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def kept_by_brute_force(texts):
    """Smallest index of every component of likeness 0.8 or more."""
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in combinations(range(len(texts)), 2):
        if likeness(texts[i], texts[j]) >= near.LIKE:
            a, b = sorted((find(i), find(j)))
            up[b] = a
    return sorted({find(i) for i in range(len(texts))})


def test_near_copies_of_a_few_changed_words(spark):
    """Single copies, a dense group and a chain, against all pairs."""
    rng = random.Random(4)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]

    def edited(base, n):
        out = list(base)
        for k in rng.sample(range(len(out)), n):
            out[k] = f"x{rng.randrange(10**6)}"
        return out

    texts = []
    for changes in (1, 2, 3, 4, 5, 6, 8, 12):  # 248 words: on both sides of 0.8
        base = words(248)
        texts += [base, edited(base, changes)]
    hot = words(100)
    texts += [edited(hot, 1) for _ in range(60)]
    link = words(200)
    for _ in range(12):  # every text is near its neighbours only
        texts.append(link)
        link = edited(link, 2)
    texts = [" ".join(t) for t in texts]
    rng.shuffle(texts)
    want = kept_by_brute_force(texts)
    assert len(texts) - len(want) > 70
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == want


def test_near_copies_edges(spark):
    five = "one two three four five"
    docs = spark.createDataFrame(
        [(3, five), (2, "One  two three\nfour five"), (None, five), (4, None), (5, " \t"), (6, "one two"), (7, "one two three")], "doc_id long, text string")
    kept = near.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 4, 6, 7]
    assert near.keep_one(docs.where("doc_id is null")).count() == 1 and near.keep_one(docs.where("1 = 0")).count() == 0


def test_tokens_know_their_place_in_the_mix(spark, tmp_path):
    """Files that a reader packs out of order still give the schedule's position."""
    rng = random.Random(2)
    data = [(i, " ".join(["word"] * rng.randrange(1, 300)), "abc"[min(i % 7, 2)]) for i in range(3000)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    want = {r.doc_id: r.position for r in mixing.order(docs).collect()}
    path = str(tmp_path / "mixed")
    corpus_pipeline.mix_sources(spark, docs, "").write.parquet(path)
    got = corpus_pipeline.tokenize(spark, spark.read.parquet(path), "").collect()
    assert {r.doc_id: r.position for r in got} == want and len(got) == 3000
    assert {r.doc_id: r.position for r in mixing.stored_position(mixing.mixed(docs)).collect()} == want


def test_many_files_in_numeric_order(spark, tmp_path):
    path = str(tmp_path / "parts")
    spark.range(0, 500, 1, 25).selectExpr("id as doc_id").write.parquet(path)
    got = mixing.stored_position(spark.read.parquet(path)).collect()
    assert len(got) == 500 and all(r.doc_id == r.position for r in got)


KEY = "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY"
JWT = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9PlFUP0THsR8U"


def owned(spark, texts):
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    spans = {r.doc_id: r.spans for r in secrets.scan(docs).collect()}
    masked = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    return [([texts[i][s.start : s.stop] for s in spans[i]], masked[i]) for i in range(len(texts))]


def test_tokens_beside_equals_signs_and_dots(spark):
    padded = "QWxhZGRpbjpvcGVuIHNlc2FtZTEyMw=="
    frames = [("aws_secret_access_key={}", KEY), ("auth={};", KEY), ("https://a.example.org/x?sig={}&y=1", KEY), ("use {} now", padded),
              ("hash={}", padded), ("Bearer {}", JWT), ("It was {}.", KEY), ("It was {}. Next", JWT), ("see .{}", KEY), ("v=\"{}\"", padded)]
    got = owned(spark, [f.format(v) for f, v in frames])
    assert got == [([v], f.format("[SECRET]")) for f, v in frames]


def test_names_addresses_and_long_runs_are_no_tokens(spark):
    texts = ["MyService2ClientKeyOfProduction=short", "https://www.example.org/Shop/Item12345/Overview", "version 1.2.3.4 of Abc1.Def2.Ghi3.Jkl4.Mno5",
             "a1B." * 50_000, "xy" * 100_000]
    assert owned(spark, texts) == [([], t) for t in texts]


def test_lag_against_the_weights_themselves():
    """A long corpus of unequal sources, small ones, and more sources than a period of 1,000 has blocks."""
    long = {"hot": 3_000_000} | {f"s{i}": 6_000_000 // 19 for i in range(19)}
    tiny = {"a": 400_000, "b": 400_000, "c": 400}
    many = {f"s{i}": 40 + i for i in range(1500)} | {None: 70}
    for counts, weights in ((long, None), (tiny, {"a": 0.7, "b": 0.2999, "c": 0.0001}), (many, None)):
        weights = weights or {s: n ** mixing.TEMPERATURE for s, n in counts.items()}
        total = math.fsum(weights.values())
        left = {s: -(-n // mixing.BLOCK_ROWS) for s, n in counts.items()}
        done, slots, first, rows = dict.fromkeys(counts, 0), -1, 0, []
        for source, block, release, deadline, slot, start in mixing.blocks(counts, weights):
            assert block == done[source] and slots < slot and release <= slot < deadline and start == first
            share = weights[source] / total
            # the lag of a source is greatest just before and just after its own blocks
            assert abs(block - share * slot) < 1 + 1e-6 and abs(block + 1 - share * (slot + 1)) < 1 + 1e-6
            done[source], slots = block + 1, slot
            first += min(mixing.BLOCK_ROWS, counts[source] - block * mixing.BLOCK_ROWS)
        assert done == left and first == sum(counts.values())


def test_more_sources_than_a_period(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 1250).cast("string").alias("source"))
    assert sorted(r.position for r in mixing.order(docs).collect()) == list(range(5000))


def test_examples_in_many_documents_of_few_owners(spark):
    live, example, again = (f"{c}B3" * 8 for c in "xyz")
    data = [(i, f"see {example} here", "hot" if i % 2 else "other") for i in range(60)]
    data += [(100, f"my {live}", "hot"), (101, f"my {live}", "hot")]
    data += [(200, f"one {again}", "hot")] * 60  # sixty rows of one document
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    spans = {(r.doc_id, len(r.spans)) for r in secrets.scan(docs).collect()}
    assert spans == {(i, 0) for i in range(60)} | {(100, 1), (101, 1), (200, 1)}
    masked = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert masked[5] == data[5][1] and masked[100] == "my [SECRET]" and masked[200] == "one [SECRET]"


def test_large_components_are_scored_or_refused(spark):
    vectors = spark.createDataFrame([(1, [100000.0, 1.0]), (2, [-3.0, 200000.5]), (3, [0.5, 0.5])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.search(topk.build_index(vectors), vectors.where("vec_id < 3"), 2).collect())
    q = {1: (25600000, 256), 2: (-768, 51200128), 3: (128, 128)}
    dot = lambda a, b: sum(x * y for x, y in zip(q[a], q[b]))
    assert got == [(a, k + 1, b, dot(a, b)) for a in (1, 2) for k, b in enumerate(sorted({1, 2, 3} - {a}, key=lambda b: -dot(a, b)))]
    huge = spark.createDataFrame([(1, [1e12]), (2, [1e12])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        topk.search(topk.build_index(huge), huge, 1).collect()
