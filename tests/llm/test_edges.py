"""Defined results of the corpus operators for nulls, empty and long texts, ties, repeats, clashes."""

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from evalweave.llm import bpe, components, language, mixing, secrets, sharding, simhash, sketch, topk, toxicity, urls

SCHEMA = "doc_id long, text string, source string, lang string, shard int, score double, fp string, row int, id string"


@pytest.fixture(scope="module")
def rows(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    data = [
        (1, "one two three four five six seven", "a", "en"), (1, "one two three four five six seven", "a", "en"),
        (2, None, "a", None), (None, "one two three four five six seven", None, "en"), (3, "", "b", "xx"),
        (4, long, "b", "en"), (5, " \t\n ", None, None), (None, None, None, None), (6, "ünï \U0001f600 code 123", "a", "de")]
    return spark.createDataFrame([(*d, 7, 0.5, "x", 1, "y") for d in data], SCHEMA)


@pytest.fixture(scope="module")
def empty(rows):
    return rows.where("1 = 0")


def test_sharding(rows, empty):
    got = sharding.assign(rows, 4).toPandas()
    assert len(got) == 9 and got.groupby("shard").size().tolist() == [3, 2, 2, 2]
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert got[got["size"] == 16].text_crc32.isna().sum() == 2
    assert sharding.assign(empty, 4).count() == 0
    hot = rows.sparkSession.range(3000).select(F.lit(9).alias("doc_id"), F.lit("x").alias("text"))
    assert sorted(r["count"] for r in sharding.assign(hot, 7).groupBy("shard").count().collect()) == [428] * 3 + [429] * 4


def test_language(rows, empty):
    learned = language.fit(rows.select("text", F.col("lang").alias("label")))
    assert set(learned) == {"en", "de"}
    got = language.predict(rows, learned)
    assert got.count() == 9 and {r.lang_pred for r in got.where("text is null or trim(text) = ''").collect()} <= {"und"}
    assert language.predict(empty, learned).count() == 0
    assert {r.lang_pred for r in language.predict(rows, language.fit(empty.select("text", F.col("lang").alias("label")))).collect()} == {"und"}


def test_topk(spark):
    nan, inf = float("nan"), float("inf")
    data = [(50, [1.0, -0.5]), (50, [1.0, -0.5]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [nan, 0.0]), (5, [inf, 1.0]),
            (6, [None, 1.0]), (None, [1.0, 1.0]), (7, []), (8, [-1.0]), (100, [0.0, 0.0])]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = topk.search(topk.build_index(vectors), vectors.where("vec_id % 50 = 0"), 3).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [
        (50, 1, 1, 16384), (50, 2, 2, 16384), (50, 3, 7, 0), (100, 1, 1, 0), (100, 2, 2, 0), (100, 3, 7, 0)]
    none = vectors.where("1 = 0")
    assert topk.search(topk.build_index(none), vectors, 3).count() == 0 == topk.search(topk.build_index(vectors), none, 3).count()


@pytest.mark.parametrize("dims,size", [(1, 5), (7, 300), (64, 1000)])
def test_bitmap_arithmetic(dims, size):
    rng = np.random.default_rng(dims)
    v, q = rng.integers(-300, 300, (size, dims)), rng.integers(-300, 300, dims)
    bits, slices = topk.slices_of(v)
    width = bits + 1 + int(np.abs(q).sum()).bit_length()
    result = topk.add_slices(q, np.stack([slices, ~slices]), width)
    valid = np.packbits(np.arange(slices.shape[2] * 64) < size, bitorder="little").view("<u8")
    ids = rng.permutation(size)
    picked, scores = topk.top_rows(result, valid, ids, 9)
    want = np.lexsort((ids, -(v @ q)))[:9]
    assert set(picked) == set(want) and dict(zip(picked, scores)) == {i: (v @ q)[i] for i in want}


def test_bpe(rows, empty, spark):
    tokens = bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    got = bpe.decode(bpe.encode(rows, tokens, public_tokenizers.PATTERN), tokens)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in got.collect())
    assert bpe.unpack(bpe.encode(rows, tokens, public_tokenizers.PATTERN)).where("text = ''").first().ids == []
    assert bpe.encode(empty, tokens, public_tokenizers.PATTERN).count() == 0
    long = spark.createDataFrame([("a" * 20_000 + "  x",)], "text string")
    assert bytes(bpe.decode(bpe.encode(long, tokens, public_tokenizers.PATTERN), tokens).first().decoded) == long.first().text.encode()


def test_toxicity(rows, empty, spark):
    labels = spark.createDataFrame([(1, 0), (4, 1), (6, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    got = toxicity.classify(rows, labels)
    assert got.count() == 9 and got.where("score between 0 and 1").count() == 9 and set(rows.columns) <= set(got.columns)
    assert toxicity.classify(empty, labels).count() == 0
    assert {r.predicted for r in toxicity.classify(rows, labels.where("1 = 0")).collect()} == {0}


def test_urls(spark):
    d = lambda s: f"2024-01-{s:02d}"
    entries = spark.createDataFrame(
        [("spam", "example.com", d(5), "add"), ("spam", "example.com", d(10), "remove"), ("spam", "example.com", d(20), "add"),
         ("spam", "example.com", d(7), "add"), ("adult", "a.org/x", d(1), "add"), ("adult", None, d(1), "add"), ("adult", "b.org", d(3), "remove")],
        "category string, pattern string, day string, action string").withColumn("day", F.col("day").cast("date"))
    pages = [(1, "http://www.Example.com/p", 4), (2, "http://www.example.com:80/p", 5), (3, "https://u@example.com.", 9), (4, "http://example.com", 10),
             (5, "http://example.com", 25), (6, "http://notexample.com/", 6), (7, "http://a.org/x/y?q", 6), (8, "http://a.org/xy", 6), (9, None, 6), (10, "mailto:x", 6)]
    captures = spark.createDataFrame([(k, u, d(t)) for k, u, t in pages], "page_id long, url string, fetched string").withColumn(
        "fetched", F.col("fetched").cast("date"))
    got = {r.page_id: (r.hits, r.category) for r in urls.evaluate(captures, entries).collect()}
    hit = {2: "spam", 3: "spam", 5: "spam", 7: "adult"}
    assert got == {k: (1, hit[k]) if k in hit else (0, None) for k, _, _ in pages}
    assert urls.evaluate(captures, entries.where("1 = 0")).where("hits > 0").count() == 0 == urls.evaluate(captures.where("1 = 0"), entries).count()


def test_secrets(rows, empty, spark):
    key = "aB3" * 8
    texts = [(1, f"x token: {key} y", "s1"), (2, f"bare {key} {key}", "s1"), (3, "é password='exampleexample1'", "s1"), (4, "password=exampleexample1", "s2"),
             (5, "password=exampleexample1", "s3"), (6, "token: secret: abcdefghijklmnop", None), (7, None, None), (7, None, None), (8, "deadbeefdeadbeef", "s1")]
    docs = spark.createDataFrame([(*t, 3, 1) for t in texts], "doc_id long, text string, source string, n_chars long, spans int")
    got = {r.doc_id: r.s for r in secrets.scan(docs).select("doc_id", secrets.listed(F.col("spans")).alias("s")).collect()}
    assert got == {1: "assign:2:33", 2: "owned:5:29,owned:30:54", 3: "assign:2:27", 4: "assign:0:24", 5: "assign:0:24", 6: "", 7: "", 8: "hex:0:16"}
    masked = {r.doc_id: r for r in secrets.redact(docs).collect()}
    assert masked[1].text == "x token: [SECRET] y" and masked[2].text == "bare [SECRET] [SECRET]" and masked[8].text == "[SECRET]"
    assert masked[3].text == texts[2][1] and masked[3].n_chars == 3 and masked[1].n_chars == 19 and masked[7].text is None
    assert secrets.redact(docs).count() == 9 and secrets.redact(docs).columns == docs.columns
    assert secrets.scan(rows).count() == 9 and secrets.scan(empty).count() == 0 == secrets.redact(empty).count()


def test_sketch(rows, empty):
    got = sketch.edited_pairs(rows).collect()
    assert len(got) == 9 and sum(r.doc_id is None for r in got) == 2
    assert sketch.edited_pairs(empty).count() == 0
    assert sketch.edited_pairs(rows.where("doc_id = 6")).first().edited == "ünï \U0001f600 c" + "ünï \U0001f600 c"
    own = sketch.with_sketch(rows, "text", "s")
    assert all(r.s == [] for r in own.where("trim(coalesce(text, '')) = '' or text rlike '^[ \\t\\n]*$'").collect())
    n = own.where("doc_id = 4").select(sketch.distinct_shingles(F.col("s")).alias("n")).first().n
    assert abs(n / 59_996 - 1) < 0.4
    parts = own.select(F.lit(1).alias("k"), "s")
    both = sketch.merge_parts(parts, ["k"], "s").first().s
    assert both == sorted({h for r in parts.collect() for h in r.s})[: sketch.K]


def test_mixing(rows, empty, spark):
    got = mixing.order(rows).toPandas()
    assert sorted(got.position) == list(range(9)) and mixing.order(empty).count() == 0
    assert mixing.mixed(rows).columns == rows.columns and mixing.mixed(rows).count() == 9
    with pytest.raises(ValueError):
        list(mixing.blocks({"a": 5}, {"a": 0.0}))
    with pytest.raises(ValueError):
        list(mixing.blocks({"a": 5}, {"b": 1.0}))


@pytest.mark.parametrize("size", [1, 32, 1000])
def test_mixing_lag(size):
    """Every source stays within one block of its share, and every block in its window, while all sources last."""
    counts = {f"s{i}": 40 * size + 13 * i for i in range(9)} | {None: 90 * size}
    weights = {s: n ** 0.5 if s != "s3" else 1e-3 for s, n in counts.items()}
    table = list(mixing.blocks(counts, weights, size))
    total, ends = sum(weights.values()), {s: -(-n // size) for s, n in counts.items()}
    assert sorted((r[0] or "", r[1]) for r in table) == sorted((s or "", i) for s, n in ends.items() for i in range(n))
    assert all(r[2] <= r[4] < r[3] for r in table) and [r[4] for r in table] == sorted({r[4] for r in table})
    done, last = dict.fromkeys(counts, 0), min(max(r[4] for r in table if r[0] == s) for s in counts if s != "s3")
    for t, r in enumerate(table):
        if t > last:
            break
        done[r[0]] += 1
        assert all(abs(done[s] - weights[s] / total * (t + 1)) < 1 for s in counts)


def test_mixing_work_is_bounded():
    assert mixing.block_rows(1000) == mixing.BLOCK_ROWS
    assert 10**10 / mixing.block_rows(10**10) <= mixing.BLOCKS


def test_simhash(rows, empty):
    got = simhash.near_duplicates(rows).toPandas()
    assert len(got) == 9 and set(got[got.doc_id == 1].component_id) == {1}
    blank = got[got.fingerprint == "0" * 16]
    assert len(blank) == 4 and set(blank.component_id) == {2}
    assert simhash.near_duplicates(empty).count() == 0 == simhash.keep_one(empty).count()
    kept = simhash.keep_one(rows)
    assert kept.columns == rows.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 6]
    assert simhash.keep_one(rows.where("doc_id is null")).count() == 2


def test_dense_neighbourhood_and_chains(spark):
    """Many fingerprints within two bits of each other, and chains, against all pairs."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 3)
    prints = {int(b) for b in base}
    for b in base:
        for _ in range(150):
            x = int(b)
            for j in rng.integers(0, 63, rng.integers(1, 4)):
                x ^= 1 << int(j)
            prints.add(x)
    prints = sorted(prints)
    up = {p: p for p in prints}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                up[find(a)] = find(b)
    least = {}
    for i, p in enumerate(prints):
        least.setdefault(find(p), i)
    df = spark.createDataFrame(list(enumerate(prints)), "id long, fp long")
    got = {r.fp: r.component for r in simhash.classes(df).collect()}
    assert got == {p: least[find(p)] for p in prints}


def test_components(spark):
    path = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    star = spark.range(1000, 1500).select(F.lit(999).cast("long").alias("a"), F.col("id").alias("b"))
    roots = {r.node: r.root for r in components.roots(path.union(star).union(star)).collect()}
    assert roots == {**{i: 0 for i in range(201)}, **{i: 999 for i in range(999, 1500)}}
