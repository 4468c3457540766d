"""Near copies by verified likeness: five-word shingle sets whose Jaccard likeness is at least 0.8.

Words are those of the SimHash query; a text of fewer than five words is one shingle.  Texts of equal
sets are one node.  A proposed pair becomes a link only if the full sets have the likeness, so chance adds
no link.  Pairs are proposed in four steps, each for what the ones before left apart:

* The SimHash operator (``simhash.links``) on fingerprints of the shingle sets: equal fingerprints and those
  of at most two differing bits, by deletion variants and stars.
* MinHash signatures of BANDS x ROWS values, for likeness down to 0.8, where fingerprints differ in about
  ten bits: two sets that agree on a whole band share a bucket, which a pair of likeness 0.8 misses in all
  bands with probability 3e-6.  Small buckets propose all pairs; a larger one first links its members to one
  of them, which settles groups of near copies.
* Members of large buckets that stay apart, such as pages of one template, are refined by a prefix filter: of
  two sets of n shingles at likeness 0.8 at least 0.8 n are common, so both hold a common one among their
  n - ceil(0.8 n) + 1 rarest.  Buckets of these rare shingles are treated in the same way.
* What is left open in large ones is compared by its difference from what the group has in common (``_differing``).

In the middle steps a pair must first agree in size and in BITS_AGREE of the lowest bits of its signatures,
which travel with the bucket, and every pair in AGREE of the whole signatures; a pair of likeness 0.8 fails the
two with probability below 3e-6.  Likeness and signatures are compared in the JVM; Python tasks hold single texts.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalweave.llm import simhash
from evalweave.llm.common import identified, small_batches
from evalweave.llm.components import roots
from evalweave.plans.shared import cut, passing_tables, small_side

WORDS = 5
LIKE = 0.8
BANDS, ROWS = 32, 5
ALL_PAIRS = 8
AGREE = 0.6  # less of the signature agrees for a pair of likeness 0.8 with probability below 1e-8
BITS_AGREE = 121  # of the BANDS * ROWS lowest bits; nine in ten agree at likeness 0.8
MARKS = ("size", "b0", "b1", "b2")
BLOCK = 1 << 12
_DRAWS = np.random.default_rng(8).integers(0, 1 << 64, (2, BANDS * ROWS), dtype=np.uint64) | np.array([[1], [0]], dtype=np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct XXH64 values of the shingles of one text; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    tops = ends[WORDS - 1 :] or [len(line) + 1]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[s : e - 1], 42) for s, e in zip([0, *ends], tops)), np.uint64, len(tops)))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least value of every draw over a set (uint32)."""
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    for k in range(0, len(hashes), BLOCK):
        drawn = hashes[k : k + BLOCK, None] * _DRAWS[0] + _DRAWS[1]
        np.minimum(least, (drawn.min(0) >> np.uint64(32)).astype(np.uint32), out=least)
    return least


@F.pandas_udf(T.StructType([T.StructField("key", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField(
    "fp", T.LongType()), T.StructField("sign", T.ArrayType(T.IntegerType())), T.StructField("bands", T.ArrayType(T.LongType())), *[T.StructField(b, T.LongType()) for b in MARKS[1:]]]))
def _sketched(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in parts:
        out = []
        for text in texts:
            own = shingles(text)
            sign = signature(own)
            bands = [xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(sign.reshape(BANDS, ROWS))] if len(own) else []
            key = np.array([xxhash.xxh64_intdigest(own.tobytes(), 42)], dtype=np.uint64).view(np.int64)[0]
            low = np.packbits(np.pad((sign & 1).astype(np.uint8), (0, 192 - len(sign)))).view(np.int64)
            fp = np.array([simhash.majority(own)], dtype=np.uint64).view(np.int64)[0]
            out.append((key, len(own), fp, sign.view(np.int32), np.array(bands, dtype=np.uint64).view(np.int64), *low))
        yield pd.DataFrame(out, columns=["key", "size", "fp", "sign", "bands", *MARKS[1:]])


@F.pandas_udf(T.ArrayType(T.LongType()))
def _set(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in parts:
        yield pd.Series([shingles(t).view(np.int64) for t in texts], dtype=object)


def _sides(pairs: DataFrame, table: DataFrame, *values: str) -> DataFrame:
    side = lambda c: table.select(F.col("key").alias(c), *[F.col(v).alias(f"{v}_{c}") for v in values])
    return pairs.join(side("a"), "a").join(side("b"), "b")


def _alike(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """Whether two keys agree in size and lowest bits as far as the likeness asks for."""
    differ = [F.bit_count(a(m).bitwiseXOR(b(m))) for m in MARKS[1:]]
    return (F.least(a("size"), b("size")) >= LIKE * F.greatest(a("size"), b("size"))) & (
        differ[0] + differ[1] + differ[2] <= BANDS * ROWS - BITS_AGREE)


def _sets(keys: DataFrame, own: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, set): the shingle sets of the keys, from one text of each."""
    rows = small_side(keys.join(own.select("key", "row"), "key"))
    return cut(texts.join(rows, "row").select("key", _set("text").alias("set")))


def _verified(pairs: DataFrame, own: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys whose full shingle sets have the likeness."""
    agree = F.aggregate(F.zip_with("sign_a", "sign_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    sized = F.least("size_a", "size_b") >= LIKE * F.greatest("size_a", "size_b")
    likely = cut(_sides(pairs, own, "size", "sign").where(sized).where(agree >= AGREE * BANDS * ROWS).select("a", "b"))
    sets = _sets(likely.select(F.col("a").alias("key")).union(likely.select("b")).distinct(), own, texts)
    both = F.size(F.array_intersect("set_a", "set_b"))
    like = both / (F.size("set_a") + F.size("set_b") - both)
    return cut(_sides(likely, sets, "set").select("a", "b", like.alias("like")).where(F.col("like") >= LIKE).select("a", "b"))


def _starred(buckets: DataFrame, own: DataFrame, texts: DataFrame, known: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, their roots, members of large buckets that stay apart) of rows (bucket, key, MARKS).

    Small buckets propose all pairs, large ones pairs with their head.  Pairs that ``known`` (links and
    roots) already brought together are not compared again.
    """
    counts = buckets.groupBy("bucket").agg(
        F.count("*").alias("n"), F.min(F.struct(F.xxhash64("key"), "key", *MARKS)).alias("head")).where("n > 1")
    shared = cut(buckets.join(counts.hint("merge"), "bucket"))
    members = F.collect_list(F.struct("key", *MARKS)).alias("members")
    small = shared.where(F.col("n") <= ALL_PAIRS).groupBy("bucket").agg(members).select(F.explode("members").alias("x"), "members").select(
        "x", F.explode("members").alias("y")).where("x.key < y.key").where(
        _alike(lambda m: F.col(f"x.{m}"), lambda m: F.col(f"y.{m}"))).select(F.col("x.key").alias("a"), F.col("y.key").alias("b"))
    wide = shared.where(F.col("n") > ALL_PAIRS)
    head = F.col("head.key")
    stars = wide.where(F.col("key") != head).where(_alike(F.col, lambda m: F.col(f"head.{m}"))).select(
        F.least("key", head).alias("a"), F.greatest("key", head).alias("b"))
    pairs = small.union(stars).distinct()
    if known is not None:
        side = lambda c: known[1].select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
        pairs = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").where(
            "coalesce(root_a, a) <> coalesce(root_b, b)").select("a", "b")
    links = _verified(cut(pairs), own, texts)
    if known is not None:
        links = cut(known[0].union(links))
    root = cut(roots(links))
    rooted = cut(wide.select("bucket", "key").join(root.withColumnRenamed("node", "key"), "key", "left").select(
        "bucket", "key", F.coalesce("root", "key").alias("root")))
    several = rooted.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most")
    return links, root, cut(rooted.join(several.select("bucket"), "bucket"))


def _rare(keys: DataFrame, own: DataFrame, texts: DataFrame) -> DataFrame:
    """(bucket, key, MARKS): every key under the rarest shingles of its set, as many as the likeness asks for."""
    each = cut(_sets(keys, own, texts).select("key", F.size("set").alias("size"), F.explode("set").alias("shingle")))
    often = each.groupBy("shingle").agg(F.count("*").alias("often")).hint("merge")
    # One row per key holds its own set.
    order = F.sort_array(F.collect_list(F.struct("often", "shingle")))
    ranked = each.join(often, "shingle").groupBy("key", "size").agg(order.alias("order"))
    prefix = F.col("size") - F.ceil(F.col("size") * LIKE - 1e-6).cast("int") + 1
    placed = ranked.select(F.explode(F.slice("order", F.lit(1), prefix)).alias("x"), "key").where("x.often > 1")
    return cut(placed.select(F.col("x.shingle").alias("bucket"), "key").join(own.select("key", *MARKS), "key"))


def _fingerprinted(own: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys that the SimHash operator proposes; equal fingerprints meet in one of their keys."""
    first = cut(own.groupBy("fp").agg(F.min("key").alias("first")))
    equal = own.select("key", "fp").join(first, "fp").where("key <> first").select(F.col("first").alias("a"), F.col("key").alias("b"))
    side = lambda c: first.select(F.col("fp").alias(c), F.col("first").alias(f"key_{c}"))
    linked = simhash.links(first.select("fp")).join(side("a"), "a").join(side("b"), "b")
    return equal.union(linked.select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b"))).distinct()


def _differing(apart: DataFrame, own: DataFrame, texts: DataFrame, links: DataFrame) -> DataFrame:
    """The links and the pairs that settle the rest: members of large buckets (bucket, key) that stay apart.

    Keys that buckets join are a group; C are the shingles that over half of it have, D the difference of a set
    from C (its own shingles outside C and those of C it lacks).  Sets x, y differ in as many places as D(x), D(y)
    do, and are alike if 9 times that is at most size(x) + size(y).  With v = 9 size(D) - size, all pairs of
    v(x) + v(y) <= 0 are alike, and a star around the least v joins them.  Any other pair must have at least
    (v(x) + v(y)) / 18 elements of D in common, so the first of them, rarest first, comes early in both.
    """
    heads = apart.groupBy("bucket").agg(F.min("key").alias("a"))
    group = cut(roots(apart.join(heads.hint("merge"), "bucket").select("a", F.col("key").alias("b"))).select(
        F.col("node").alias("key"), F.col("root").alias("group")))
    sets = cut(_sets(group.select("key"), own, texts).join(group, "key"))
    members = group.groupBy("group").agg(F.count("*").alias("members"))
    often = sets.select("group", F.explode("set").alias("shingle")).groupBy("group", "shingle").agg(F.count("*").alias("often"))
    # C has fewer than twice the shingles of an average set.
    common = cut(often.join(members, "group").where("2 * often > members").groupBy("group").agg(F.collect_list("shingle").alias("common")))
    parts = lambda x, y, lacks: F.transform(F.array_except(x, y), lambda s: F.struct(s.alias("shingle"), F.lit(lacks).alias("lacks")))
    has = sets.join(common, "group", "left").withColumn("common", F.coalesce("common", F.array().cast("array<long>")))
    differ = cut(has.select("group", "key", F.size("set").alias("size"), F.concat(parts("set", "common", False), parts("common", "set", True)).alias("d")))
    own_v = 9 * F.size("d") - F.col("size")
    centre = cut(differ.groupBy("group").agg(F.min(F.struct(own_v.alias("v"), "key")).alias("centre")))
    sized = differ.select("group", "key", "size", F.size("d").alias("n"), own_v.alias("v")).join(centre, "group").withColumn(
        "far", F.col("v") + F.col("centre.v") > 0)
    stars = sized.where("not far and key <> centre.key").select(F.least("key", "centre.key").alias("a"), F.greatest("key", "centre.key").alias("b"))
    linked = cut(links.union(stars))
    root = roots(linked).select(F.col("node").alias("key"), "root")
    marked = cut(sized.drop("centre").join(root, "key", "left").withColumn("root", F.coalesce("root", "key")))

    each = cut(differ.select("group", "key", F.explode("d").alias("x")).select("group", "key", "x.*"))
    counts = each.groupBy("group", "shingle", "lacks").agg(F.count("*").alias("often")).where("often > 1").hint("merge")
    # One row per key holds its own difference; elements that no other key has come first and need no place.
    order = F.sort_array(F.collect_list(F.struct("often", "shingle", "lacks")))
    held = each.join(counts, ["group", "shingle", "lacks"]).groupBy("key").agg(order.alias("order")).join(marked, "key")
    placed = cut(held.select("group", "key", "size", "v", "far", "root", (F.col("n") - F.size("order")).alias("alone"), "n", F.posexplode("order").alias(
        "p", "x")).select("group", "key", "size", "v", "far", "root", (F.col("n") - F.col("alone") - F.col("p")).alias("left"), "x.shingle", "x.lacks"))
    side = lambda c: placed.select("group", "shingle", "lacks", *[F.col(m).alias(f"{m}_{c}") for m in ("key", "size", "v", "far", "root", "left")])
    needed = F.col("v_a") + F.col("v_b")
    once = ~F.col("far_b") | (F.col("key_a") < F.col("key_b"))
    sizes = F.least("size_a", "size_b") >= LIKE * F.greatest("size_a", "size_b")
    rest = side("a").where("far_a").join(side("b"), ["group", "shingle", "lacks"]).where(
        once & (F.col("root_a") != F.col("root_b")) & sizes & (needed > 0) & (needed <= 18 * F.least("left_a", "left_b")))
    pairs = rest.select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b")).distinct()
    return linked.union(_verified(cut(pairs), own, texts))


def _classes(own: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, root): the components of all proposed pairs of keys that have the likeness; single keys are left out."""
    links = _verified(cut(_fingerprinted(own)), own, texts)
    known = links, cut(roots(links))
    links, root, apart = _starred(cut(own.select("key", *MARKS, F.explode("bands").alias("bucket"))), own, texts, known)
    if apart.isEmpty():
        return root
    links, root, apart = _starred(_rare(apart.select("key").distinct(), own, texts), own, texts, (links, root))
    return root if apart.isEmpty() else roots(_differing(apart, own, texts, links))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without near copies: the row of the smallest id stays in each class.

    A class is a connected component of links.  Texts without words are one class.  Of rows that share
    the id, one stays; a class whose ids are all NULL keeps one row.  All columns come back unchanged.
    """
    small_batches(docs.sparkSession)
    row = "_row_number_of_near_copies"
    fixed = identified(docs, row)
    texts = fixed.select(F.col(row).alias("row"), F.col(text).alias("text"))
    with passing_tables(docs.sparkSession) as keep:
        prints = cut(fixed.select(F.col(row).alias("row"), F.col(doc_id).alias("id"), _sketched(F.col(text)).alias("s")).select("row", "id", "s.*"))
        own = cut(prints.groupBy("key").agg(F.min("row").alias("row")).join(prints.select("row", "fp", "sign", "bands", *MARKS), "row"))
        root = _classes(own, texts).withColumnRenamed("node", "key")
        best = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "row"))
        each = prints.groupBy("key").agg(best.alias("best")).join(root, "key", "left")
        first = each.groupBy(F.coalesce("root", "key").alias("class")).agg(F.min("best").alias("best"))
        stay = keep(first.select(F.col("best.row").alias(row)))
    return fixed.join(stay, row, "left_semi").drop(row)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
