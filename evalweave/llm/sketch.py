"""Bottom-k sketches of shingle hashes, in DataFrame functions only.

Words are blank-separated, lower-cased; a shingle is five words (a shorter text is one shingle); its
hash is the XXH64 chain of its words.  The sketch is the K smallest distinct hashes, in order.  The
sketch of a union is the K smallest of the sketches, so sketches merge across parts and files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalweave.plans.ranked import with_running
from evalweave.plans.shared import cut

K = 64
WORDS = 5
RANGE = float(1 << 64)


def with_sketch(docs: DataFrame, text: str | Column, out: str, k: int = K) -> DataFrame:
    """Add the bottom-k sketch of a text (array<bigint>, ascending; NULL and blank texts: empty)."""
    words, inner = F.split(F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " ")), " "), f"{out}_words"
    filled = docs.withColumn(inner, F.filter(F.coalesce(words, F.array().cast("array<string>")), lambda w: w != ""))
    size = F.size(inner)
    many = F.transform(F.sequence(F.lit(1), F.greatest(size - (WORDS - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(inner, i, WORDS)))
    hashes = F.when(size == 0, F.array().cast("array<bigint>")).otherwise(many)
    return filled.withColumn(out, F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)).drop(inner)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two sketched sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_parts(parts: DataFrame, keys: Sequence[str], sketch: str, k: int = K) -> DataFrame:
    """One sketch per group of part sketches: a group of any size keeps k hashes per task and one group of k.

    The sketches are written out first: a filter that the optimizer derives from the explode would else
    be pushed into the computation of the sketch and repeat it for every shingle.
    """
    fixed = cut(parts.select(*keys, sketch))
    hashes = fixed.select(*keys, F.explode(sketch).alias("hash")).groupBy(*keys, "hash").agg(F.lit(1))
    least = hashes.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("hash"))).where(F.col("n") <= k)
    return least.groupBy(*keys).agg(F.array_sort(F.collect_list("hash")).alias(sketch))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness: the share of the union's sketch that both have; 1 if both are empty."""
    union = merged(a, b, k)
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(F.array_intersect(union, a), b)) / F.size(union))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else from the k-th smallest hash."""
    spread = (F.element_at(a, -1).cast("double") + RANGE / 2) / RANGE
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / spread)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has (0 to 1; 1 for an empty a)."""
    like, n, m = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), like * (n + m) / ((1 + like) * n)))


def text_form(a: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits per hash."""
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def edited_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, text, edited, sketch, next_sketch): each document beside the next one.

    The next document has the next smaller id (NULL last, equal ids by hash and length of the text);
    the first follows the last.  In the edited text the last half (rounded down) of the code points
    is replaced by as many from the head of the next text.  Identical rows follow each other: all
    but the last have themselves as next.  NULL texts count as empty.
    """
    # Plain equality on these columns identifies a row's id and text, and keeps one partitioning for all joins.
    key = ["unnamed", "number", "hash", "n_chars"]
    keyed = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).select(
        F.col("id").isNull().alias("unnamed"), F.coalesce("id", F.lit(0)).alias("number"), F.xxhash64("text").alias("hash"),
        F.length("text").alias("n_chars"), "text")
    ranked = with_running(keyed.groupBy(*key).agg(F.count("*").alias("copies")), [],
                          [F.col("unnamed"), F.col("number").desc(), F.col("hash"), F.col("n_chars")])
    named = lambda prefix: [F.col(c).alias(f"{prefix}_{c}") for c in key]
    before = ranked.select((F.col("rank") % F.col("group_rows") + 1).alias("rank"), *named("own"))
    follow = before.join(ranked.select("rank", *key), "rank").drop("rank").withColumn("times", F.lit(1))
    itself = ranked.where("copies > 1").select(*named("own"), *key, (F.col("copies") - 1).cast("int").alias("times"))
    edges = follow.unionByName(itself)

    # One exchange, used twice: every text is sketched once, where it is read, and travels with its sketch.
    texts = with_sketch(keyed, "text", "sketch").repartition(*key).groupBy(*key).agg(
        F.min("text").alias("text"), F.min("sketch").alias("sketch"))
    half = F.floor(F.col("own_n_chars") / 2).cast("int")
    heads = texts.join(edges, key).select(
        *[F.col(f"own_{c}").alias(c) for c in key], "times", F.substring("text", F.lit(1), half).alias("head"), F.col("sketch").alias("next_sketch"))
    kept = F.col("n_chars") - F.floor(F.col("n_chars") / 2).cast("int")
    return texts.join(heads, key).select(
        F.when(~F.col("unnamed"), F.col("number")).alias(doc_id), F.col("n_chars").cast("long").alias("n_chars"), "text",
        F.concat(F.substring("text", F.lit(1), kept), "head").alias("edited"), "sketch", "next_sketch",
        F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).drop("copy")
