"""SimHash near-duplicate classes, joined on deletion-variant signatures.

Words are runs of non-blank characters of the text with A-Z lower-cased; every three-word shingle,
repeats included, votes with the bits of its XXH64 (seed 42).  Two fingerprints of at most two
differing bits are linked.  Cut into two segments, one segment of such a pair differs by at most one
bit, so the pair agrees on some variant (segment, position, segment with that position deleted).
Variants are grouped by equality; a variant that two fingerprints share gives a pair to verify.
A variant shared by more belongs to a dense neighbourhood, where all pairs would be too many: its
fingerprints are linked exactly through the points at most one bit away from them.  Whatever shares
such a point differs in at most two bits, and whatever differs in at most two bits shares one, so a
star per point (65 fingerprints at most) loses no link and adds none.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalweave.llm.common import identified, small_batches
from evalweave.llm.components import roots
from evalweave.plans.shared import cut

WORDS = 3
BITS = 64
SEGMENTS = 2
WIDTH = BITS // SEGMENTS
DISTANCE = 2
BLOCK = 1 << 16


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes (uint64) have each bit."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(len(hashes), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def majority(hashes: np.ndarray) -> int:
    """Unsigned 64-bit SimHash of hashes (uint64): the bits that over half of them have; 0 without hashes."""
    votes = sum((_ones(hashes[k : k + BLOCK]) for k in range(0, len(hashes), BLOCK)), np.zeros(BITS, dtype=np.int64))
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of one text; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    last = max(len(words) - WORDS + 1, 1)
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(BITS, dtype=np.int64)
    for k in range(0, last, BLOCK):
        n = min(BLOCK, last - k)
        tops = ends[k + WORDS - 1 : k + WORDS - 1 + n] or [len(line) + 1]
        hashes = np.fromiter((digest(line[s : e - 1], 42) for s, e in zip(starts[k : k + n], tops)), np.uint64, n)
        votes += _ones(hashes)
    return int(np.packbits(votes * 2 > last, bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def _fingerprints(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in parts:
        yield pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add the signed 64-bit SimHash of a text column (NULL counts as empty; ``out`` is replaced)."""
    small_batches(docs.sparkSession)
    return docs.withColumn(out, _fingerprints(F.col(text)))


def variants(prints: DataFrame) -> DataFrame:
    """(fp, slot, rest): the one-deletion variants of both segments of every fingerprint."""
    slots = prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("slot"))
    segment = F.expr(f"shiftrightunsigned(fp, slot div {WIDTH} * {WIDTH}) & {(1 << WIDTH) - 1}L")
    return slots.select("fp", "slot", (segment.bitwiseAND(F.expr(f"~shiftleft(1L, slot % {WIDTH})"))).alias("rest"))


def links(prints: DataFrame) -> DataFrame:
    """(a, b): edges that join exactly the fingerprints of at most two differing bits.

    ``prints`` has the distinct, non-NULL long column fp.  Dense neighbourhoods give stars instead of
    all pairs; the connected components are those of all links.
    """
    spark = prints.sparkSession
    spread = prints.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "fp")
    # One exchange serves the counts and the members.
    rows = variants(spread).repartition("slot", "rest")
    counts = rows.groupBy("slot", "rest").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(rows.join(counts.hint("merge"), ["slot", "rest"]))
    pairs = shared.where("n = 2").groupBy("slot", "rest").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where(
        f"bit_count(a ^ b) <= {DISTANCE}").select("a", "b")
    dense = cut(shared.where("n > 2").select("fp").distinct())
    points = dense.select("fp", F.explode(F.sequence(F.lit(-1), F.lit(BITS - 1))).alias("bit")).select(
        "fp", F.expr("case when bit < 0 then fp else fp ^ shiftleft(1L, bit) end").alias("point"))
    heads = points.groupBy("point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    stars = points.join(heads, "point").where("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.union(stars).distinct()


def classes(prints: DataFrame) -> DataFrame:
    """(fp, root, component): a class and its smallest id, for rows (id, fp); one row per fingerprint.

    NULL ids take part but never name a component unless all ids of it are NULL.
    """
    own = cut(prints.groupBy("fp").agg(F.min("id").alias("id")))
    root = roots(links(own.select("fp"))).select(F.col("node").alias("fp"), "root")
    placed = own.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = placed.groupBy("root").agg(F.min("id").alias("component"))
    return placed.join(named, "root").select("fp", "root", "component")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    NULL and blank texts have fingerprint zero and link like any other; repeated rows give repeated
    rows; an empty table gives none; other columns are not carried.
    """
    fixed = cut(with_fingerprint(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), "text", "fp").drop("text"))
    found = classes(fixed)
    return fixed.join(found, "fp").select(
        F.col("id").alias(doc_id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without near copies: the row of the smallest id stays in each class.

    Of rows that share the id, one stays; a class whose ids are all NULL keeps one row.  All columns
    of the input come back unchanged.
    """
    row = "_row_number_of_near_duplicates"
    fixed = identified(docs, row)
    prints = cut(with_fingerprint(fixed.select(
        F.col(row).alias("row"), F.col(doc_id).alias("id"), F.col(text).alias("text")), "text", "fp").drop("text"))
    best = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "row"))
    first = prints.join(classes(prints), "fp").groupBy("root").agg(best.alias("best")).select(F.col("best.row").alias(row))
    return fixed.join(first, row, "left_semi").drop(row)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
