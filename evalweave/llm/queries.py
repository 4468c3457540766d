"""Registered queries of the corpus operators and their SQL oracles, on the given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from evalweave.llm import bpe, language, mixing, negatives, quality, runs, secrets, sharding, simhash, sketch, topk, toxicity, urls
from evalweave.llm.common import held_out
from evalweave.plans.shared import cut

SHARDS = 40
TOP = 5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounded-load ring over all documents; the law kept is equal row counts."""
    placed = sharding.assign(_table(spark, sf_dir, "documents"), SHARDS)
    return placed.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two thirds of them."""
    docs = _table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"))
    learned = language.fit(docs.where(~out).select("text", F.col("lang").alias("label")))
    return language.predict(docs.select("doc_id", out.alias("held_out"), "text"), learned).drop("text")


def op3_bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows for every query vector."""
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.search(topk.build_index(vectors), vectors.where("vec_id % 50 = 0"), TOP)


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes."""
    tokens = bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode(docs, tokens, public_tokenizers.PATTERN).drop("text")
    return bpe.decode(encoded, tokens).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, labels learned from two thirds of them."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = toxicity.classify(docs, _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against dated list entries.  Both are derived from the pages: a capture's day from
    its id; the list adds hosts and some path prefixes, and removes part of them later."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    day = lambda salt, key, span: F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(
        F.crc32(F.concat(F.lit(salt), key.cast("string"))), F.lit(span)).cast("int"))
    captures = pages.withColumn("fetched", day("f", F.col("page_id"), 720))
    host = urls.host_of(F.col("url"))
    seeds = pages.select(host.alias("pattern")).union(pages.select(F.regexp_replace(host, r"^[^.]+\.", ""))).union(
        pages.where("page_id % 7 = 0").select(F.concat(host, F.lit("/"), F.regexp_extract("url", r"^[a-z]+://[^/]*/([a-z]+)", 1))))
    listed = seeds.where("pattern is not null").distinct().withColumn("code", F.crc32("pattern") % 6).where("code < 3").withColumn(
        "category", F.element_at(F.array(*map(F.lit, ("adult", "malware", "spam"))), (F.col("code") + 1).cast("int")))
    added = listed.select("category", "pattern", day("a", F.col("pattern"), 360).alias("day"), F.lit("add").alias("action"))
    gone = listed.where(F.crc32(F.concat(F.lit("r"), "pattern")) % 2 == 0).select(
        "category", "pattern", F.date_add(day("a", F.col("pattern"), 360), F.pmod(F.crc32(F.concat(F.lit("d"), "pattern")), F.lit(300)).cast(
            "int")).alias("day"), F.lit("remove").alias("action"))
    again = gone.where(F.crc32(F.concat(F.lit("b"), "pattern")) % 3 == 0).select(
        "category", "pattern", F.date_add("day", 60).alias("day"), F.lit("add").alias("action"))
    return urls.evaluate(captures, cut(added.union(gone).union(again)))


def op7_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document with the corpus-wide verdict on bare tokens."""
    found = secrets.scan(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    live = F.size(F.filter("spans", lambda s: s["live"])).cast("long")
    return found.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"), live.alias("n_live"))


def op8_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bottom-k sketches of every document and of its edited text, with their likeness."""
    pairs = sketch.edited_pairs(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    own = sketch.with_sketch(pairs, "edited", "changed")
    a, b, c = F.col("sketch"), F.col("changed"), F.col("next_sketch")
    return own.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), sketch.text_form(a).alias("fingerprint"),
        sketch.text_form(b).alias("edited_fingerprint"), sketch.resemblance(a, b).alias("near_edited"),
        sketch.resemblance(a, c).alias("near_next"), sketch.containment(b, a).alias("edited_in_own"),
        sketch.distinct_shingles(a).alias("distinct_shingles"))


def op9_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's block, release, deadline, slot and position in the mixed order."""
    return mixing.order(_table(spark, sf_dir, "documents").select("doc_id", "source"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash and near-duplicate class of every document."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document.  A tenth of the documents, by the hash of the id, first repeats
    the words of a stretch to its end."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = docs.withColumns({"g": F.floor(h / 10), "words": F.when(h % 10 == 0, words)}).withColumn("n", F.size("words"))
    placed = chosen.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn(
        "p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    index = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")
    repeated = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - F.lit(1).cast("long")), lambda i: F.get("words", index(i))), " ")
    changed = placed.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))
    found = runs.with_runs(changed)
    longest = F.try_element_at(F.array_sort(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(1))
    top = found.withColumn("top", longest)
    return top.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), (-F.col("top.shorter")).alias("length"),
        F.col("top.period").alias("period"), F.floor(-F.col("top.shorter") * 1000 / F.col("top.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), ""), 256).alias(
            "runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; the label of every seventh is moved on by one."""
    vectors = _table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, labels learned from four fifths of them."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, _table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_bounded_ring, op2_language, op3_bit_sliced_topk, op4_bpe_round_trip, op5_toxicity, op6_url_lists,
    op7_secret_ownership, op8_bottom_k, op9_pfair_mix, op10_simhash, op11_runs, op12_hard_negatives, op13_quality, pipeline)}
_VECTORS = """with v as (select vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)) as q from embeddings
  where vec_id is not null and embedding is not null and list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))))"""
ORACLES: dict[str, str] = {
    "op3_bit_sliced_topk": _VECTORS + f"""
select query_id, rank::int as rank, vec_id, score from (
  select a.vec_id as query_id, b.vec_id, list_inner_product(a.q, b.q)::bigint as score,
    row_number() over (partition by a.vec_id order by list_inner_product(a.q, b.q) desc, b.vec_id) as rank
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0) where rank <= {TOP}""",
    "op12_hard_negatives": _VECTORS + """,
l as (select vec_id, q, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label from v where label is not null),
s as (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_inner_product(a.q, b.q)::bigint as score
  from l a join l b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (select p.*, s.vec_id as negative_id, s.score as negative_score,
    row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) as rank
  from p join s on p.anchor_id = s.anchor_id and not s.same
    and 80 * p.positive_score <= 100 * s.score and 100 * s.score <= 100 * p.positive_score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 5""",
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
