"""A training corpus from raw documents: five stages, each one corpus operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the documents of the next.  All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.llm import bpe, mixing, near, secrets, toxicity
from evalweave.plans.shared import scratch_path, tune


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the labels teach, they do not decide."""
    model = toxicity.fit(toxicity.training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    own = "_score_of_toxicity"  # docs may have a score of their own
    return toxicity.score(docs, model, out=own).where(F.col(own) < toxicity.THRESHOLD).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: five-word shingles, likeness 0.8 or more."""
    return near.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, live secrets masked."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixing schedule."""
    return mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, position in the mixed order, token ids (array) and their number; the ids decode to the text (checked)."""
    tokens = bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    placed = mixing.stored_position(docs).select("doc_id", "source", "position", F.coalesce("text", F.lit("")).alias("text"))
    return bpe.round_trip(placed, tokens, public_tokenizers.PATTERN).select("doc_id", "source", "position", "ids", "n_tokens", "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("tokens", tokenize),
]
ORACLE_SQL = None  # compression margins, MinHash and BPE have no SQL form; tests use brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    tune(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return done
        path = scratch_path(spark, f"stage-{name}")
        done.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
