"""Sinks (S4-S6, S8, S9, S15)."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalweave.functions.scoring import ensure_columns, gold_or_letter
from evalweave.sources import versioned

# Columns of the three report tables.
MAIN_FIELDS = """cell_id task model_family model_id quant_config seed n pass_at_1 pass_at_1_ci95_low
    pass_at_1_ci95_high num_correct""".split()
EFFICIENCY_FIELDS = """cell_id task model_family quant_config latency_sec_mean latency_sec_p50 peak_vram_gb_max
    peak_vram_gb_mean prompt_tokens_mean completion_tokens_mean completion_tokens_p50 reasoning_steps_mean
    total_gpu_seconds cost_per_correct_seconds cost_per_correct_seconds_ci95_low
    cost_per_correct_seconds_ci95_high cost_of_pass_seconds""".split()
FAILURE_FIELDS = """cell_id task model_family quant_config n parse_failure_rate empty_completion_rate
    truncation_rate invalid_answer_rate num_parse_failures num_empty_completions num_truncated
    num_invalid_answers""".split()
CACHE_FIELDS = "id task prompt completion pred_answer gold_answer correct cell_id quant_config seed".split()


def _replace(df: DataFrame, path: str, kind: str, partition_cols: Sequence[str], **options: object) -> None:
    """Write beside the table and swap at the end: a failed job leaves the old table as it was.

    Partitioned tables are dealt out by their partition columns first, so that a small partition is
    one file; AQE splits large ones.
    """
    spark, base = df.sparkSession, path.rstrip("/")
    staged, old = (f"{base}.{part}-{uuid.uuid4().hex}" for part in ("staged", "old"))
    if partition_cols:
        df = df.hint("rebalance", *[F.col(c) for c in partition_cols])
    df.write.format(kind).options(**options).partitionBy(*partition_cols).save(staged)
    at = spark._jvm.org.apache.hadoop.fs.Path
    files = at(base).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    moved = files.exists(at(base))
    if moved and not files.rename(at(base), at(old)):
        raise OSError(f"cannot set aside {base}; the new table is {staged}")
    if not files.rename(at(staged), at(base)):
        raise OSError(f"cannot move {staged} to {base}; the old table is {old}")
    if moved:
        files.delete(at(old), True)


def _write(df: DataFrame, path: str, kind: str, partition_cols: Sequence[str], as_version: bool, **options: object) -> None:
    if as_version:
        versioned.publish(df, path, kind, partition_cols=partition_cols, **options)
    else:
        _replace(df, path, kind, partition_cols, **options)


def write_jsonl(df: DataFrame, path: str, *, partition_cols: Sequence[str] = (), as_version: bool = False, compression: str = "none") -> None:
    """Replace a line-JSON table once the new one is complete.

    A plain folder is swapped by two renames, between which a reader may find nothing.  ``as_version``
    writes a new version of a versioned table instead: readers (``versioned.load``) see no gap.  ``compression``
    is a codec of Spark's JSON writer; a compressed file is read by one task.
    """
    _write(df, path, "json", partition_cols, as_version, ignoreNullFields=False, compression=compression)


def write_parquet(
    df: DataFrame, path: str, *, partition_cols: Sequence[str] = ("cell_id",), as_version: bool = False
) -> None:
    """Replace a Parquet table, by default one directory per cell so that cell filters prune."""
    _write(df, path, "parquet", partition_cols, as_version)


def flatten(df: DataFrame) -> DataFrame:
    """Nested structs as dotted columns; arrays and maps stay whole."""
    def walk(fields: Sequence[T.StructField], at: Column | None, prefix: str) -> list[Column]:
        out = []
        for f in fields:
            col = F.col(f"`{f.name}`") if at is None else at.getField(f.name)
            name = f"{prefix}{f.name}"
            out += walk(f.dataType.fields, col, name + ".") if isinstance(f.dataType, T.StructType) else [col.alias(name)]
        return out
    return df.select(*walk(df.schema.fields, None, ""))


def table_of(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Exactly the given fields: others are dropped, missing ones are empty."""
    have = set(df.columns)
    return df.select(*[F.col(f) if f in have else F.lit(None).cast("string").alias(f) for f in fields])


def write_csv(df: DataFrame, path: str, fields: Sequence[str], *, as_version: bool = False) -> None:
    """Replace a CSV table of the given fields once the new one is complete."""
    _write(table_of(df, fields), path, "csv", (), as_version, header=True)


def response_cache(scored: DataFrame, limit: int | None = None, order: Sequence[str] = ("cell_id", "id", "sample_index")) -> DataFrame:
    """Ten-column subset of scored rows, optionally the first ``limit`` in a fixed order."""
    types = {**{f: "string" for f in CACHE_FIELDS}, "correct": "boolean", "seed": "int"}
    df = ensure_columns(scored, **types, gold_letter="string", sample_index="int")
    if limit:
        df = df.orderBy(*order).limit(limit)
    return df.withColumn("gold_answer", gold_or_letter()).select(*CACHE_FIELDS)


def cache_manifest(cache: DataFrame, *, source: str, git_commit: str) -> DataFrame:
    """Row count and origin of a cache; stored beside it, not inside."""
    return cache.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(source).alias("source"), F.lit(git_commit).alias("git_commit"), "n_rows"
    )
