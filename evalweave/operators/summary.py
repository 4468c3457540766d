"""Cell summaries: accuracy, latency, tokens, failures, trace length, cost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.functions.scoring import ensure_columns, failure_flags, is_true, query_cost
from evalweave.operators.calibration import merge_groups
from evalweave.operators.quantiles import percentile_columns

# Telemetry fields of a summary; the marked ones also report their maximum.
NUMERIC_FIELDS = {
    "time_to_first_token_sec": False,
    "tokens_per_second": False,
    "decode_tokens_per_second": False,
    "seconds_per_output_token": False,
    "vram_before_gb": False,
    "vram_after_gb": False,
    "vram_max_gb": True,
    "gpu_util_mean": False,
    "gpu_util_max": True,
    "power_watts_mean": False,
    "power_watts_max": True,
    "tokens_per_joule": False,
}


def accuracy_columns() -> list[Column]:
    hits = F.count_if(is_true(F.col("correct")))
    return [
        F.count(F.lit(1)).alias("n"),
        F.avg(is_true(F.col("correct")).cast("int")).alias("pass_at_1"),
        hits.alias("num_correct"),
    ]


def latency_columns() -> list[Column]:
    return [
        F.avg("latency_sec").alias("latency_sec_mean"),
        F.max("peak_vram_gb").alias("peak_vram_gb_max"),
        F.avg("peak_vram_gb").alias("peak_vram_gb_mean"),
        F.avg("prompt_tokens").alias("prompt_tokens_mean"),
    ]


def numeric_columns(fields: dict[str, bool]) -> list[Column]:
    out = []
    for name, with_max in fields.items():
        out.append(F.avg(name).alias(f"{name}_mean"))
        if with_max:
            out.append(F.max(name).alias(f"{name}_max"))
    return out


def failure_columns(df: DataFrame) -> list[Column]:
    names = {
        "parse_failure": ("parse_failure_rate", "num_parse_failures"),
        "empty_completion": ("empty_completion_rate", "num_empty_completions"),
        "truncated_row": ("truncation_rate", "num_truncated"),
        "invalid_answer": ("invalid_answer_rate", "num_invalid_answers"),
    }
    out = []
    for flag, column in failure_flags(df).items():
        rate, count = names[flag]
        out += [F.avg(column.cast("int")).alias(rate), F.count_if(column).alias(count)]
    return out


def trace_columns() -> list[Column]:
    """Mean steps and tokens; zero token counts fall back to the estimate or are left out."""
    tokens = F.coalesce(F.nullif(F.col("completion_tokens"), F.lit(0)), F.col("completion_tokens_est"))
    return [
        F.avg("reasoning_steps").alias("reasoning_steps_mean"),
        F.coalesce(F.avg(tokens), F.avg("completion_tokens")).alias("completion_tokens_mean"),
    ]


def cost_columns(gpu_hour_rate: float | None = None) -> list[Column]:
    """Total seconds, cost per correct (A8) and cost of pass (A9); NULL when nothing is correct."""
    cost = F.coalesce(query_cost(F.col("latency_sec"), gpu_hour_rate), F.lit(0.0))
    hits = F.count_if(is_true(F.col("correct")))
    return [
        F.sum(F.coalesce(F.col("latency_sec"), F.lit(0.0))).alias("total_gpu_seconds"),
        F.try_divide(F.sum(cost), F.nullif(hits, F.lit(0))).alias("cost_per_correct_seconds"),
        F.try_divide(
            F.avg(cost), F.nullif(F.avg(is_true(F.col("correct")).cast("double")), F.lit(0.0))
        ).alias("cost_of_pass_seconds"),
    ]


def energy_columns() -> list[Column]:
    return [F.sum("energy_joules").alias("energy_joules_total"), F.avg("energy_joules").alias("energy_joules_mean")]


def with_summary_columns(df: DataFrame) -> DataFrame:
    return ensure_columns(
        df, latency_sec="double", peak_vram_gb="double", prompt_tokens="long", completion_tokens="long",
        completion_tokens_est="long", reasoning_steps="int", energy_joules="double", finish_reason="string",
        pred_answer="string", correct="boolean", **{f: "double" for f in NUMERIC_FIELDS},
    )


def finish_reason_counts(df: DataFrame, *, group_cols: Sequence[str] = ("cell_id",)) -> DataFrame:
    """Histogram of finish reasons as a long table (A5)."""
    return (
        df.filter(F.col("finish_reason").isNotNull())
        .groupBy(*group_cols, "finish_reason")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def numeric_summary(
    df: DataFrame, fields: dict[str, bool], *, group_cols: Sequence[str] = ("cell_id",)
) -> DataFrame:
    """Mean, exact median and optional maximum of numeric fields (A3)."""
    base = df.groupBy(*group_cols).agg(*numeric_columns(fields))
    medians = percentile_columns(df, {f"{f}_p50": (f, 0.5) for f in fields}, group_cols=group_cols)
    return merge_groups([base, medians], group_cols)


def cell_summary(
    df: DataFrame, *, group_cols: Sequence[str] = ("cell_id",), medians: bool = True
) -> DataFrame:
    """The summary of every group: one aggregate over the scored rows, then medians (A1-A10)."""
    own = set(df.columns)
    df = with_summary_columns(df)
    base = df.groupBy(*group_cols).agg(
        *accuracy_columns(), *latency_columns(), *numeric_columns(NUMERIC_FIELDS), *energy_columns(),
        *failure_columns(df), *trace_columns(), *cost_columns(),
    )
    parts = [base]
    if medians:
        fields = ["latency_sec", "completion_tokens", *NUMERIC_FIELDS]
        held = [f for f in fields if f in own] or fields[:1]  # a field that no row has takes no sketch
        found = percentile_columns(df, {f"{f}_p50": (f, 0.5) for f in held}, group_cols=group_cols)
        parts.append(found.select(*group_cols, *[
            F.col(f"{f}_p50") if f in held else F.lit(None).cast("double").alias(f"{f}_p50") for f in fields]))
    # A handful of finish reasons per group.
    reasons = finish_reason_counts(df, group_cols=group_cols).groupBy(*group_cols).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("finish_reason", "rows")))).alias("finish_reason_counts")
    )
    return merge_groups([*parts, reasons], group_cols)


def cost_from_totals(summaries: DataFrame, gpu_hour_rate: float | None = None) -> DataFrame:
    """Cost per correct answer from summary totals, in seconds or USD."""
    cost = query_cost(F.col("total_gpu_seconds"), gpu_hour_rate)
    name = "cost_per_correct" if gpu_hour_rate is None else "cost_per_correct_usd"
    return summaries.withColumn(name, F.try_divide(cost, F.nullif(F.col("num_correct"), F.lit(0))))


def profile_summary(df: DataFrame, *, group_cols: Sequence[str] = ("cell_id",)) -> DataFrame:
    """Latency mean and upper median, VRAM maximum and mean."""
    base = df.groupBy(*group_cols).agg(
        F.avg("latency_sec").alias("latency_sec_mean"),
        F.max("peak_vram_gb").alias("peak_vram_gb_max"),
        F.avg("peak_vram_gb").alias("peak_vram_gb_mean"),
    )
    p50 = percentile_columns(df, {"latency_sec_p50": ("latency_sec", 0.5)}, group_cols=group_cols, upper=True)
    return merge_groups([base, p50], group_cols)


def tail_latency(
    df: DataFrame, *, group_cols: Sequence[str] = ("cell_id",), probs: Sequence[float] = (0.5, 0.95, 0.99)
) -> DataFrame:
    """Latency percentiles and token throughput per group."""
    named = {f"latency_sec_p{round(p * 100)}": ("latency_sec", p) for p in probs}
    rate = df.groupBy(*group_cols).agg(
        F.try_divide(F.sum("completion_tokens"), F.sum("latency_sec")).alias("tokens_per_second")
    )
    return merge_groups([rate, percentile_columns(df, named, group_cols=group_cols)], group_cols)
