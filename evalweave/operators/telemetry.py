"""Device telemetry and serving metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalweave.functions.scoring import ensure_columns, is_true
from evalweave.operators.calibration import join_groups

GB = 1024**3


def integrate_samples(
    samples: DataFrame, *, group_cols: Sequence[str] = ("device",), bucket_seconds: int = 3600
) -> DataFrame:
    """Peak memory, utilisation, power and energy per device or run.

    Energy sums power times the gap to the sample before it.  Gaps are taken inside time
    buckets, so a device with very many samples is split; the gap across a bucket edge follows
    from the first and last sample of neighbouring buckets.  The result does not depend on the
    bucket length.
    """
    df = ensure_columns(samples, mem_bytes="long", util="double", power="double", sample_id="long")
    second = F.col("ts").cast("timestamp").cast("double")
    df = df.withColumns({"_sec": second, "_bucket": F.floor(second / bucket_seconds)})
    in_bucket = Window.partitionBy(*group_cols, "_bucket").orderBy("ts", "sample_id")
    gap = F.greatest(F.lit(0.0), F.col("_sec") - F.lag("_sec").over(in_bucket))
    first = F.struct("ts", "sample_id")
    buckets = df.withColumn("_energy", F.col("power") * gap).groupBy(*group_cols, "_bucket").agg(
        F.count(F.lit(1)).alias("samples"),
        F.max("mem_bytes").alias("peak_bytes"),
        F.max("util").alias("util_max"), F.sum("util").alias("util_sum"),
        F.max("power").alias("power_max"), F.sum("power").alias("power_sum"),
        F.count("power").alias("powered"),
        F.sum("_energy").alias("energy"),
        F.min("_sec").alias("first_sec"), F.max("_sec").alias("last_sec"),
        F.min_by("power", first).alias("first_power"),
    )
    across = Window.partitionBy(*group_cols).orderBy("_bucket")
    edge = F.col("first_power") * F.greatest(F.lit(0.0), F.col("first_sec") - F.lag("last_sec").over(across))
    n = F.sum("samples")
    energy = F.sum(F.coalesce("energy", F.lit(0.0)) + F.coalesce("_edge", F.lit(0.0)))
    return buckets.withColumn("_edge", edge).groupBy(*group_cols).agg(
        n.alias("samples"),
        (F.max("peak_bytes") / GB).alias("peak_vram_gb"),
        (F.sum("util_sum") / n).alias("gpu_util_mean"),
        F.max("util_max").alias("gpu_util_max"),
        # The mean divides by all samples, also those without a power reading.
        (F.coalesce(F.sum("power_sum"), F.lit(0.0)) / n).alias("power_watts_mean"),
        F.max("power_max").alias("power_watts_max"),
        F.when(F.sum("powered") > 0, energy).alias("energy_joules"),
    )


def serving_metrics(df: DataFrame, *, batch_cols: Sequence[str] = ("batch_id",)) -> DataFrame:
    """Per-response latency, throughput and energy from batch measurements.

    Expects batch_latency_sec, batch_energy_joules, arrival and first-token seconds, token
    counts, VRAM bytes and completion.  The batch size is a pre-aggregated count, not a window
    over the batch.
    """
    df = ensure_columns(
        df, batch_energy_joules="double", first_token_time="double", arrival_time="double", completion="string",
        finish_reason="string", max_tokens="long", vram_before_bytes="long", vram_after_bytes="long",
        vram_peak_bytes="long",
    )
    sizes = df.groupBy(*batch_cols).agg(F.count(F.lit(1)).alias("batch_size"))
    latency = F.col("latency_sec")
    out = join_groups([df, sizes], batch_cols).withColumns({
        "latency_sec": F.col("batch_latency_sec") / F.col("batch_size"),
        "energy_joules": F.col("batch_energy_joules") / F.col("batch_size"),
        "time_to_first_token_sec": F.when(
            F.col("first_token_time").isNotNull() & F.col("arrival_time").isNotNull(),
            F.greatest(F.lit(0.0), F.col("first_token_time") - F.col("arrival_time")),
        ),
        "total_tokens": F.col("prompt_tokens") + F.col("completion_tokens"),
        "completion_chars": F.length("completion"),
        "vram_before_gb": F.col("vram_before_bytes") / GB,
        "vram_after_gb": F.col("vram_after_bytes") / GB,
        "vram_max_gb": F.greatest("vram_before_bytes", "vram_after_bytes", "vram_peak_bytes") / GB,
        "truncated": is_true(F.col("finish_reason") == "length")
        | is_true(F.col("completion_tokens") >= F.coalesce("max_tokens", F.lit(32768))),
    })
    decode = F.coalesce(F.greatest(latency - F.col("time_to_first_token_sec"), F.lit(0.0)), latency)
    positive = lambda c: F.when(c > 0, c)
    return out.withColumns({
        "tokens_per_second": F.try_divide(F.col("total_tokens"), positive(latency)),
        "decode_tokens_per_second": F.try_divide(F.col("completion_tokens"), positive(decode)),
        "seconds_per_output_token": F.try_divide(latency, F.nullif(F.col("completion_tokens"), F.lit(0))),
        "tokens_per_joule": F.try_divide(F.col("completion_tokens"), positive(F.col("energy_joules"))),
        "peak_vram_gb": F.col("vram_max_gb"),
    })
