"""End-to-end jobs: score a run, multi-sample report, comparison, archive tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.functions import identity
from evalweave.functions.scoring import ensure_columns, is_true, resolve_confidence, score_responses
from evalweave.operators import bootstrap, calibration, risk, summary
from evalweave.operators.calibration import join_groups, merge_groups
from evalweave.plans.shared import cut
from evalweave.sources import writers


def scored_table(responses: DataFrame, path: str, *, allow_parse_proxy: bool = False) -> DataFrame:
    """Score once and store without text; every report then reads only the columns it needs."""
    scored = resolve_confidence(score_responses(responses, keep_text=False), allow_parse_proxy=allow_parse_proxy)
    writers.write_parquet(scored, path)
    # The written types: a partition folder named 007 stays the text 007.
    return responses.sparkSession.read.schema(scored.schema).parquet(path)


def summary_with_intervals(
    scored: DataFrame, *, group_cols: Sequence[str] = ("cell_id",), n_resamples: int = bootstrap.RESAMPLES
) -> DataFrame:
    """Cell summary with pass-rate, cluster and cost intervals."""
    rename = lambda df, prefix: df.select(
        *group_cols, F.col("ci_low").alias(f"{prefix}_ci95_low"), F.col("ci_high").alias(f"{prefix}_ci95_high")
    )
    opts = {"group_cols": group_cols, "n_resamples": n_resamples}
    passes = bootstrap.bootstrap_ci(scored, {"x": is_true(F.col("correct")).cast("int")}, **opts)
    # The summary's cost counts the correct answers of all rows, so the interval does as well.
    costs = bootstrap.cost_per_correct_ci(scored, untimed_as_zero=True, **opts)
    clusters = bootstrap.cluster_bootstrap_ci(scored, **opts)
    # Cluster intervals only where every row has an id.
    complete = scored.groupBy(*group_cols).agg(F.bool_and(F.col("id").isNotNull()).alias("_ids"))
    clusters = merge_groups([clusters, complete], group_cols).filter("_ids")
    cluster_cols = rename(clusters, "pass_at_1_cluster")
    sizes = clusters.select(*group_cols, F.col("n_clusters").alias("pass_at_1_n_clusters"))
    return merge_groups(
        [summary.cell_summary(scored, group_cols=group_cols), rename(passes, "pass_at_1"),
         rename(costs, "cost_per_correct_seconds"), cluster_cols, sizes],
        group_cols,
    )


def score_run(
    scored: DataFrame, *, skip_calibration: bool = False, require_calibration: bool = False,
    allow_parse_proxy: bool = False, n_resamples: int = bootstrap.RESAMPLES,
) -> DataFrame:
    """The full report of every cell (A47): summary, identity, intervals, calibration, selective risk."""
    scored = ensure_columns(scored, quant_config="string", seed="int", task="string", model_path="string")
    names = scored.groupBy("cell_id").agg(*[
        F.min(c).alias(c) for c in ("quant_config", "seed", "task", "model_path")
    ])
    parts = [summary_with_intervals(scored, n_resamples=n_resamples), names]
    if not skip_calibration:
        group = ["cell_id"]
        pairs = cut(calibration.confidence_pairs(scored, group_cols=group, allow_parse_proxy=allow_parse_proxy))
        falling = risk.descending(pairs, group)
        cal = calibration.calibration_summary(
            scored, group_cols=group, allow_parse_proxy=allow_parse_proxy, pairs=pairs, falling=falling
        )
        if require_calibration:
            publishable = F.when(F.col("valid_for_publication"), F.lit(True)).otherwise(
                F.raise_error(F.concat(F.col("cell_id"), F.lit(": "), F.col("message")))
            )
            cal = cal.withColumn("valid_for_publication", publishable)
        parts += [cal, risk.coverage_at_risk(falling, group_cols=group)]
    out = merge_groups(parts, ["cell_id"])
    if not skip_calibration:
        # Risk figures follow the same gate as the calibration metrics.
        out = out.withColumns({c: F.when(F.col("available"), F.col(c)) for c in out.columns if "_risk_" in c})
    return out.withColumn("schema_version", F.lit("summary.v1"))


def with_metadata(summaries: DataFrame, metadata: DataFrame) -> DataFrame:
    """Summaries with model id and family from the cell metadata."""
    df = ensure_columns(summaries, model_path="string")
    meta = metadata.select("cell_id", "model_id")
    out = join_groups([df, meta], ["cell_id"], how="left")
    return out.withColumn(
        "model_family", identity.model_family(F.col("cell_id"), F.col("model_path"), F.col("model_id"))
    )


def report_tables(summaries: DataFrame, metadata: DataFrame) -> dict[str, DataFrame]:
    """Main, efficiency and failure tables of an archive."""
    rows = with_metadata(summaries, metadata)
    return {
        "main": writers.table_of(rows, writers.MAIN_FIELDS),
        "efficiency": writers.table_of(rows, writers.EFFICIENCY_FIELDS),
        "failures": writers.table_of(rows, writers.FAILURE_FIELDS),
    }


def leaderboard(summaries: DataFrame) -> DataFrame:
    """Cell, quantization, task, accuracy, truncation and cost of pass."""
    return writers.table_of(
        summaries.withColumnRenamed("cost_of_pass_seconds", "cost_of_pass"),
        ["cell_id", "quant_config", "task", "pass_at_1", "truncation_rate", "cost_of_pass"],
    )
