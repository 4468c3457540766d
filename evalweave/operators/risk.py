"""Selective risk: risk-coverage curve, its area, and coverage at fixed risk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.operators.calibration import TIE_KEYS, availability, confidence_pairs, confidence_rows, merge_groups
from evalweave.plans.ranked import with_running

TARGET_RISKS = (0.05, 0.10, 0.20)


def descending(pairs: DataFrame, group_cols: Sequence[str] = ("cell_id",)) -> DataFrame:
    """Pairs with their position by falling confidence and the hits up to it."""
    order = [F.desc("conf"), *[F.asc(k) for k in TIE_KEYS], F.asc("y")]
    return with_running(pairs, group_cols, order, {"hits": "y"})


def risk_coverage_curve(ranked: DataFrame, *, group_cols: Sequence[str] = ("cell_id",)) -> DataFrame:
    """(group, k, coverage, risk) for every k (W1); ``ranked`` comes from ``descending``."""
    return ranked.select(
        *group_cols,
        F.col("rank").alias("k"),
        (F.col("rank") / F.col("group_rows")).alias("coverage"),
        (1 - F.col("hits") / F.col("rank")).alias("risk"),
    )


def aurc(ranked: DataFrame, *, group_cols: Sequence[str] = ("cell_id",)) -> DataFrame:
    """Trapezoid area under the curve from 1/n to 1 (W2); the point before follows from the totals."""
    risk = 1 - F.col("hits") / F.col("rank")
    risk_before = 1 - F.try_divide(F.col("hits") - F.col("y"), F.col("rank") - 1)
    panel = (risk + risk_before) / 2 / F.col("group_rows")
    return ranked.groupBy(*group_cols).agg(F.coalesce(F.sum(panel), F.lit(0.0)).alias("aurc"))


def coverage_at_risk(
    ranked: DataFrame, *, group_cols: Sequence[str] = ("cell_id",), targets: Sequence[float] = TARGET_RISKS
) -> DataFrame:
    """Per group: for each target the widest coverage within it, else coverage 0 and risk 1."""
    curve = risk_coverage_curve(ranked, group_cols=group_cols)
    columns = []
    for target in targets:
        ok = F.col("risk") <= F.lit(target)
        name = f"{round(target * 100)}pct"
        columns += [
            F.coalesce(F.max(F.when(ok, F.col("coverage"))), F.lit(0.0)).alias(f"coverage_at_risk_{name}"),
            F.coalesce(
                F.max_by(F.col("risk"), F.when(ok, F.col("k"))), F.lit(1.0)
            ).alias(f"achieved_risk_{name}"),
        ]
    return curve.groupBy(*group_cols).agg(*columns)


def selective_risk_summary(
    df: DataFrame, *, group_cols: Sequence[str] = ("cell_id",), allow_parse_proxy: bool = False,
    targets: Sequence[float] = TARGET_RISKS,
) -> DataFrame:
    """AURC and coverage at risk behind the availability gate (A45); the curve is W1's long table."""
    # Thin rows, read by the gate, the sample of the ranges and the ranges.
    rows = confidence_rows(df, group_cols=group_cols, allow_parse_proxy=allow_parse_proxy)
    gate = availability(rows, group_cols=group_cols, allow_parse_proxy=allow_parse_proxy)
    ranked = descending(confidence_pairs(rows, group_cols=group_cols), group_cols)
    found = [aurc(ranked, group_cols=group_cols), coverage_at_risk(ranked, group_cols=group_cols, targets=targets)]
    out = merge_groups([gate, *found], group_cols)
    kept = [c for part in found for c in part.columns if c not in group_cols]
    return out.withColumn("skipped", ~F.col("available")).withColumns(
        {c: F.when(F.col("available"), F.col(c)) for c in kept}
    )
