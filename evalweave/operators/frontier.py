"""Pareto frontier of accuracy against cost over cell summaries.

Inputs hold one row per cell, an aggregate over all its responses.  Families are counted; where one
has more rows than a window should hold, the running minimum of the costs is taken in slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalweave.functions.scoring import ensure_columns
from evalweave.functions.stats import finite
from evalweave.plans.ranked import WINDOW_ROWS, fits_window, with_running
from evalweave.plans.shared import cut


def in_family(summaries: DataFrame, hint: str) -> DataFrame:
    """Cells whose id or model path contains the hint, in any case."""
    df = ensure_columns(summaries, model_path="string")
    text = F.concat_ws(" ", F.coalesce("cell_id", F.lit("")), F.coalesce("model_path", F.lit("")))
    return df.filter(F.lower(text).contains(hint.lower()))


def frontier_points(
    summaries: DataFrame, *, family_cols: Sequence[str] = (), window_rows: int = WINDOW_ROWS
) -> DataFrame:
    """Cells with a finite cost, with a flag for the non-dominated ones.

    A point is on the frontier if it costs less than all points that come before it by accuracy, cost and
    name.  Families of any size: beyond ``window_rows`` no task holds a whole one.
    """
    df = ensure_columns(summaries, quant_config="string", latency_sec_mean="double", peak_vram_gb_max="double")
    points = df.select(
        *family_cols,
        F.coalesce(F.col("cell_id"), F.lit("")).alias("cell_id"),
        F.coalesce(F.col("quant_config"), F.lit("")).alias("quant_config"),
        F.coalesce(F.col("pass_at_1").cast("double"), F.lit(0.0)).alias("pass_at_1"),
        finite(F.col("cost_per_correct_seconds")).alias("cost_per_correct_seconds"),
        F.coalesce(F.col("latency_sec_mean").cast("double"), F.lit(0.0)).alias("latency_sec_mean"),
        "peak_vram_gb_max",
    ).filter(F.col("cost_per_correct_seconds").isNotNull())
    points, order = cut(points), [F.desc("pass_at_1"), F.col("cost_per_correct_seconds"), F.col("cell_id")]
    if fits_window(points, family_cols, window_rows):
        better = Window.partitionBy(*family_cols).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        placed = points.withColumn("_cheapest", F.min("cost_per_correct_seconds").over(better))
    else:
        placed = with_running(points, family_cols, order, least_before={"_cheapest": "cost_per_correct_seconds"})
    on = F.col("_cheapest").isNull() | (F.col("cost_per_correct_seconds") < F.col("_cheapest"))
    return placed.select(*points.columns, on.alias("on_pareto_frontier"))


def frontier_report(summaries: DataFrame, *, family_cols: Sequence[str] = ()) -> DataFrame:
    """Rounded points of the frontier table."""
    return frontier_points(summaries, family_cols=family_cols).withColumns({
        "pass_at_1": F.bround("pass_at_1", 4),
        "cost_per_correct_seconds": F.bround("cost_per_correct_seconds", 2),
        "latency_sec_mean": F.bround("latency_sec_mean", 2),
    })


def frontier_overview(summaries: DataFrame, *, family_cols: Sequence[str] = ()) -> DataFrame:
    """Point counts and frontier members, best accuracy first."""
    on = F.col("on_pareto_frontier")
    return frontier_points(summaries, family_cols=family_cols).groupBy(*family_cols).agg(
        F.count(F.lit(1)).alias("n_points"),
        F.count_if(on).alias("n_frontier"),
        F.transform(
            F.array_sort(F.collect_list(F.when(on, F.struct((-F.col("pass_at_1")).alias("p"), "cell_id")))),
            lambda x: x["cell_id"],
        ).alias("frontier_cell_ids"),
    )
