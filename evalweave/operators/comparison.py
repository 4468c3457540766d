"""Paired and multi-seed comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalweave.functions.scoring import is_true
from evalweave.functions.stats import erfc, erfc_expression, mean_std_text
from evalweave.operators.bootstrap import cluster_bootstrap_ci
from evalweave.operators.calibration import merge_groups
from evalweave.plans.ranked import WINDOW_ROWS, fits_window, with_running
from evalweave.plans.shared import cut


def last_per_item(
    df: DataFrame, *, seq: str = "sample_index", group_cols: Sequence[str] = ("cell_id",)
) -> DataFrame:
    """The last row's correctness per (group, id), ids non-empty.

    ``max_by`` combines on the map side, so an item with very many rows is not gathered.
    """
    item = F.coalesce(F.col("id").cast("string"), F.lit(""))
    order = F.struct(F.coalesce(F.col(seq), F.lit(0)), is_true(F.col("correct")))
    return (
        df.filter(item != "")
        .groupBy(*group_cols, item.alias("id"))
        .agg(F.max_by(is_true(F.col("correct")), order).alias("correct"))
    )


def paired_items(df: DataFrame, baseline: str, *, cell_col: str = "cell_id", seq: str = "sample_index") -> DataFrame:
    """(cell, id, base, var) for the items each variant shares with the baseline."""
    items = last_per_item(df, seq=seq, group_cols=(cell_col,))
    base = items.filter(F.col(cell_col) == baseline).select("id", F.col("correct").alias("base"))
    variants = items.filter(F.col(cell_col) != baseline).withColumnRenamed("correct", "var")
    return variants.join(base, "id", "inner")


def mcnemar_columns(b: Column, c: Column, p_value=erfc) -> dict[str, Column]:
    """Continuity-corrected McNemar statistic and two-sided p."""
    n = b + c
    gap = (F.abs(b - c) - 1).cast("double")
    stat = F.when(n == 0, 0.0).otherwise(F.try_divide(gap * gap, n))
    return {
        "n_discordant": n,
        "statistic": stat,
        "p_value": F.when(n == 0, 1.0).otherwise(p_value(F.sqrt(stat / 2.0))),
    }


def compare_with_baseline(
    df: DataFrame, baseline: str, *, cell_col: str = "cell_id", seq: str = "sample_index",
    exact_p: bool = True, require_overlap: bool = False,
) -> DataFrame:
    """One McNemar row per variant, Holm-adjusted over all variants (E3 without intervals).

    A variant without a common item keeps a row with ``n_items`` 0, or raises if
    ``require_overlap``.
    """
    pairs = paired_items(df, baseline, cell_col=cell_col, seq=seq)
    counts = pairs.groupBy(cell_col).agg(
        F.count(F.lit(1)).alias("n_items"),
        F.avg(F.col("base").cast("int")).alias("baseline_pass_at_1"),
        F.avg(F.col("var").cast("int")).alias("variant_pass_at_1"),
        F.count_if(F.col("base") & ~F.col("var")).alias("b"),
        F.count_if(~F.col("base") & F.col("var")).alias("c"),
    )
    variants = df.filter(F.col(cell_col) != baseline).select(cell_col).distinct()
    out = merge_groups([variants, counts], [cell_col]).withColumn(
        "n_items", F.coalesce("n_items", F.lit(0))
    )
    if require_overlap:
        out = out.withColumn(
            "n_items",
            F.when(F.col("n_items") > 0, F.col("n_items")).otherwise(
                F.raise_error(F.lit("No overlapping item ids between baseline and variant"))
            ),
        )
    out = out.withColumns(
        mcnemar_columns(F.col("b"), F.col("c"), erfc if exact_p else erfc_expression)
    ).withColumn(
        "effect_rate_diff",
        F.when(F.col("n_discordant") == 0, 0.0).otherwise(F.col("variant_pass_at_1") - F.col("baseline_pass_at_1")),
    )
    return holm_adjusted(out.withColumn("baseline", F.lit(baseline)), "p_value", ["baseline"], [cell_col])


def holm_adjusted(
    df: DataFrame, p_col: str, family: Sequence[str], tie_keys: Sequence[str], name: str = "p_value_holm",
    window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """Holm step-down adjusted p-values within a family of comparisons.

    Families are counted: up to ``window_rows`` rows one window serves, beyond that ranks and the running
    maximum are taken in slices and no task holds a family.  A NULL p-value has no adjusted one.
    """
    fixed, order = cut(df), [F.col(p_col).asc_nulls_last(), *map(F.col, tie_keys)]
    if fits_window(fixed, family, window_rows):
        window = Window.partitionBy(*family).orderBy(*order)
        m = F.count(p_col).over(Window.partitionBy(*family))
        raw = F.least(F.lit(1.0), (m - F.row_number().over(window) + 1) * F.col(p_col))
        steps = fixed.withColumn("_raw", raw).withColumn(
            "_most", F.max("_raw").over(window.rowsBetween(Window.unboundedPreceding, 0)))
    else:
        tested = with_running(fixed.filter(F.col(p_col).isNotNull()), family, order)
        raw = F.least(F.lit(1.0), (F.col("group_rows") - F.col("rank") + 1) * F.col(p_col))
        stepped = tested.withColumn("_raw", raw).drop("rank", "group_rows")
        steps = with_running(stepped, family, order, greatest_upto={"_most": "_raw"}).unionByName(
            fixed.filter(F.col(p_col).isNull()), allowMissingColumns=True)
    adjusted = F.when(F.col(p_col).isNotNull(), F.col("_most"))
    return steps.select(*[c for c in fixed.columns if c != name], adjusted.alias(name))


def paired_report(df: DataFrame, baseline: str, *, cell_col: str = "cell_id", **options: object) -> DataFrame:
    """Comparison rows with a cluster bootstrap interval of the variant's pass rate."""
    rows = compare_with_baseline(df, baseline, cell_col=cell_col)
    pairs = paired_items(df, baseline, cell_col=cell_col).withColumnRenamed("var", "correct")
    ci = cluster_bootstrap_ci(pairs, group_cols=[cell_col], **options).drop("value", "n_clusters")
    return merge_groups([rows, ci], [cell_col])


def seed_variance(
    summaries: DataFrame, metric: str = "pass_at_1", *, family_cols: Sequence[str] = ("family",), digits: int = 1
) -> DataFrame:
    """Mean, sample deviation and member cells of a metric over the seeds of a family."""
    mean, std = F.coalesce(F.avg(metric), F.lit(0.0)), F.coalesce(F.stddev_samp(metric), F.lit(0.0))
    return summaries.groupBy(*family_cols).agg(
        F.lit(metric).alias("metric"),
        F.count(metric).alias("n_seeds"),
        mean.alias("mean"),
        std.alias("std"),
        mean_std_text(mean, std, digits).alias("formatted"),
        # One entry per seed of the family.
        F.sort_array(F.collect_list("cell_id")).alias("summaries"),
    )


def cost_of_pass_ratio(summaries: DataFrame, baseline: str) -> DataFrame:
    """Each cell's cost of pass relative to the baseline cell."""
    base = summaries.filter(F.col("cell_id") == baseline).agg(F.max("cost_of_pass_seconds").alias("_base"))
    # The right side is one aggregate row.
    return summaries.crossJoin(F.broadcast(base)).select(
        "cell_id", F.try_divide("cost_of_pass_seconds", F.nullif(F.col("_base"), F.lit(0.0))).alias("cost_of_pass_ratio")
    )


def rank_reversal_rate(
    summaries: DataFrame, metric: str = "pass_at_1", *, config_col: str = "family", seed_col: str = "seed"
) -> DataFrame:
    """Share of seed pairs in which the order of two configurations flips, per configuration pair.

    For one pair of configurations the flips follow from how many seeds put one ahead, so seeds
    are never paired with each other.
    """
    a, b = summaries.alias("a"), summaries.alias("b")
    same_seed = (F.col(f"a.{seed_col}") == F.col(f"b.{seed_col}")) & (F.col(f"a.{config_col}") < F.col(f"b.{config_col}"))
    signs = a.join(b, same_seed).groupBy(
        F.col(f"a.{config_col}").alias("config_a"), F.col(f"b.{config_col}").alias("config_b")
    ).agg(
        F.count_if(F.col(f"a.{metric}") > F.col(f"b.{metric}")).alias("ahead"),
        F.count_if(F.col(f"a.{metric}") < F.col(f"b.{metric}")).alias("behind"),
        F.count(F.lit(1)).alias("n_seeds"),
    )
    pairs = F.col("n_seeds") * (F.col("n_seeds") - 1) / 2
    return signs.withColumn("reversal_rate", F.try_divide(F.col("ahead") * F.col("behind"), pairs))
