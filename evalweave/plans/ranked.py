"""Ranks and running totals inside groups of any size.

A window over one group would sort the whole group in one task.  Here the rows are range
partitioned on (group, order keys), so a large group spans many slices; running values are
taken inside each slice and shifted by the totals of the slices before it.  The slice
assignment is written out once, because two evaluations of a range partitioning may cut the
data at different points.

Where all groups are counted first and found small, ``fits_window`` allows the plain window, which
needs one shuffle less.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalweave.plans.shared import cut


WINDOW_ROWS = 100_000


def fits_window(df: DataFrame, group_cols: Sequence[str], limit: int = WINDOW_ROWS) -> bool:
    """Whether no group has more than ``limit`` rows, by count."""
    sizes = df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("rows"))
    return (sizes.agg(F.max("rows")).first()[0] or 0) <= limit


def with_running(
    df: DataFrame,
    group_cols: Sequence[str],
    order: Sequence[Column],
    sums: Mapping[str, str] | None = None,
    *,
    least_before: Mapping[str, str] | None = None,
    greatest_upto: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add ``rank`` (1-based in the group), ``group_rows``, running sums, minima and maxima.

    Each mapping goes from an output name to the column it runs over: ``sums`` and ``greatest_upto``
    include the current row, ``least_before`` has the rows before it alone (NULL for the first).
    ``order`` must determine the row order fully.  NULL group keys form a group of their own.
    """
    sums, least, most = dict(sums or {}), dict(least_before or {}), dict(greatest_upto or {})
    group = F.struct(*[F.col(c) for c in group_cols]) if group_cols else F.struct(F.lit(0).alias("all"))
    placed = cut(
        df.withColumn("_group", group)
        .repartitionByRange(F.col("_group"), *order)
        .withColumn("_slice", F.spark_partition_id())
    )
    upto = Window.partitionBy("_group", "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("_group", "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumns({
        "_local_rank": F.count(F.lit(1)).over(upto),
        **{f"_local_{n}": F.sum(c).over(upto) for n, c in sums.items()},
        **{f"_local_{n}": F.min(c).over(earlier) for n, c in least.items()},
        **{f"_local_{n}": F.max(c).over(upto) for n, c in most.items()},
    })

    # One row per (group, slice): at most groups + slices rows.
    totals = placed.groupBy("_group", "_slice").agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()],
        *[F.min(c).alias(f"_sum_{n}") for n, c in least.items()], *[F.max(c).alias(f"_sum_{n}") for n, c in most.items()],
    )
    before = Window.partitionBy("_group").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_group")
    offsets = totals.select(
        F.col("_group"),
        F.col("_slice"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        F.sum("_rows").over(whole).alias("group_rows"),
        *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in sums],
        *[F.min(f"_sum_{n}").over(before).alias(f"_before_{n}") for n in least],
        *[F.max(f"_sum_{n}").over(before).alias(f"_before_{n}") for n in most],
    )
    joined = local.join(offsets, ["_group", "_slice"])
    return joined.withColumns({
        "rank": F.col("_local_rank") + F.col("_rows_before"),
        **{n: F.coalesce(F.col(f"_local_{n}"), F.lit(0)) + F.col(f"_before_{n}") for n in sums},
        # least and greatest pass over NULL
        **{n: F.least(f"_local_{n}", f"_before_{n}") for n in least},
        **{n: F.greatest(f"_local_{n}", f"_before_{n}") for n in most},
    }).drop(
        "_group", "_slice", "_local_rank", "_rows_before",
        *[f"_{part}_{n}" for part in ("local", "before") for n in (*sums, *least, *most)],
    )
