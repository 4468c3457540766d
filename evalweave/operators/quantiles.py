"""Exact percentiles of many columns at once, with bounded memory per group.

The built-in exact ``percentile`` keeps every distinct value of a group in one buffer.  Here a
quantile sketch first brackets each wanted rank; then only the rows inside the brackets, a
fraction of a percent of a large group, are ranked exactly.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalweave.plans.shared import small_side

ACCURACY = 10_000
# The sketch errs by at most n / ACCURACY ranks; the bracket allows ten times that.
MARGIN = 10.0 / ACCURACY
# From here on the margin is worth five ranks, more than the sketch and the two neighbours of an
# interpolated rank need; the bracket of a smaller group is its whole range.
WHOLE_ROWS = 5 * ACCURACY // 10


def _positions(n: Column, prob: float, upper: bool) -> tuple[Column, Column]:
    """0-based rank below and fraction above it for a linearly interpolated percentile."""
    if upper:
        return F.floor(n / 2), F.lit(0.0)
    at = (n - 1) * F.lit(prob)
    return F.floor(at), at - F.floor(at)


def exact_percentiles(
    df: DataFrame,
    fields: Sequence[str],
    probs: Sequence[float] = (0.5,),
    *,
    group_cols: Sequence[str] = ("cell_id",),
    upper: bool = False,
) -> DataFrame:
    """One row per (group, field, prob) with its exact percentile ``value``.

    ``upper=True`` returns the element at index n // 2 instead of interpolating.  Fields that
    hold no value in a group yield no row.
    """
    keys = [F.col(c) for c in group_cols]
    rows = df.select(*keys, *[F.col(f).cast("double").alias(f) for f in fields])

    def bracket(field: str, prob: float) -> Column:
        lo, hi = max(0.0, prob - MARGIN), min(1.0, prob + MARGIN)
        return F.percentile_approx(field, F.array(F.lit(lo), F.lit(hi)), F.lit(ACCURACY))

    pairs = [(i, f, j, p) for i, f in enumerate(fields) for j, p in enumerate(probs)]
    brackets = small_side(
        rows.groupBy(*group_cols).agg(
            *[F.count(f).alias(f"_n{i}") for i, f in enumerate(fields)],
            *[F.array(F.min(f), F.max(f)).alias(f"_all{i}") for i, f in enumerate(fields)],
            *[bracket(f, p).alias(f"_b{i}_{j}") for i, f, j, p in pairs],
        ).withColumns({
            f"_b{i}_{j}": F.when(F.col(f"_n{i}") < WHOLE_ROWS, F.col(f"_all{i}")).otherwise(F.col(f"_b{i}_{j}"))
            for i, _, j, _ in pairs
        }).drop(*[f"_all{i}" for i in range(len(fields))])
    )
    same_group = [rows[c].eqNullSafe(brackets[c]) for c in group_cols]
    joined = rows.join(brackets, same_group, "inner").drop(*[brackets[c] for c in group_cols])

    def item(i: int, f: str, j: int, p: float) -> Column:
        lo, hi = F.col(f"_b{i}_{j}")[0], F.col(f"_b{i}_{j}")[1]
        return F.when(
            F.col(f).between(lo, hi),
            F.struct(F.lit(f).alias("field"), F.lit(float(p)).alias("prob"),
                     F.col(f).alias("value"), F.col(f"_n{i}").alias("n")),
        )

    inner = reduce(or_, [F.col(f).between(F.col(f"_b{i}_{j}")[0], F.col(f"_b{i}_{j}")[1]) for i, f, j, _ in pairs])
    # Rows inside a bracket, collapsed to distinct values before any ranking.
    inside = (
        joined.where(inner).select(*keys, F.explode(F.array_compact(F.array(*[item(*x) for x in pairs]))).alias("x"))
        .select(*keys, "x.*")
        .groupBy(*group_cols, "field", "prob", "value", "n")
        .agg(F.count(F.lit(1)).alias("m"))
    )
    below = joined.groupBy(*group_cols).agg(
        *[F.count_if(F.col(f) < F.col(f"_b{i}_{j}")[0]).alias(f"_below{i}_{j}") for i, f, j, _ in pairs]
    )
    below = below.select(
        *keys,
        F.explode(F.array(*[
            F.struct(F.lit(f).alias("field"), F.lit(float(p)).alias("prob"),
                     F.col(f"_below{i}_{j}").alias("below"))
            for i, f, j, p in pairs
        ])).alias("x"),
    ).select(*keys, "x.*")

    by = [*group_cols, "field", "prob"]
    upto = Window.partitionBy(*by).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = inside.withColumn("upto", F.sum("m").over(upto)).alias("r")
    below = below.alias("b")
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    at = ranked.join(below, on).select(
        *[F.col(f"r.{c}") for c in by], "value", "n",
        (F.col("upto") + F.col("below")).alias("last"),
        (F.col("upto") + F.col("below") - F.col("m")).alias("first"),
    )
    # A value covers the 0-based ranks first .. last-1.
    covers = lambda rank: (F.col("first") <= rank) & (rank < F.col("last"))
    picks = []
    for prob in probs:
        rank, frac = _positions(F.col("n"), float(prob), upper)
        nxt = F.least(rank + 1, F.col("n") - 1)
        picks.append((F.lit(float(prob)), rank, nxt, frac))
    choose = lambda k: F.coalesce(*[F.when(F.col("prob") == p[0], p[k]) for p in picks])
    at = at.withColumns({"_lo": choose(1), "_hi": choose(2), "_frac": choose(3)})
    low = F.max(F.when(covers(F.col("_lo")), F.col("value")))
    high = F.max(F.when(covers(F.col("_hi")), F.col("value")))
    frac = F.max("_frac")
    return at.groupBy(*by).agg(
        F.max("n").alias("n"),
        F.when(frac == 0, low).otherwise(low * (1 - frac) + high * frac).alias("value"),
    )


def percentile_columns(
    df: DataFrame,
    named: dict[str, tuple[str, float]],
    *,
    group_cols: Sequence[str] = ("cell_id",),
    upper: bool = False,
) -> DataFrame:
    """Wide form: one row per group, one column per ``{name: (field, prob)}``."""
    fields = list(dict.fromkeys(f for f, _ in named.values()))
    probs = list(dict.fromkeys(p for _, p in named.values()))
    long = exact_percentiles(df, fields, probs, group_cols=group_cols, upper=upper)
    return long.groupBy(*group_cols).agg(*[
        F.max(F.when((F.col("field") == f) & (F.col("prob") == float(p)), F.col("value"))).alias(name)
        for name, (f, p) in named.items()
    ])
