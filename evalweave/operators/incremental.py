"""Cell summaries that grow with new files instead of a rescan.

The state of a summary has one row per key (by default cell and day) with counts, sums, extremes and a
KLL sketch per numeric field.  States merge: new files add state rows, a summary merges the state rows of
a cell.  Means, extremes and counts are exact; a quantile lies within ``rank_error`` of its rank.  Exact
percentiles over all rows stay in ``quantiles``.

Intervals grow in the same way with the Poisson bootstrap (Chamandy et al., "Estimating uncertainty for
massive data streams", 2012): in a replicate every row counts a Poisson number of times, on its own, so
the sums of a replicate are those of its parts.  The draws of a part depend on the part's rows and key
alone: a part that changed is drawn anew, all others stay, and the result is that of a run over all rows.
The multinomial bootstrap over a fixed number of rows stays in ``bootstrap``.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.functions.scoring import is_true
from evalweave.operators.bootstrap import CHUNK_LEVELS, _generator
from evalweave.plans.shared import cut
from evalweave.sources import versioned

FIELDS = ("latency_sec", "completion_tokens", "prompt_tokens", "peak_vram_gb")
SIZE = 800


def rank_error(size: int = SIZE) -> float:
    """Bound of the rank error of one quantile, as a share of the rows, at 99 percent confidence."""
    return 2.296 / size**0.9723


def _number(field: str) -> Column:
    x = F.col(field).cast("double")
    return F.when(~F.isnan(x), x)


def states(rows: DataFrame, keys: Sequence[str] = ("cell_id", "day"), fields: Sequence[str] = FIELDS, size: int = SIZE) -> DataFrame:
    """State rows of new rows: combined before the shuffle, of bounded size each.

    NULL and NaN values of a field do not count; NULL keys are keys of their own; no rows give no states.
    """
    parts = []
    for f in fields:
        x = _number(f)
        parts += [F.count(x).alias(f"{f}_n"), F.sum(x).alias(f"{f}_sum"), F.min(x).alias(f"{f}_min"), F.max(x).alias(f"{f}_max"),
                  F.kll_sketch_agg_double(x, size).alias(f"{f}_kll")]
    hits = F.count_if(is_true(F.col("correct")))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), hits.alias("num_correct"), *parts)


def merged(state: DataFrame, group_cols: Sequence[str] = ("cell_id",), fields: Sequence[str] = FIELDS, size: int = SIZE) -> DataFrame:
    """State rows combined per group: the state of the union of their rows."""
    parts = []
    for f in fields:
        parts += [F.sum(f"{f}_n").alias(f"{f}_n"), F.sum(f"{f}_sum").alias(f"{f}_sum"), F.min(f"{f}_min").alias(f"{f}_min"),
                  F.max(f"{f}_max").alias(f"{f}_max"), F.kll_merge_agg_double(f"{f}_kll", size).alias(f"{f}_kll")]
    return state.groupBy(*group_cols).agg(F.sum("n").alias("n"), F.sum("num_correct").alias("num_correct"), *parts)


def summary(
    state: DataFrame, group_cols: Sequence[str] = ("cell_id",), fields: Sequence[str] = FIELDS,
    probs: Sequence[float] = (0.5, 0.95), size: int = SIZE,
) -> DataFrame:
    """One row per group: n, num_correct, pass_at_1 and, per field, mean, min, max and quantiles.

    A quantile of field f is named f_p50 for 0.5, f_p95 for 0.95, f_p99_9 for 0.999; it is NULL without values.
    """
    one = merged(state, group_cols, fields, size)
    out = [F.col("n"), F.col("num_correct"), F.try_divide("num_correct", "n").alias("pass_at_1")]
    for f in fields:
        some = F.col(f"{f}_n") > 0
        out += [F.try_divide(f"{f}_sum", f"{f}_n").alias(f"{f}_mean"), F.col(f"{f}_min"), F.col(f"{f}_max")]
        out += [F.when(some, F.kll_sketch_get_quantile_double(f"{f}_kll", F.lit(float(p)))).alias(
            f"{f}_p{f'{100 * p:g}'.replace('.', '_')}") for p in probs]
    return one.select(*group_cols, *out)


def add(rows: DataFrame, path: str, batch: tuple[str, int], **shape: object) -> int:
    """Add the states of new rows to the stored ones and return the version; a batch counts once.

    ``path`` is a versioned table; the stored states are not read.  ``batch`` names the rows, such as
    a load series and its number.
    """
    return versioned.publish(states(rows, **shape), path, mode="append", batch=batch)


def stored(spark: SparkSession, path: str) -> DataFrame:
    return versioned.load(spark, path)


def compact(spark: SparkSession, path: str, keys: Sequence[str] = ("cell_id", "day"), batch: tuple[str, int] | None = None, **shape: object) -> int:
    """Merge the stored state rows of equal keys into one version, so that a summary reads few."""
    return versioned.publish(merged(stored(spark, path), keys, **shape), path, mode="replace", batch=batch)


# --- intervals ---------------------------------------------------------------------------------

def interval_states(
    rows: DataFrame, values: Mapping[str, Column], keys: Sequence[str] = ("cell_id", "day"), *, n_resamples: int = 1000,
    seed: int = 0, chunk_levels: int = CHUNK_LEVELS,
) -> DataFrame:
    """(keys, replicate, n, sum per value): Poisson replicates of every part; replicate -1 is the part itself.

    Rows with a NULL value are left out.  Equal rows are drawn together; a large part is split by the hash of
    its values and added up again, so a task holds ``chunk_levels`` different rows at a time, on average.
    """
    names, keys = list(values), list(keys)
    levels = cut(rows.select(F.struct(*[F.col(k) for k in keys]).alias("key"), *[c.cast("double").alias(n) for n, c in values.items()]).dropna(
        subset=names).groupBy("key", *names).agg(F.count(F.lit(1)).alias("rows")))
    slots = levels.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / chunk_levels).alias("slots"))
    dealt = levels.join(slots, "key").withColumn("slot", F.pmod(F.xxhash64(*names), F.col("slots")))
    kind = levels.schema["key"].dataType.simpleString()

    def draw(level: pd.DataFrame) -> pd.DataFrame:
        key, slot = level["key"].iloc[0], int(level["slot"].iloc[0])
        level = level.sort_values(names)
        own, counts = level[names].to_numpy(float), level["rows"].to_numpy(float)
        rng = _generator(seed, tuple(str(v) for v in key.values()), int(level["slots"].iloc[0]), slot)
        n, sums = [counts.sum()], [counts @ own]
        for start in range(0, n_resamples, 100):
            drawn = rng.poisson(counts, (min(100, n_resamples - start), len(counts)))
            n += drawn.sum(axis=1).tolist()
            sums += list(drawn @ own)
        out = pd.DataFrame({"key": [key] * len(n), "replicate": np.arange(-1, n_resamples), "n": np.array(n, dtype=np.int64)})
        return pd.concat([out, pd.DataFrame(np.array(sums), columns=names)], axis=1)

    # The levels are few bytes but much work: a fixed number of partitions keeps them from being merged into one task.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = dealt.repartition(tasks, "key", "slot").groupBy("key", "slot").applyInPandas(draw, f"key {kind}, replicate int, n long, " + ", ".join(f"{v} double" for v in names))
    return made.groupBy("key", "replicate").agg(F.sum("n").alias("n"), *[F.sum(v).alias(v) for v in names]).select("key.*", "replicate", "n", *names)


def interval(
    state: DataFrame, statistic: Callable[[], Column], names: Sequence[str], group_cols: Sequence[str] = ("cell_id",), confidence: float = 0.95,
) -> DataFrame:
    """(group, n, value, ci_low, ci_high): interval of a statistic of the sums ``names`` and the count n, from states alone."""
    sums = state.groupBy(*group_cols, "replicate").agg(F.sum("n").alias("n"), *[F.sum(v).alias(v) for v in names]).withColumn("_stat", statistic())
    real, tail = F.col("replicate") < 0, (1.0 - confidence) / 2.0
    of = lambda which, c: F.max(F.when(which, F.col(c)))
    # One number per replicate.
    end = lambda p: F.percentile(F.when(~real, F.col("_stat")), F.lit(p))
    return sums.groupBy(*group_cols).agg(of(real, "n").alias("n"), of(real, "_stat").alias("value"), end(tail).alias("ci_low"), end(1 - tail).alias("ci_high"))


def replace_parts(rows: DataFrame, path: str, values: Mapping[str, Column], keys: Sequence[str] = ("cell_id", "day"), **shape: object) -> int:
    """Put the states of changed parts in the place of the stored ones and return the version.

    ``rows`` has all rows of the parts that changed; the rows of other parts are not read.
    """
    spark, new = rows.sparkSession, cut(interval_states(rows, values, keys, **shape))
    if versioned.is_versioned(spark, path):
        changed = new.select(*[F.col(k).alias(f"_new_{k}") for k in keys]).distinct()
        same = [F.col(k).eqNullSafe(F.col(f"_new_{k}")) for k in keys]
        new = stored(spark, path).join(changed, same, "left_anti").unionByName(new)
    return versioned.publish(new, path, mode="replace")


# Tasks receive these functions by value; workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
