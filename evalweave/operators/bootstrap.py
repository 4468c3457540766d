"""Percentile bootstrap intervals as distributed jobs.

A resample of n rows depends on the data only through how often each distinct value is drawn,
so rows are first collapsed to (value, multiplicity) levels.  Levels are hashed into chunks of
bounded size.  The number of draws that fall in a chunk comes from a binary tree over the
chunks: every node splits its draws binomially, seeded by (seed, group, node), so each chunk
walks its own path from the root and all chunks agree without a central step.  Inside a chunk
the draws are spread over its levels.  The result follows the ordinary multinomial bootstrap
exactly, whatever the size of the group, and does not depend on the partitioning.

For quantiles the chunks follow the order of the values instead.  A replicate needs only the chunks
that hold its order statistics: it walks down the tree by the ranks it looks for, and only where it
arrives are draws spread over levels.  Any other statistic of a weighted sample runs as a function
over the levels of a group, whose number is bounded and checked.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalweave.plans.ranked import with_running
from evalweave.plans.shared import cut

CHUNK_LEVELS = 5_000
TOGETHER = 8  # chunks of a group that one call takes and adds up
RESAMPLES = 2_000
PER_LEVEL = 8  # draws a level up to which rows are picked one by one
BLOCK_DRAWS = 1_000_000
MAX_LEVELS = 1_000_000


def _generator(*parts: object) -> np.random.Generator:
    digest = hashlib.blake2b(repr(parts).encode(), digest_size=16).digest()
    return np.random.Generator(np.random.PCG64(int.from_bytes(digest, "big")))


def _chunk_draws(path: pd.DataFrame, seed: int, group: tuple, n_resamples: int) -> np.ndarray:
    """Draws per replicate that reach one chunk, walking down its path of tree nodes."""
    path = path.sort_values("depth")
    draws = np.full(n_resamples, int(path["node_rows"].iloc[0]), dtype=np.int64)
    for here, below in zip(path.iloc[:-1].itertuples(), path.iloc[1:].itertuples()):
        share = here.left_rows / here.node_rows
        left = _generator(seed, group, here.depth, here.node).binomial(draws, share)
        draws = left if below.node == 2 * here.node else draws - left
    return draws


def _spread(draws: np.ndarray, levels: np.ndarray, rows: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Per replicate: sums of each value column over ``draws`` draws from the chunk.

    Picking rows costs a step a draw, counting by level a step a level; both give the multinomial.
    """
    out = np.zeros((len(draws), levels.shape[1]))
    total = int(rows.sum())
    if max(total, int(draws.max(initial=0))) <= PER_LEVEL * len(rows):
        columns = np.ascontiguousarray(np.repeat(levels, rows, axis=0).T)
        some = np.flatnonzero(draws)
        step = max(1, BLOCK_DRAWS // max(1, int(draws.max(initial=1))))
        for start in range(0, len(some), step):
            block = some[start : start + step]
            ends = np.cumsum(draws[block])
            picks = rng.integers(0, total, int(ends[-1]), dtype=np.uint32)
            for k, column in enumerate(columns):
                out[block, k] = np.add.reduceat(column[picks], ends - draws[block])
        return out
    share = rows / total
    for start in range(0, len(draws), 100):
        out[start : start + 100] = rng.multinomial(draws[start : start + 100], share) @ levels
    return out


def _levels(df: DataFrame, values: Mapping[str, Column], group_cols: Sequence[str]) -> DataFrame:
    """(group, value columns, rows): the distinct values of every group and how often they occur; reads ``df`` once."""
    return cut(
        df.select(*[F.col(c) for c in group_cols], *[c.cast("double").alias(n) for n, c in values.items()])
        .groupBy(*group_cols, *values)
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def replicate_sums(
    df: DataFrame,
    values: Mapping[str, Column],
    *,
    group_cols: Sequence[str] = ("cell_id",),
    n_resamples: int = RESAMPLES,
    seed: int = 0,
    chunk_levels: int = CHUNK_LEVELS,
) -> DataFrame:
    """(group, replicate, n, sum per value) for resamples of the rows of each group."""
    return _replicates(_levels(df, values, group_cols), list(values), group_cols, n_resamples, seed, chunk_levels)


def _replicates(
    levels: DataFrame, names: Sequence[str], group_cols: Sequence[str], n_resamples: int, seed: int, chunk_levels: int
) -> DataFrame:
    spark = levels.sparkSession
    # The depth of a group's tree depends on that group alone, so its draws never change with the others.
    deep = F.greatest(F.lit(0), F.ceil(F.log2(F.count(F.lit(1)) / chunk_levels))).cast("int")
    sizes = levels.groupBy(*[F.col(c).alias(f"_of_{c}") for c in group_cols]).agg(deep.alias("_deep"))
    own = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in group_cols]
    levels = levels.join(sizes, own).drop(*[f"_of_{c}" for c in group_cols]).withColumn(
        "chunk", F.pmod(F.xxhash64(*names), F.expr("shiftleft(1L, _deep)")))

    chunks = levels.groupBy(*group_cols, "chunk", "_deep").agg(F.sum("rows").alias("rows"))
    levels = levels.drop("_deep")
    steps = chunks.withColumn("depth", F.explode(F.sequence(F.lit(0), F.col("_deep")))).withColumn(
        "node", F.expr("shiftright(chunk, _deep - depth)")
    )
    nodes = steps.groupBy(*group_cols, "depth", "node").agg(
        F.sum("rows").alias("node_rows"),
        F.coalesce(
            F.sum(F.when(F.expr("depth < _deep and shiftright(chunk, greatest(_deep - depth - 1, 0)) % 2 = 0"), F.col("rows"))), F.lit(0)
        ).alias("left_rows"),
    )
    a, b = steps.alias("a"), nodes.alias("b")
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*group_cols, "depth", "node")]
    paths = a.join(b, on).select(
        # New names for the keys: both sides of the cogroup below come from ``levels``.
        *[F.col(f"a.{c}").alias(c) for c in (*group_cols, "chunk")], "a.depth", "a.node", "b.node_rows", "b.left_rows"
    )

    width = len(group_cols)
    schema = T.StructType(
        [levels.schema[c] for c in group_cols]
        + [T.StructField("replicate", T.IntegerType()), T.StructField("n", T.LongType())]
        + [T.StructField(n, T.DoubleType()) for n in names]
    )

    def draw(key: tuple, level: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        group = tuple(str(k) for k in key[:width])
        n, sums = np.zeros(n_resamples, dtype=np.int64), np.zeros((n_resamples, len(names)))
        paths = dict(tuple(path.groupby("chunk")))
        for chunk, own in level.groupby("chunk"):
            own = own.sort_values(names)
            draws = _chunk_draws(paths[chunk], seed, group, n_resamples)
            n += draws
            sums += _spread(draws, own[names].to_numpy(float), own["rows"].to_numpy(np.int64),
                            _generator(seed, group, "chunk", int(chunk)))
        out = pd.DataFrame({c: [k] * n_resamples for c, k in zip(group_cols, key)})
        out["replicate"] = np.arange(n_resamples, dtype=np.int32)
        out["n"] = n
        return pd.concat([out, pd.DataFrame(sums, columns=names)], axis=1)

    by = [*group_cols, "slot"]
    slot = F.expr(f"chunk div {TOGETHER}")
    # The levels are few bytes but much work: a fixed number of partitions keeps them from being merged into one task.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    left, right = (side.withColumn("slot", slot).repartition(tasks, *by) for side in (levels, paths))
    parts = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(draw, schema)
    return parts.groupBy(*group_cols, "replicate").agg(
        F.sum("n").alias("n"), *[F.sum(n).alias(n) for n in names]
    )


def bootstrap_ci(
    df: DataFrame,
    values: Mapping[str, Column],
    statistic: Callable[[], Column] | None = None,
    *,
    group_cols: Sequence[str] = ("cell_id",),
    n_resamples: int = RESAMPLES,
    confidence: float = 0.95,
    seed: int = 0,
    chunk_levels: int = CHUNK_LEVELS,
) -> DataFrame:
    """Value and percentile interval of a statistic of column sums.

    ``statistic`` builds a Column over the sums named in ``values`` and the row count ``n``; the
    default is the mean of the first value.  Rows with a NULL value must be filtered before.
    """
    return _interval(
        df, values, statistic, group_cols=group_cols, n_resamples=n_resamples, confidence=confidence, seed=seed, chunk_levels=chunk_levels
    ).select(*group_cols, "n", "value", "ci_low", "ci_high")


def _interval(
    df: DataFrame,
    values: Mapping[str, Column],
    statistic: Callable[[], Column] | None,
    *,
    group_cols: Sequence[str],
    n_resamples: int = RESAMPLES,
    confidence: float = 0.95,
    seed: int = 0,
    chunk_levels: int = CHUNK_LEVELS,
) -> DataFrame:
    """As ``bootstrap_ci``, with the sums of the values of all rows beside it.  Rows are read once."""
    first = next(iter(values))
    stat = statistic() if statistic else F.col(first) / F.col("n")
    tail = (1.0 - confidence) / 2.0
    levels = _levels(df, values, group_cols)
    reps = _replicates(levels, list(values), group_cols, n_resamples, seed, chunk_levels)
    # One number per replicate, so the exact percentile is bounded by n_resamples.
    ends = reps.withColumn("_stat", stat).groupBy(*group_cols).agg(
        F.percentile("_stat", F.lit(tail)).alias("ci_low"),
        F.percentile("_stat", F.lit(1.0 - tail)).alias("ci_high"),
    )
    observed = (
        levels.groupBy(*group_cols)
        .agg(F.sum("rows").alias("n"), *[F.sum(F.col(n) * F.col("rows")).alias(n) for n in values])
        .select(*group_cols, "n", *[F.col(n).alias(f"_sum_{n}") for n in values], stat.alias("value"))
    )
    o, e = observed.alias("o"), ends.alias("e")
    on = [F.col(f"o.{c}").eqNullSafe(F.col(f"e.{c}")) for c in group_cols]
    return o.join(e, on).select("o.*", "e.ci_low", "e.ci_high")


def cluster_bootstrap_ci(
    df: DataFrame,
    *,
    cluster_key: str = "id",
    value_key: str = "correct",
    group_cols: Sequence[str] = ("cell_id",),
    **options: object,
) -> DataFrame:
    """Interval of the mean of cluster means, resampling clusters."""
    df = cut(df.select(*group_cols, cluster_key, value_key))  # read twice
    clusters = (
        df.filter(F.col(cluster_key).isNotNull() & F.col(value_key).isNotNull())  # F4
        .groupBy(*group_cols, cluster_key)
        .agg(F.avg(F.col(value_key).cast("int")).alias("cluster_mean"))
    )
    ci = bootstrap_ci(clusters, {"x": F.col("cluster_mean")}, group_cols=group_cols, **options)
    groups = df.select(*group_cols).distinct().alias("g")
    ci = ci.alias("c")
    on = [F.col(f"g.{c}").eqNullSafe(F.col(f"c.{c}")) for c in group_cols]
    zero = lambda c: F.coalesce(F.col(f"c.{c}"), F.lit(0.0)).alias(c)
    return groups.join(ci, on, "left").select(
        *[F.col(f"g.{c}") for c in group_cols], zero("value"), zero("ci_low"), zero("ci_high"),
        F.coalesce(F.col("c.n"), F.lit(0)).alias("n_clusters"),
    )


def cost_per_correct_ci(
    df: DataFrame, *, group_cols: Sequence[str] = ("cell_id",), untimed_as_zero: bool = False, **options: object
) -> DataFrame:
    """Interval of total latency per correct answer; the total when none is correct.

    Rows without a latency are left out, or, with ``untimed_as_zero``, cost nothing and still count as
    correct answers: then value and interval fit the cost per correct answer of a cell summary.
    """
    rows = df if untimed_as_zero else df.filter(F.col("latency_sec").isNotNull())
    values = {
        "cost": F.coalesce(F.col("latency_sec").cast("double"), F.lit(0.0)),
        "hits": F.coalesce(F.col("correct").cast("int"), F.lit(0)),
    }
    ratio = lambda: F.when(F.col("hits") <= 0, F.col("cost")).otherwise(F.try_divide(F.col("cost"), F.col("hits")))
    ci = _interval(rows, values, ratio, group_cols=group_cols, **options)
    # No interval for a group without a correct answer.
    return ci.filter(F.col("_sum_hits") > 0).select(*group_cols, "n", "value", "ci_low", "ci_high")


def _ranks(n: int, probs: Sequence[float]) -> np.ndarray:
    """The two order statistics (from 0) that a quantile with linear interpolation lies between."""
    at = (n - 1) * np.asarray(probs, dtype=float)
    low = np.floor(at).astype(np.int64)
    return np.column_stack([low, np.minimum(low + 1, n - 1)]).ravel()


def _descend(rows: np.ndarray, ranks: np.ndarray, seed: int, group: tuple, n_resamples: int) -> list[tuple]:
    """(chunk, replicate, target, draws, place): where every replicate finds its order statistics.

    ``rows`` are the rows of the chunks in value order.  A node splits the draws of the replicates that
    look for a rank below it; the others need not be known.
    """
    upto = np.concatenate([[0], np.cumsum(rows)])
    found: list[tuple] = []
    every = np.arange(n_resamples)
    nodes = [(0, len(rows), every, np.full(n_resamples, int(upto[-1])), np.zeros(n_resamples, dtype=np.int64))]
    while nodes:
        a, b, replicates, draws, before = nodes.pop()
        inside = (ranks >= before[:, None]) & (ranks < (before + draws)[:, None])
        some = inside.any(axis=1)
        replicates, draws, before, inside = replicates[some], draws[some], before[some], inside[some]
        if not len(replicates):
            continue
        if b - a == 1:
            line, target = np.nonzero(inside)
            found.append((np.full(len(line), a), replicates[line], target, draws[line], ranks[target] - before[line]))
            continue
        m = (a + b) // 2
        left = _generator(seed, group, "rank", a, b).binomial(draws, (upto[m] - upto[a]) / (upto[b] - upto[a]))
        nodes += [(a, m, replicates, left, before), (m, b, replicates, draws - left, before + left)]
    return found


def bootstrap_quantile_ci(
    df: DataFrame,
    value: Column,
    probs: Sequence[float] = (0.5,),
    *,
    group_cols: Sequence[str] = ("cell_id",),
    n_resamples: int = RESAMPLES,
    confidence: float = 0.95,
    seed: int = 0,
    chunk_levels: int = CHUNK_LEVELS,
) -> DataFrame:
    """(group, prob, n, value, ci_low, ci_high): percentile intervals of quantiles.

    Quantiles interpolate linearly between order statistics; the value is exact.  NULL and NaN values are
    left out; a group without values gives no rows.  All quantiles of a replicate come from one resample.
    Work grows with the levels for the ranks, and with replicates times ``chunk_levels`` for the draws.
    """
    group_cols = list(group_cols)
    x = value.cast("double")
    levels = (
        df.select(*[F.col(c) for c in group_cols], x.alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
        .groupBy(*group_cols, "x").agg(F.count(F.lit(1)).alias("rows"))
    )
    # The group must be one column of a name of its own, so that cogrouped sides agree on it; NULL is a group.
    key = F.struct(*[F.col(c) for c in group_cols]) if group_cols else F.struct(F.lit(0).alias("all"))
    ordered = cut(with_running(levels.withColumn("g", key).drop(*group_cols), ["g"], [F.col("x")], {"upto": "rows"}).withColumn(
        "chunk", F.floor((F.col("rank") - 1) / chunk_levels)).select("g", "x", "rows", "upto", "chunk"))
    group = ordered.schema["g"].dataType.simpleString()

    def walk(table: pd.DataFrame) -> pd.DataFrame:
        g = table["g"].iloc[0]
        rows = table.sort_values("chunk")["rows"].to_numpy(np.int64)
        parts = _descend(rows, _ranks(int(rows.sum()), probs), seed, tuple(str(v) for v in g.values()), n_resamples)
        out = pd.DataFrame(dict(zip(("chunk", "replicate", "target", "draws", "place"), map(np.concatenate, zip(*parts)))))
        out.insert(0, "g", [g] * len(out))
        return out

    # One row per chunk_levels levels of a group.
    sizes = ordered.groupBy("g", "chunk").agg(F.sum("rows").alias("rows"))
    asked = cut(sizes.groupBy("g").applyInPandas(walk, f"g {group}, chunk long, replicate int, target int, draws long, place long"))

    def resolve(level: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
        if not len(want) or not len(level):
            return pd.DataFrame({"g": [], "replicate": [], "target": [], "x": []})
        level = level.sort_values("x")
        values, share = level["x"].to_numpy(float), (level["rows"] / level["rows"].sum()).to_numpy(float)
        g = want["g"].iloc[0]
        rng = _generator(seed, tuple(str(v) for v in g.values()), "spread", int(want["chunk"].iloc[0]))
        want = want.sort_values(["replicate", "target"])
        first = ~want["replicate"].duplicated().to_numpy()
        line = np.cumsum(first) - 1
        draws, place, out = want["draws"].to_numpy()[first], want["place"].to_numpy(), np.empty(len(want))
        for start in range(0, len(draws), 100):
            upto = rng.multinomial(draws[start : start + 100], share).cumsum(axis=1)
            own = np.flatnonzero((line >= start) & (line < start + 100))
            out[own] = [values[np.searchsorted(upto[line[i] - start], place[i], side="right")] for i in own]
        return pd.DataFrame({"g": [g] * len(want), "replicate": want["replicate"].to_numpy(), "target": want["target"].to_numpy(), "x": out})

    found = ordered.select("g", "x", "rows", "chunk").join(asked.select("g", "chunk").distinct(), ["g", "chunk"], "left_semi").groupBy(
        "g", "chunk").cogroup(asked.groupBy("g", "chunk")).applyInPandas(resolve, f"g {group}, replicate int, target int, x double")

    totals = cut(ordered.groupBy("g").agg(F.sum("rows").alias("n")))
    at = lambda p: (F.col("n") - 1) * F.lit(float(p))
    wanted = totals.select("g", "n", F.explode(F.array(*[F.struct(
        F.lit(k).alias("k"), F.lit(float(p)).alias("prob"), F.floor(at(p)).alias("low"), (at(p) - F.floor(at(p))).alias("part"))
        for k, p in enumerate(probs)])).alias("w")).select("g", "n", "w.*")
    side = lambda end: F.max(F.when(F.col("target") % 2 == end, F.col("x")))
    pairs = found.groupBy("g", "replicate", F.expr("target div 2").cast("int").alias("k")).agg(side(0).alias("a"), side(1).alias("b"))
    tail = (1.0 - confidence) / 2.0
    between = F.col("a") + (F.col("b") - F.col("a")) * F.col("part")
    # One number per replicate and quantile, so the exact percentile is bounded by n_resamples.
    ends = pairs.join(wanted, ["g", "k"]).groupBy("g", "k", "prob", "n").agg(
        F.percentile(between, F.lit(tail)).alias("ci_low"), F.percentile(between, F.lit(1.0 - tail)).alias("ci_high"))
    # The rows that hold the two order statistics of the data.
    holds = lambda rank: (F.col("upto") - F.col("rows") <= rank) & (rank < F.col("upto"))
    high = F.least(F.col("low") + 1, F.col("n") - 1)
    exact = ordered.select("g", "x", "rows", "upto").join(wanted, "g").where(holds(F.col("low")) | holds(high)).groupBy("g", "k").agg(
        F.min("x").alias("a"), F.max("x").alias("b"), F.max("part").alias("part")).select("g", "k", between.alias("value"))
    return ends.join(exact, ["g", "k"]).select(
        *[F.col(f"g.{c}").alias(c) for c in group_cols], "prob", "n", "value", "ci_low", "ci_high")


def bootstrap_statistic_ci(
    df: DataFrame,
    values: Mapping[str, Column],
    statistic: Callable[[np.ndarray, np.ndarray], float],
    *,
    group_cols: Sequence[str] = ("cell_id",),
    n_resamples: int = RESAMPLES,
    confidence: float = 0.95,
    seed: int = 0,
    max_levels: int = MAX_LEVELS,
    blocks: int = 16,
) -> DataFrame:
    """(group, n, value, ci_low, ci_high): percentile interval of any statistic of a weighted sample.

    ``statistic(levels, counts)`` gets the distinct value rows of a group, in order, and how often each
    occurs in the sample.  ``blocks`` tasks a group share the replicates, each with the group's levels; a
    group of more than ``max_levels`` distinct levels raises an error.  Rows with a NULL value are left out.
    """
    names, group_cols = list(values), list(group_cols)
    levels = df.select(*[F.col(c) for c in group_cols], *[c.cast("double").alias(n) for n, c in values.items()]).dropna(
        subset=names).groupBy(*group_cols, *names).agg(F.count(F.lit(1)).alias("rows"))
    key = F.struct(*[F.col(c) for c in group_cols]) if group_cols else F.struct(F.lit(0).alias("all"))
    levels = cut(levels.select(key.alias("g"), *names, "rows"))
    group = levels.schema["g"].dataType.simpleString()
    size = F.count(F.lit(1))
    fits = F.when(size <= max_levels, size).otherwise(F.raise_error(F.lit(f"more than {max_levels} distinct levels in a group")).cast("long"))
    checked = levels.groupBy("g").agg(fits.alias("levels"), F.sum("rows").alias("n"))
    spread = levels.join(checked.where("levels > 0"), "g").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values(names)
        g, block = table["g"].iloc[0], int(table["block"].iloc[0])
        own, rows = table[names].to_numpy(float), table["rows"].to_numpy(np.int64)
        turns = range(block, n_resamples, blocks)
        rng = _generator(seed, tuple(str(v) for v in g.values()), "any", block)
        stats = [statistic(own, rng.multinomial(int(rows.sum()), rows / rows.sum())) for _ in turns]
        if not block:  # the sample itself comes as replicate -1
            turns, stats = [-1, *turns], [statistic(own, rows), *stats]
        return pd.DataFrame({"g": [g] * len(stats), "n": int(rows.sum()), "replicate": list(turns), "stat": stats})

    made = spread.groupBy("g", "block").applyInPandas(run, f"g {group}, n long, replicate int, stat double")
    tail = (1.0 - confidence) / 2.0
    drawn = F.when(F.col("replicate") >= 0, F.col("stat"))
    return made.groupBy("g").agg(
        F.max("n").alias("n"), F.max(F.when(F.col("replicate") < 0, F.col("stat"))).alias("value"),
        F.percentile(drawn, F.lit(tail)).alias("ci_low"), F.percentile(drawn, F.lit(1.0 - tail)).alias("ci_high"),
    ).select(*[F.col(f"g.{c}").alias(c) for c in group_cols], "n", "value", "ci_low", "ci_high")


# Tasks receive these functions by value; workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
