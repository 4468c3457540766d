"""Quantile and free-form bootstrap against plain resampling."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalweave.operators import bootstrap


def frame(spark, groups):
    rows = [(g, None if v is None else float(v)) for g, values in groups.items() for v in values]
    return spark.createDataFrame(rows, "cell_id string, x double").repartition(4)


def plain(values, statistic, n=4000):
    rng = np.random.default_rng(11)
    values = np.asarray(values, dtype=float)
    return np.quantile([statistic(values[rng.integers(0, len(values), len(values))]) for _ in range(n)], [0.025, 0.975])


@pytest.mark.parametrize("chunk_levels", [7, 5000])
def test_quantiles(spark, chunk_levels):
    rng = np.random.default_rng(3)
    groups = {"skew": rng.exponential(10, 900).round(2), "ties": rng.integers(0, 6, 700), None: rng.normal(size=301), "one": [4.0], "same": [2.0] * 50}
    df = frame(spark, {g: [*v, None] for g, v in groups.items()})
    probs = [0.1, 0.5, 0.9]
    got = {(r.cell_id, r.prob): r for r in bootstrap.bootstrap_quantile_ci(df, F.col("x"), probs, chunk_levels=chunk_levels).collect()}
    assert len(got) == len(groups) * len(probs)
    for g, values in groups.items():
        spread = np.std(values) / np.sqrt(len(values)) + 1e-9
        for p in probs:
            row, ends = got[g, p], plain(values, lambda v: np.quantile(v, p))
            assert row.n == len(values) and np.isclose(row.value, np.quantile(values, p))
            assert np.allclose([row.ci_low, row.ci_high], ends, atol=1.2 * spread), (g, p, row, ends)


def test_chunks_and_partitions_do_not_matter(spark):
    values = np.random.default_rng(5).normal(size=2000)
    df = frame(spark, {"a": values})
    rows = [bootstrap.bootstrap_quantile_ci(d, F.col("x"), [0.25, 0.75], chunk_levels=100).orderBy("prob").collect() for d in (df, df.coalesce(1))]
    assert rows[0] == rows[1]
    assert bootstrap.bootstrap_quantile_ci(df.where("1 = 0"), F.col("x")).count() == 0


def test_no_group_and_nan(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 100]] + [(float("nan"),), (None,)], "x double")
    row = bootstrap.bootstrap_quantile_ci(df, F.col("x"), group_cols=[]).first()
    assert (row.n, row.value) == (5, 3.0) and row.ci_low == 1.0 and row.ci_high == 100.0


def test_any_statistic(spark):
    rng = np.random.default_rng(6)
    groups = {"a": rng.integers(0, 30, 400), "b": rng.normal(50, 4, 300).round(1)}

    def spread(levels, counts):
        """Standard deviation of a weighted sample."""
        mean = (levels[:, 0] * counts).sum() / counts.sum()
        return float((((levels[:, 0] - mean) ** 2 * counts).sum() / counts.sum()) ** 0.5)

    df = frame(spark, {g: [*v, None] for g, v in groups.items()})
    got = {r.cell_id: r for r in bootstrap.bootstrap_statistic_ci(df, {"x": F.col("x")}, spread).collect()}
    for g, values in groups.items():
        ends, row = plain(values, np.std), got[g]
        assert row.n == len(values) and np.isclose(row.value, np.std(values))
        assert np.allclose([row.ci_low, row.ci_high], ends, atol=0.12 * (ends[1] - ends[0]))
    with pytest.raises(Exception, match="distinct levels"):
        bootstrap.bootstrap_statistic_ci(df, {"x": F.col("x")}, spread, max_levels=10).collect()


@pytest.mark.parametrize("repeat", [1, 40])
def test_both_ways_to_spread_draws(repeat):
    """Picking rows and counting by level: the same mean and variance of sums."""
    rng = np.random.default_rng(1)
    levels, rows = rng.normal(size=(60, 2)), rng.integers(1, 4, 60) * repeat
    draws = np.full(4000, 90)
    sums = bootstrap._spread(draws, levels, rows, rng)
    share = rows / rows.sum()
    mean = share @ levels
    variance = share @ levels**2 - mean**2
    assert np.abs(sums.mean(0) - 90 * mean).max() < 5 * np.sqrt(90 * variance / 4000).max()
    assert np.allclose(sums.var(0), 90 * variance, rtol=0.15)
    assert not bootstrap._spread(np.zeros(5, dtype=np.int64), levels, rows, rng).any()


def test_cost_interval_fits_the_summary(spark):
    """Rows without a latency count as correct answers of no cost, as in the cell summary."""
    rng = np.random.default_rng(8)
    rows = [("a", None if rng.random() < 0.3 else float(rng.exponential(5)), bool(rng.random() < 0.4)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "cell_id string, latency_sec double, correct boolean")
    row = bootstrap.cost_per_correct_ci(df, untimed_as_zero=True).first()
    cost = np.array([r[1] or 0.0 for r in rows])
    hit = np.array([r[2] for r in rows], dtype=float)
    assert np.isclose(row.value, cost.sum() / hit.sum())
    picks = np.random.default_rng(2).integers(0, len(rows), (3000, len(rows)))
    ends = np.quantile(cost[picks].sum(1) / hit[picks].sum(1), [0.025, 0.975])
    assert np.allclose([row.ci_low, row.ci_high], ends, atol=0.12 * (ends[1] - ends[0]))
