"""Frontier and Holm on large families: slices give what one window gives."""

import numpy as np
from pyspark.sql import functions as F

from evalweave.operators import comparison, frontier
from evalweave.plans.ranked import with_running


def cells(spark, n, families=1):
    h = lambda salt, m: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(m))
    return spark.range(n).select(
        F.concat(F.lit("c"), "id").alias("cell_id"), F.concat(F.lit("f"), F.col("id") % families).alias("family"),
        (h(1, 1000) / 1000).alias("pass_at_1"), F.when(h(2, 50) > 0, h(3, 5000) / 10).alias("cost_per_correct_seconds"),
        F.when(h(4, 9) > 0, h(5, 3000) / 3000).alias("p"))


def test_running_extremes(spark):
    df = cells(spark, 500, 3).withColumn("v", F.col("cost_per_correct_seconds")).repartition(5)
    got = with_running(df, ["family"], [F.col("pass_at_1"), F.col("cell_id")], least_before={"low": "v"}, greatest_upto={"high": "v"}).toPandas()
    for _, g in got.sort_values(["pass_at_1", "cell_id"]).groupby("family"):
        low = g.v.cummin().ffill().shift()
        high = g.v.cummax().ffill()
        assert np.allclose(g.low.astype(float), low.astype(float), equal_nan=True) and np.allclose(g.high.astype(float), high.astype(float), equal_nan=True)


def test_frontier_in_slices(spark):
    df = cells(spark, 4000, 2)
    ways = [frontier.frontier_points(df, family_cols=["family"], window_rows=rows).orderBy("cell_id").toPandas() for rows in (100_000, 10)]
    assert ways[0].equals(ways[1]) and 0 < ways[0].on_pareto_frontier.sum() < 200


def test_frontier_of_a_million(spark):
    df = cells(spark, 1_000_000)
    got = frontier.frontier_points(df, window_rows=1000).where("on_pareto_frontier").toPandas()
    points = df.where("cost_per_correct_seconds is not null").select("cell_id", "pass_at_1", "cost_per_correct_seconds").toPandas()
    points = points.sort_values(["pass_at_1", "cost_per_correct_seconds", "cell_id"], ascending=[False, True, True])
    before = points.cost_per_correct_seconds.cummin().shift()
    want = points[before.isna() | (points.cost_per_correct_seconds < before)]
    assert sorted(got.cell_id) == sorted(want.cell_id)


def test_holm_in_slices(spark):
    df = cells(spark, 3000, 2)
    ways = [comparison.holm_adjusted(df, "p", ["family"], ["cell_id"], window_rows=rows).orderBy("cell_id").toPandas() for rows in (100_000, 10)]
    assert list(ways[0].columns) == list(ways[1].columns)
    a, b = (w.p_value_holm.astype(float) for w in ways)
    assert np.allclose(a, b, equal_nan=True) and (a.isna() == ways[0].p.isna()).all()
