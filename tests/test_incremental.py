"""Incremental summaries against exact ones."""

import numpy as np
from pyspark.sql import functions as F

from evalweave.operators import incremental
from evalweave.sources import versioned

FIELDS = ["latency_sec", "completion_tokens"]


def rows(spark, n, day):
    h = lambda salt, m: F.pmod(F.xxhash64("id", F.lit(salt), F.lit(day)), F.lit(m))
    return spark.range(n).select(
        F.concat(F.lit("c"), F.col("id") % 3).alias("cell_id"), F.lit(day).alias("day"), (h(1, 3) == 0).alias("correct"),
        F.when(h(2, 20) > 0, h(3, 100_000) / 7.0).alias("latency_sec"), h(4, 50).alias("completion_tokens"))


def test_states_merge(spark, tmp_path):
    path, days = str(tmp_path / "state"), [rows(spark, 30_000, d) for d in range(3)]
    for k, day in enumerate(days):
        for _ in range(2):  # a batch that comes again counts once
            incremental.add(day, path, ("load", k), fields=FIELDS)
    whole = days[0].union(days[1]).union(days[2]).toPandas()
    for turn in range(2):
        got = incremental.summary(incremental.stored(spark, path), fields=FIELDS, probs=[0.5, 0.95]).toPandas().set_index("cell_id")
        for cell, g in whole.groupby("cell_id"):
            r = got.loc[cell]
            assert (r.n, r.num_correct) == (len(g), g.correct.sum())
            for f in FIELDS:
                x = np.sort(g[f].dropna().to_numpy(float))
                assert np.allclose([r[f"{f}_mean"], r[f"{f}_min"], r[f"{f}_max"]], [x.mean(), x[0], x[-1]])
                for p, name in ((0.5, "p50"), (0.95, "p95")):
                    v, e = r[f"{f}_{name}"], incremental.rank_error()
                    assert np.searchsorted(x, v) / len(x) <= p + e and np.searchsorted(x, v, "right") / len(x) >= p - e
        if not turn:
            assert incremental.stored(spark, path).count() == 9
            incremental.compact(spark, path, ["cell_id"], fields=FIELDS)
            assert incremental.stored(spark, path).count() == 3
    assert versioned.versions(spark, path)[-1] == 4
    assert incremental.add(days[2], path, ("load", 2), fields=FIELDS) == 4


def test_edges(spark):
    nan = float("nan")
    df = spark.createDataFrame([("a", None, None, None), ("a", True, nan, 2.0), (None, False, 1.0, None)],
                               "cell_id string, correct boolean, latency_sec double, completion_tokens double").withColumn("day", F.lit(1))
    got = {r.cell_id: r for r in incremental.summary(incremental.states(df, fields=FIELDS), fields=FIELDS).collect()}
    a, none = got["a"], got[None]
    assert (a.n, a.num_correct, a.latency_sec_mean, a.latency_sec_p50, a.completion_tokens_p50) == (2, 1, None, None, 2.0)
    assert (none.n, none.latency_sec_p95, none.completion_tokens_max) == (1, 1.0, None)
    assert incremental.summary(incremental.states(df.where("1 = 0"), fields=FIELDS), fields=FIELDS).count() == 0


def test_intervals_from_parts(spark, tmp_path):
    """A changed part is drawn anew, the result is that of a run over all rows and near plain resampling."""
    path = str(tmp_path / "state")
    values = {"cost": F.col("latency_sec"), "hits": F.col("correct").cast("int")}
    ratio = lambda: F.col("cost") / F.col("hits")
    days = [rows(spark, 3000, d) for d in range(3)]
    shape = {"n_resamples": 600, "chunk_levels": 400}
    for day in (days[0].union(days[1].limit(1000)), days[2], days[1]):  # the second day comes in part, then whole
        incremental.replace_parts(day, path, values, **shape)
    got = incremental.interval(incremental.stored(spark, path), ratio, list(values)).orderBy("cell_id").collect()
    whole = days[0].union(days[1]).union(days[2])
    again = incremental.interval(incremental.interval_states(whole, values, **shape), ratio, list(values)).orderBy("cell_id").collect()
    for a, b in zip(got, again, strict=True):
        assert (a.cell_id, a.n) == (b.cell_id, b.n) and np.allclose(list(a)[2:], list(b)[2:])
    frame = whole.dropna(subset=["latency_sec"]).toPandas()
    rng = np.random.default_rng(7)
    for r in got:
        g = frame[frame.cell_id == r.cell_id]
        cost, hit = g.latency_sec.to_numpy(float), g.correct.to_numpy(float)
        picks = rng.integers(0, len(g), (1500, len(g)))
        low, high = np.quantile(cost[picks].sum(1) / hit[picks].sum(1), [0.025, 0.975])
        assert np.isclose(r.value, cost.sum() / hit.sum()) and np.allclose([r.ci_low, r.ci_high], [low, high], atol=0.2 * (high - low))
