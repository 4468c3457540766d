"""Intervals read the rows once, and draws are spread over a fixed number of tasks."""

from pyspark.sql import functions as F

from evalweave.operators import bootstrap, incremental


def plan(df):
    return df._jdf.queryExecution().toString()


def test_rows_are_read_once(spark, tmp_path):
    path = str(tmp_path / "rows-read-once")
    spark.range(400).select(
        (F.col("id") % 2).alias("cell_id"), (F.col("id") % 50).cast("string").alias("id"), (F.col("id") % 3 == 0).alias("correct"),
        F.when(F.col("id") % 7 > 0, F.col("id") / 8).alias("latency_sec")).write.parquet(path)
    rows = spark.read.parquet(path)
    made = {
        "mean": bootstrap.bootstrap_ci(rows, {"x": F.col("correct").cast("int")}, n_resamples=50),
        "cluster": bootstrap.cluster_bootstrap_ci(rows, n_resamples=50),
        "cost": bootstrap.cost_per_correct_ci(rows, n_resamples=50),
    }
    for df in made.values():  # all that follows comes from the distinct values
        assert "rows-read-once" not in plan(df)
    want = {r.cell_id: (r.a, r.n) for r in rows.groupBy("cell_id").agg(F.avg(F.col("correct").cast("int")).alias("a"), F.count("*").alias("n")).collect()}
    assert {r.cell_id: (r.value, r.n) for r in made["mean"].collect()} == want
    timed = rows.where("latency_sec is not null").groupBy("cell_id").agg((F.sum("latency_sec") / F.count_if("correct")).alias("a"), F.count("*").alias("n"))
    assert {r.cell_id: (round(r.value, 9), r.n) for r in made["cost"].collect()} == {r.cell_id: (round(r.a, 9), r.n) for r in timed.collect()}
    assert "ci_low" in made["cost"].columns and not [c for c in made["cost"].columns if c.startswith("_")]


def test_replicates_of_parts_use_many_tasks(spark):
    rows = spark.range(1000).select((F.col("id") % 2).alias("cell_id"), (F.col("id") % 3).alias("day"), (F.col("id") / 7).alias("x"))
    made = incremental.interval_states(rows, {"x": F.col("x")}, n_resamples=10, chunk_levels=20)
    assert "RepartitionByExpression [key" in plan(made)
