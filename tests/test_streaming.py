"""Streams through restarts, repeats and late rows."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from evalweave.operators import telemetry
from evalweave.sources import versioned
from evalweave.streaming import jobs

RESPONSE = "cell_id string, id string, sample_index int, task string, completion string, gold_solution string, ts timestamp"


def responses(spark, ids, ts, answer="\\boxed{1}"):
    return spark.createDataFrame([(f"c{i % 2}", str(i), 0, "math500", answer, "\\boxed{1}", ts) for i in ids], RESPONSE)


def test_exactly_once_with_late_copies(spark, tmp_path):
    source, path, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    os.mkdir(source)
    now, old = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None), dt.datetime(2020, 1, 1)
    stream = spark.readStream.schema(RESPONSE).option("maxFilesPerTrigger", 1).parquet(source)

    def put(df):
        df.coalesce(1).write.mode("append").parquet(source)

    def run(checkpoint=state):
        jobs.start_merging(stream, path, checkpoint, event_time="ts", delay="1 hour").awaitTermination()
        return sorted((r.id, r.correct) for r in versioned.load(spark, path).collect())

    put(responses(spark, range(6), now))
    put(responses(spark, [4, 5, 6], now))  # repeats while the keys are in state
    assert run() == [(str(i), True) for i in range(7)]
    put(responses(spark, [6, 7], old))  # a late copy and a late first row, after a restart
    put(responses(spark, [8, 8], None))
    assert run() == [(str(i), True) for i in range(9)]
    put(responses(spark, range(12), old, "none"))  # copies of everything and three new rows
    got = run()
    assert sorted(i for i, _ in got) == sorted(str(i) for i in range(12)) and sum(not ok for _, ok in got) == 3
    # A state that was lost: every row comes again, all are old, none is added.
    spark.read.parquet(source).withColumn("ts", F.lit(old)).coalesce(1).write.parquet(str(tmp_path / "again"))
    again = spark.readStream.schema(RESPONSE).parquet(str(tmp_path / "again"))
    jobs.start_merging(again, path, state + "-second", event_time="ts", delay="1 hour").awaitTermination()
    assert sorted((r.id, r.correct) for r in versioned.load(spark, path).collect()) == sorted(got)


def test_a_repeated_batch_adds_nothing(spark, tmp_path, monkeypatch):
    """The job fails after the table's commit and before the stream's: the batch runs again."""
    source, path, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    responses(spark, range(5), now).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(RESPONSE).parquet(source)
    publish = versioned.publish

    def broken(*args, **kwargs):
        publish(*args, **kwargs)
        raise RuntimeError("lost")

    monkeypatch.setattr(versioned, "publish", broken)
    with pytest.raises(Exception, match="lost"):
        jobs.start_merging(stream, path, state, event_time="ts").awaitTermination()
    monkeypatch.setattr(versioned, "publish", publish)
    assert versioned.load(spark, path).count() == 5
    jobs.start_merging(stream, path, state, event_time="ts").awaitTermination()
    assert versioned.load(spark, path).count() == 5


def test_energy_over_batches_late_samples_and_a_restart(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    os.mkdir(source)
    start = dt.datetime(2024, 1, 1)
    rows = [(f"d{i % 3}", start + dt.timedelta(seconds=7 * i + i % 4), i, (i * 37 % 80) * 10**9, float(i % 101), None if i % 11 == 0 else float(i % 50))
            for i in range(400)] + [("idle", start, 1, None, None, None)]
    schema = "device string, ts timestamp, sample_id long, mem_bytes long, util double, power double"
    batch_of = lambda i: min(3, (i + (60 if i % 5 == 0 else 0)) // 100)  # noqa: E731  every fifth comes early, so the others are late
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    with jobs.rocksdb_state(spark):
        for parts in ((0, 1), (2,), (3,)):
            for k in parts:
                spark.createDataFrame([r for r in rows if batch_of(r[2]) == k], schema).coalesce(1).write.mode("append").parquet(source)
            (jobs.telemetry_energy(stream, delay="10 minutes").writeStream.outputMode("update").option("checkpointLocation", state).foreachBatch(
                lambda b, n: b.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)).trigger(availableNow=True).start().awaitTermination())
    kept = spark.read.parquet(out)
    assert kept.select("batch").distinct().count() >= 4
    names = [c for c in kept.columns if c not in ("device", "batch")]
    last = {r.device: r.x for r in kept.groupBy("device").agg(F.max_by(F.struct(*names), F.struct("batch", "samples")).alias("x")).collect()}
    want = {r.device: r for r in telemetry.integrate_samples(spark.createDataFrame(rows, schema)).collect()}
    assert set(last) == set(want)
    for d, w in want.items():
        g = last[d]
        assert g.samples == w.samples and g.open_samples < w.samples or w.samples == 1
        for c in ("peak_vram_gb", "gpu_util_mean", "gpu_util_max", "power_watts_mean", "power_watts_max", "energy_joules"):
            assert (g[c] is None) == (w[c] is None) and (g[c] is None or abs(g[c] - w[c]) < 1e-6 * max(1, abs(w[c]))), (d, c, g, w)
