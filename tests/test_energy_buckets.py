"""Streaming energy keeps a bounded number of state groups, however many devices there are."""

import datetime as dt
import os

from pyspark.sql import functions as F

from evalweave.operators import telemetry
from evalweave.streaming import jobs

SCHEMA = "device string, ts timestamp, sample_id long, mem_bytes long, util double, power double"
KEYS = ("samples", "peak_vram_gb", "gpu_util_mean", "gpu_util_max", "power_watts_mean", "power_watts_max", "energy_joules")


def test_devices_share_state_groups(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    start, devices = dt.datetime(2024, 1, 1), 5 * jobs.BUCKETS
    rows = [(f"d{i % devices}" if i % devices else None, start + dt.timedelta(seconds=i // 2), i, None if i % 5 == 0 else i * 10**7, float(i % 101),
             None if i % 3 == 0 else float(i % 50)) for i in range(4 * devices)] + [("silent", start, 0, None, None, None)]
    os.mkdir(source)
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    groups = []
    with jobs.rocksdb_state(spark):
        for k in range(2):
            part = [r for r in rows if (r[1] - start).seconds // devices == k]
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
            query = (jobs.telemetry_energy(stream, delay="5 minutes").writeStream.outputMode("update").option("checkpointLocation", state)
                     .foreachBatch(lambda b, n: b.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)).trigger(availableNow=True).start())
            query.awaitTermination()
            groups += [p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress]
    assert 0 < max(groups) <= jobs.BUCKETS
    last = spark.read.parquet(out).groupBy("device").agg(F.max_by(F.struct(*KEYS), F.struct("batch", "samples")).alias("x")).select("device", "x.*")
    rounded = lambda df: sorted([(r.device or "", *[None if r[c] is None else round(r[c], 6) for c in KEYS]) for r in df.collect()])
    got, want = rounded(last), rounded(telemetry.integrate_samples(spark.createDataFrame(rows, SCHEMA)))
    assert len(want) == devices + 1 and got == want
