"""Streaming deduplication keeps its keys outside the heap, and the session's settings as they were."""

import os

from evalweave.streaming import jobs

SCHEMA = "cell_id string, id string, sample_index int, task string, completion string, gold_solution string"


def test_scored_keys_are_kept_in_rocksdb(spark, tmp_path):
    source, table, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    os.mkdir(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    rows = [(f"c{i % 20}" if i % 7 else None, str(i) if i % 5 else None, i % 3 if i % 4 else None, "math500", "\\boxed{1}", "\\boxed{1}") for i in range(400)]
    before = {n: spark.conf.get(n, None) for n in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.maxConcurrentOutputFileWriters")}
    kinds = []
    for part in (rows[:250], rows[150:], rows):  # each run goes on from the state of the one before
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        query = jobs.start_scoring(stream, table, state)
        query.awaitTermination()
        kinds += [{n for n in o["customMetrics"] if n.startswith("rocksdb")} for p in query.recentProgress for o in p["stateOperators"]]
    assert kinds and all(kinds)
    assert {n: spark.conf.get(n, None) for n in before} == before
    got = [tuple(r) for r in spark.read.parquet(table).select("cell_id", "id", "sample_index").collect()]
    want = {(r[0], r[1], r[2]) for r in rows}
    assert len(got) == len(want)
    assert {(c, None if i is None else str(i), n) for c, i, n in got} == want
