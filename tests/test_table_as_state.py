"""Merging finds copies in the table itself: recent versions for all rows, all versions for the cells of late rows."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from evalweave.sources import versioned
from evalweave.streaming import jobs

SCHEMA = "cell_id string, id string, sample_index int, task string, completion string, gold_solution string, ts timestamp"
OLD = dt.datetime(2020, 1, 1)


def now():
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


@pytest.mark.parametrize("small, named", [(100_000, 200), (0, 200), (0, 1)])
def test_copies_are_found_without_state(spark, tmp_path, monkeypatch, small, named):
    monkeypatch.setattr(jobs, "BROADCAST_ROWS", small)
    monkeypatch.setattr(jobs, "NAMED_CELLS", named)
    source, path, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    os.mkdir(source)
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    clock, states = [0], []
    monkeypatch.setattr(versioned, "_now_ms", lambda real=versioned._now_ms: real() - clock[0])

    def run(keys, ts, checkpoint=state):
        rows = [(*k, "math500", "\\boxed{1}", "\\boxed{1}", ts) for k in keys]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        query = jobs.start_merging(stream, path, checkpoint, event_time="ts", delay="1 hour")
        query.awaitTermination()
        states.extend(o for p in query.recentProgress for o in p["stateOperators"])
        return sorted([tuple(r) for r in versioned.load(spark, path).select("cell_id", "id", "sample_index").collect()], key=repr)

    keys = [(c, i, n) for c in ("a", "b", None) for i in ("1", "2", None) for n in (0, None)]
    whole = sorted(keys, key=repr)
    clock[0] = 3 * 3_600_000  # the first version is older than the keys of fresh rows are looked for
    assert run([*keys[:6], *keys[:6]], now()) == sorted(keys[:6], key=repr)
    clock[0] = 0
    assert run([*keys[3:9], *keys[6:]], OLD) == whole  # copies in the batch and of a version that is old
    assert run([*keys[6:], *keys[6:]], now()) == whole  # fresh copies of late rows, of a version that is recent
    assert run(keys, None) == whole
    assert run([], OLD, state + "-lost") == whole  # all rows come again
    assert not states


def test_an_empty_cell_comes_once(spark, tmp_path):
    source, path, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    os.mkdir(source)
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    for ts in (now(), now(), OLD):
        rows = [("", str(i), 0, "math500", "\\boxed{1}", "\\boxed{1}", ts) for i in range(3)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        jobs.start_merging(stream, path, state, event_time="ts", delay="1 hour").awaitTermination()
    assert sorted(r.id for r in versioned.load(spark, path).collect()) == ["0", "1", "2"]


def test_rows_are_exchanged_once(spark, capsys):
    keys = list(jobs.RESPONSE_KEYS)
    rows = spark.range(9).selectExpr("nullif(string(id % 2), '9') as cell_id", "nullif(string(id), '9') as id", "int(id) as sample_index", "id > 3 as late")
    held = rows.select(*keys).transform(jobs._by_hash, keys).hint("merge").alias("k")
    unique = rows.transform(jobs._by_hash, keys).groupBy("_hash", *keys).agg(F.max("late").alias("late"))
    unique.alias("r").join(held, (F.col("r._hash") == F.col("k._hash")) & (F.col("r.late") | F.col("k.id").isNull()), "left_anti").explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 2  # one a side


def test_old_versions_are_not_read_for_fresh_rows(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.createDataFrame([("a", "1", 0, False)], "cell_id string, id string, sample_index int, _late boolean")
    for cell in ("a", "b"):
        versioned.publish(spark.createDataFrame([(cell, "1", 0)], "cell_id string, id string, sample_index int"), path, mode="append", partition_cols=["cell_id"])
    written = versioned.manifest(spark, path)["written"]
    assert sorted(written) == sorted(versioned.manifest(spark, path)["folders"])
    last, keys = max(written.values()), list(jobs.RESPONSE_KEYS)
    assert jobs._held_keys(spark, path, rows, keys, last + 1) is None
    assert jobs._held_keys(spark, path, rows, keys, 0).count() == 2
    late = rows.selectExpr(*keys, "true as _late")
    assert [tuple(r) for r in jobs._held_keys(spark, path, late, keys, last + 1).collect()] == [("a", "1", 0, False)]
    assert jobs._held_keys(spark, str(tmp_path / "none"), rows, keys, 0) is None
