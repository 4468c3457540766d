"""Streaming jobs: scored sink, live progress, telemetry roll-up."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce
from operator import and_, or_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from evalweave.functions import identity
from evalweave.functions.scoring import ensure_columns, resolve_confidence, score_responses
from evalweave.plans.shared import BROADCAST_ROWS, cut, small_side
from evalweave.sources import versioned

RESPONSE_KEYS = ("cell_id", "id", "sample_index")
NAMED_CELLS = 200  # the files of up to so many cells are chosen by name


def start_scoring(
    responses: DataFrame, path: str, checkpoint: str, *, event_time: str | None = None, delay: str = "1 day",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Score new response files into a Parquet table, each response once.

    Without an event time the keys of all responses stay in state; with one, keys older than
    ``delay`` are forgotten, and a copy that comes later still has to be removed by the reader;
    ``start_merging`` removes it in the table.
    """
    if event_time is None:
        unique = responses.dropDuplicates(list(RESPONSE_KEYS))
    else:
        unique = responses.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(RESPONSE_KEYS))
    scored = resolve_confidence(score_responses(unique, keep_text=False))
    with _key_state(responses.sparkSession), _open_cells(responses.sparkSession):
        return (
            scored.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .partitionBy("cell_id").outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
        )


def start_merging(
    responses: DataFrame, path: str, checkpoint: str, *, event_time: str, delay: str = "1 day", trigger: dict | None = None,
) -> StreamingQuery:
    """Score new response files into a versioned table, each response exactly once.

    The table itself is the state.  Rows of a batch are compared with the keys of the versions written up to
    twice ``delay`` before the batch arrived.  A row whose event time is NULL or at least ``delay`` old may be a copy
    of an older one: such late rows, and only these, are compared with all keys that the table holds for their
    cells, so late first copies are kept and late repeats are not.  Between batches no memory holds any.
    Every micro-batch is one version of the table, recorded under the checkpoint's name, so a batch that is
    repeated after a failure adds nothing twice and readers see whole batches.
    """
    keys = list(RESPONSE_KEYS)
    age = f"_arrival - cast({event_time} as timestamp) < interval '{delay}'"
    marked = responses.withColumn("_arrival", F.current_timestamp()).withColumn("_late", ~F.coalesce(F.expr(age), F.lit(False)))
    kept_ms = 2 * responses.sparkSession.sql(f"select unix_millis(timestamp_millis(0) + interval '{delay}')").first()[0]

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = cut(batch)  # the source is read once
        arrival = rows.select(F.unix_millis("_arrival")).first()  # the same for all rows of a batch, also when it is repeated
        # One exchange and one sort, by a hash of the keys first, serve the copies inside the batch and those in the table.
        others = [F.first(f"`{c}`").alias(c) for c in responses.columns if c not in keys]  # of one of the copies
        small = rows.count() <= BROADCAST_ROWS
        parts = None if small else int(spark.conf.get("spark.sql.shuffle.partitions"))  # joined ones would be too wide to be sorted in memory
        unique = rows.transform(_by_hash, keys, parts).groupBy("_hash", *keys).agg(*others, F.max("_late").alias("_late"))
        held = _held_keys(spark, path, rows, keys, arrival[0] - kept_ms) if arrival else None
        if held is not None:
            # Not as join keys: these would be sorted by and dealt out by too.
            pairs = [(_as_held(k, "r."), F.col(f"k.{k}")) for k in keys]
            same = [F.coalesce(a == b, a.isNull() & b.isNull()) for a, b in pairs]
            known = reduce(and_, [F.col("r._hash") == F.col("k._hash"), *same, F.col("r._late") | F.col("k._recent")])
            if small:  # such a batch picks what it may meet before the held keys are exchanged
                held = held.join(F.broadcast(rows.select(_key_hash(keys).alias("_met"))), _key_hash(keys) == F.col("_met"), "left_semi")
            held = held.transform(_by_hash, keys, parts).hint("merge")  # of any number, so never sent to every task
            unique = unique.alias("r").join(held.alias("k"), known, "left_anti")
        scored = resolve_confidence(score_responses(unique.select(*[f"`{c}`" for c in responses.columns]), keep_text=False))
        versioned.publish(scored, path, mode="append", partition_cols=["cell_id"], batch=(checkpoint, number))

    with _open_cells(responses.sparkSession):
        return (
            marked.writeStream.outputMode("append").foreachBatch(merge).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start()
        )


def _as_held(key: str, at: str = "") -> Column:
    """A key as the table gives it back: its folders do not tell an empty cell from none."""
    value = F.col(f"{at}{key}")
    return F.when(value.cast("string") != "", value.cast("string")) if key == "cell_id" else value  # nullif is planned as two steps


def _key_hash(keys: list[str]) -> Column:
    return F.xxhash64(*[_as_held(k).cast("string") for k in keys])


def _by_hash(df: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """Rows dealt out by a hash of the keys, which is taken anew afterwards rather than sent: its digits do not compress."""
    return df.repartition(*([parts] if parts else []), _key_hash(keys)).withColumn("_hash", _key_hash(keys))


def _held_keys(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], since: int) -> DataFrame | None:
    """The keys of a versioned table that rows of a batch may repeat: those written since, and of the cells of late rows all."""
    now = versioned.manifest(spark, path)
    if now is None:
        return None
    recent = [f for f in now["folders"] if now.get("written", {}).get(f, since) >= since]
    older = [f for f in now["folders"] if f not in set(recent)]
    keys_in = lambda folders: versioned.load(spark, path, now["version"], folders=folders).select(*keys)
    parts = [keys_in(recent).withColumn("_recent", F.lit(True))] if recent else []
    late_cells = rows.where("_late").select(_as_held("cell_id").alias("cell_id")).distinct()
    named = [r[0] for r in late_cells.limit(NAMED_CELLS + 1).collect()] if older else []
    if named and len(named) <= NAMED_CELLS:  # files of other cells are not opened
        parts.append(keys_in(older).where(reduce(or_, [F.col("cell_id").eqNullSafe(F.lit(c)) for c in named])).withColumn("_recent", F.lit(False)))
    elif named:
        same = F.col("h.cell_id").eqNullSafe(F.col("c.cell_id"))
        parts.append(keys_in(older).alias("h").join(small_side(late_cells).alias("c"), same, "left_semi").withColumn("_recent", F.lit(False)))
    return reduce(DataFrame.unionByName, parts) if parts else None


def start_progress(
    responses: DataFrame, tasks: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str,
    *, trigger: dict | None = None,
) -> StreamingQuery:
    """Rows done and expected for the cells that changed in each batch (R2)."""
    counts = responses.groupBy("cell_id").agg(F.count(F.lit(1)).alias("rows_done"))
    total = identity.expected_rows(F.col("task"))

    def publish(batch: DataFrame, number: int) -> None:
        rows = batch.join(tasks, "cell_id", "left").select("cell_id", "rows_done", total.alias("rows_total"))
        sink(rows.withColumn(
            "status", F.when(F.col("rows_done") >= F.col("rows_total"), "completed").otherwise("in_progress")
        ), number)

    return (
        counts.writeStream.outputMode("update").foreachBatch(publish).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def telemetry_windows(
    samples: DataFrame, *, window: str = "1 minute", delay: str = "5 minutes", interval_seconds: float = 0.5
) -> DataFrame:
    """Roll-up per device and tumbling window, for samples at a fixed interval."""
    return (
        samples.withWatermark("ts", delay)
        .groupBy(F.window("ts", window).alias("w"), "device")
        .agg(
            F.count(F.lit(1)).alias("samples"),
            F.max("mem_bytes").alias("peak_bytes"),
            F.avg("util").alias("gpu_util_mean"),
            F.max("util").alias("gpu_util_max"),
            F.max("power").alias("power_watts_max"),
            (F.sum("power") * interval_seconds).alias("energy_joules"),
        )
        .select(F.col("w.start").alias("window_start"), "device", "samples", "peak_bytes", "gpu_util_mean",
                "gpu_util_max", "power_watts_max", "energy_joules")
    )


GB = 1024**3
BUCKETS = 128
_SAMPLE = ["sec", "sample_id", "mem_bytes", "util", "power"]
_PEAKS = ["peak_bytes", "util_max", "power_max", "last_sec"]
_SUMS = ["samples", "util_sum", "power_sum", "powered", "energy"]
_ENERGY = """device string, samples long, peak_vram_gb double, gpu_util_mean double, gpu_util_max double, power_watts_mean double,
    power_watts_max double, energy_joules double, open_samples long"""


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(",")]


def _packed(rows: pd.DataFrame) -> bytes:
    out, table = pa.BufferOutputStream(), pa.Table.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _unpacked(packed: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(pa.py_buffer(bytes(packed))).read_all().to_pandas()


def _folded(total: pd.DataFrame, samples: pd.DataFrame) -> pd.DataFrame:
    """Totals, one row per ``at``, after more samples, which come in order of ``at`` and time."""
    if samples.empty:
        return total
    at = samples["at"]
    before = samples["sec"].groupby(at).shift().fillna(at.map(total["last_sec"]))
    energy = samples["power"] * (samples["sec"] - before).clip(lower=0)
    more = pd.DataFrame({
        "samples": 1.0, "peak_bytes": samples["mem_bytes"], "util_max": samples["util"], "util_sum": samples["util"],
        "power_max": samples["power"], "power_sum": samples["power"], "powered": samples["power"].notna().astype("float64"),
        "energy": energy, "last_sec": samples["sec"]}).set_index(at)
    both = pd.concat([total, more])
    peaks = both[_PEAKS].groupby(level=0).max()
    # Added one by one onto the totals, so that the sums do not depend on the batches.
    sums = {c: np.bincount(both.index, weights=both[c].fillna(0.0))[peaks.index] for c in _SUMS}
    return peaks.assign(**sums)


class EnergyProcessor(StatefulProcessor):
    """Totals of a bucket's devices up to the watermark, and the samples after it, which late ones may still part."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "total binary, open binary")

    def _settle(self, new: list[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        mark = timers.getCurrentWatermarkInMs() / 1000.0
        if self.held.exists():
            total, waiting = map(_unpacked, self.held.get())
        else:
            total, waiting = pd.DataFrame(columns=["device", *_PEAKS, *_SUMS]), pd.DataFrame(columns=["device", *_SAMPLE])
        parts = [waiting, *new]
        rows = pd.concat([p for p in parts if len(p)] or [waiting], ignore_index=True).astype(
            {"sec": "float64", "sample_id": "int64", "mem_bytes": "float64", "util": "float64", "power": "float64"})
        number, devices = pd.factorize(pd.concat([total["device"], rows["device"]]).astype(object), use_na_sentinel=False)
        total = total.set_index(number[:len(total)])[[*_PEAKS, *_SUMS]].astype("float64")
        rows = rows.assign(at=number[len(total):], new=np.arange(len(rows)) >= len(waiting)).sort_values(["at", "sec", "sample_id"])
        settled = ~(rows["sec"] > mark)  # a sample without a time parts no gap
        total = _folded(total, rows[settled])
        waiting = rows[~settled]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if len(waiting):  # folds what is open when no sample follows
            self.handle.registerTimer(int(waiting["sec"].max() * 1000) + 1)
        named = lambda df, at: df.assign(device=devices[at])
        self.held.update((_packed(named(total, total.index)), _packed(named(waiting, waiting["at"])[["device", *_SAMPLE]])))
        changed = np.unique(rows["at"][settled | rows["new"]])
        if len(changed):
            now = _folded(total, waiting).loc[changed]
            yield pd.DataFrame({
                "device": devices[changed], "samples": now["samples"].astype("int64"), "peak_vram_gb": now["peak_bytes"] / GB,
                "gpu_util_mean": (now["util_sum"] / now["samples"]).where(now["util_max"].notna()), "gpu_util_max": now["util_max"],
                "power_watts_mean": now["power_sum"] / now["samples"], "power_watts_max": now["power_max"],
                "energy_joules": now["energy"].where(now["powered"] > 0),
                "open_samples": waiting["at"].value_counts().reindex(changed, fill_value=0).astype("int64")})[_names(_ENERGY)]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield from self._settle([part[["device", *_SAMPLE]] for part in rows], timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settle([], timerValues)

    def close(self) -> None:
        pass


def telemetry_energy(samples: DataFrame, *, delay: str = "5 minutes", buckets: int = BUCKETS) -> DataFrame:
    """Exact peak memory, utilisation, power and energy per device so far (R3), as the batch job has them.

    A device gives a row whenever it changed; its last row holds for all its samples.  Energy is power
    times the gap to the sample before it, whichever micro-batch that came in: samples younger than the
    watermark stay in state, in order of time, so one that is late by up to ``delay`` still parts the gap
    it falls into.  Older samples are dropped by the watermark.  State per device: one row of totals and
    the samples of the last ``delay``; a timer folds them when its bucket falls silent.  Needs the RocksDB
    state store (``rocksdb_state``).  ``open_samples`` counts the samples that later ones may still part.

    Devices are dealt by hash into ``buckets``, whose rows and state pass as columns: a call of the
    processor costs the same for one device as for thousands.  A checkpoint keeps its number of buckets.
    """
    df = ensure_columns(samples, mem_bytes="long", util="double", power="double", sample_id="long")
    timed = df.withWatermark("ts", delay).select(
        F.pmod(F.xxhash64(F.col("device").cast("string")), F.lit(buckets)).cast("int").alias("bucket"),
        F.col("device").cast("string").alias("device"), "ts", F.col("ts").cast("double").alias("sec"),
        F.coalesce(F.col("sample_id").cast("long"), F.lit(0)).alias("sample_id"),
        *[F.col(c).cast(t) for c, t in (("mem_bytes", "long"), ("util", "double"), ("power", "double"))])
    return timed.groupBy("bucket").transformWithStateInPandas(EnergyProcessor(), _ENERGY, "Update", "EventTime")


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings that hold inside; a query keeps those it was started with."""
    before = {name: spark.conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def _unset(spark: SparkSession, values: dict[str, str]) -> dict[str, str]:
    return {name: value for name, value in values.items() if spark.conf.get(name, None) is None}


_STATE = "spark.sql.streaming.stateStore."


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which ``telemetry_energy`` needs."""
    with _settings(spark, {f"{_STATE}providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}):
        yield


@contextmanager
def _key_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep the keys they have seen on local disks, with bounded memory; a session's own settings go first.

    All stores of an executor share one cache.  Without the count of keys a put needs no read.
    """
    with rocksdb_state(spark), _settings(spark, _unset(spark, {
            f"{_STATE}rocksdb.boundedMemoryUsage": "true", f"{_STATE}rocksdb.maxMemoryUsageMB": "256", f"{_STATE}rocksdb.trackTotalNumberOfRows": "false"})):
        yield


@contextmanager
def _open_cells(spark: SparkSession) -> Iterator[None]:
    """Queries started inside do not sort rows by the cell to write them, unless a task has more cells than it may keep files open."""
    with _settings(spark, _unset(spark, {"spark.sql.maxConcurrentOutputFileWriters": "16"})):
        yield


# Tasks receive these functions by value; workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
