"""Streaming queries, run over the given tables until all input is processed."""

from pyspark.sql import functions as F

from evalweave.plans.shared import cut, scratch_path
from evalweave.registry import views as V
from evalweave.registry.catalog import query
from evalweave.sources import versioned
from evalweave.streaming import jobs


BATCHES = 3
FILE_ROWS = 250_000
DELAY = "90 days"  # the files are in no order of time: longer than the table's span, so that no row comes too late


def stream_table(spark, sf_dir, name, columns=("*",)):
    """A table, or those of its columns that are asked for, as a stream in a few micro-batches, so that state crosses batches.

    A micro-batch has as many files as its rows ask for, so that no task reads more than about FILE_ROWS.
    """
    rows, path = V.table(spark, sf_dir, name).select(*columns), scratch_path(spark, f"stream-{name}")
    files = max(1, -(-rows.count() // (BATCHES * FILE_ROWS)))
    rows.repartition(BATCHES * files).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


_KEYED = [
    ("cell_id", V.CELL), ("id", "cast(l_orderkey as string)"), ("sample_index", "l_linenumber"),
    ("ok", "(l_orderkey + l_linenumber) % 3 = 0"), ("gold", "cast(l_orderkey % 90 + 10 as string)"),
]


def stream_responses(spark, sf_dir):
    """Responses whose columns depend on the key alone; the source holds copies of some keys."""
    named = ["l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber"]  # in _KEYED
    rows = stream_table(spark, sf_dir, "lineitem", named).selectExpr(*[f"{e} as {n}" for n, e in _KEYED])
    return rows.select(
        "cell_id", "id", "sample_index", F.lit("math500").alias("task"),
        F.concat(F.lit("It is \\boxed{"), F.when(F.col("ok"), F.col("gold")).otherwise(F.lit("0")), F.lit("}")).alias("completion"),
        F.concat(F.lit("\\boxed{"), F.col("gold"), F.lit("}")).alias("gold_solution"),
    )


_UNIQUE = "with " + V._ctes("lineitem", "keyed", [_KEYED]) + ", uniq as (select distinct cell_id, id, sample_index, ok, gold from keyed)"


@query("stream_scoring", _UNIQUE + """
  select cell_id, id, sample_index, case when ok then gold else '0' end as pred_answer, ok as correct from uniq""")
def stream_scoring(spark, sf_dir):
    table, checkpoint = scratch_path(spark, "stream-scored"), scratch_path(spark, "stream-scored-state")
    jobs.start_scoring(stream_responses(spark, sf_dir), table, checkpoint).awaitTermination()
    return spark.read.parquet(table).select("cell_id", F.col("id").cast("string").alias("id"), "sample_index", "pred_answer", "correct")


@query("stream_progress", _UNIQUE.split(", uniq")[0] + """  , counted as (select 'supplier_' || l_suppkey as cell_id, count(*) as rows_done, any_value(l_suppkey % 3) as kind from lineitem group by 1),
  expected as (select *, case kind when 0 then 500 when 1 then 1319 else 198 end as rows_total from counted)
  select cell_id, rows_done, rows_total, case when rows_done >= rows_total then 'completed' else 'in_progress' end as status from expected""")
def stream_progress(spark, sf_dir):
    table, checkpoint = scratch_path(spark, "progress"), scratch_path(spark, "progress-state")
    cell = F.concat(F.lit("supplier_"), F.col("l_suppkey").cast("string")).alias("cell_id")
    rows = stream_table(spark, sf_dir, "lineitem").select(cell)
    task = F.element_at(F.array(*map(F.lit, ("math500", "gsm8k", "gpqa_diamond"))), (F.col("l_suppkey") % 3 + 1).cast("int"))
    tasks = V.table(spark, sf_dir, "lineitem").select(cell, task.alias("task")).distinct()

    def sink(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(table)

    jobs.start_progress(rows, tasks, sink, checkpoint).awaitTermination()
    latest = F.max_by(F.struct("rows_done", "rows_total", "status"), "batch").alias("x")
    return spark.read.parquet(table).groupBy("cell_id").agg(latest).select("cell_id", "x.*")


@query("stream_telemetry", V.SAMPLES_SQL + """
  select epoch(time_bucket(interval '1 day', ts)) as window_start, device, count(*) as samples, max(mem_bytes) as peak_bytes,
    avg(util) as gpu_util_mean, max(util) as gpu_util_max, max(power) as power_watts_max, round(sum(power) * 0.5, 6) as energy_joules
  from samples group by 1, 2""")
def stream_telemetry(spark, sf_dir):
    table, checkpoint = scratch_path(spark, "telemetry"), scratch_path(spark, "telemetry-state")
    samples = V.samples_of(stream_table(spark, sf_dir, "events")).withColumn("ts", F.col("ts").cast("timestamp"))

    def sink(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(table)

    windows = jobs.telemetry_windows(samples, window="1 day", delay=DELAY)
    (windows.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())
    keys = ["window_start", "device"]
    kept = spark.read.parquet(table)
    latest = F.max_by(F.struct(*[c for c in kept.columns if c not in (*keys, "batch")]), "batch").alias("x")
    out = kept.groupBy(*keys).agg(latest).select(*keys, "x.*")
    return out.withColumns({"window_start": F.col("window_start").cast("double"), "energy_joules": F.round("energy_joules", 6)})


_TWICE = """, uniq as (select distinct cell_id, id, sample_index, ok, gold from keyed)"""


@query("stream_merging", "with " + V._ctes("lineitem", "keyed", [_KEYED]) + _TWICE + """
  select cell_id, id, sample_index, case when ok then gold else '0' end as pred_answer, ok as correct, 1 as copies from uniq""")
def stream_merging(spark, sf_dir):
    """Exactly once through a restart: the second run, with a checkpoint of its own, meets copies of all rows of the first.

    Half of the rows are fresh, half are late; the series of batches goes on.
    """
    rows = stream_responses(spark, sf_dir).withColumn("ts", F.when(
        F.col("id").cast("long") % 2 == 0, F.current_timestamp()).otherwise(F.lit("1995-01-01").cast("timestamp")))
    path, state = scratch_path(spark, "merged"), scratch_path(spark, "merged-state")
    again = rows.withColumn("ts", F.lit("1995-01-01").cast("timestamp"))
    for source, checkpoint in ((rows, state), (rows, state), (again, state + "-second")):
        jobs.start_merging(source, path, checkpoint, event_time="ts", delay="1 hour").awaitTermination()
    keys = ["cell_id", "id", "sample_index", "pred_answer", "correct"]
    counted = versioned.load(spark, path).groupBy(*sorted(keys, key="id".__ne__)).agg(F.count(F.lit(1)).cast("int").alias("copies"))
    return counted.select(*keys, "copies")  # grouped by the id first, as groups that do not fit in memory are sorted


@query("stream_energy", V.SAMPLES_SQL + """,
  gaps as (select *, greatest(0, epoch(ts) - lag(epoch(ts)) over (partition by device order by ts, sample_id)) as dt from samples)
  select device, count(*) as samples, round(max(mem_bytes) / 1073741824e0, 6) as peak_vram_gb, round(avg(util), 6) as gpu_util_mean,
    max(util) as gpu_util_max, round(coalesce(sum(power), 0) / count(*), 6) as power_watts_mean, max(power) as power_watts_max,
    round(case when count(power) > 0 then coalesce(sum(power * dt), 0) end, 3) as energy_joules from gaps group by device""")
def stream_energy(spark, sf_dir):
    """Exact energy over four micro-batches, each after a restart.  Each batch holds its share of the time span and, from the
    next share, samples that come early, so that the samples of the next batch are late and part their gaps."""
    source, table, state = (scratch_path(spark, f"energy{part}") for part in ("", "-out", "-state"))
    samples = V.samples(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    ends = samples.agg(F.min("ts").cast("double").alias("a"), F.max("ts").cast("double").alias("b")).first()
    share = (F.col("ts").cast("double") - F.lit(ends.a)) / F.lit(max(ends.b - ends.a, 1.0)) * 4
    early = F.when(F.col("sample_id") % 5 == 0, share - 0.5).otherwise(share)
    held = cut(samples.withColumn("file", F.least(F.greatest(F.floor(early), F.lit(0)), F.lit(3))))
    delay = f"{int((ends.b - ends.a) / 7) + 1} seconds"

    def sink(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(table)

    for k in range(4):  # every run goes on from the state of the one before
        held.where(F.col("file") == k).drop("file").write.mode("append").parquet(source)
        stream = spark.readStream.schema(samples.schema).parquet(source)
        with jobs.rocksdb_state(spark):
            (jobs.telemetry_energy(stream, delay=delay).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", state)
             .trigger(availableNow=True).start().awaitTermination())
    kept = spark.read.parquet(table)
    latest = F.max_by(F.struct(*[c for c in kept.columns if c not in ("device", "batch")]), F.struct("batch", "samples")).alias("x")
    out = kept.groupBy("device").agg(latest).select("device", "x.*").drop("open_samples")
    return V.rounded(out).withColumn("energy_joules", F.round("energy_joules", 3))
