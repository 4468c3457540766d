"""Reader and writer queries: tables written to the shared folder and read back."""

from pyspark.sql import functions as F

from evalweave.functions import scoring
from evalweave.plans.shared import scratch_path
from evalweave.registry import views as V
from evalweave.registry.catalog import query
from evalweave.registry.summary_queries import run_summaries, runs_sql
from evalweave.sources import documents, readers, versioned, writers


@query("jsonl_roundtrip", V.SCORED_SQL + """
  select cell_id, id, sample_index, task, seed, latency_sec, completion_tokens, finish_reason, truncated, confidence, confidence_source from scored""")
def jsonl_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "responses")
    writers.write_jsonl(V.raw_responses(spark, sf_dir).drop("sd"), path, partition_cols=["cell_id"], compression="gzip")
    return readers.read_responses(spark, path).select(
        "cell_id", "id", "sample_index", "task", "seed", "latency_sec", "completion_tokens", "finish_reason", "truncated",
        "confidence", "confidence_source")


@query("archive_rescore", V.SCORED_SQL + """,
    ext as (select *, case when task = 'gpqa_diamond' then case when pred_answer in ('A', 'B', 'C', 'D') then pred_answer end
            else nullif(coalesce(pred_answer, ''), '') end as pred from scored)
    select cell_id, count(*) as n, count_if(coalesce(pred = gold_answer, false)) as num_correct,
        count_if(pred is not null) as parsed, cast(sum(2) as bigint) as steps from ext group by cell_id""")
def archive_rescore(spark, sf_dir):
    """All raw files of an archive in one job."""
    path = scratch_path(spark, "raw")
    writers.write_jsonl(V.raw_responses(spark, sf_dir).drop("sd"), path, partition_cols=["cell_id"], compression="gzip")
    rows = scoring.score_responses(readers.read_responses(spark, path), keep_text=False)
    return rows.groupBy("cell_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("num_correct"),
        F.count_if("answer_parse_success").alias("parsed"), F.sum("reasoning_steps").alias("steps"))


_LINES = """with docs as (select event_id, event_type,
    case when event_type = 'error' and event_id % 50 = 3 then '{"k": ' when event_id % 11 = 0 then '   ' else props end as value from events)"""


def _event_lines(spark, sf_dir, broken="error"):
    """Event properties as line files per event type; some lines blank, some of one type broken."""
    path = scratch_path(spark, "lines")
    lines = V.table(spark, sf_dir, "events").select(
        "event_type",
        F.when((F.col("event_type") == broken) & (F.col("event_id") % 50 == 3), '{"k": ')
        .when(F.col("event_id") % 11 == 0, "   ").otherwise(F.col("props")).alias("value"))
    lines.write.partitionBy("event_type").text(path)
    found = readers.read_lines(spark, path)
    return found.withColumn("name", F.regexp_extract("path", "event_type=([a-z]+)", 1))


@query("line_validity", _LINES + """
  select event_type as name, count(*) filter (trim(value) <> '' and value <> '{"k": ') as good_rows,
    count(*) filter (value = '{"k": ') as bad_rows, count(*) filter (value = '{"k": ') = 0 as valid from docs group by 1""")
def line_validity(spark, sf_dir):
    return readers.line_validity(_event_lines(spark, sf_dir), ["name"])


@query("corrupt_lines_set_aside", _LINES + """
  select event_type as name, count(*) filter (trim(value) <> '' and value <> '{"k": ') as parsed,
    cast(sum(try_cast(regexp_extract(value, ': (\\d+)', 1) as bigint)) as bigint) as k_sum,
    count(*) filter (value = '{"k": ') as set_aside from docs group by 1""")
def corrupt_lines_set_aside(spark, sf_dir):
    lines = _event_lines(spark, sf_dir)
    by_name = F.regexp_extract("path", "event_type=([a-z]+)", 1)
    good, bad = readers.split_corrupt(lines.drop("name"), V.small_table(spark, [], "k long").schema)
    parsed = good.groupBy(by_name.alias("name")).agg(F.count(F.lit(1)).alias("parsed"), F.sum("k").alias("k_sum"))
    aside = bad.groupBy(by_name.alias("name")).agg(F.count(F.lit(1)).alias("set_aside"))
    return parsed.join(aside, "name", "left").withColumn("set_aside", F.coalesce("set_aside", F.lit(0)))


@query("mirror_preferred", """select distinct event_type as name, case event_type when 'error' then 'mirror' else 'primary' end as source from events""")
def mirror_preferred(spark, sf_dir):
    by_name = ["name"]
    primary = readers.line_validity(_event_lines(spark, sf_dir, "error"), by_name).withColumn("path", F.lit("primary"))
    mirror = readers.line_validity(_event_lines(spark, sf_dir, "view"), by_name).withColumn("path", F.lit("mirror"))
    return readers.prefer_valid_copy(primary, mirror).select("name", "source")


@query("parquet_by_cell", V.SCORED_SQL + f"""
  select cell_id, count(*) as n, round(sum(latency_sec), 6) as total_seconds from scored where cell_id = '{V.BASELINE_CELL}' group by 1""")
def parquet_by_cell(spark, sf_dir):
    path = scratch_path(spark, "scored")
    writers.write_parquet(V.scored(spark, sf_dir).select("cell_id", "id", "sample_index", "latency_sec", "correct"), path)
    cell = spark.read.parquet(path).filter(F.col("cell_id") == V.BASELINE_CELL)
    return V.rounded(cell.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"), F.sum("latency_sec").alias("total_seconds")))


@query("flatten_nested", """select o_orderkey as id, o_orderstatus as "cell.status", o_totalprice as "cell.cost.total",
    o_custkey as "cell.cost.customer" from orders""")
def flatten_nested(spark, sf_dir):
    nested = V.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.struct(F.col("o_orderstatus").alias("status"),
                 F.struct(F.col("o_totalprice").alias("total"), F.col("o_custkey").alias("customer")).alias("cost")).alias("cell"))
    return writers.flatten(nested)


@query("csv_table", V.SCORED_SQL + f""", {runs_sql()}
  select cell_id, task, cast(null as varchar) as model_family, quant_config, cast(n as varchar) as n,
    cast(num_parse_failures as varchar) as num_parse_failures, cast(num_truncated as varchar) as num_truncated from runs""")
def csv_table(spark, sf_dir):
    path = scratch_path(spark, "csv")
    writers.write_csv(run_summaries(spark, sf_dir), path, writers.FAILURE_FIELDS)
    back = spark.read.option("header", True).csv(path)
    return back.select("cell_id", "task", "model_family", "quant_config", "n", "num_parse_failures", "num_truncated")


@query("response_cache", V.SCORED_SQL + """
  select id, task, cast(null as varchar) as prompt, completion, pred_answer, nullif(gold_answer, '') as gold_answer, correct, cell_id, quant_config, seed from scored""")
def response_cache(spark, sf_dir):
    return writers.response_cache(V.scored(spark, sf_dir))


@query("response_cache_limited", V.SCORED_SQL + """
  select id, task, completion, pred_answer, gold_answer, correct, cell_id, quant_config, seed from scored
  order by cell_id, id, sample_index limit 500""")
def response_cache_limited(spark, sf_dir):
    return writers.response_cache(V.scored(spark, sf_dir), limit=500).drop("prompt")


@query("file_hashes", """select s_suppkey, sha256(concat(s_name, '|', s_nationkey, chr(10))) as sha256,
    cast(strlen(concat(s_name, '|', s_nationkey)) + 1 as bigint) as n_bytes from supplier""")
def file_hashes(spark, sf_dir):
    """One text file per supplier, hashed."""
    path = scratch_path(spark, "files")
    rows = V.table(spark, sf_dir, "supplier").select("s_suppkey", F.concat_ws("|", "s_name", "s_nationkey").alias("value"))
    # Few bytes, but a file each: a fixed number of tasks writes them.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(tasks, "s_suppkey").write.partitionBy("s_suppkey").text(path)
    key = F.regexp_extract("path", "s_suppkey=([0-9]+)", 1).cast("long").alias("s_suppkey")
    return readers.file_hashes(spark, path).select(key, "sha256", "n_bytes")


@query("given_file_hashes")
def given_file_hashes(spark, sf_dir):
    """Every Parquet file of the given folder, hashed; SQL has no access to the bytes, tests use hashlib."""
    return readers.file_hashes(spark, sf_dir, "*.parquet")


@query("items_of_split", """select p_partkey as id, p_name as problem, 'test' as split from part where p_partkey % 3 = 1""")
def items_of_split(spark, sf_dir):
    """One split of a stored item table."""
    path = scratch_path(spark, "items")
    split = F.when(F.col("p_partkey") % 3 == 1, "test").otherwise("train").alias("split")
    V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("problem"), split).write.parquet(path)
    return readers.read_items(spark, path, split="test")


@query("response_cache_manifest", V.SCORED_SQL + " select 'archive' as source, 'none' as git_commit, count(*) as n_rows from scored")
def response_cache_manifest(spark, sf_dir):
    return writers.cache_manifest(writers.response_cache(V.scored(spark, sf_dir)), source="archive", git_commit="none")


def _put_documents(spark, folder, docs):
    """Text files named as the rows (name, value) say: one file per row, moved from a partitioned write."""
    staged = scratch_path(spark, "documents")
    docs.write.partitionBy("name").text(staged)
    at = spark._jvm.org.apache.hadoop.fs.Path
    files = at(staged).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for status in files.listStatus(at(staged)):
        name = status.getPath().getName()
        if name.startswith("name="):
            part = next(p.getPath() for p in files.listStatus(status.getPath()) if p.getPath().getName().startswith("part-"))
            target = at(f"{folder}/{name[5:].replace('%2F', '/')}")
            files.mkdirs(target.getParent())
            files.rename(part, target)
    return folder


_CELL_DOCS = """with cells as (select 'run_' || (l_suppkey % 40) as cell_id, l_suppkey % 40 % 3 = 0 as unnamed, count(*) as n,
    round(avg(l_quantity), 6) as pass_at_1, max(l_linenumber) as seed from lineitem group by l_suppkey % 40)"""


def _cell_docs(spark, sf_dir):
    """Forty cells of run documents over all rows."""
    return V.table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 40).alias("run")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 6).alias("pass_at_1"), F.max("l_linenumber").alias("seed")).withColumn(
        "cell_id", F.concat(F.lit("run_"), F.col("run")))


@query("summary_scan", _CELL_DOCS + " select cell_id, n, pass_at_1, cast(unnamed as int) as unnamed, seed as best from cells")
def summary_scan(spark, sf_dir):
    """Summary files of many cells in nested folders, some without their cell's name; other files lie beside them."""
    cells = _cell_docs(spark, sf_dir)
    body = F.to_json(F.struct(
        F.when(F.col("run") % 3 != 0, F.col("cell_id")).alias("cell_id"), "n", "pass_at_1",
        F.struct(F.col("seed").alias("best")).alias("detail"), (F.col("run") % 3 == 0).cast("int").alias("unnamed")))
    name = F.concat(F.lit("run"), F.col("run") % 4, F.lit("/"), F.col("cell_id"), F.lit("_summary.json"))
    other = F.concat(F.lit("run0/"), F.col("cell_id"), F.lit("_notes.json"))
    docs = cells.select(name.alias("name"), body.alias("value")).union(cells.select(other, F.lit("{}")))
    found = readers.read_summaries(spark, _put_documents(spark, scratch_path(spark, "summaries"), docs))
    return found.select("cell_id", "n", "pass_at_1", F.col("unnamed").cast("int").alias("unnamed"), F.col("detail.best").cast("int").alias("best"))


@query("summary_sink", V.SCORED_SQL + f""", {runs_sql()}
  select cell_id, n, round(pass_at_1, 6) as pass_at_1, num_correct, round(cost_per_correct_seconds, 6) as cost_per_correct_seconds from runs""")
def summary_sink(spark, sf_dir):
    """Summaries written as line JSON, as a version, and read again."""
    path = scratch_path(spark, "summary")
    writers.write_jsonl(run_summaries(spark, sf_dir), path, as_version=True)
    return V.rounded(versioned.load(spark, path).select("cell_id", "n", "pass_at_1", "num_correct", "cost_per_correct_seconds"))


@query("harness_scan", """select n_name as key, round(n_nationkey / 25e0, 6) as accuracy, case when n_nationkey % 2 = 0 then round(n_regionkey / 5e0, 6) end as strict
    from nation""")
def harness_scan(spark, sf_dir):
    """Entries of the newest of several results files; the greatest by path has no results."""
    nations = V.table(spark, sf_dir, "nation")
    entry = lambda shift: F.struct(
        F.round((F.col("n_nationkey") + shift) / 25.0, 6).alias("acc,none"), F.lit("x").alias("alias"),
        F.when(F.col("n_nationkey") % 2 == 0, F.round(F.col("n_regionkey") / 5.0, 6)).alias("exact_match,strict-match"))
    whole = lambda shift: nations.groupBy().agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(
        F.col("n_name"), entry(shift)))).alias("results"))).alias("value"))
    docs = whole(0).select(F.lit("b/results_2024-05-02.json").alias("name"), "value").union(
        whole(3).select(F.lit("a/results_2024-05-03.json"), "value")).union(
        whole(5).select(F.lit("b/other_2024-05-04.json"), "value")).union(
        spark.createDataFrame([("c/results_2024-05-05.json", '{"config": {}}'), ("c/results_2024-05-06.json", '{"results": ')], "name string, value string"))
    found = readers.read_harness_results(spark, _put_documents(spark, scratch_path(spark, "harness"), docs))
    return found.select("key", F.col("metrics")["acc,none"].alias("accuracy"), F.col("metrics")["exact_match,strict-match"].alias("strict"))


@query("config_scan", _CELL_DOCS + """ select cell_id || '.json' as file_name, cell_id, 'models/' || cell_id as model_config, seed,
    case when unnamed then null else pass_at_1 end as temperature from cells""")
def config_scan(spark, sf_dir):
    """One configuration document per cell, pretty-printed, some without a decoding section."""
    cells = _cell_docs(spark, sf_dir)
    body = F.to_json(F.struct(
        "cell_id", F.concat(F.lit("models/"), F.col("cell_id")).alias("model_config"), "seed",
        F.when(F.col("run") % 3 != 0, F.struct(F.col("pass_at_1").alias("temperature"))).alias("decoding")), {"pretty": "true"})
    docs = cells.select(F.concat("cell_id", F.lit(".json")).alias("name"), body.alias("value"))
    found = readers.read_documents(spark, _put_documents(spark, scratch_path(spark, "configs"), docs))
    return found.select("file_name", "cell_id", "model_config", F.col("seed").cast("int").alias("seed"), F.col("decoding.temperature").alias("temperature"))


@query("versioned_table", V.SCORED_SQL + """
  select cell_id, cast(seed as int) as version, count(*) as n, round(sum(latency_sec), 6) as seconds from scored group by 1, 2
  union all select cell_id, 9, count(*), round(sum(latency_sec), 6) from scored group by 1""")
def versioned_table(spark, sf_dir):
    """A table replaced and appended to in versions: each version as its readers see it.  A batch given twice counts once."""
    rows = V.scored(spark, sf_dir).select("cell_id", "seed", "id", "sample_index", "latency_sec")
    path, only = scratch_path(spark, "versions"), lambda k: rows.where(F.col("seed") == k)
    kept = {0: versioned.publish(only(0), path, partition_cols=["cell_id"])}
    kept[1] = versioned.publish(only(1), path, partition_cols=["cell_id"])
    for _ in range(2):
        kept[9] = versioned.publish(only(0), path, mode="append", partition_cols=["cell_id"], batch=("load", 0))
    seen = [versioned.load(spark, path, v).groupBy("cell_id", F.lit(k).alias("version")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("latency_sec").alias("seconds")) for k, v in kept.items()]
    return V.rounded(seen[0].union(seen[1]).union(seen[2]))


@query("versioned_csv", V.SCORED_SQL + f""", {runs_sql()}
  select cell_id, task, cast(null as varchar) as model_family, n, num_truncated from runs""")
def versioned_csv(spark, sf_dir):
    path = scratch_path(spark, "csv-versions")
    writers.write_csv(run_summaries(spark, sf_dir), path, writers.MAIN_FIELDS, as_version=True)
    writers.write_csv(run_summaries(spark, sf_dir), path, writers.FAILURE_FIELDS, as_version=True)
    return versioned.load(spark, path).select("cell_id", "task", "model_family", "n", "num_truncated")


@query("document_source", _CELL_DOCS + " select cell_id, n, pass_at_1 from cells where cell_id in ('run_1', 'run_2', 'run_3')")
def document_source(spark, sf_dir):
    """The same kind of files through the data source; the names choose which files are read."""
    cells = _cell_docs(spark, sf_dir)
    body = F.to_json(F.struct("n", "pass_at_1"))
    docs = cells.select(F.concat(F.lit("x/"), F.col("cell_id"), F.lit("_summary.json")).alias("name"), body.alias("value"))
    documents.register(spark)
    found = spark.read.format("json_documents").option("path", _put_documents(spark, scratch_path(spark, "source"), docs)).option(
        "pattern", "*_summary.json").load().where(F.col("cell").isin("run_1", "run_2", "run_3"))
    return found.select(F.col("cell").alias("cell_id"), F.from_json("value", "n long, pass_at_1 double").alias("d")).select("cell_id", "d.*")
