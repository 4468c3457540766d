"""Item, prompt, draw-plan, provenance and telemetry queries."""

from pyspark.sql import functions as F

from evalweave.functions import identity
from evalweave.operators import items as I
from evalweave.operators import telemetry
from evalweave.registry import views as V
from evalweave.registry.catalog import query


def numbered_documents(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("unique_id"), "text", "lang", "source", "doc_id")
    return I.number_items(docs, ["lang", "doc_id"])


_NUMBERED = """with numbered as (select *, row_number() over (order by lang, doc_id) - 1 as idx from documents)"""


@query("prepare_items", _NUMBERED + r"""
  select 'doc-' || doc_id as id, idx as item_index, md5(regexp_replace(text, '^[\s\x{85}\x{1c}-\x{1f}\p{Z}]+|[\s\x{85}\x{1c}-\x{1f}\p{Z}]+$', '', 'g')) as question_md5,
    md5(text) as problem_md5, source as gold_solution, cast(null as varchar) as subject from numbered""")
def prepare_items(spark, sf_dir):
    out = I.prepare_items(numbered_documents(spark, sf_dir), problem_field="text", solution_field="source")
    return out.select("id", "item_index", F.md5("question").alias("question_md5"), F.md5("problem").alias("problem_md5"),
                      "gold_solution", "subject")


@query("items_in_order", _NUMBERED + " select doc_id, idx as item_index from numbered where idx < 100")
def items_in_order(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return I.number_items(docs, ["lang", "doc_id"], limit=100).select("doc_id", "item_index")


@query("first_field", """select event_id, coalesce(case when event_id % 3 = 0 then event_type end, cast(value as varchar), '') as label from events""")
def first_field(spark, sf_dir):
    events = V.table(spark, sf_dir, "events").withColumn("label_a", F.expr("case when event_id % 3 = 0 then event_type end"))
    return events.select("event_id", identity.first_field(events.columns, "label_a", "absent", "value").alias("label"))


_CHOICES = """with parts as (select p_partkey as k, p_name as a0, p_brand as a1, p_type as a2, 'none' as a3 from part),
  placed as (select k, i, case i when 0 then a0 when 1 then a1 when 2 then a2 else a3 end as choice,
    row_number() over (partition by k order by md5(concat_ws('|', '5', cast(k as varchar), cast(i as varchar)))) as place
    from parts, range(4) t(i))"""


@query("choice_shuffle", _CHOICES + """
  select cast(k as varchar) as id, k as item_index, max(substr('ABCD', place, 1)) filter (i = 0) as gold_letter,
    max(choice) filter (i = 0) as gold_answer, string_agg(substr('ABCD', place, 1) || ':' || choice, '|' order by place) as choices
  from placed group by k""")
def choice_shuffle(spark, sf_dir):
    parts = V.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_index"), F.col("p_name").alias("question"), F.col("p_name").alias("correct_answer"),
        F.col("p_brand").alias("incorrect_answer_1"), F.col("p_type").alias("incorrect_answer_2"),
        F.lit("none").alias("incorrect_answer_3"))
    out = I.shuffle_choices(parts, seed=5)
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("choices")), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), "|")
    return out.select("id", "item_index", "gold_letter", "gold_answer", shown.alias("choices"))


_TEMPLATES = [
    ("prompts/math500.txt", "Solve: put $\\boxed{{ANSWER}}$ last.\n\n{question}"),
    ("prompts/qrm_math500.txt", "{question}\n\nReason, then answer within \\boxed{{}}."),
    ("prompts/gpqa_diamond.txt", "{question}\n\nA) {a}\nB) {b}"),
]


@query("prompt_rendering", """with r as (select doc_id, text, source, lang,
    case doc_id % 3 when 0 then 'prompts/math500.txt' when 1 then 'prompts/qrm_math500.txt' else 'prompts/gpqa_diamond.txt' end as file from documents)
  select doc_id, file as template_file, md5(case doc_id % 3
    when 0 then concat('Solve: put $', chr(92), 'boxed{ANSWER}$ last.', chr(10), chr(10), text)
    when 1 then concat(text, chr(10), chr(10), 'Reason, then answer within ', chr(92), 'boxed{}.')
    else concat(text, chr(10), chr(10), 'A) ', source, chr(10), 'B) ', lang) end) as prompt_md5 from r""")
def prompt_rendering(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").withColumns({
        "profile": F.expr("case doc_id % 3 when 0 then 'sober' when 1 then 'reproduction' end"),
        "task": F.expr("case when doc_id % 3 = 2 then 'gpqa_diamond' else 'math500' end"),
    })
    docs = docs.withColumn("template_file", I.template_file(F.col("profile"), F.col("task"), F.lit("prompts/gpqa_diamond.txt")))
    templates = V.small_table(spark, _TEMPLATES, "template_file string, template string")
    fields = {"question": F.col("text"), "a": F.col("source"), "b": F.col("lang")}
    return docs.join(F.broadcast(templates), "template_file").select(
        "doc_id", "template_file", F.md5(I.render_template(F.col("template"), fields)).alias("prompt_md5"))


@query("draw_plan", """select doc_id, cast(i as int) as sample_index, 7 * 1000 + i as sample_seed from documents, range(5) t(i)""")
def draw_plan(spark, sf_dir):
    return I.draw_plan(V.table(spark, sf_dir, "documents").select("doc_id"), 5, 7)


@query("remaining_draws", """with plan as (select distinct l_orderkey as id, i as sample_index from lineitem, range(8) t(i)),
  done as (select distinct l_orderkey as id, l_linenumber as sample_index from lineitem)
  select p.id, cast(p.sample_index as int) as sample_index, 3 * 1000 + p.sample_index as sample_seed
  from plan p left join done d on d.id = p.id and d.sample_index = p.sample_index where d.id is null""")
def remaining_draws(spark, sf_dir):
    lines = V.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("sample_index"))
    return I.remaining_draws(I.draw_plan(lines.select("id").distinct(), 8, 3), lines)


@query("text_hash", "select doc_id, substr(sha256(text), 1, 16) as input_text_hash from documents")
def text_hash(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", identity.short_hash(F.col("text")).alias("input_text_hash"))


@query("config_hash", """select o_orderkey, substr(sha256(
    '{"cell_id": "cell_' || o_orderkey || '", "decoding": {"max_tokens": 32768, "temperature": 0.6}, "model_config": "' || o_orderpriority ||
    '", "model_path": null, "prompt_profile": "sober", "quant_config": "' || o_orderstatus || '", "seed": ' || (o_custkey % 5) || ', "task_config": null}'), 1, 16) as config_hash from orders""")
def config_hash(spark, sf_dir):
    fields = {
        "cell_id": F.concat(F.lit("cell_"), F.col("o_orderkey").cast("string")), "model_config": F.col("o_orderpriority"),
        "model_path": F.lit(None).cast("string"), "prompt_profile": F.lit("sober"), "quant_config": F.col("o_orderstatus"),
        "seed": F.col("o_custkey") % 5,
    }
    decoding = {"temperature": F.lit(0.6), "max_tokens": F.lit(32768)}
    return V.table(spark, sf_dir, "orders").select("o_orderkey", identity.config_hash(fields, decoding).alias("config_hash"))


@query("provenance_columns", """select o_orderkey, 'cell_' || o_orderkey || '-s' || (o_custkey % 5) || '-' || strftime(o_orderdate, '%Y%m%dT%H%M%SZ') as run_id,
    strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00') as timestamp, 'abc1234' as git_commit, substr(sha256(o_orderstatus), 1, 16) as config_hash,
    'qrm_math500.txt' as prompt_template_version, 'raw_response.v1' as schema_version from orders""")
def provenance_columns(spark, sf_dir):
    orders = V.table(spark, sf_dir, "orders").withColumns({
        "cell_id": F.concat(F.lit("cell_"), F.col("o_orderkey").cast("string")), "seed": F.col("o_custkey") % 5,
        "prompt_template_file": F.lit("prompts/qrm_math500.txt")})
    out = I.with_provenance(orders, at=F.col("o_orderdate"), git_commit="abc1234",
                            hash_column=identity.short_hash(F.col("o_orderstatus")))
    return out.select("o_orderkey", "run_id", "timestamp", "git_commit", "config_hash", "prompt_template_version", "schema_version")


@query("config_join", """select o_orderkey as cell_id, c_name as model_id, 'math500' as task_name,
    case when o_orderpriority like '1%' then 0.9 else 0.6 end as temperature, 0.95 as top_p, 32768 as max_tokens,
    case when o_orderstatus = 'O' then 'prompts/math500.txt' when o_orderstatus = 'F' then 'prompts/qrm_math500.txt' else 'prompts/own.txt' end as prompt_template_file
  from orders left join customer on c_custkey = o_custkey""")
def config_join(spark, sf_dir):
    orders = V.table(spark, sf_dir, "orders")
    cells = orders.select(
        F.col("o_orderkey").alias("cell_id"), F.col("o_custkey").alias("model_config"), F.lit("t").alias("task_config"),
        F.col("o_orderpriority").alias("decoding_config"),
        F.expr("case o_orderstatus when 'O' then 'sober' when 'F' then 'reproduction' end").alias("prompt_profile"))
    models = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("model_config"), F.col("c_name").alias("model_id"))
    tasks = V.small_table(spark, [("t", "math500", "prompts/own.txt")], "task_config string, task_name string, prompt_template_file string")
    decoding = orders.select(F.col("o_orderpriority").alias("decoding_config")).distinct().select(
        "decoding_config", F.when(F.col("decoding_config").startswith("1"), 0.9).alias("temperature"),
        F.lit(None).cast("double").alias("top_p"), F.lit(None).cast("int").alias("max_tokens"))
    out = I.join_cell_config(cells, models, tasks, decoding)
    return out.select("cell_id", "model_id", "task_name", "temperature", "top_p", "max_tokens", "prompt_template_file")


@query("telemetry_integration", V.SAMPLES_SQL + """,
  gaps as (select *, greatest(0, epoch(ts) - lag(epoch(ts)) over (partition by device order by ts, sample_id)) as dt from samples)
  select device, count(*) as samples, round(max(mem_bytes) / 1073741824e0, 6) as peak_vram_gb, avg(util) as gpu_util_mean,
    max(util) as gpu_util_max, round(coalesce(sum(power), 0) / count(*), 9) as power_watts_mean, max(power) as power_watts_max,
    round(case when count(power) > 0 then coalesce(sum(power * dt), 0) end, 3) as energy_joules from gaps group by device""")
def telemetry_integration(spark, sf_dir):
    out = telemetry.integrate_samples(V.samples(spark, sf_dir), bucket_seconds=86400)
    digits = {"peak_vram_gb": 6, "power_watts_mean": 9, "energy_joules": 3}
    return out.withColumns({c: F.round(c, d) for c, d in digits.items()})


@query("serving_metrics", """with b as (select *, count(*) over (partition by l_orderkey) as m from lineitem),
  s as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_extendedprice / 1e2 / m as lat, l_extendedprice / m as en,
    greatest(0, l_linenumber / 1e1 - 0.2e0) as ttft, cast(l_quantity * 10 as bigint) as pt, cast(l_quantity * (l_linenumber - 1) as bigint) as ct from b)
  select l_orderkey as batch_id, l_linenumber, l_partkey, l_suppkey, lat as latency_sec, en as energy_joules,
    ttft as time_to_first_token_sec, pt + ct as total_tokens, (pt + ct) / lat as tokens_per_second,
    case when lat - ttft > 0 then ct / (lat - ttft) end as decode_tokens_per_second,
    case when ct <> 0 then lat / ct end as seconds_per_output_token, ct / en as tokens_per_joule,
    ct >= 100 as truncated, 4 as completion_chars from s""")
def serving_metrics(spark, sf_dir):
    rows = V.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("batch_id"), "l_linenumber", "l_partkey", "l_suppkey",
        (F.col("l_extendedprice") / 100).alias("batch_latency_sec"), F.col("l_extendedprice").alias("batch_energy_joules"),
        F.lit(0.2).alias("arrival_time"), (F.col("l_linenumber") / 10).alias("first_token_time"),
        (F.col("l_quantity") * 10).cast("long").alias("prompt_tokens"),
        (F.col("l_quantity") * (F.col("l_linenumber") - 1)).cast("long").alias("completion_tokens"),
        F.lit("text").alias("completion"), F.lit(100).alias("max_tokens"))
    out = telemetry.serving_metrics(rows)
    return out.select(
        "batch_id", "l_linenumber", "l_partkey", "l_suppkey", "latency_sec", "energy_joules", "time_to_first_token_sec",
        "total_tokens", "tokens_per_second", "decode_tokens_per_second", "seconds_per_output_token", "tokens_per_joule",
        "truncated", "completion_chars")
