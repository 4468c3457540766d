"""Validation, provenance, status, baseline and harness queries."""

from pyspark.sql import functions as F

from evalweave.functions import identity
from evalweave.operators import gates, schema
from evalweave.registry import views as V
from evalweave.registry.catalog import query
from evalweave.registry.summary_queries import run_summaries, runs_sql
from evalweave.sources.schemas import CELL_RULES, document

# Literature targets (model, task, metric, reference, low, high, maximum, severity).
TARGETS = [
    ("DeepSeek-R1-Distill-Qwen-7B", "MATH-500", "pass_at_1_pct", 55.5, 45.0, 65.0, None, "FAIL"),
    ("DeepSeek-R1-Distill-Qwen-7B", "MATH-500", "truncation_rate", None, None, None, 0.30, "FAIL"),
    ("DeepSeek-R1-Distill-Qwen-7B", "MATH-500", "parse_failure_rate", None, None, None, 0.40, "FAIL"),
    ("DeepSeek-R1-Distill-Qwen-7B", "MATH-500", "reasoning_steps_mean", None, 3.0, 80.0, None, "WARN"),
    ("DeepSeek-R1-Distill-Qwen-7B", "GSM8K", "pass_at_1_pct", 88.0, 75.0, 95.0, None, "FAIL"),
    ("DeepSeek-R1-Distill-Llama-8B", "MATH-500", "pass_at_1_pct", 50.0, 40.0, 60.0, None, "FAIL"),
    ("DeepSeek-R1-Distill-Llama-8B", "MATH-500", "truncation_rate", None, None, None, 0.30, "FAIL"),
    ("DeepSeek-R1-Distill-Llama-8B", "MATH-500", "parse_failure_rate", None, None, None, 0.40, "FAIL"),
    ("DeepSeek-R1-Distill-Qwen-7B-GPTQ-W4G128", "MATH-500", "pass_at_1_pct", None, 40.0, 60.0, None, "FAIL"),
]
TARGET_SCHEMA = """model_key string, task_key string, metric string, reference double, lo double, hi double,
    max_value double, severity string"""
_TARGETS_SQL = f"""targets as (select model_key, task_key, metric, cast(lo as double) as lo, cast(hi as double) as hi,
    cast(mx as double) as mx, severity from {V.values_sql(TARGETS)} t(model_key, task_key, metric, reference, lo, hi, mx, severity))"""
_KEYS = """keyed as (select *, lower(cell_id || ' ' || coalesce(model_path, '')) as x from runs),
  keys as (select *, case when contains(x, 'llama') and contains(x, '8b') then 'DeepSeek-R1-Distill-Llama-8B'
      when contains(x, 'gptq') and contains(x, 'qwen') then 'DeepSeek-R1-Distill-Qwen-7B-GPTQ-W4G128'
      when contains(x, 'qwen') and contains(x, '7b') then 'DeepSeek-R1-Distill-Qwen-7B' end as model_key,
    case when task like 'gsm8k%' then 'GSM8K' when task like 'gpqa%' then 'GPQA-Diamond' else 'MATH-500' end as task_key from keyed)"""
_CHECKS = f"""{_TARGETS_SQL}, {_KEYS},
  obs as (select cell_id, model_key, task_key, 'pass_at_1_pct' as metric, pass_at_1 * 100 as observed from keys
    union all select cell_id, model_key, task_key, 'truncation_rate', truncation_rate from keys
    union all select cell_id, model_key, task_key, 'parse_failure_rate', parse_failure_rate from keys
    union all select cell_id, model_key, task_key, 'reasoning_steps_mean', reasoning_steps_mean from keys),
  checks as (select o.*, case when t.metric is null then 'SKIP'
      when mx is not null and observed <= mx then 'PASS' when mx is null and observed between lo and hi then 'PASS'
      else t.severity end as status
    from obs o left join targets t using (model_key, task_key, metric))"""


def _checks(spark, sf_dir):
    return gates.baseline_checks(run_summaries(spark, sf_dir), V.small_table(spark, TARGETS, TARGET_SCHEMA))


@query("baseline_keys", V.SCORED_SQL + f""", {runs_sql()}, {_KEYS} select cell_id, model_key, task_key from keys""")
def baseline_keys(spark, sf_dir):
    cells = V.scored(spark, sf_dir).select(F.col("run_cell").alias("cell_id"), "model_path", "task").distinct()
    return cells.select(
        "cell_id", identity.baseline_model_key(F.col("cell_id"), F.col("model_path")).alias("model_key"),
        identity.baseline_task_key(F.col("task")).alias("task_key"))


@query("baseline_checks", V.SCORED_SQL + f""", {runs_sql()}, {_CHECKS}
  select cell_id, model_key, task_key, metric, round(observed, 6) as observed, status from checks""")
def baseline_checks(spark, sf_dir):
    return V.rounded(_checks(spark, sf_dir).select("cell_id", "model_key", "task_key", "metric", "observed", "status"))


@query("baseline_gate", V.SCORED_SQL + f""", {runs_sql()}, {_CHECKS}
  select cell_id, model_key, task_key, count_if(status <> 'SKIP') as n_checks,
    case when count_if(status <> 'SKIP') > 0 then count_if(status = 'FAIL') = 0 end as passed from checks group by 1, 2, 3""")
def baseline_gate(spark, sf_dir):
    return gates.baseline_gate(_checks(spark, sf_dir))


# Cell documents as JSON lines, some of them broken, one per order.
_CELL_LINES = """with docs as (select o_orderkey as k, o_orderstatus as path,
    case o_orderkey % 9 when 0 then '{"cell_id": "Bad-Id", "seed": 1'
      when 1 then '{"cell_id": "Bad-Id", "model_config": "m", "task_config": "t", "quant_config": "q", "seed": 1}'
      when 2 then '{"cell_id": "ok_1", "model_config": "m", "task_config": "t", "quant_config": "q", "seed": -3}'
      when 3 then '{"cell_id": "ok_1", "model_config": 7, "task_config": "t", "quant_config": "q", "seed": 1}'
      when 4 then '{"cell_id": "ok_1", "model_config": "m", "seed": 1.5, "quant_config": "q", "task_config": "t"}'
      when 5 then '{"cell_id": "ok_1", "task_config": "t", "quant_config": "q", "seed": 1, "prompt_profile": "odd"}'
      else '{"cell_id": "ok_1", "model_config": "m", "task_config": "t", "quant_config": "q", "seed": 1, "prompt_profile": "sober", "x": [1]}'
    end as value from orders)"""
_ERRORS = """case k % 9 when 0 then ['row: not valid JSON'] when 1 then ['cell_id: does not match its pattern']
    when 2 then ['seed: is below its minimum'] when 3 then ['model_config: is not of type string']
    when 4 then ['seed: is not of type integer']
    when 5 then ['prompt_profile: is not an allowed value', 'model_config: required property missing'] else [] end"""


def _cell_lines(spark, sf_dir):
    orders = V.table(spark, sf_dir, "orders")
    text = _CELL_LINES[_CELL_LINES.index("case"):_CELL_LINES.index("end as value") + 3]
    return orders.selectExpr("o_orderkey as k", "o_orderstatus as path", f"{text} as value")


@query("schema_validation", _CELL_LINES + f""",
  errs as (select path, k, {_ERRORS} as e from docs),
  per_row as (select path, k, unnest(e) as message, unnest(range(len(e))) as at from errs)
  select d.path, count(*) as rows_checked, cast(sum(len(e)) as bigint) as n_errors, sum(len(e)) = 0 as valid,
    least(20, sum(len(e))) as n_shown, any_value(first_row) as first_error_row
  from errs d join (select path, min(k) as first_row from per_row group by 1) m using (path) group by d.path""")
def schema_validation(spark, sf_dir):
    report = gates.validation_report(_cell_lines(spark, sf_dir), CELL_RULES, row_col="k", reported=20)
    first = F.regexp_extract(F.try_element_at("errors", F.lit(1)), r"^row (\d+)", 1).cast("long")
    return report.select("path", "rows_checked", "n_errors", "valid", F.size("errors").alias("n_shown"), first.alias("first_error_row"))


@query("schema_row_errors", _CELL_LINES + f"""
  select k, array_to_string(list_sort({_ERRORS}), '; ') as errors from docs""")
def schema_row_errors(spark, sf_dir):
    found = gates.with_row_errors(_cell_lines(spark, sf_dir), CELL_RULES)
    return found.select("k", F.array_join(F.array_sort("errors"), "; ").alias("errors"))


@query("schema_document_errors", _CELL_LINES + f"""
  select k, array_to_string(list_sort({_ERRORS}), '; ') as errors from docs""")
def schema_document_errors(spark, sf_dir):
    """The same lines against the rules as a JSON Schema document."""
    found = schema.with_schema_errors(_cell_lines(spark, sf_dir), document(CELL_RULES))
    return found.select("k", F.array_join(F.array_sort("errors"), "; ").alias("errors"))


_ORDER_SCHEMA = {
    "type": "object", "required": ["key", "lines"],
    "properties": {
        "key": {"type": "integer"}, "status": {"enum": ["F", "O"]},
        "lines": {"type": "array", "maxItems": 6, "items": {
            "type": "object", "required": ["qty"], "properties": {"qty": {"type": "integer", "maximum": 45}, "flag": {"type": ["string", "null"], "pattern": "^[AN]$"}}}},
    },
}


@query("schema_nested_errors", """
  with l as (select l_orderkey as k, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as i,
      cast(l_quantity as int) as qty, l_returnflag as flag from lineitem),
  found as (
    select k, 'lines[' || i || '].qty: is above its maximum' as m from l where qty % 10 <> 0 and qty > 45
    union all select k, 'lines[' || i || '].qty: required property missing' from l where qty % 10 = 0
    union all select k, 'lines[' || i || '].flag: does not match its pattern' from l where flag = 'R'
    union all select k, 'lines: has too many items' from l group by k having count(*) > 6
    union all select o_orderkey, 'status: is not an allowed value' from orders where o_orderstatus = 'P')
  select o_orderkey as k, coalesce(string_agg(m, '; ' order by m), '') as errors from orders left join found on k = o_orderkey
  where o_orderkey in (select k from l) group by o_orderkey""")
def schema_nested_errors(spark, sf_dir):
    """Orders with their lines as nested documents: objects in arrays, each message with its place."""
    lines = V.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_quantity").cast("int").alias("qty"), F.col("l_returnflag").alias("flag")))).alias("x"))
    entry = F.transform("x", lambda e: F.struct(F.when(e["qty"] % 10 != 0, e["qty"]).alias("qty"), e["flag"].alias("flag")))
    docs = V.table(spark, sf_dir, "orders").join(lines, "o_orderkey").select(F.col("o_orderkey").alias("k"), F.to_json(F.struct(
        F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), entry.alias("lines"))).alias("value"))
    found = schema.with_schema_errors(docs, _ORDER_SCHEMA)
    return found.select("k", F.array_join(F.array_sort("errors"), "; ").alias("errors"))


_CELLS = [
    ("level_a_qwen7b_bf16_math500_seed0", 1.05, "abc1234", "cfg_bf16"),
    ("level_b_qwen7b_gptq4_math500_seed1", 1.05, "abc1234", "cfg_gptq4"),
    ("level_c_llama8b_bf16_math500_seed0", 1.05, "fff0000", "cfg_bf16"),
    ("level_c_llama8b_fp8_gsm8k_seed1", None, "unknown", "cfg_other"),
    ("level_c_qwen15b_awq4_gpqa_seed0", None, "def5678", "cfg_awq4"),
]
_GUARD = f"""cells as (select * from {V.values_sql(_CELLS)} t(cell_id, penalty, current_commit, expected_hash)),
  facts as (select s.cell_id, count(*) as rows, count(decoding_repetition_penalty) as with_penalty,
    list(distinct git_commit) filter (git_commit is not null) as commits, list(distinct config_hash) filter (config_hash is not null) as hashes
    from scored s group by 1)
  select f.cell_id, rows, case when c.cell_id is null then 'unknown_cell'
      when penalty is not null and with_penalty = 0 then 'missing_repetition_penalty'
      when len(commits) > 0 and current_commit <> 'unknown' and not list_contains(commits, current_commit) then 'git_commit_mismatch'
      when len(hashes) > 0 and not list_contains(hashes, expected_hash) then 'config_hash_mismatch' end as reason
  from facts f left join cells c using (cell_id)"""


@query("provenance_guard", V.SCORED_SQL + f", {_GUARD}")
def provenance_guard(spark, sf_dir):
    cells = V.small_table(spark, _CELLS, "cell_id string, expected_penalty double, current_commit string, expected_hash string")
    return gates.provenance_guard(V.scored(spark, sf_dir), cells).drop("blocked")


_TASK_CASE = "case task when 'math500' then 500 when 'gsm8k' then 1319 when 'gpqa_diamond' then 198 else 1 end"


@query("expected_rows", V.SCORED_SQL + f"""
  select run_cell as cell_id, any_value(task) as task, cast(any_value({_TASK_CASE}) as int) as expected from scored group by 1""")
def expected_rows(spark, sf_dir):
    cells = V.scored(spark, sf_dir).select(F.col("run_cell").alias("cell_id"), "task").distinct()
    return cells.select("cell_id", "task", identity.expected_rows(F.col("task")).alias("expected"))


@query("progress", V.SCORED_SQL + f""", done as (select run_cell as cell_id, any_value(task) as task, count(*) as rows_done from scored group by 1)
  select cell_id, task, rows_done, cast({_TASK_CASE} as int) as rows_total,
    case when rows_done >= {_TASK_CASE} then 'completed' else 'in_progress' end as status from done""")
def progress(spark, sf_dir):
    rows = V.scored(spark, sf_dir).drop("cell_id").withColumnRenamed("run_cell", "cell_id")
    return gates.progress(rows, rows.select("cell_id", "task").distinct())


def _status(spark, sf_dir):
    """Every second run has a summary, every third a scored table; runs divisible by 7 hold no rows."""
    rows = V.scored(spark, sf_dir).drop("cell_id").withColumnRenamed("run_cell", "cell_id")
    cells = rows.select("cell_id", "task", "run_no").distinct()
    counts = rows.filter(F.col("run_no") % 7 != 0).groupBy("cell_id").agg(F.count(F.lit(1)).alias("rows_saved"))
    metadata = cells.select("cell_id", "task", F.when(F.col("run_no") % 14 == 0, "queued").alias("status"))
    return gates.cell_status(
        metadata, counts, cells.filter(F.col("run_no") % 2 == 0), cells.filter(F.col("run_no") % 3 == 0))


_STATUS = f"""cells as (select run_cell as cell_id, any_value(task) as task, any_value(run_no) as r, count(*) as n from scored group by 1),
  saved as (select *, case when r % 7 = 0 then 0 else n end as rows_saved, cast({_TASK_CASE} as int) as rows_total from cells),
  status as (select *, case when rows_saved >= rows_total and r % 2 = 0 and r % 3 = 0 then 'scored'
      when rows_saved >= rows_total and r % 2 = 0 then 'completed' when rows_saved > 0 then 'in_progress'
      when r % 14 = 0 then 'queued' else 'pending' end as status from saved)"""


@query("cell_status", V.SCORED_SQL + f""", {_STATUS}
  select cell_id, rows_saved, rows_total, r % 2 = 0 as has_summary, r % 3 = 0 as has_scored, status from status""")
def cell_status(spark, sf_dir):
    return _status(spark, sf_dir).select("cell_id", "rows_saved", "rows_total", "has_summary", "has_scored", "status")


@query("latest_cell", V.SCORED_SQL + f""", {_STATUS}
  select cell_id as last_cell_id, status as last_phase, rows_saved as rows_done, rows_total from status
  order by rows_saved desc, cell_id desc limit 1""")
def latest_cell(spark, sf_dir):
    return gates.latest_cell(_status(spark, sf_dir))


@query("matrix_check", V.SCORED_SQL + """,
  wired as (select distinct run_cell as cell_id from scored where run_cell not like 'smoke\\_%' escape '\\' and run_no < 30),
  expected as (select distinct run_cell as cell_id from scored where run_no >= 10 and run_cell not like 'smoke%'),
  repro as (select distinct run_cell as cell_id from scored where run_no < 3)
  select cell_id, 'missing' as finding from expected where cell_id not in (select cell_id from wired)
  union all select cell_id, 'extra' from wired where cell_id not in (select cell_id from expected) and cell_id not in (select cell_id from repro)""")
def matrix_check(spark, sf_dir):
    cells = V.scored(spark, sf_dir).select(F.col("run_cell").alias("cell_id"), "run_no").distinct()
    expected = cells.filter((F.col("run_no") >= 10) & ~F.col("cell_id").startswith("smoke"))
    return gates.matrix_check(expected, cells.filter("run_no < 30"), cells.filter("run_no < 3"))


@query("harness_delta", V.SCORED_SQL + f""", {runs_sql()}, hit as (
    select n_nationkey, case when n_regionkey = 0 then null else n_regionkey / 10e0 end as v from nation
    where contains(lower(n_name), 'nation_1') order by n_nationkey limit 1)
  select cell_id, round(pass_at_1, 6) as harness_pass_at_1, round(v, 6) as lmeval_accuracy, round(pass_at_1 - v, 6) as delta from runs, hit""")
def harness_delta(spark, sf_dir):
    results = V.table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("pos"), F.col("n_name").alias("key"),
        F.create_map(F.lit("acc,none"), F.col("n_regionkey") / 10.0).alias("metrics"))
    return V.rounded(gates.harness_delta(results, run_summaries(spark, sf_dir), "nation_1"))
