"""Summary, cost, seed, frontier and report-table queries."""

from functools import reduce
from operator import and_

from pyspark.sql import functions as F

from evalweave.functions import identity
from evalweave.functions.scoring import is_true
from evalweave.operators import comparison, frontier, incremental, quantiles, summary
from evalweave.plans import reports
from evalweave.plans.shared import cut, scratch_path
from evalweave.registry import views as V
from evalweave.registry.catalog import query
from evalweave.registry.text_queries import _FLAGS

_PASS = "avg(cast(coalesce(correct, false) as int))"
_HITS = "count_if(coalesce(correct, false))"
_TRACE = """coalesce(avg(nullif(completion_tokens, 0)), avg(completion_tokens))"""
_COST = f"""sum(coalesce(latency_sec, 0)) as total_gpu_seconds,
    sum(coalesce(latency_sec, 0)) / nullif({_HITS}, 0) as cost_per_correct_seconds,
    avg(coalesce(latency_sec, 0)) / nullif({_PASS}, 0) as cost_of_pass_seconds"""


def runs_sql(group: str = "run_cell") -> str:
    """Summaries at the grain of run cells, unrounded."""
    return f"""flagged as (select *, {_FLAGS} from scored),
  runs as (select {group} as cell_id, any_value(cell_id) as family, any_value(run_no) as run_no,
    any_value(model_path) as model_path, any_value(task) as task, any_value(quant_config) as quant_config,
    any_value(seed) as seed, count(*) as n, {_PASS} as pass_at_1, {_HITS} as num_correct,
    avg(latency_sec) as latency_sec_mean, max(peak_vram_gb) as peak_vram_gb_max, avg(peak_vram_gb) as peak_vram_gb_mean,
    avg(prompt_tokens) as prompt_tokens_mean, avg(reasoning_steps) as reasoning_steps_mean, {_TRACE} as completion_tokens_mean,
    avg(cast(parse_failure as int)) as parse_failure_rate, avg(cast(empty_completion as int)) as empty_completion_rate,
    avg(cast(truncated_row as int)) as truncation_rate, avg(cast(invalid_answer as int)) as invalid_answer_rate,
    count_if(parse_failure) as num_parse_failures, count_if(empty_completion) as num_empty_completions,
    count_if(truncated_row) as num_truncated, count_if(invalid_answer) as num_invalid_answers, {_COST}
    from flagged group by {group})"""


def run_summaries(spark, sf_dir, medians=False):
    """One summary per run cell, with its identity columns."""
    df = V.scored(spark, sf_dir).withColumnRenamed("cell_id", "family").withColumnRenamed("run_cell", "cell_id")
    names = df.groupBy("cell_id").agg(*[
        F.first(c).alias(c) for c in ("family", "run_no", "model_path", "task", "quant_config", "seed")
    ])
    return summary.merge_groups([summary.cell_summary(df, medians=medians), names], ["cell_id"])


_SUMMARY_COLS = """n, round(pass_at_1, 6) as pass_at_1, num_correct, round(latency_sec_mean, 6) as latency_sec_mean,
  round(peak_vram_gb_max, 6) as peak_vram_gb_max, round(peak_vram_gb_mean, 6) as peak_vram_gb_mean,
  round(prompt_tokens_mean, 6) as prompt_tokens_mean, round(reasoning_steps_mean, 6) as reasoning_steps_mean,
  round(completion_tokens_mean, 6) as completion_tokens_mean,
  round(parse_failure_rate, 6) as parse_failure_rate, round(empty_completion_rate, 6) as empty_completion_rate,
  round(truncation_rate, 6) as truncation_rate, round(invalid_answer_rate, 6) as invalid_answer_rate,
  num_parse_failures, num_empty_completions, num_truncated, num_invalid_answers,
  round(total_gpu_seconds, 6) as total_gpu_seconds, round(cost_per_correct_seconds, 6) as cost_per_correct_seconds,
  round(cost_of_pass_seconds, 6) as cost_of_pass_seconds"""


@query("cell_summary", V.SCORED_SQL + f""", {runs_sql('cell_id')},
  mids as (select cell_id, median(latency_sec) as latency_sec_p50, median(completion_tokens) as completion_tokens_p50,
    median(time_to_first_token_sec) as ttft, median(tokens_per_second) as tps, median(power_watts_max) as power,
    max(power_watts_max) as power_max, avg(power_watts_max) as power_mean, sum(energy_joules) as energy_total,
    avg(energy_joules) as energy_mean, avg(time_to_first_token_sec) as ttft_mean from scored group by cell_id),
  reasons as (select cell_id, string_agg(finish_reason || '=' || m, ',' order by finish_reason) as finish_reasons
    from (select cell_id, finish_reason, count(*) as m from scored where finish_reason is not null group by 1, 2) group by 1)
  select cell_id, {_SUMMARY_COLS}, round(latency_sec_p50, 6) as latency_sec_p50, round(completion_tokens_p50, 6) as completion_tokens_p50,
    round(ttft, 6) as time_to_first_token_sec_p50, round(ttft_mean, 6) as time_to_first_token_sec_mean,
    round(tps, 6) as tokens_per_second_p50, round(power, 6) as power_watts_max_p50, round(power_max, 6) as power_watts_max_max,
    round(power_mean, 6) as power_watts_max_mean, round(energy_total, 6) as energy_joules_total,
    round(energy_mean, 6) as energy_joules_mean, finish_reasons
  from runs join mids using (cell_id) join reasons using (cell_id)""")
def cell_summary(spark, sf_dir):
    # Several steps read the rows, as they would read a stored scored table.
    read = """cell_id latency_sec peak_vram_gb time_to_first_token_sec tokens_per_second power_watts_max energy_joules prompt_tokens
        completion_tokens reasoning_steps finish_reason truncated decoding_max_tokens max_tokens completion pred_answer correct""".split()
    df = summary.cell_summary(cut(V.scored(spark, sf_dir).select(*read)))
    reasons = F.array_join(
        F.transform(F.map_entries("finish_reason_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","
    )
    names = """cell_id n pass_at_1 num_correct latency_sec_mean peak_vram_gb_max peak_vram_gb_mean prompt_tokens_mean
        reasoning_steps_mean completion_tokens_mean parse_failure_rate empty_completion_rate truncation_rate
        invalid_answer_rate num_parse_failures num_empty_completions num_truncated num_invalid_answers
        cost_per_correct_seconds cost_of_pass_seconds latency_sec_p50 completion_tokens_p50
        time_to_first_token_sec_p50 time_to_first_token_sec_mean tokens_per_second_p50 power_watts_max_p50
        power_watts_max_max power_watts_max_mean energy_joules_mean""".split()
    return V.rounded(df.select(*names, "total_gpu_seconds", "energy_joules_total", reasons.alias("finish_reasons")))


@query("failure_rates", V.SCORED_SQL + f""", {runs_sql()}
  select cell_id, n, round(parse_failure_rate, 6) as parse_failure_rate, round(empty_completion_rate, 6) as empty_completion_rate,
    round(truncation_rate, 6) as truncation_rate, round(invalid_answer_rate, 6) as invalid_answer_rate,
    num_parse_failures, num_empty_completions, num_truncated, num_invalid_answers from runs""")
def failure_rates(spark, sf_dir):
    df = V.scored(spark, sf_dir)
    return V.rounded(df.groupBy(F.col("run_cell").alias("cell_id")).agg(
        F.count(F.lit(1)).alias("n"), *summary.failure_columns(df)))


@query("finish_reason_counts", V.SCORED_SQL + """
  select cell_id, finish_reason, count(*) as rows from scored where finish_reason is not null group by 1, 2""")
def finish_reason_counts(spark, sf_dir):
    return summary.finish_reason_counts(V.scored(spark, sf_dir))


@query("numeric_field_summary", V.SCORED_SQL + """
  select cell_id, round(avg(tokens_per_second), 6) as tokens_per_second_mean, round(median(tokens_per_second), 6) as tokens_per_second_p50,
    round(avg(power_watts_max), 6) as power_watts_max_mean, round(max(power_watts_max), 6) as power_watts_max_max,
    round(median(power_watts_max), 6) as power_watts_max_p50 from scored group by cell_id""")
def numeric_field_summary(spark, sf_dir):
    return V.rounded(summary.numeric_summary(
        V.scored(spark, sf_dir), {"tokens_per_second": False, "power_watts_max": True}))


@query("trace_summary", V.SCORED_SQL + f"""
  select run_cell, round(avg(reasoning_steps), 6) as reasoning_steps_mean, round({_TRACE}, 6) as completion_tokens_mean
  from scored group by run_cell""")
def trace_summary(spark, sf_dir):
    df = summary.with_summary_columns(V.scored(spark, sf_dir))
    return V.rounded(df.groupBy("run_cell").agg(*summary.trace_columns()))


@query("cost_metrics", V.SCORED_SQL + f""", {runs_sql()}
  select cell_id, num_correct, round(total_gpu_seconds, 6) as total_gpu_seconds, round(cost_per_correct_seconds, 6) as cost_per_correct_seconds,
    round(cost_of_pass_seconds, 6) as cost_of_pass_seconds,
    round(total_gpu_seconds * (2.5e0 / 3600) / nullif(num_correct, 0), 6) as cost_per_correct_usd from runs""")
def cost_metrics(spark, sf_dir):
    df = V.scored(spark, sf_dir).groupBy(F.col("run_cell").alias("cell_id")).agg(
        F.count_if(F.coalesce("correct", F.lit(False))).alias("num_correct"), *summary.cost_columns())
    return V.rounded(summary.cost_from_totals(df, 2.5))


@query("percentiles", V.SCORED_SQL + """
  select cell_id, field, p as prob, cast(n as bigint) as n, round(v, 6) as value from (
    select cell_id, 'latency_sec' as field, unnest([0.0, 0.025, 0.5, 0.95, 1.0]) as p, count(latency_sec) as n,
      unnest(quantile_cont(latency_sec, [0.0, 0.025, 0.5, 0.95, 1.0])) as v from scored group by 1
    union all
    select cell_id, 'completion_tokens', unnest([0.0, 0.025, 0.5, 0.95, 1.0]), count(completion_tokens),
      unnest(quantile_cont(cast(completion_tokens as double), [0.0, 0.025, 0.5, 0.95, 1.0])) from scored group by 1)""")
def percentiles(spark, sf_dir):
    rows = cut(V.scored(spark, sf_dir).select("cell_id", "latency_sec", "completion_tokens"))
    return V.rounded(quantiles.exact_percentiles(
        rows, ["latency_sec", "completion_tokens"], [0.0, 0.025, 0.5, 0.95, 1.0]))


@query("profile_summary", V.SCORED_SQL + """, ranked as (
    select *, row_number() over (partition by cell_id order by latency_sec) as k,
      count(latency_sec) over (partition by cell_id) as m from scored where latency_sec is not null)
  select s.cell_id, round(avg(s.latency_sec), 6) as latency_sec_mean, round(max(s.peak_vram_gb), 6) as peak_vram_gb_max,
    round(avg(s.peak_vram_gb), 6) as peak_vram_gb_mean, round(any_value(r.latency_sec), 6) as latency_sec_p50
  from scored s join ranked r on r.cell_id = s.cell_id and r.k = r.m // 2 + 1 group by 1""")
def profile_summary(spark, sf_dir):
    return V.rounded(summary.profile_summary(V.scored(spark, sf_dir)))


@query("tail_latency", V.SCORED_SQL + """
  select cell_id, round(quantile_cont(latency_sec, 0.5), 6) as latency_sec_p50, round(quantile_cont(latency_sec, 0.95), 6) as latency_sec_p95,
    round(quantile_cont(latency_sec, 0.99), 6) as latency_sec_p99, round(sum(completion_tokens) / sum(latency_sec), 6) as tokens_per_second
  from scored group by cell_id""")
def tail_latency(spark, sf_dir):
    return V.rounded(summary.tail_latency(V.scored(spark, sf_dir)))


@query("seed_variance", V.SCORED_SQL + f""", {runs_sql()}
  select family, 'pass_at_1' as metric, count(pass_at_1) as n_seeds, round(avg(pass_at_1), 6) as mean,
    round(coalesce(stddev_samp(pass_at_1), 0), 6) as std,
    printf('%.2f±%.2f', avg(pass_at_1), coalesce(stddev_samp(pass_at_1), 0)) as formatted,
    string_agg(cell_id, ',' order by cell_id) as members from runs group by family""")
def seed_variance(spark, sf_dir):
    df = comparison.seed_variance(run_summaries(spark, sf_dir), digits=2)
    return V.rounded(df.withColumn("members", F.array_join("summaries", ",")).drop("summaries"))


_FRONTIER = """pts as (select * from runs where cost_per_correct_seconds is not null),
  front as (select *, row_number() over w as place,
    min(cost_per_correct_seconds) over (w rows between unbounded preceding and 1 preceding) as best from pts
    window w as (partition by family order by pass_at_1 desc, cost_per_correct_seconds, cell_id)),
  marked as (select *, best is null or cost_per_correct_seconds < best as on_front from front)"""


@query("pareto_frontier", V.SCORED_SQL + f""", {runs_sql()}, {_FRONTIER}
  select family, cell_id, quant_config, round(pass_at_1, 6) as pass_at_1, round(cost_per_correct_seconds, 6) as cost_per_correct_seconds,
    round(latency_sec_mean, 6) as latency_sec_mean, round(peak_vram_gb_max, 6) as peak_vram_gb_max, on_front as on_pareto_frontier from marked""")
def pareto_frontier(spark, sf_dir):
    return V.rounded(frontier.frontier_points(run_summaries(spark, sf_dir), family_cols=["family"]))


@query("pareto_frontier_family_filter", V.SCORED_SQL + f""", {runs_sql()},
  fam as (select * from runs where contains(lower(cell_id || ' ' || model_path), 'qwen')),
  pts as (select * from fam where cost_per_correct_seconds is not null)
  select a.cell_id, a.quant_config, round(a.pass_at_1, 6) as pass_at_1, round(a.cost_per_correct_seconds, 6) as cost_per_correct_seconds,
    round(a.latency_sec_mean, 6) as latency_sec_mean, round(a.peak_vram_gb_max, 6) as peak_vram_gb_max,
    not exists (select 1 from pts b where b.cell_id <> a.cell_id and
      ((b.pass_at_1 > a.pass_at_1 and b.cost_per_correct_seconds <= a.cost_per_correct_seconds) or
       (b.pass_at_1 = a.pass_at_1 and (b.cost_per_correct_seconds < a.cost_per_correct_seconds or
         (b.cost_per_correct_seconds = a.cost_per_correct_seconds and b.cell_id < a.cell_id))))) as on_pareto_frontier
  from pts a""")
def pareto_frontier_family_filter(spark, sf_dir):
    return V.rounded(frontier.frontier_points(frontier.in_family(run_summaries(spark, sf_dir), "QWEN")))


@query("frontier_overview", V.SCORED_SQL + f""", {runs_sql()}, {_FRONTIER}
  select family, count(*) as n_points, count_if(on_front) as n_frontier,
    string_agg(cell_id, ',' order by pass_at_1 desc, cell_id) filter (on_front) as frontier_cells from marked group by family""")
def frontier_overview(spark, sf_dir):
    df = frontier.frontier_overview(run_summaries(spark, sf_dir), family_cols=["family"])
    return df.withColumn("frontier_cells", F.array_join("frontier_cell_ids", ",")).drop("frontier_cell_ids")


@query("frontier_report", V.SCORED_SQL + f""", {runs_sql()}, {_FRONTIER}
  select family, cell_id, quant_config, round_even(pass_at_1, 4) as pass_at_1, round_even(cost_per_correct_seconds, 2) as cost_per_correct_seconds,
    round_even(latency_sec_mean, 2) as latency_sec_mean, round(peak_vram_gb_max, 6) as peak_vram_gb_max, on_front as on_pareto_frontier from marked""")
def frontier_report(spark, sf_dir):
    """The frontier table as it is printed."""
    return V.rounded(frontier.frontier_report(run_summaries(spark, sf_dir), family_cols=["family"]))


_MODELS = [(c, m) for c, m in (
    ("level_a_qwen7b_bf16_math500_seed0", "deepseek-ai/DeepSeek-R1-Distill-Qwen-7B"),
    ("level_c_llama8b_bf16_math500_seed0", "deepseek-ai/DeepSeek-R1-Distill-Llama-8B"),
    ("smoke_other_fp8_math500_seed1", "example/Qwen-1.5B"),
)]
_FAMILY_SQL = """case when contains(names, 'qwen15b') or contains(names, 'qwen-1.5b') then 'Qwen-1.5B'
    when contains(names, 'qwen7b') or contains(names, 'qwen-7b') then 'Qwen-7B'
    when contains(names, 'llama8b') or contains(names, 'llama-8b') then 'Llama-8B' else 'unknown' end"""
_WITH_META = f"""meta as (select * from {V.values_sql(_MODELS)} t(cell_id, model_id)),
  named as (select r.*, model_id, lower(concat_ws(' ', r.cell_id, r.model_path, model_id)) as names from runs r left join meta using (cell_id)),
  tabled as (select *, {_FAMILY_SQL} as model_family from named)"""


def _tables(spark, sf_dir, intervals=True):
    meta = V.small_table(spark, _MODELS, "cell_id string, model_id string")
    df = cut(V.scored(spark, sf_dir))
    names = df.groupBy("cell_id").agg(*[F.first(c).alias(c) for c in ("model_path", "task", "quant_config", "seed")])
    hit, cost = is_true(F.col("correct")).cast("int"), F.coalesce("latency_sec", F.lit(0.0))
    ratio = F.sum(cost) / F.sum(hit)
    spread = F.var_pop(cost) + ratio * ratio * F.var_pop(hit) - 2 * ratio * F.covar_pop(cost, hit)  # of cost - ratio * hit
    errors = df.groupBy("cell_id").agg(
        (F.stddev_pop(hit) / F.sqrt(F.count(F.lit(1)))).alias("std_error"),
        (F.sqrt(spread * F.count(F.lit(1))) / F.sum(hit)).alias("cost_std_error"))
    made = reports.summary_with_intervals(df) if intervals else summary.cell_summary(df, medians=False)
    rows = summary.merge_groups([made, names], ["cell_id"])
    return reports.report_tables(rows, meta), errors


@query("report_table_main", V.SCORED_SQL + f""", {runs_sql('cell_id')}, {_WITH_META}
  select cell_id, task, model_family, model_id, quant_config, seed, n, round(pass_at_1, 6) as pass_at_1,
    round(sqrt(pass_at_1 * (1 - pass_at_1) / n), 6) as std_error, true as interval_near_normal, num_correct from tabled""")
def report_table_main(spark, sf_dir):
    tables, errors = _tables(spark, sf_dir)
    ends = ["pass_at_1_ci95_low", "pass_at_1_ci95_high"]
    out = summary.merge_groups([tables["main"], errors.drop("cost_std_error")], ["cell_id"])
    return V.rounded(out.withColumn("interval_near_normal", V.near_normal(F.col("pass_at_1"), F.col("std_error"), *ends)).drop(*ends))


@query("report_table_efficiency", V.SCORED_SQL + f""", {runs_sql('cell_id')}, {_WITH_META}
  select cell_id, task, model_family, quant_config, round(latency_sec_mean, 6) as latency_sec_mean,
    round(peak_vram_gb_max, 6) as peak_vram_gb_max, round(peak_vram_gb_mean, 6) as peak_vram_gb_mean,
    round(prompt_tokens_mean, 6) as prompt_tokens_mean, round(completion_tokens_mean, 6) as completion_tokens_mean,
    round(reasoning_steps_mean, 6) as reasoning_steps_mean, round(total_gpu_seconds, 6) as total_gpu_seconds,
    round(cost_per_correct_seconds, 6) as cost_per_correct_seconds, round(cost_of_pass_seconds, 6) as cost_of_pass_seconds,
    round(latency_sec_p50, 6) as latency_sec_p50, round(completion_tokens_p50, 6) as completion_tokens_p50,
    round(cost_std_error, 6) as cost_std_error, true as interval_near_normal
  from tabled join (select cell_id, median(latency_sec) as latency_sec_p50, median(completion_tokens) as completion_tokens_p50
    from scored group by cell_id) using (cell_id)
  join (select cell_id, sqrt(var_pop(c) + power(sum(c) / sum(h), 2) * var_pop(h) - 2 * (sum(c) / sum(h)) * covar_pop(c, h)) * sqrt(count(*)) / sum(h)
      as cost_std_error from (select cell_id, coalesce(latency_sec, 0) as c, cast(coalesce(correct, false) as int) as h from scored)
    group by cell_id) using (cell_id)""")
def report_table_efficiency(spark, sf_dir):
    tables, errors = _tables(spark, sf_dir)
    ends = ["cost_per_correct_seconds_ci95_low", "cost_per_correct_seconds_ci95_high"]
    out = summary.merge_groups([tables["efficiency"], errors.drop("std_error")], ["cell_id"])
    near = V.near_normal(F.col("cost_per_correct_seconds"), F.col("cost_std_error"), *ends)
    return V.rounded(out.withColumn("interval_near_normal", near).drop(*ends))


@query("report_table_failures", V.SCORED_SQL + f""", {runs_sql('cell_id')}, {_WITH_META}
  select cell_id, task, model_family, quant_config, n, round(parse_failure_rate, 6) as parse_failure_rate,
    round(empty_completion_rate, 6) as empty_completion_rate, round(truncation_rate, 6) as truncation_rate,
    round(invalid_answer_rate, 6) as invalid_answer_rate, num_parse_failures, num_empty_completions, num_truncated, num_invalid_answers from tabled""")
def report_table_failures(spark, sf_dir):
    return V.rounded(_tables(spark, sf_dir, intervals=False)[0]["failures"])


@query("leaderboard", V.SCORED_SQL + f""", {runs_sql()}
  select cell_id, quant_config, task, round(pass_at_1, 6) as pass_at_1, round(truncation_rate, 6) as truncation_rate,
    round(cost_of_pass_seconds, 6) as cost_of_pass from runs""")
def leaderboard(spark, sf_dir):
    return V.rounded(reports.leaderboard(run_summaries(spark, sf_dir)))


@query("model_family", V.SCORED_SQL + f""", {runs_sql()}, named as (select *, lower(concat_ws(' ', cell_id, model_path)) as names from runs)
  select cell_id, {_FAMILY_SQL} as model_family from named""")
def model_family(spark, sf_dir):
    cells = V.scored(spark, sf_dir).select(F.col("run_cell").alias("cell_id"), "model_path").distinct()
    return cells.select("cell_id", identity.model_family(F.col("cell_id"), F.col("model_path")).alias("model_family"))


@query("per_language_breakdown", """
  select lang as cell_id, count(*) as n, round(avg(l.quality), 6) as pass_at_1, cast(sum(l.quality) as bigint) as num_correct
  from documents d join labels l using (doc_id) group by lang""")
def per_language_breakdown(spark, sf_dir):
    rows = V.table(spark, sf_dir, "documents").select("doc_id", "lang").join(V.table(spark, sf_dir, "labels"), "doc_id")
    rows = rows.select("lang", (F.col("quality") == 1).alias("correct"))
    return V.rounded(rows.groupBy(F.col("lang").alias("cell_id")).agg(*summary.accuracy_columns()))


@query("cost_of_pass_ratio", V.SCORED_SQL + f""", {runs_sql()}
  select cell_id, round(cost_of_pass_seconds / (select cost_of_pass_seconds from runs where cell_id = '{V.BASELINE_CELL}_r0'), 6) as cost_of_pass_ratio from runs""")
def cost_of_pass_ratio(spark, sf_dir):
    return V.rounded(comparison.cost_of_pass_ratio(run_summaries(spark, sf_dir), f"{V.BASELINE_CELL}_r0"))


@query("seed_rank_reversal", V.SCORED_SQL + f""", {runs_sql()},
  signs as (select a.family as config_a, b.family as config_b, a.run_no, sign(a.pass_at_1 - b.pass_at_1) as s
    from runs a join runs b on a.run_no = b.run_no and a.family < b.family),
  pairs as (select x.config_a, x.config_b, count_if(x.s * y.s < 0) as flips, count(*) as m
    from signs x join signs y on x.config_a = y.config_a and x.config_b = y.config_b and x.run_no < y.run_no group by 1, 2)
  select config_a, config_b, round(flips / cast(m as double), 6) as reversal_rate from pairs""")
def seed_rank_reversal(spark, sf_dir):
    df = comparison.rank_reversal_rate(run_summaries(spark, sf_dir), seed_col="run_no")
    return V.rounded(df.select("config_a", "config_b", "reversal_rate"))


@query("incremental_summary", V.SCORED_SQL + """
  select cell_id, count(*) as n, count_if(coalesce(correct, false)) as num_correct, round(avg(latency_sec), 6) as latency_sec_mean,
    round(min(latency_sec), 6) as latency_sec_min, round(max(completion_tokens), 6) as completion_tokens_max,
    round(avg(completion_tokens), 6) as completion_tokens_mean, true as within_rank_error from scored group by cell_id""")
def incremental_summary(spark, sf_dir):
    """Rows arrive in four loads, one of them twice; the summary merges stored states and reads no row again.  A
    quantile is judged by the share of rows below it."""
    rows = cut(V.scored(spark, sf_dir).select(
        "cell_id", "sd", "correct", "latency_sec", F.col("completion_tokens").cast("double").alias("completion_tokens"), "run_no"))
    fields, path = ["latency_sec", "completion_tokens"], scratch_path(spark, "states")
    for load in (0, 1, 1, 2, 3):
        incremental.add(rows.where(F.col("run_no") % 4 == load).withColumn("day", F.col("sd")), path, ("load", load), fields=fields)
    found = cut(incremental.summary(incremental.stored(spark, path), fields=fields))
    bound, probs = incremental.rank_error(), {"p50": 0.5, "p95": 0.95}
    below = lambda f, q: F.count_if(F.col(f) < F.col(f"{f}_{q}")) / F.count(f)
    upto = lambda f, q: F.count_if(F.col(f) <= F.col(f"{f}_{q}")) / F.count(f)
    fits = [(below(f, q) <= p + bound) & (upto(f, q) >= p - bound) for f in fields for q, p in probs.items()]
    within = rows.select("cell_id", *fields).join(found, "cell_id").groupBy("cell_id").agg(reduce(and_, fits).alias("within_rank_error"))
    return V.rounded(found.join(within, "cell_id").select(
        "cell_id", "n", "num_correct", "latency_sec_mean", "latency_sec_min", "completion_tokens_max", "completion_tokens_mean", "within_rank_error"))
