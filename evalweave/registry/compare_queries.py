"""Paired comparison, multiple-testing and bootstrap queries."""

import re

from pyspark.sql import functions as F

from evalweave.functions.scoring import is_true
from evalweave.functions.stats import ERFC_COEFFICIENTS, erfc_expression
from evalweave.operators import bootstrap, comparison, incremental, sampling
from evalweave.plans import reports
from evalweave.plans.shared import cut, scratch_path
from evalweave.registry import views as V
from evalweave.registry.catalog import query
from evalweave.registry.metric_queries import _AVAILABLE, _BUNDLE, _BUNDLE_FROM
from evalweave.registry.summary_queries import _SUMMARY_COLS, run_summaries, runs_sql

SUMMARY_NAMES = re.findall(r"(\w+)(?=,|$)", re.sub(r"round\(\w+, 6\) as ", "", _SUMMARY_COLS))
CALIBRATION_NAMES = ["brier", "ece", "nll", "auroc", "aurc", "adaptive_ece"]
_GATED = ", ".join(f"case when reason is null then round({m}, 6) end as {m}" for m in CALIBRATION_NAMES)


def _erfc_sql(x: str) -> str:
    t = f"(1.0e0 / (1.0e0 + 0.5e0 * {x}))"
    poly = f"{ERFC_COEFFICIENTS[-1]}e0"
    for c in reversed(ERFC_COEFFICIENTS[:-1]):
        poly = f"({c}e0 + {t} * {poly})"
    return f"({t} * exp(-({x}) * ({x}) + {poly}))"


_ITEMS = V.SCORED_SQL + f""",
  items as (select cell_id, id, coalesce(correct, false) as ok from scored
    qualify row_number() over (partition by cell_id, id order by sample_index desc) = 1),
  pairs as (select v.cell_id, v.id, b.ok as base, v.ok as var from items v join items b on b.id = v.id
    and b.cell_id = '{V.BASELINE_CELL}' and v.cell_id <> b.cell_id)"""
_COUNTS = f"""counts as (select cell_id, count(*) as n_items, avg(cast(base as int)) as bp, avg(cast(var as int)) as vp,
    count_if(base and not var) as b, count_if(var and not base) as c from pairs group by cell_id),
  stats as (select *, case when b + c = 0 then 0 else (abs(b - c) - 1) * (abs(b - c) - 1) / cast(b + c as double) end as stat from counts),
  tested as (select *, case when b + c = 0 then 1 else {_erfc_sql('sqrt(stat / 2)')} end as p from stats),
  ranked as (select *, row_number() over (order by p, cell_id) as k, count(*) over () as m from tested),
  holm as (select *, max(least(1, (m - k + 1) * p)) over (order by k rows unbounded preceding) as p_holm from ranked)"""


@query("last_row_wins", _ITEMS + " select cell_id, id, ok as correct from items")
def last_row_wins(spark, sf_dir):
    return comparison.last_per_item(V.scored(spark, sf_dir))


@query("paired_items", _ITEMS + " select cell_id, id, base, var from pairs")
def paired_items(spark, sf_dir):
    return comparison.paired_items(V.scored(spark, sf_dir), V.BASELINE_CELL).select("cell_id", "id", "base", "var")


@query("mcnemar_holm", f"""{_ITEMS}, {_COUNTS}
  select cell_id, '{V.BASELINE_CELL}' as baseline, n_items, round(bp, 6) as baseline_pass_at_1, round(vp, 6) as variant_pass_at_1,
    b, c, b + c as n_discordant, round(stat, 6) as statistic, round(p, 4) as p_value,
    round(case when b + c = 0 then 0 else vp - bp end, 6) as effect_rate_diff, round(p_holm, 4) as p_value_holm from holm""")
def mcnemar_holm(spark, sf_dir):
    df = V.rounded(comparison.compare_with_baseline(V.scored(spark, sf_dir), V.BASELINE_CELL))
    return df.withColumns({c: F.round(c, 4) for c in ("p_value", "p_value_holm")})


@query("holm_adjustment", V.SCORED_SQL + f""", {runs_sql()},
  tests as (select family, cell_id, {_erfc_sql('abs(pass_at_1 - 0.45) * sqrt(n)')} as p from runs),
  ranked as (select *, row_number() over w as k, count(*) over (partition by family) as m from tests
    window w as (partition by family order by p, cell_id))
  select family, cell_id, round(p, 6) as p_value,
    round(max(least(1, (m - k + 1) * p)) over (partition by family order by k rows unbounded preceding), 6) as p_value_holm from ranked""")
def holm_adjustment(spark, sf_dir):
    tests = run_summaries(spark, sf_dir).select(
        "family", "cell_id", erfc_expression(F.abs(F.col("pass_at_1") - 0.45) * F.sqrt("n")).alias("p_value"))
    return V.rounded(comparison.holm_adjusted(tests, "p_value", ["family"], ["cell_id"]))


def _with_error(intervals, rows, std_error):
    """Resampled intervals beside the exact standard error, which SQL can derive, and their agreement with it."""
    errors = rows.groupBy("cell_id").agg(std_error.alias("std_error"))
    out = comparison.merge_groups([intervals, errors], ["cell_id"])
    near = V.near_normal(F.col("value"), F.col("std_error")).alias("interval_near_normal")
    return V.rounded(out.select(*[c for c in out.columns if c not in ("ci_low", "ci_high")], near))


def _mean_error(value):
    return F.stddev_pop(value) / F.sqrt(F.count(value))


@query("bootstrap_pass_rate", V.SCORED_SQL + """
  select cell_id, count(*) as n, round(avg(x), 6) as value, round(stddev_pop(x) / sqrt(count(x)), 6) as std_error, true as interval_near_normal
  from (select cell_id, cast(coalesce(correct, false) as int) as x from scored) group by cell_id""")
def bootstrap_pass_rate(spark, sf_dir):
    rows, hit = cut(V.scored(spark, sf_dir).select("cell_id", "correct")), is_true(F.col("correct")).cast("int")
    return _with_error(bootstrap.bootstrap_ci(rows, {"x": hit}), rows, _mean_error(hit))


@query("bootstrap_mean_latency", V.SCORED_SQL + """
  select cell_id, count(*) as n, round(avg(latency_sec), 6) as value, round(stddev_pop(latency_sec) / sqrt(count(*)), 6) as std_error,
    true as interval_near_normal from scored where latency_sec is not null group by cell_id""")
def bootstrap_mean_latency(spark, sf_dir):
    rows = cut(V.scored(spark, sf_dir).select("cell_id", "latency_sec").filter(F.col("latency_sec").isNotNull()))
    return _with_error(bootstrap.bootstrap_ci(rows, {"x": F.col("latency_sec")}), rows, _mean_error(F.col("latency_sec")))


@query("cluster_bootstrap", V.SCORED_SQL + """,
  clusters as (select cell_id, id, avg(cast(correct as int)) as m from scored where correct is not null and id is not null group by 1, 2)
  select cell_id, round(avg(m), 6) as value, count(*) as n_clusters, round(stddev_pop(m) / sqrt(count(*)), 6) as std_error,
    true as interval_near_normal from clusters group by cell_id""")
def cluster_bootstrap(spark, sf_dir):
    rows = cut(V.scored(spark, sf_dir).select("cell_id", "id", "correct"))
    clusters = rows.filter("correct is not null and id is not null").groupBy("cell_id", "id").agg(F.avg(F.col("correct").cast("int")).alias("m"))
    return _with_error(bootstrap.cluster_bootstrap_ci(rows), clusters, _mean_error(F.col("m")))


@query("cost_per_correct_bootstrap", V.SCORED_SQL + """,
  timed as (select cell_id, latency_sec as c, cast(coalesce(correct, false) as int) as h from scored where latency_sec is not null),
  ratios as (select cell_id, sum(c) / sum(h) as r, count(*) as n from timed group by cell_id having sum(h) > 0)
  select cell_id, any_value(n) as n, round(any_value(r), 6) as value, round(stddev_pop(c - r * h) * sqrt(count(*)) / sum(h), 6) as std_error,
    true as interval_near_normal from timed join ratios using (cell_id) group by cell_id""")
def cost_per_correct_bootstrap(spark, sf_dir):
    rows = cut(V.scored(spark, sf_dir).select("cell_id", "correct", "latency_sec"))
    timed = rows.filter("latency_sec is not null").select("cell_id", F.col("latency_sec").alias("c"), is_true(F.col("correct")).cast("int").alias("h"))
    ratio = F.sum("c") / F.sum("h")
    spread = F.var_pop("c") + ratio * ratio * F.var_pop("h") - 2 * ratio * F.covar_pop("c", "h")  # of c - ratio * h
    return _with_error(bootstrap.cost_per_correct_ci(rows), timed, F.sqrt(spread * F.count(F.lit(1))) / F.sum("h"))


@query("incremental_intervals", V.SCORED_SQL + """,
  timed as (select cell_id, latency_sec as c, cast(coalesce(correct, false) as int) as h from scored where latency_sec is not null),
  ratios as (select cell_id, sum(c) / sum(h) as r, count(*) as n from timed group by cell_id having sum(h) > 0)
  select cell_id, any_value(n) as n, round(any_value(r), 6) as value, round(stddev_pop(c - r * h) * sqrt(count(*)) / sum(h), 6) as std_error,
    true as interval_near_normal from timed join ratios using (cell_id) group by cell_id""")
def incremental_intervals(spark, sf_dir):
    """Cost per correct answer from stored Poisson replicates: rows arrive in two loads, then one part comes again."""
    rows = cut(V.scored(spark, sf_dir).select("cell_id", (F.col("run_no") % 4).alias("day"), "latency_sec", is_true(F.col("correct")).cast("int").alias("hit")))
    values, path = {"cost": F.col("latency_sec"), "hits": F.col("hit")}, scratch_path(spark, "replicates")
    for part in (F.col("day") < 2, F.col("day") >= 2, F.col("day") == 1):
        incremental.replace_parts(rows.where(part), path, values)
    found = incremental.interval(incremental.stored(spark, path), lambda: F.col("cost") / F.col("hits"), list(values))
    timed = rows.where("latency_sec is not null")
    ratio = F.sum("latency_sec") / F.sum("hit")
    spread = F.var_pop("latency_sec") + ratio * ratio * F.var_pop("hit") - 2 * ratio * F.covar_pop("latency_sec", "hit")
    return _with_error(found, timed, F.sqrt(spread * F.count(F.lit(1))) / F.sum("hit"))


def _quantile_sql(probs):
    return " union all ".join(f"select cell_id, {p}e0 as prob, count(latency_sec) as n, quantile_cont(latency_sec, {p}e0) as value from scored group by 1" for p in probs)


_PROBS = (0.25, 0.5, 0.95)


@query("bootstrap_quantiles", V.SCORED_SQL + f"""
  select cell_id, prob, n, round(value, 6) as value, round(sqrt(prob * (1 - prob) / n), 6) as rank_error, true as interval_near_normal
  from ({_quantile_sql(_PROBS)})""")
def bootstrap_quantiles(spark, sf_dir):
    """Median, lower quartile and tail latency.  An interval end is judged by the share of rows below it, whose
    standard error SQL knows for any distribution."""
    rows = cut(V.scored(spark, sf_dir).select("cell_id", "latency_sec").filter("latency_sec is not null"))
    found = cut(bootstrap.bootstrap_quantile_ci(rows, F.col("latency_sec"), _PROBS))
    below = lambda end: F.count_if(F.col("latency_sec") <= F.col(end)) / F.count(F.lit(1))
    ranks = rows.join(found, "cell_id").groupBy("cell_id", "prob").agg(below("ci_low").alias("low"), below("ci_high").alias("high"))
    error = F.sqrt(F.col("prob") * (1 - F.col("prob")) / F.col("n"))
    out = found.join(ranks, ["cell_id", "prob"]).withColumn("rank_error", error)
    near = V.near_normal(F.col("prob"), F.col("rank_error"), "low", "high").alias("interval_near_normal")
    return V.rounded(out.select("cell_id", "prob", "n", "value", "rank_error", near))


def _trimmed(levels, counts):
    """Mean of the middle nine tenths of a weighted sample."""
    import numpy as np
    upto = np.cumsum(counts)
    low, high = upto[-1] // 20, upto[-1] - upto[-1] // 20
    kept = np.clip(np.minimum(upto, high) - np.maximum(upto - counts, low), 0, None)
    return float((levels[:, 0] * kept).sum() / kept.sum())


@query("bootstrap_trimmed_mean", V.SCORED_SQL + """,
  placed as (select cell_id, reasoning_steps as x, row_number() over (partition by cell_id order by reasoning_steps) as k,
    count(*) over (partition by cell_id) as n from scored)
  select cell_id, any_value(n) as n, round(avg(x) filter (k > n // 20 and k <= n - n // 20), 6) as value, true as around from placed group by cell_id""")
def bootstrap_trimmed_mean(spark, sf_dir):
    """A statistic given as a function of levels and counts."""
    found = bootstrap.bootstrap_statistic_ci(V.scored(spark, sf_dir), {"x": F.col("reasoning_steps")}, _trimmed, n_resamples=400)
    around = F.col("value").between(F.col("ci_low"), F.col("ci_high")).alias("around")
    return V.rounded(found.select("cell_id", "n", "value", around))


# The point values that the intervals surround, with an oracle of their own.
@query("bootstrap_point_values", V.SCORED_SQL + """,
  clusters as (select cell_id, id, avg(cast(correct as int)) as m from scored where correct is not null group by 1, 2),
  cl as (select cell_id, avg(m) as cluster_mean, count(*) as n_clusters from clusters group by 1)
  select s.cell_id, count(*) as n, round(avg(cast(coalesce(correct, false) as int)), 6) as pass_rate,
    round(any_value(cluster_mean), 6) as cluster_mean, any_value(n_clusters) as n_clusters,
    round(sum(latency_sec) / count_if(correct and latency_sec is not null), 6) as cost_ratio, true as inside
  from scored s join cl using (cell_id) group by s.cell_id""")
def bootstrap_point_values(spark, sf_dir):
    df = cut(V.scored(spark, sf_dir).select("cell_id", "id", "correct", "latency_sec"))  # read by all three
    named = lambda d, v: d.select("cell_id", F.col("value").alias(v), F.col("value").between(F.col("ci_low"), F.col("ci_high")).alias(f"{v}_inside"),
                                  *[c for c in ("n", "n_clusters") if c in d.columns and v != "cost_ratio"])
    out = comparison.merge_groups([
        named(bootstrap.bootstrap_ci(df, {"x": is_true(F.col("correct")).cast("int")}), "pass_rate"),
        named(bootstrap.cluster_bootstrap_ci(df), "cluster_mean"),
        named(bootstrap.cost_per_correct_ci(df), "cost_ratio"),
    ], ["cell_id"])
    inside = F.col("pass_rate_inside") & F.col("cluster_mean_inside") & F.col("cost_ratio_inside")
    return V.rounded(out.select("cell_id", "n", "pass_rate", "cluster_mean", "n_clusters", "cost_ratio", inside.alias("inside")))


@query("paired_report", f"""{_ITEMS}, {_COUNTS},
  errors as (select cell_id, stddev_pop(cast(var as int)) / sqrt(count(*)) as std_error from pairs group by cell_id)
  select cell_id, n_items, round(bp, 6) as baseline_pass_at_1, round(vp, 6) as variant_pass_at_1, b, c, round(p, 4) as p_value,
    round(p_holm, 4) as p_value_holm, round(std_error, 6) as std_error, true as interval_near_normal from holm join errors using (cell_id)""")
def paired_report(spark, sf_dir):
    rows = cut(V.scored(spark, sf_dir).select("cell_id", "id", "sample_index", "correct"))
    errors = comparison.paired_items(rows, V.BASELINE_CELL).groupBy("cell_id").agg(_mean_error(F.col("var").cast("int")).alias("std_error"))
    out = comparison.merge_groups([comparison.paired_report(rows, V.BASELINE_CELL), errors], ["cell_id"])
    near = V.near_normal(F.col("variant_pass_at_1"), F.col("std_error")).alias("interval_near_normal")
    df = V.rounded(out.select("cell_id", "n_items", "baseline_pass_at_1", "variant_pass_at_1", "b", "c", "p_value", "p_value_holm", "std_error", near))
    return df.withColumns({c: F.round(c, 4) for c in ("p_value", "p_value_holm")})


@query("score_run_report", f"""{_BUNDLE}, {_AVAILABLE}, {runs_sql('cell_id')},
  errors as (select cell_id, stddev_pop(cast(coalesce(correct, false) as int)) / sqrt(count(*)) as std_error from scored group by cell_id)
  select r.cell_id, r.quant_config, r.seed, r.task, {_SUMMARY_COLS.replace('n, round', 'r.n, round', 1)}, d.n_pairs, d.reason is not null as skipped,
    {_GATED}, round(std_error, 6) as std_error, true as interval_near_normal
  from runs r join errors using (cell_id) join decided d using (cell_id) left join (select cell_id, brier, ece, nll, auroc, aurc, adaptive_ece from {_BUNDLE_FROM}) using (cell_id)""")
def score_run_report(spark, sf_dir):
    # A stored scored table, as every report reads it.
    scored = cut(V.scored(spark, sf_dir))
    errors = scored.groupBy("cell_id").agg(_mean_error(is_true(F.col("correct")).cast("int")).alias("std_error"))
    out = comparison.merge_groups([reports.score_run(scored), errors], ["cell_id"])
    near = V.near_normal(F.col("pass_at_1"), F.col("std_error"), "pass_at_1_ci95_low", "pass_at_1_ci95_high").alias("interval_near_normal")
    return V.rounded(out.select(
        "cell_id", "quant_config", "seed", "task", *SUMMARY_NAMES, "n_pairs", "skipped", *CALIBRATION_NAMES, "std_error", near))


_AUDIT = """keyed as (select *, not coalesce(correct, false) or not answer_parse_success as is_failure,
    md5(concat_ws('|', '7', id, cast(sample_index as varchar))) as k from scored),
  sizes as (select cell_id, count_if(is_failure) as f, count_if(not is_failure) as s from keyed group by 1),
  placed as (select *, row_number() over (partition by cell_id, is_failure order by k, id, sample_index) as place from keyed),
  quota as (select *, least(f, greatest(25, 50 - least(s, 25))) as take_f from sizes)"""


@query("audit_sample", V.SCORED_SQL + f""", {_AUDIT}
  select p.cell_id, id, sample_index, is_failure, task, completion, pred_answer, gold_answer, correct, answer_parse_success,
    cast(null as varchar) as reviewer_decision, cast(null as varchar) as adjudication_notes
  from placed p join quota q using (cell_id) where place <= case when is_failure then take_f else 50 - take_f end""")
def audit_sample(spark, sf_dir):
    return sampling.audit_sample(V.scored(spark, sf_dir), n=50, seed=7)
