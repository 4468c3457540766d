"""Calibration, selective-risk and voting queries."""

from pyspark.sql import functions as F

from evalweave.operators import calibration as C
from evalweave.operators import risk as R
from evalweave.operators import voting
from evalweave.plans.shared import cut
from evalweave.registry import views as V
from evalweave.registry.catalog import query
from evalweave.registry.text_queries import CONFIDENCE_SQL

G = ("cell_id",)
_PAIRS = V.SCORED_SQL + f""", {CONFIDENCE_SQL},
  pairs as (select cell_id, id, sample_index, confidence_value as c, cast(correct as int) as y
    from conf where correct is not null and confidence_value is not null)"""
_ASC = """asc_rank as (select *, row_number() over (partition by cell_id order by c, id, sample_index) as k,
    count(*) over (partition by cell_id) as n from pairs)"""
_DESC = """desc_rank as (select *, row_number() over w as k, count(*) over (partition by cell_id) as n,
    sum(y) over (w rows unbounded preceding) as hits from pairs
    window w as (partition by cell_id order by c desc, id, sample_index))"""
_POINTWISE = """pointwise as (select cell_id, count(*) as n, avg((c - y) * (c - y)) as brier,
    avg(-(y * ln(greatest(1e-12, least(1 - 1e-12, c))) + (1 - y) * ln(1 - greatest(1e-12, least(1 - 1e-12, c))))) as nll
    from pairs group by cell_id)"""
_ECE = """edges as (select i, i * 0.1e0 as lo, case when i = 9 then 1e0 else (i + 1) * 0.1e0 end as hi from range(10) t(i)),
  binned as (select p.cell_id, e.i, count(*) as m, avg(y) as acc, avg(c) as conf
    from pairs p join edges e on (c > lo or (i = 0 and c >= lo)) and c <= hi group by 1, 2),
  ece as (select b.cell_id, sum(m * abs(acc - conf)) / any_value(n) as ece
    from binned b join pointwise using (cell_id) group by b.cell_id)"""
_AUROC = """levels as (select cell_id, c, sum(y) as pos, count(*) - sum(y) as neg from pairs group by 1, 2),
  below as (select *, coalesce(sum(neg) over (partition by cell_id order by c rows between unbounded preceding and 1 preceding), 0) as neg_below from levels),
  auroc as (select cell_id, sum(pos * (neg_below + neg / 2e0)) / nullif(sum(pos) * sum(neg), 0) as auroc from below group by 1)"""
_AURC = """risks as (select cell_id, k, n, 1 - hits / cast(k as double) as risk from desc_rank),
  panels as (select *, lag(risk) over (partition by cell_id order by k) as before from risks),
  aurc as (select cell_id, coalesce(sum((risk + before) / 2 / n), 0) as aurc from panels group by 1)"""


def _adaptive(bins: int) -> str:
    return f"""chunks as (select cell_id, (k - 1) // greatest(1, n // {bins}) as chunk, abs(sum(y) - sum(c)) as gap,
        any_value(n) as n from asc_rank group by 1, 2),
      adaptive as (select cell_id, sum(gap) / any_value(n) as adaptive_ece from chunks group by 1)"""


def pairs(spark, sf_dir):
    return C.confidence_pairs(V.scored(spark, sf_dir))


@query("brier_nll", f"{_PAIRS}, {_POINTWISE} select cell_id, n, round(brier, 6) as brier, round(nll, 6) as nll from pointwise")
def brier_nll(spark, sf_dir):
    return V.rounded(C.pointwise_metrics(pairs(spark, sf_dir)).drop("ece"))


@query("expected_calibration_error", f"{_PAIRS}, {_POINTWISE}, {_ECE} select cell_id, round(ece, 6) as ece from ece")
def expected_calibration_error(spark, sf_dir):
    return V.rounded(C.pointwise_metrics(pairs(spark, sf_dir)).select("cell_id", "ece"))


@query("reliability_bins", f"""{_PAIRS},
  bins as (select i, i / 10e0 as lo, (i + 1) / 10e0 as hi from range(10) t(i)),
  groups as (select distinct cell_id from pairs),
  filled as (select p.cell_id, b.i, count(*) as m, avg(y) as acc, avg(c) as conf
    from pairs p join bins b on (c > lo or (i = 0 and c >= lo)) and c <= hi group by 1, 2)
  select g.cell_id, cast(b.i as int) as bin, round(lo, 6) as bin_lo, round(hi, 6) as bin_hi, coalesce(m, 0) as count,
    round(coalesce(acc, 0), 6) as accuracy, round(coalesce(conf, 0), 6) as confidence
  from groups g cross join bins b left join filled f on f.cell_id = g.cell_id and f.i = b.i""")
def reliability_bins(spark, sf_dir):
    return V.rounded(C.reliability_bins(pairs(spark, sf_dir)))


@query("adaptive_ece", f"{_PAIRS}, {_ASC}, {_adaptive(15)} select cell_id, round(adaptive_ece, 6) as adaptive_ece from adaptive")
def adaptive_ece(spark, sf_dir):
    return V.rounded(C.adaptive_ece(C.ascending(cut(pairs(spark, sf_dir)), G)))


@query("auroc", f"{_PAIRS}, {_AUROC} select cell_id, round(auroc, 6) as auroc from auroc")
def auroc(spark, sf_dir):
    return V.rounded(C.auroc(pairs(spark, sf_dir)))


_BUNDLE = f"""{_PAIRS}, {_ASC}, {_DESC}, {_POINTWISE}, {_ECE}, {_AUROC}, {_AURC}, {_adaptive(10)}"""
_BUNDLE_COLS = """round(brier, 6) as brier, round(ece, 6) as ece, round(nll, 6) as nll, round(auroc, 6) as auroc,
    round(aurc, 6) as aurc, round(adaptive_ece, 6) as adaptive_ece"""
_BUNDLE_FROM = "pointwise join ece using (cell_id) join auroc using (cell_id) join aurc using (cell_id) join adaptive using (cell_id)"


@query("calibration_bundle", f"{_BUNDLE} select cell_id, n, {_BUNDLE_COLS} from {_BUNDLE_FROM}")
def calibration_bundle(spark, sf_dir):
    return V.rounded(C.calibration_metrics(pairs(spark, sf_dir)))


_AVAILABLE = """gate as (select cell_id, count_if(correct is not null and confidence_value is not null) as n_pairs,
    count_if(correct is not null and confidence_value is not null and is_valid) as n_valid,
    array_to_string(list_sort(list(distinct resolved_source) filter (correct is not null and confidence_value is not null)), ',') as sources
    from conf group by cell_id),
  decided as (select *, case when n_pairs = 0 then 'no_confidence_values' when n_pairs = n_valid then null
    else 'no_valid_confidence_source' end as reason from gate)"""


@query("calibration_availability", f"""{V.SCORED_SQL}, {CONFIDENCE_SQL}, {_AVAILABLE}
  select cell_id, n_pairs, n_valid as n_valid_for_calibration, sources, reason, reason is null as available,
    reason is null as valid_for_publication, n_pairs > 0 and n_pairs = n_valid as all_valid_for_calibration from decided""")
def calibration_availability(spark, sf_dir):
    return C.availability(V.scored(spark, sf_dir)).select(
        "cell_id", "n_pairs", "n_valid_for_calibration", F.array_join("confidence_sources_seen", ",").alias("sources"),
        "reason", "available", "valid_for_publication", "all_valid_for_calibration",
    )


@query("calibration_summary", f"""{_BUNDLE}, {_AVAILABLE}
  select d.cell_id, d.n_pairs, d.reason is not null as skipped,
    {', '.join(f"case when reason is null then round({m}, 6) end as {m}" for m in ('brier', 'ece', 'nll', 'auroc', 'aurc', 'adaptive_ece'))},
    case when reason is null then 10 end as n_bins
  from decided d left join ({_BUNDLE_FROM}) using (cell_id)""")
def calibration_summary(spark, sf_dir):
    return V.rounded(C.calibration_summary(V.scored(spark, sf_dir)).select(
        "cell_id", "n_pairs", "skipped", "brier", "ece", "nll", "auroc", "aurc", "adaptive_ece",
        F.when(~F.col("skipped"), F.size("reliability_bins")).alias("n_bins"),
    ))


@query("risk_coverage_curve", f"""{_PAIRS}, {_DESC}
  select cell_id, k, k / cast(n as double) as coverage, 1 - hits / cast(k as double) as risk from desc_rank""")
def risk_coverage_curve(spark, sf_dir):
    return R.risk_coverage_curve(R.descending(pairs(spark, sf_dir)))


@query("aurc", f"{_PAIRS}, {_DESC}, {_AURC} select cell_id, round(aurc, 6) as aurc from aurc")
def aurc(spark, sf_dir):
    return V.rounded(R.aurc(R.descending(pairs(spark, sf_dir))))


_TARGETS = (0.05, 0.1, 0.2, 0.4)


def _at_risk(t: float) -> str:
    name = f"{round(t * 100)}pct"
    return f"""round(coalesce(max(k / cast(n as double)) filter (risk <= {t}e0), 0), 6) as coverage_at_risk_{name},
        round(coalesce(arg_max(risk, k) filter (risk <= {t}e0), 1), 6) as achieved_risk_{name}"""


@query("coverage_at_risk", f"""{_PAIRS}, {_DESC}, {_AURC}
  select cell_id, {', '.join(_at_risk(t) for t in _TARGETS)} from risks group by cell_id""")
def coverage_at_risk(spark, sf_dir):
    return V.rounded(R.coverage_at_risk(R.descending(pairs(spark, sf_dir)), targets=_TARGETS))


@query("selective_risk_summary", f"""{_PAIRS}, {_DESC}, {_AURC}, {_AVAILABLE},
  at_risk as (select cell_id, {', '.join(_at_risk(t) for t in _TARGETS)} from risks group by cell_id)
  select d.cell_id, reason is not null as skipped, case when reason is null then round(aurc, 6) end as aurc,
    {', '.join(f"case when reason is null then {c}_{round(t * 100)}pct end as {c}_{round(t * 100)}pct" for t in _TARGETS for c in ('coverage_at_risk', 'achieved_risk'))}
  from decided d left join aurc using (cell_id) left join at_risk using (cell_id)""")
def selective_risk_summary(spark, sf_dir):
    df = R.selective_risk_summary(V.scored(spark, sf_dir), targets=_TARGETS)
    return V.rounded(df.select("cell_id", "skipped", "aurc", *[c for c in df.columns if "_risk_" in c]))


# --- voting ---------------------------------------------------------------------------------

_VOTES = V.SCORED_SQL + """,
  answers as (select cell_id, id, sample_index, pred_answer as a from scored where coalesce(pred_answer, '') <> ''),
  counts as (select cell_id, id, a, count(*) as cnt, min(sample_index) as first_at, a = '[invalid]' as inv from answers group by 1, 2, 3),
  totals as (select cell_id, id, sum(cnt) as n_all, count(*) as d_all, coalesce(sum(cnt) filter (not inv), 0) as n_valid,
    count_if(not inv) as d_valid from counts group by 1, 2),
  kept as (select c.*, n_all, case when d_valid = 0 then n_all else n_valid end as nv,
    case when d_valid = 0 then 1 else d_valid end as dv from counts c join totals using (cell_id, id) where d_valid = 0 or not inv),
  placed as (select *, row_number() over (partition by cell_id, id order by cnt desc, first_at, a desc) as place from kept),
  placed_all as (select *, row_number() over (partition by cell_id, id order by cnt desc, first_at, a desc) as place from counts),
  scores as (select cell_id, id, any_value(n_all) as n_all,
    max(cnt) / cast(any_value(n_all) as double) as agree_percent,
    case when any_value(dv) = 1 then 1 else 1 - (-sum((cnt / cast(nv as double)) * log2(cnt / cast(nv as double)))) / log2(any_value(dv)) end as entropy,
    case when any_value(dv) = 1 then 1 else (max(cnt) filter (place = 1) - max(cnt) filter (place = 2)) / cast(any_value(n_all) as double) end as fsd
    from placed group by 1, 2),
  majority as (select cell_id, id, a as majority from placed_all where place = 1),
  majority_valid as (select cell_id, id, a as majority_valid from placed where place = 1),
  flags as (select cell_id, id, count(*) as n_samples, count_if(coalesce(correct, false)) as n_correct,
    arg_min(gold_answer, sample_index) as gold from scored group by 1, 2),
  items as (select f.*, coalesce(n_all, 0) as n_answers, majority, majority_valid,
    coalesce(agree_percent, 0) as agree_percent, greatest(0, least(1, coalesce(entropy, 0))) as entropy, coalesce(fsd, 0) as fsd,
    n_correct * 2 > n_samples as more_than_half, coalesce(majority = gold, false) as matches
    from flags f left join scores using (cell_id, id) left join majority using (cell_id, id) left join majority_valid using (cell_id, id))"""


def _consistency_query(method: str):
    @query(f"consistency_{method}", f"""{_VOTES}
      select cell_id, id, cast(n_answers as bigint) as n_answers, round({method}, 6) as consistency from items""")
    def run(spark, sf_dir):
        df = voting.item_votes(V.scored(spark, sf_dir), method=method)
        return V.rounded(df.select("cell_id", "id", "n_answers", "consistency"))
    return run


for _method in voting.METHODS:
    _consistency_query(_method)


@query("majority_votes", f"""{_VOTES}
  select cell_id, id, n_samples, n_correct, majority, majority_valid, more_than_half as more_than_half_correct,
    case when majority is null then more_than_half else matches end as maj_correct from items""")
def majority_votes(spark, sf_dir):
    return voting.item_votes(V.scored(spark, sf_dir)).select(
        "cell_id", "id", "n_samples", "n_correct", "majority", "majority_valid", "more_than_half_correct", "maj_correct"
    )


@query("multisample_summary", f"""{_VOTES}
  select cell_id, count(*) as n_items, cast(sum(n_samples) as bigint) as n_rows, max(n_samples) as n_samples_per_item,
    round(avg(cast(case when majority is null then more_than_half else matches end as int)), 6) as maj_at_k,
    round(avg(cast(n_correct > 0 as int)), 6) as pass_at_1_any_sample,
    round(sum(n_correct) / cast(sum(n_samples) as double), 6) as pass_at_1_per_sample_mean,
    round(avg(agree_percent) filter (n_answers > 0), 6) as consistency_mean, 'agree_percent' as consistency_method
  from items group by cell_id""")
def multisample_summary(spark, sf_dir):
    return V.rounded(voting.multisample_summary(V.scored(spark, sf_dir)))


@query("item_calibration", f"""{_VOTES}, pairs as (select cell_id, id, 0 as sample_index, agree_percent as c, cast(matches as int) as y from items),
  {_ASC}, {_DESC}, {_POINTWISE}, {_ECE}, {_AUROC}, {_AURC}
  select cell_id, n, round(brier, 6) as brier, round(ece, 6) as ece, round(auroc, 6) as auroc, round(aurc, 6) as aurc
  from pointwise join ece using (cell_id) join auroc using (cell_id) join aurc using (cell_id)""")
def item_calibration(spark, sf_dir):
    pairs = voting.item_calibration_pairs(V.scored(spark, sf_dir))
    return V.rounded(C.calibration_metrics(pairs, full=False))
