import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalweave.functions.stats import erfc, erfc_expression, finite
from evalweave.operators import bootstrap, calibration, comparison, frontier, quantiles, risk, sampling, voting
from evalweave.plans.ranked import with_running


def pairs_df(spark, rows):
    return spark.createDataFrame(
        [("g", float(c), int(y), f"{i:04d}", 0) for i, (c, y) in enumerate(rows)],
        "cell_id string, conf double, y int, id string, sample_index int")


def brute(rows, bins=10):
    """Metrics of (conf, label) pairs in file order, straight from their definitions."""
    conf, lab = np.array([c for c, _ in rows]), np.array([y for _, y in rows])
    n = len(rows)
    edges = np.linspace(0, 1, bins + 1)
    ece = 0.0
    for i in range(bins):
        m = ((conf > edges[i]) | ((i == 0) & (conf >= 0))) & (conf <= edges[i + 1])
        if m.any():
            ece += m.mean() * abs(lab[m].mean() - conf[m].mean())
    order = sorted(range(n), key=lambda i: -conf[i])
    risks = [1 - lab[order[:k]].mean() for k in range(1, n + 1)]
    aurc = sum((risks[i] + risks[i - 1]) / 2 / n for i in range(1, n))
    pos, neg = conf[lab == 1], conf[lab == 0]
    auc = None
    if len(pos) and len(neg):
        auc = np.mean([(p > q) + (p == q) / 2 for p in pos for q in neg])
    asc = sorted(range(n), key=lambda i: conf[i])
    size = max(1, n // max(bins, 10))
    adaptive = sum(len(asc[s:s + size]) / n * abs(lab[asc[s:s + size]].mean() - conf[asc[s:s + size]].mean()) for s in range(0, n, size))
    p = np.clip(conf, 1e-12, 1 - 1e-12)
    nll = -np.mean(lab * np.log(p) + (1 - lab) * np.log(1 - p))
    return {"brier": np.mean((conf - lab) ** 2), "ece": ece, "auroc": auc, "aurc": aurc, "adaptive_ece": adaptive, "nll": nll}


@pytest.mark.parametrize("rows", [
    [(0.9, 1), (0.8, 1), (0.2, 0), (0.1, 0)],
    [(0.5, 1)],
    [(0.0, 0), (1.0, 1), (1.2, 1), (-0.1, 0), (0.3, 1), (0.3, 0), (0.3, 1)],
    [(0.5, i % 2) for i in range(40)],
    [(round(((i * 7919) % 101) / 100, 2), int((i * 31) % 10 < 6)) for i in range(257)],
    [(0.7, 1), (0.8, 1)],
])
def test_calibration_matches_definitions(spark, rows):
    got = calibration.calibration_metrics(pairs_df(spark, rows)).first().asDict()
    for name, want in brute(rows).items():
        assert got[name] == (None if want is None else pytest.approx(want, abs=1e-9)), name


def test_reliability_bins_cover_all_bins(spark):
    rows = calibration.reliability_bins(pairs_df(spark, [(0.0, 0), (0.1, 1), (0.28, 1), (1.5, 1)])).orderBy("bin").collect()
    assert [r["count"] for r in rows] == [2, 0, 1, 0, 0, 0, 0, 0, 0, 0]
    assert rows[0].accuracy == 0.5 and rows[1].confidence == 0.0 and rows[9].bin_hi == 1.0


def test_running_totals_split_a_hot_group(spark):
    """One group holds most rows and one tie holds most of the group; slices must add up."""
    rows = [("hot" if i % 5 else f"g{i % 3}", 0.5 if i % 4 else i / 1000.0, i, i % 2) for i in range(4000)]
    df = spark.createDataFrame(rows, "cell_id string, conf double, id int, y int").repartition(5)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = with_running(df, ["cell_id"], [F.desc("conf"), F.asc("id")], {"hits": "y"}).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    seen = {}
    for r in sorted(out, key=lambda r: (r.cell_id, -r.conf, r.id)):
        k, h = seen.get(r.cell_id, (0, 0))
        seen[r.cell_id] = (k + 1, h + r.y)
        assert (r["rank"], r.hits) == seen[r.cell_id]
    assert {r.cell_id: r.group_rows for r in out} == {g: k for g, (k, _) in seen.items()}
    assert len(out) == 4000


def test_null_group_is_kept(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "cell_id string, v int")
    out = with_running(df, ["cell_id"], [F.asc("v")]).collect()
    assert sorted((str(r.cell_id), r["rank"], r.group_rows) for r in out) == [("None", 1, 2), ("None", 2, 2), ("a", 1, 1)]


def test_risk_gates_and_coverage(spark):
    ranked = risk.descending(pairs_df(spark, [(0.9, 1), (0.8, 1), (0.3, 0)]))
    curve = [(r.k, r.coverage, r.risk) for r in risk.risk_coverage_curve(ranked).orderBy("k").collect()]
    assert curve == [(1, pytest.approx(1 / 3), 0.0), (2, pytest.approx(2 / 3), 0.0), (3, 1.0, pytest.approx(1 / 3))]
    row = risk.coverage_at_risk(ranked).first()
    assert row.coverage_at_risk_10pct == pytest.approx(2 / 3) and row.achieved_risk_10pct == 0.0
    none = risk.coverage_at_risk(risk.descending(pairs_df(spark, [(0.9, 0)]))).first()
    assert (none.coverage_at_risk_5pct, none.achieved_risk_5pct) == (0.0, 1.0)


def _scored(spark, rows):
    return spark.createDataFrame(
        [("c", str(i), k, a, g, "math500", g is not None and a == g) for i, k, a, g in rows],
        "cell_id string, id string, sample_index int, pred_answer string, gold_answer string, task string, correct boolean")


VOTES = [("1", i, a, "x") for i, a in enumerate(["x", "y", "y", "x", "[invalid]"])] + \
        [("2", i, a, "x") for i, a in enumerate(["[invalid]", "[invalid]", "x"])] + \
        [("3", i, a, "x") for i, a in enumerate(["[invalid]", "[invalid]"])] + \
        [("4", i, a, "x") for i, a in enumerate([None, ""])] + [("5", 0, "x", "x")] + \
        [("6", i, a, "z") for i, a in enumerate(["a", "a", "a", "b"])]


@pytest.mark.parametrize("method, want", [
    ("agree_percent", {"1": 2 / 5, "2": 1 / 3, "3": 1.0, "4": 0.0, "5": 1.0, "6": 0.75}),
    ("entropy", {"1": 0.0, "2": 1.0, "3": 1.0, "4": 0.0, "5": 1.0, "6": 1 + 0.75 * math.log2(0.75) + 0.25 * math.log2(0.25)}),
    ("fsd", {"1": 0.0, "2": 1.0, "3": 1.0, "4": 0.0, "5": 1.0, "6": 0.5}),
])
def test_consistency(spark, method, want):
    out = {r.id: r.consistency for r in voting.item_votes(_scored(spark, VOTES), method=method).collect()}
    assert out == {k: pytest.approx(v, abs=1e-12) for k, v in want.items()}


def test_majorities(spark):
    out = {r.id: r for r in voting.item_votes(_scored(spark, VOTES)).collect()}
    assert {k: r.majority for k, r in out.items()} == {"1": "x", "2": "[invalid]", "3": "[invalid]", "4": None, "5": "x", "6": "a"}
    assert out["2"].majority_valid == "x" and out["3"].majority_valid == "[invalid]"
    assert out["1"].maj_correct and not out["6"].maj_correct and not out["4"].maj_correct
    with pytest.raises(ValueError):
        voting.item_votes(_scored(spark, VOTES), method="other")


def _flags(spark, **cells):
    rows = [(c, str(i), 0, f == "T") for c, flags in cells.items() for i, f in enumerate(flags)]
    return spark.createDataFrame(rows, "cell_id string, id string, sample_index int, correct boolean")


def test_mcnemar(spark):
    out = comparison.compare_with_baseline(_flags(spark, base="TTFFT", var="TFFTT"), "base").first()
    assert (out.b, out.c, out.statistic) == (1, 1, 0.5) and out.p_value == pytest.approx(math.erfc(0.5))
    out = comparison.compare_with_baseline(_flags(spark, base="F" * 10, var="T" * 10), "base").first()
    assert (out.b, out.c) == (0, 10) and out.p_value < 0.01 and out.effect_rate_diff == 1.0
    out = comparison.compare_with_baseline(_flags(spark, base="TF", var="TF"), "base").first()
    assert (out.statistic, out.p_value, out.effect_rate_diff) == (0.0, 1.0, 0.0)


def test_overlap_rule(spark):
    df = _flags(spark, base="TF").unionByName(spark.createDataFrame([("v", "zz", 0, True)], "cell_id string, id string, sample_index int, correct boolean"))
    assert comparison.compare_with_baseline(df, "base").first().n_items == 0
    with pytest.raises(Exception, match="No overlapping"):
        comparison.compare_with_baseline(df, "base", require_overlap=True).collect()


def test_holm(spark):
    df = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03)], "family string, id string, p double")
    out = {r.id: r.p_value_holm for r in comparison.holm_adjusted(df, "p", ["family"], ["id"]).collect()}
    assert out == {"a": pytest.approx(0.03), "b": pytest.approx(0.06), "c": pytest.approx(0.06)}


def test_erfc(spark):
    df = spark.createDataFrame([(x / 10,) for x in range(0, 50)], "x double")
    for r in df.select("x", erfc(F.col("x")).alias("a"), erfc_expression(F.col("x")).alias("b")).collect():
        assert r.a == math.erfc(r.x) and r.b == pytest.approx(r.a, rel=2e-7)


def test_exact_percentiles(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=5001), rng.integers(0, 7, size=800).astype(float)
    rows = [("a", float(x)) for x in a] + [("b", float(x)) for x in b] + [("c", 4.0), ("d", None)]
    df = spark.createDataFrame(rows, "cell_id string, v double")
    probs = [0.0, 0.025, 0.5, 0.9, 1.0]
    got = {(r.cell_id, r.prob): r.value for r in quantiles.exact_percentiles(df, ["v"], probs).collect()}
    for name, values in (("a", a), ("b", b), ("c", np.array([4.0]))):
        for p in probs:
            assert got[(name, p)] == pytest.approx(np.quantile(values, p)), (name, p)
    assert not any(k[0] == "d" for k in got)
    upper = quantiles.exact_percentiles(spark.createDataFrame([("c", float(x)) for x in (1, 2, 3, 10)], "cell_id string, v double"), ["v"], upper=True)
    assert upper.first().value == 3.0


def _normal_ci(values):
    m, se = np.mean(values), np.std(values) / math.sqrt(len(values))
    return m - 1.96 * se, m + 1.96 * se, se


@pytest.mark.parametrize("chunk", [64, 20_000])
def test_bootstrap_mean_matches_ordinary_resampling(spark, chunk):
    rng = np.random.default_rng(7)
    values = rng.exponential(size=900)
    df = spark.createDataFrame([("g", float(v)) for v in values], "cell_id string, v double")
    reps = bootstrap.replicate_sums(df, {"x": F.col("v")}, n_resamples=1500, chunk_levels=chunk).toPandas()
    assert len(reps) == 1500 and (reps["n"] == 900).all()
    plain = np.array([rng.choice(values, 900).mean() for _ in range(1500)])
    means = reps["x"] / reps["n"]
    assert means.mean() == pytest.approx(plain.mean(), abs=4 * plain.std() / math.sqrt(1500) * 2)
    assert means.std() == pytest.approx(plain.std(), rel=0.1)
    low, high, se = _normal_ci(values)
    ci = bootstrap.bootstrap_ci(df, {"x": F.col("v")}, n_resamples=1500, chunk_levels=chunk).first()
    assert abs(ci.ci_low - low) < 0.4 * se and abs(ci.ci_high - high) < 0.4 * se and ci.value == pytest.approx(values.mean())


def test_bootstrap_is_repeatable_whatever_the_partitioning(spark):
    df = spark.createDataFrame([("g", float(i % 50)) for i in range(400)], "cell_id string, v double")
    first, second = (
        bootstrap.bootstrap_ci(d, {"x": F.col("v")}, n_resamples=100, chunk_levels=8).first()
        for d in (df, df.repartition(5, "v"))
    )
    assert first == second


def test_cluster_and_ratio_bootstrap(spark):
    one = spark.createDataFrame([("c", "a", True), ("c", "a", False)], "cell_id string, id string, correct boolean")
    row = bootstrap.cluster_bootstrap_ci(one, n_resamples=50).first()
    assert (row.value, row.ci_low, row.ci_high, row.n_clusters) == (0.5, 0.5, 0.5, 1)
    empty = spark.createDataFrame([("c", None, True)], "cell_id string, id string, correct boolean")
    row = bootstrap.cluster_bootstrap_ci(empty, n_resamples=50).first()
    assert (row.value, row.ci_low, row.ci_high, row.n_clusters) == (0.0, 0.0, 0.0, 0)
    rows = [("c", float(1 + i % 3), i % 2 == 0) for i in range(60)] + [("none", 1.0, False)]
    ratio = bootstrap.cost_per_correct_ci(spark.createDataFrame(rows, "cell_id string, latency_sec double, correct boolean"), n_resamples=300).collect()
    assert [r.cell_id for r in ratio] == ["c"] and ratio[0].value == pytest.approx(4.0)
    assert ratio[0].ci_low < 4.0 < ratio[0].ci_high


def test_pareto(spark):
    rows = [("a", 0.5, 100.0), ("b", 0.48, 80.0), ("c", 0.45, 90.0), ("d", 0.5, 100.0), ("e", 0.9, float("nan")), ("f", 0.9, None), ("g", 0.9, float("inf"))]
    df = spark.createDataFrame(rows, "cell_id string, pass_at_1 double, cost_per_correct_seconds double")
    assert {r.cell_id: r.on_pareto_frontier for r in frontier.frontier_points(df).collect()} == {"a": True, "b": True, "c": False, "d": False}
    assert spark.range(1).select(finite(F.lit("abc")).alias("x")).first().x is None


def test_seed_variance(spark):
    df = spark.createDataFrame([("f", "a", 0.5), ("f", "b", 0.7), ("g", "c", 0.1), ("h", "d", None)], "family string, cell_id string, pass_at_1 double")
    out = {r.family: r for r in comparison.seed_variance(df).collect()}
    assert (out["f"].n_seeds, out["f"].formatted, out["f"].std) == (2, "0.6±0.1", pytest.approx(math.sqrt(0.02)))
    assert (out["g"].std, out["h"].mean, out["h"].n_seeds) == (0.0, 0.0, 0)


@pytest.mark.parametrize("failures, successes, want", [(40, 60, (5, 5)), (2, 60, (2, 8)), (40, 3, (7, 3)), (2, 3, (2, 3)), (0, 20, (0, 10))])
def test_audit_quota(spark, failures, successes, want):
    rows = [("c", str(i), i >= failures) for i in range(failures + successes)]
    df = spark.createDataFrame([(c, i, ok, True) for c, i, ok in rows], "cell_id string, id string, correct boolean, answer_parse_success boolean")
    out = sampling.audit_sample(df, n=10).collect()
    assert (sum(r.is_failure for r in out), sum(not r.is_failure for r in out)) == want
    assert len({r.id for r in out}) == len(out)


def test_interval_does_not_depend_on_other_cells(spark):
    from evalweave.operators import bootstrap

    small = spark.range(300).select(F.lit("a").alias("cell_id"), (F.xxhash64("id") % 997).cast("double").alias("x"))
    large = spark.range(9000).select(F.lit("b").alias("cell_id"), (F.xxhash64("id") % 99_991).cast("double").alias("x"))

    def of(df):
        sums = bootstrap.replicate_sums(df, {"x": F.col("x")}, n_resamples=50, chunk_levels=200)
        return sorted(sums.where("cell_id = 'a'").select("replicate", "n", "x").collect())

    alone = of(small)
    assert len(alone) == 50 and alone == of(small.union(large))
