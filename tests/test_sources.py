import json
import os

import pytest
from pyspark.sql import functions as F

from evalweave.functions import identity
from evalweave.operators import gates, items
from evalweave.plans import reports
from evalweave.sources import readers, writers
from evalweave.sources.schemas import RESPONSE_RULES, SUMMARY_RULES


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_responses_missing_blank_and_mixed_ids(spark, tmp_path):
    assert readers.read_responses(spark, str(tmp_path / "none")).count() == 0
    _write(str(tmp_path / "raw/a.jsonl"), '{"id": 1, "cell_id": "a", "truncated": null}\n\n   \n{"id": "x", "extra": 3, "latency_sec": 2}\n')
    rows = readers.read_responses(spark, str(tmp_path / "raw")).orderBy("id").collect()
    assert [(r.id, r.latency_sec, r.cell_id) for r in rows] == [("1", None, "a"), ("x", 2.0, None)]


def test_strict_read_fails_on_a_broken_line(spark, tmp_path):
    _write(str(tmp_path / "a.jsonl"), '{"id": 1}\n{"id": \n')
    with pytest.raises(Exception):
        readers.read_responses(spark, str(tmp_path)).collect()
    good, bad = readers.split_corrupt(readers.read_lines(spark, str(tmp_path)))
    assert (good.count(), bad.count()) == (1, 1)
    row = readers.line_validity(readers.read_lines(spark, str(tmp_path))).first()
    assert (row.good_rows, row.bad_rows, row.valid) == (1, 1, False)


def test_summaries_by_file_name(spark, tmp_path):
    _write(str(tmp_path / "results/one_summary.json"), json.dumps({"cell_id": "named", "n": 3}, indent=1))
    _write(str(tmp_path / "results/two_summary.json"), json.dumps({"n": 4}))
    _write(str(tmp_path / "results/other.json"), json.dumps({"n": 9}))
    out = {r.cell_id: r.n for r in readers.read_summaries(spark, str(tmp_path / "results")).collect()}
    assert out == {"named": 3, "two": 4}


def test_harness_results_newest_with_results(spark, tmp_path):
    _write(str(tmp_path / "h/m/results_1.json"), json.dumps({"results": {"gsm8k": {"acc,none": 0.1}}}))
    _write(str(tmp_path / "h/m/results_2.json"), json.dumps({"results": {"GSM8K_cot": {"acc,none": 0, "exact_match,strict-match": 0.5, "alias": "x"}}}))
    _write(str(tmp_path / "h/m/results_3.json"), json.dumps({"other": 1}))
    results = readers.read_harness_results(spark, str(tmp_path / "h"))
    summary = spark.createDataFrame([("c", 0.75)], "cell_id string, pass_at_1 double")
    row = gates.harness_delta(results, summary, "gsm8k").first()
    assert (row.lmeval_accuracy, row.delta) == (0.5, 0.25)


def test_hashes_counts_and_documents(spark, tmp_path):
    import hashlib
    _write(str(tmp_path / "raw/c1.jsonl"), '{"a": 1}\n\n{"a": 2}\n')
    _write(str(tmp_path / "cfg/m.json"), '{"model_id": "x",\n "dtype": "b"}')
    row = readers.file_hashes(spark, str(tmp_path / "raw")).first()
    assert row.sha256 == hashlib.sha256(open(tmp_path / "raw/c1.jsonl", "rb").read()).hexdigest()
    assert [tuple(r) for r in readers.file_row_counts(spark, str(tmp_path / "raw")).collect()] == [("c1", 2)]
    assert readers.read_documents(spark, str(tmp_path / "cfg")).first().file_name == "m.json"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("c", 1, None), ("d", 2, "x")], "cell_id string, n int, note string")
    writers.write_jsonl(df, str(tmp_path / "j"), partition_cols=["cell_id"])
    writers.write_jsonl(df.limit(1), str(tmp_path / "k"))
    writers.write_csv(df, str(tmp_path / "csv"), ["cell_id", "absent", "n"])
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    back = spark.read.option("header", True).csv(str(tmp_path / "csv")).orderBy("cell_id")
    assert back.columns == ["cell_id", "absent", "n"] and back.first().absent is None
    manifest = writers.cache_manifest(df, source="s", git_commit="abc").first()
    assert manifest.n_rows == 2


def test_validation_rules(spark):
    ok = {f: "x" for f in ("id", "prompt", "completion", "cell_id", "task", "run_id", "git_commit", "config_hash", "prompt_template_version")} | {"seed": 1}
    cases = [ok, ok | {"id": 7, "finish_reason": None, "latency_sec": 3}, {k: v for k, v in ok.items() if k != "run_id"},
             ok | {"seed": "0"}, ok | {"truncated": "yes"}, ok | {"problem": None}, ok | {"id": 1.5}, "broken"]
    lines = spark.createDataFrame([("p", i, c if isinstance(c, str) else json.dumps(c)) for i, c in enumerate(cases)], "path string, row int, value string")
    report = gates.validation_report(lines, RESPONSE_RULES).first()
    assert (report.rows_checked, report.n_errors, report.valid) == (8, 6, False)
    assert report.errors[0] == "row 2: run_id: required property missing" and report.errors[-1] == "row 7: row: not valid JSON"
    assert gates.validation_report(lines, RESPONSE_RULES, limit=2).first().valid is True
    doc = spark.createDataFrame([('{"n": -1, "pass_at_1": 1.5}',)], "value string")
    errors = gates.with_row_errors(doc, SUMMARY_RULES).first().errors
    assert sorted(errors) == ["cell_id: required property missing", "n: is below its minimum", "pass_at_1: is above its maximum"]


def test_guard_reasons(spark):
    rows = [("a", None, "abc", "h"), ("b", 1.05, "old", "h"), ("c", 1.05, None, "x"), ("d", 1.05, "abc", "h"), ("e", 1.05, "abc", "h"), ("f", None, None, None)]
    df = spark.createDataFrame(rows, "cell_id string, decoding_repetition_penalty double, git_commit string, config_hash string")
    cells = spark.createDataFrame([(c, 1.05, "abc", "h") for c in "abcd"] + [("f", None, "abc", "h")],
                                  "cell_id string, expected_penalty double, current_commit string, expected_hash string")
    out = {r.cell_id: r.reason for r in gates.provenance_guard(df, cells).collect()}
    assert out == {"a": "missing_repetition_penalty", "b": "git_commit_mismatch", "c": "config_hash_mismatch", "d": None, "e": "unknown_cell", "f": None}
    assert not any(r.blocked for r in gates.provenance_guard(df, cells, allow_resume=True).collect())
    marked = df.withColumn("src", F.lit("/x/old-archive/raw/a.jsonl"))
    assert {r.reason for r in gates.provenance_guard(marked, cells, source_col="src", forbidden_sources=["old-archive"]).collect()} == {"forbidden_source"}


def test_low_pass_rate_fails_its_gate(spark):
    from evalweave.registry.gate_queries import TARGET_SCHEMA, TARGETS
    rows = [("level_a_qwen7b_bf16_math500_seed0", "math500", 0.07, 0.9, 0.86, 100.0), ("good_qwen7b", "math500", 0.5, 0.1, 0.1, 500.0), ("other", "math500", 0.5, 0.1, 0.1, 5.0)]
    df = spark.createDataFrame(rows, "cell_id string, task string, pass_at_1 double, truncation_rate double, parse_failure_rate double, reasoning_steps_mean double")
    checks = gates.baseline_checks(df, spark.createDataFrame(TARGETS, TARGET_SCHEMA))
    assert {r.cell_id: r.passed for r in gates.baseline_gate(checks).collect()} == {
        "level_a_qwen7b_bf16_math500_seed0": False, "good_qwen7b": True, "other": None}
    assert checks.filter("status = 'WARN'").count() == 2


def test_hashes_match_python(spark):
    import hashlib
    payload = {"cell_id": "c", "model_config": "m", "task_config": "t", "quant_config": "q", "seed": 3,
               "decoding": {"temperature": 0.6, "max_tokens": 10, "repetition_penalty": 1.05}, "prompt_profile": None, "model_path": "p/\"x\""}
    want = hashlib.sha256(json.dumps(payload, sort_keys=True).encode()).hexdigest()[:16]
    lit = lambda v: F.lit(v).cast("string") if v is None else F.lit(v)
    fields = {k: lit(v) for k, v in payload.items() if k != "decoding"}
    got = spark.range(1).select(identity.config_hash(fields, {k: F.lit(v) for k, v in payload["decoding"].items()}).alias("h")).first().h
    assert got == want


def test_templates_and_rows(spark):
    df = spark.createDataFrame([("{question} {{x}} {a}", "Q {a} {{", "A")], "t string, q string, a string")
    assert df.select(items.render_template(F.col("t"), {"question": F.col("q"), "a": F.col("a")}).alias("x")).first().x == "Q {a} {{ {x} A"
    profile = spark.createDataFrame([("reproduction", "math500"), ("sober", "gsm8k"), ("odd", "gsm8k"), (None, "gsm8k")], "p string, t string")
    got = [r.f for r in profile.select(items.template_file(F.col("p"), F.col("t"), F.lit("own")).alias("f")).collect()]
    assert got == ["prompts/qrm_math500.txt", "prompts/gsm8k.txt", "own", "own"]
    tasks = spark.createDataFrame([("math500", None), ("gsm8k", None), ("gpqa_x", None), ("other", None), ("math500", 7)], "t string, l int")
    assert [r.n for r in tasks.select(identity.expected_rows(F.col("t"), F.col("l")).alias("n")).collect()] == [500, 1319, 198, 1, 7]


def test_choice_shuffle_is_a_permutation(spark):
    df = spark.createDataFrame([(i, "q", "r", "a", "b", "c") for i in range(40)],
                               ["item_index", "Question", "Correct Answer", "Incorrect Answer 1", "Incorrect Answer 2", "Incorrect Answer 3"])
    out = items.shuffle_choices(df, seed=1).collect()
    assert all(sorted(r.choices.values()) == ["a", "b", "c", "r"] and r.choices[r.gold_letter] == "r" for r in out)
    assert {r.gold_letter for r in out} == set("ABCD")
    assert out == items.shuffle_choices(df, seed=1).collect() != items.shuffle_choices(df, seed=2).collect()


def test_score_run_report(spark):
    rows = [("c", str(i), i % 3 > 0, 0.9 if i % 3 else 0.4, "explicit", float(i), "x", "stop") for i in range(30)]
    rows += [("d", str(i), True, None, None, 1.0, "x", None) for i in range(5)]
    df = spark.createDataFrame(rows, "cell_id string, id string, correct boolean, confidence double, confidence_source string, latency_sec double, pred_answer string, finish_reason string")
    out = {r.cell_id: r for r in reports.score_run(df, n_resamples=50).collect()}
    assert out["c"].skipped is False and out["c"].brier is not None and out["c"].pass_at_1_ci95_low < 2 / 3 < out["c"].pass_at_1_ci95_high
    assert out["d"].skipped is True and out["d"].brier is None and out["d"].reason == "no_confidence_values"
    assert out["c"].finish_reason_counts == {"stop": 30} and out["d"].pass_at_1_n_clusters == 5
    with pytest.raises(Exception, match="no confidence values"):
        reports.score_run(df, require_calibration=True, n_resamples=50).collect()


def test_lines_are_judged_like_the_reader_does(spark):
    lines = ['{"a":1}', '{"a":1,"a":2}', '{"a":NaN}', "{}", "5", "[1]", '{"a":1', '{"a":1} x', '{"a":1},{"b":2}', '{"a":1}]', "null", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "i int, value string")
    good = df.filter(readers.is_row(F.col("value"))).orderBy("i").collect()
    assert [r.i for r in good] == [0, 1, 2, 3]


def test_replacing_keeps_cell_names_and_leaves_nothing_beside(spark, tmp_path):
    cells = spark.createDataFrame([("007", 1), ("08", 2), ("7", 3), (None, 4)], "cell_id string, x int")
    for _ in range(2):
        writers.write_parquet(cells, f"{tmp_path}/t")
    back = spark.read.schema(cells.schema).parquet(f"{tmp_path}/t").select("cell_id", "x").collect()
    assert sorted(back, key=lambda r: r.x) == [("007", 1), ("08", 2), ("7", 3), (None, 4)]
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_harness_entries_keep_the_document_order(spark, tmp_path):
    (tmp_path / "results_1.json").write_text('{"results": {"gsm8k_zero": {"acc": 0.9}, "gsm8k_cot": {"acc": 0.1}}}')
    rows = readers.read_harness_results(spark, str(tmp_path)).orderBy("pos").collect()
    assert [r.key for r in rows] == ["gsm8k_zero", "gsm8k_cot"]


def test_hashes_of_all_given_files(spark, tmp_path):
    import hashlib
    from evalweave.registry import catalog
    spark.range(30).write.parquet(str(tmp_path / "many.parquet"))
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "one.parquet"))
    got = {r.path.removeprefix("file:"): (r.sha256, r.n_bytes) for r in catalog.load()[0]["given_file_hashes"](spark, str(tmp_path)).collect()}
    want = {str(f): (hashlib.sha256(f.read_bytes()).hexdigest(), f.stat().st_size) for f in tmp_path.rglob("*.parquet") if f.is_file()}
    assert got == want and len(want) > 2
