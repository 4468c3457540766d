"""Validation, provenance, status and baseline gates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalweave.functions import identity
from evalweave.functions.scoring import ensure_columns
from evalweave.operators.calibration import join_groups


# --- schema validation -----------------------------------------------------------------------

def with_row_errors(
    lines: DataFrame, rules: Mapping[str, Mapping[str, object]], *, value_col: str = "value", name: str = "errors"
) -> DataFrame:
    """Add the rule violations of one JSON document per row as an array of messages.

    A rule may hold ``required``, ``types`` (JSON type names), ``enum``, ``pattern``, ``minimum``
    and ``maximum``.  A document is parsed once and each field taken from it once, in stages.
    """
    fields = list(rules)
    values = [f"_value_{i}" for i in range(len(fields))]
    df = lines.withColumn("_doc", F.try_parse_json(F.col(value_col)))
    df = df.withColumns({v: F.try_variant_get("_doc", f"$.{f}", "variant") for v, f in zip(values, fields)})
    df = df.withColumns({f"{v}_schema": F.schema_of_variant(v) for v in values})
    df = df.withColumns({f"{v}_kind": json_type(F.col(f"{v}_schema")) for v in values})
    checks = [check for v, f in zip(values, fields) for check in _field_checks(f, rules[f], F.col(v), F.col(f"{v}_kind"))]
    found = F.when(F.col("_doc").isNull(), F.array(F.lit("row: not valid JSON"))).otherwise(
        F.array_compact(F.array(*checks))
    )
    return df.withColumn(name, found).drop("_doc", *[v + p for v in values for p in ("", "_schema", "_kind")])


def _field_checks(field: str, rule: Mapping[str, object], value: Column, kind: Column) -> list[Column]:
    message = lambda text: F.lit(f"{field}: {text}")
    text, number = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double")
    is_number = kind.isin("integer", "number")
    checks = []
    if rule.get("required"):
        checks.append(F.when(value.isNull(), message("required property missing")))
    if rule.get("types"):
        allowed = [*rule["types"], *(["integer"] if "number" in rule["types"] else [])]
        checks.append(F.when(~kind.isin(*allowed), message("is not of type " + "/".join(rule["types"]))))
    if rule.get("enum"):
        known = F.coalesce(text.isin(*rule["enum"]), F.lit(False))
        checks.append(F.when(value.isNotNull() & ~known, message("is not an allowed value")))
    if rule.get("pattern"):
        checks.append(F.when((kind == "string") & ~text.rlike(rule["pattern"]), message("does not match its pattern")))
    if rule.get("minimum") is not None:
        checks.append(F.when(is_number & (number < F.lit(rule["minimum"])), message("is below its minimum")))
    if rule.get("maximum") is not None:
        checks.append(F.when(is_number & (number > F.lit(rule["maximum"])), message("is above its maximum")))
    return checks


def json_type(kind: Column) -> Column:
    """JSON type name for the schema text of a VARIANT; NULL when the value is absent."""
    return (
        F.when(kind == "VOID", "null").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean")
        .when(kind == "BIGINT", "integer")
        .when(kind.rlike(r"^(DECIMAL\(\d+,0\))$"), "integer")
        .when(kind.rlike("^(DOUBLE|FLOAT|DECIMAL)"), "number")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind.startswith("OBJECT"), "object")
    )


def validation_report(
    lines: DataFrame, rules: Mapping[str, Mapping[str, object]], *, value_col: str = "value",
    row_col: str = "row", group_cols: Sequence[str] = ("path",), limit: int | None = None,
    reported: int | None = None,
) -> DataFrame:
    """Rows checked, total rows, validity and the first errors per file.

    ``limit`` checks only rows numbered below it and ``reported`` lists only so many errors per
    file; by default every row is checked and every error listed.  For files with very many errors
    take the long form, ``with_row_errors``.
    """
    checked = F.lit(True) if limit is None else F.col(row_col) < limit
    numbered = lines.select(*group_cols, row_col, checked.alias("_checked"), F.when(checked, F.col(value_col)).alias("value"))
    rows = with_row_errors(numbered, rules).withColumn("errors", F.when(F.col("_checked"), F.col("errors"))).drop("value")
    counts = rows.groupBy(*group_cols).agg(
        F.count_if("_checked").alias("rows_checked"),
        F.count(F.lit(1)).alias("total_rows"),
        F.coalesce(F.sum(F.size("errors")), F.lit(0)).alias("n_errors"),
    )
    first = Window.partitionBy(*group_cols).orderBy(row_col, "at")
    shown = (
        rows.select(*group_cols, row_col, F.posexplode_outer("errors").alias("at", "message"))
        .filter(F.col("message").isNotNull())
        .withColumn("_n", F.row_number().over(first))
        .filter(F.lit(True) if reported is None else F.col("_n") <= reported)
        .groupBy(*group_cols)
        .agg(F.array_sort(F.collect_list(F.struct("_n", row_col, "message"))).alias("found"))
        .select(*group_cols, F.transform("found", lambda e: F.format_string("row %s: %s", e[row_col].cast("string"), e["message"])).alias("errors"))
    )
    return join_groups([counts, shown], group_cols, how="left").withColumns({
        "valid": F.col("n_errors") == 0,
        "errors": F.coalesce("errors", F.array().cast("array<string>")),
    })


# --- provenance ------------------------------------------------------------------------------

def provenance_guard(
    rows: DataFrame, cells: DataFrame, *, allow_resume: bool = False, source_col: str | None = None,
    forbidden_sources: Sequence[str] = (),
) -> DataFrame:
    """First reason, if any, not to continue each cell's existing rows.

    ``cells`` holds one row per known cell: cell_id, expected_penalty, current_commit and
    expected_hash.  A cell with rows but no configuration is a problem of its own.
    """
    rows = ensure_columns(
        rows, decoding_repetition_penalty="double", git_commit="string", config_hash="string"
    )
    source = F.col(source_col) if source_col else F.lit("")
    forbidden = F.lit(False)
    for marker in forbidden_sources:
        forbidden = forbidden | source.contains(marker)
    commit = F.nullif(F.col("git_commit"), F.lit(""))
    digest = F.nullif(F.col("config_hash"), F.lit(""))
    known = cells.select("cell_id", "expected_penalty", "current_commit", "expected_hash", F.lit(True).alias("_known"))
    # Expected values ride along as one row per cell, so matches are plain counts, not value sets.
    joined = rows.select("cell_id", "decoding_repetition_penalty", commit.alias("c"), digest.alias("h"), forbidden.alias("f"))
    facts = joined.groupBy("cell_id", "c", "h").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("decoding_repetition_penalty").alias("with_penalty"),
        F.bool_or("f").alias("f"),
    )
    facts = join_groups([facts, known], ["cell_id"], how="left").groupBy("cell_id").agg(
        F.sum("n").alias("rows"),
        F.sum("with_penalty").alias("with_penalty"),
        F.bool_or("f").alias("forbidden"),
        F.count("c").alias("commits"), F.count_if(F.col("c") == F.col("current_commit")).alias("same_commit"),
        F.count("h").alias("hashes"), F.count_if(F.col("h") == F.col("expected_hash")).alias("same_hash"),
        F.max("expected_penalty").alias("expected_penalty"), F.max("current_commit").alias("current_commit"),
        F.max("_known").alias("known"),
    )
    # An unknown cell has no expected values to check; only its being unknown counts.
    reason = (
        F.when(F.lit(allow_resume), F.lit(None).cast("string"))
        .when(F.col("forbidden"), "forbidden_source")
        .when(F.col("known").isNull(), "unknown_cell")
        .when(F.col("expected_penalty").isNotNull() & (F.col("with_penalty") == 0), "missing_repetition_penalty")
        .when((F.col("commits") > 0) & (F.coalesce("current_commit", F.lit("unknown")) != "unknown")
              & (F.col("same_commit") == 0), "git_commit_mismatch")
        .when((F.col("hashes") > 0) & (F.col("same_hash") == 0), "config_hash_mismatch")
    )
    return facts.select("cell_id", "rows", reason.alias("reason")).withColumn("blocked", F.col("reason").isNotNull())


# --- progress and status ---------------------------------------------------------------------

def progress(rows: DataFrame, tasks: DataFrame) -> DataFrame:
    """Rows done, rows expected and status per cell of ``tasks`` (cell_id, task[, row_limit])."""
    tasks = ensure_columns(tasks, row_limit="int")
    done = rows.groupBy("cell_id").agg(F.count(F.lit(1)).alias("rows_done"))
    total = identity.expected_rows(F.col("task"), F.col("row_limit"))
    return join_groups([tasks, done], ["cell_id"], how="left").select(
        "cell_id", "task", F.coalesce("rows_done", F.lit(0)).alias("rows_done"), total.alias("rows_total"),
    ).withColumn("status", F.when(F.col("rows_done") >= F.col("rows_total"), "completed").otherwise("in_progress"))


def cell_status(metadata: DataFrame, row_counts: DataFrame, summaries: DataFrame, scored: DataFrame) -> DataFrame:
    """Status of every archived cell from its raw rows, summary and scored output.

    ``metadata`` has cell_id, task and the status so far; the other inputs list cell_id (and
    rows_saved) of what exists.
    """
    have = lambda df, name: df.select("cell_id").distinct().withColumn(name, F.lit(True))
    out = join_groups(
        [metadata, row_counts, have(summaries, "has_summary"), have(scored, "has_scored")], ["cell_id"], how="left"
    ).withColumns({
        "rows_saved": F.coalesce("rows_saved", F.lit(0)),
        "rows_total": identity.expected_rows(F.coalesce("task", F.lit("math500"))),
        "has_summary": F.coalesce("has_summary", F.lit(False)),
        "has_scored": F.coalesce("has_scored", F.lit(False)),
    })
    full = (F.col("rows_saved") >= F.col("rows_total")) & F.col("has_summary")
    return out.withColumn(
        "status",
        F.when(full & F.col("has_scored"), "scored").when(full, "completed")
        .when(F.col("rows_saved") > 0, "in_progress").otherwise(F.coalesce("status", F.lit("pending"))),
    )


def latest_cell(status: DataFrame) -> DataFrame:
    """The cell with most rows, the later name on ties."""
    order = F.struct("rows_saved", "cell_id")
    return status.agg(
        F.max_by("cell_id", order).alias("last_cell_id"), F.max_by("status", order).alias("last_phase"),
        F.max("rows_saved").alias("rows_done"), F.max_by("rows_total", order).alias("rows_total"),
    )


def matrix_check(expected: DataFrame, wired: DataFrame, reproduction: DataFrame) -> DataFrame:
    """Expected cells that are missing, and extra cells outside the expected and reproduction sets."""
    wired = wired.select("cell_id").filter(~F.col("cell_id").startswith("smoke_")).distinct()
    expected = expected.select("cell_id").distinct()
    missing = expected.join(wired, "cell_id", "left_anti").withColumn("finding", F.lit("missing"))
    extra = wired.join(expected.unionByName(reproduction.select("cell_id")), "cell_id", "left_anti")
    return missing.unionByName(extra.withColumn("finding", F.lit("extra")))


# --- baseline targets ------------------------------------------------------------------------

def baseline_checks(summaries: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per cell and check against the literature targets.

    ``targets``: model_key, task_key, metric, reference, lo, hi, max_value, severity; metric is
    pass_at_1_pct, truncation_rate, parse_failure_rate or reasoning_steps_mean.
    """
    df = ensure_columns(summaries, model_path="string", task="string", truncation_rate="double",
                        parse_failure_rate="double", reasoning_steps_mean="double")
    observed = df.select(
        "cell_id",
        identity.baseline_model_key(F.col("cell_id"), F.col("model_path")).alias("model_key"),
        identity.baseline_task_key(F.col("task")).alias("task_key"),
        F.explode(F.array(*[
            F.struct(F.lit(m).alias("metric"), v.cast("double").alias("observed"), F.lit(d).alias("digits"))
            for m, v, d in (
                ("pass_at_1_pct", F.coalesce("pass_at_1", F.lit(0.0)) * 100, 2),
                ("truncation_rate", F.col("truncation_rate"), 4),
                ("parse_failure_rate", F.col("parse_failure_rate"), 4),
                ("reasoning_steps_mean", F.col("reasoning_steps_mean"), 2),
            )
        ])).alias("m"),
    ).select("cell_id", "model_key", "task_key", "m.*")
    keyed = observed.join(targets, ["model_key", "task_key", "metric"], "left")
    within = F.when(F.col("max_value").isNotNull(), F.col("observed") <= F.col("max_value")).otherwise(
        F.col("observed").between(F.col("lo"), F.col("hi"))
    )
    return keyed.withColumn(
        "status",
        F.when(within.isNull(), "SKIP").when(within, "PASS").otherwise(F.coalesce("severity", F.lit("FAIL"))),
    )


def baseline_gate(checks: DataFrame) -> DataFrame:
    """Overall result per cell: NULL when nothing applied; warnings do not fail it."""
    applied = F.count_if(F.col("status") != "SKIP")
    return checks.groupBy("cell_id", "model_key", "task_key").agg(
        applied.alias("n_checks"),
        F.when(applied > 0, F.count_if(F.col("status") == "FAIL") == 0).alias("passed"),
    )


def harness_delta(results: DataFrame, summaries: DataFrame, task_key: str) -> DataFrame:
    """Own pass rate minus an external harness's accuracy on the first matching task.

    ``results`` has one row per entry: pos, key and a metrics map of name to value; a zero in the
    first metric falls through to the second.
    """
    metric = lambda name: F.try_element_at("metrics", F.lit(name))
    accuracy = F.coalesce(F.nullif(metric("acc,none"), F.lit(0.0)), metric("exact_match,strict-match"))
    first = results.filter(F.lower("key").contains(task_key)).agg(
        F.min_by(F.struct(accuracy.alias("v")), "pos").alias("hit")
    )
    # One aggregate row.
    return summaries.crossJoin(F.broadcast(first)).select(
        "cell_id",
        F.coalesce("pass_at_1", F.lit(0.0)).alias("harness_pass_at_1"),
        F.col("hit.v").alias("lmeval_accuracy"),
        (F.coalesce("pass_at_1", F.lit(0.0)) - F.col("hit.v")).alias("delta"),
    )
