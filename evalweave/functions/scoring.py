"""Scoring of response rows: task dispatch, failure flags, confidence, cost columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.functions import text as T

# Confidence sources that may support calibration claims.
VALID_CONFIDENCE_SOURCES = (
    "answer_logprob",
    "normalized_sequence_logprob",
    "verbalized_confidence",
    "self_consistency_5",
    "trained_confidence_predictor",
    "explicit",
)
PARSE_PROXY = "answer_parse_success"
DEFAULT_MAX_TOKENS = 32768
TRUNCATION_SHARE = 0.97
INVALID_ANSWER = "[invalid]"


def ensure_columns(df: DataFrame, **types: str) -> DataFrame:
    """Add missing columns as typed NULLs, so that old and new row layouts mix."""
    have = set(df.columns)
    return df.withColumns({n: F.lit(None).cast(t) for n, t in types.items() if n not in have})


def present(value: Column) -> Column:
    """Neither NULL nor the empty string."""
    return F.coalesce(value != "", F.lit(False))


def is_true(flag: Column) -> Column:
    return F.coalesce(flag.cast("boolean"), F.lit(False))


def task_kind(task: Column) -> Column:
    """'choice', 'numeric' or 'math' from the task name prefix."""
    name = F.lower(F.coalesce(task, F.lit("math500")))
    return (
        F.when(name.startswith("gpqa"), F.lit("choice"))
        .when(name.startswith("gsm8k"), F.lit("numeric"))
        .otherwise(F.lit("math"))
    )


def comparable(answer: Column, kind: Column) -> Column:
    """Answer in the form in which its task compares it."""
    plain = T.normalize_answer(answer)
    return (
        F.when(kind == "choice", T.normalize_letter(answer))
        .when(kind == "numeric", F.replace(plain, F.lit(","), F.lit("")))
        .otherwise(plain)
    )


def same_answer(pred: Column, gold: Column, kind: Column) -> Column:
    """Whether both answers compare equal and are not empty.

    Forms are costly and conditions share no work, so each is named as rarely as can be: equal texts need one.
    """
    a, b = comparable(pred, kind), comparable(gold, kind)
    return F.when(pred.eqNullSafe(gold), a != "").otherwise((a == b) & (a != ""))


def score_responses(df: DataFrame, *, keep_text: bool = True) -> DataFrame:
    """Extract and compare the answer of every row.

    With ``keep_text=False`` the wide text columns end here, before the rows pass the Arrow
    boundary; the scored table then holds metrics only.
    """
    df = ensure_columns(
        df, task="string", completion="string", gold_solution="string",
        gold_letter="string", completion_tokens_est="long",
    )
    kind = F.col("_kind")
    text = F.col("_text")
    df = df.withColumns({
        "_kind": task_kind(F.col("task")),
        "_text": T.repair_markers(F.coalesce(F.col("completion"), F.lit(""))),
        "_gold": T.repair_markers(F.coalesce(F.col("gold_solution"), F.lit(""))),
    })
    # Everything that reads the wide texts, before the Arrow boundary of the box residue.
    df = df.withColumns({
        "_letter": F.when(kind == "choice", T.choice_letter(text)),
        "_number": F.when(kind == "numeric", T.last_number(text)),
        "_number_gold": F.when(kind == "numeric", T.numeric_gold(F.coalesce("gold_solution", F.lit("")))),
        "reasoning_steps": T.reasoning_steps(text),
        "empty_completion": is_blank(F.col("completion")),
    })
    boxes = {
        "_boxed": F.when(kind != "choice", text),
        "_boxed_gold": F.when(kind == "math", F.col("_gold")),
    }
    df = df.withColumns({f"_in{n}": c for n, c in boxes.items()}).drop("_text", "_gold")
    if not keep_text:
        df = df.drop("prompt", "completion", "problem", "gold_solution")
    df = T.with_boxed(df, {n: F.col(f"_in{n}") for n in boxes}, consume=True)
    number = F.coalesce(F.nullif(F.col("_boxed"), F.lit("")), F.col("_number"))
    df = df.withColumns({
        "pred_answer": F.when(kind == "choice", F.col("_letter")).when(kind == "numeric", number).otherwise(F.col("_boxed")),
        "gold_answer": F.when(kind == "choice", F.nullif(T.normalize_letter(F.col("gold_letter")), F.lit("")))
        .when(kind == "numeric", F.col("_number_gold")).otherwise(F.col("_boxed_gold")),
    })
    return df.withColumns({
        "correct": same_answer(F.col("pred_answer"), F.col("gold_answer"), kind),
        "answer_parse_success": present(F.col("pred_answer")),
        "boxed_answer_present": F.when(kind == "math", present(F.col("pred_answer"))),
    }).drop("_kind", "_letter", "_number", "_number_gold", *boxes)


def is_blank(text: Column) -> Column:
    """No character other than whitespace; NULL counts as blank."""
    return ~F.coalesce(text.rlike(T.NON_SPACE), F.lit(False))


def failure_flags(df: DataFrame) -> dict[str, Column]:
    """Row failure flags (P15): parse failure, empty, truncated, invalid."""
    have = set(df.columns)
    col = lambda name, kind: F.col(name) if name in have else F.lit(None).cast(kind)
    limit = F.coalesce(
        F.nullif(col("decoding_max_tokens", "long"), F.lit(0)),
        F.nullif(col("max_tokens", "long"), F.lit(0)),
        F.lit(DEFAULT_MAX_TOKENS),
    )
    truncated = col("truncated", "boolean")
    no_answer = ~present(F.col("pred_answer"))
    empty = col("empty_completion", "boolean") if "empty_completion" in have else is_blank(col("completion", "string"))
    return {
        "parse_failure": no_answer,
        "empty_completion": empty,
        "truncated_row": is_true(truncated)
        | is_true(col("finish_reason", "string") == "length")
        | (truncated.isNull()
           & is_true(col("completion_tokens", "long") >= F.floor(limit * F.lit(TRUNCATION_SHARE)))),
        "invalid_answer": no_answer | F.col("correct").isNull(),
    }


def resolve_confidence(df: DataFrame, *, allow_parse_proxy: bool = False) -> DataFrame:
    """Add confidence_value, confidence_source and confidence_valid_for_calibration."""
    df = ensure_columns(df, confidence="double", confidence_source="string", answer_parse_success="boolean")
    raw = F.col("confidence").cast("double")
    source = F.coalesce(F.nullif(F.col("confidence_source"), F.lit("")), F.lit("explicit"))
    given = raw.isNotNull()
    # Where the flag is missing, a row with an extracted answer counts as parsed.
    has_answer = F.coalesce(F.col("extracted_answer") != "", F.lit(False)) if "extracted_answer" in df.columns else F.lit(False)
    if allow_parse_proxy:
        value = F.coalesce(raw, is_true(F.col("answer_parse_success")).cast("double"))
        fallback_source = F.lit(PARSE_PROXY)
    else:
        value, fallback_source = raw, F.lit(None).cast("string")
    return df.withColumns({
        "confidence_value": value,
        "confidence_source": F.when(given, source).otherwise(fallback_source),
        "confidence_valid_for_calibration": given & source.isin(*VALID_CONFIDENCE_SOURCES),
        "answer_parse_success": F.coalesce(F.col("answer_parse_success"), has_answer),
    })


def query_cost(latency: Column, gpu_hour_rate: float | None = None) -> Column:
    """Cost of one response in GPU seconds, or in USD for an hourly rate."""
    return latency if gpu_hour_rate is None else latency * F.lit(gpu_hour_rate / 3600.0)


def audit_columns() -> Sequence[Column]:
    """Columns of a manual review sheet."""
    return [
        F.col("id"), F.col("task"), F.col("completion"), F.col("pred_answer"),
        gold_or_letter().alias("gold_answer"), F.col("correct"), F.col("answer_parse_success"),
        F.lit(None).cast("string").alias("reviewer_decision"),
        F.lit(None).cast("string").alias("adjudication_notes"),
    ]


def gold_or_letter() -> Column:
    return F.coalesce(F.nullif(F.col("gold_answer"), F.lit("")), F.col("gold_letter"))
