"""Extraction and scoring queries."""

from pyspark.sql import functions as F

from evalweave.functions import scoring, sql, text
from evalweave.registry import views as V
from evalweave.registry.catalog import query


def _nested(depth: int) -> str:
    body = "[^{}]*"
    for _ in range(depth):
        body = "[^{}]*(?:[{]" + body + "[}][^{}]*)*"
    return body


_WS = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"
_BOX = r"(?:\\boxed|\\fbox)[{](" + _nested(10) + ")[}]"
_FINAL = r"(?is)final answer is:\s*(.+?)(?:\.\s*I hope it is correct|\.\s*$|\s*$)"
_NUM = r"-?\p{Nd}+(?:,\p{Nd}{3})*(?:\.\p{Nd}+)?"


def _norm(x: str) -> str:
    repaired = f"translate(coalesce({x}, ''), 'ĠĊ', concat(' ', chr(10)))"
    return f"lower(regexp_replace(replace(replace({repaired}, '$', ''), concat(chr(92), ','), ''), '{_WS}+', '', 'g'))"


def _boxed(t: str) -> str:
    """SQL for the last box of a text whose unclosed boxes, if any, come last."""
    tail = rf"regexp_extract({t}, '(?s)^.*(?:\\boxed|\\fbox)(.*)$', 1)"
    return rf"""case
        when not regexp_matches({t}, '\\boxed|\\fbox') then
            nullif(trim(trim(trim(regexp_extract({t}, '{_FINAL}', 1)), '$')), '')
        when regexp_matches({t}, '(?s)\\boxed [^\\]*$') then nullif(trim(split_part({tail}, '$', 1)), '')
        when regexp_matches({tail}, '^[a-z]+[{{]') then null
        else trim(list_last(regexp_extract_all({t}, '{_BOX}', 1))) end"""


def _last_number(t: str) -> str:
    return f"list_last(regexp_extract_all({t}, '{_NUM}'))"


def _letter(t: str) -> str:
    line = rf"nullif(regexp_extract({t}, '(?i)Answer:\s*\$?([A-D])\$?', 1), '')"
    lone = rf"nullif(regexp_extract(right({t}, 200), '(?s)^(?:.*[^\p{{L}}\p{{M}}\p{{N}}_])?([A-Da-d])(?:[^\p{{L}}\p{{M}}\p{{N}}_]|$)', 1), '')"
    return f"upper(coalesce({line}, {lone}))"


def _steps(t: str) -> str:
    ends = r"[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
    return rf"""case when {t} = '' then 0
        when len(string_split({t}, concat(chr(10), chr(10)))) > 1 then len(string_split({t}, concat(chr(10), chr(10))))
        else len([x for x in string_split_regex({t}, '{ends}') if regexp_matches(x, '[^\s\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]')]) end"""


_REPAIRED = V.TEXT_SQL + r""", rep as (select *, translate(completion, 'ĠĊ', concat(' ', chr(10))) as t,
    case when task = 'gpqa_diamond' then 'choice' when task = 'gsm8k' then 'numeric' else 'math' end as kind from raw)"""


@query("token_marker_repair", V.TEXT_SQL + """
    select id, md5(translate(completion, 'ĠĊ', concat(' ', chr(10)))) as repaired_md5,
        position('Ġ' in completion) > 0 as damaged from raw""")
def token_marker_repair(spark, sf_dir):
    df = V.text_responses(spark, sf_dir)
    return df.select("id", F.md5(text.repair_markers(F.col("completion"))).alias("repaired_md5"),
                     F.col("completion").contains("Ġ").alias("damaged"))


@query("boxed_answer", _REPAIRED + f" select id, form, {_boxed('t')} as answer from rep")
def boxed_answer(spark, sf_dir):
    df = V.text_responses(spark, sf_dir)
    return text.with_boxed(df, {"answer": text.repair_markers(F.col("completion"))}).select("id", "form", "answer")


@query("final_answer_line", _REPAIRED + f"""
    select id, nullif(trim(trim(trim(regexp_extract(t, '{_FINAL}', 1)), '$')), '') as answer from rep""")
def final_answer_line(spark, sf_dir):
    df = V.text_responses(spark, sf_dir)
    return df.select("id", text.final_answer_line(text.repair_markers(F.col("completion"))).alias("answer"))


@query("answer_normalisation", _REPAIRED + f"""
    select id, md5({_norm('completion')}) as normal_md5, {_norm("ending")} as ending_normal from rep""")
def answer_normalisation(spark, sf_dir):
    df = V.text_responses(spark, sf_dir)
    return df.select("id", F.md5(text.normalize_answer(F.col("completion"))).alias("normal_md5"),
                     text.normalize_answer(F.col("ending")).alias("ending_normal"))


@query("sql_functions", _REPAIRED + f"""
    select id, form, md5({_norm('completion')}) as normal_md5, {_norm("ending")} as ending_normal, {_boxed('t')} as answer from rep""")
def sql_functions(spark, sf_dir):
    """The registered functions, called from SQL."""
    sql.register(spark)
    rows = V.text_responses(spark, sf_dir)
    return spark.sql("""select id, form, md5(answer_norm(completion)) as normal_md5, answer_norm(ending) as ending_normal,
        boxed_answer(translate(completion, 'ĠĊ', ' \n')) as answer from {rows}""", rows=rows)


@query("choice_letter", _REPAIRED + f" select id, {_letter('t')} as letter from rep")
def choice_letter(spark, sf_dir):
    df = V.text_responses(spark, sf_dir)
    return df.select("id", text.choice_letter(text.repair_markers(F.col("completion"))).alias("letter"))


@query("numeric_answer", _REPAIRED + f"""
    select id, {_last_number('t')} as last_number,
        case when position('####' in gold_solution) > 0 then trim(list_last(string_split(gold_solution, '####')))
             else {_last_number('gold_solution')} end as gold
    from rep""")
def numeric_answer(spark, sf_dir):
    df = V.text_responses(spark, sf_dir)
    return df.select("id", text.last_number(text.repair_markers(F.col("completion"))).alias("last_number"),
                     text.numeric_gold(F.col("gold_solution")).alias("gold"))


@query("reasoning_steps", _REPAIRED + f" select id, cast({_steps('t')} as int) as steps from rep")
def reasoning_steps(spark, sf_dir):
    df = V.text_responses(spark, sf_dir)
    return df.select("id", text.reasoning_steps(text.repair_markers(F.col("completion"))).alias("steps"))


_SCORE_TEXT = _REPAIRED + f""", ext as (
    select *, {_boxed('t')} as box, {_boxed('gold_solution')} as gold_box from rep),
  ans as (
    select *, case kind when 'choice' then {_letter('t')} when 'numeric' then coalesce(nullif(box, ''), {_last_number('t')})
            else box end as pred_answer,
        case kind when 'choice' then nullif(upper(trim(gold_letter)), '')
            when 'numeric' then trim(list_last(string_split(gold_solution, '####'))) else gold_box end as gold_answer
    from ext),
  cmp as (
    select *, case kind when 'choice' then upper(coalesce(pred_answer, '')) when 'numeric' then replace({_norm('pred_answer')}, ',', '')
            else {_norm('pred_answer')} end as p,
        case kind when 'choice' then coalesce(gold_answer, '') when 'numeric' then replace({_norm('gold_answer')}, ',', '')
            else {_norm('gold_answer')} end as g from ans)
  select id, task, pred_answer, gold_answer, p <> '' and p = g as correct,
    coalesce(pred_answer, '') <> '' as answer_parse_success,
    case when kind = 'math' then coalesce(pred_answer, '') <> '' end as boxed_answer_present,
    cast({_steps('t')} as int) as reasoning_steps from cmp"""


@query("score_responses", _SCORE_TEXT)
def score_responses(spark, sf_dir):
    return scoring.score_responses(V.text_responses(spark, sf_dir), keep_text=False).select(
        "id", "task", "pred_answer", "gold_answer", "correct", "answer_parse_success", "boxed_answer_present",
        "reasoning_steps",
    )


@query("score_short_responses", V.SCORED_SQL + """,
    ext as (select *, case when task = 'gpqa_diamond' then
            case when pred_answer in ('A', 'B', 'C', 'D') then pred_answer
                 when pred_answer = '[invalid]' then null else null end
            when task = 'gsm8k' then nullif(coalesce(pred_answer, ''), '') else coalesce(pred_answer, '') end as pred from scored)
    select cell_id, cast(count(*) as bigint) as n, count_if(coalesce(pred = gold_answer, false)) as num_correct,
        count_if(coalesce(pred, '') <> '') as parsed from ext group by cell_id""")
def score_short_responses(spark, sf_dir):
    rows = scoring.score_responses(V.raw_responses(spark, sf_dir), keep_text=False)
    return rows.groupBy("cell_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("num_correct"),
        F.count_if("answer_parse_success").alias("parsed"),
    )


_FLAGS = """coalesce(pred_answer, '') = '' as parse_failure,
    trim(coalesce(completion, '')) = '' as empty_completion,
    coalesce(truncated, false) or coalesce(finish_reason = 'length', false)
      or (truncated is null and coalesce(completion_tokens >= floor(
          case when coalesce(decoding_max_tokens, 0) <> 0 then decoding_max_tokens
               when coalesce(max_tokens, 0) <> 0 then max_tokens else 32768 end * 0.97e0), false)) as truncated_row,
    coalesce(pred_answer, '') = '' or correct is null as invalid_answer"""


@query("failure_flags", V.SCORED_SQL + f"""
    select cell_id, id, sample_index, {_FLAGS} from scored""")
def failure_flags(spark, sf_dir):
    df = V.scored(spark, sf_dir)
    return df.select("cell_id", "id", "sample_index", *[c.alias(n) for n, c in scoring.failure_flags(df).items()])


_VALID = "('answer_logprob','normalized_sequence_logprob','verbalized_confidence','self_consistency_5','trained_confidence_predictor','explicit')"
CONFIDENCE_SQL = f"""conf as (select *, confidence as confidence_value,
    case when confidence is not null then coalesce(nullif(confidence_source, ''), 'explicit') end as resolved_source,
    confidence is not null and coalesce(nullif(confidence_source, ''), 'explicit') in {_VALID} as is_valid from scored)"""


@query("confidence_resolution", V.SCORED_SQL + f""", {CONFIDENCE_SQL}
    select cell_id, id, sample_index, confidence_value, resolved_source as confidence_source,
        is_valid as confidence_valid_for_calibration from conf""")
def confidence_resolution(spark, sf_dir):
    return scoring.resolve_confidence(V.scored(spark, sf_dir)).select(
        "cell_id", "id", "sample_index", "confidence_value", "confidence_source", "confidence_valid_for_calibration"
    )


@query("confidence_parse_proxy", V.SCORED_SQL + f"""
    select cell_id, case when confidence is not null then coalesce(nullif(confidence_source, ''), 'explicit')
            else 'answer_parse_success' end as confidence_source,
        confidence is not null and coalesce(nullif(confidence_source, ''), 'explicit') in {_VALID} as valid,
        cast(count(*) as bigint) as n,
        round(avg(case when confidence is not null then confidence when answer_parse_success then 1 else 0 end), 6) as mean_value
    from scored group by 1, 2, 3""")
def confidence_parse_proxy(spark, sf_dir):
    df = scoring.resolve_confidence(V.scored(spark, sf_dir), allow_parse_proxy=True)
    return V.rounded(
        df.groupBy("cell_id", "confidence_source", F.col("confidence_valid_for_calibration").alias("valid")).agg(
            F.count(F.lit(1)).alias("n"), F.avg("confidence_value").alias("mean_value")
        )
    )


@query("query_cost", V.SCORED_SQL + """
    select cell_id, id, sample_index, latency_sec as cost_seconds,
        latency_sec * (2.5e0 / 3600e0) as cost_usd from scored""")
def query_cost(spark, sf_dir):
    return V.scored(spark, sf_dir).select(
        "cell_id", "id", "sample_index", scoring.query_cost(F.col("latency_sec")).alias("cost_seconds"),
        scoring.query_cost(F.col("latency_sec"), 2.5).alias("cost_usd"),
    )
