"""Response tables that Spark derives from the given tables, and the same views as SQL text.

The given tables hold no evaluation results, so responses are derived from ``lineitem`` (short
rows, several samples per item) and from ``documents`` (long texts).  Varying values come from
16-bit slices of a row hash, written ``@0`` ... ``@15`` below, so both engines derive the same
rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_PRIME = 2147483647


def _slices(text: str) -> str:
    """``@n`` as a 16-bit number: the mixed row key times a power of a primitive root.

    Integer arithmetic that both engines share; short enough for compiled code to stay small.
    """
    def one(m: re.Match) -> str:
        key = "item_key" if m.group(1) else "key"
        return f"cast(((({key} * {pow(48271, int(m.group(2)) + 3, _PRIME)}) % {_PRIME}) >> 12) % 65536 as int)"
    return re.sub(r"@(i?)(\d+)", one, text)


def _mixed(key: str) -> str:
    """One nonlinear round, so that neighbouring keys do not give neighbouring slices."""
    return f"({key} * (({key} >> 15) + 40503)) % {_PRIME}"


CELL = """case concat(l_returnflag, l_linestatus)
    when 'AF' then 'level_a_qwen7b_bf16_math500_seed0' when 'AO' then 'level_b_qwen7b_gptq4_math500_seed1'
    when 'NF' then 'level_c_llama8b_bf16_math500_seed0' when 'NO' then 'level_c_llama8b_fp8_gsm8k_seed1'
    when 'RF' then 'level_c_qwen15b_awq4_gpqa_seed0' else 'smoke_other_fp8_math500_seed1' end"""
BASELINE_CELL = "level_a_qwen7b_bf16_math500_seed0"

# Stages of the scored view: (name, expression) lists on top of the columns before.
_BASE = [
    ("cell_id", CELL), ("id", "cast(l_orderkey as string)"), ("okey", "l_orderkey"), ("pk", "l_partkey"),
    ("sk", "l_suppkey"), ("ln", "l_linenumber"), ("px", "l_extendedprice"),
    ("qty", "l_quantity"), ("sd", "l_shipdate"), ("run_no", "cast(l_suppkey % 40 as int)"),
]
_INDEXED = [("sample_index", "cast(row_number() over (partition by cell_id, id order by ln, pk, sk, px, sd) - 1 as int)")]
# Spark names the same groups by the id first: cells share long beginnings, which a sort by the cell compares for every row.
_INDEXED_BY_ID = [(name, text.replace("partition by cell_id, id", "partition by id, cell_id")) for name, text in _INDEXED]
_KEYED = [("raw_key", f"((okey * 997 + length(cell_id) * 5 + ascii(substr(cell_id, 7, 1))) * 31 + sample_index) % {_PRIME}")]
_HASHED = [
    ("key", _mixed("raw_key")),
    ("item_key", f"(okey * 104729 + 17) % {_PRIME}"),
    ("task", "case when cell_id like '%gsm8k%' then 'gsm8k' when cell_id like '%gpqa%' then 'gpqa_diamond' else 'math500' end"),
    ("quant_config", "case when cell_id like '%bf16%' then 'bf16' when cell_id like '%gptq4%' then 'gptq4' when cell_id like '%awq4%' then 'awq4' else 'fp8' end"),
    ("seed", "case when cell_id like '%seed0' then 0 else 1 end"),
    ("model_path", "concat('models/', cell_id)"),
    ("run_cell", "concat(cell_id, '_r', cast(run_no as string))"),
]
_ANSWERS = [
    ("gold_no", "@i0 % 4"),
]
_SCORED = [
    ("gold_answer", "case when task = 'gpqa_diamond' then substr('ABCD', gold_no + 1, 1) else cast(10 + gold_no as string) end"),
    ("wrong", "case when task = 'gpqa_diamond' then substr('ABCD', @9 % 4 + 1, 1) else cast(10 + @9 % 4 as string) end"),
    ("latency_sec", "case when @0 % 50 = 0 then null else px / 2718e0 end"),
    ("prompt_tokens", "cast(qty * 10 as bigint)"),
    ("completion_tokens", "case when @1 % 20 = 0 then null when @1 % 20 = 1 then cast(0 as bigint) else cast(@1 as bigint) end"),
    ("peak_vram_gb", "case when @2 % 40 = 0 then null else 40 + (@2 % 3000) / 1e2 end"),
    ("time_to_first_token_sec", "(@2 % 97) / 1e2"),
    ("tokens_per_second", "case when @3 % 10 = 0 then null else (@3 % 5000) / 5e1 end"),
    ("power_watts_max", "case when @3 % 9 = 0 then null else (@3 % 700) / 2e0 end"),
    ("energy_joules", "case when @4 % 7 = 0 then null else (@4 % 10000) / 4e0 end"),
    ("finish_reason", "case @5 % 4 when 0 then null when 1 then 'length' else 'stop' end"),
    ("truncated", "case when @6 % 8 = 0 then true when @6 % 8 < 5 then false else null end"),
    ("decoding_max_tokens", "case when @6 % 5 = 0 then cast(0 as bigint) when @6 % 5 = 1 then null else cast(32768 as bigint) end"),
    ("max_tokens", "case when @6 % 3 = 0 then null else cast(60000 as bigint) end"),
    ("reasoning_steps", "@7 % 300"),
    ("completion", "case when @14 % 30 = 0 then null when @14 % 30 = 1 then '   ' else 'text' end"),
    ("confidence", "case when @11 % 25 = 0 then null else (@12 % 101) / 1e2 end"),
    ("confidence_source", "case when seed = 0 then 'answer_logprob' when @13 % 10 = 0 then '' when @13 % 10 = 1 then null when @13 % 10 = 2 then 'mystery' else 'verbalized_confidence' end"),
    ("git_commit", "case when @15 % 10 = 0 then null when @15 % 2 = 0 then 'abc1234' else 'def5678' end"),
    ("config_hash", "case when @15 % 3 = 0 then null else concat('cfg_', quant_config) end"),
    ("decoding_repetition_penalty", "case when seed = 1 then null else 1.05e0 end"),
]
_JUDGED = [
    ("pred_answer", "case when @8 % 12 = 0 then null when @8 % 12 = 1 then '' when @8 % 12 = 2 then '[invalid]' when @8 % 12 < 8 then gold_answer else wrong end"),
]
_FINAL = [
    ("correct", "case when @10 % 60 = 0 then null else coalesce(pred_answer = gold_answer, false) end"),
    ("answer_parse_success", "coalesce(pred_answer <> '', false)"),
    ("boxed", "concat(chr(92), 'boxed{', coalesce(pred_answer, ''), '}')"),
]
_STAGES = [_BASE, _INDEXED, _KEYED, _HASHED, _ANSWERS, _SCORED, _JUDGED, _FINAL]
_SPARK_STAGES = [_INDEXED_BY_ID if stage is _INDEXED else stage for stage in _STAGES]


def _derive(df: DataFrame, stages: list[list[tuple[str, str]]]) -> DataFrame:
    for n, stage in enumerate(stages):
        exprs = [f"{_slices(e)} as {name}" for name, e in stage]
        df = df.selectExpr(*([] if n == 0 else ["*"]), *exprs)
    return df


def _ctes(source: str, name: str, stages: list[list[tuple[str, str]]]) -> str:
    out, prev = [], source
    for n, stage in enumerate(stages):
        cur = name if n == len(stages) - 1 else f"{name}_{n}"
        cols = ", ".join(f"{_slices(e)} as {c}" for c, e in stage)
        out.append(f"{cur} as (select {'' if n == 0 else '*, '}{cols} from {prev})")
        prev = cur
    return ",\n".join(out)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows of six cells, about one per lineitem row."""
    return _derive(table(spark, sf_dir, "lineitem"), _SPARK_STAGES).withColumn("ts", F.col("sd"))


SCORED_SQL = "with " + _ctes("lineitem", "scored", _STAGES)


# Long texts: a document with an answer in one of ten forms at its end.
_TEXT_STAGES = [
    [("doc_id", "doc_id"), ("id", "cast(doc_id as string)"), ("cell_id", "concat('docs_', lang)"), ("text", "text"),
     ("raw_key", f"((doc_id + 3) * 104729 + 31) % {_PRIME}"), ("sample_index", "0")],
    [("key", _mixed("raw_key"))],
    [("task", "case @0 % 3 when 0 then 'gpqa_diamond' when 1 then 'gsm8k' else 'math500' end"),
     ("gold_no", "@3 % 3"), ("form", "@1 % 10"), ("bs", "chr(92)"),
     ("v", "case when @4 % 2 = 0 then cast(10 + @3 % 3 as string) else cast(10 + @5 % 5 as string) end"),
     ("body", "case when @2 % 5 = 0 then replace(replace(text, ' ', 'Ġ'), chr(10), 'Ċ') when @2 % 5 = 1 then replace(text, chr(10), concat(chr(10), chr(10))) else text end")],
    [("ending", """case form when 0 then '' when 1 then concat(' ', bs, 'boxed{', v, '}')
        when 2 then concat(' so ', bs, 'boxed{', bs, 'frac{1}{ ', v, '}}.')
        when 3 then concat(' ', bs, 'boxed{', v, '} then ', bs, 'boxed{', bs, 'frac{1}{2')
        when 4 then concat(' Therefore, the final answer is: $', v, '$. I hope it is correct.')
        when 5 then concat(' thus ', bs, 'boxed ', v, '$ done')
        when 6 then concat(' Answer: $', substr('ABCD', @5 % 4 + 1, 1), '$')
        when 7 then concat(' ', bs, 'fbox{', v, bs, ', 000}')
        when 8 then concat(' ', bs, 'boxed{{{{{{{{{', v, '}}}}}}}}} end')
        else concat(' ', bs, 'boxedx{', v, '}') end"""),
     ("gold_solution", """case when task = 'gsm8k' then concat('about 7 #### ', case when @6 % 2 = 0 then cast(10 + gold_no as string) else concat('1,0', cast(10 + gold_no as string)) end)
        else concat('hence ', bs, 'boxed{', cast(10 + gold_no as string), '}') end"""),
     ("gold_letter", "case when task = 'gpqa_diamond' then substr('abcd', @3 % 4 + 1, 1) else null end")],
    [("completion", "concat(body, ending)")],
]


def text_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw response per document, its text in full."""
    return _derive(table(spark, sf_dir, "documents"), _TEXT_STAGES).drop("text", "body", "raw_key", "key", "bs")


TEXT_SQL = "with " + _ctes("documents", "raw", _TEXT_STAGES)


def raw_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw responses with short completions, several samples per item."""
    df = scored(spark, sf_dir)
    choice = F.concat(F.lit("I think.\n\nAnswer: "), F.coalesce("pred_answer", F.lit("")))
    return df.select(
        "cell_id", "id", "sample_index", "task", "seed", "quant_config", "latency_sec", "completion_tokens",
        "finish_reason", "truncated", "decoding_max_tokens", "max_tokens", "confidence", "confidence_source", "sd",
        F.when(F.col("task") == "gpqa_diamond", choice)
        .otherwise(F.concat(F.lit("First.\n\nThen "), F.col("boxed"))).alias("completion"),
        F.concat(F.lit("so #### "), F.col("gold_answer"), F.lit("")).alias("_numeric_gold"),
        F.col("gold_answer").alias("_gold"),
    ).select(
        "*",
        F.when(F.col("task") == "gsm8k", F.col("_numeric_gold"))
        .otherwise(F.concat(F.lit("\\boxed{"), F.col("_gold"), F.lit("}"))).alias("gold_solution"),
        F.when(F.col("task") == "gpqa_diamond", F.col("_gold")).alias("gold_letter"),
    ).drop("_gold", "_numeric_gold")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry samples: one device per user, power from the event value."""
    return samples_of(table(spark, sf_dir, "events"))


def samples_of(events: DataFrame) -> DataFrame:
    return events.select(
        F.concat(F.lit("gpu"), F.col("user_id").cast("string")).alias("device"),
        "ts",
        F.col("event_id").alias("sample_id"),
        (F.col("event_id") % 80 * 1_000_000_000).alias("mem_bytes"),
        (F.col("event_id") % 101).cast("double").alias("util"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("power"),
    )


SAMPLES_SQL = """with samples as (
    select concat('gpu', cast(user_id as string)) as device, ts, event_id as sample_id,
        event_id % 80 * 1000000000 as mem_bytes, cast(event_id % 101 as double) as util,
        case when event_type <> 'error' then value end as power
    from events)"""


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values_sql(rows: list[tuple]) -> str:
    """Rows as a VALUES list."""
    def one(v: object) -> str:
        if v is None:
            return "null"
        if isinstance(v, bool):
            return str(v).lower()
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)
    return "(values " + ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows) + ")"


def near_normal(value, std_error, low: str = "ci_low", high: str = "ci_high"):
    """Whether both ends of a 95 % interval lie within 0.4 standard errors of the normal interval."""
    off = lambda end, z: F.abs(F.col(end) - (value + z * std_error)) <= 0.4 * std_error
    return off(low, -1.959964) & off(high, 1.959964)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison: sums differ in their last bits by the order of addition."""
    return df.select(*[
        F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])
