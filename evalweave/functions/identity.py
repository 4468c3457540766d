"""Keys, hashes, names and provenance columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Split sizes of the known tasks.
TASK_ROWS = {"math500": 500, "gsm8k": 1319, "gpqa_diamond": 198}
CONFIG_FIELDS = (
    "cell_id", "decoding", "model_config", "model_path", "prompt_profile", "quant_config", "seed", "task_config",
)


def first_field(columns: Sequence[str], *names: str) -> Column:
    """First non-NULL among alternative column names, as text; '' when there is none (P20)."""
    found = [F.col(f"`{n}`").cast("string") for n in names if n in set(columns)]
    return F.coalesce(*found, F.lit(""))


def draw_seed(base: Column, index: Column) -> Column:
    return base.cast("long") * 1000 + index  # P24


def short_hash(text: Column) -> Column:
    """First 16 hex digits of SHA-256 (P25)."""
    return F.substring(F.sha2(text, 256), 1, 16)


def json_value(value: Column) -> Column:
    """A scalar as JSON text, NULL as null."""
    boxed = F.to_json(F.struct(value.alias("v")))
    inner = F.substring(boxed, F.lit(6), F.length(boxed) - 6)  # between {"v": and }
    return F.when(value.isNull(), F.lit("null")).otherwise(inner)


def json_object(fields: dict[str, Column]) -> Column:
    """Object with sorted keys and ', ' / ': ' separators; the values are JSON text already."""
    parts = [F.concat(F.lit(f'"{k}": '), fields[k]) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def config_hash(fields: dict[str, Column], decoding: dict[str, Column] | None = None) -> Column:
    """Hash over the eight identifying fields of a cell (P26).  ``decoding`` maps its keys to columns."""
    values = {k: json_value(fields[k]) if k in fields else F.lit("null") for k in CONFIG_FIELDS if k != "decoding"}
    values["decoding"] = (
        json_object({k: json_value(v) for k, v in decoding.items()}) if decoding is not None else F.lit("null")
    )
    return short_hash(json_object(values))


def run_id(cell_id: Column, seed: Column, at: Column) -> Column:
    """cell-sSEED-UTC; the time is an argument, so a plan gives the same rows when run again."""
    stamp = F.date_format(at, "yyyyMMdd'T'HHmmss'Z'")
    return F.concat(cell_id, F.lit("-s"), seed.cast("string"), F.lit("-"), stamp)


def _any(text: Column, *needles: str) -> Column:
    out = F.lit(False)
    for needle in needles:
        out = out | text.contains(needle)
    return out


def model_family(*names: Column) -> Column:
    """Model family named in any of the texts."""
    text = F.lower(F.concat_ws(" ", *names))
    return (
        F.when(_any(text, "qwen15b", "qwen-1.5b"), "Qwen-1.5B")
        .when(_any(text, "qwen7b", "qwen-7b"), "Qwen-7B")
        .when(_any(text, "llama8b", "llama-8b"), "Llama-8B")
        .otherwise("unknown")
    )


def baseline_model_key(cell_id: Column, model_path: Column) -> Column:
    """Key of the literature target a cell compares with, or NULL."""
    text = F.lower(F.concat_ws(" ", F.coalesce(cell_id, F.lit("")), F.coalesce(model_path, F.lit(""))))
    has = text.contains
    return (
        F.when(has("llama") & has("8b"), "DeepSeek-R1-Distill-Llama-8B")
        .when(has("gptq") & has("qwen"), "DeepSeek-R1-Distill-Qwen-7B-GPTQ-W4G128")
        .when(has("qwen") & has("7b"), "DeepSeek-R1-Distill-Qwen-7B")
    )


def baseline_task_key(task: Column) -> Column:
    name = F.lower(F.coalesce(task, F.lit("math500")))
    return (
        F.when(name.startswith("gsm8k"), "GSM8K").when(name.startswith("gpqa"), "GPQA-Diamond").otherwise("MATH-500")
    )


def expected_rows(task: Column, limit: Column | None = None) -> Column:
    """Rows a finished cell holds: the limit, else the split size, else 1."""
    known = F.coalesce(*[F.when(task == t, n) for t, n in TASK_ROWS.items()])
    by_prefix = F.when(task.startswith("gpqa"), TASK_ROWS["gpqa_diamond"])
    return F.coalesce(*([limit] if limit is not None else []), known, by_prefix, F.lit(1))
