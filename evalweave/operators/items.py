"""Item preparation, prompts, draw plans and provenance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.functions import identity
from evalweave.functions.text import strip
from evalweave.plans.ranked import with_running

LETTERS = "ABCD"
# Template files by prompt profile and task.
PROMPT_PROFILES = {
    "reproduction": {
        "math500": "prompts/qrm_math500.txt",
        "gsm8k": "prompts/qrm_gsm8k.txt",
        "gpqa_diamond": "prompts/gpqa_diamond.txt",
    },
    "sober": {
        "math500": "prompts/math500.txt",
        "gsm8k": "prompts/gsm8k.txt",
        "gpqa_diamond": "prompts/gpqa_diamond.txt",
    },
}


def number_items(items: DataFrame, order: Sequence[str], limit: int | None = None) -> DataFrame:
    """Items with a 0-based ``item_index`` in the given order, optionally the first ``limit``."""
    if limit is not None:
        items = items.orderBy(*order).limit(limit)
    ranked = with_running(items, [], [F.asc(c) for c in order])
    return ranked.withColumn("item_index", F.col("rank") - 1).drop("rank", "group_rows")


def prepare_items(items: DataFrame, *, problem_field: str = "problem", solution_field: str = "solution") -> DataFrame:
    """Question, id and gold solution of open-answer items (P21); needs ``item_index``."""
    cols = items.columns
    optional = lambda n: (F.col(n) if n in cols else F.lit(None)).cast("string")
    problem = F.col(problem_field).cast("string")
    return items.select(
        F.coalesce(optional("unique_id"), F.col("item_index").cast("string")).alias("id"),
        "item_index",
        strip(problem).alias("question"),
        problem.alias("problem"),
        F.col(solution_field).cast("string").alias("gold_solution"),
        optional("subject").alias("subject"),
        optional("level").alias("level"),
    )


def shuffle_choices(items: DataFrame, *, seed: int = 0) -> DataFrame:
    """Choice items with the four answers in a seeded order, a letter map and the gold letter.

    The order depends on (seed, item index, answer number) only.
    """
    field = lambda *names: identity.first_field(items.columns, *names)
    answers = [field("Correct Answer", "correct_answer", "answer")] + [
        field(f"Incorrect Answer {i}", f"incorrect_answer_{i}") for i in (1, 2, 3)
    ]
    key = lambda i: F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("item_index").cast("string"), F.lit(str(i))))
    placed = F.array_sort(F.array(*[
        F.struct(key(i).alias("key"), a.alias("choice"), F.lit(i == 0).alias("gold")) for i, a in enumerate(answers)
    ]))
    letters = F.array(*[F.lit(c) for c in LETTERS])
    return items.withColumn("_placed", placed).select(
        F.coalesce(*[F.col(f"`{c}`").cast("string") for c in ("Record ID", "unique_id") if c in items.columns],
                   F.col("item_index").cast("string")).alias("id"),
        "item_index",
        field("Question", "question", "problem").alias("question"),
        F.map_from_arrays(letters, F.transform("_placed", lambda x: x["choice"])).alias("choices"),
        F.element_at(letters, F.array_position(F.transform("_placed", lambda x: x["gold"]), True).cast("int")).alias("gold_letter"),
        answers[0].alias("gold_answer"),
    )


def template_file(profile: Column, task: Column, default: Column) -> Column:
    """Template of a cell: by its prompt profile and task, else the task's own."""
    known = [
        F.when((profile == p) & (task == t), f) for p, files in PROMPT_PROFILES.items() for t, f in files.items()
    ]
    return F.coalesce(*known, default)


def render_template(template: Column, fields: Mapping[str, Column]) -> Column:
    """Fill {name} fields and unescape doubled braces.

    The template is cut at its fields first, so braces inside a field value stay untouched.
    """
    names = "|".join(fields)
    parts = F.split(template, rf"(?<!\{{)(?=\{{(?:{names})\}}(?!\}}))")
    unescape = lambda t: F.replace(F.replace(t, F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}"))

    def fill(part: Column) -> Column:
        out = unescape(part)
        for name, value in fields.items():
            token = "{" + name + "}"
            rest = F.substring(part, F.lit(len(token) + 1), F.length(part))
            out = F.when(part.startswith(token), F.concat(value, unescape(rest))).otherwise(out)
        return out

    return F.array_join(F.transform(parts, fill), "")


def draw_plan(items: DataFrame, n_samples: int, base_seed: int) -> DataFrame:
    """Every item times every sample index, with its draw seed."""
    return items.withColumn("sample_index", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1)))).withColumn(
        "sample_seed", identity.draw_seed(F.lit(base_seed), F.col("sample_index"))
    )


def remaining_draws(plan: DataFrame, done: DataFrame, keys: Sequence[str] = ("id", "sample_index")) -> DataFrame:
    """Planned draws without a finished response."""
    return plan.join(done.select(*keys), list(keys), "left_anti")


def join_cell_config(cells: DataFrame, models: DataFrame, tasks: DataFrame, decoding: DataFrame) -> DataFrame:
    """Cells with their model, task and decoding settings; all four are configuration tables.

    Decoding defaults apply where a setting is missing.
    """
    out = (
        cells.join(models, "model_config", "left").join(tasks, "task_config", "left")
        .join(decoding, "decoding_config", "left")
    )
    return out.withColumns({
        "temperature": F.coalesce("temperature", F.lit(0.6)),
        "top_p": F.coalesce("top_p", F.lit(0.95)),
        "max_tokens": F.coalesce("max_tokens", F.lit(32768)),
        "prompt_template_file": template_file(F.col("prompt_profile"), F.col("task_name"), F.col("prompt_template_file")),
    })


def with_provenance(df: DataFrame, *, at: Column, git_commit: str, hash_column: Column) -> DataFrame:
    """Run id, time, commit, config hash and template version columns."""
    return df.withColumns({
        "run_id": identity.run_id(F.col("cell_id"), F.col("seed"), at),
        "timestamp": F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'"),
        "git_commit": F.lit(git_commit),
        "config_hash": hash_column,
        "prompt_template_version": F.element_at(F.split(F.col("prompt_template_file"), "/"), -1),
        "schema_version": F.lit("raw_response.v1"),
    })
