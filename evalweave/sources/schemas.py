"""Schemas of response rows and the validation rules of stored artifacts."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "long": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType()}

# Superset of the columns that single- and multi-sample response rows carry, by type.
_COLUMNS = {
    "string": """id problem gold_solution gold_letter gold_answer subject level run_id timestamp git_commit
        config_hash prompt_template_version prompt_template_file dataset_id dataset_split schema_version
        input_text_hash prompt completion finish_reason stop_reason cell_id model_path quant_config task
        confidence_source""",
    "double": """latency_sec time_to_first_token_sec peak_vram_gb vram_before_gb vram_after_gb vram_max_gb
        gpu_util_mean gpu_util_max power_watts_mean power_watts_max energy_joules tokens_per_second
        decode_tokens_per_second seconds_per_output_token tokens_per_joule decoding_temperature decoding_top_p
        decoding_repetition_penalty confidence""",
    "long": """prompt_tokens completion_tokens total_tokens completion_chars decoding_max_tokens max_tokens
        max_model_len""",
    "int": "seed batch_size sample_index sample_seed n_samples",
    "boolean": "truncated",
}
RESPONSES = T.StructType(
    [T.StructField(n, _TYPES[t]) for t, names in _COLUMNS.items() for n in names.split()]
    + [T.StructField("choices", T.MapType(T.StringType(), T.StringType()))]
)
SCORED = T.StructType(
    RESPONSES.fields
    + [T.StructField(n, _TYPES[t]) for n, t in {
        "pred_answer": "string", "correct": "boolean", "boxed_answer_present": "boolean",
        "answer_parse_success": "boolean", "reasoning_steps": "int", "completion_tokens_est": "long",
        "empty_completion": "boolean", "confidence_value": "double", "confidence_valid_for_calibration": "boolean",
    }.items()]
)


def _rules(required: str, **types: str) -> dict[str, dict[str, object]]:
    """Rules from a field list per type; a trailing '?' also allows null."""
    out: dict[str, dict[str, object]] = {}
    for kind, names in types.items():
        for name in names.split():
            allowed = kind.split("_or_")
            if name.endswith("?"):
                name, allowed = name[:-1], [*allowed, "null"]
            out[name] = {"types": allowed}
    for name in required.split():
        out.setdefault(name, {})["required"] = True
    return out


# Fields of the three stored artifact kinds.
RESPONSE_RULES = _rules(
    "id prompt completion cell_id task seed run_id git_commit config_hash prompt_template_version",
    string="""run_id timestamp git_commit config_hash model_revision? dataset_revision? prompt_template_version
        prompt_template_file input_text_hash problem gold_solution gold_letter prompt completion finish_reason?
        cell_id quant_config task backend_version?""",
    string_or_integer="id",
    boolean="truncated?",
    integer="prompt_tokens? completion_tokens? seed decoding_max_tokens?",
    number="""latency_sec? time_to_first_token_sec? peak_vram_gb? decoding_temperature? decoding_top_p?
        decoding_repetition_penalty?""",
)
SUMMARY_RULES = _rules(
    "n pass_at_1 cell_id",
    string="cell_id schema_version",
    integer="n num_correct",
    number="""pass_at_1 pass_at_1_ci95_low pass_at_1_ci95_high truncation_rate parse_failure_rate cost_of_pass
        cost_per_correct_seconds brier_score aurc""",
)
SUMMARY_RULES["n"]["minimum"] = 0
SUMMARY_RULES["pass_at_1"].update(minimum=0, maximum=1)
CELL_RULES = _rules(
    "cell_id model_config task_config quant_config seed",
    string="cell_id model_config task_config quant_config decoding_config prompt_profile notes",
    integer="seed",
)
CELL_RULES["cell_id"]["pattern"] = "^[a-z0-9_]+$"
CELL_RULES["prompt_profile"]["enum"] = ["reproduction", "sober", "default"]
CELL_RULES["seed"]["minimum"] = 0


def document(rules: dict[str, dict[str, object]]) -> dict:
    """The rules as a JSON Schema document, for ``operators.schema``."""
    fields = {}
    for name, rule in rules.items():
        types = rule.get("types")
        fields[name] = {k: v for k, v in rule.items() if k not in ("types", "required")} | ({"type": list(types)} if types else {})
    return {"type": "object", "required": [n for n, r in rules.items() if r.get("required")], "properties": fields}
