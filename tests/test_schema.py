"""JSON Schema documents compiled to columns."""

import json

import pytest

from evalweave.operators import gates, schema
from evalweave.sources import schemas

NESTED = {
    "$schema": "http://json-schema.org/draft-07/schema#", "type": "object", "title": "cell", "required": ["cell_id", "decoding"],
    "definitions": {"share": {"type": "number", "minimum": 0, "maximum": 1}},
    "properties": {
        "cell_id": {"type": "string", "pattern": "^[a-z0-9_]+$", "maxLength": 8},
        "decoding": {"type": "object", "required": ["top_p"], "additionalProperties": False, "properties": {
            "top_p": {"$ref": "#/definitions/share"}, "temperature": {"type": ["number", "null"], "exclusiveMinimum": -1}}},
        "steps": {"type": "array", "minItems": 1, "maxItems": 3, "items": {"type": "object", "required": ["k"], "properties": {
            "k": {"type": "integer"}, "share": {"$ref": "#/definitions/share"}}}},
        "profile": {"enum": ["a", 1, None, True]}, "kind": {"const": "x"},
        "either": {"anyOf": [{"type": "string"}, {"type": "integer", "minimum": 5}]}, "never": {"not": {"type": "string"}},
    },
}
BASE = {"cell_id": "ab", "decoding": {"top_p": 0.5}}
CASES = [
    (BASE, []),
    ({"cell_id": "A b"}, ["cell_id: does not match its pattern", "decoding: required property missing"]),
    ({**BASE, "cell_id": "abcdefghi"}, ["cell_id: is too long"]),
    ({**BASE, "cell_id": 7}, ["cell_id: is not of type string"]),
    ({**BASE, "decoding": {"top_p": 1.5, "other": 1}}, ["decoding.other: is not allowed", "decoding.top_p: is above its maximum"]),
    ({**BASE, "decoding": {"temperature": -1}}, ["decoding.temperature: is not above its bound", "decoding.top_p: required property missing"]),
    ({**BASE, "decoding": {"top_p": 0, "temperature": None}}, []),
    ({**BASE, "decoding": []}, ["decoding: is not of type object"]),
    ({**BASE, "steps": []}, ["steps: has too few items"]),
    ({**BASE, "steps": [{"k": 1}, {"k": 1.5, "share": 2}, {}, 4]}, [
        "steps: has too many items", "steps[1].k: is not of type integer", "steps[1].share: is above its maximum",
        "steps[2].k: required property missing", "steps[3]: is not of type object"]),
    ({**BASE, "steps": [{"k": 2.0}]}, []),
    ({**BASE, "profile": True}, []), ({**BASE, "profile": 1.0}, []), ({**BASE, "profile": None}, []),
    ({**BASE, "profile": "b"}, ["profile: is not an allowed value"]), ({**BASE, "profile": False}, ["profile: is not an allowed value"]),
    ({**BASE, "kind": "y"}, ['kind: is not "x"']),
    ({**BASE, "either": 3}, ["either: fits none of the choices"]), ({**BASE, "either": 6}, []),
    ({**BASE, "never": "s"}, ["never: is excluded"]), ({**BASE, "never": 1}, []),
    ([1], ["row: is not of type object"]),
]


def test_nested_documents(spark):
    rows = [(k, json.dumps(doc), want) for k, (doc, want) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "k long, value string, want array<string>")
    got = schema.with_schema_errors(df, NESTED).collect()
    assert {r.k: sorted(r.errors) for r in got} == {r.k: sorted(r.want) for r in got}


def test_malformed_and_null(spark):
    df = spark.createDataFrame([("{",), (None,), ("",)], "value string")
    assert all(r.errors == ["row: not valid JSON"] for r in schema.with_schema_errors(df, json.dumps(NESTED)).collect())


def test_unsupported_and_endless():
    for wrong in ({"oneOf": []}, {"properties": {"a": {"dependencies": {}}}}, {"enum": [{}]}, {"$ref": "other.json"}, {"properties": {"a": {"$ref": "#"}}}):
        with pytest.raises(ValueError):
            from pyspark.sql import functions as F
            schema.messages(F.lit(None).cast("variant"), wrong, F.lit("row: "), wrong)


@pytest.mark.parametrize("rules", [schemas.RESPONSE_RULES, schemas.SUMMARY_RULES, schemas.CELL_RULES])
def test_stored_artifacts(spark, rules):
    """The three artifact kinds as schema documents give the messages of the rule lists."""
    good = {}
    for name, rule in rules.items():
        if rule.get("required"):
            kind = (rule.get("types") or ["string"])[0]
            good[name] = {"string": "abc", "integer": 1, "number": 0.5, "boolean": True}[kind]
    docs = [good] + [{**good, name: v} for name in rules for v in (None, "A b!", 3, -2, 1.5, True, [1], {"a": 1})] + [
        {k: v for k, v in good.items() if k != name} for name in good]
    df = spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(docs)], "k long, value string")
    got = schema.with_schema_errors(gates.with_row_errors(df, rules, name="listed"), schemas.document(rules)).collect()
    assert any(r.errors for r in got) and all(sorted(r.errors) == sorted(r.listed) for r in got)
