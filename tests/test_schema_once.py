"""Compiled schemas take a member once and read no container to name its kind."""

import json

from evalweave.operators import schema

RULES = {"type": "object", "required": ["lines"], "properties": {"lines": {"type": "array", "minItems": 1, "maxItems": 3, "items": {
    "type": "object", "required": ["qty"], "properties": {"qty": {"type": "integer", "maximum": 45}, "tag": {"type": ["array", "null"]}}}}}}
CASES = [
    ({"lines": [{"qty": 1, "tag": None}, {"tag": [1, {"a": 2}]}, {"qty": 50, "tag": "x"}]}, [
        "lines[1].qty: required property missing", "lines[2].qty: is above its maximum", "lines[2].tag: is not of type array/null"]),
    ({"lines": {"qty": 1}}, ["lines: is not of type array"]), ({"lines": []}, ["lines: has too few items"]),
    ({"lines": [1, [], {"qty": {"qty": 1}}, None]}, [
        "lines[0]: is not of type object", "lines[1]: is not of type object", "lines[2].qty: is not of type integer",
        "lines[3]: is not of type object", "lines: has too many items"]),
    ({}, ["lines: required property missing"]), ([], ["row: is not of type object"]),
]


def test_members_are_taken_once(spark):
    df = spark.createDataFrame([(k, json.dumps(doc)) for k, (doc, _) in enumerate(CASES)], "k long, value string")
    found = schema.with_schema_errors(df, RULES)
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("$['qty']") == 1 and text.count("$['lines']") == 1 and "regexp_replace" not in text
    assert {r.k: r.errors for r in found.collect()} == {k: want for k, (_, want) in enumerate(CASES)}
