"""JSON Schema documents as column rules.

A draft-07 schema compiles to one array of messages per row, so validation is a projection: no row is
parsed twice and no Python runs.  Supported: type, required, properties, additionalProperties (false or a
schema), items (one schema), enum and const of scalars, pattern, minimum, maximum, exclusiveMinimum,
exclusiveMaximum, minLength, maxLength, minItems, maxItems, allOf, anyOf, not, and local ``$ref``.  Other
keywords that constrain raise an error; titles, defaults and the like are passed over.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.operators.gates import json_type

# Keywords without an effect on validity.
NOTES = frozenset("$schema $id $comment title description default examples definitions format readOnly writeOnly".split())
KNOWN = frozenset("""type required properties additionalProperties items enum const pattern minimum maximum exclusiveMinimum
    exclusiveMaximum minLength maxLength minItems maxItems allOf anyOf not $ref""".split())
DEPTH = 12


def resolved(schema: Mapping, root: Mapping) -> Mapping:
    """The schema that a local ``$ref`` names; in draft-07 nothing beside a reference counts."""
    for _ in range(DEPTH):
        if "$ref" not in schema:
            return schema
        name = schema["$ref"]
        if not name.startswith("#"):
            raise ValueError(f"only local references are supported: {name}")
        schema = root
        for part in filter(None, name[1:].split("/")):
            schema = schema[part.replace("~1", "/").replace("~0", "~")]
    raise ValueError("references do not end")


def _bound(value: Column, body) -> Column:
    """``body`` over a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _literal(value: object) -> str:
    return json.dumps(value, sort_keys=True)


def _same(value: Column, kind: Column, wanted: object) -> Column:
    """Whether a variant equals a JSON scalar; 1 and 1.0 are equal, 1 and true are not."""
    text, number = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double")
    if wanted is None:
        return kind == "null"
    if isinstance(wanted, bool):
        return (kind == "boolean") & (F.try_variant_get(value, "$", "boolean") == F.lit(wanted))
    if isinstance(wanted, (int, float)):
        return kind.isin("integer", "number") & (number == F.lit(float(wanted)))
    if isinstance(wanted, str):
        return (kind == "string") & (text == F.lit(wanted))
    raise ValueError("only scalars may be listed in enum and const")


def messages(
    value: Column, schema: Mapping | bool, at: Column, root: Mapping, depth: int = 0, kind: Column | None = None
) -> Column:
    """array<string> of the violations of a variant that is present; ``at`` is its place, such as ``a.b[2]: ``.

    The value is used more than once: give a column or a bound one, and its kind if it is known.
    """
    none = F.array().cast("array<string>")
    if depth > DEPTH:
        raise ValueError("the schema is nested too deeply or refers to itself")
    if isinstance(schema, bool):
        return none if schema else F.array(F.concat(at, F.lit("is not allowed")))
    schema = resolved(schema, root)
    if unknown := set(schema) - KNOWN - NOTES:
        raise ValueError(f"unsupported keywords: {sorted(unknown)}")
    if kind is not None:
        return _checked(value, kind, None, schema, at, root, depth)
    elements = F.try_variant_get(value, "$", "array<variant>") if _wants_array(schema) else None
    return _held([elements], lambda e: _bound(_kind(value, schema, e), lambda k: _checked(value, k, e, schema, at, root, depth)))


def _checked(value: Column, kind: Column, elements: Column | None, schema: Mapping, at: Column, root: Mapping, depth: int) -> Column:
    """Messages of a value of known kind; members are taken once, and so are their kinds."""
    fields = schema.get("properties", {})
    names = list(dict.fromkeys([*schema.get("required", []), *fields]))
    subs = [resolved(fields[n], root) if isinstance(fields.get(n), Mapping) else None for n in names]
    members = F.when(kind == "object", F.array(*[_member(value, n) for n in names])) if names else None
    early = [i for i, sub in enumerate(subs) if sub is not None and not _wants_array(sub)]

    def with_members(m):
        kinds = F.when(m.isNotNull(), F.array(*[_kind(m[i], subs[i]) for i in early])) if early else None
        return _held([kinds], lambda k: _messages(
            value, kind, {n: (m[i], k[early.index(i)] if i in early else None) for i, n in enumerate(names)}, elements, schema, at, root, depth))

    return _held([members], with_members)


def _wants_array(schema: Mapping) -> bool:
    return "array" in _types(schema) or bool({"items", "minItems", "maxItems"} & set(schema))


def _kind(value: Column, schema: Mapping, elements: Column | None = None) -> Column:
    """Kind of a value.  Where containers may stand, a cast tells them; a schema would be built and printed from all they hold."""
    kind = json_type(F.schema_of_variant(value))
    if elements is not None:
        kind = F.when(elements.isNotNull(), "array").otherwise(kind)
    if "object" in _types(schema) or {"properties", "required", "additionalProperties"} & set(schema):
        kind = F.when(F.try_variant_get(value, "$", "struct<>").isNotNull(), "object").otherwise(kind)
    return kind


def _types(schema: Mapping) -> set[str]:
    types = schema.get("type", [])
    return {types} if isinstance(types, str) else set(types)


def _member(value: Column, name: str) -> Column:
    return F.try_variant_get(value, "$['" + name.replace("'", "\\'") + "']", "variant")


def _held(values: list[Column | None], body) -> Column:
    """``body`` over values that are each computed once; None stays None."""
    if not values:
        return body()
    if values[0] is None:
        return _held(values[1:], lambda *rest: body(None, *rest))
    return _bound(values[0], lambda v: _held(values[1:], lambda *rest: body(v, *rest)))


def _messages(v: Column, kind: Column, members: Mapping[str, tuple[Column, Column | None]], elements: Column | None,
              schema: Mapping, at: Column, root: Mapping, depth: int) -> Column:
    none = F.array().cast("array<string>")
    lists: list[Column] = []
    single: list[tuple[Column, Column]] = []
    one = lambda bad, text: single.append((bad, F.concat(at, F.lit(text))))

    def close() -> None:
        """Lists the single messages so far; a value without a fault builds no array."""
        if single:
            found = F.array_compact(F.array(*[F.when(bad, text) for bad, text in single]))
            lists.append(F.when(reduce(or_, [F.coalesce(bad, F.lit(False)) for bad, _ in single]), found))
            single.clear()

    text, number = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "double")
    is_number, is_text = kind.isin("integer", "number"), kind == "string"
    if "type" in schema:
        types = [schema["type"]] if isinstance(schema["type"], str) else list(schema["type"])
        whole = (number == F.floor(number)) & is_number if "integer" in types else F.lit(False)  # 1.0 is an integer
        one(~(kind.isin(*types, *(["integer"] if "number" in types else [])) | F.coalesce(whole, F.lit(False))), "is not of type " + "/".join(types))
    if "enum" in schema:
        known = [_same(v, kind, w) for w in schema["enum"]]
        any_ = known[0]
        for k in known[1:]:
            any_ = any_ | k
        one(~F.coalesce(any_, F.lit(False)), "is not an allowed value")
    if "const" in schema:
        one(~F.coalesce(_same(v, kind, schema["const"]), F.lit(False)), "is not " + _literal(schema["const"]))
    for word, bad, says in (
        ("minimum", lambda b: number < b, "is below its minimum"), ("maximum", lambda b: number > b, "is above its maximum"),
        ("exclusiveMinimum", lambda b: number <= b, "is not above its bound"), ("exclusiveMaximum", lambda b: number >= b, "is not below its bound"),
    ):
        if word in schema:
            one(is_number & bad(F.lit(float(schema[word]))), says)
    if "pattern" in schema:
        one(is_text & ~text.rlike(schema["pattern"]), "does not match its pattern")
    if "minLength" in schema:
        one(is_text & (F.length(text) < schema["minLength"]), "is too short")
    if "maxLength" in schema:
        one(is_text & (F.length(text) > schema["maxLength"]), "is too long")
    fields, stem = schema.get("properties", {}), F.left(at, F.length(at) - 2)  # a place ends with ": "
    is_object, place = kind == "object", lambda name: F.concat(stem, F.lit(f".{name}: "))
    inner = lambda name: F.when(at == "row: ", F.lit(f"{name}: ")).otherwise(place(name))
    for name in schema.get("required", []):
        single.append((is_object & members[name][0].isNull(), F.concat(inner(name), F.lit("required property missing"))))
    close()
    for name, sub in fields.items():
        value, its_kind = members[name]
        lists.append(F.when(value.isNotNull(), messages(value, sub, inner(name), root, depth + 1, its_kind)))
    extra = schema.get("additionalProperties", True)
    if extra is not True and extra != {}:
        entries = F.filter(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda e: ~e["key"].isin(*fields) if fields else F.lit(True))
        where = lambda e: F.concat(F.when(at == "row: ", F.lit("")).otherwise(F.concat(stem, F.lit("."))), e["key"], F.lit(": "))
        lists.append(F.when(is_object, F.flatten(F.transform(entries, lambda e: messages(e["value"], extra, where(e), root, depth + 1)))))
    if "items" in schema:
        if not isinstance(schema["items"], (Mapping, bool)):
            raise ValueError("items must be one schema")
        spot = lambda i: F.concat(stem, F.lit("["), i.cast("string"), F.lit("]: "))
        lists.append(F.when(elements.isNotNull(), F.flatten(F.transform(
            elements, lambda x, i: messages(x, schema["items"], spot(i), root, depth + 1)))))
    if "minItems" in schema:
        one(elements.isNotNull() & (F.size(elements) < schema["minItems"]), "has too few items")
    if "maxItems" in schema:
        one(elements.isNotNull() & (F.size(elements) > schema["maxItems"]), "has too many items")
    close()
    for sub in schema.get("allOf", []):
        lists.append(messages(v, sub, at, root, depth + 1))
    if "anyOf" in schema:
        fits = [F.size(messages(v, sub, at, root, depth + 1)) == 0 for sub in schema["anyOf"]]
        ok = fits[0]
        for f in fits[1:]:
            ok = ok | f
        one(~ok, "fits none of the choices")
    if "not" in schema:
        one(F.size(messages(v, schema["not"], at, root, depth + 1)) == 0, "is excluded")
    close()
    lists = [F.coalesce(found, none) for found in lists]
    return F.flatten(F.array(*lists)) if len(lists) > 1 else lists[0] if lists else none


def with_schema_errors(lines: DataFrame, schema: Mapping | str, *, value_col: str = "value", name: str = "errors") -> DataFrame:
    """Add the violations of a JSON Schema by one JSON document per row, as an array of messages.

    ``schema`` is the document or its text.  A message starts with the place of the value, such as
    ``decoding.steps[2]: ``; ``row: `` stands for the whole document.  NULL and malformed documents have the
    one message that they are not valid JSON.  A column ``name`` is replaced.
    """
    root = json.loads(schema) if isinstance(schema, str) else schema
    doc = F.try_parse_json(F.col(value_col))
    found = _bound(doc, lambda d: F.when(d.isNull(), F.array(F.lit("row: not valid JSON"))).otherwise(messages(d, root, F.lit("row: "), root)))
    return lines.withColumn(name, found)
