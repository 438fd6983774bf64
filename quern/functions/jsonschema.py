"""JSON Schema as one boolean Column over a VARIANT.

type, enum, const, allOf, anyOf, oneOf, not, $ref (within the schema, not to a
part that holds it), properties, required, additionalProperties (false or a
schema), minProperties, maxProperties, items, contains, minItems, maxItems,
uniqueItems, minimum, maximum, exclusiveMinimum, exclusiveMaximum, multipleOf,
minLength, maxLength, pattern and format (a few; others hold).  A keyword that
doesn't concern a value's type holds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import RequestError
from .paths import VariantField, json_path, same

KNOWN = {"type", "enum", "const", "allOf", "anyOf", "oneOf", "not", "$ref", "$defs", "definitions", "properties", "required", "additionalProperties", "minProperties", "maxProperties", "items", "contains", "minItems", "maxItems", "uniqueItems", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength", "pattern", "format", "title", "description", "$schema", "$id", "$comment", "default", "examples"}
FORMATS = {"date": r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$", "date-time": r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$", "email": r"^[^@\s]+@[^@\s]+$", "ipv4": r"^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.|$)){4}$", "uuid": r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"}


def referred(root: dict, ref: str, seen: tuple[str, ...]) -> dict:
    """The part of the schema that a "#/..." reference names."""
    if not isinstance(ref, str) or not ref.startswith("#") or ref in seen:
        raise RequestError(f"Unsupported reference: {ref!r}")
    part = root
    for name in ref[1:].strip("/").split("/") if ref.strip("#/") else []:
        name = name.replace("~1", "/").replace("~0", "~")
        if not isinstance(part, dict) or name not in part:
            raise RequestError(f"Unknown reference: {ref!r}")
        part = part[name]
    return part


def of_type(f: VariantField, name: str) -> Column:
    number = f.number.isNotNull()
    tests = {"string": f.string.isNotNull(), "number": number, "integer": number & (f.number == F.floor(f.number)), "boolean": f.boolean.isNotNull(), "null": f.null, "array": f.array.isNotNull(), "object": F.startswith(f.kind, F.lit("OBJECT"))}
    if name not in tests:
        raise RequestError(f"Unknown type: {name!r}")
    return F.coalesce(tests[name], F.lit(False))


def exactly(f: VariantField, value) -> Column:
    """Equality with a constant, strings letter by letter."""
    return f.string == F.lit(value) if isinstance(value, str) else same(f, value)


def valid(value: Column, schema: dict | bool, root: dict | None = None, seen: tuple[str, ...] = ()) -> Column:
    """True where the value meets the schema; a missing value does."""
    if isinstance(schema, bool):
        return F.lit(True) if schema else F.coalesce(F.schema_of_variant(value).isNull(), F.lit(True))
    root = schema if root is None else root
    inside = lambda x, part: valid(x, part, root, seen)
    unknown = sorted(set(schema) - KNOWN)
    if unknown:
        raise RequestError(f"Unsupported schema keyword: {unknown[0]}")
    f = VariantField(value)
    parts: list[Column] = []
    if "type" in schema:
        names = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        parts.append(reduce(lambda a, b: a | b, [of_type(f, n) for n in names]))
    if "enum" in schema:
        parts.append(reduce(lambda a, b: a | b, [F.coalesce(f.null if x is None else same(f, x), F.lit(False)) for x in schema["enum"]], F.lit(False)))
    if "const" in schema:
        parts.append(F.coalesce(f.null if schema["const"] is None else exactly(f, schema["const"]), F.lit(False)))
    if "$ref" in schema:
        parts.append(valid(value, referred(root, schema["$ref"], seen), root, (*seen, schema["$ref"])))
    if "allOf" in schema:
        parts += [inside(value, x) for x in schema["allOf"]]
    if "anyOf" in schema:
        parts.append(reduce(lambda a, b: a | b, [inside(value, x) for x in schema["anyOf"]]))
    if "oneOf" in schema:
        parts.append(reduce(lambda a, b: a + b, [inside(value, x).cast("int") for x in schema["oneOf"]]) == 1)
    if "not" in schema:
        parts.append(~inside(value, schema["not"]))
    if "multipleOf" in schema:
        times = f.number / F.lit(float(schema["multipleOf"]))
        parts.append(f.number.isNull() | (F.abs(times - F.round(times)) < 1e-9))
    if schema.get("format") in FORMATS:
        parts.append(f.string.isNull() | F.rlike(f.string, F.lit(FORMATS[schema["format"]])))
    bounds = {"minimum": lambda x: f.number >= x, "maximum": lambda x: f.number <= x, "exclusiveMinimum": lambda x: f.number > x, "exclusiveMaximum": lambda x: f.number < x, "minLength": lambda x: F.length(f.string) >= x, "maxLength": lambda x: F.length(f.string) <= x, "pattern": lambda x: F.rlike(f.string, F.lit(x)), "minItems": lambda x: F.size(f.array) >= x, "maxItems": lambda x: F.size(f.array) <= x}
    holders = {"minLength": f.string, "maxLength": f.string, "pattern": f.string, "minItems": f.array, "maxItems": f.array}
    for word, test in bounds.items():
        if word in schema:
            parts.append(holders.get(word, f.number).isNull() | test(schema[word]))
    is_object = F.startswith(f.kind, F.lit("OBJECT"))
    for name in schema.get("required", ()):
        parts.append(~is_object | F.schema_of_variant(F.try_variant_get(value, json_path([name]), "variant")).isNotNull())
    for name, inner in schema.get("properties", {}).items():
        parts.append(inside(F.try_variant_get(value, json_path([name]), "variant"), inner))
    members = F.try_variant_get(value, "$", "map<string,variant>")
    known = list(schema.get("properties", {}))
    if schema.get("additionalProperties") is False:
        parts.append(~is_object | F.forall(F.map_keys(members), lambda k: k.isin(known)))
    elif isinstance(schema.get("additionalProperties"), dict):
        parts.append(~is_object | F.forall(F.map_entries(members), lambda e: e["key"].isin(known) | inside(e["value"], schema["additionalProperties"])))
    if "minProperties" in schema:
        parts.append(~is_object | (F.size(members) >= schema["minProperties"]))
    if "maxProperties" in schema:
        parts.append(~is_object | (F.size(members) <= schema["maxProperties"]))
    if "items" in schema:
        parts.append(f.array.isNull() | F.forall(f.array, lambda x: inside(x, schema["items"])))
    if "contains" in schema:
        parts.append(f.array.isNull() | F.exists(f.array, lambda x: inside(x, schema["contains"])))
    if schema.get("uniqueItems"):
        texts = F.transform(f.array, lambda x: F.to_json(x))
        parts.append(f.array.isNull() | (F.size(F.array_distinct(texts)) == F.size(texts)))
    whole = reduce(lambda a, b: a & b, parts) if parts else F.lit(True)
    return f.kind.isNull() | F.coalesce(whole, F.lit(False))
