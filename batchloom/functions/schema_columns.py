"""JSON Schemas as column expressions over VARIANT: validation inside the JVM.

``compiled`` gives a boolean column, or None for a schema that says something columns can't say alike: recursive
references, uniqueItems, enum or const of arrays and objects, and patterns beyond what Java's and Python's
regular expressions share. Those are left to ``functions.validate``, which has the same meaning throughout.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters, digits, blanks, and the signs that mean the same in both languages; no escapes, no flags, no lookaround.
_SHARED_PATTERN = re.compile(r"(?:[A-Za-z0-9 _,:;/@#%&=<>~'\"!-]|[.^$|*+]|\?(?![=!<:])|\((?!\?)|\)|\{[0-9]+(?:,[0-9]*)?\}|\[\^?[A-Za-z0-9 _,:;/@#%=.-]+\])*")
_EXACT = 1 << 53  # integers below are doubles


class _Beyond(Exception):
    """Not expressible."""


def strict_variant(text: Column) -> Column:
    """The text as VARIANT, null unless all of it is one JSON value.

    Spark's parser ignores what follows a value; inside brackets and inside an object nothing that isn't one value
    passes both.
    """
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    named = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when((F.size(listed) == 1) & named.isNotNull(), F.try_element_at(listed, F.lit(1)))


def _pattern(pattern: str) -> str:
    if not _SHARED_PATTERN.fullmatch(pattern):
        raise _Beyond
    re.compile(pattern)
    return f"(?d){pattern}"  # only a line feed ends a line, as in Python


def _finite(bound: Any) -> Any:
    if isinstance(bound, bool) or not isinstance(bound, (int, float)) or abs(bound) >= _EXACT:
        raise _Beyond
    return float(bound)


class _Value:
    """Views of one VARIANT column."""

    def __init__(self, v: Column):
        self.v = v
        self.null = v.isNull() | F.is_variant_null(v)
        self.kind = F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
        self.array = F.try_variant_get(v, "$", "array<variant>")
        self.map = F.try_variant_get(v, "$", "map<string,variant>")
        self.number = F.try_variant_get(v, "$", "double")
        self.text = F.try_variant_get(v, "$", "string")
        self.is_array, self.is_object = self.kind.startswith("ARRAY"), self.kind.startswith("OBJECT")
        self.is_text, self.is_bool = self.kind == "STRING", self.kind == "BOOLEAN"
        self.is_number = self.kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")

    def of(self, kind: str) -> Column:
        if kind == "integer":
            return self.is_number & (self.number == F.floor(self.number))
        return {"number": self.is_number, "string": self.is_text, "boolean": self.is_bool, "null": self.null, "array": self.is_array, "object": self.is_object}[kind]

    def equals(self, value: Any) -> Column:
        if value is None:
            return self.null
        if isinstance(value, bool):
            return self.is_bool & (F.try_variant_get(self.v, "$", "boolean") == value)
        if isinstance(value, (int, float)):
            return self.is_number & (self.number == _finite(value))
        if isinstance(value, str):
            return self.is_text & (self.text == value)
        raise _Beyond


def _target(root: Any, ref: str) -> Any:
    at = root
    for step in ref.removeprefix("#").split("/")[1:]:
        step = step.replace("~1", "/").replace("~0", "~")
        at = at[int(step)] if isinstance(at, list) else at[step]
    return at


def _check(v: Column, schema: Any, root: Any, seen: tuple[str, ...]) -> Column:
    if isinstance(schema, bool):
        return F.lit(schema)
    own, all_of = _Value(v), []
    inner: Callable[[Column, Any], Column] = lambda x, s: _check(x, s, root, seen)

    def when(is_kind: Column, holds: Column) -> None:
        all_of.append(~is_kind | F.coalesce(holds, F.lit(False)))

    def some(parts: list[Column]) -> Column:
        out = F.lit(False)
        for p in parts:
            out = out | p
        return out

    kinds = schema.get("type")
    if kinds is not None:
        all_of.append(some([F.coalesce(own.of(k), F.lit(False)) for k in ([kinds] if isinstance(kinds, str) else kinds)]))
    if "enum" in schema:
        all_of.append(some([F.coalesce(own.equals(x), F.lit(False)) for x in schema["enum"]]))
    if "const" in schema:
        all_of.append(F.coalesce(own.equals(schema["const"]), F.lit(False)))
    if "$ref" in schema:
        if schema["$ref"] in seen:
            raise _Beyond
        all_of.append(_check(v, _target(root, schema["$ref"]), root, (*seen, schema["$ref"])))
    all_of += [inner(v, s) for s in schema.get("allOf", [])]
    if "anyOf" in schema:
        all_of.append(some([inner(v, s) for s in schema["anyOf"]]))
    if "oneOf" in schema:
        hits = F.lit(0)
        for s in schema["oneOf"]:
            hits = hits + inner(v, s).cast("int")
        all_of.append(hits == 1)
    if "not" in schema:
        all_of.append(~inner(v, schema["not"]))
    for name, test in (("minimum", lambda n, b: n >= b), ("maximum", lambda n, b: n <= b), ("exclusiveMinimum", lambda n, b: n > b), ("exclusiveMaximum", lambda n, b: n < b)):
        if name in schema:
            when(own.is_number, test(own.number, _finite(schema[name])))
    if schema.get("multipleOf"):
        turns = own.number / _finite(schema["multipleOf"])
        when(own.is_number, F.abs(turns - F.round(turns)) <= 1e-9)
    size = F.char_length(own.text)
    if "minLength" in schema:
        when(own.is_text, size >= schema["minLength"])
    if "maxLength" in schema:
        when(own.is_text, size <= schema["maxLength"])
    if "pattern" in schema:
        when(own.is_text, own.text.rlike(_pattern(schema["pattern"])))
    if schema.get("uniqueItems"):
        raise _Beyond
    if "minItems" in schema:
        when(own.is_array, F.size(own.array) >= schema["minItems"])
    if "maxItems" in schema:
        when(own.is_array, F.size(own.array) <= schema["maxItems"])
    head = schema.get("prefixItems", [])
    for k, s in enumerate(head):
        when(own.is_array & (F.size(own.array) > k), inner(F.try_element_at(own.array, F.lit(k + 1)), s))
    if "items" in schema:
        rest = F.slice(own.array, len(head) + 1, F.greatest(F.size(own.array), F.lit(0))) if head else own.array
        when(own.is_array, F.forall(rest, lambda x: inner(x, schema["items"])))
    _object(own, schema, inner, when)
    out = F.lit(True)
    for part in all_of:
        out = out & part
    return out


def _object(own: _Value, schema: dict, inner: Callable[[Column, Any], Column], when: Callable[[Column, Column], None]) -> None:
    known, patterns = schema.get("properties", {}), {_pattern(p): s for p, s in schema.get("patternProperties", {}).items()}
    if "minProperties" in schema:
        when(own.is_object, F.size(own.map) >= schema["minProperties"])
    if "maxProperties" in schema:
        when(own.is_object, F.size(own.map) <= schema["maxProperties"])
    for name in schema.get("required", []):
        when(own.is_object, F.map_contains_key(own.map, name))
    for name, s in known.items():
        when(own.is_object & F.coalesce(F.map_contains_key(own.map, name), F.lit(False)), inner(F.try_element_at(own.map, F.lit(name)), s))
    def named_so(p: str, s: Any) -> Callable[[Column], Column]:
        return lambda entry: ~entry["key"].rlike(p) | inner(entry["value"], s)

    for p, s in patterns.items():
        when(own.is_object, F.forall(F.map_entries(own.map), named_so(p, s)))
    more = schema.get("additionalProperties", True)
    if more is not True:

        def fits(entry: Column) -> Column:
            told = entry["key"].isin(list(known)) if known else F.lit(False)
            for p in patterns:
                told = told | entry["key"].rlike(p)
            return told | inner(entry["value"], more)

        when(own.is_object, F.forall(F.map_entries(own.map), fits))


def compiled(v: Column, schema: dict | bool) -> Column | None:
    """Whether a VARIANT value meets a schema; None if the schema can't be told in columns."""
    try:
        json.dumps(schema)
        return _check(v, schema, schema, ())
    except (_Beyond, TypeError):
        return None
