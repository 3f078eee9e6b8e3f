"""From source records to requests: built-in fields, user mappers, normalisation.

A request is JSON text; an error is text beside it, and exactly one of both is null.
"""

from __future__ import annotations

import hashlib
import importlib
import inspect
import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom.schemas import ENDPOINTS

BUILTIN_FINGERPRINT = hashlib.sha256(b"batchloom.builtin_mapping.v1").hexdigest()
NO_FIELD = "Generation rows require 'prompt', 'messages', or 'responses_input'."
_FIELDS = ("responses_input", "messages", "prompt")


def builtin_input(record: Column) -> Column:
    """The first field that isn't null among responses_input, messages and prompt, as JSON text.

    Empty strings and lists count.
    """
    v = F.try_parse_json(record)

    def field(name: str) -> Column:
        found = F.try_variant_get(v, f"$.{name}", "variant")
        return F.when(found.isNotNull() & ~F.is_variant_null(found), F.to_json(found))

    return F.coalesce(*[field(n) for n in _FIELDS])


def truthy_input(record: Column) -> Column:
    """The bench's rule: the first field that isn't empty either."""
    v = F.try_parse_json(record)

    def field(name: str) -> Column:
        text = F.to_json(F.try_variant_get(v, f"$.{name}", "variant"))
        return F.when(~text.isin('""', "[]", "{}", "null", "false", "0"), text)

    return F.coalesce(*[field(n) for n in _FIELDS])


def check_endpoint(endpoint: str) -> str:
    if endpoint not in ENDPOINTS:
        raise ValueError(f"unknown endpoint {endpoint!r}; known: {', '.join(ENDPOINTS)}")
    return endpoint


def normalised(source: Column, endpoint: str) -> Column:
    """struct(request, error) of an input (JSON text) for an endpoint.

    chat: text becomes one user message, a list of objects with ``role`` stays; text: text only;
    responses: text, or an object with ``input``.
    """
    check_endpoint(endpoint)
    v = F.try_parse_json(source)
    kind = F.schema_of_variant(v)
    is_text = F.coalesce(kind == "STRING", F.lit(False))
    if endpoint == "responses":
        has = F.coalesce(F.startswith(kind, F.lit("OBJECT<")) & F.try_variant_get(v, "$.input", "variant").isNotNull(), F.lit(False))
        request = F.when(is_text, F.concat(F.lit('{"input":'), source, F.lit("}"))).when(has, source)
        error = "Responses requests require a string or a dictionary with an 'input' key."
    elif endpoint == "text_completion":
        request, error = F.when(is_text, source), "Text completion expects a string input."
    else:
        messages = F.try_variant_get(v, "$", "array<variant>")
        roles = F.startswith(kind, F.lit("ARRAY<")) & F.forall(
            messages,
            lambda m: F.startswith(F.schema_of_variant(m), F.lit("OBJECT<")) & F.try_variant_get(m, "$.role", "variant").isNotNull(),
        )
        request = F.when(
            is_text, F.concat(F.lit('[{"role":"user","content":'), source, F.lit("}]")),
        ).when(F.coalesce(roles, F.lit(False)), source)
        error = "Chat completion expects either a string or a list of message dictionaries."
    return F.struct(request.alias("request"), F.when(request.isNull(), F.lit(error)).alias("error"))


def embedding_inputs(column: Column) -> Column:
    """An array of texts from a value or an array of values."""
    return F.transform(column, lambda x: x.cast("string"))


def chat_messages(df: DataFrame, key: str, order: str, role: str = "role", text: str = "text") -> DataFrame:
    """One message list for each conversation, in turn order."""
    lists = df.groupBy(key).agg(
        F.array_sort(
            F.collect_list(F.struct(F.col(order).alias("turn"), F.col(role).alias("role"), F.col(text).alias("content")))
        ).alias("m")
    )
    return lists.select(key, F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def load_mapper(spec: str) -> Callable[[dict], Any]:
    """``package.module:function``."""
    module, colon, name = spec.rpartition(":")
    if not (module and colon and name):
        raise ValueError(f"a mapper is named 'package.module:function', not {spec!r}")
    found = getattr(importlib.import_module(module), name, None)
    if not callable(found):
        raise ValueError(f"{spec!r} names nothing callable")
    return found


def mapper_fingerprint(mapper: Callable | None, spec: str | None = None) -> str:
    """Ties a run to its mapping: the source of the mapper's module, of itself, or its bytecode."""
    if mapper is None:
        return BUILTIN_FINGERPRINT
    body = None
    for thing in (inspect.getmodule(mapper), mapper):
        try:
            body = body or (inspect.getsource(thing) if thing is not None else None)
        except (OSError, TypeError):
            continue
    code = getattr(mapper, "__code__", None)
    body = body or repr((getattr(code, "co_code", None), getattr(code, "co_consts", None), getattr(mapper, "__defaults__", None)))
    name = f"{getattr(mapper, '__module__', '')}.{getattr(mapper, '__qualname__', type(mapper).__qualname__)}"
    return hashlib.sha256(json.dumps([spec, name, body]).encode()).hexdigest()


def map_one(mapper: Callable[[dict], Any], record: str) -> tuple[str | None, str | None, str | None]:
    """input, metadata and error of one record; whatever the mapper does wrong is an error row."""
    try:
        result = mapper(json.loads(record))
        if not isinstance(result, dict):
            raise ValueError(f"Mapper must return a dict, got {type(result).__name__!r}")
        if "input" not in result:
            raise KeyError("Mapper return value is missing required key 'input'")
        meta = result.get("metadata")
        if meta is not None and not isinstance(meta, dict):
            raise TypeError("Mapper 'metadata' must be a dict when provided.")
        try:
            meta = None if meta is None else json.dumps(meta, ensure_ascii=False)
        except (TypeError, ValueError) as error:
            raise TypeError(f"Mapper 'metadata' must be JSON serializable: {error}") from error
        return json.dumps(result["input"], ensure_ascii=False), meta, None
    except Exception as error:  # noqa: BLE001
        return None, None, str(error) or type(error).__name__


def prepared(
    source: DataFrame, endpoint: str, mapper: Callable[[dict], Any] | None = None, native: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Adds request, metadata and error; the first error wins: parsing, mapping, normalisation.

    ``mapper`` takes and returns dicts and runs in Arrow batches; ``native`` takes the source frame
    and adds ``input`` (JSON text) and ``metadata`` by column expressions.
    """
    check_endpoint(endpoint)
    if native is not None:
        mapped = native(source).withColumn("map_error", F.lit(None).cast("string"))
        if "metadata" not in mapped.columns:
            mapped = mapped.withColumn("metadata", F.lit(None).cast("string"))
    elif mapper is not None:

        @F.pandas_udf("struct<input:string,metadata:string,map_error:string>")
        def run(records: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for s in records:
                yield pd.DataFrame(
                    [(None, None, None) if r is None else map_one(mapper, r) for r in s], columns=["input", "metadata", "map_error"],
                )

        mapped = source.withColumn("m", run("record")).select("*", "m.*").drop("m")
    else:
        mapped = source.withColumn("input", builtin_input(F.col("record"))).withColumn("metadata", F.lit(None).cast("string"))
        mapped = mapped.withColumn("map_error", F.when(F.col("input").isNull(), F.lit(NO_FIELD)))
    done = mapped.withColumn("n", normalised(F.col("input"), endpoint))
    problem = F.coalesce("parse_error", "map_error", "n.error")
    return done.withColumn(
        "request", F.when(problem.isNull(), F.col("n.request")),
    ).withColumn("error", problem).drop("n", "input", "map_error")
