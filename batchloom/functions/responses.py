"""Provider responses (JSON text) into typed columns, by VARIANT paths.

Malformed JSON gives null structs. ``'$.a.b'`` paths give null where a value is absent or
JSON null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from batchloom.functions.text import strip_blanks, thinking


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _list(v: Column, path: str) -> Column:
    return F.coalesce(_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _present(v: Column, path: str) -> Column:
    found = _get(v, path, "variant")
    return found.isNotNull() & ~F.is_variant_null(found)


def usage(v: Column) -> Column:
    """Token usage under either naming, null without usage."""
    u = _get(v, "$.usage", "variant")

    def number(name: str) -> Column:
        return F.coalesce(_get(v, f"$.usage.{name}", "bigint"), F.lit(0).cast("bigint"))

    def named(into: str, out: str) -> Column:
        return F.struct(
            number(into).alias("prompt_tokens"), number(out).alias("completion_tokens"), number("total_tokens").alias("total_tokens"),
            _get(v, f"$.usage.{out}_details.reasoning_tokens", "bigint").alias("reasoning_tokens"),
        )

    newer = _get(v, "$.usage.input_tokens", "variant").isNotNull() | _get(v, "$.usage.output_tokens", "variant").isNotNull()
    return F.when(
        u.isNotNull() & ~F.is_variant_null(u),
        F.when(newer, named("input_tokens", "output_tokens")).otherwise(named("prompt_tokens", "completion_tokens")),
    )


def _parts_text(parts: Column) -> Column:
    """Text of a list of content parts; a part without text reads ``None``."""
    return F.array_join(F.transform(parts, lambda p: F.coalesce(_get(p, "$.text"), F.lit("None"))), "")


def _choice_text(c: Column) -> Column:
    parts = _get(c, "$.message.content", "array<variant>")
    inside = F.when(parts.isNotNull(), _parts_text(parts)).otherwise(_get(c, "$.message.content"))
    return F.when(_present(c, "$.message"), inside).otherwise(_get(c, "$.text"))


def _call(t: Column) -> Column:
    has = _present(t, "$.function")
    name = F.coalesce(F.nullif(_get(t, "$.function.name"), F.lit("")), F.nullif(_get(t, "$.name"), F.lit("")), F.lit(""))
    return F.struct(
        F.coalesce(_get(t, "$.id"), F.lit("")).alias("id"), name.alias("name"),
        F.when(has, _get(t, "$.function.arguments")).otherwise(_get(t, "$.arguments")).alias("arguments"),
    )


def _or_null(calls: Column) -> Column:
    return F.when(F.size(calls) > 0, calls)


def completion(v: Column) -> Column:
    """Result of a chat or text completion: texts of all choices joined, the last finish reason."""
    choices = _list(v, "$.choices")
    text = F.array_join(F.filter(F.transform(choices, _choice_text), lambda t: t.isNotNull()), "")
    given = F.filter(F.transform(choices, lambda c: F.nullif(_get(c, "$.message.reasoning_content"), F.lit(""))), lambda t: t.isNotNull())
    joined = F.array_join(F.filter(F.transform(given, strip_blanks), lambda t: t != ""), "\n\n")
    cut = thinking(text)
    calls = F.flatten(F.transform(choices, lambda c: F.transform(_list(c, "$.message.tool_calls"), _call)))
    return F.struct(
        F.coalesce(_get(v, "$.model"), F.lit("")).alias("model_id"),
        F.when(F.size(given) > 0, text).otherwise(cut["text"]).alias("output_text"),
        F.when(F.size(given) > 0, F.nullif(joined, F.lit(""))).otherwise(cut["reasoning"]).alias("reasoning"),
        usage(v).alias("token_usage"),
        _get(F.try_element_at(choices, F.lit(-1)), "$.finish_reason").alias("finish_reason"),
        _or_null(calls).alias("tool_calls"),
        _get(v, "$.id").alias("request_id"),
    )


def responses_api(v: Column) -> Column:
    """Result of a responses-style answer: text parts of messages, and function calls."""
    outputs = _list(v, "$.output")
    kind = lambda o, k: F.coalesce(_get(o, "$.type") == k, F.lit(False))
    texts = F.flatten(
        F.transform(
            F.filter(outputs, lambda o: kind(o, "message")),
            lambda o: F.transform(
                F.filter(_list(o, "$.content"), lambda c: kind(c, "output_text")), lambda c: F.coalesce(_get(c, "$.text"), F.lit("")),
            ),
        )
    )
    calls = F.transform(
        F.filter(outputs, lambda o: kind(o, "function_call")),
        lambda o: F.struct(
            F.coalesce(_get(o, "$.id"), F.lit("")).alias("id"), F.coalesce(_get(o, "$.name"), F.lit("")).alias("name"),
            _get(o, "$.arguments").alias("arguments"),
        ),
    )
    none = F.lit(None).cast("string")
    return F.struct(
        F.coalesce(_get(v, "$.model"), F.lit("")).alias("model_id"),
        F.array_join(texts, "").alias("output_text"),
        none.alias("reasoning"),
        usage(v).alias("token_usage"),
        none.alias("finish_reason"),
        _or_null(calls).alias("tool_calls"),
        _get(v, "$.id").alias("request_id"),
    )


def generation(raw: Column, endpoint: Column | str) -> Column:
    """Result struct of a response, by its endpoint."""
    v = F.try_parse_json(raw)
    kind = F.lit(endpoint) if isinstance(endpoint, str) else endpoint
    return F.when(v.isNotNull(), F.when(kind == "responses", responses_api(v)).otherwise(completion(v)))


def embeddings(raw: Column) -> Column:
    """Array of vectors of an embedding response, in the order of its inputs."""
    v = F.try_parse_json(raw)
    return F.transform(_list(v, "$.data"), lambda d: F.coalesce(_get(d, "$.embedding", "array<double>"), F.array().cast("array<double>")))


def transcription(raw: Column) -> Column:
    v = F.try_parse_json(raw)
    return F.struct(
        F.coalesce(_get(v, "$.text"), F.lit("")).alias("text"), _get(v, "$.duration", "double").alias("duration_s"),
        _get(v, "$.language").alias("language"), _get(v, "$.id").alias("request_id"),
        F.coalesce(_get(v, "$.model"), F.lit("")).alias("model_id"),
    )


def total_usage(raw: Column) -> Column:
    return F.coalesce(_get(F.try_parse_json(raw), "$.usage.total_tokens", "bigint"), F.lit(0).cast("bigint"))


def response_headers(raw: Column) -> Column:
    v = F.try_parse_json(raw)
    return F.coalesce(_get(v, "$._response_headers", "map<string,string>"), _get(v, "$.headers", "map<string,string>"))


def deployment(raw: Column) -> Column:
    """The first of deployment, api_base, model_id, model among the hidden parameters."""
    v = F.try_parse_json(raw)
    return F.coalesce(*[F.nullif(_get(v, f"$._hidden_params.{k}"), F.lit("")) for k in ("deployment", "api_base", "model_id", "model")])


def parsed_json(text: Column) -> Column:
    """``text`` as compact JSON text, null if it isn't JSON."""
    return F.to_json(F.try_parse_json(text))


def cost(raw: Column) -> Column:
    """What the provider's library says the call cost, null if it says nothing."""
    v = F.try_parse_json(raw)
    return F.coalesce(F.try_variant_get(v, "$._hidden_params.response_cost", "double"), F.try_variant_get(v, "$.cost", "double"))
