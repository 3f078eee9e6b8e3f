"""Rate-limit headers, retry delays and token arithmetic as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# An epoch value lies beyond five years before now; smaller numbers are seconds.
FIVE_YEARS_S = 5 * 365 * 86_400
_PIECE = r"([0-9]+(?:\.[0-9]+)?)(ms|h|m|s)"
_NAMES = ("limit-requests", "limit-tokens", "remaining-requests", "remaining-tokens", "reset-requests", "reset-tokens")


def reset_seconds(text: Column, now: Column | None = None) -> Column:
    """Seconds until a reset: ``10``, ``8.64s``, ``1m30s``, ``100ms``, or an epoch; null if malformed."""
    now = F.unix_timestamp().cast("double") if now is None else now
    t = F.lower(F.trim(text))
    number = t.try_cast("double")
    plain = F.when(number > now - FIVE_YEARS_S, F.greatest(F.lit(0.0), number - now)).otherwise(F.greatest(F.lit(0.0), number))
    values = F.regexp_extract_all(t, F.lit(_PIECE), F.lit(1))
    parts = F.regexp_extract_all(t, F.lit(_PIECE), F.lit(2))
    scale = lambda u: F.when(u == "h", 3600.0).when(u == "m", 60.0).when(u == "s", 1.0).otherwise(0.001)
    total = F.aggregate(F.zip_with(values, parts, lambda v, u: v.cast("double") * scale(u)), F.lit(0.0), lambda a, x: a + x)
    whole = t.rlike(f"^(?:{_PIECE.replace('(ms|h|m|s)', '(?:ms|h|m|s)')})+$")
    return F.when(number.isNotNull() & ~F.isnan(number), plain).when(whole, total)


def rate_headers(headers: Column, now: Column | None = None) -> Column:
    """The six x-ratelimit values of a map of headers, names matched in any case, inside longer ones too.

    Malformed numbers are null.
    """
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("k"), e["value"].alias("v")))

    def field(name: str) -> Column:
        found = F.try_element_at(
            F.transform(F.filter(entries, lambda e: F.contains(e["k"], F.lit(f"x-ratelimit-{name}"))), lambda e: e["v"]), F.lit(-1),
        )
        kind, what = name.split("-")
        value = reset_seconds(found, now) if kind == "reset" else F.trim(found).try_cast("bigint")
        return value.alias(f"{what}_{kind}")

    return F.struct(*[field(n) for n in _NAMES])


def retry_delay(attempt: Column, retry_after: Column | None = None, jitter: Column | None = None) -> Column:
    """Seconds before the next attempt: 2^attempt up to 60, plus up to half a second; a server's
    own delay counts up to 60 and takes no jitter. A date as Retry-After is ignored."""
    backoff = F.least(F.pow(F.lit(2.0), attempt.cast("double")), F.lit(60.0)) + (F.rand() * 0.5 if jitter is None else jitter)
    if retry_after is None:
        return backoff
    asked = F.trim(retry_after).try_cast("double")
    return F.when(asked.isNotNull(), F.least(F.greatest(asked, F.lit(0.0)), F.lit(60.0))).otherwise(backoff)


def output_limit(kwargs: Column, endpoint: Column) -> Column:
    """Output tokens that a request may cost, by the keys its endpoint knows, in their order."""
    get = lambda k: F.try_element_at(kwargs, F.lit(k)).try_cast("bigint")
    chat = F.coalesce(get("max_completion_tokens"), get("max_tokens"), get("max_output_tokens"))
    return F.when(
        endpoint == "responses", F.coalesce(get("max_output_tokens"), get("max_completion_tokens"), get("max_tokens")),
    ).when(endpoint == "text_completion", F.coalesce(get("max_tokens"), get("max_completion_tokens"))).otherwise(chat)


def token_estimate(text: Column, max_tokens: Column | int = 0) -> Column:
    """A tokenizer-free estimate: a token for four characters, one more, and the output limit."""
    most = F.lit(max_tokens) if isinstance(max_tokens, int) else F.coalesce(max_tokens, F.lit(0))
    return F.floor(F.length(text) / 4) + 1 + F.greatest(F.lit(0), most)


def bucket_refill(level: Column, elapsed: Column, rate: Column, capacity: Column) -> Column:
    return F.least(capacity, level + F.greatest(elapsed, F.lit(0.0)) * rate)


def refill_wait(needed: Column, level: Column, rate: Column) -> Column:
    """Seconds until a bucket holds ``needed``; infinite without refill."""
    short = needed - F.floor(level)
    return F.when(short <= 0, F.lit(0.0)).when(rate <= 0, F.lit(float("inf"))).otherwise(short / rate + 1e-9)


def sweep_levels(most: Column) -> Column:
    """Powers of two up to ``most``, then ``most``."""
    powers = F.transform(
        F.sequence(F.lit(0), F.floor(F.log2(most.cast("double")) + 1e-9).cast("int")), lambda k: F.pow(F.lit(2.0), k).cast("int"),
    )
    return F.array_distinct(F.concat(powers, F.array(most.cast("int"))))


def batch_sweep(most: Column) -> Column:
    """1, 8, 32, 128, 512 as far as they go, then ``most``."""
    sizes = F.array(*[F.lit(n) for n in (1, 8, 32, 128, 512)])
    return F.array_distinct(F.concat(F.filter(sizes, lambda n: n <= most), F.array(most.cast("int"))))
