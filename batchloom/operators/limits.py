"""Token buckets on an explicit clock, and their use: one limiter, shares, and a scan over events."""

from __future__ import annotations

import asyncio
import heapq
import itertools
import math
import time
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYNC_VALID_S = 60.0
DAY_SCOPE_S = 120.0
MINUTE, DAY = 60, 86_400


@dataclass
class TokenBucket:
    """``per_period`` tokens each ``period`` seconds, at most ``capacity`` kept; it starts full.

    A server's report replaces the level and, until the next change here or for a minute, the
    rate.
    """

    per_period: int
    capacity: int | None = None
    period: int = MINUTE
    at: float = 0.0

    def __post_init__(self) -> None:
        for name in ("per_period", "period", *(["capacity"] if self.capacity is not None else [])):
            v = getattr(self, name)
            if not isinstance(v, int) or isinstance(v, bool) or v <= 0:
                raise ValueError(f"{name} must be a positive integer, not {v!r}")
        self.capacity = self.capacity or self.per_period
        self.tokens = float(self.capacity)
        self.server: tuple[float, float, float] | None = None  # rate, since, reset

    def rate(self, now: float) -> float:
        if self.server and now - self.server[1] <= SYNC_VALID_S:
            return self.server[0]
        return self.per_period / self.period

    def level(self, now: float) -> int:
        if now > self.at:
            self.tokens = min(float(self.capacity), self.tokens + (now - self.at) * self.rate(now))
            self.at = now
        return math.floor(self.tokens)

    def take(self, n: int, now: float) -> bool:
        if n <= 0:
            return True
        if self.level(now) < n:
            return False
        self.tokens -= n
        self.server = None
        return True

    def give(self, n: int, now: float) -> None:
        """Add (or with a negative n remove) tokens, within 0 and the capacity."""
        if n:
            self.level(now)
            self.tokens = min(float(self.capacity), max(0.0, self.tokens + n))
            self.server = None

    def wait(self, n: int, now: float) -> float:
        """Seconds until n tokens are there."""
        short = n - self.level(now)
        if short <= 0:
            return 0.0
        rate = self.rate(now)
        if rate > 0:
            return short / rate + 1e-9
        if self.server and self.server[2] > now:
            return self.server[2] - now + 1e-9
        return math.inf

    def report(self, limit: int | None, remaining: int, reset: float, now: float) -> None:
        """A server's own figures; ``reset`` is a time on this clock."""
        if limit is not None and limit <= 0 or remaining < 0 or reset <= now:
            raise ValueError("a report needs a positive limit, no negative remainder and a reset to come")
        self.level(now)
        self.tokens, self.at = float(min(self.capacity, remaining)), now
        goal = min(self.capacity, limit) if limit is not None else self.capacity
        self.server = (max(0.0, (goal - self.tokens) / (reset - now)), now, reset)


@dataclass(frozen=True)
class Limits:
    rpm: int | None = None
    tpm: int | None = None
    rpd: int | None = None
    tpd: int | None = None
    max_request_burst: int | None = None
    max_token_burst: int | None = None
    header_scope: str = "auto"

    def __post_init__(self) -> None:
        if self.header_scope not in ("auto", "minute", "day"):
            raise ValueError(f"unknown header scope {self.header_scope!r}")

    @property
    def any(self) -> bool:
        return any(x is not None for x in (self.rpm, self.tpm, self.rpd, self.tpd))

    def requests_per_minute(self) -> int | None:
        """The request limit, or one derived where only others are set."""
        if self.rpm is not None or not self.any:
            return self.rpm
        return max(1, self.tpm // 6000) if self.tpm else self.rpd if self.rpd else self.tpd

    def share(self, part: int, parts: int) -> Limits:
        """The part of each limit that one of ``parts`` concurrent tasks may use; the first get the rest.

        The sum never exceeds the whole; a task whose share is nothing gets 1 only if there are
        fewer parts than units, so callers keep parts <= the least limit.
        """

        def of(n: int | None) -> int | None:
            return None if n is None else max(1, n // parts + (part < n % parts))

        own = replace(self, rpm=self.requests_per_minute())
        return replace(own, **{k: of(getattr(own, k)) for k in ("rpm", "tpm", "rpd", "tpd", "max_request_burst", "max_token_burst")})

    def most_parts(self) -> int:
        found = [x for x in (self.requests_per_minute(), self.tpm, self.rpd, self.tpd) if x is not None]
        return min(found) if found else 1 << 30


class Limiter:
    """All buckets together: a request takes one slot and its tokens from each, or nothing."""

    def __init__(self, limits: Limits, now: float = 0.0):
        rpm = limits.requests_per_minute()
        if rpm is None:
            raise ValueError("no limit is set")
        self.limits = limits
        self.requests = {"minute": TokenBucket(rpm, limits.max_request_burst, MINUTE, now)}
        self.tokens: dict[str, TokenBucket] = {}
        if limits.rpd:
            self.requests["day"] = TokenBucket(limits.rpd, None, DAY, now)
        if limits.tpm:
            self.tokens["minute"] = TokenBucket(limits.tpm, limits.max_token_burst, MINUTE, now)
        if limits.tpd:
            self.tokens["day"] = TokenBucket(limits.tpd, None, DAY, now)

    def _needs(self, tokens: int) -> list[tuple[TokenBucket, int]]:
        return [(b, tokens) for b in self.tokens.values()] + [(b, 1) for b in self.requests.values()]

    def check(self, tokens: int) -> None:
        if any(tokens > b.capacity for b in self.tokens.values()):
            raise ValueError(f"{tokens} tokens exceed the capacity of a token bucket")

    def try_acquire(self, tokens: int, now: float) -> bool:
        self.check(tokens)
        needs = self._needs(tokens)
        if any(b.level(now) < n for b, n in needs):
            return False
        for b, n in needs:
            b.take(n, now)
        return True

    def wait(self, tokens: int, now: float) -> float:
        return max(b.wait(n, now) for b, n in self._needs(tokens))

    def adjust(self, reserved: int, actual: int, now: float, failed: bool | None = None, headers: dict | None = None) -> None:
        """After a request: its slot back if it failed, the difference in tokens, a server's report.

        ``failed`` defaults to "no tokens used". ``headers``: the fields of ``rate_headers``, resets
        in seconds from now.
        """
        if reserved < 0 or actual < 0:
            raise ValueError("tokens must not be negative")
        if actual == 0 if failed is None else failed:
            for b in self.requests.values():
                b.give(1, now)
        for b in self.tokens.values():
            b.give(reserved - actual, now)
        for what, buckets in (("requests", self.requests), ("tokens", self.tokens)):
            h = headers or {}
            remaining, reset = h.get(f"{what}_remaining"), h.get(f"{what}_reset")
            if remaining is not None and reset is not None:
                scope = self.limits.header_scope
                if scope == "auto":
                    scope = "minute" if reset < DAY_SCOPE_S else "day"
                if scope in buckets and reset > 0:
                    buckets[scope].report(h.get(f"{what}_limit"), remaining, now + reset, now)


class Gate:
    """A limiter for coroutines of one event loop. Waiters go in order of tokens, then time: a
    large request can wait long while smaller ones keep coming."""

    def __init__(self, limits: Limits, clock=time.monotonic):
        self.clock = clock
        self.limiter = Limiter(limits, clock())
        self.waiting: list[tuple[int, float, int, asyncio.Future]] = []
        self.count = itertools.count()
        self.timer: asyncio.TimerHandle | None = None

    async def acquire(self, tokens: int) -> None:
        self.limiter.check(tokens)
        self._wake()
        if not self.waiting and self.limiter.try_acquire(tokens, self.clock()):
            return
        future = asyncio.get_running_loop().create_future()
        heapq.heappush(self.waiting, (tokens, self.clock(), next(self.count), future))
        self._wake()
        await future

    def adjust(self, reserved: int, actual: int, failed: bool, headers: dict | None = None) -> None:
        self.limiter.adjust(reserved, actual, self.clock(), failed, headers)
        self._wake()

    def _wake(self) -> None:
        if self.timer:
            self.timer.cancel()
            self.timer = None
        while self.waiting:
            tokens, _, _, future = self.waiting[0]
            if future.done():
                heapq.heappop(self.waiting)
            elif self.limiter.try_acquire(tokens, self.clock()):
                heapq.heappop(self.waiting)
                future.set_result(None)
            else:
                delay = self.limiter.wait(tokens, self.clock())
                if delay < math.inf:
                    self.timer = asyncio.get_running_loop().call_later(delay, self._wake)
                return


def admission(events: DataFrame, key: str, seconds: str, tokens: str, limits: Limits) -> DataFrame:
    """For each request of a log, whether a limiter of its key admits it on arrival.

    A fold over the rows of a key in time order. Rows are dealt by key and sorted, and a task
    streams over them with one limiter in memory, however long a key's log is. Adds
    ``admitted``, ``tokens_left`` (of the minute's bucket, null without) and ``slots_left``.
    """
    dealt = events.repartition(key).sortWithinPartitions(key, seconds, *[c for c in events.columns if c not in (key, seconds)][:1])
    from pyspark.sql import types as T

    schema = T.StructType(
        events.schema.fields + [
            T.StructField("admitted", T.BooleanType()), T.StructField("tokens_left", T.LongType()),
            T.StructField("slots_left", T.LongType()),
        ]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, limiter = object(), None
        for b in batches:
            out = []
            for k, t, n in zip(b[key], b[seconds], b[tokens]):
                if limiter is None or k != own:
                    own, limiter = k, Limiter(limits, float(t))
                fits = all(int(n) <= x.capacity for x in limiter.tokens.values()) and limiter.try_acquire(int(n), float(t))
                left = limiter.tokens.get("minute")
                out.append((fits, left.level(float(t)) if left else None, limiter.requests["minute"].level(float(t))))
            b = b.copy()
            b["admitted"], b["tokens_left"], b["slots_left"] = (
                pd.array([x[i] for x in out], d) for i, d in enumerate(("boolean", "Int64", "Int64"))
            )
            yield b

    return dealt.mapInPandas(run, schema)


def partition_shares(df: DataFrame, cap: int, wanted: int) -> tuple[int, int]:
    """Partitions and in-flight requests a task, so that their product is at most ``cap``."""
    parts = max(1, min(wanted, cap))
    return parts, max(1, cap // parts)


def round_robin(index: str, n: int) -> F.Column:
    return F.pmod(F.col(index), F.lit(n))
