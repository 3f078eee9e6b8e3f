"""Dispatch: requests go out from Spark tasks under a window, retries and rate limits.

Each task runs one event loop over its rows, in batches as Arrow delivers them, and keeps at most
``window`` requests in flight. Tasks x window stays within the global cap. The
result must be written once and read from there: every action over it calls the provider again.
"""

from __future__ import annotations

import asyncio
import json
import random
import time
from collections.abc import AsyncIterator, Callable, Iterator
from dataclasses import dataclass, field, replace
from typing import Any

import pandas as pd
from pyspark import BarrierTaskContext, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.operators.journal import Journal, StoppedError, followed
from batchloom.operators.limits import Gate, Limits
from batchloom.operators.mapping import check_endpoint
from batchloom.operators.pool import PoolGate
from batchloom.operators.provider import ProviderError, first_text
from batchloom.schemas import DISPATCHED, EMBEDDING, TRANSCRIPTION
from batchloom.sources.settings import Deployment, coerce
from batchloom.store import fresh_path, written

ROUTING = ("simple-shuffle", "least-busy", "usage-based-routing", "latency-based-routing", "cost-based-routing", "round-robin")


def estimate(request: Any) -> int:
    """Stand-in for a tokenizer: a token for four characters, and one."""
    text = request if isinstance(request, str) else json.dumps(request)
    return len(text) // 4 + 1


@dataclass(frozen=True)
class DispatchConfig:
    model: str
    provider: Callable[[], Any]
    endpoint: str = "chat_completion"
    api_base: str | None = None
    api_key: str | None = field(default=None, repr=False)
    deployments: tuple[Deployment, ...] = ()
    max_parallel_requests: int | None = None
    limits: Limits = Limits()
    default_output_tokens: int = 0
    timeout: float | None = None
    max_retries: int = 3
    default_request_kwargs: dict[str, Any] = field(default_factory=dict)
    routing_strategy: str = "simple-shuffle"
    router_kwargs: dict[str, Any] = field(default_factory=dict)
    strict: bool = False
    partitions: int | None = None  # by default the cores that Spark has
    count_tokens: Callable[[Any], int] = estimate
    backoff_unit: float = 1.0
    shared_limits: bool = False  # one exact limit for all tasks, by a barrier stage; else each task has its share
    journal: str | None = None  # a shared folder: answers there are replayed, and a strict failure stops all tasks

    def __post_init__(self) -> None:
        if not self.model:
            raise ValueError("a model is required")
        check_endpoint(self.endpoint)
        if self.max_parallel_requests is not None and self.max_parallel_requests < 1:
            raise ValueError("max_parallel_requests must be at least 1")
        if self.deployments and (self.api_base or self.api_key):
            raise ValueError("deployments bring their own api_base and api_key")
        if self.routing_strategy not in ROUTING:
            raise ValueError(f"unknown routing strategy {self.routing_strategy!r}")
        if self.max_retries < 0:
            raise ValueError("max_retries must not be negative")
        object.__setattr__(self, "deployments", tuple(coerce(d) for d in self.deployments))

    def targets(self) -> tuple[Deployment, ...]:
        return self.deployments or (Deployment(self.model, self.model, self.api_base, self.api_key),)

    def options(self, extra: dict[str, Any] | None = None) -> dict[str, Any]:
        """Defaults below the call's own; our retries replace the provider's."""
        merged = {**self.default_request_kwargs, **(extra or {})}
        if self.max_retries > 0:
            merged.pop("num_retries", None)
        if self.timeout is not None:
            merged.setdefault("timeout", self.timeout)
        return merged

    def shape(self, cores: int = 8) -> tuple[int, int]:
        """Partitions and requests in flight for each. ``cores``: what the cluster has."""
        most = self.partitions or max(1, cores)
        cap = self.max_parallel_requests or 128 * most
        parts = max(1, min(most, cap, most if self.shared_limits else self.limits.most_parts()))
        return parts, max(1, cap // parts)


class Router:
    """Picks a deployment for each call of one task.

    simple-shuffle: at random; round-robin: in turn; least-busy: fewest in flight; usage-based: fewest
    tokens in the last ``window_s`` seconds; latency-based: least moving mean of service
    seconds, the untried first; cost-based: least ``costs[label]`` (router_kwargs; 0 if absent).
    Ties go to the least busy, then to the first.
    """

    def __init__(
        self, strategy: str, targets: tuple[Deployment, ...], options: dict[str, Any], clock: Callable[[], float] = time.monotonic,
    ):
        self.strategy, self.targets, self.clock = strategy, targets, clock
        self.window, self.costs = float(options.get("window_s", 60.0)), dict(options.get("costs", {}))
        self.turn = 0
        self.busy = {d.label: 0 for d in targets}
        self.mean = {d.label: -1.0 for d in targets}
        self.used: dict[str, list[tuple[float, int]]] = {d.label: [] for d in targets}

    def _usage(self, label: str) -> int:
        oldest = self.clock() - self.window
        self.used[label] = [x for x in self.used[label] if x[0] > oldest]
        return sum(n for _, n in self.used[label])

    def pick(self, kind: str) -> Deployment:
        """The responses endpoint is always served in turn."""
        how = "round-robin" if kind == "responses" else self.strategy
        if how == "simple-shuffle":
            return random.choice(self.targets)
        if how == "round-robin":
            self.turn += 1
            return self.targets[(self.turn - 1) % len(self.targets)]
        first = {
            "least-busy": lambda d: 0,
            "usage-based-routing": lambda d: self._usage(d.label),
            "latency-based-routing": lambda d: self.mean[d.label],
            "cost-based-routing": lambda d: self.costs.get(d.label, 0.0),
        }[how]
        return min(self.targets, key=lambda d: (first(d), self.busy[d.label]))

    def done(self, target: Deployment, seconds: float, tokens: int) -> None:
        old = self.mean[target.label]
        self.mean[target.label] = seconds if old < 0 else 0.8 * old + 0.2 * seconds
        if self.strategy == "usage-based-routing":
            self.used[target.label].append((self.clock(), tokens))


class _Caller:
    """What one task needs: provider, gate, deployments."""

    def __init__(self, config: DispatchConfig, part: int, parts: int):
        self.config, self.provider = config, config.provider()
        self.gate: Gate | PoolGate | None = None
        if config.limits.any and config.shared_limits:
            self.gate = PoolGate(config.limits, part, BarrierTaskContext.get().allGather)
        elif config.limits.any:
            self.gate = Gate(config.limits.share(part, parts))
        self.router = Router(config.routing_strategy, config.targets(), config.router_kwargs)
        self.journal = Journal(config.journal) if config.journal else None
        self.known: dict[int, dict] = {}  # what rows of the batch at hand have got in an earlier try
        self.fresh: list[dict] = []

    def begin(self, indices: Any) -> None:
        """A batch of rows begins: a stopped run raises, and answers that they have already are at hand."""
        if self.journal and len(indices):
            self.journal.check(0.0)
            self.known |= self.journal.load(int(min(indices)), int(max(indices)))

    def replayed(self, indices: list[int]) -> list[dict] | None:
        if self.known and all(i in self.known for i in indices):
            return [self.known.pop(i) for i in indices]
        return None

    def note(self, rows: list[dict]) -> list[dict]:
        if self.journal:
            self.fresh += rows
        return rows

    def flush(self) -> None:
        if self.journal:
            self.journal.write(self.fresh)
            self.fresh = []

    def failed(self, error: BaseException) -> None:
        """The failure of a strict run: what has come is kept, and the other tasks stop."""
        if self.journal and not isinstance(error, StoppedError):
            self.flush()
            self.journal.stop(error)

    async def close(self) -> None:
        """Close the provider if it can be closed."""
        done = getattr(self.provider, "close", lambda: None)()
        if asyncio.iscoroutine(done):
            await done

    async def call(self, kind: str, request: Any, tokens: int, options: dict, since: float) -> tuple[dict, dict]:
        """Response and metrics; raises the last error, with its metrics attached."""
        c, waited, slept, attempt = self.config, 0.0, 0.0, 0
        target = self.router.pick(kind)
        while True:
            if self.journal:
                self.journal.check()
            asked = time.monotonic()
            if self.gate:
                await self.gate.acquire(tokens)
            began = time.monotonic()
            waited += began - (since if not attempt else asked)
            self.router.busy[target.label] += 1
            try:
                response = await self.provider.call(kind, request, target, {**target.extra, **options})
            except Exception as error:
                now = time.monotonic()
                if self.gate:
                    self.gate.adjust(tokens, 0, failed=True)
                again = isinstance(error, ProviderError) and error.retryable and attempt < c.max_retries
                if not again:
                    error.metrics = self._metrics(waited, now - began, now - since, slept, target, attempt)
                    raise
                pause = _pause(attempt, error.retry_after) * c.backoff_unit
                slept += pause
                attempt += 1
                target = self.router.pick(kind)
                await asyncio.sleep(pause)
            else:
                now = time.monotonic()
                used = (response.get("usage") or {}).get("total_tokens") if isinstance(response, dict) else None
                used = int(used if used is not None else tokens)
                self.router.done(target, now - began, used)
                if self.gate:
                    self.gate.adjust(tokens, used, failed=False, headers=_limits_of(response))
                return response, self._metrics(waited, now - began, now - since, slept, target, attempt, response)
            finally:
                self.router.busy[target.label] -= 1

    @staticmethod
    def _metrics(
        queue: float, service: float, total: float, slept: float, target: Deployment, retries: int, response: dict | None = None,
    ) -> dict:
        hidden = (response or {}).get("_hidden_params") or {}
        label = next((str(hidden[k]) for k in ("deployment", "api_base", "model_id", "model") if hidden.get(k)), target.label)
        return {
            "queue_wait_s": queue, "service_time_s": service, "end_to_end_s": total, "backoff_s": slept, "deployment": label,
            "retries": retries,
        }


def _pause(attempt: int, retry_after: str | float | None) -> float:
    try:
        return min(max(float(retry_after), 0.0), 60.0)
    except (TypeError, ValueError):
        return min(2.0**attempt, 60.0) + random.random() * 0.5


def reset_seconds(text: str, now: float | None = None) -> float | None:
    """As the column of this name: seconds until a reset, None if malformed."""
    import re

    from batchloom.functions.ratelimit import FIVE_YEARS_S

    t = text.strip().lower()
    now = time.time() if now is None else now
    if re.fullmatch(r"[0-9]+(?:\.[0-9]+)?", t):
        v = float(t)
        return max(0.0, v - now) if v > now - FIVE_YEARS_S else v
    if not re.fullmatch(r"(?:[0-9]+(?:\.[0-9]+)?(?:ms|h|m|s))+", t):
        return None
    scale = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 0.001}
    return sum(float(v) * scale[u] for v, u in re.findall(r"([0-9.]+)(ms|h|m|s)", t))


def _limits_of(response: Any) -> dict | None:
    found = response.get("_response_headers") or response.get("headers") if isinstance(response, dict) else None
    if not found:
        return None
    out: dict[str, Any] = {}
    for name, value in dict(found).items():
        for what in ("requests", "tokens"):
            for kind in ("limit", "remaining", "reset"):
                if f"x-ratelimit-{kind}-{what}" in name.lower():
                    try:
                        out[f"{what}_{kind}"] = reset_seconds(str(value)) if kind == "reset" else int(value)
                    except ValueError:
                        continue
    return out


def _row(index: int, response: dict | None, error: BaseException | str | None, call: str | None, metrics: dict | None) -> dict:
    if isinstance(error, BaseException):
        kind, error = type(error).__name__, str(error) or "unknown error"
    else:
        kind = "ValueError" if error else None
    return {
        "_index": index, "response": None if response is None else json.dumps(response, ensure_ascii=False), "error": error,
        "error_type": kind, "call_id": call, "metrics": metrics,
    }


async def _windowed(jobs: Iterator[Callable[[], Any]], window: int) -> AsyncIterator[list[dict]]:
    """Run jobs with at most ``window`` in flight; each gives a list of rows, in order of completion."""
    running: set[asyncio.Task] = set()
    left, loop = True, asyncio.get_running_loop()
    try:
        while left or running:
            while left and len(running) < window:
                job = await loop.run_in_executor(None, next, jobs, None)  # Arrow may have to wait for rows
                if job is None:
                    left = False
                else:
                    running.add(asyncio.ensure_future(job()))
            if running:
                done, running = await asyncio.wait(running, return_when=asyncio.FIRST_COMPLETED)
                ready = [row for task in done if task.exception() is None for row in task.result()]
                if ready:
                    yield ready  # before a failure among the others is raised
                for task in done:
                    task.result()
    finally:
        for task in running:
            task.cancel()
        if running:
            await asyncio.gather(*running, return_exceptions=True)


_COLUMNS = ["_index", "response", "error", "error_type", "call_id", "metrics"]
FRAME_ROWS, FRAME_SECONDS = 512, 1.0


def _run(config: DispatchConfig, window: int, parts: int, make: Callable[[_Caller, pd.DataFrame], Iterator[Callable]]):
    """Rows leave a task in frames of ``FRAME_ROWS``, or of what came within ``FRAME_SECONDS``."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loop = asyncio.new_event_loop()
        caller = _Caller(config, TaskContext.get().partitionId() % parts, parts)
        held: list[dict] = []
        began = time.monotonic()
        try:

            def jobs() -> Iterator[Callable]:
                for b in batches:
                    yield from make(caller, b)

            rows = _windowed(jobs(), window)
            while True:
                try:
                    held += loop.run_until_complete(anext(rows))
                except StopAsyncIteration:
                    break
                if len(held) >= FRAME_ROWS or time.monotonic() - began > FRAME_SECONDS:
                    caller.flush()
                    yield pd.DataFrame(held, columns=_COLUMNS)
                    held, began = [], time.monotonic()
            caller.flush()
            if held:
                yield pd.DataFrame(held, columns=_COLUMNS)
            if isinstance(caller.gate, PoolGate):
                caller.gate.finish()
        except Exception as error:
            caller.failed(error)
            raise
        finally:
            loop.run_until_complete(caller.close())
            loop.run_until_complete(loop.shutdown_default_executor())
            loop.close()

    return task


def _together(config: DispatchConfig) -> bool:
    """Whether all tasks have to run at once."""
    return config.shared_limits and config.limits.any


def _own(config: DispatchConfig, text: Any) -> dict[str, Any]:
    """Options of one call: its own (JSON text of an object, or null) above the defaults."""
    return config.options(json.loads(text) if isinstance(text, str) else None)


def _with_options(df: DataFrame) -> F.Column:
    return F.col("options") if "options" in df.columns else F.lit(None).cast("string").alias("options")


def generate(requests: DataFrame, config: DispatchConfig) -> DataFrame:
    """Answers to rows of _index, request (JSON text) and error; rows with an error make no call.

    A column ``options`` (JSON text, may be null) holds a call's own options. In strict mode the first
    failure raises: the task cancels what it has in flight, and the job fails. With a ``journal`` the other
    tasks stop too, and a task that is tried again replays what it has got and calls nothing twice, but for calls
    whose answers were in flight or not yet a frame old when an executor was lost.
    """
    parts, window = config.shape(requests.sparkSession.sparkContext.defaultParallelism)

    def make(caller: _Caller, batch: pd.DataFrame) -> Iterator[Callable]:
        caller.begin(batch["_index"])
        for index, text, error, asked in zip(batch["_index"], batch["request"], batch["error"], batch["options"]):

            async def one(index=index, text=text, error=error, asked=asked) -> list[dict]:
                found = caller.replayed([index])
                if found is not None:
                    return found
                if error is not None or text is None:
                    if config.strict:
                        raise ValueError(error or "no request")
                    return caller.note([_row(index, None, error or "no request", None, None)])
                since = time.monotonic()
                try:
                    request, options = json.loads(text), _own(config, asked)
                    most = next(
                        (int(options[k]) for k in ("max_completion_tokens", "max_tokens", "max_output_tokens") if options.get(k)),
                        config.default_output_tokens,
                    )
                    response, metrics = await caller.call(
                        config.endpoint, request, config.count_tokens(request) + max(0, most), options, since,
                    )
                    return caller.note([_row(index, response, None, f"g-{index}", metrics)])
                except Exception as failure:
                    if config.strict or isinstance(failure, StoppedError):
                        raise
                    return caller.note([_row(index, None, failure, None, getattr(failure, "metrics", None))])

            yield one

    rows = requests.select(F.col("_index").cast("bigint"), "request", "error", _with_options(requests)).repartitionByRange(parts, "_index")
    return rows.mapInPandas(_run(config, window, parts, make), DISPATCHED, barrier=_together(config))


def micro_batches(texts: DataFrame, size: int, text_col: str = "text") -> DataFrame:
    """batch, indices and texts: contiguous slices of the index, in order; null texts are empty."""
    named = texts.select(F.col("_index").cast("bigint"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    grouped = named.groupBy(F.floor(F.col("_index") / size).alias("batch")).agg(
        F.array_sort(F.collect_list(F.struct("_index", "text"))).alias("rows")
    )
    return grouped.select("batch", F.col("rows._index").alias("indices"), F.col("rows.text").alias("texts"))


def embed(texts: DataFrame, config: DispatchConfig, text_col: str = "text", micro_batch_size: int = 32) -> DataFrame:
    """One answer row for each text; texts go out in contiguous micro-batches of their index.

    A batch that fails for another reason than a passing one is halved until single texts fail. The
    rows of a call share ``call_id``, and each holds its own vector and the call's usage.
    """
    if micro_batch_size < 1:
        raise ValueError("micro_batch_size must be at least 1")
    parts, window = config.shape(texts.sparkSession.sparkContext.defaultParallelism)
    options = config.options()

    def make(caller: _Caller, batch: pd.DataFrame) -> Iterator[Callable]:
        caller.begin([i for own in batch["indices"] for i in own])
        for indices, inputs in zip(batch["indices"], batch["texts"]):

            async def one(indices=[int(i) for i in indices], inputs=list(inputs)) -> list[dict]:
                found = caller.replayed(indices)
                if found is not None:
                    return found
                return await chunk(caller, indices, inputs, time.monotonic())

            yield one

    async def chunk(caller: _Caller, indices: list[int], inputs: list[str], since: float) -> list[dict]:
        try:
            response, metrics = await caller.call(EMBEDDING, inputs, sum(map(config.count_tokens, inputs)), options, since)
            data = response.get("data") or []
            if len(data) != len(inputs):
                raise ValueError("Embedding response did not contain one vector per input item.")
            shared = {k: v for k, v in response.items() if k != "data"}
            return caller.note([_row(i, shared | {"data": [d]}, None, f"e-{indices[0]}-{len(indices)}", metrics) for i, d in zip(indices, data)])
        except Exception as error:
            if config.strict or isinstance(error, StoppedError):
                raise
            passing = isinstance(error, ProviderError) and error.retryable
            if len(inputs) == 1 or passing:
                return caller.note([_row(i, None, error, None, getattr(error, "metrics", None)) for i in indices])
            half = len(inputs) // 2
            return await chunk(caller, indices[:half], inputs[:half], since) + await chunk(caller, indices[half:], inputs[half:], since)

    batches = micro_batches(texts, micro_batch_size, text_col).repartitionByRange(parts, "batch")
    return batches.mapInPandas(_run(config, window, parts, make), DISPATCHED, barrier=_together(config))


def transcribe(files: DataFrame, config: DispatchConfig) -> DataFrame:
    """Answers to rows of _index, content and error (as the audio sources give them)."""
    parts, window = config.shape(files.sparkSession.sparkContext.defaultParallelism)

    def make(caller: _Caller, batch: pd.DataFrame) -> Iterator[Callable]:
        caller.begin(batch["_index"])
        for index, content, error, asked in zip(batch["_index"], batch["content"], batch["error"], batch["options"]):

            async def one(index=index, content=content, error=error, asked=asked) -> list[dict]:
                found = caller.replayed([index])
                if found is not None:
                    return found
                try:
                    if error is not None:
                        raise ValueError(error)
                    response, metrics = await caller.call(TRANSCRIPTION, bytes(content), 0, _own(config, asked), time.monotonic())
                    return caller.note([_row(index, response, None, f"t-{index}", metrics)])
                except Exception as failure:
                    if config.strict or isinstance(failure, StoppedError):
                        raise
                    return caller.note([_row(index, None, failure, None, getattr(failure, "metrics", None))])

            yield one

    rows = files.select(F.col("_index").cast("bigint"), "content", "error", _with_options(files)).repartitionByRange(parts, "_index")
    return rows.mapInPandas(_run(config, window, parts, make), DISPATCHED, barrier=_together(config))


def batch(
    call: Callable[..., DataFrame], rows: DataFrame, config: DispatchConfig, on_result: Callable[[int, dict], None] | None = None,
    on_progress: Callable[[int, int], None] | None = None, **kw: Any,
) -> DataFrame:
    """What ``call`` (generate, embed or transcribe) answers to ``rows``, written once.

    ``on_result`` gets the index and the answer of each row as it comes, in order of completion and in the
    caller's thread; ``on_progress`` how many there are, of how many.
    """
    if on_result is None and on_progress is None:
        return written(call(rows, config, **kw), "answers")
    journal = config.journal or fresh_path(rows.sparkSession, "journal")
    total, done = rows.count() if on_progress else 0, 0

    def note(row: dict) -> None:
        nonlocal done
        done += 1
        if on_result:
            on_result(row["_index"], row)
        if on_progress:
            on_progress(done, total)

    return followed(journal, lambda: written(call(rows, replace(config, journal=journal), **kw), "answers"), note)


def secretless(config: DispatchConfig) -> DispatchConfig:
    """The same without keys, for logs."""
    return replace(config, api_key=None, deployments=tuple(replace(d, api_key=None) for d in config.deployments))
