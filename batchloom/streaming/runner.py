"""Structured Streaming: dispatch of arriving rows, and a stateful limiter."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from batchloom.operators.dispatch import DispatchConfig, generate
from batchloom.operators.limits import Limits, Limiter, TokenBucket
from batchloom.operators.mapping import prepared
from batchloom.operators.results import records
from batchloom.sources import places
from batchloom.store import Folder


def run_stream(
    spark: SparkSession, source: str, target: str, checkpoint: str, config: DispatchConfig, files_per_trigger: int = 1,
    parse_json: bool = False,
) -> StreamingQuery:
    """Process all files that are there in micro-batches, each written once under its own number.

    A repeated batch replaces its own folder, so that a restart leaves one copy of each row; what is
    done isn't called again. The index is gapless over all batches and restarts: the rows of earlier batches
    are kept in the checkpoint, and inside a batch rows count by file and place.
    """
    lines = places.text_lines(spark.readStream.option("maxFilesPerTrigger", files_per_trigger), source)
    counts = Folder(spark, f"{checkpoint}/rows")

    def batch(rows: DataFrame, number: int) -> None:
        found, n = places.indexed(rows)
        first = _before(counts, number)
        counts.put(f"{number}.json", json.dumps({"first": first, "rows": n}))
        work = Folder(spark, f"{target}/_work/batch={number}")
        try:
            found.withColumn("source_index", F.col("source_index") + first).write.mode("overwrite").parquet(f"{work.path}/rows")
            ready = prepared(spark.read.parquet(f"{work.path}/rows"), config.endpoint)
            asked = ready.select(F.col("source_index").alias("_index"), "request", "error")
            # Answers are written once: what follows never calls the provider again.
            generate(asked, config).write.mode("overwrite").parquet(f"{work.path}/answers")
            out = records(spark.read.parquet(f"{work.path}/answers"), config.endpoint, parse_json)
            out.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{target}/batch={number}")
        finally:
            work.remove()

    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _before(counts: Folder, number: int) -> int:
    """How many rows the batches before this one have."""
    earlier = [k for k in (int(n.split(".")[0]) for n in counts.names() if n.endswith(".json")) if k < number]
    if not earlier:
        return 0
    last = json.loads(counts.text(f"{max(earlier)}.json"))
    return last["first"] + last["rows"]


_BUCKETS = ("minute_requests", "minute_tokens", "day_requests", "day_tokens")
_STATE = "at double, " + ", ".join(f"{b} double, {b}_rate double, {b}_since double, {b}_reset double" for b in _BUCKETS)
HEADERS = tuple(f"{what}_{kind}" for what in ("requests", "tokens") for kind in ("limit", "remaining", "reset"))


def _buckets(limiter: Limiter) -> list[TokenBucket | None]:
    return [limiter.requests.get("minute"), limiter.tokens.get("minute"), limiter.requests.get("day"), limiter.tokens.get("day")]


def _restore(limiter: Limiter, state: tuple) -> None:
    at, rest = state[0], state[1:]
    for k, b in enumerate(_buckets(limiter)):
        if b is not None:
            b.tokens, b.at = rest[4 * k], at
            rate, since, reset = rest[4 * k + 1 : 4 * k + 4]
            b.server = None if rate is None or rate != rate else (rate, since, reset)


def _kept(limiter: Limiter, now: float) -> tuple:
    out: list[float | None] = [now]
    for b in _buckets(limiter):
        if b is None:
            out += [0.0, None, None, None]
        else:
            b.level(now)
            out += [b.tokens, *(b.server or (None, None, None))]
    return tuple(out)


def limited(requests: DataFrame, limits: Limits, key: str = "deployment") -> DataFrame:
    """A stream of (key, request_id, seconds, tokens, actual) with ``admitted``; state is the levels
    of the key's buckets and what a server last said of each. ``actual`` (null: as reserved) corrects the
    reservation of an admitted request afterwards. Further columns named in ``HEADERS``, as far as there are any,
    are the server's report after the request; ``header_scope`` says which bucket it is for."""
    told = [h for h in HEADERS if h in requests.columns]

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["seconds", "request_id"], kind="stable")
        limiter = Limiter(limits, float(rows["seconds"].iloc[0]))
        if state.exists:
            _restore(limiter, state.get)
        out = []
        for r in rows.itertuples():
            now = float(r.seconds)
            fits = all(r.tokens <= b.capacity for b in limiter.tokens.values()) and limiter.try_acquire(int(r.tokens), now)
            report = {h: (float if h.endswith("reset") else int)(getattr(r, h)) for h in told if not pd.isna(getattr(r, h))}
            used = int(r.tokens) if pd.isna(r.actual) else int(r.actual)
            if fits and (not pd.isna(r.actual) or report):
                limiter.adjust(int(r.tokens), used, now, failed=used == 0 and not pd.isna(r.actual), headers=report)
            out.append((k[0], int(r.request_id), now, fits))
        state.update(_kept(limiter, float(rows["seconds"].iloc[-1])))
        yield pd.DataFrame(out, columns=[key, "request_id", "seconds", "admitted"])

    return requests.groupBy(key).applyInPandasWithState(
        step, f"{key} string, request_id bigint, seconds double, admitted boolean", _STATE, "append", GroupStateTimeout.NoTimeout,
    )
