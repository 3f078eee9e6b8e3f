"""Benchmark summaries and recommendations: plain aggregations over a log of requests.

The log has a row for each request: level, failed, end_to_end_s, service_time_s, queue_wait_s,
deployment, prompt_tokens, output_tokens, total_tokens; timings are null on failure.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchloom.store import written

WITHIN = 0.95
TIMINGS = {"latency_s": "end_to_end_s", "service_time_s": "service_time_s", "queue_wait_s": "queue_wait_s"}


def exact_percentile(column: Column, p: int) -> Column:
    """Linear interpolation between neighbours; 0 without values."""
    return F.coalesce(F.percentile(column, p / 100), F.lit(0.0))


def ranked_percentiles(rows: DataFrame, keys: list[str], value: str, points: tuple[int, ...]) -> DataFrame:
    """keys, p, value: the same percentiles for groups of any size, null values aside.

    Distinct values are counted, dealt out in ranges and written; ranks come from running counts inside a range and
    the sums of earlier ones, and each percentile is read off at its two neighbouring ranks. No buffer holds a
    group's values.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    dealt = written(counts.repartitionByRange(*keys, value).withColumn("_part", F.spark_partition_id()), "ranked")
    parts = dealt.groupBy(*keys, "_part").agg(F.sum("_n").alias("_rows"))
    earlier = F.sum("_rows").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    whole = F.sum("_rows").over(Window.partitionBy(*keys))
    parts = parts.select(*keys, "_part", F.coalesce(earlier, F.lit(0)).alias("_before"), whole.alias("_total"))
    upto = F.sum("_n").over(Window.partitionBy(*keys, "_part").orderBy(value))
    ranked = dealt.withColumn("_upto", upto).join(F.broadcast(parts), [*keys, "_part"]).withColumn("_upto", F.col("_upto") + F.col("_before"))
    ranked = ranked.withColumn("p", F.explode(F.array(*map(F.lit, points))))
    at = F.col("p") / 100 * (F.col("_total") - 1)
    stands = lambda rank: (F.col("_upto") - F.col("_n") <= rank) & (rank < F.col("_upto"))
    near = ranked.where(stands(F.floor(at)) | stands(F.ceil(at))).groupBy(*keys, "p").agg(
        F.max(F.when(stands(F.floor(at)), F.col(value))).alias("_low"), F.max(F.when(stands(F.ceil(at)), F.col(value))).alias("_high"), F.max(at - F.floor(at)).alias("_share"),
    )
    return near.select(*keys, "p", (F.col("_low") * (1 - F.col("_share")) + F.col("_high") * F.col("_share")).alias(value))


def per_second(amount: Column, elapsed: Column) -> Column:
    return F.when(elapsed > 0, amount / elapsed).otherwise(F.lit(0.0))


def summary(log: DataFrame, elapsed: DataFrame, level: str = "level", by_ranks: bool = False) -> DataFrame:
    """Counts, rates and p50/p95/p99 for each level; ``elapsed`` has level and elapsed_s.

    Percentiles keep a level's distinct timings in one buffer, or with ``by_ranks`` in none, for levels of many
    millions of requests; the results are the same.
    """
    done = F.when(~F.col("failed"), F.lit(1))
    stats = [exact_percentile(F.col(c), p).alias(f"p{p}_{name}") for name, c in TIMINGS.items() for p in (50, 95, 99)] if not by_ranks else []
    sums = [
        F.coalesce(F.sum(F.when(~F.col("failed"), F.col(c))), F.lit(0)).alias(c) for c in ("prompt_tokens", "output_tokens", "total_tokens")
    ]
    found = log.groupBy(level).agg(
        F.count(F.lit(1)).alias("total_submitted"), F.count(done).alias("succeeded"), F.count_if("failed").alias("failures"), *stats, *sums,
    )
    if by_ranks:
        times = log.select(level, F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(c).cast("double").alias("time")) for n, c in TIMINGS.items()))).alias("x")).select(level, "x.*")
        ranks = ranked_percentiles(times, [level, "name"], "time", (50, 95, 99))
        pick = lambda n, p: F.max(F.when((F.col("name") == n) & (F.col("p") == p), F.col("time")))
        wide = ranks.groupBy(level).agg(*(pick(n, p).alias(f"p{p}_{n}") for n in TIMINGS for p in (50, 95, 99)))
        found = found.join(wide, level, "left").fillna(0.0, [f"p{p}_{n}" for n in TIMINGS for p in (50, 95, 99)])
    e = F.col("elapsed_s")
    rates = [per_second(F.col(c), e).alias(f"{c}_per_second") for c in ("prompt_tokens", "output_tokens", "total_tokens")]
    return found.join(F.broadcast(elapsed), level).select(
        level, "total_submitted", "succeeded", "failures", "elapsed_s", per_second(F.col("succeeded"), e).alias("requests_per_second"),
        *[f"p{p}_{n}" for n in TIMINGS for p in (50, 95, 99)], *rates,
    )


def deployment_histogram(log: DataFrame, level: str = "level") -> DataFrame:
    """Answers by deployment; empty labels don't count."""
    return log.where(
        ~F.col("failed") & F.col("deployment").isNotNull() & (F.col("deployment") != "")
    ).groupBy(level, "deployment").agg(F.count(F.lit(1)).alias("n"))


def embed_calls(rows: DataFrame, level: str = "level") -> DataFrame:
    """Totals of embedding calls: the usage and timing of a call counts once, however many vectors it gave."""
    vectors = rows.groupBy(level).agg(F.count(F.lit(1)).alias("total_submitted"), F.count_if("failed").alias("failures"))
    calls = rows.where(~F.col("failed")).dropDuplicates([level, "call_id"]).groupBy(level).agg(
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"), F.count(F.lit(1)).alias("calls"),
    )
    return vectors.join(calls, level, "left").select(
        level, "total_submitted", (F.col("total_submitted") - F.col("failures")).alias("succeeded"), "failures",
        F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("total_tokens", F.lit(0)).alias("total_tokens"),
    )


def recommend(levels: DataFrame, level: str = "level", position: str = "position") -> DataFrame:
    """One row: the first level without failures within 95 % of the best throughput.

    Throughput is output tokens a second if any level has some, else requests a second. Null without
    such a level, or if the best is 0. ``still_rising``: it is the last of the sweep.
    """
    tokens = F.max("output_tokens_per_second") > 0
    flags = levels.agg(tokens.alias("use_tokens"), F.max_by(level, position).alias("last"))
    rated = levels.join(F.broadcast(flags), F.lit(True))
    rated = rated.withColumn("rate", F.when(F.col("use_tokens"), F.col("output_tokens_per_second")).otherwise(F.col("requests_per_second")))
    fine = rated.withColumn("fine", F.when(F.col("failures") == 0, F.col("rate")))
    best = fine.agg(F.max("fine").alias("best"))
    good = (F.col("best") > 0) & (F.col("fine") >= WITHIN * F.col("best"))
    near = fine.join(F.broadcast(best), F.lit(True)).agg(
        F.min_by(level, F.when(good, F.col(position))).alias("recommended"),
        F.first("use_tokens").alias("use_tokens"),
        F.first("last").alias("last"),
    )
    return near.select(
        "recommended", F.when(F.col("use_tokens"), F.lit("output_tok/s")).otherwise(F.lit("rps")).alias("metric"),
        F.coalesce(F.col("recommended") == F.col("last"), F.lit(False)).alias("still_rising"),
    )


def recommend_embed(levels: DataFrame, level: str = "level", position: str = "position") -> DataFrame:
    """One row: the level without failures that gives most vectors a second, the first of equal ones."""
    fine = F.when(F.col("failures") == 0, F.struct("vectors_per_second", (-F.col(position)).alias("p")))
    return levels.agg(
        F.max_by(F.when(F.col("failures") == 0, F.col(level)), fine).alias("recommended"), F.max_by(level, position).alias("last"),
        F.count(F.lit(1)).alias("n"),
    ).select("recommended", (F.coalesce(F.col("recommended") == F.col("last"), F.lit(False)) & (F.col("n") > 1)).alias("still_rising"))


def levels_up_to(most: int) -> list[int]:
    """Powers of two, then ``most``."""
    found = [1 << k for k in range(most.bit_length()) if 1 << k <= most]
    return found if found and found[-1] == most else [*found, most]


def batches_up_to(most: int) -> list[int]:
    found = [n for n in (1, 8, 32, 128, 512) if n <= most]
    return found if found and found[-1] == most else [*found, most]


def sweep(
    levels: list[int], run: Callable[[int], DataFrame], warmup: Callable[[int], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Run each level once (after its warm-up); returns the logs in one frame and elapsed by level."""
    logs, took, spark = None, [], None
    for k, n in enumerate(levels):
        if warmup is not None:
            warmup(n).count()
        began = time.monotonic()
        rows = written(run(n).withColumn("level", F.lit(n)).withColumn("position", F.lit(k)), "bench")
        took.append((n, k, time.monotonic() - began))
        logs, spark = rows if logs is None else logs.unionByName(rows, allowMissingColumns=True), rows.sparkSession
    return logs, spark.createDataFrame(took, "level int, position int, elapsed_s double")


def for_seconds(seconds: float, run: Callable[[int], DataFrame]) -> tuple[DataFrame, float]:
    """Repeat chunks until the time is over; their rows in one frame, and the time taken."""
    began, rows, k = time.monotonic(), None, 0
    while rows is None or time.monotonic() - began < seconds:
        part = written(run(k), "bench")
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
        k += 1
    return rows, time.monotonic() - began


def as_json(levels: DataFrame, recommendation: DataFrame | None = None) -> str:
    """The summary for people and scripts; levels are few."""
    body: dict = {"results": [r.asDict(recursive=True) for r in levels.collect()]}
    if recommendation is not None:
        body["recommendation"] = recommendation.first().asDict()
    return json.dumps(body, indent=2)
