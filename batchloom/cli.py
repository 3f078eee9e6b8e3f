"""Command line: generate, embed, transcribe, bench generate, bench embed.

Exit codes: 0 also when rows failed, 1 when the run couldn't be set up or finished, 2 on usage.
"""

from __future__ import annotations

import argparse
import importlib
import json
import os
import sys
from dataclasses import replace
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from batchloom.operators import bench
from batchloom.operators.dispatch import ROUTING, DispatchConfig, embed, generate, transcribe
from batchloom.operators.limits import Limits
from batchloom.operators.mapping import load_mapper, normalised, truthy_input
from batchloom.operators.results import embedded, generated, transcribed
from batchloom.plans import workflow
from batchloom.schemas import ENDPOINTS
from batchloom.sources import lines, settings
from batchloom.store import Folder, fresh_path, written


def _common(p: argparse.ArgumentParser) -> None:
    p.add_argument("--model", default="")
    p.add_argument("--provider", default="batchloom.operators.provider:EchoProvider", help="package.module:factory")
    p.add_argument("--api-base", action="append", default=[])
    p.add_argument("--env-file")
    p.add_argument("--deployments-toml")
    p.add_argument("--routing-strategy", choices=ROUTING, default="simple-shuffle")
    p.add_argument("--max-parallel-requests", type=int)
    for name in ("rpm", "tpm", "rpd", "tpd", "max-request-burst", "max-token-burst"):
        p.add_argument(f"--{name}", type=int)
    p.add_argument("--max-retries", type=int, default=3)


def parser() -> argparse.ArgumentParser:
    root = argparse.ArgumentParser(prog="batchloom")
    verbs = root.add_subparsers(dest="verb", required=True)
    g = verbs.add_parser("generate")
    _common(g)
    g.add_argument("--prompt")
    g.add_argument("--input-jsonl")
    g.add_argument("--output-jsonl")
    g.add_argument("--checkpoint-dir")
    g.add_argument("--endpoint", choices=ENDPOINTS, default="chat_completion")
    g.add_argument("--parse-json", action="store_true")
    g.add_argument("--resume", action="store_true")
    g.add_argument("--mapper")
    e = verbs.add_parser("embed")
    _common(e)
    e.add_argument("--text")
    e.add_argument("--input-jsonl")
    e.add_argument("--output-jsonl")
    e.add_argument("--no-vectors", action="store_true")
    t = verbs.add_parser("transcribe")
    _common(t)
    t.add_argument("path", nargs="?")
    t.add_argument("--input-jsonl")
    t.add_argument("--output-jsonl")
    b = verbs.add_parser("bench").add_subparsers(dest="task", required=True)
    for name in ("generate", "embed"):
        x = b.add_parser(name)
        _common(x)
        x.add_argument("--prompt" if name == "generate" else "--text")
        x.add_argument("--input-jsonl")
        x.add_argument("--output-json")
        x.add_argument("--endpoint", choices=ENDPOINTS, default="chat_completion")
        x.add_argument("--warmup", type=int, default=5 if name == "generate" else 3)
        x.add_argument("--requests", type=int, default=50 if name == "generate" else 20)
        x.add_argument("--max-level", type=int, default=32 if name == "generate" else 512)
        x.add_argument("--duration", type=float)
    return root


def _factory(spec: str) -> Any:
    module, _, name = spec.rpartition(":")
    return getattr(importlib.import_module(module), name)


def dispatch_config(a: argparse.Namespace, **more: Any) -> DispatchConfig:
    """Deployments from a file come before repeated base URLs, these before a single one."""
    key = os.environ.get("OPENAI_API_KEY")
    found: list[settings.Deployment] = []
    if a.deployments_toml:
        found = settings.deployments(a.deployments_toml)
    elif len(a.api_base) > 1:
        found = settings.replicas(a.model, a.api_base, key)
    limits = Limits(a.rpm, a.tpm, a.rpd, a.tpd, a.max_request_burst, a.max_token_burst)
    single = {} if found else {"api_base": a.api_base[0] if a.api_base else None, "api_key": key}
    return DispatchConfig(
        a.model or (found[0].model if found else ""), _factory(a.provider), deployments=tuple(found),
        max_parallel_requests=a.max_parallel_requests, limits=limits, max_retries=a.max_retries, routing_strategy=a.routing_strategy,
        **single, **more,
    )


def _session() -> SparkSession:
    spark = SparkSession.getActiveSession()
    if spark is None:
        spark = SparkSession.builder.appName("batchloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    root = str(Path(__file__).resolve().parent.parent)
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)
    return spark


def _put(spark: SparkSession, rows, path: str | None) -> None:
    """JSON lines in index order, to a file (whole or not at all) or to standard output."""
    text = workflow.as_lines(rows)
    if path is not None:
        workflow.put_lines(spark, text, path)
        return
    for r in text.toLocalIterator():  # a terminal is the driver's own
        print(r["value"], flush=True)


def _generate(a: argparse.Namespace) -> None:
    spark = _session()
    source, spool = a.input_jsonl, None
    if a.resume and not a.output_jsonl:
        raise ValueError("--resume needs --output-jsonl")
    if a.input_jsonl and a.output_jsonl and lines.same_file(a.input_jsonl, a.output_jsonl):
        raise ValueError("input and output are the same file")
    if source is None and a.prompt is None:
        source = spool = lines.stdin_spool(spark)
    mapper = load_mapper(a.mapper) if a.mapper else None
    own = None
    try:
        if a.output_jsonl:
            folder = workflow.run_dir_of(a.output_jsonl, a.checkpoint_dir)
        else:
            folder = own = fresh_path(spark, "run")
        config = workflow.RunConfig(
            folder, dispatch_config(a, endpoint=a.endpoint), source, a.prompt, mapper, a.mapper, resume=a.resume, parse_json=a.parse_json,
            on_status=lambda s: print(s, file=sys.stderr),
        )
        workflow.run(spark, config)
        if a.output_jsonl:
            workflow.export(spark, folder, a.output_jsonl)
        else:
            _put(spark, workflow.output(spark, folder).drop("metadata"), None)
    finally:
        for made in filter(None, (spool, own)):
            Folder(spark, made).remove()


def _embed(a: argparse.Namespace) -> None:
    spark = _session()
    if a.text is not None:
        rows = lines.items(spark, [a.text]).withColumnRenamed("input", "text")
    else:
        rows = lines.field_rows(lines.json_lines(spark, a.input_jsonl), "text")
    answers = written(embed(rows, dispatch_config(a)), "answers")
    _put(spark, embedded(answers, not a.no_vectors).drop("call_id", "metrics"), a.output_jsonl)


def _transcribe(a: argparse.Namespace) -> None:
    spark = _session()
    paths = lines.items(spark, [a.path]).withColumnRenamed("input", "path") if a.path else lines.field_rows(
        lines.json_lines(spark, a.input_jsonl), "path",
    )
    answers = written(transcribe(lines.audio_paths(spark, paths), dispatch_config(a)), "answers")
    _put(spark, transcribed(answers).drop("metrics"), a.output_jsonl)


def _log(answers, endpoint: str):
    r = generated(answers, endpoint)
    usage = lambda k: F.coalesce(F.col(f"token_usage.{k}"), F.lit(0))
    return r.select(
        "_index", F.col("error").isNotNull().alias("failed"), "metrics.end_to_end_s", "metrics.service_time_s", "metrics.queue_wait_s",
        "metrics.deployment", "call_id", usage("prompt_tokens").alias("prompt_tokens"), usage("completion_tokens").alias("output_tokens"),
        usage("total_tokens").alias("total_tokens"),
    )


def _bench(a: argparse.Namespace) -> None:
    spark = _session()
    if a.task == "generate":
        source = lines.prompt(spark, a.prompt) if a.prompt is not None else lines.json_lines(spark, a.input_jsonl)
        n = normalised(truthy_input(F.col("record")), a.endpoint)
        base = source.where("record is not null").select(
            F.col("source_index").alias("_index"), n.alias("n"),
        ).select("_index", "n.request", "n.error")
        config = dispatch_config(a, endpoint=a.endpoint)
        run = lambda c, k: _log(generate(lines.cycle(base, k), replace(config, max_parallel_requests=c)), a.endpoint)
        levels = bench.levels_up_to(a.max_level)
    else:
        base = lines.items(spark, [a.text]).withColumnRenamed("input", "text") if a.text is not None else lines.field_rows(
            lines.json_lines(spark, a.input_jsonl), "text",
        )
        run = lambda c, k: _log(embed(lines.cycle(base, k * c), dispatch_config(a), micro_batch_size=c), "chat_completion")
        levels = bench.batches_up_to(a.max_level)
    timed = (lambda c: bench.for_seconds(a.duration, lambda _: run(c, a.requests))[0]) if a.duration else (lambda c: run(c, a.requests))
    log, elapsed = bench.sweep(levels, timed, lambda c: run(c, a.warmup))
    found = bench.summary(log, elapsed.select("level", "elapsed_s")).join(elapsed.select("level", "position"), "level")
    if a.task == "generate":
        best = bench.recommend(found)
    else:
        found = found.withColumn("vectors_per_second", F.col("requests_per_second"))
        best = bench.recommend_embed(found)
    text = bench.as_json(found.orderBy("position"), best)
    for r in json.loads(text)["results"]:
        print(
            f"{r['level']:>5}  {r['requests_per_second']:.2f}/s  p50 {r['p50_latency_s']:.3f} s  p95 {r['p95_latency_s']:.3f} s  failures {r['failures']}",
            file=sys.stderr,
        )
    if a.output_json:
        Path(a.output_json).write_text(text)
    else:
        print(text)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        if a.env_file:
            settings.load_env(a.env_file)
        {"generate": _generate, "embed": _embed, "transcribe": _transcribe, "bench": _bench}[a.verb](a)
    except Exception as error:  # noqa: BLE001 - the exit code tells
        print(f"error: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
