"""A durable, resumable run over JSON lines.

A run directory holds

    _run.json            schema version, mapping fingerprint, endpoint, identity of the source's files
    ledger/              Parquet: one pending row for each source row with its place there, written once, in ranges of the index
    work-*/chunk=N/      Parquet: which rows a chunk does; manifest.json, written last, lists the chunks
    journal/chunk=N/     answers of the chunk at hand, if the run keeps a journal; gone once it's settled
    output/chunk=N/      JSON lines of settled rows
    settled/chunk=N/     Parquet: their index and state

Pending rows are dealt into chunks of exact size by one write, and each chunk reads its own files. Of a source
whose files are the same ones still (names, lengths, times) a resumed run parses nothing again:
the ledger is what the source holds, and each chunk reads the bytes of its rows. Each row is checked against its
fingerprint there. Where files have changed, are packed, or are in a store that tasks can't open, the source
is parsed and joined to the ledger instead. A chunk's output is written first, then its entry in the
settle log: a crash between both repeats the chunk's calls and output, and readers keep the
latest chunk of each index. A crash loses at most the chunk in flight; with a journal (``journal``, or
``on_row``) the repeated chunk replays what was answered and asks for the rest only. Nothing is ever
overwritten in place: a fresh run is built beside the old one and renamed over it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from batchloom.operators import planner
from batchloom.operators.dispatch import DispatchConfig, generate
from batchloom.operators.journal import Journal, followed
from batchloom.operators.mapping import mapper_fingerprint, prepared
from batchloom.operators.results import records
from batchloom.schemas import ERROR, SUCCESS
from batchloom.sources import lines, places
from batchloom.store import Folder

VERSION = 1


@dataclass(frozen=True)
class RunConfig:
    run_dir: str
    dispatch: DispatchConfig
    input_path: str | None = None
    prompt: str | None = None
    mapper: Callable[[dict], dict] | None = None
    mapper_spec: str | None = None
    native_mapper: Callable[[DataFrame], DataFrame] | None = None
    resume: bool = False
    retry_errors: bool = False
    parse_json: bool = False
    chunk_rows: int = 100_000
    on_status: Callable[[str], None] | None = None
    on_progress: Callable[[int, int], None] | None = None
    on_result: Callable[[DataFrame], None] | None = None  # gets the output rows of each settled chunk
    on_row: Callable[[dict], None] | None = None  # gets each answer as it comes, in the caller's thread; keeps a journal
    journal: bool = False
    job_tag: str | None = None  # for ``cancel``

    def __post_init__(self) -> None:
        if (self.input_path is None) == (self.prompt is None):
            raise ValueError("a run needs either an input path or a prompt")
        if self.mapper is not None and self.native_mapper is not None:
            raise ValueError("a run takes one mapper")
        if self.input_path and lines.same_file(self.input_path, self.run_dir):
            raise ValueError("input and output are the same file")
        if self.chunk_rows < 1:
            raise ValueError("chunk_rows must be at least 1")


def run_dir_of(output: str, checkpoint_dir: str | None = None) -> str:
    """Where the ledger of an output lives: beside it, or below ``checkpoint_dir`` under a name
    that is its own for each full path."""
    import hashlib

    path = Path(output).absolute()
    if checkpoint_dir is None:
        return f"{path}.run"
    return str(Path(checkpoint_dir) / f"{path.name}.{hashlib.sha256(str(path).encode()).hexdigest()[:8]}.run")


def _meta(config: RunConfig) -> dict:
    mapper = config.native_mapper or config.mapper
    return {
        "schema_version": VERSION, "mapping_fingerprint": mapper_fingerprint(mapper, config.mapper_spec),
        "endpoint": config.dispatch.endpoint,
    }


def _source(spark: SparkSession, config: RunConfig) -> DataFrame:
    found = lines.json_lines(spark, config.input_path) if config.input_path is not None else lines.prompt(spark, config.prompt)
    return planner.with_occurrence(found)


def _chunks(spark: SparkSession, run_dir: str, name: str) -> list[int]:
    """Numbers of the chunks that were finished."""
    folder = Folder(spark, f"{run_dir}/{name}")
    return sorted(int(n.split("=")[1]) for n in folder.names() if n.startswith("chunk=") and folder.exists(f"{n}/_SUCCESS"))


def settled(spark: SparkSession, run_dir: str) -> DataFrame | None:
    """output_index, status, chunk_id of every finished chunk."""
    found = _chunks(spark, run_dir, "settled")
    if not found:
        return None
    rows = spark.read.option("basePath", f"{run_dir}/settled").schema(
        "output_index bigint, status tinyint, chunk int"
    ).parquet(*[f"{run_dir}/settled/chunk={k}" for k in found])
    return rows.withColumnRenamed("chunk", "chunk_id")


OUTPUT = "_index bigint, output_text string, output_parsed variant, token_usage struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint,reasoning_tokens:bigint>, request_id string, finish_reason string, error string, metadata string"


def output(spark: SparkSession, run_dir: str, chunk: int | None = None) -> DataFrame:
    """The settled rows (of one chunk), of repeated ones the latest chunk's; sort by ``_index`` for source order."""
    chunks = [k for k in _chunks(spark, run_dir, "output") if chunk in (None, k)]
    if not chunks:
        return spark.createDataFrame([], OUTPUT)
    rows = spark.read.schema(f"{OUTPUT}, chunk int").option("basePath", f"{run_dir}/output").json(
        [f"{run_dir}/output/chunk={k}" for k in chunks]
    )
    rows = rows.withColumnRenamed("chunk", "_chunk")
    last = rows.groupBy("_index").agg(F.max("_chunk").alias("_chunk"))
    return rows.join(last, ["_index", "_chunk"], "left_semi").drop("_chunk")


def _begin(spark: SparkSession, config: RunConfig) -> None:
    """Build a fresh run in a folder beside, then put it in place; the old run survives a failure."""
    target, mark = Folder(spark, config.run_dir), uuid.uuid4().hex[:12]
    staged = Folder(spark, f"{target.path}.new-{mark}")
    try:
        # Taken before the scan: a change while it runs shows as one later.
        meta = _meta(config) | {"source": places.identity(spark, config.input_path) if config.input_path is not None else None}
        ledger = planner.bootstrap(_source(spark, config))
        ledger.repartitionByRange("output_index").sortWithinPartitions("output_index").write.parquet(f"{staged.path}/ledger")
        staged.put("_run.json", json.dumps(meta))
        old = None
        if target.exists():
            old = Folder(spark, f"{target.path}.old-{mark}")
            target.rename(old.path)
        staged.rename(target.path)
        if old:
            old.remove()
    except BaseException:
        staged.remove()
        raise


def _same_files(spark: SparkSession, config: RunConfig) -> bool:
    """Whether the source's files are those that the ledger was made from."""
    if config.input_path is None:
        return False
    known = json.loads(Folder(spark, config.run_dir).text("_run.json")).get("source")
    return known is not None and known == places.identity(spark, config.input_path)


def _check(spark: SparkSession, config: RunConfig) -> None:
    """Raise unless the run can be resumed. Without joins of rows, as long as nothing is wrong."""
    path = Folder(spark, config.run_dir)
    if not path.exists("_run.json") or not path.exists("ledger"):
        raise planner.MismatchError(f"{path.path} holds no run to resume")
    meta, mine = json.loads(path.text("_run.json")), _meta(config)
    if meta["schema_version"] != VERSION:
        raise planner.MismatchError(f"run version {meta['schema_version']} isn't {VERSION}")
    if meta["mapping_fingerprint"] != mine["mapping_fingerprint"]:
        raise planner.MismatchError("the mapper has changed since the run began")
    log = settled(spark, config.run_dir)
    ledger = spark.read.parquet(f"{path.path}/ledger")
    planner.validate_log(ledger, log)
    if not _same_files(spark, config):
        planner.validate(_source(spark, config), ledger)
    planner.validate_output(planner.current(ledger, log), output(spark, config.run_dir))


def run(spark: SparkSession, config: RunConfig) -> int:
    """Do all pending rows; returns their number."""
    if config.job_tag is None:
        return _run(spark, config)
    spark.sparkContext.addJobTag(config.job_tag)
    try:
        return _run(spark, config)
    finally:
        spark.sparkContext.removeJobTag(config.job_tag)


def cancel(spark: SparkSession, job_tag: str) -> None:
    """Stop the runs with this tag: their tasks cancel what they have in flight."""
    spark.sparkContext.cancelJobsWithTag(job_tag)


def _readable(spark: SparkSession, config: RunConfig, ledger: DataFrame) -> bool:
    """Whether pending rows can be read by their places in the source."""
    return (
        set(places.PLACE) <= set(ledger.columns) and _same_files(spark, config) and places.seekable(spark, config.input_path)
    )


def deal(spark: SparkSession, rows: DataFrame, size: int, path: str) -> list[dict]:
    """Write ``rows`` once, a folder for each chunk of ``size`` rows in index order, then the manifest: chunk, rows,
    first and last index of each. Without a manifest nothing was dealt."""
    planner.chunked(rows, size).sortWithinPartitions("chunk", "output_index").write.partitionBy("chunk").parquet(path)
    found = spark.read.parquet(path) if any(n.startswith("chunk=") for n in Folder(spark, path).names()) else None
    chunks = [] if found is None else [
        r.asDict() for r in found.groupBy("chunk").agg(
            F.count(F.lit(1)).alias("rows"), F.min("output_index").alias("first"), F.max("output_index").alias("last"),
        ).orderBy("chunk").collect()
    ]
    Folder(spark, path).put("manifest.json", json.dumps(chunks))
    return chunks


def dealt(spark: SparkSession, path: str, chunk: int) -> DataFrame:
    """The rows of one chunk; no other file is read."""
    return spark.read.parquet(f"{path}/chunk={chunk}")


def _run(spark: SparkSession, config: RunConfig) -> int:
    tell = config.on_status or (lambda text: None)
    if config.resume:
        _check(spark, config)
    else:
        _begin(spark, config)
    ledger = planner.current(spark.read.parquet(f"{config.run_dir}/ledger"), settled(spark, config.run_dir))
    by_place = _readable(spark, config, ledger)
    work = Folder(spark, f"{config.run_dir}/work-{uuid.uuid4().hex[:12]}")
    todo = planner.todo(ledger, config.retry_errors) if by_place else planner.pending(_source(spark, config), ledger, config.retry_errors)
    try:
        chunks = deal(spark, todo, config.chunk_rows, work.path)
        total = sum(c["rows"] for c in chunks)
        if not total:
            tell("nothing to do")
            return 0
        first = max([*_chunks(spark, config.run_dir, "output"), *_chunks(spark, config.run_dir, "settled"), -1]) + 1
        done = 0
        for k, c in enumerate(chunks):
            part = dealt(spark, work.path, c["chunk"])
            if by_place:  # places are dealt out before any line is read
                part = places.read_places(part.repartitionByRange(spark.sparkContext.defaultParallelism, "output_index").sortWithinPartitions("output_index"))
            n = _settle(spark, config, part, first + k)
            if config.on_result:
                config.on_result(output(spark, config.run_dir, first + k))
            done += n
            tell(f"{done} of {total} rows settled")
            if config.on_progress:
                config.on_progress(done, total)
        return done
    finally:
        work.remove()


def _fresh(spark: SparkSession, path: str) -> str:
    """A chunk folder left by a crash has no _SUCCESS and is replaced."""
    Folder(spark, path).remove()
    return path


def _settle(spark: SparkSession, config: RunConfig, part: DataFrame, chunk: int) -> int:
    work = prepared(part, config.dispatch.endpoint, config.mapper, config.native_mapper)
    requests = work.select(F.col("output_index").alias("_index"), "request", "error", "metadata")
    # Answers are written once: later reads never call the provider again.
    raw = _fresh(spark, f"{config.run_dir}/answers/chunk={chunk}")
    journal = Folder(spark, f"{config.run_dir}/journal/chunk={chunk}")
    if config.journal or config.on_row:
        Journal(journal.path).reopen()  # a strict run that failed may go on
        calls = generate(requests, replace(config.dispatch, journal=journal.path))
    else:
        calls = generate(requests, config.dispatch)
    if config.on_row:
        followed(journal.path, lambda: calls.write.parquet(raw), config.on_row)
    else:
        calls.write.parquet(raw)
    answers = spark.read.parquet(raw)
    kept = requests.where("error is null").select("_index", "metadata")
    rows = records(answers, config.dispatch.endpoint, config.parse_json, kept)
    rows.write.option("ignoreNullFields", "false").json(_fresh(spark, f"{config.run_dir}/output/chunk={chunk}"))
    log = answers.select(
        F.col("_index").alias("output_index"), F.when(F.col("error").isNull(), SUCCESS).otherwise(ERROR).cast("tinyint").alias("status"),
    )
    counted = Observation()
    log.observe(counted, F.count(F.lit(1)).alias("rows")).write.parquet(_fresh(spark, f"{config.run_dir}/settled/chunk={chunk}"))
    Folder(spark, raw).remove()
    journal.remove()
    return counted.get["rows"]


def as_lines(rows: DataFrame) -> DataFrame:
    """``value``: each row as a JSON line with its nulls, in index order; metadata only where there is some."""
    plain = [c for c in rows.columns if c != "metadata"]
    line = F.to_json(F.struct(*plain), {"ignoreNullFields": "false"})
    if "metadata" in rows.columns:
        more = F.concat(F.substring(line, F.lit(1), F.length(line) - 1), F.lit(',"metadata":'), F.col("metadata"), F.lit("}"))
        line = F.coalesce(more, line)
    return rows.orderBy("_index").select(line.alias("value"))


def export(spark: SparkSession, run_dir: str, path: str) -> int:
    """The output as JSON lines in source order, written by Spark; returns the number of rows."""
    rows = output(spark, run_dir)
    put_lines(spark, as_lines(rows), path)
    return rows.count()


def put_lines(spark: SparkSession, lines_: DataFrame, path: str) -> None:
    """A text file at ``path``, whole or not at all; executors write parts, which are then joined in order.

    The parts are joined through the store's streams in blocks, not through the driver's memory.
    """
    beside = Folder(spark, f"{path}.parts-{uuid.uuid4().hex[:12]}")
    try:
        lines_.write.text(beside.path)
        beside.join("part-", f"{beside.path}/joined")
        Folder(spark, path).remove()
        Folder(spark, f"{beside.path}/joined").rename(path)
    finally:
        beside.remove()
