"""Row sources: JSON lines, prompts, in-memory rows, text and path lists, binary files."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.functions.fingerprint import parse_strict
from batchloom.sources.places import located
from batchloom.store import Folder, fresh_path

MAX_AUDIO_BYTES = 25 * 1024 * 1024
_LOCAL_BITS = 33  # monotonically_increasing_id: the row within its partition


def with_index(df: DataFrame, name: str = "source_index") -> DataFrame:
    """A gapless index from 0 in the order of partitions, without a global window or an RDD.

    The driver gets one count for each partition. ``df`` must come out in the same partitions
    each time (a scan does).
    """
    spark = df.sparkSession
    tagged = df.withColumn("_mono", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_mono", _LOCAL_BITS))
    counts = sorted((r["_part"], r["count"]) for r in tagged.groupBy("_part").count().collect())
    offsets, total = [], 0
    for part, n in counts:
        offsets.append((part, total))
        total += n
    table = F.broadcast(spark.createDataFrame(offsets, "_part bigint, _before bigint"))  # a row for each partition
    local = F.col("_mono").bitwiseAND((1 << _LOCAL_BITS) - 1)
    return tagged.join(table, "_part").withColumn(name, F.col("_before") + local).drop("_mono", "_part", "_before")


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """source_index, raw_line, record, parse_error, record_fingerprint and place of the non-blank lines."""
    return located(spark, path)


def stripped(lines: DataFrame) -> DataFrame:
    """raw_line: the text without white space at its ends; blank lines go."""
    return lines.select(F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("raw_line")).where("raw_line <> ''")


def parsed(lines: DataFrame) -> DataFrame:
    """Parse ``raw_line`` strictly; errors are data."""
    return lines.withColumn("p", parse_strict("raw_line")).select("*", "p.*").drop("p")


def prompt(spark: SparkSession, text: str) -> DataFrame:
    """One row from a prompt."""
    import json

    line = spark.createDataFrame([(0, json.dumps({"prompt": text}, ensure_ascii=False))], "source_index bigint, raw_line string")
    return parsed(line)


def stdin_spool(spark: SparkSession, stream: Iterable[str] | None = None, block: int = 8 << 20) -> str:
    """Copy standard input to a file in the shared folder, so that tasks can read it again; the caller
    removes it. The driver holds a block at a time."""
    folder = Folder(spark, fresh_path(spark, "stdin"))

    def blocks() -> Iterator[str]:
        held: list[str] = []
        size = 0
        for line in stream if stream is not None else sys.stdin:
            held.append(line if line.endswith("\n") else line + "\n")
            size += len(line)
            if size >= block:
                yield "".join(held)
                held, size = [], 0
        yield "".join(held)

    folder.put("stdin.jsonl", blocks())
    return folder.path


def items(spark: SparkSession, values: Sequence[object], schema: str = "string") -> DataFrame:
    """_index and input of a sequence."""
    return spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"_index bigint, input {schema}")


def strict_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines where a malformed line raises."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def field_rows(source: DataFrame, field: str) -> DataFrame:
    """_index and the field (as text) of those records that have it; raises when none has."""
    found = source.where("record is not null").select(
        F.col("source_index").alias("_index"), F.get_json_object("record", f"$.{field}").alias(field),
    ).where(F.col(field).isNotNull())
    if found.isEmpty():
        raise ValueError(f"no row has a {field!r} field")
    return found


def audio(spark: SparkSession, path: str, most: int = MAX_AUDIO_BYTES) -> DataFrame:
    """_index, path, content and error of binary files; those over ``most`` bytes are error rows.

    Two scans of the listing, one for each side of the limit. Spark's reader applies a filter on the length
    before it opens a file, and the second scan has no content at all: no byte of a rejected file is
    read, and none fails for being too large to be a row.
    """
    files = spark.read.format("binaryFile").load(path)
    fit = files.where(F.col("length") <= most).select("path", "length", "content")
    rest = files.where((F.col("length") > most) | F.col("length").isNull()).select("path", "length", F.lit(None).cast("binary").alias("content"))
    return with_index(guarded(fit.union(rest), most), "_index")


def guarded(files: DataFrame, most: int = MAX_AUDIO_BYTES) -> DataFrame:
    """``length`` becomes ``error``; the content of files over ``most`` bytes isn't kept."""
    big = F.col("length") > most
    error = F.when(
        F.col("length").isNull(), F.concat(F.lit("not a regular file: "), F.col("path")),
    ).when(big, F.lit(f"audio exceeds {most} bytes"))
    return files.withColumn("error", error).withColumn("content", F.when(F.col("error").isNull(), F.col("content"))).drop("length")


def audio_paths(spark: SparkSession, paths: DataFrame, most: int = MAX_AUDIO_BYTES) -> DataFrame:
    """As ``audio`` for a frame of _index and path (or URI), read by the tasks that hold the
    rows; missing files are error rows, and files over ``most`` bytes aren't read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                own = b.slice(at, 1)
                length, content = _file(own.column(1)[0].as_py(), most)
                yield pa.RecordBatch.from_arrays(
                    [*own.columns, pa.array([length], pa.int64()), pa.array([content], pa.binary())],
                    ["_index", "path", "length", "content"],
                )

    rows = paths.select(F.col("_index").cast("bigint").alias("_index"), F.col("path").cast("string").alias("path"))
    return guarded(rows.mapInArrow(read, "_index bigint, path string, length bigint, content binary"), most)


def _file(path: str | None, most: int) -> tuple[int | None, bytes | None]:
    """Size and bytes of a file; without bytes if it is too large, without both if there is none."""
    from pyarrow import fs

    try:
        store, own = fs.FileSystem.from_uri(path if "://" in path else Path(path).absolute().as_uri())
        info = store.get_file_info(own)
        if info.type != fs.FileType.File:
            return None, None
        if info.size > most:
            return info.size, None
        with store.open_input_stream(own) as f:
            return info.size, f.read()
    except (OSError, TypeError, ValueError):
        return None, None


def cycle(df: DataFrame, n: int, index: str = "_index") -> DataFrame:
    """``n`` rows by repeating the rows of ``df`` in index order."""
    spark = df.sparkSession
    size = df.count()
    if not size:
        return df
    turns = spark.range(n).withColumnRenamed("id", "_turn")
    rows = df.withColumnRenamed(index, "_old")
    return turns.join(rows, F.col("_turn") % size == F.col("_old")).drop("_old").withColumnRenamed("_turn", index)


def same_file(source: str, target: str) -> bool:
    """Whether two local paths are one file."""
    a, b = Path(source), Path(target)
    return a.exists() and b.exists() and a.samefile(b) or a.resolve() == b.resolve()
