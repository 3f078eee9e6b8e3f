"""Lines with their places in a source (file, first byte, bytes), and reading by place.

A scan finds places once. What is read again later, such as the pending rows of a run, is read by its
places: bytes of other rows are skipped, and no row of the source is parsed twice for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchloom.functions.fingerprint import parse_line

PLACE = ["source_file", "byte_start", "byte_size"]
PACKED = (".gz", ".gzip", ".bz2", ".zst", ".zstd", ".deflate", ".snappy", ".lz4", ".xz")  # no place can be sought in these
_PARSED = "raw_line string, record string, parse_error string, record_fingerprint binary"


class SourceChangedError(ValueError):
    """What stands at a row's place isn't the row."""


def _pieces(line: bytes) -> Iterator[tuple[int, bytes]]:
    """A line between two line feeds, cut at carriage returns: first byte and bytes of each part that isn't blank."""
    at = 0
    for part in line.split(b"\r"):
        if part.strip() and part.decode("utf-8", "replace").strip():
            yield at, part
        at += len(part) + 1


def _row(part: bytes) -> tuple[str, str | None, str | None, bytes]:
    """raw_line and its parse; bytes that aren't UTF-8 make an error row."""
    found = parse_line(part.decode("utf-8", "surrogateescape").strip())
    return part.decode("utf-8", "replace").strip(), found["record"], found["parse_error"], found["record_fingerprint"]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, list[bytes], np.ndarray]]:
    """file, block, first byte (in the block), lines and their bytes with the line feed, of each stretch of one block."""
    own, at = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        names, block = b.column(1).dictionary_encode(), b.column(2).to_numpy()
        code = names.indices.to_numpy()
        cuts = np.flatnonzero((code[1:] != code[:-1]) | (block[1:] != block[:-1])) + 1
        size = pc.binary_length(b.column(0)).to_numpy().astype(np.int64) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
            name, first = names.dictionary[int(code[low])].as_py(), int(block[low])
            if (name, first) != own:
                own, at = (name, first), 0
            yield name, first, at, b.column(0).slice(low, high - low).to_pylist(), size[low:high]
            at += int(size[low:high].sum())


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for name, block, _, lines, size in _blocks(batches):
        rows = sum(1 for line in lines for _ in _pieces(line))
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block]), pa.array([int(size.sum())]), pa.array([rows])], ["source_file", "block", "size", "rows"])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own, seen = None, 0
    for name, block, at, lines, size in _blocks(batches):
        if (name, block) != own:
            own, seen = (name, block), 0
        starts = at + np.cumsum(size) - size
        found = [(int(s) + k, len(part), *_row(part)) for s, line in zip(starts, lines) for k, part in _pieces(line)]
        n = len(found)
        columns = [list(c) for c in zip(*found)] if n else [[]] * 6
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([name] * n, pa.string()), pa.array([block] * n, pa.int64()), pa.array(np.arange(seen, seen + n)), pa.array(columns[0], pa.int64()),
                pa.array(columns[1], pa.int64()), *(pa.array(c, t) for c, t in zip(columns[2:], (pa.string(), pa.string(), pa.string(), pa.binary()))),
            ],
            ["source_file", "block", "line", "byte_start", "byte_size", "raw_line", "record", "parse_error", "record_fingerprint"],
        )
        seen += n


def text_lines(reader, path: str) -> DataFrame:
    """value, source_file and block of all lines, by a batch or stream reader."""
    return reader.option("lineSep", "\n").text(path).select(
        F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block"),
    )


def indexed(lines: DataFrame) -> tuple[DataFrame, int]:
    """source_index, raw_line, record, parse_error, record_fingerprint and place of the non-blank ones among
    ``text_lines``, and their number.

    The index is gapless from 0, by file name and place in the file, however Spark packs files into
    tasks. The driver gets one row for each block of a file. Places in packed files are null.
    """
    totals = lines.mapInArrow(_totals, "source_file string, block bigint, size bigint, rows bigint")
    before, last, rows, size = [], None, 0, 0
    for name, block, n_bytes, n_rows in sorted(totals.groupBy("source_file", "block").agg(F.sum("size"), F.sum("rows")).collect()):
        if name != last:
            last, size = name, 0
        before.append((name, block, size, rows))
        size, rows = size + n_bytes, rows + n_rows
    table = lines.sparkSession.createDataFrame(before, "source_file string, block bigint, _bytes bigint, _rows bigint")
    parsed = lines.mapInArrow(_parse, f"source_file string, block bigint, line bigint, byte_start bigint, byte_size bigint, {_PARSED}")
    packed = F.lower("source_file").rlike("(" + "|".join(p.replace(".", r"\.") for p in PACKED) + ")$")
    return parsed.join(F.broadcast(table), ["source_file", "block"]).select(  # a row for each block
        (F.col("_rows") + F.col("line")).alias("source_index"), "raw_line", "record", "parse_error", "record_fingerprint", "source_file",
        F.when(~packed, F.col("_bytes") + F.col("byte_start")).alias("byte_start"), "byte_size",
    ), rows


def located(spark: SparkSession, path: str) -> DataFrame:
    """The non-blank lines of files, as ``indexed`` gives them."""
    return indexed(text_lines(spark.read, path))[0]


def identity(spark: SparkSession, path: str) -> dict[str, str]:
    """What tells whether the files of a source are the same ones still: their number, bytes, and a hash of
    names, lengths and times. No content is read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    found = files.agg(
        F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0)), F.coalesce(F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")), F.lit(0)),
    ).first()
    return dict(zip(("files", "bytes", "hash"), map(str, found)))


def seekable(spark: SparkSession, path: str) -> bool:
    """Whether tasks can read bytes of the source's files: none is packed, and ``pyarrow.fs`` knows the store."""
    from pyarrow import fs

    names = spark.read.text(path).inputFiles()
    if not names or any(n.lower().endswith(PACKED) for n in names):
        return False
    try:
        store, own = fs.FileSystem.from_uri(names[0])
        return store.get_file_info(own).type == fs.FileType.File
    except (OSError, ValueError):
        return False


def spans(starts: np.ndarray, sizes: np.ndarray, gap: int, most: int = 32 << 20) -> list[tuple[int, int]]:
    """(first, end) of runs of rows that one read takes: rising places with gaps of at most ``gap`` bytes, up to ``most`` bytes."""
    out, first = [], 0
    for k in range(1, len(starts) + 1):
        if k < len(starts):
            skipped = starts[k] - (starts[k - 1] + sizes[k - 1])
            if 0 <= skipped <= gap and starts[k] + sizes[k] - starts[first] <= most:
                continue
        out.append((first, k))
        first = k
    return out


def read_places(rows: DataFrame, gap: int = 4096) -> DataFrame:
    """``rows`` (record_fingerprint and a place, with any other columns) and raw_line, record, parse_error.

    Rows of a task that stand in the order of their places are read in few reads; at most ``gap`` bytes
    between two rows are read along. A row whose fingerprint is another one now raises.
    """
    kept = [f for f in rows.schema.fields if f.name not in ("raw_line", "record", "parse_error")]
    own = rows.select([f.name for f in kept])
    more = [T.StructField(n, T.StringType()) for n in ("raw_line", "record", "parse_error")]
    file_at, start_at, size_at, print_at = (own.columns.index(c) for c in (*PLACE, "record_fingerprint"))
    names = [*own.columns, *(f.name for f in more)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        last, handle = None, None
        try:
            for whole in batches:
                for low in range(0, whole.num_rows, 1024):
                    b = whole.slice(low, 1024)
                    files = b.column(file_at).to_pylist()
                    starts, sizes = b.column(start_at).to_numpy(), b.column(size_at).to_numpy()
                    prints, found = b.column(print_at).to_pylist(), []
                    cuts = [0, *(k for k in range(1, len(files)) if files[k] != files[k - 1]), len(files)]
                    for a, z in zip(cuts, cuts[1:]):
                        if files[a] != last:
                            if handle is not None:
                                handle.close()
                            store, path = fs.FileSystem.from_uri(files[a])
                            last, handle = files[a], store.open_input_file(path)
                        for i, j in spans(starts[a:z], sizes[a:z], gap):
                            i, j = a + i, a + j
                            handle.seek(int(starts[i]))
                            held = handle.read(int(starts[j - 1] + sizes[j - 1] - starts[i]))
                            for k in range(i, j):
                                at = int(starts[k] - starts[i])
                                line, record, error, now = _row(held[at : at + int(sizes[k])])
                                if now != prints[k]:
                                    raise SourceChangedError(f"{files[k]} has another row at byte {starts[k]} than the ledger")
                                found.append((line, record, error))
                    columns = [pa.array(list(c), pa.string()) for c in zip(*found)] if found else [pa.array([], pa.string())] * 3
                    yield pa.RecordBatch.from_arrays([*b.columns, *columns], names)
        finally:
            if handle is not None:
                handle.close()

    return own.mapInArrow(read, T.StructType([*kept, *more]))
