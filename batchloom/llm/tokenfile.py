"""Token ids in binary files, with document boundaries in Elias-Fano code.

A file holds, little-endian: the mark ``BLTK``, a 32-bit version, then as 64-bit numbers the
count of documents, those of them without doc_id, the count of ids, the bytes of an id (2 or
4), the first doc_id, and the byte sizes of the two Elias-Fano blocks; then the ids, one document
after the other; then the blocks: ends of the documents, and doc_ids less the first. A
folder holds files in ascending doc_id order by name, and ``manifest`` (Parquet): a row for each
file with its number of documents and ids.

An Elias-Fano block of n rising numbers below u stores the low ``l = floor(log2(u / n))``
bits of each, packed, and the high parts in unary as a bit vector: bit ``high + k`` is set
for number k. Select of the k-th set bit less k is the high part again. Each 256th set
bit's place is stored as a sample, so that select scans a few words. That takes about
2 + l bits a document, against 64 in a table of offsets.

Null texts are empty: one id, the end's. Null doc_ids come first, whatever their texts. Rows of one
doc_id, and those without, stand in order of their texts' hashes, then texts, so that one
id with a third of all rows is dealt over many tasks. An empty table gives no file. Long
texts are encoded whole. Other columns are dropped, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from batchloom.llm.bpe import encoder
from batchloom.llm.common import fresh_path

MARK = b"BLTK"
HEADER = struct.Struct("<4sI7q")
VERSION = 2
SAMPLE = 256
_SET = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(bool)  # the bits of each byte
_COUNT = _SET.sum(axis=1).astype(np.uint8)
_PLACE = np.zeros((256, 8), np.uint8)  # of the k-th set bit in a byte
for _b in range(256):
    _PLACE[_b, : _COUNT[_b]] = np.flatnonzero(_SET[_b])


class EliasFano:
    """Rising non-negative numbers; equal ones are allowed."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        top = int(v[-1]) + 1 if n else 1
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        shifts = np.arange(low_bits, dtype=np.uint64)
        bits = ((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8) if low_bits else np.zeros((n, 0), np.uint8)
        places = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        marks = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        marks[places] = 1
        return cls(
            n, low_bits, np.packbits(bits.reshape(-1), bitorder="little"), np.packbits(marks, bitorder="little"),
            places[::SAMPLE].astype("<u8"),
        )

    def to_bytes(self) -> bytes:
        head = struct.pack("<qqqqq", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, low_bits, a, b, c = struct.unpack_from("<qqqqq", raw)
        at = 40
        low = np.frombuffer(raw, np.uint8, a, at)
        high = np.frombuffer(raw, np.uint8, b, at + a)
        samples = np.frombuffer(raw, "<u8", c, at + a + b)
        return cls(n, low_bits, low, high, samples)

    def _low(self, k: np.ndarray) -> np.ndarray:
        out = np.zeros(len(k), np.uint64)
        for b in range(self.low_bits):
            place = k * self.low_bits + b
            out |= ((self.low[place >> 3].astype(np.uint64) >> (place & 7).astype(np.uint64)) & np.uint64(1)) << np.uint64(b)
        return out

    def select(self, k: int) -> int:
        """Number k: from the sample before it on, count set bits byte by byte."""
        if not 0 <= k < self.n:
            raise IndexError(k)
        start = int(self.samples[k // SAMPLE])
        left = k % SAMPLE  # set bits to pass after the sample
        at = start >> 3
        byte = int(self.high[at]) >> (start & 7) << (start & 7)
        while True:
            c = byte.bit_count()
            if left < c:
                break
            left -= c
            at += 1
            byte = int(self.high[at])
        for _ in range(left):
            byte &= byte - 1
        place = at * 8 + (byte & -byte).bit_length() - 1
        return (place - k) << self.low_bits | int(self._low(np.array([k]))[0])

    def select_many(self, k: np.ndarray) -> np.ndarray:
        """Numbers k, an array of rising places: the bytes between the samples around them are counted
        once, and a table gives the place in a byte."""
        k = np.asarray(k, np.int64)
        if not len(k):
            return np.zeros(0, np.int64)
        first = int(k[0]) // SAMPLE
        start = int(self.samples[first])
        end = int(k[-1]) // SAMPLE + 1
        stop = (int(self.samples[end]) >> 3) + 1 if end < len(self.samples) else len(self.high)
        window = self.high[start >> 3 : stop].copy()
        window[0] = int(window[0]) >> (start & 7) << (start & 7)
        counted = np.cumsum(_COUNT[window], dtype=np.int64)
        rank = k - first * SAMPLE
        at = np.searchsorted(counted, rank, side="right")
        inside = rank - (counted[at] - _COUNT[window[at]])
        places = ((start >> 3) + at) * 8 + _PLACE[window[at], inside]
        return ((places - k).astype(np.uint64) << np.uint64(self.low_bits) | self._low(k)).astype(np.int64)

    def all(self) -> np.ndarray:
        return self.select_many(np.arange(self.n))


def file_bytes(doc_ids: np.ndarray, ends: np.ndarray, ids: np.ndarray, nulls: int = 0) -> bytes:
    """A whole file. ``ends``: for each document, the ids up to its end; the first ``nulls`` have no doc_id."""
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    first = int(doc_ids[0]) if len(doc_ids) else 0
    a = EliasFano.of(ends).to_bytes()
    # Beyond 63 bits apart, doc_ids wrap around as unsigned numbers and still rise.
    b = EliasFano.of(np.asarray(doc_ids, np.int64).astype(np.uint64) - np.uint64(first % (1 << 64))).to_bytes()
    head = HEADER.pack(MARK, VERSION, len(ends), nulls, len(ids), width, first, len(a), len(b))
    return b"".join([head, ids.astype(f"<u{width}").tobytes(), a, b])


class TokenFile:
    """Reads one file; documents are addressed by their place in it."""

    def __init__(self, raw: bytes):
        mark, version, self.n_docs, self.nulls, self.n_ids, self.width, self.first, a, b = HEADER.unpack_from(raw)
        if mark != MARK or version != VERSION:
            raise ValueError("not a token file")
        at = HEADER.size
        self.ids = np.frombuffer(raw, f"<u{self.width}", self.n_ids, at)
        at += self.n_ids * self.width
        self.ends = EliasFano.from_bytes(raw[at : at + a])
        self.names = EliasFano.from_bytes(raw[at + a : at + a + b])

    def bounds(self, k: int) -> tuple[int, int]:
        return (self.ends.select(k - 1) if k else 0), self.ends.select(k)

    def document(self, k: int) -> np.ndarray:
        s, e = self.bounds(k)
        return self.ids[s:e]

    def documents(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where documents k (rising places) start and end."""
        ends = self.ends.select_many(k)
        before = self.ends.select_many(np.maximum(k - 1, 0))
        return np.where(k > 0, before, 0), ends

    def doc_ids(self) -> np.ndarray:
        """Of the documents behind the first ``nulls``."""
        return (self.names.all().astype(np.uint64) + np.uint64(self.first % (1 << 64))).astype(np.int64)


@dataclass(frozen=True)
class TokenFileConfig:
    tokenizer: str
    end_id: int = 2
    ids_per_file: int = 8 << 20


def _put(folder: str, name: str, raw: bytes) -> None:
    """Write under a name of this attempt, then rename: a repeated task replaces the file whole."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    own = f"{base}/.{name}.{TaskContext.get().taskAttemptId()}"
    with store.open_output_stream(own) as out:
        out.write(raw)
    store.move(own, f"{base}/{name}")


FILES = "part int, place int, name string, docs bigint, ids bigint"


def write_tokens(df: DataFrame, folder: str, config: TokenFileConfig, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files and their manifest, and return it: part, place in it, name, documents and ids of each file."""
    spark = df.sparkSession
    narrow = df.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).withColumn("h", F.xxhash64("text"))
    dealt = narrow.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(config.tokenizer)
        end = np.array([config.end_id], np.uint32)
        part = TaskContext.get().partitionId()
        names: list[int] = []
        ids: list[np.ndarray] = []
        size = place = nulls = 0

        def close() -> pa.RecordBatch:
            nonlocal size, place, nulls
            name = f"tokens-{part:06d}-{place:06d}.bin"
            _put(folder, name, file_bytes(np.array(names, np.int64), np.cumsum([len(x) for x in ids]), np.concatenate(ids), nulls))
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([place], pa.int32()), pa.array([name]), pa.array([len(ids)]), pa.array([size])],
                ["part", "place", "name", "docs", "ids"],
            )
            names.clear()
            ids.clear()
            size, place, nulls = 0, place + 1, 0
            return row

        for b in batches:
            for at in range(0, b.num_rows, 128):
                piece = b.slice(at, 128)
                found, ends = own.encode(piece.column(1).to_pylist())
                for doc_id, s, e in zip(piece.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                    one = np.concatenate([found[s:e], end])
                    if doc_id is None:
                        nulls += 1
                    else:
                        names.append(doc_id)
                    ids.append(one.astype(np.uint16) if one.max() < 1 << 16 else one)
                    size += len(one)
                    if size >= config.ids_per_file:
                        yield close()
        if ids:
            yield close()

    dealt.mapInArrow(run, FILES).write.parquet(f"{folder}/manifest")
    return spark.read.schema(FILES).parquet(f"{folder}/manifest")


def with_starts(files: DataFrame) -> DataFrame:
    """name and before: the ids in all files before each. The driver holds a sum for each part, no file."""
    spark = files.sparkSession
    sums = sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum("ids").alias("n")).collect())
    offsets, total = [], 0
    for part, n in sums:
        offsets.append((part, total))
        total += n
    parts = F.broadcast(spark.createDataFrame(offsets, "part int, offset bigint"))
    inside = F.sum("ids").over(Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    return files.withColumn("inside", F.coalesce(inside, F.lit(0))).join(parts, "part").select(
        "name", (F.col("offset") + F.col("inside")).alias("before"),
    )


def read_tokens(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """One row for each document, from the files: doc_id, start, n_tokens, ids_crc32."""
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, name string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, raw in zip(b.column(0).to_pylist(), b.column(1)):
                file, name = TokenFile(raw.as_buffer()), path.rsplit("/", 1)[-1]
                names = file.doc_ids()
                for at in range(0, file.n_docs, 1 << 14):
                    k = np.arange(at, min(file.n_docs, at + (1 << 14)))
                    starts, ends = file.documents(k)
                    sums = [zlib.crc32(file.ids[s:e].astype("<u4").tobytes()) for s, e in zip(starts.tolist(), ends.tolist())]
                    own = pa.array(names[np.maximum(k - file.nulls, 0)] if len(names) else np.zeros(len(k), np.int64), mask=k < file.nulls)
                    yield pa.RecordBatch.from_arrays(
                        [own, pa.array(starts), pa.array(ends - starts), pa.array(sums, pa.int64()), pa.array([name] * len(k))],
                        ["doc_id", "start", "n_tokens", "ids_crc32", "name"],
                    )

    found = spark.read.format("binaryFile").option("pathGlobFilter", "tokens-*.bin").load(folder)
    rows = found.select("path", "content").mapInArrow(run, schema)
    return rows.join(with_starts(files), "name").select(
        "doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32",
    )


def token_file_digest(df: DataFrame, config: TokenFileConfig) -> DataFrame:
    """Write the files below the shared folder and read them back."""
    spark = df.sparkSession
    folder = fresh_path(spark, "tokens")
    files = write_tokens(df, folder, config)
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    return read_tokens(spark, folder, files)
