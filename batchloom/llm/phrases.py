"""Collocations: frequent phrases of 2 to ``longest`` words, scored by their least likely cut.

Everything is per language (null: ``und``). Texts are lower-cased (A-Z), split into pieces and words.

Dictionary. Tasks count words and put out what they counted; a word with ``least`` occurrences or more in
its language gets an id, from 1, more frequent words before others. A phrase of ``least`` occurrences holds
no other word, so texts become id sequences, with 0 wherever a piece ends or another word stands; an id
is one language's. A dictionary of up to ``broadcast_words`` words is broadcast; for a larger one the
distinct words of each block of a text are joined with it, and the blocks put together again.

Counting. Id n-grams become binary keys, of one fixed width in each pass: four bytes an id, high byte first,
zeros behind, so that keys sort as numbers. Pairs are counted first. A longer phrase of ``least`` occurrences
holds frequent pairs only: all n-grams of 3 to ``longest`` words whose pairs are marked in a bitmap of
hashes are counted in one more pass. The bitmap has ``bitmap`` bits whatever there is; where hashes meet it
lets a key more pass, which is counted all the same. Each task sorts and run-length counts its keys, ``held``
at a time; then all are dealt out by ranges of keys, sorted inside each range (Spark sorts by radix on
the first eight bytes), and equal keys that follow each other are summed. So a key that a third of all
texts hold comes as one row for each block of a task.

Scores. Each candidate is joined with the counts of both parts of each cut. Products are exact
decimals. A candidate goes if a phrase of one word more, with the same count, contains it: a longer phrase
never has a greater count, and one longer by more words implies such a phrase. The first ``top`` of each
language are found in two steps, first of shares of the language, then of what those leave.

Null texts count as empty, very long ones are read whole, repeated rows count each time, and words of any
length are words. Without candidates the result is empty. Ties go by the words' UTF-8 bytes. Columns beside
text and lang are ignored, whatever they are called.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from batchloom.llm.common import settle

_BREAKS = b".,;:!?\n\x0b\x0c\r"  # all white space of bytes.split but the two blanks ends a piece
_FLAT = bytes.maketrans(bytes(range(65, 91)) + _BREAKS, bytes(range(97, 123)) + b"." * len(_BREAKS))
_KEY = "key binary, words int, n bigint"


@dataclass(frozen=True)
class PhraseConfig:
    least: int = 100
    longest: int = 5
    top: int = 2_000
    broadcast_words: int = 1_000_000
    bitmap: int = 1 << 26  # bits: 8 MB
    held: int = 1 << 20  # distinct words, or n-grams, that a task counts before it puts them out
    shares: int = 64

    def __post_init__(self) -> None:
        if self.least < 1 or self.longest < 2 or self.top < 1:
            raise ValueError("least and top are at least 1, longest at least 2")
        if self.bitmap < 1 << 15 or self.bitmap & (self.bitmap - 1):
            raise ValueError("the bitmap's bits are a power of two, 32768 at least")

    @property
    def cells(self) -> int:
        """Numbers of eight bytes in a key: two ids each."""
        return -(-self.longest // 2)


def words(text: str | None) -> list[bytes]:
    """Lower-cased words in order, and ``.`` wherever a piece ends."""
    return (text or "").encode().translate(_FLAT).replace(b".", b" . ").split()


# --- the dictionary -------------------------------------------------------------------------------


def word_counts(texts: DataFrame, config: PhraseConfig) -> DataFrame:
    """lang, word (UTF-8 bytes), n of all words. ``texts``: lang, text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, c in found.items():
                c.pop(b".", None)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], ["lang", "word", "n"],
                )
            found.clear()

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    found.setdefault(lang, Counter()).update(words(text))
                if sum(map(len, found.values())) > config.held:
                    yield from out()
        yield from out()

    return texts.mapInArrow(count, "lang string, word binary, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def dictionary(counts: DataFrame, config: PhraseConfig) -> DataFrame:
    """lang, word, n, id of the frequent words; ids are dense, by falling n as far as ranges tell counts apart."""
    frequent = settle(counts.where(F.col("n") >= config.least), "phrase-words")
    dealt = frequent.repartitionByRange(F.desc("n")).sortWithinPartitions(F.desc("n"), "lang", "word")
    dealt = settle(dealt.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), "phrase-words")
    before, total = [], 0
    for part, rows, first in sorted(dealt.groupBy("part").agg(F.count(F.lit(1)), F.min("place")).collect()):
        before.append((part, total + 1 - first))
        total += rows
    shift = F.broadcast(dealt.sparkSession.createDataFrame(before, "part int, shift bigint"))  # a row for each partition
    return settle(dealt.join(shift, "part").select("lang", "word", "n", (F.col("place") + F.col("shift")).cast("int").alias("id")), "phrase-words")


# --- texts as ids ---------------------------------------------------------------------------------


def _encode_broadcast(texts: DataFrame, known: DataFrame) -> DataFrame:
    """ids (little-endian int32) of each text in a language that has frequent words."""
    table: dict[str, dict[bytes, int]] = {}
    rows = known.select("lang", "word", "id").toArrow()
    for lang, word, own in zip(*(rows[c].to_pylist() for c in rows.column_names)):
        table.setdefault(lang, {})[word] = own
    shared = texts.sparkSession.sparkContext.broadcast(table)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part, ids = b.slice(at, 256), []
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if lang in shared.value:
                        own = words(text)
                        ids.append(np.fromiter(map(shared.value[lang].get, own, repeat(0)), np.int32, len(own)).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], ["ids"])

    return texts.mapInArrow(encode, "ids binary")


def _encode_joined(texts: DataFrame, known: DataFrame, block: int = 4096) -> DataFrame:
    """The same by a join: the distinct words of each block of a text with their places, joined and put together."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), 0
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own, doc = words(text), (task << 33) | seen
                seen += 1
                for at in range(0, len(own), block):
                    places: dict[bytes, list[int]] = {}
                    for place, word in enumerate(own[at : at + block]):
                        places.setdefault(word, []).append(place)
                    places.pop(b".", None)
                    n, size = len(places), min(block, len(own) - at)
                    own_rows = [
                        pa.array([lang] * n, pa.string()), pa.array([doc] * n, pa.int64()), pa.array([at] * n, pa.int64()), pa.array([size] * n, pa.int32()),
                        pa.array(list(places), pa.binary()), pa.array(list(places.values()), pa.list_(pa.int32())),
                    ]
                    yield pa.RecordBatch.from_arrays(own_rows, ["lang", "doc", "at", "size", "word", "places"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by document and block; where a block is missing no frequent word stands."""
        doc, ids = None, bytearray()
        for b in batches:
            for r in b.to_pylist():
                if r["doc"] != doc:
                    if doc is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([bytes(ids)], pa.binary())], ["ids"])
                    doc, ids = r["doc"], bytearray()
                own = np.zeros(r["size"], np.int32)
                for held in r["held"]:
                    own[held["places"]] = held["id"]
                ids += bytes(r["at"] * 4 - len(ids)) + own.tobytes()
        if doc is not None:
            yield pa.RecordBatch.from_arrays([pa.array([bytes(ids)], pa.binary())], ["ids"])

    # Written once: a task that is tried again doesn't number its texts anew beside the others.
    rows = settle(texts.mapInArrow(spread, "lang string, doc bigint, at bigint, size int, word binary, places array<int>"), "phrase-places")
    joined = rows.join(known.select("lang", "word", "id"), ["lang", "word"])
    blocks = joined.groupBy("doc", "at", "size").agg(F.collect_list(F.struct("id", "places")).alias("held"))  # a block's words at most
    return blocks.repartition("doc").sortWithinPartitions("doc", "at").mapInArrow(gather, "ids binary")


# --- counting n-grams -----------------------------------------------------------------------------


def pack(ids: np.ndarray, cells: int) -> np.ndarray:
    """Rows of ids as rows of ``cells`` numbers of eight bytes, two ids each, zeros behind."""
    own = np.zeros((len(ids), 2 * cells), np.uint64)
    own[:, : ids.shape[1]] = ids
    return own[:, ::2] << np.uint64(32) | own[:, 1::2]


def _runs(cells: np.ndarray, times: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their times (without: 1 each)."""
    if not len(cells):
        return cells, np.zeros(0, np.int64)
    used = [k for k in range(cells.shape[1]) if k == 0 or cells[:, k].any()]
    order = np.argsort(cells[:, 0], kind="stable") if len(used) == 1 else np.lexsort([cells[:, k] for k in reversed(used)])
    cells = cells[order]
    first = np.flatnonzero(np.append(True, (cells[1:] != cells[:-1]).any(axis=1)))
    n = np.diff(np.append(first, len(cells))) if times is None else np.add.reduceat(times[order], first)
    return cells[first], n.astype(np.int64)


def _out(cells: np.ndarray, times: np.ndarray, width: int | None = None) -> pa.RecordBatch:
    """key and n; with a ``width`` in cells, keys are widened to it, and ``words`` stands between."""
    if width is not None and width > cells.shape[1]:
        cells = np.concatenate([cells, np.zeros((len(cells), width - cells.shape[1]), np.uint64)], axis=1)
    bounds = np.arange(len(cells) + 1, dtype=np.int32) * np.int32(8 * cells.shape[1])
    keys = pa.Array.from_buffers(pa.binary(), len(cells), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(cells.astype(">u8").tobytes())])
    if width is None:
        return pa.RecordBatch.from_arrays([keys, pa.array(times, pa.int64())], ["key", "n"])
    size = (cells > 0).sum(axis=1) + ((cells & np.uint64(0xFFFFFFFF)) > 0).sum(axis=1)
    return pa.RecordBatch.from_arrays([keys, pa.array(size, pa.int32()), pa.array(times, pa.int64())], ["key", "words", "n"])


def _cells(keys: pa.Array, cells: int) -> np.ndarray:
    _, _, data = keys.buffers()
    own = np.frombuffer(data, ">u8", count=len(keys) * cells, offset=keys.offset * 8 * cells)
    return own.reshape(-1, cells).astype(np.uint64)


def gram_counts(encoded: DataFrame, grams: Callable[[np.ndarray], Iterator[np.ndarray]], longest: int, config: PhraseConfig, label: str) -> DataFrame:
    """key, words, n of the n-grams with ``least`` occurrences among those of up to ``longest`` words that ``grams(ids)`` gives."""
    width = -(-longest // 2)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh: list[np.ndarray] = []
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            if fresh:
                kept.append(_runs(np.concatenate(fresh), None))
                fresh.clear()
            kept[:] = [_runs(np.concatenate([k for k, _ in kept]), np.concatenate([n for _, n in kept]))]
            return kept[0]

        for b in batches:
            for at in range(0, b.num_rows, 256):
                ids = np.frombuffer(bytes(4).join([*b.column(0).slice(at, 256).to_pylist(), b""]), np.int32)
                for rows in grams(ids):
                    for low in range(0, len(rows), config.held):
                        fresh.append(pack(rows[low : low + config.held], width))
                        size += len(fresh[-1])
                        if size >= config.held:
                            size = len(merged()[1])
                            if size > config.held // 2:
                                yield _out(*kept.pop())
                                size = 0
        if fresh or kept:
            yield _out(*merged())

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of equal keys that follow each other; the last key of a batch may go on in the next."""
        last, so_far = np.zeros((0, width), np.uint64), np.zeros(0, np.int64)
        for b in batches:
            keys, n = _runs(np.concatenate([last, _cells(b.column(0), width)]), np.concatenate([so_far, b.column(1).to_numpy()]))
            last, so_far = keys[-1:], n[-1:]
            done = n[:-1] >= config.least
            yield _out(keys[:-1][done], n[:-1][done], config.cells)
        if len(last) and so_far[0] >= config.least:
            yield _out(last, so_far, config.cells)

    # Spark samples the keys for the ranges' bounds in a pass of its own: counting twice takes less than writing them.
    dealt = encoded.mapInArrow(count, "key binary, n bigint").repartitionByRange("key").sortWithinPartitions("key")
    return settle(dealt.mapInArrow(total, _KEY), label)


def _pairs(ids: np.ndarray) -> Iterator[np.ndarray]:
    at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
    yield np.stack([ids[at], ids[at + 1]], axis=1)


def _place(pairs: np.ndarray, bits: int) -> np.ndarray:
    """A place in the bitmap for each pair (its first cell)."""
    mixed = pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)) & np.uint64(bits - 1)


def _bitmap(pairs: DataFrame, config: PhraseConfig) -> np.ndarray:
    """Bits set for the keys of ``pairs``; executors build it in buckets, which the driver joins: ``bitmap`` bits in all."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_place(_cells(b.column(0), config.cells)[:, 0], config.bitmap).astype(np.int64) + 1)], ["place"])

    held = pairs.mapInArrow(places, "place bigint")
    buckets = held.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    own = np.zeros(config.bitmap // 8, np.uint8)
    for bucket, bits in buckets.toLocalIterator():  # both count from 1
        own[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(bits, np.uint8)
    return own


def phrase_counts(texts: DataFrame, known: DataFrame, config: PhraseConfig) -> DataFrame:
    """key, words, n of all phrases of 1 to ``longest`` words with ``least`` occurrences."""
    if known.count() <= config.broadcast_words:
        encoded = _encode_broadcast(texts, known)
    else:
        encoded = _encode_joined(texts, known)
    encoded = settle(encoded, "phrase-ids")
    cells, longest, bits = config.cells, config.longest, config.bitmap

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _out(pack(b.column(0).to_numpy()[:, None], cells), b.column(1).to_numpy(), cells)

    pairs = gram_counts(encoded, _pairs, 2, config, "phrase-pairs")
    found = known.select("id", "n").mapInArrow(single, _KEY).union(pairs)
    if longest == 2:
        return found
    shared = texts.sparkSession.sparkContext.broadcast(_bitmap(pairs, config))

    def longer(ids: np.ndarray) -> Iterator[np.ndarray]:
        both = ids[:-1].astype(np.uint64) << np.uint64(32) | ids[1:].astype(np.uint64)
        at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        place = _place(both[at], bits)
        at = at[(shared.value[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0]
        ok = np.zeros(len(ids) + longest, bool)
        ok[at] = True
        own = np.concatenate([ids, np.zeros(longest, ids.dtype)])
        for n in range(3, longest + 1):
            at = at[ok[at + n - 2]]
            yield own[at[:, None] + np.arange(n)]

    return found.union(gram_counts(encoded, longer, longest, config, "phrase-grams"))


# --- scores ---------------------------------------------------------------------------------------


def _part(first: int | F.Column, count: int | F.Column, config: PhraseConfig) -> F.Column:
    """The key of ``count`` ids of ``key`` from the ``first`` (0) on."""
    own = F.substring(F.col("key"), F.lit(1) + 4 * F.lit(first), 4 * F.lit(count))
    return F.rpad(own, 8 * config.cells, bytes(1))


def collocations(docs: DataFrame, config: PhraseConfig = PhraseConfig(), text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    counts = settle(word_counts(texts, config), "phrase-words")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    known = dictionary(counts, config)
    held = settle(phrase_counts(texts, known, config), "phrase-counts")
    wanted = held.where("words > 1").withColumnRenamed("n", "a")
    # A phrase of one word more with the same count takes its two parts with it.
    inside = wanted.where("words > 2").select(F.explode(F.array(_part(0, F.col("words") - 1, config), _part(1, F.col("words") - 1, config))).alias("key"), "a")
    left = wanted.join(inside.distinct(), ["key", "a"], "left_anti")
    cuts = left.select("key", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"head": _part(0, F.col("k"), config), "tail": _part(F.col("k"), F.col("words") - F.col("k"), config)})
    cuts = cuts.join(held.select(F.col("key").alias("head"), F.col("n").alias("l")), "head").join(held.select(F.col("key").alias("tail"), F.col("n").alias("r")), "tail")
    # Words and language of each candidate.
    spelt = left.select("key", F.explode(F.sequence(F.lit(0), F.col("words") - 1)).alias("at"))
    spelt = spelt.withColumn("id", F.conv(F.hex(F.substring(F.col("key"), F.lit(1) + 4 * F.col("at"), F.lit(4))), 16, 10).cast("int"))
    spelt = spelt.join(known.select("id", "lang", F.col("word").cast("string").alias("word")), "id").groupBy("key").agg(
        F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"])).alias("phrase"), F.first("lang").alias("lang"),
    )
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    rows = cuts.join(spelt, "key").join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang")
    rows = rows.withColumns({"over": (1000 * wide("a") * wide("total")).cast("decimal(38,0)"), "under": (wide("l") * wide("r")).cast("decimal(38,0)")})
    rows = rows.withColumn("score", F.expr("over div under"))
    best = rows.groupBy("key", "lang", "phrase", "a", F.col("total").alias("n")).agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(config.shares))
    some = best.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= config.top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= config.top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
