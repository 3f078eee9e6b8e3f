"""Packing documents into sequences by order-preserving dynamic programming.

The documents of a partition stand in their order, as one row of token ids. Candidate cuts
are document ends (free), sentence ends (``sentence_penalty``) and, in stretches without
either, places inside a sentence (``hard_penalty``). A window between two cuts holds at
most ``length`` ids and costs its padding plus the penalty of its right cut. With ``pos``
the place of a cut, the least cost up to cut j is

    f(j) = penalty(j) + length - pos(j) + min over i, pos(j) - pos(i) <= length, of f(i) + pos(i)

and a monotone queue gives the sliding minimum, so that each cut enters and leaves it once.
No shuffle is needed: a sequence holds documents of one partition. Blocks of ``block`` ids
are solved one after the other; the last window of a block goes into the next.

Null texts count as empty; each document ends with ``end_id``, so that an empty one has one
id. Repeated rows are packed as often as they occur. Null doc_ids are kept as null. An empty
table gives no rows. A very long text fills blocks one after the other, no id of it is lost.
Of cuts of equal cost the earliest start of a window counts. Other columns are dropped,
whatever their names.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.llm.bpe import encoder


@dataclass(frozen=True)
class PackConfig:
    tokenizer: str
    length: int = 1024
    end_id: int = 0
    sentence_penalty: int = 8
    hard_penalty: int = 24
    hard_step: int = 32
    block: int = 1 << 20
    with_ids: bool = False
    max_words: int = 1_000_000  # words that a worker remembers the ids of


_SENTENCE_END: dict[str, np.ndarray] = {}


def sentence_ends(path: str, max_words: int = 1_000_000) -> np.ndarray:
    """For each id, whether its token ends a sentence or line."""
    if path not in _SENTENCE_END:
        library = encoder(path, max_words).library
        flags = np.zeros(max(library.get_vocab().values()) + 1, bool)
        for token, k in library.get_vocab().items():
            flags[k] = token.endswith((".", "!", "?", "Ċ"))  # Ċ: a line feed in byte-level spelling
        _SENTENCE_END[path] = flags
    return _SENTENCE_END[path]


def candidates(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, config: PackConfig) -> tuple[np.ndarray, np.ndarray]:
    """Places of the candidate cuts, from 0 to the end, and their penalties."""
    n = len(ids)
    soft = np.flatnonzero(ends[ids]) + 1
    pos = np.union1d(np.concatenate([[0, n], soft]), doc_ends)
    gaps = np.diff(pos)
    step = max(1, min(config.hard_step, config.length // 2))
    wide = np.flatnonzero(gaps > step)
    hard = np.concatenate([np.arange(pos[k] + step, pos[k + 1], step) for k in wide]) if len(wide) else np.zeros(0, np.int64)
    every = np.union1d(pos, hard)
    penalty = np.full(len(every), config.hard_penalty, np.int64)
    penalty[np.searchsorted(every, soft)] = config.sentence_penalty
    penalty[np.searchsorted(every, doc_ends)] = 0
    penalty[0] = penalty[-1] = 0
    return every, penalty


def best_cuts(pos: list[int], penalty: list[int], length: int) -> list[int]:
    """Places of the cuts of the cheapest packing, both ends included."""
    g = [0] * len(pos)  # f(i) + pos(i)
    back = [0] * len(pos)
    queue = deque([0])
    for j in range(1, len(pos)):
        at = pos[j]
        while at - pos[queue[0]] > length:
            queue.popleft()
        i = queue[0]
        back[j] = i
        v = g[j] = g[i] + penalty[j] + length
        while queue and g[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(pos) - 1
    while j:
        cuts.append(pos[j])
        j = back[j]
    return [0, *reversed(cuts)]


def tail(start: int, end: int, config: PackConfig) -> list[int]:
    """Right ends of the last windows: powers of two, which need no padding, where that is cheaper."""
    size = end - start
    powers = [1 << k for k in range(size.bit_length() - 1, -1, -1) if size >> k & 1]
    if config.length - size <= config.hard_penalty * (len(powers) - 1):
        return [end]
    return list(start + np.cumsum(powers))


class Packer:
    """Packs the documents of one partition. ``base``: the first sequence id."""

    def __init__(self, config: PackConfig, base: int):
        self.config, self.next = config, base
        self.ends = sentence_ends(config.tokenizer, config.max_words)
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple] = []  # (doc_id, ids of it before the block, ids in the block, all its ids)
        self.size = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.ids.append(ids)
        self.docs.append((doc_id, 0, len(ids), len(ids)))
        self.size += len(ids)

    def solve(self, last: bool) -> list[tuple]:
        """The pieces of all windows that are settled."""
        if not self.size:
            return []
        ids = np.concatenate(self.ids)
        lengths = np.array([d[2] for d in self.docs], np.int64)
        doc_ends = np.cumsum(lengths)
        pos, penalty = candidates(ids, doc_ends, self.ends, self.config)
        cuts = best_cuts(pos.tolist(), penalty.tolist(), self.config.length)
        if last:
            cuts = cuts[:-1] + tail(cuts[-2], cuts[-1], self.config)
        else:
            cuts = cuts[:-1]
        done = cuts[-1]
        windows = np.array(cuts, np.int64)
        edges = np.union1d(windows, doc_ends[doc_ends <= done])
        out = []
        doc_starts = doc_ends - lengths
        left = edges[:-1]
        doc = np.searchsorted(doc_ends, left, side="right")
        window = np.searchsorted(windows, left, side="right") - 1
        raw = ids.astype("<u4")
        for s, e, d, w in zip(left.tolist(), edges[1:].tolist(), doc.tolist(), window.tolist()):
            name, before, _, total = self.docs[d]
            piece = raw[s:e].tobytes()
            row = (name, before + s - int(doc_starts[d]), e - s, zlib.crc32(piece), total, self.next + w, s - int(windows[w]))
            out.append((*row, piece) if self.config.with_ids else row)
        self.next += len(windows) - 1
        # What is left goes into the next block.
        rest = []
        k = int(np.searchsorted(doc_ends, done, side="right"))
        for d in range(k, len(self.docs)):
            name, before, size, total = self.docs[d]
            cut = max(0, done - int(doc_starts[d]))
            rest.append((name, before + cut, size - cut, total))
        self.docs = rest
        self.ids = [ids[done:]] if done < len(ids) else []
        self.size = len(ids) - done
        return out


def pack(df: DataFrame, config: PackConfig, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of a document: where it starts there, and in which sequence it lies."""
    narrow = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    if config.with_ids:
        schema += ", ids binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(config.tokenizer, config.max_words)
        packer = Packer(config, TaskContext.get().partitionId() << 40)
        end = np.array([config.end_id], np.uint32)
        kind_of: list[pa.DataType] = []

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows))
            types = [kind_of[0], *[pa.int64()] * 6, *[pa.binary()] * config.with_ids]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for b in batches:
            kind_of[:] = [b.schema.field(0).type]
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                ids, ends = own.encode(part.column(1).to_pylist())
                for doc_id, s, e in zip(part.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                    packer.add(doc_id, np.concatenate([ids[s:e], end]))
                    if packer.size >= config.block:
                        rows = packer.solve(False)
                        if rows:
                            yield batch(rows)
        rows = packer.solve(True)
        if rows:
            yield batch(rows)

    return narrow.mapInArrow(run, schema)
