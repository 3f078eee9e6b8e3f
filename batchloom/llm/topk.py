"""Exact top-k by inner product with vector-approximation files.

Vectors are cut to integers, floor(scale * x). A task keeps its vectors in blocks; each
dimension of a block is cut into ``cells`` cells of equal width, and a vector is
approximated by its cells. Scanning the cells bounds a query's inner product from both
sides: with centre m and half width h of the cells it is q.m - |q|.h at least and
q.m + |q|.h at most; q.m is the product of the query, scaled by the widths, with the cell
numbers. Vectors whose upper bound is below the k-th best so far (or the k-th
best lower bound) drop out; the others are read exactly, from the highest bound down, until
the k-th result is certain. Ties go to the smaller id.

Queries go to the vectors in chunks of at most ``chunk_bytes`` as a broadcast; a task puts
out at most k rows for each query, and a window over those rows keeps the k best. More
queries mean more chunks, not more memory.

Vectors that are null, empty, or hold null or non-finite components take no part, nor do
rows without id. Vectors of other lengths than the query's are no candidates. A row with the
query's id is its own. Vectors with a component of 16,384 or more (``LARGE``) are compared with
whole numbers of any size, and scores beyond a long are set to its limits. Of queries
that share an id, the least vector counts; repeated candidates count as often as they occur.
An empty table of queries or vectors gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from batchloom.llm.common import settle

LARGE = 16_384.0
_MOST = (1 << 63) - 1
SCHEMA = "query_id bigint, vec_id bigint, score bigint"


@dataclass(frozen=True)
class TopKConfig:
    k: int = 10
    scale: int = 1024
    cells: int = 64
    block: int = 16_384
    query_rows: int = 256
    chunk_bytes: int = 16 << 20


class Approximation:
    """The cells of a block of vectors, and the vectors."""

    def __init__(self, ids: np.ndarray, exact: np.ndarray, cells: int):
        self.ids, self.exact = ids, exact
        low, high = exact.min(axis=0).astype(np.float64), exact.max(axis=0).astype(np.float64)
        self.width = (high - low) / cells
        self.low = low
        with np.errstate(invalid="ignore", divide="ignore"):
            place = np.floor((exact - low) / self.width)
        self.cell = np.clip(np.nan_to_num(place), 0, cells - 1).astype(np.uint8)
        self.size = np.maximum(np.abs(low), np.abs(high))

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds, queries x vectors, from the cell numbers alone."""
        scaled = queries * self.width
        middle = scaled.astype(np.float32) @ self.cell.T.astype(np.float32) + (queries @ self.low + 0.5 * scaled.sum(axis=1))[:, None]
        # Half a cell to both sides, and what rounding does to single-precision sums.
        off = np.abs(queries) @ (self.width * 0.5) + np.abs(scaled).sum(axis=1) * ((len(self.width) + 2) * 256 * 2.0**-24) + 1e-9 * (1 + np.abs(queries) @ self.size)
        return middle - off[:, None], middle + off[:, None]

    def best(
        self, query: np.ndarray, own: int, low: np.ndarray, high: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int,
    ) -> tuple[np.ndarray, np.ndarray]:
        """The k best of those known so far and this block's, best first."""
        mine = self.ids == own
        if mine.any():
            low, high = np.where(mine, -np.inf, low), np.where(mine, -np.inf, high)
        floor = scores[-1] if len(scores) == k else -np.inf
        if len(low) > k:
            floor = max(floor, np.partition(low, len(low) - k)[len(low) - k])
        left = np.flatnonzero((high >= floor) & (high > -np.inf))
        left = left[np.argsort(-high[left], kind="stable")]
        at, step = 0, 2 * k
        while at < len(left) and (len(scores) < k or high[left[at]] >= scores[-1]):
            part = left[at : at + step]
            ids = np.concatenate([ids, self.ids[part]])
            scores = np.concatenate([scores, self.exact[part] @ query])
            order = np.lexsort((ids, -np.maximum(scores, -_MOST)))[:k]
            ids, scores = ids[order], scores[order]
            at, step = at + step, 2 * step
        return ids, scores


def finite_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and v, an array of doubles, of the rows that take part."""
    v = F.col(vec_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(F.col(id_col).isNotNull() & (F.size(v) > 0) & fine).select(
        F.col(id_col).cast("bigint").alias("id"), F.transform(v, lambda x: x.cast("double")).alias("v"),
    )


def _whole(rows: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as whole numbers of any size."""
    return np.array([[math.floor(scale * Fraction(x)) for x in row] for row in rows.tolist()], object).reshape(rows.shape)


def split(rows: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows are large, the others as longs, and the large ones as whole numbers."""
    large = (np.abs(rows) >= LARGE).any(axis=1)
    return large, np.floor(rows[~large] * scale).astype(np.int64), _whole(rows[large], scale)


def _clipped(scores: np.ndarray) -> np.ndarray:
    return np.array([min(max(int(x), -_MOST - 1), _MOST) for x in scores.tolist()], np.int64)


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """ids and matrix of the vectors of each length."""
    ids, column = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        yield ids[rows], flat[(ends[rows] - size)[:, None] + np.arange(size)]


class _Known:
    """The k best of each query of one length so far: plain queries first, then large ones."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, config: TopKConfig):
        large, self.plain, self.large = split(rows, config.scale)
        self.ids, self.n, self.config = np.concatenate([ids[~large], ids[large]]), int((~large).sum()), config
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)

    def _merge(self, j: int, ids: np.ndarray, scores: np.ndarray) -> None:
        other = ids != self.ids[j]
        ids, scores = np.concatenate([self.best[j][0], ids[other]]), np.concatenate([self.best[j][1], scores[other]])
        order = np.lexsort((ids, -np.maximum(scores, -_MOST)))[: self.config.k]
        self.best[j] = ids[order], scores[order]

    def take(self, ids: np.ndarray, rows: np.ndarray) -> None:
        large, plain, odd = split(rows, self.config.scale)
        if len(plain) and self.n:
            block = Approximation(ids[~large], plain, self.config.cells)
            for at in range(0, self.n, self.config.query_rows):
                low, high = block.bounds(self.plain[at : min(self.n, at + self.config.query_rows)].astype(np.float64))
                for j in range(len(low)):
                    self.best[at + j] = block.best(
                        self.plain[at + j], int(self.ids[at + j]), low[j], high[j], *self.best[at + j], self.config.k,
                    )
        # Pairs with a large vector on either side: whole numbers of any size, a query at a time.
        for j in range(len(self.ids)):
            query = self.plain[j].astype(object) if j < self.n else self.large[j - self.n]
            for own, part in ((ids[large], odd), *([(ids[~large], plain.astype(object))] if j >= self.n else [])):
                if len(own):
                    self._merge(j, own, _clipped(part @ query))


def _scan(queries: list[tuple[np.ndarray, np.ndarray]], config: TopKConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {m.shape[1]: _Known(ids, m, config) for ids, m in queries}
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        count: dict[int, int] = {}
        for b in batches:
            for ids, m in _matrices(b):
                size = m.shape[1]
                if size in known:
                    for at in range(0, len(ids), config.block):
                        held.setdefault(size, []).append((ids[at : at + config.block], m[at : at + config.block]))
                        count[size] = count.get(size, 0) + len(held[size][-1][0])
                        if count[size] >= config.block:
                            known[size].take(*(np.concatenate(x) for x in zip(*held.pop(size))))
                            count[size] = 0
        for size, parts in held.items():
            known[size].take(*(np.concatenate(x) for x in zip(*parts)))
        for own in known.values():
            for at in range(0, len(own.ids), 4096):
                rows = list(zip(own.ids[at : at + 4096], own.best[at : at + 4096]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([np.full(len(x[0]), i, np.int64) for i, x in rows])),
                        pa.array(np.concatenate([x[0] for _, x in rows])), pa.array(np.concatenate([x[1] for _, x in rows])),
                    ],
                    ["query_id", "vec_id", "score"],
                )

    return run


def top_k(
    queries: DataFrame, vectors: DataFrame, config: TopKConfig = TopKConfig(), id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best vectors."""
    every = finite_vectors(vectors, id_col, vec_col)
    asked = settle(finite_vectors(queries, id_col, vec_col).groupBy("id").agg(F.min("v").alias("v")), "asked")
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("v")), F.lit(1)).alias("d")).first()
    rows = max(1, config.chunk_bytes // (8 * size["d"]))
    chunks = max(1, math.ceil(size["n"] / rows))
    if chunks > 1:
        every = settle(every, "vectors")  # filtered once, however many chunks there are
    found = None
    for c in range(chunks):
        # A chunk's size is bounded by its share of a hash, and checked by the limit of rows.
        part = asked if chunks == 1 else asked.where(F.pmod(F.xxhash64("id"), F.lit(chunks)) == c)
        by: dict[int, list] = {}
        for r in part.toLocalIterator():
            by.setdefault(len(r["v"]), []).append((r["id"], r["v"]))
        if not by:
            continue
        shared = [(np.array([i for i, _ in x], np.int64), np.array([v for _, v in x], np.float64)) for x in by.values()]
        partial = every.mapInArrow(_scan(shared, config), SCHEMA)
        if chunks > 1:
            partial = settle(partial, "topk")
        found = partial if found is None else found.union(partial)
    if found is None:
        found = queries.sparkSession.createDataFrame([], SCHEMA)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.k).select("query_id", "rank", "vec_id", "score")
