"""Quality by a byte-level convolutional network, trained and run in numpy.

Network. A text is its UTF-8 bytes, whole, cut into chunks of ``chunk`` bytes that overlap by
``overlap``; the last one is padded. Each byte has a learned vector; learned filters of ``width`` bytes
stand at each ``stride``-th byte of a chunk, and the greatest value of each filter in the chunk counts
(max-pooling). A hidden layer makes a chunk's features of those. The mean and the greatest value of each
feature over all chunks of the document are combined into one probability.

Overlap is at least ``width``, so that each run of ``width`` bytes at a multiple of ``stride`` lies inside
some chunk, at the same phase: chunk starts are multiples of ``stride``.

Learning. At most ``max_examples`` labelled rows are used, those least by a hash of their doc_id; rows
whose crc32(doc_id as text) mod 5 is 0 are held out and never seen. Of equal texts one counts. An example
gives at most ``chunks`` chunks to learn from, evenly spread over its whole length, cut on the
executors: the driver holds max_examples x chunks x chunk bytes at most, whatever the tables' size. Adam
runs over them in a seeded order; doc_id, lang, source and labels are no inputs.

Scoring is a map over Arrow batches: no shuffle, the broadcast network has some 20,000 numbers, and
beside the batch, memory is a slab of chunks and a row of features a text, however long the text is.

Null texts count as empty; an empty text is one chunk of padding and has the score of that. Very long
texts are read whole. Repeated rows score alike: a chunk's features don't depend on its neighbours
(scores are rounded to 6 places). Rows without doc_id are scored, and not held out. Without examples of both
labels every score is the share of good ones, 1 without any. An empty table gives an empty
result. Extra columns are kept; those called score or predicted give way to the new ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchloom.llm.common import free_name

PAD = 256


@dataclass(frozen=True)
class QualityConfig:
    chunk: int = 256
    overlap: int = 32
    width: int = 8
    stride: int = 4
    embed: int = 8
    filters: int = 64
    hidden: int = 32
    max_examples: int = 4_000
    chunks: int = 16
    epochs: int = 10
    batch: int = 50
    rate: float = 0.004
    threshold: float = 0.3
    seed: int = 11

    def __post_init__(self) -> None:
        if self.overlap < self.width or (self.chunk - self.overlap) % self.stride or self.width % self.stride or self.chunk % self.stride:
            raise ValueError("chunks must overlap by a filter's width, and start at multiples of the stride")

    @property
    def step(self) -> int:
        return self.chunk - self.overlap


def held_out(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def _n_chunks(sizes: np.ndarray, config: QualityConfig) -> np.ndarray:
    """The first chunk, and one for each further ``step`` bytes begun beyond it."""
    return 1 + np.maximum(0, -(-(sizes - config.chunk) // config.step))


def cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, config: QualityConfig) -> np.ndarray:
    """Chunks of byte values, padded where a text ends. ``data``: bytes, behind them ``chunk`` spare ones."""
    own = data[starts[:, None] + np.arange(config.chunk)].astype(np.int16)
    own[np.arange(config.chunk) >= (ends - starts)[:, None]] = PAD
    return own


class Network:
    """Arrays are in ``p``: byte vectors e, filters w, hidden layer a, output weights m (means) and x (maxima)."""

    def __init__(self, config: QualityConfig, base: float = 1.0):
        rng = np.random.default_rng(config.seed)
        c = config
        make = lambda n, *shape: rng.normal(0, 1 / np.sqrt(n), shape).astype(np.float32)
        self.config = config
        self.base: float | None = base  # the score of every text, until there is something to learn from
        zero = lambda n: np.zeros(n, np.float32)
        self.p = {
            "e": make(1, PAD + 1, c.embed), "w": make(c.width * c.embed, c.width * c.embed, c.filters), "wb": zero(c.filters),
            "a": make(c.filters, c.filters, c.hidden), "ab": zero(c.hidden), "m": make(c.hidden, c.hidden), "x": make(c.hidden, c.hidden), "b": zero(1),
        }

    def _filtered(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of strides, chunks x strides x (stride * embed), and filter values, chunks x places x filters."""
        c, p = self.config, self.p
        blocks = p["e"][chunks].reshape(len(chunks), c.chunk // c.stride, c.stride * c.embed)
        parts = c.width // c.stride
        places = blocks.shape[1] - parts + 1
        rows = c.stride * c.embed
        y = blocks[:, :places] @ p["w"][:rows]
        for k in range(1, parts):
            y += blocks[:, k : k + places] @ p["w"][k * rows : (k + 1) * rows]
        return blocks, y

    def features(self, chunks: np.ndarray) -> np.ndarray:
        _, y = self._filtered(chunks)
        pooled = np.maximum(y.max(axis=1) + self.p["wb"], 0)
        return np.maximum(pooled @ self.p["a"] + self.p["ab"], 0)

    def probability(self, mean: np.ndarray, most: np.ndarray) -> np.ndarray:
        z = (mean @ self.p["m"] + most @ self.p["x"] + self.p["b"][0]).astype(np.float64)
        return 0.5 * (np.tanh(0.5 * z) + 1)

    def step(self, chunks: np.ndarray, first: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss of documents whose chunks begin at ``first``, and its gradients."""
        c, p, n = self.config, self.p, len(labels)
        blocks, y = self._filtered(chunks)
        at = y.argmax(axis=1)  # chunks x filters
        top = np.take_along_axis(y, at[:, None], axis=1)[:, 0] + p["wb"]
        pooled = np.maximum(top, 0)
        z = pooled @ p["a"] + p["ab"]
        h = np.maximum(z, 0)
        size = np.diff(np.append(first, len(chunks)))
        owner = np.repeat(np.arange(n), size)
        mean = np.add.reduceat(h, first) / size[:, None].astype(np.float32)
        most = np.maximum.reduceat(h, first)
        prob = self.probability(mean, most)
        loss = -np.mean(np.where(labels == 1, np.log(prob + 1e-9), np.log(1 - prob + 1e-9)))
        d = ((prob - labels) / n).astype(np.float32)
        g = {"m": mean.T @ d, "x": most.T @ d, "b": d.sum(keepdims=True)}
        leads = h == most[owner]
        share = np.add.reduceat(leads, first, dtype=np.float32)
        dh = (d / size).astype(np.float32)[owner, None] * p["m"] + leads * (d[:, None] * p["x"] / share)[owner]
        dz = dh * (z > 0)
        g["a"], g["ab"] = pooled.T @ dz, dz.sum(axis=0)
        dy = (dz @ p["a"].T) * (top > 0)
        g["wb"] = dy.sum(axis=0)
        # Only the pooled places have gradients: their bytes, chunks x filters x width.
        bytes_at = np.take_along_axis(chunks, (at[:, :, None] * c.stride + np.arange(c.width)).reshape(len(chunks), -1), axis=1)
        own = p["e"][bytes_at].reshape(len(chunks), c.filters, -1)
        g["w"] = np.einsum("nf,nfk->kf", dy, own, optimize=True)
        back = (dy[:, :, None] * p["w"].T).reshape(-1, c.embed)
        flat = bytes_at.reshape(-1)
        g["e"] = np.stack([np.bincount(flat, back[:, k], PAD + 1) for k in range(c.embed)], axis=1).astype(np.float32)
        return float(loss), g

    def fit(self, chunks: list[np.ndarray], labels: np.ndarray) -> list[float]:
        """Adam over documents (arrays of chunks) in a seeded order; returns the mean loss of each epoch."""
        c = self.config
        rng = np.random.default_rng(c.seed)
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        losses, t, last = [], 0, c.epochs * -(-len(labels) // c.batch)
        for _ in range(c.epochs):
            order, total = rng.permutation(len(labels)), 0.0
            for at in range(0, len(order), c.batch):
                mine = order[at : at + c.batch]
                first = np.cumsum([0, *(len(chunks[k]) for k in mine[:-1])])
                loss, g = self.step(np.concatenate([chunks[k] for k in mine]), first, labels[mine])
                t += 1
                total += loss * len(mine)
                rate = c.rate * (1 - t / (last + 1))
                for k, v in g.items():
                    m1[k] += 0.1 * (v - m1[k])
                    m2[k] += 0.001 * (v * v - m2[k])
                    self.p[k] -= (rate * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
            losses.append(total / max(1, len(order)))
        self.base = None
        return losses

    def score(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, slab: int = 512) -> np.ndarray:
        """Probabilities of texts that stand in ``data`` (``chunk`` spare bytes behind), ``slab`` chunks at a time."""
        c, n = self.config, len(starts)
        if self.base is not None:
            return np.full(n, self.base)
        size = _n_chunks(ends - starts, c)
        done = np.cumsum(size)
        total = np.zeros((n, c.hidden), np.float64)
        most = np.zeros((n, c.hidden), np.float32)  # features are never below 0
        for at in range(0, int(done[-1]) if n else 0, slab):
            k = np.arange(at, min(at + slab, int(done[-1])))
            owner = np.searchsorted(done, k, side="right")
            first = starts[owner] + (k - (done[owner] - size[owner])) * c.step
            h = self.features(cut(data, first, ends[owner], c))
            edge = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            total[owner[edge]] += np.add.reduceat(h, edge, dtype=np.float64)
            most[owner[edge]] = np.maximum(most[owner[edge]], np.maximum.reduceat(h, edge))
        return np.round(self.probability((total / size[:, None]), most), 6)


def _bytes(texts: pa.Array, spare: int) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column (nulls empty) with spare ones behind, and the bounds of its texts."""
    texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, bounds, data = texts.buffers()
    if bounds is None or not len(texts):
        return np.zeros(spare, np.uint8), np.zeros(len(texts) + 1, np.int64)
    bounds = np.frombuffer(bounds, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    own = np.zeros(bounds[-1] - bounds[0] + spare, np.uint8)
    if data is not None:
        own[: bounds[-1] - bounds[0]] = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
    return own, bounds - bounds[0]


def _examples(docs: DataFrame, labels: DataFrame, config: QualityConfig, text_col: str) -> list[dict]:
    sample = labels.where("quality is not null and doc_id is not null").where(~held_out("doc_id"))
    sample = sample.groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("quality"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(config.max_examples)
    # The sample has max_examples rows at most, so it may be broadcast.
    chosen = docs.select("doc_id", F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id").where("text is not null")

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                data, bounds = _bytes(part.column(1), config.chunk)
                found = []
                for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    n = int(_n_chunks(np.array([e - s]), config)[0])
                    k = np.unique(np.linspace(0, n - 1, min(n, config.chunks)).round().astype(np.int64))
                    first = s + k * config.step
                    found.append(cut(data, first, np.full(len(first), e), config).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), part.column(3), pa.array(found, pa.binary())], ["doc_id", "quality", "h", "chunks"],
                )

    cut_up = chosen.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "quality", F.xxhash64("text").alias("h")).mapInArrow(
        chunks, "doc_id bigint, quality int, h bigint, chunks binary",
    )
    # Equal texts count once, good if half of their labels or more say so.
    return cut_up.groupBy("h").agg(
        F.min("doc_id").alias("doc_id"), F.min("chunks").alias("chunks"), (F.avg("quality") >= 0.5).cast("int").alias("quality"),
    ).toArrow().sort_by("doc_id").to_pylist()


def learn(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig(), text_col: str = "text") -> Network:
    """A network fitted to the labelled rows of ``docs`` that aren't held out."""
    rows = _examples(docs, labels, config, text_col)
    y = np.array([r["quality"] for r in rows], np.int64)
    network = Network(config, float(y.mean()) if len(y) else 1.0)
    if len(np.unique(y)) == 2:
        network.fit([np.frombuffer(r["chunks"], np.int16).reshape(-1, config.chunk) for r in rows], y)
    return network


def scored(docs: DataFrame, network: Network, text_col: str = "text") -> DataFrame:
    """``docs`` with score and predicted behind its other columns."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("score", "predicted") and c != text_col])
    own = free_name(docs, "text__")
    shared = docs.sparkSession.sparkContext.broadcast(network)
    rows = docs.withColumn(own, F.col(text_col).cast("string"))
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    names = [f.name for f in schema]
    spare, threshold = network.config.chunk, network.config.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                data, bounds = _bytes(part.column(part.num_columns - 1), spare)
                score = shared.value.score(data, bounds[:-1], bounds[1:])
                columns = [*part.columns[:-1], pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, schema)
