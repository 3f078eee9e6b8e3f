"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over block-max inverted lists.

Learning. At most ``max_examples`` labelled rows are used, those least by a hash of their
doc_id (a bounded sample; rows whose crc32(doc_id as text) mod 5 is 0 are held out and never
seen). Of equal texts one counts. Every word of an example is a term, weighed
(1 + ln tf) * idf * (floor + (1 - floor) * evidence), where evidence, between 0 and 1, rises with
the log-likelihood ratio G of the word's document frequencies in toxic and other examples,
(G / (G + half))^2. Without that factor (``floor`` = 1) the cosine is plain TF-IDF, in which a
few telling words drown among hundreds of others. Words are counted on the executors;
the driver holds what the bounded sample has.

Index. Each example is a vector of length 1. Examples are put in order by their strongest
common word, so that those of one language stand together, in blocks of ``block``. Each term
has, for each block, a list of (example, weight) and its greatest weight there. For a
text, the sum of products with those maxima bounds the cosine in each block; blocks are
read from the highest bound down until no bound reaches the k-th cosine found. So the k
nearest are exact over all terms; ties go to the lesser doc_id.

Score. Votes of the k nearest weigh 1 / (0.05 + 1 - cosine), with ``prior_weight`` votes of the
share of toxic examples. A rising function, fitted to the votes that each example gets from
the others (pooled adjacent violators, joined by lines), calibrates them. ``evidence`` lists
the nearest examples as doc_id:label:cosine.

Null texts count as empty. A text that shares no word with any example (an empty one too) has
no neighbour, and the score of a vote of none. Very long texts are read whole, a text at a
time. Repeated rows score alike. Without examples of both labels every score is the share of
toxic ones, 0 without any. An empty table gives an empty result. Extra columns are kept;
those called score, predicted or evidence give way to the new ones.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchloom.llm.common import settle

words = re.compile(r"[^\W\d_]+").findall


@dataclass(frozen=True)
class ToxicityConfig:
    max_examples: int = 4_000
    neighbours: int = 15
    floor: float = 0.02
    half: float = 50.0
    block: int = 512
    prior_weight: float = 0.5


def held_out(id_col: str) -> F.Column:
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def evidence(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int, half: float) -> np.ndarray:
    """0 to 1 for each word, from the numbers of toxic and clean examples that have it."""

    def h(k: np.ndarray, n: int) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where((k == 0) | (k == n), 0.0, k * np.log(k / n) + (n - k) * np.log(1 - k / n))

    g = np.maximum(0.0, 2 * (h(toxic, n_toxic) + h(clean, n_clean) - h(toxic + clean, n_toxic + n_clean)))
    return (g / (g + half)) ** 2


class Index:
    """Labelled examples: (doc_id, label, counts by word), at most ``max_examples`` of them."""

    def __init__(self, config: ToxicityConfig, examples: list[tuple[int, int, dict[str, int]]]):
        self.config, n = config, len(examples)
        labels = np.array([y for _, y, _ in examples], np.int64)
        self.base = float(labels.mean()) if n else 0.0
        self.curve: tuple[np.ndarray, np.ndarray] | None = None
        self.vocabulary: dict[str, int] = {}
        terms = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in c], np.int64) for _, _, c in examples]
        times = [np.fromiter(c.values(), np.float64, len(c)) for _, _, c in examples]
        v = len(self.vocabulary)
        held = [sum((np.bincount(t, minlength=v) for t, y in zip(terms, labels) if y == label), np.zeros(v, np.int64)) for label in (0, 1)]
        sure = evidence(held[1], held[0], int(labels.sum()), int(n - labels.sum()), config.half) if n else np.zeros(0)
        self.weight = (np.log((1 + n) / (1 + held[0] + held[1])) + 1) * (config.floor + (1 - config.floor) * sure)
        self.unseen = (np.log(1 + n) + 1) * config.floor  # weight of a word of no example
        vectors = [self._unit(t, tf, 0.0) for t, tf in zip(terms, times)]
        common = held[0] + held[1] >= max(2, n // 20)
        order = sorted(range(n), key=lambda k: (self._strongest(terms[k], times[k], common), examples[k][0]))
        self.names = np.array([examples[k][0] for k in order], np.int64)
        self.labels = labels[order]
        self.blocks = -(-n // config.block)
        # The lists, term after term, and inside a term block after block; long ones as rows of ``full``.
        own = [(terms[k], vectors[k]) for k in order]
        place = np.repeat(np.arange(n), [len(t) for t, _ in own])
        t = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in own)])
        w = np.concatenate([np.zeros(0), *(w for _, w in own)])
        block, inside = place // config.block, place % config.block
        self.tops = np.zeros((v, self.blocks))
        np.maximum.at(self.tops, (t, block), w)
        held = np.bincount(t * self.blocks + block, minlength=v * self.blocks).reshape(v, self.blocks)
        self.row = np.full((v, self.blocks), -1, np.int32)
        self.full: list[np.ndarray] = []
        for b in range(self.blocks):
            long = np.flatnonzero(held[:, b] > config.block // 8)
            self.row[long, b] = np.arange(len(long))
            self.full.append(np.zeros((len(long), config.block)))
            mine = np.flatnonzero((block == b) & (self.row[t, block] >= 0))
            self.full[b][self.row[t[mine], b], inside[mine]] = w[mine]
        rest = np.flatnonzero(self.row[t, block] < 0)
        cell = t[rest] * self.blocks + block[rest]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(cell, minlength=v * self.blocks))])
        rest = rest[np.argsort(cell, kind="stable")]
        self.places, self.weights = inside[rest], w[rest]

    @staticmethod
    def _strongest(terms: np.ndarray, times: np.ndarray, common: np.ndarray) -> int:
        has = np.flatnonzero(common[terms])
        return int(terms[has[times[has].argmax()]]) if len(has) else -1

    def _unit(self, terms: np.ndarray, times: np.ndarray, rest: float) -> np.ndarray:
        """Weights of the terms in a vector of length 1. ``rest``: square sum of other weights."""
        w = (1 + np.log(times)) * self.weight[terms]
        return w / np.sqrt(w @ w + rest) if len(w) else w

    def vector(self, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """The known terms of a text and their weights; unknown words count in its length."""
        find = self.vocabulary.get
        terms = np.fromiter((find(w, -1) for w in counts), np.int64, len(counts))
        times = np.fromiter(counts.values(), np.float64, len(counts))
        known = terms >= 0
        rest = ((1 + np.log(times[~known])) * self.unseen) ** 2
        return terms[known], self._unit(terms[known], times[known], float(rest.sum()))

    def nearest(self, t: np.ndarray, w: np.ndarray, k: int, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k examples nearest to the weights w of terms t."""
        bound = w @ self.tops[t]
        starts = self.starts[t[:, None] * self.blocks + np.arange(self.blocks + 1)]
        rows, size = self.row[t], self.config.block
        places, cosines = np.zeros(0, np.int64), np.zeros(0)
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or len(places) == k and bound[b] < cosines[-1] - 1e-12:
                break
            first, n = starts[:, b], starts[:, b + 1] - starts[:, b]
            ends = np.cumsum(n)
            at = np.repeat(first - (ends - n), n) + np.arange(ends[-1])
            long = np.flatnonzero(rows[:, b] >= 0)
            score = w[long] @ self.full[b][rows[long, b]] + np.bincount(self.places[at], np.repeat(w, n) * self.weights[at], minlength=size)
            least = cosines[-1] - 1e-12 if len(places) == k else 0.0
            hit = np.flatnonzero(score > max(least, 0.0))
            if len(hit) > 4 * k:  # all that may be among the k best, ties included
                hit = hit[score[hit] >= np.partition(score[hit], -k - 1)[-k - 1] - 1e-12]
            if without is not None:
                hit = hit[self.names[hit + b * size] != without]
            places, cosines = np.concatenate([places, hit + b * size]), np.concatenate([cosines, score[hit]])
            best = np.lexsort((self.names[places], -np.round(cosines, 12)))[:k]
            places, cosines = places[best], cosines[best]
        return places, cosines

    def vote(self, places: np.ndarray, cosines: np.ndarray) -> float:
        w = 1 / (0.05 + 1 - np.minimum(cosines, 1.0))
        c = self.config.prior_weight
        return float((w @ self.labels[places] + c * self.base) / (w.sum() + c))

    def asked(self, text: str, without: int | None = None) -> tuple[float, np.ndarray, np.ndarray]:
        """The vote over a text, and its nearest examples."""
        t, w = self.vector(Counter(words(text.lower())))
        places, cosines = self.nearest(t, w, self.config.neighbours, without)
        return self.vote(places, cosines), places, cosines

    def calibrate(self, votes: np.ndarray, labels: np.ndarray) -> None:
        """Pool adjacent violators over votes; the curve joins the pools' means by lines."""
        order = np.argsort(votes, kind="stable")
        pools: list[list[float]] = []  # sum of votes, sum of labels, rows
        for v, y in zip(votes[order].tolist(), labels[order].tolist()):
            pools.append([v, y, 1])
            while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last)]
        self.curve = np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        vote, places, cosines = self.asked(text)
        score = vote if self.curve is None else float(np.interp(vote, *self.curve))
        return min(1.0, max(0.0, score)), [(int(self.names[p]), int(self.labels[p]), float(c)) for p, c in zip(places, cosines)]


def learn(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> Index:
    """The index of the labelled rows of ``docs`` that aren't held out."""
    spark = docs.sparkSession
    sample = labels.where("toxic is not null and doc_id is not null").where(~held_out("doc_id"))
    sample = sample.groupBy("doc_id").agg(
        F.max(F.col("toxic").cast("int")).alias("toxic")
    ).orderBy(F.xxhash64("doc_id"), "doc_id").limit(config.max_examples)
    # The sample's rows are at most max_examples, so they may be broadcast.
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").where("text is not null")
    # Equal texts count once, toxic if most of their labels say so.
    texts = chosen.groupBy(F.xxhash64("text").alias("h")).agg(
        F.min("doc_id").alias("doc_id"), F.min("text").alias("text"), (F.avg("toxic") >= 0.5).cast("int").alias("toxic"),
    )
    texts = settle(texts.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "toxic"), "examples")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [Counter(words(t.lower())) for t in b.column(1).to_pylist()]
            terms = pa.array([list(c) for c in found], pa.list_(pa.string()))
            times = pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), terms, times], ["doc_id", "toxic", "terms", "times"])

    got = texts.mapInArrow(count, "doc_id bigint, toxic int, terms array<string>, times array<bigint>").toArrow().to_pylist()
    index = Index(config, sorted(((r["doc_id"], r["toxic"], dict(zip(r["terms"], r["times"]))) for r in got), key=lambda r: r[0]))
    if 0 < index.base < 1:
        shared = spark.sparkContext.broadcast(index)

        def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                votes = [shared.value.asked(t, without=name)[0] for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(votes, pa.float64()), b.column(2)], ["vote", "toxic"])

        found = texts.mapInArrow(vote, "vote double, toxic int").toArrow()
        index.calibrate(found["vote"].to_numpy(), found["toxic"].to_numpy())
        shared.destroy()  # workers need not keep it beside the one that scores
    return index


def _few(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """A few rows at a time, so that a batch's texts aren't all Python strings at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def scored(docs: DataFrame, index: Index, text_col: str = "text") -> DataFrame:
    """``docs`` with score, predicted and evidence behind its other columns."""
    extra = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("evidence", T.StringType())]
    clash = [c for c in docs.columns if c.lower() in {f.name for f in extra} and c != text_col]
    docs = docs.drop(*clash)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    place = docs.columns.index(text_col)
    schema = T.StructType(docs.schema.fields + extra)
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part in _few(batches):
            found = [own.score(t or "") for t in part.column(place).to_pylist()]
            score = [s for s, _ in found]
            near = [",".join(f"{n}:{y}:{c:.4f}" for n, y, c in e[:5]) for _, e in found]
            columns = [pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32()), pa.array(near, pa.string())]
            yield pa.RecordBatch.from_arrays([*part.columns, *columns], names)

    return docs.mapInArrow(run, schema)


def clean(docs: DataFrame, index: Index, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with its columns."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part in _few(batches):
            yield part.filter(pa.array([own.score(t or "")[0] < 0.5 for t in part.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))
