"""Document fingerprints by a randomised embedding of edit distance into Hamming distance.

All texts share random bits, one for each step and class of characters. A walk reads a text
from its start; at each step it puts out the character under it, and the bit for that step
and character tells whether it goes on to the next. After an insertion or deletion two walks
soon meet again, so that texts within a small edit distance have outputs within a small
Hamming distance. A walk takes two steps a character on the mean and at most three.

A fingerprint holds the outputs at sampled steps. The steps depend only on the level of the
text, that is its length up to a power of two; the steps of a level are among those of
the levels below it. So any two fingerprints have the steps of the higher level in
common, and the share of equal outputs there estimates 1 - Hamming distance. It has 128 to 256
samples before the end (all steps for short texts). Written as hexadecimal: level (2
digits), then a byte for each sampled step; ``ff`` stands behind a text's end.

``bands`` are hashes of sampled outputs at steps shared by neighbouring levels; texts are
compared (``likeness``) where a band is equal. ``near_documents`` does so over a table.

Null texts count as empty; empty texts are like each other only. Walks of a level advance
together. Equal texts have equal fingerprints. Whole texts are walked, however long. Repeated
rows give repeated rows, rows of one doc_id stand in order of their texts, null doc_ids come
last; an empty table gives no rows. Other columns are dropped, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.llm.common import free_name, settle

SAMPLES = 128
PERIOD = 4093  # of the shared random bits, in steps
END = 255
LEAST_LEVEL = SAMPLES.bit_length() - 1
BANDS, BAND_SAMPLES = 16, 8

_BITS = np.random.default_rng(1).integers(0, 2, (PERIOD, 256)).astype(np.int32)
_BITS[:, END] = 0


def _mix(x: np.ndarray) -> np.ndarray:
    z = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


_CLASSES = (_mix(np.arange(1 << 16)) % np.uint64(255)).astype(np.uint8)


def char_classes(text: str) -> np.ndarray:
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(cp) and cp.max() >= 1 << 16:
        return (_mix(cp) % np.uint64(255)).astype(np.uint8)
    return _CLASSES[cp]


def level_of(n: int) -> int:
    """2n steps lie below 2^(level + 1)."""
    return max(LEAST_LEVEL, (2 * n).bit_length() - 1)


@lru_cache(maxsize=64)
def steps_of(level: int) -> np.ndarray:
    """Sampled steps of a level: those below 3 * 2^level whose hash lies below a bound that halves from level to level."""
    bound = np.uint64(2 ** (63 - (level - LEAST_LEVEL)) * 2 - 1) if level > LEAST_LEVEL else np.uint64(0xFFFFFFFFFFFFFFFF)
    most, out = 3 << level, []
    for at in range(0, most, 1 << 20):
        j = np.arange(at, min(most, at + (1 << 20)))
        out.append(j[_mix(j) <= bound])
    return np.concatenate(out)


def walks(texts: list[str]) -> list[bytes]:
    """For each text its level and its samples, in one byte string."""
    out: list[bytes] = [b""] * len(texts)
    groups: dict[int, list[int]] = {}
    for k, t in enumerate(texts):
        groups.setdefault(level_of(len(t)), []).append(k)
    end = np.array([END], np.uint8)
    for level, places in groups.items():
        parts = [char_classes(texts[k]) for k in places]
        sizes = np.array([len(p) for p in parts], np.int64)
        buffer = np.concatenate([x for p in parts for x in (p, end)])
        at = np.cumsum(sizes + 1) - (sizes + 1)
        c = np.empty(len(parts), np.uint8)
        r = np.empty(len(parts), np.int32)
        steps = steps_of(level)
        sampled = np.full((len(steps), len(parts)), END, np.uint8)
        marks = steps.tolist()
        s = 0
        for j in range(3 * int(sizes.max(initial=0))):
            np.take(buffer, at, out=c, mode="clip")
            if marks[s] == j:
                sampled[s] = c
                s += 1
                if s == len(marks):
                    break
            np.take(_BITS[j % PERIOD], c, out=r, mode="clip")
            np.add(at, r, out=at)
            if j & 255 == 255 and (c == END).all():
                break
        late = steps[:, None] >= 3 * sizes[None, :]
        sampled[late] = END
        live = (sampled != END).sum(axis=0)
        for i, k in enumerate(places):
            out[k] = bytes([level]) + sampled[: int(live[i]), i].tobytes()
    return out


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal outputs at the sampled steps that both levels have, up to the later end."""
    level = max(a[0], b[0])

    def at(x: bytes) -> np.ndarray:
        own = np.frombuffer(x, np.uint8, len(x) - 1, 1)
        return own if x[0] == level else own[np.isin(steps_of(x[0])[: len(own)], steps_of(level), assume_unique=True)]

    x, y = at(a), at(b)
    most, least = max(len(x), len(y)), min(len(x), len(y))
    if not most:
        return 1.0 if a == b else 0.0
    return int((x[:least] == y[:least]).sum()) / most


def written(x: bytes) -> str:
    return x.hex()


def _after(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the following text."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def with_next(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """part, ghost, doc_id, text - in each partition, sorted by (part, ghost), a row is followed by
    the next one in descending doc_id order; a part ends with a ghost, the first row of the part
    after it (after the last part: of the first).

    Parts are ranges of doc_id, cut at quantiles, and each is a partition: one for each 16 MB that
    the planner expects, at least as many as shuffle partitions. The driver holds one id for each.
    Texts are shuffled once. Null doc_ids come last.
    """
    from pyspark.ml.feature import Bucketizer

    spark = df.sparkSession
    key = free_name(df, "order__")
    docs = df.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.coalesce(F.col(id_col).cast("double"), F.lit(float(-(1 << 63)))).alias(key),
    )
    expected = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Without an estimate (rows that come from the driver or from Python) the planner says exabytes.
    n = max(parts, min(expected >> 24, 100_000)) if expected < 1 << 56 else 4 * parts
    cuts = sorted(set(docs.approxQuantile(key, [k / n for k in range(1, n)], 0.2 / n))) or [0.0]
    docs = Bucketizer(
        splits=[-float("inf"), *cuts, float("inf")], inputCol=key, outputCol="part",
    ).transform(docs).withColumn("part", F.lit(len(cuts)) - F.col("part").cast("int"))
    heads = sorted((r["part"], r["head"]) for r in docs.groupBy("part").agg(F.max(key).alias("head")).collect())
    ghosts = [(head, heads[k - 1][0]) for k, (_, head) in enumerate(heads)]  # the part before takes it
    table = spark.createDataFrame(ghosts, f"{key} double, into int") if ghosts else spark.createDataFrame([], f"{key} double, into int")
    copies = F.when(F.col("into").isNull(), F.array(F.struct("part", F.lit(0).alias("ghost")))).otherwise(
        F.array(F.struct("part", F.lit(0).alias("ghost")), F.struct(F.col("into").alias("part"), F.lit(1).alias("ghost")))
    )
    marked = docs.join(F.broadcast(table), key, "left").select("doc_id", "text", key, F.explode(copies).alias("p"))
    dealt = marked.select("p.part", "p.ghost", "doc_id", "text", key).repartitionById(len(cuts) + 1, F.col("part"))
    return dealt.sortWithinPartitions("part", "ghost", F.desc_nulls_last("doc_id"), "text").select("part", "ghost", "doc_id", "text")


def with_edits(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 8 << 20, chunk_rows: int = 2048,
) -> DataFrame:
    """Fingerprints of each text and of its edited text, and likeness to the edited and the next text."""
    rows = with_next(df, id_col, text_col)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            """All but the last, which is only looked at."""
            own = [k for k in range(len(held) - 1) if not held[k][1]]
            edited = [_after(held[k][3], held[k + 1][3]) for k in own]
            prints = walks([h[3] for h in held] + edited)
            changed = prints[len(held) :]
            columns = [
                pa.array([held[k][2] for k in own], kind),
                pa.array([len(held[k][3]) for k in own], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], pa.string()),
                pa.array([written(prints[k]) for k in own], pa.string()),
                pa.array([written(x) for x in changed], pa.string()),
                pa.array([likeness(prints[k], x) for k, x in zip(own, changed)], pa.float64()),
                pa.array([likeness(prints[k], prints[k + 1]) for k in own], pa.float64()),
            ]
            return pa.RecordBatch.from_arrays(columns, names)

        held: list[tuple] = []
        chars = 0
        kind = None
        for b in batches:
            kind = b.schema.field(2).type
            for at in range(0, b.num_rows, 256):
                for row in zip(*(c.to_pylist() for c in b.slice(at, 256).columns)):
                    held.append(row)
                    chars += len(row[3])
                    if len(held) > 1 and (chars >= chunk_chars or len(held) > chunk_rows):
                        yield out(held, kind)
                        held = held[-1:]
                        chars = len(row[3])
        if len(held) > 1:
            yield out(held, kind)

    return rows.mapInArrow(run, schema)


@lru_cache(maxsize=4096)
def _picked(band: int, most: int) -> np.ndarray:
    return np.random.default_rng(band).permutation(most)[:BAND_SAMPLES]


def bands(x: bytes) -> list[int]:
    """Hashes of groups of samples, at the text's level and the one above, whose steps it has too.

    Groups are drawn from the first 1.25^k samples, for the k at a text's number of samples and
    the next, so that they lie over the whole text, and texts whose numbers differ by a quarter
    at most have a k in common. Behind a text's end samples count as ``END``.
    """
    out = []
    own = np.frombuffer(x, np.uint8, len(x) - 1, 1)
    for level in (x[0], x[0] + 1):
        s = own if level == x[0] else own[np.isin(steps_of(x[0])[: len(own)], steps_of(level), assume_unique=True)]
        size = int(np.log(max(len(s), 1)) / np.log(1.25) + 1e-9)
        for k in (size, size + 1):
            most = int(np.ceil(1.25**k))
            full = np.concatenate([s, np.full(max(0, most - len(s)), END, np.uint8)])
            for b in range(BANDS):
                h = xxhash.xxh64_intdigest(bytes([level, k, b]) + full[_picked(b, most)].tobytes())
                out.append(h - (1 << 64) if h >> 63 else h)
    return sorted(set(out))


def near_documents(df: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", slice_rows: int = 4096) -> DataFrame:
    """doc_id, fingerprint and class_id: the least doc_id among documents linked by likeness.

    Equal fingerprints are one node. In each band the nodes are linked to its first node if
    their likeness is at least ``least``. Those that aren't are compared with all nodes of the
    band, dealt out in slices, but for those that are linked by others already; so no link of
    two nodes with a band in common is lost. Were samples to differ independently, two texts of
    likeness p and one level would have one of the ``BANDS`` of a group in common with
    probability 1 - (1 - p^8)^16: 0.95 at 0.8, more than 0.99 at 0.9.
    """
    from batchloom.llm.components import components

    narrow = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([written(x) for x in walks(part.column(1).to_pylist())])], ["doc_id", "fingerprint"],
                )

    every = settle(narrow.mapInArrow(prints, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, fingerprint string"), "prints")
    nodes = every.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            keys = [bands(bytes.fromhex(t)) for t in texts]
            yield pa.RecordBatch.from_pydict(
                {
                    "band": pa.array([k for own in keys for k in own], pa.int64()),
                    "fingerprint": [t for t, own in zip(texts, keys) for _ in own],
                }
            )

    def first_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = [likeness(bytes.fromhex(x), bytes.fromhex(y)) >= least for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near, pa.bool_())], ["band", "fingerprint", "first", "near"])

    def rest_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[list[bytes]] = []  # linked nodes of the slice
        where = None
        for b in batches:
            found: list[tuple[str, str]] = []
            for band, part, visits, near, text in zip(*(c.to_pylist() for c in b.columns)):
                if (band, part) != where:
                    where, groups = (band, part), [[]]
                x = bytes.fromhex(text)
                if not visits:
                    if near:
                        groups[0].append(x)
                    else:
                        groups.append([x])
                    continue
                met, others = [], []
                for g in groups:
                    y = next((y for y in g if likeness(x, y) >= least), None)
                    if y is None:
                        others.append(g)
                    else:
                        met += g
                        if x != y:
                            found.append((text, written(y)))
                groups = [met, *others] if met else others
            yield pa.RecordBatch.from_pydict(
                {"a": pa.array([p[0] for p in found], pa.string()), "b": pa.array([p[1] for p in found], pa.string())}
            )

    banded = settle(nodes.select("fingerprint").mapInArrow(spread, "band bigint, fingerprint string"), "bands")
    # Written tables let adaptive execution split the join at crowded bands.
    firsts = settle(
        banded.groupBy("band").agg(
            F.min("fingerprint").alias("first"), F.count(F.lit(1)).alias("n"),
        ).where("n > 1").select("band", "first"),
        "firsts",
    )
    told = settle(
        banded.join(firsts, "band").select("band", "fingerprint", "first").mapInArrow(
            first_links, "band bigint, fingerprint string, first string, near boolean",
        ),
        "told",
    )
    rest = told.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("near").alias("all")).where("not all")
    rest = settle(rest.select("band", F.ceil(F.col("n") / slice_rows).cast("int").alias("slices")), "rest")
    # A node goes to its own slice; one that is left over visits each slice too.
    own = F.pmod(F.xxhash64("fingerprint"), F.col("slices")).cast("int")
    stays = F.array(F.struct(own.alias("part"), F.lit(False).alias("visits")))
    visits = F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda k: F.struct(k.alias("part"), F.lit(True).alias("visits")))
    dealt = told.join(rest, "band").select(
        "band", "near", "fingerprint", F.explode(F.when(F.col("near"), stays).otherwise(F.concat(stays, visits))).alias("p"),
    )
    grouped = dealt.select(
        "band", "p.part", "p.visits", "near", "fingerprint",
    ).repartition("band", "part").sortWithinPartitions("band", "part", "visits", "fingerprint")
    pairs = told.where("near and fingerprint <> first").select(F.col("fingerprint").alias("a"), F.col("first").alias("b"))
    links = components(pairs.union(grouped.mapInArrow(rest_links, "a string, b string")).distinct())
    rooted = nodes.join(
        links.withColumnRenamed("a", "fingerprint"), "fingerprint", "left",
    ).withColumn("root", F.coalesce("root", "fingerprint"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("class_id")), "root").select("fingerprint", "class_id")
    return every.join(named, "fingerprint").select("doc_id", "fingerprint", "class_id")
