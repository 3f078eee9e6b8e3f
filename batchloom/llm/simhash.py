"""SimHash near-duplicates found through anchor points of a covering code.

Fingerprints are 64-bit. Two that differ in at most 3 bits differ in at most 1 bit in one
of their 32-bit halves. The anchors of a half are the words of a code: the perfect Hamming
code on 31 bits, times both values of the last bit. Its covering radius is 1, so each half
has a home anchor within 1. A half is replicated to all anchors within 1 + 1 = 2: its home,
the home with the last bit changed, and the 15 code words two bits away. If y differs from
x in at most one bit of the half, the home of x is among the anchors of y. Fingerprints of
one anchor are compared, home members against all, and links of at most 3 bits kept.

There are 2 x 2^27 anchors; only distinct fingerprints are replicated, 34 times. Fingerprints
of a crowded anchor (more than ``HOT`` rows) are told apart by the other half: with at most 3
differing bits in all, one of its four bytes is equal, so they are compared by (anchor, byte,
value). Where those are many too they are dealt out in tiles: home members into rows of
``tile``, all members into columns, and each home tile meets each tile of all once. So no task
holds a group, whatever its size, and no link is lost. Within a cell only a spanning forest
of the links is put out, never all pairs.

Documents with the same fingerprint are one node, so exact copies cost one aggregation.
Null or empty texts have fingerprint zero and are linked by it, as any other. Null doc_ids
never name a component unless all ids in it are null; repeated rows are rows of one
component. An empty table gives no rows. Shingles of a long text are hashed in blocks. Other
columns are dropped, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.llm.common import settle
from batchloom.llm.components import components

BITS = 3
HOT = 4_000  # rows at an anchor, or of one byte there, from which they are told apart or dealt out
TILE = 2_000  # rows in a tile, about


def fingerprint(text: str, words: int = 3) -> int:
    """Unsigned 64-bit SimHash over the XXH64 (seed 42) of all shingles, repeats included."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII spaces only
    if not parts:
        return 0
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    k = min(words, len(parts))
    starts = (ends - lengths)[: len(parts) - k + 1].tolist()
    stops = ends[k - 1 :].tolist()
    total = np.zeros(64, np.int64)
    one = xxhash.xxh64_intdigest
    for at in range(0, len(starts), 1 << 16):  # bounds the memory of a long text
        h = np.array([one(joined[s:e], 42) for s, e in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)])], ">u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(starts)).tobytes(), "big")


def with_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long)."""
    narrow = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t.as_py(), words) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found)], ["doc_id", "fp"])

    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, fp bigint")


# For each syndrome s of the Hamming code, the masks of the 15 pairs of bits whose change
# leads from a word with that syndrome to a code word.
_NAMES = np.arange(1, 32, dtype=np.uint32)
_FLIPS = np.zeros((32, 15), np.uint64)
for _s in range(1, 32):
    _FLIPS[_s] = [1 << (i - 1) | 1 << (j - 1) for i, j in combinations(range(1, 32), 2) if i ^ j == _s]
_TABLES = np.zeros((4, 256), np.uint32)  # syndrome of each byte of a half
for _k in range(4):
    for _i in range(8):
        if 8 * _k + _i < 31:
            _TABLES[_k, np.arange(256) >> _i & 1 == 1] ^= _NAMES[8 * _k + _i]


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor key, index into ``fp`` and home mark of each replica."""
    keys, index, home = [], [], []
    n = np.arange(len(fp))
    for half in range(2):
        x = fp.view(np.uint64) >> np.uint64(32 * half) & np.uint64(0xFFFFFFFF)
        s = np.zeros(len(x), np.uint32)
        for k in range(4):
            s ^= _TABLES[k, (x >> np.uint64(8 * k) & np.uint64(255)).astype(np.int64)]
        own = np.where(s > 0, x ^ (np.uint64(1) << (np.maximum(s, 1) - 1).astype(np.uint64)), x)
        far = np.flatnonzero(s)
        two = x[far][:, None] ^ _FLIPS[s[far]]
        mark = np.uint64(half << 32)
        for a, b, c in ((own, n, True), (own ^ np.uint64(1 << 31), n, False), (two.reshape(-1), np.repeat(far, 15), False)):
            keys.append((a | mark).view(np.int64))
            index.append(b)
            home.append(np.full(len(a), c))
    return np.concatenate(keys), np.concatenate(index), np.concatenate(home)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of links: each node with the least of its component."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        before = root.copy()
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        root = root[root]
        if (root == before).all():
            break
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


def near_links(key: np.ndarray, fp: np.ndarray, home: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links within groups of equal ``key``; rows sorted by key, home members first."""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.concatenate([edge, [len(key)]]))
    homes = np.add.reduceat(home.astype(np.int64), edge)
    found_a, found_b = [], []

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        near = np.bitwise_count((fp[i] ^ fp[j]).view(np.uint64)) <= bits
        near &= fp[i] != fp[j]
        found_a.append(fp[i[near]])
        found_b.append(fp[j[near]])

    # Member h of each group, at home, against member h + d.
    for h in range(int(homes.max(initial=0))):
        has = np.flatnonzero((homes > h) & (size > h + 1))
        if not len(has):
            break
        rest = size[has] - h - 1
        for at in range(0, len(has), 1 << 14):
            e, r = edge[has[at : at + (1 << 14)]], rest[at : at + (1 << 14)]
            i = np.repeat(e + h, r)
            keep(i, i + 1 + np.arange(r.sum()) - np.repeat(np.cumsum(r) - r, r))
    a, b = np.concatenate(found_a or [fp[:0]]), np.concatenate(found_b or [fp[:0]])
    return _forest(a, b)


def link(distinct: DataFrame, bits: int = BITS, hot: int = HOT, tile: int = TILE) -> DataFrame:
    """Links a, b of distinct fingerprints (column fp) that span the same components as all links do."""
    if bits > 3:
        raise ValueError("the anchors cover at most 3 differing bits")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                fp = b.column(0).slice(at, 4096).to_numpy(zero_copy_only=False)
                key, index, home = anchors(fp)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[index]), pa.array(home)], ["key", "fp", "home"])

    replicas = settle(distinct.select("fp").mapInArrow(spread, "key bigint, fp bigint, home boolean"), "replicas")
    # Counting by key is combined before the shuffle; only crowded anchors are left.
    crowded = settle(replicas.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("key"), "crowded")
    if crowded.isEmpty():
        dealt = replicas.withColumn("cell", F.lit(0).cast("bigint"))
    else:
        plain = replicas.join(crowded, "key", "left_anti").withColumn("cell", F.lit(0).cast("bigint"))
        # The marked half is the one of the anchor; the bytes are those of the other.
        low = (F.shiftright("key", 32) == 0).cast("int") * 32
        byte = lambda k: F.expr(f"shiftrightunsigned(fp, {8 * k} + other)").bitwiseAND(255)
        kinds = F.explode(F.array(*[byte(k) + 256 * (k + 1) for k in range(4)]))
        told = replicas.join(crowded, "key", "left_semi").withColumn("other", low).withColumn("part", kinds).drop("other")
        told = settle(told, "told")
        many = told.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"), F.count_if("home").alias("homes"))
        tiles = lambda n: F.ceil(n / tile).cast("int")
        many = settle(
            many.where(F.col("n") > hot).select("key", "part", tiles(F.col("homes")).alias("down"), tiles(F.col("n")).alias("across")),
            "many",
        )
        sized = told.join(many, ["key", "part"], "left").withColumns(
            {"down": F.coalesce("down", F.lit(1)), "across": F.coalesce("across", F.lit(1))}
        )
        row = lambda n: F.pmod(F.xxhash64("fp"), n).cast("bigint")
        cell = lambda i, j: F.shiftleft(i.cast("bigint"), 40) + F.shiftleft(j.cast("bigint"), 16) + F.col("part")
        place = lambda i, j, home: F.struct(cell(i, j).alias("cell"), home.alias("home"))
        upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        # A home member meets each column of all; as one of all it stands in its own column.
        as_home = F.transform(upto("across"), lambda j: place(row(F.col("down")), j, F.lit(True)))
        as_one = F.transform(upto("down"), lambda i: place(i, row(F.col("across")), F.lit(False)))
        alone = F.array(place(F.lit(0), F.lit(0), F.col("home")))
        places = F.when(F.col("across") == 1, alone).when(F.col("home"), F.concat(as_home, as_one)).otherwise(as_one)
        spread_out = sized.select("key", "fp", F.explode(places).alias("p")).select("key", "fp", "p.home", "p.cell")
        dealt = plain.unionByName(spread_out)
    grouped = dealt.select("key", "fp", "home", "cell").repartition("key", "cell").sortWithinPartitions("key", "cell", F.desc("home"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(part: tuple) -> pa.RecordBatch:
            a, b = near_links(_runs(part[0], part[3]), part[1], part[2], bits)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        held: tuple | None = None
        for b in batches:
            if not b.num_rows:
                continue
            part = tuple(c.to_numpy(zero_copy_only=False) for c in b.columns)
            if held is not None:
                part = tuple(np.concatenate(x) for x in zip(held, part))
            last = (part[0] == part[0][-1]) & (part[3] == part[3][-1])
            cut = len(last) - int(last[::-1].argmin() if not last.all() else len(last))
            if cut:
                yield out(tuple(c[:cut] for c in part))
            held = tuple(c[cut:] for c in part)
        if held is not None:
            yield out(held)

    return grouped.mapInArrow(compare, "a bigint, b bigint").distinct()


def _runs(key: np.ndarray, part: np.ndarray) -> np.ndarray:
    """One number for each run of equal (key, slice)."""
    new = np.concatenate([[False], (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
    return np.cumsum(new)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """doc_id, fp, fingerprint (hexadecimal) and component_id, one row for each row of ``df``."""
    prints = settle(with_fingerprints(df, id_col, text_col), "prints")
    nodes = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    links = components(link(nodes, bits)).withColumnRenamed("a", "fp")
    # Written tables let adaptive execution split joins at roots and fingerprints of many rows.
    rooted = settle(nodes.join(links, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    names = settle(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "names")
    named = settle(rooted.join(names, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
