"""Line dedup by pairwise alignment: patience diff of documents that share rare line hashes.

Units. A text is cut into units: lines, and inside lines sentences. A unit of more than
``long_words`` words is cut again after words that a sum over their first and last letter
and length picks (about one in eight), so that a passage set into longer lines still
shares units. Writing without blanks counts a word for eight ASCII or three
other characters.

Overlaps. The hashes that documents are found by are those of runs, that is units that
follow each other: the shortest runs of ``min_passage`` words from each unit on and up to each
unit, and shorter ones that fill whole lines and have ``min_words``. A run is far rarer
than a line. Of the documents that hold a run the least doc_id is the partner of all others, so
that a passage in a third of all rows makes one pair a row and not their square. Any longer run
that two documents share is the union of such runs inside it, and both have those; so what any
one earlier document holds whole is found, wherever and however often.

Alignment. A later document is aligned with each of its partners. The shared runs are (later
place, earlier place) pairs; their longest chain that rises in both (patience sorting) is
the diff's common part. Blocks of it are deleted from the later document, and wherever it repeats them.
What is off the chain stands in another order than in the partner and stays, as in any diff, unless it
is part of a shared block of ``moved`` words or more, which is a passage and no chance: that goes
wherever it stands. Time is that of sorting, however often a line repeats.

Null texts stay null; empty ones stay empty. A document whose text is all copied becomes
empty; no row is ever dropped. Rows with equal doc_ids count as one document: they are never
compared with each other, and told apart by 20 bits of their texts' hash. A null doc_id counts
as the least. An empty table stays empty. Very long texts are units of one row, at most
2^30 of them. Other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchloom.llm.common import free_name, settle

_STOP = re.compile(r"[.!?](?=[ \t])").finditer
_WIDE_STOP = re.compile(r"[.!?\u3002\uff01\uff1f](?:(?=[ \t])|(?<=[\u3002\uff01\uff1f]))").finditer  # the wide ones need no blank
_ODD_BLANK = re.compile(r"[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search  # white space beside blank and line feed
_WORD = re.compile(r"\S+").finditer
_NOT_BYTES = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u0100-\U0010ffff]").search
_MOST_BYTES = 1 << 22  # of texts that are cut at once
# A unit's place in its table: text tag, number, opens a line, closes a line, words (no more than count).
_TAG_BITS, _PLACE_BITS, _WORD_BITS = 20, 30, 11
_STEP = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class LineConfig:
    min_words: int = 5
    min_passage: int = 12
    long_words: int = 25
    moved: int = 50  # words of a shared block that goes whether aligned or not; 1: each, 0: none

    def __post_init__(self) -> None:
        if max(self.min_words, self.min_passage) >= 1 << _WORD_BITS:
            raise ValueError(f"min_words and min_passage must be below {1 << _WORD_BITS}")


def _keys(text: str, own: list) -> list[int]:
    """Hashes of the units."""
    raw, one = text.encode("utf-8", "surrogatepass"), xxhash.xxh64_intdigest
    if len(raw) == len(text):
        return [one(raw[u[0] : u[1]], 7) for u in own]
    return [one(text[u[0] : u[1]].encode("utf-8", "surrogatepass"), 7) for u in own]


def _words(n: int, part: str) -> int:
    """Words of a part with n words between blanks; where blanks are rare, one for eight ASCII or three other characters."""
    size = len(part)
    if size <= 16 * n:
        return n
    return max(n, size // 3) if not part.isascii() else max(n, size // 8) if size > 24 * n else n


def units(text: str, config: LineConfig) -> list[tuple[int, int, int, bool, bool]]:
    """start, end, words, opens a line, closes a line - for each unit of a text."""
    out = []
    most, start = config.long_words, 0
    stop_marks = _STOP if text.isascii() else _WIDE_STOP
    single = "  " not in text and not _ODD_BLANK(text)  # then words are one more than blanks
    for line in text.split("\n"):
        begin, start = start, start + len(line) + 1
        own = line.strip()
        if not own:
            continue
        at = begin + line.index(own[0])
        end = at + len(own)
        stops = [m.start() + 1 for m in stop_marks(text, at, end)]
        if not stops or stops[-1] < end:
            stops.append(end)
        first = True
        for stop in stops:
            while text[at] in " \t":
                at += 1
            n = text.count(" ", at, stop) + 1 if single else len(text[at:stop].split())
            if n > most:
                if single:
                    part = text[at:stop].split(" ")
                    starts = list(accumulate((len(w) + 1 for w in part), initial=at))
                else:
                    starts = [m.start() for m in _WORD(text, at, stop)]
                    part = text[at:stop].split()
                n, last = len(part), 0
                picked = [k for k, w in enumerate(part) if not (31 * ord(w[0]) + 17 * ord(w[-1]) + 7 * len(w)) & 7]
                for k in [*picked, n - 1]:
                    if last <= k and (k == n - 1 or k - last >= 4):
                        e = starts[k] + len(part[k])
                        out.append((starts[last], e, _words(k + 1 - last, text[starts[last] : e]), first, stop == end and k == n - 1))
                        last, first = k + 1, False
            else:
                out.append((at, stop, n if stop - at <= 16 * n else _words(n, text[at:stop]), first, stop == end))
            first = False
            at = stop
    return out


def byte_units(texts: list[str], config: LineConfig) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """The units of many texts at once: the texts in a row, their starts there and their end, columns as those of
    ``units`` (places in that row), and the number of units of each text.

    Only for texts of the first 256 code points whose white space is single blanks and line feeds: there each byte is
    a character, and words, sentences and lines end where the byte after them says so.
    """
    joined = "\n".join([*texts, "\n"])
    data = np.frombuffer(joined.encode("latin-1"), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    bases = np.concatenate([[0], np.cumsum(sizes + 1)])
    inside = (data != 32) & (data != 10)
    turns = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        turns = np.concatenate([[0], turns])
    first, end = turns[::2], turns[1::2]  # of each word; the row ends with two line feeds
    closes = (data[end] == 10) | (data[end + 1] == 10)
    mark = data[end - 1]
    stops = np.flatnonzero(closes | (mark == 46) | (mark == 33) | (mark == 63))
    count = np.diff(stops, prepend=-1)
    heads = stops - count + 1
    opens = np.concatenate([[True], closes[stops[:-1]]])[: len(stops)]
    long = np.flatnonzero(count > config.long_words)
    if len(long):
        # The words of long units, and which of them units may end with.
        n = count[long]
        edge = np.cumsum(n)
        word = np.repeat(heads[long] - (edge - n), n) + np.arange(edge[-1])
        told = 31 * data[first[word]].astype(np.int64) + 17 * data[end[word] - 1] + 7 * (end[word] - first[word])
        picked = word[told & 7 == 0]
        ranges = np.searchsorted(picked, heads[long]), np.searchsorted(picked, stops[long])
        picks, more = picked.tolist(), []
        for head, a, b in zip(heads[long].tolist(), ranges[0].tolist(), ranges[1].tolist()):
            for k in picks[a:b]:
                if k - head >= 4:
                    more.append(k)
                    head = k + 1
        cuts = np.array(more, np.int64)
        stops = np.sort(np.concatenate([stops, cuts]))
        count = np.diff(stops, prepend=-1)
        heads = stops - count + 1
        # A cut closes no line, and what follows it opens none.
        closes[cuts] = False
        opens = np.concatenate([[True], closes[stops[:-1]]])[: len(stops)]
    begin, over = first[heads], end[stops]
    count = count.copy()
    for k in np.flatnonzero(over - begin > 16 * count).tolist():
        count[k] = _words(int(count[k]), joined[begin[k] : over[k]])
    table = np.stack([begin, over, count, opens, closes[stops]]).astype(np.int64)
    return joined, bases, table, np.diff(np.searchsorted(begin, bases))


def units_of(texts: list[str], config: LineConfig) -> list[list[tuple[int, int, int]]]:
    """start, end, words - for each unit of each text."""
    out: list[list] = [[] for _ in texts]
    groups, rest = parted(texts)
    for group in groups:
        _, bases, table, sizes = byte_units([texts[k] for k in group], config)
        table[:2] -= np.repeat(bases[:-1], sizes)
        rows, at = list(zip(*table[:3].tolist())), 0
        for k, n in zip(group, sizes.tolist()):
            out[k] = rows[at : at + n]
            at += n
    for k in rest:
        out[k] = [u[:3] for u in units(texts[k], config)]
    return out


def parted(texts: list[str]) -> tuple[list[list[int]], list[int]]:
    """Places of the texts that ``byte_units`` may cut, some MB at a time, and of the others; empty ones have no units."""
    groups: list[list[int]] = []
    rest, size = [], _MOST_BYTES
    for k, text in enumerate(texts):
        if "  " in text or _NOT_BYTES(text):
            rest.append(k)
        elif text:
            if size >= _MOST_BYTES:
                groups.append([])
                size = 0
            groups[-1].append(k)
            size += len(text)
    return groups, rest


def byte_keys(joined: str, begin: np.ndarray, over: np.ndarray) -> list[int]:
    """Hashes of units of texts in a row."""
    raw, one = joined.encode("utf-8"), xxhash.xxh64_intdigest
    if len(raw) != len(joined):  # characters of two bytes
        wide = np.concatenate([[0], np.cumsum(np.frombuffer(joined.encode("latin-1"), np.uint8) > 127)])
        begin, over = begin + wide[begin], over + wide[over]
    return [one(raw[s:e], 7) for s, e in zip(begin.tolist(), over.tolist())]


def text_tag(text: str) -> int:
    return xxhash.xxh32_intdigest(text.encode("utf-8", "surrogatepass"), 3) >> 32 - _TAG_BITS


def runs(doc: np.ndarray, at: np.ndarray, key: np.ndarray, config: LineConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """run, doc, span (tag, first unit, further units, may be deleted, the document's first of its kind) -
    of units sorted by doc and at."""
    if len(doc) > 1:
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])])  # equal rows of one doc_id
        doc, at, key = doc[new], at[new], key[new]
    n, whole = len(doc), config.min_passage
    words = at & (1 << _WORD_BITS) - 1
    closes, opens = at >> _WORD_BITS & 1, at >> _WORD_BITS + 1 & 1
    place = at >> _WORD_BITS + 2
    begins = np.concatenate([[True], (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + 1)])
    heads = np.flatnonzero(begins)
    stretch = np.cumsum(begins) - 1
    least, most = heads[stretch], np.concatenate([heads[1:], [n]])[stretch]  # the stretch of each unit
    total = np.concatenate([[0], np.cumsum(words)])
    own = np.arange(n)
    end = np.searchsorted(total, total[:-1] + whole) - 1
    start = np.searchsorted(total, total[1:] - whole, "right") - 1
    ahead, behind = end < most, start >= least
    pairs = np.unique(np.concatenate([own[ahead] * (n + 1) + end[ahead], start[behind] * (n + 1) + own[behind]]))
    firsts, lasts, asks = [pairs // (n + 1)], [pairs % (n + 1)], [np.ones(len(pairs), np.int64)]
    s, e = own, own
    while len(s):
        size = total[e + 1] - total[s]
        s, e, size = s[size < whole], e[size < whole], size[size < whole]
        told = size >= config.min_words
        firsts.append(s[told])
        lasts.append(e[told])
        asks.append(opens[s[told]] & closes[e[told]])
        s, e = s[e + 1 < most[s]], e[e + 1 < most[s]] + 1
    first, last, ask = np.concatenate(firsts), np.concatenate(lasts), np.concatenate(asks)
    # Sum of key times power of an odd number, divided by the power of the first: modulo 2^64.
    power = np.cumprod(np.full(n, _STEP, np.uint64))
    back = np.cumprod(np.full(n, pow(_STEP, -1, 1 << 64), np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(key.view(np.uint64) * power)])
    run = ((sums[last + 1] - sums[first]) * back[first]).view(np.int64)
    owner = doc[first]
    order = np.lexsort((first, run, owner))
    new = np.ones(len(run), bool)
    new[1:] = (run[order][1:] != run[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    opening = np.zeros(len(run), np.int64)
    opening[order[new]] = 1
    return run, owner, ((place[first] << _WORD_BITS | last - first) << 1 | ask) << 1 | opening


def patience(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of (later, earlier) places that rises in both; ``pairs`` sorted by the first."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, e) in enumerate(pairs):
        p = bisect_left(tops, e)
        if p:
            back[k] = at[p - 1]
        if p == len(tops):
            tops.append(e)
            at.append(k)
        else:
            tops[p], at[p] = e, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(partner: np.ndarray, own: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which pairs (own place, place held by the partner) are on the chain with their partner, or repeat a block that is.

    The rows are sorted by partner, own place, and falling place held, so that a chain has one
    pair of an own place.
    """
    other, later, same = np.diff(partner) != 0, np.diff(own) > 0, np.diff(held) == 0
    if (other | (later & (np.diff(held) > 0)) | (~later & same)).all():
        return np.ones(len(own), bool)  # all in the partner's order, as in copies
    on = np.zeros(len(own), bool)
    edges = [0, *(np.flatnonzero(other) + 1).tolist(), len(own)]
    for s, e in zip(edges, edges[1:]):
        pairs = list(dict.fromkeys(zip(own[s:e].tolist(), held[s:e].tolist())))
        chain = patience(pairs)
        on[s:e] = np.isin(own[s:e], [p for p, _ in chain]) | np.isin(held[s:e], [h for _, h in chain])
    return on


def _merged(first: np.ndarray, last: np.ndarray) -> list[tuple[int, int]]:
    """Units of overlapping or touching runs together."""
    order = np.argsort(first, kind="stable")
    f, z = first[order], np.maximum.accumulate(last[order])
    new = np.flatnonzero(f[1:] > z[:-1] + 1) + 1
    return list(zip([int(f[0]), *f[new].tolist()], [*z[new - 1].tolist(), int(z[-1])])) if len(f) else []


def cut(
    text: str, found: list, partner: np.ndarray, held: np.ndarray, span: np.ndarray, config: LineConfig,
) -> tuple[str, list[tuple[int, int]], list[tuple[int, int]]]:
    """The text without its blocks that are aligned with partners or long, the places cut, and those of them
    that stand in another order there (code points).

    ``partner``, ``held``, ``span``: for each shared run the earlier document, the run's first unit
    there, and its place here.
    """
    place = span >> 2 + _WORD_BITS
    first = place & (1 << _PLACE_BITS) - 1
    last = first + (span >> 2 & (1 << _WORD_BITS) - 1)
    mine = place >> _PLACE_BITS == text_tag(text)
    if not mine.all():  # rows of this doc_id with other texts
        partner, held, first, last = partner[mine], held[mine], first[mine], last[mine]
    if not len(first):
        return text, [], []
    odd: list[tuple[int, int]] = []
    if (held - first == held[0] - first[0]).all() and (partner == partner[0]).all():  # one block of one partner, as in copies
        gone = _merged(first, last)
    else:
        order = np.lexsort((-held, first, partner))
        first, last = first[order], last[order]
        on = align(partner[order], first, held[order])
        gone = aligned = _merged(first[on], last[on])
        if config.moved and not on.all():
            long = [(f, z) for f, z in _merged(first, last) if sum(u[2] for u in found[f : z + 1]) >= config.moved]
            gone = _merged(*(np.array(x, np.int64) for x in zip(*aligned, *long))) if aligned or long else []
            within = lambda block, blocks: any(s <= block[0] and block[1] <= e for s, e in blocks)
            odd = [b for b in _merged(first[~on], last[~on]) if within(b, long) and not within(b, aligned)]
    out, kept, at = [], [], 0
    for f, z in gone:
        s, e = found[f][0], found[z + 1][0] if z + 1 < len(found) else len(text)
        out.append((s, found[z][1]))
        kept.append(text[at:s])
        at = e
    kept.append(text[at:])
    rest = "".join(kept).rstrip("\n") if at == len(text) else "".join(kept)
    return rest, out, [(found[f][0], found[z][1]) for f, z in odd]


def _order(id_col: str) -> F.Column:
    return F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63)))


def overlaps(df: DataFrame, config: LineConfig, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, partner, held and span: each run of a document that an earlier one has, and its place in both."""
    narrow = df.where(F.length(text_col) > 0).select(_order(id_col).alias("doc"), F.col(text_col).alias("text"))
    count = max(config.min_words, config.min_passage)

    def out(docs: np.ndarray, tags: np.ndarray, keys: list[int], table: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        words, opens, closes = table
        columns = [
            np.array(keys, np.uint64).view(np.int64), np.repeat(docs, sizes), np.repeat(tags, sizes),
            (np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32),
            ((opens << 1 | closes) << _WORD_BITS | np.minimum(words, count)).astype(np.int32),
        ]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["key", "doc", "tag", "place", "kind"])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                docs, texts = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_pylist()
                tags = np.fromiter(map(text_tag, texts), np.int32, len(texts))
                groups, rest = parted(texts)
                for group in groups:
                    joined, _, table, sizes = byte_units([texts[k] for k in group], config)
                    yield out(docs[group], tags[group], byte_keys(joined, table[0], table[1]), table[2:], sizes)
                for k in rest:
                    own = units(texts[k], config)
                    table = np.array([u[2:] for u in own], np.int64).reshape(-1, 3).T
                    yield out(docs[k : k + 1], tags[k : k + 1], _keys(texts[k], own), table, np.array([len(own)]))

    lines = settle(narrow.mapInArrow(keyed, "key bigint, doc bigint, tag int, place int, kind int"), "units")
    place = F.shiftleft(F.shiftleft(F.col("tag").cast("bigint"), _PLACE_BITS) + F.col("place"), _WORD_BITS + 2) + F.col("kind")
    # Only keys of several documents go on; counting is combined before the shuffle. Written tables
    # leave both joins to adaptive execution, which splits keys that many rows have.
    shared = settle(
        lines.groupBy("key").agg(F.min("doc").alias("owner"), F.max("doc").alias("latest")).where("latest > owner").select("key"), "shared",
    )
    dealt = lines.select("doc", place.alias("at"), "key").join(shared, "key", "left_semi").select("doc", "at", "key").repartition("doc").sortWithinPartitions("doc", "at")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(part: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in runs(*part, config)], ["run", "doc", "span"])

        held: list[np.ndarray] | None = None
        for b in batches:
            part = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if held is not None:
                part = [np.concatenate(x) for x in zip(held, part)]
            done = int(np.searchsorted(part[0], part[0][-1])) if len(part[0]) else 0
            if done:
                yield out([x[:done] for x in part])
            held = [x[done:] for x in part]
        if held is not None and len(held[0]):
            yield out(held)

    every = settle(dealt.mapInArrow(joined, "run bigint, doc bigint, span bigint"), "runs")
    # The least document of each run, and the place where it has it first; sums of longs, combined
    # before the shuffle. Written tables let adaptive execution split the join at hot runs.
    there = F.when(F.col("span").bitwiseAND(1) == 1, F.col("doc"))
    held = F.min_by(F.shiftright("span", 2 + _WORD_BITS).bitwiseAND((1 << _PLACE_BITS) - 1), there)
    first = every.groupBy("run").agg(
        F.min("doc").alias("partner"), F.max("doc").alias("latest"), held.alias("held"),
    ).where("latest > partner")
    first = settle(first.select("run", "partner", "held"), "holders")
    return every.where(F.col("span").bitwiseAND(2) == 2).join(first, "run").where("doc > partner").select("doc", "partner", "held", "span")


def without_copies(
    df: DataFrame, config: LineConfig = LineConfig(), id_col: str = "doc_id", text_col: str = "text", report: str | None = None,
) -> DataFrame:
    """``df`` without the blocks that its documents share with earlier ones.

    ``report`` names a further column for the places cut, as ``start:end`` in code points of
    the old text, joined by commas; a second one, ``<report>_moved``, has those of them that
    stand in another order in the partner.
    """
    pairs = overlaps(df, config, id_col, text_col).groupBy("doc").agg(F.collect_list(F.struct("partner", "held", "span")).alias("pairs"))
    doc, shared = free_name(df, "doc__"), free_name(df, "pairs__")
    pairs = settle(pairs, "pairs").select(F.col("doc").alias(doc), F.col("pairs").alias(shared))
    joined = df.withColumn(doc, _order(id_col)).join(pairs.hint("shuffle_hash"), doc, "left").drop(doc)
    kinds = df.schema.fields + ([T.StructField(report, T.StringType()), T.StructField(f"{report}_moved", T.StringType())] if report else [])
    names = [f.name for f in kinds]
    place = df.columns.index(text_col)

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                column = part.column(len(part.columns) - 1)
                ends, flat = column.offsets.to_numpy(), [c.to_numpy() for c in column.values.flatten()]
                texts, places, moved = [], [], []
                own = part.column(place).to_pylist()
                found = units_of([t if t and ends[k + 1] > ends[k] else "" for k, t in enumerate(own)], config)
                for k, text in enumerate(own):
                    gone: list[tuple[int, int]] = []
                    odd: list[tuple[int, int]] = []
                    if text and ends[k + 1] > ends[k]:
                        text, gone, odd = cut(text, found[k], *(x[ends[k] : ends[k + 1]] for x in flat), config)
                    texts.append(text)
                    places.append(",".join(f"{s}:{e}" for s, e in gone))
                    moved.append(",".join(f"{s}:{e}" for s, e in odd))
                columns = list(part.columns[:-1])
                columns[place] = pa.array(texts, columns[place].type)
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(x, pa.string()) for x in (places, moved)] if report else []), names)

    return joined.mapInArrow(trim, T.StructType(kinds))
