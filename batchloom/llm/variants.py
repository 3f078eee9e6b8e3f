"""Spelling variants: words that differ by one code point, found through a positional q-gram index.

Words. Maximal runs of the letters A-Z, a-z and U+00C0 to U+00FF are lower-cased (A-Z only). Let h be the
crc32 of ``<doc_id>:<run>``; where 31 divides h the run loses its code point h % length. Words are the
distinct results of ``shortest`` code points or more that occur twice or more. Tasks count them
before the shuffle, ``held`` distinct ones at a time.

Index. A word of L letters has L - q + 1 positional q-grams. One edit leaves all but q of the longer word's,
and moves them by at most one place, so two near words share a gram among the q + 1 rarest of each
(ranked by how many grams of all words are that gram; 90^q grams at most, so that their ranks may be
broadcast). Each word stands in the posting lists of its q + 1 rarest grams, keyed by (length, place, gram);
it is looked up among words of its own length there, and among words one letter shorter at the same
place and the one before. A key is split by a hash where more than ``crowded`` words stand in its
list: each of those then is in one slice, and who looks up visits all slices.

Count filter. Lists of a task come sorted by key. Those who meet in a list are indexed by the grams they
have beside the key's. One edit leaves T = max(L) - 2q of those in common, so all but the T - 1 longest
postings of each word are merged (as sorted runs, ``block`` entries at a time); pairs found there that
have T in common in all are verified letter by letter. A pair counts in the list of its first common gram only.

Forms. A word's form is its near word of largest n (ties: smallest in code-point order), if that is
``lead`` times its own n or more. Roots are found by doubling steps over words that have forms; a chain of
forms is as long as n can grow by ``lead`` and has no rings.

Null texts and texts without a doc_id count as none; empty ones hold no word. Very long texts are read
whole, and so are very long words (lengths and places are compared modulo 2^21 in keys only, which lets
more words meet, not fewer). Repeated rows count each time. Without words the result is empty. Columns beside
doc_id and text are ignored, whatever they are called.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.llm.common import settle

LETTERS = 90  # a-z and U+00C0 to U+00FF
_BITS = 21


@dataclass(frozen=True)
class VariantConfig:
    shortest: int = 7
    least: int = 2
    lead: int = 10
    q: int = 3
    crowded: int = 4096
    block: int = 1 << 21
    held: int = 1 << 18

    def __post_init__(self) -> None:
        if not 1 <= self.q <= 3 or self.shortest < 2 * self.q + 1:
            raise ValueError("q is 1 to 3, and the shortest word has 2 q + 1 letters at least")


# --- words ----------------------------------------------------------------------------------------


def word_counts(docs: DataFrame, config: VariantConfig) -> DataFrame:
    """word, n. ``docs``: doc_id, text."""
    runs = re.compile(f"[a-zÀ-ÿ]{{{config.shortest},}}").findall  # greedy from a run's start: whole runs

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
            found.clear()
            return batch

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if doc is None or text is None:
                        continue
                    before = zlib.crc32(f"{doc}:".encode())
                    for run, n in Counter(runs(text.encode().lower().decode())).items():  # bytes: A-Z only
                        h = zlib.crc32(run.encode(), before)
                        if h % 31 == 0:
                            k = h % len(run)
                            run = run[:k] + run[k + 1 :]
                            if len(run) < config.shortest:
                                continue
                        found[run] += n
                if len(found) > config.held:
                    yield out()
        yield out()

    parts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(count, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= config.least)


# --- the index ------------------------------------------------------------------------------------

_CODE = np.zeros(256, np.int32)
_CODE[97:123] = np.arange(26)
_CODE[0xC0:0x100] = np.arange(26, LETTERS)


def letters(words: list[bytes], length: int) -> np.ndarray:
    """Words of one length (Latin-1 bytes) as rows of bytes."""
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), length)


def gram_codes(rows: np.ndarray, q: int) -> np.ndarray:
    """The grams of each row, by place."""
    codes = _CODE[rows]
    n = rows.shape[1] - q + 1
    own = codes[:, :n]
    for k in range(1, q):
        own = own * LETTERS + codes[:, k : k + n]
    return own


def _by_length(words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
    """Each length and the places of its words."""
    found: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        found.setdefault(len(w), []).append(k)
    yield from found.items()


def rarest(codes: np.ndarray, rank: np.ndarray, count: int) -> np.ndarray:
    """Places of the ``count`` rarest grams of each row, the rarest first, equal ones from the left."""
    return np.argsort(rank[codes], axis=1, kind="stable")[:, :count]


def key_of(length: int, place: np.ndarray, gram: np.ndarray) -> np.ndarray:
    mask = (1 << _BITS) - 1
    return np.int64(length & mask) << np.int64(42) | (place.astype(np.int64) & mask) << np.int64(21) | gram.astype(np.int64)


def gram_ranks(words: DataFrame, config: VariantConfig) -> np.ndarray:
    """A rank for each possible gram: the rarer the less; of equally rare ones by the gram's number."""
    size, q = LETTERS**config.q, config.q

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            own = [w.encode("latin-1") for w in b.column(0).to_pylist()]
            for length, at in _by_length(own):
                total += np.bincount(gram_codes(letters([own[k] for k in at], length), q).reshape(-1), minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["gram", "n"])

    got = words.select("word").mapInArrow(count, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(size, np.int64)
    n[got["gram"].to_numpy()] = got["n"].to_numpy()
    rank = np.empty(size, np.int32)
    rank[np.argsort(n, kind="stable")] = np.arange(size, dtype=np.int32)
    return rank


_STANDS, _ASKS, _SEEN = 0, 1, 2
_POSTING = "key bigint, asks tinyint, word binary, n bigint"


def _postings(words: DataFrame, rank, config: VariantConfig) -> DataFrame:
    """Rows of ``_POSTING``: each word in the lists of its rarest grams, and (``asks``) where it looks for shorter words."""
    q = config.q

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 1 << 14):
                part = b.slice(start, 1 << 14)
                own = [w.encode("latin-1") for w in part.column(0).to_pylist()]
                held, n = pa.array(own, pa.binary()), part.column(1)
                for length, at in _by_length(own):
                    codes = gram_codes(letters([own[k] for k in at], length), q)
                    place = rarest(codes, rank.value, q + 1)
                    gram = np.take_along_axis(codes, place, axis=1)
                    row = np.repeat(np.array(at)[:, None], q + 1, axis=1)
                    keys, rows, asks = [key_of(length, place, gram).reshape(-1)], [row.reshape(-1)], [np.zeros(row.size, np.int8)]
                    if length > config.shortest:
                        # A gram that stands at a place and at the next one asks the same list twice.
                        again = ((gram[:, :, None] == gram[:, None, :]) & (place[:, :, None] - 1 == place[:, None, :])).any(axis=2)
                        for moved, ok in ((place, place <= length - 1 - q), (place - 1, (place > 0) & ~again)):
                            keys.append(key_of(length - 1, moved[ok], gram[ok]))
                            rows.append(row[ok])
                            asks.append(np.ones(len(keys[-1]), np.int8))
                    take = pa.array(np.concatenate(rows))
                    columns = [pa.array(np.concatenate(keys)), pa.array(np.concatenate(asks)), held.take(take), n.take(take)]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "asks", "word", "n"])

    return words.select("word", "n").mapInArrow(spread, _POSTING)


def _sliced(postings: DataFrame, config: VariantConfig) -> DataFrame:
    """``slice`` and ``home`` for each row: the words of a crowded list stand in one slice each (there ``home``
    is set), and all rows of its key visit every slice."""
    crowd = postings.where(F.col("asks") == _STANDS).groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > config.crowded)
    crowd = settle(crowd.select("key", F.ceil(F.col("size") / config.crowded).cast("int").alias("slices")), "variant-crowded")
    if crowd.isEmpty():
        return postings.withColumns({"slice": F.lit(0), "home": F.col("asks") == _STANDS})
    rows = postings.join(crowd, "key", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("slices")).cast("int")
    rows = rows.withColumn("own", own).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    return rows.withColumn("home", (F.col("asks") == _STANDS) & (F.col("own") == F.col("slice"))).drop("own", "slices")


_PAIR = "word binary, n bigint, near binary, near_n bigint"


class _Lists:
    """Words of one length that meet in lists: ``owner`` tells the list of each row, ``place`` and ``gram`` its key."""

    def __init__(self, rows: np.ndarray, owner: np.ndarray, place: np.ndarray, gram: np.ndarray, at: np.ndarray, rank: np.ndarray, q: int):
        self.rows, self.owner, self.place, self.gram, self.at = rows, owner, place, gram, at
        self.codes = gram_codes(rows, q)
        self.first = rarest(self.codes, rank, q + 1)
        self.tokens = np.take_along_axis(self.codes, self.first, axis=1)

    def postings(self, shift: int) -> tuple[np.ndarray, np.ndarray]:
        """Posting keys (list, place less shift, gram) of all grams, rows x places, and which of them are the list's own."""
        mask = (1 << _BITS) - 1
        place = (np.arange(self.codes.shape[1]) - shift) & mask
        key = self.owner[:, None].astype(np.int64) << 42 | place << 21 | self.codes
        return key, (self.codes == self.gram[:, None]) & (place == self.place[:, None])


def _meet(asks: _Lists, held: _Lists, shifts: tuple[int, ...], need: int, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that may share ``need`` postings beside their list's, the asker's row the lesser if both are one.

    Of an asker's postings the need - 1 longest aren't merged: who shares ``need`` is in one of the others.
    """
    keys, own = held.postings(0)
    row = np.broadcast_to(np.arange(len(keys))[:, None], keys.shape)[~own]
    keys = keys[~own]
    order = np.argsort(keys, kind="stable")
    keys, row = keys[order], row[order]
    both = [asks.postings(s) for s in shifts]
    low = np.stack([np.searchsorted(keys, k) for k, _ in both], axis=2)
    high = np.stack([np.searchsorted(keys, k, side="right") for k, _ in both], axis=2)
    if asks is held:  # rows of one posting stand in order: each meets those behind it
        place = np.empty(len(keys), np.int64)
        place[order] = np.arange(len(keys))
        low[~own, 0] = place + 1
    n = np.where(np.stack([o for _, o in both], axis=2), 0, high - low)
    if need > 1:
        longest = np.argsort(-n.sum(axis=2), axis=1, kind="stable")[:, : need - 1]
        np.put_along_axis(n, longest[:, :, None], 0, axis=1)
    total = np.cumsum(n.sum(axis=(1, 2)))
    at = 0
    while at < len(total):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + block, side="right")))
        m = n[at:end].reshape(-1)
        ends = np.cumsum(m)
        if ends[-1]:
            found = row[np.repeat(low[at:end].reshape(-1) - (ends - m), m) + np.arange(ends[-1])]
            pair = np.repeat(np.arange(at, end), n[at:end].sum(axis=(1, 2))) * len(held.rows) + found
            pair.sort()
            pair = pair[np.append(True, pair[1:] != pair[:-1])]
            yield pair // len(held.rows), pair % len(held.rows)
        at = end


def _enough(x: _Lists, i: np.ndarray, y: _Lists, j: np.ndarray, need: int) -> np.ndarray:
    """The count filter: ``need`` grams in common beside the list's, at the same place (or, in a longer x, the next)."""
    a, b = x.codes[i], y.codes[j]
    same = a == b if a.shape == b.shape else (a[:, :-1] == b) | (a[:, 1:] == b)
    return same.sum(axis=1) > need


def _substituted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x != y).sum(axis=1) == 1


def _deleted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether x less one letter is y."""
    lead = np.cumprod(x[:, :-1] == y, axis=1).sum(axis=1)
    tail = np.cumprod((x[:, 1:] == y)[:, ::-1], axis=1).sum(axis=1)
    return lead + tail >= y.shape[1]


def _first_common(x: _Lists, i: np.ndarray, y: _Lists, j: np.ndarray, longer: bool) -> np.ndarray:
    """Whether the list they meet in is that of the first of y's rarest grams that is among x's too."""
    gap = x.first[i][:, :, None] - y.first[j][:, None, :]
    same = (x.tokens[i][:, :, None] == y.tokens[j][:, None, :]) & ((gap == 0) | (gap == 1) & longer)
    k = same.any(axis=1).argmax(axis=1)
    mask = (1 << _BITS) - 1
    return (y.tokens[j, k] == y.gram[j]) & ((y.first[j, k] & mask) == y.place[j])


def _near_pairs(key: np.ndarray, owner: np.ndarray, asks: np.ndarray, home: np.ndarray, words: list[bytes], rank: np.ndarray, config: VariantConfig):
    """(longer or later row, other row) of the near words that meet in some list, each pair once in all lists."""
    q, mask = config.q, (1 << _BITS) - 1
    place, gram = (key >> 21) & mask, key & mask
    sizes = np.array([len(w) for w in words])
    ordered = {w: k for k, w in enumerate(sorted(set(words)))}
    order = np.array([ordered[w] for w in words])

    def lists(at: np.ndarray) -> _Lists:
        return _Lists(letters([words[k] for k in at], int(sizes[at[0]])), owner[at], place[at], gram[at], at, rank, q)

    for length in np.unique(sizes[home]).tolist():
        held = lists(np.flatnonzero(home & (sizes == length)))
        same = np.flatnonzero((asks == _STANDS) & (sizes == length))
        if len(same):
            other = held if np.array_equal(same, held.at) else lists(same)
            for i, j in _meet(other, held, (0,), max(1, length - 2 * q), config.block):
                if other is not held:
                    less = order[other.at[i]] < order[held.at[j]]  # either visits where the other is at home
                    i, j = i[less], j[less]
                ok = _enough(other, i, held, j, length - 2 * q)
                i, j = i[ok], j[ok]
                ok = _substituted(other.rows[i], held.rows[j])
                i, j = i[ok], j[ok]
                ok = _first_common(other, i, held, j, False)
                yield other.at[i[ok]], held.at[j[ok]]
        longer = np.flatnonzero((asks == _ASKS) & (sizes == length + 1))
        if len(longer):
            other = lists(longer)
            for i, j in _meet(other, held, (0, 1), max(1, length + 1 - 2 * q), config.block):
                ok = _enough(other, i, held, j, length + 1 - 2 * q)
                i, j = i[ok], j[ok]
                ok = _deleted(other.rows[i], held.rows[j])
                i, j = i[ok], j[ok]
                ok = _first_common(other, i, held, j, True)
                yield other.at[i[ok]], held.at[j[ok]]


def near_pairs(words: DataFrame, config: VariantConfig) -> DataFrame:
    """word, n, near, near_n (words as Latin-1 bytes): both directions of each pair of near words."""
    rank = words.sparkSession.sparkContext.broadcast(gram_ranks(words, config))
    rows = _sliced(_postings(words, rank, config), config)
    dealt = rows.repartition("key", "slice").sortWithinPartitions("key", "slice", F.desc("home")).select("key", "slice", "asks", "home", "word", "n")

    def match(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        key, part = table["key"].to_numpy(), table["slice"].to_numpy()
        owner = np.cumsum(np.append(False, (key[1:] != key[:-1]) | (part[1:] != part[:-1])))
        words_ = table["word"].to_pylist()
        n = table["n"].to_numpy()
        asks, home = table["asks"].to_numpy(), table["home"].to_numpy()
        # A list of one row has no pairs.
        some = np.bincount(owner)[owner] > 1
        at = np.flatnonzero(some)
        if not len(at):
            return
        for i, j in _near_pairs(key[at], owner[at], asks[at], home[at], [words_[k] for k in at], rank.value, config):
            i, j = at[i], at[j]
            a, b = pa.array([words_[k] for k in i], pa.binary()), pa.array([words_[k] for k in j], pa.binary())
            yield pa.RecordBatch.from_arrays([a, pa.array(n[i]), b, pa.array(n[j])], ["word", "n", "near", "near_n"])
            yield pa.RecordBatch.from_arrays([b, pa.array(n[j]), a, pa.array(n[i])], ["word", "n", "near", "near_n"])

    def weight(b: pa.RecordBatch) -> int:
        """Rows, more of them for long words."""
        return b.num_rows + sum(len(w) >> 5 for w in b.column(4).to_pylist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole lists, 2^16 rows at a time; of a longer list those at home, who come first, wait for all visitors."""
        held: list[pa.RecordBatch] = []
        size = 0
        for whole in batches:
            for at in range(0, whole.num_rows, 1 << 14):
                b = whole.slice(at, 1 << 14)
                held.append(b)
                size += weight(b)
                if size < 1 << 16:
                    continue
                key, part = b.column(0).to_numpy(), b.column(1).to_numpy()
                new = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1]))
                if len(new):
                    cut = int(new[-1]) + 1
                    yield from match([*held[:-1], b.slice(0, cut)])
                    held = [b.slice(cut)]
                else:
                    yield from match(held)
                    held = waiting(held)
                size = sum(map(weight, held))
                if size >= 1 << 15:
                    size = 0  # many at home: as many visitors more before the next step
        if held:
            yield from match(held)

    def waiting(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        """Of the last list those at home, who have asked already; and nothing of earlier lists."""
        rows = pa.Table.from_batches(held)
        key, part = rows["key"].to_numpy(), rows["slice"].to_numpy()
        rows = rows.filter(pa.array((key == key[-1]) & (part == part[-1]) & rows["home"].to_numpy()))
        rows = rows.set_column(2, "asks", pa.array(np.full(rows.num_rows, _SEEN, np.int8)))
        return rows.combine_chunks().to_batches()

    return dealt.mapInArrow(run, _PAIR)


# --- forms and roots ------------------------------------------------------------------------------


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of the words that have a form: each step follows the whole way found so far."""
    ways = settle(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ways = settle(ways.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variant-roots")
        if ways.where("moved").isEmpty():
            return ways.select("word", "root")
        ways = ways.select("word", "root")


def variants(docs: DataFrame, config: VariantConfig = VariantConfig()) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words."""
    words = settle(word_counts(docs, config), "variant-words")
    text = lambda c: F.decode(F.col(c), "ISO-8859-1")
    pairs = near_pairs(words, config)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))  # bytes of Latin-1 are in code-point order
    near = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best")).select(
        text("word").alias("word"), "n_near", text("best.near").alias("near"), (-F.col("best.less")).alias("near_n"),
    )
    named = F.col("near_n") >= config.lead * F.col("n")
    rows = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(named, F.col("near")).alias("form"), F.when(named, F.col("near_n")).alias("form_n"),
    )
    rows = settle(rows, "variant-forms")
    roots = _roots(rows.where("form is not null"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
