"""Exact token counts of every prefix of a text, by dynamic programming over its words.

A byte-level BPE text is split into words and merged inside them. The count of a prefix is
the count of the words before its last one, plus that of the last, which may be cut: the
trellis gives it for each prefix of each distinct word at once. Four kinds of prefixes are
split otherwise than the whole text, and corrected: a cut contraction, a cut special string,
and a run of white space cut from the word that takes its last blank.

Answers about truncation and budgets then need no further encoding: ``count(k)`` for a cut
after k code points, ``fit(limit)`` for the longest prefix within a limit.

Null texts count as empty (no tokens). Repeated rows give repeated rows; an empty table
none. Very long texts and words are counted whole; nothing here can tie. Columns other than the id and the text are dropped, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.llm.bpe import SPECIAL, words_of
from batchloom.llm.trellis import Trellis, batches

_CUT_CONTRACTIONS = ("'re", "'ve", "'ll")  # after two letters: an apostrophe and a letter, two tokens


def byte_spelling() -> dict[str, int]:
    """The byte for each character in the vocabulary's spelling: printable ones stand for
    themselves, the others for characters from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class MergeRules:
    """Which pieces may stand beside each other, from a list of merges by rank."""

    def __init__(self, merges: list[tuple[int, int, int]], n_ids: int):
        a, b, c = (np.array(x, np.int64) for x in zip(*merges))
        self.n = n_ids
        self.rank = np.full(n_ids, -1, np.int64)
        self.left = np.arange(n_ids)
        self.right = np.arange(n_ids)
        r = np.arange(len(a))
        for order in (r[::-1],):  # of two merges into one piece, the first counts
            self.rank[c[order]], self.left[c[order]], self.right[c[order]] = r[order], a[order], b[order]
        pairs = a * n_ids + b
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.pair_rank = pairs[order], r[order]

    def agrees(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Undo the merges on both sides, the latest first; a merge across that came before the
        one undone would have been made."""
        x, y = a.copy(), b.copy()
        limit = np.full(len(x), np.iinfo(np.int64).max)
        good = np.ones(len(x), bool)
        live = np.arange(len(x))
        while len(live):
            p = x[live] * self.n + y[live]
            k = np.minimum(np.searchsorted(self.pairs, p), len(self.pairs) - 1)
            crossed = (self.pairs[k] == p) & (self.pair_rank[k] < limit[live])
            good[live[crossed]] = False
            live = live[~crossed]
            rx, ry = self.rank[x[live]], self.rank[y[live]]
            more = (rx >= 0) | (ry >= 0)
            live, rx, ry = live[more], rx[more], ry[more]
            undo_x = rx > ry
            i, j = live[undo_x], live[~undo_x]
            limit[i], x[i] = rx[undo_x], self.right[x[i]]
            limit[j], y[j] = ry[~undo_x] + 1, self.left[y[j]]  # at equal ranks the left one goes first
        return good


class PrefixCounter:
    """Counts for one vocabulary file. At most ``max_words`` words are remembered."""

    def __init__(self, path: str, max_words: int = 500_000):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        spelling, vocab = byte_spelling(), model["vocab"]
        n = max(vocab.values()) + 1
        tokens = {t: k for t, k in vocab.items() if all(c in spelling for c in t)}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        rules = MergeRules([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], n)
        reachable = {a + b for a, b in merges} | {t for t in tokens if len(t) == 1}
        pieces = [t for t in tokens if t in reachable]
        self.trellis = Trellis(
            [np.array([spelling[c] for c in t], np.uint32) for t in pieces], np.array([tokens[t] for t in pieces]), rules.agrees,
        )
        self.max_words = max_words
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.pool = np.zeros(1 << 16, np.int32)  # counts after 1, 2, ... code points of each word
        self.starts = np.zeros(1 << 14, np.int64)
        self.used = 0
        self.blank = np.zeros(1 << 14, bool)  # words of white space only
        self.opens_blank = np.zeros(1 << 14, bool)  # words that begin with white space

    def _room(self, words: int, counts: int) -> None:
        while len(self.index) + words + 1 > len(self.starts):
            for name in ("starts", "blank", "opens_blank"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros_like(old)]))
        while self.used + counts > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])

    def learn(self, words: list[str]) -> None:
        raw = [np.frombuffer(w.encode("utf-8", "surrogatepass"), np.uint8) for w in words]
        for places, matrix, sizes in batches(raw):
            count = self.trellis.solve(matrix)[0][:, 1:]
            self._store([words[k] for k in places], matrix, sizes, count)

    def _store(self, words: list[str], matrix: np.ndarray, lengths: np.ndarray, count: np.ndarray) -> None:
        """Remember the counts at the ends of code points."""
        ends = np.ones(matrix.shape, bool)
        ends[:, :-1] = (matrix[:, 1:] & 0xC0) != 0x80
        ends[np.arange(len(words)), lengths - 1] = True
        ends &= np.arange(matrix.shape[1]) < lengths[:, None]
        sizes = ends.sum(axis=1)
        flat = count[ends]
        first = len(self.index)
        self._room(len(words), len(flat))
        stops = self.used + np.cumsum(sizes)
        self.starts[first + 1 : first + 1 + len(words)] = stops
        self.pool[self.used : self.used + len(flat)] = flat
        for k, w in enumerate(words):
            if w == SPECIAL:
                self.pool[stops[k] - sizes[k] : stops[k]] = 1
            elif w in _CUT_CONTRACTIONS:
                self.pool[stops[k] - 2] = 2
        self.blank[first : first + len(words)] = [w.isspace() for w in words]
        self.opens_blank[first : first + len(words)] = [w[0].isspace() for w in words]
        self.used += len(flat)
        self.index.update(zip(words, range(first, first + len(words))))

    def prepare(self, texts: list[str]) -> list[list[str]]:
        """Split texts and learn their new words together."""
        split = [words_of(t) for t in texts]
        new = {w for words in split for w in words if w not in self.index}
        if new:
            if len(self.index) + len(new) > self.max_words:
                self._clear()
                new = {w for words in split for w in words}
            self.learn(list(new))
        return split

    def _total(self, word: str) -> int:
        if word not in self.index:
            self.learn([word])
        return int(self.pool[self.starts[self.index[word] + 1] - 1])

    def prefixes(self, words: list[str]) -> np.ndarray:
        """Token counts after 0, 1, 2, ... code points of the text that the (learnt) words make up."""
        if not words:
            return np.zeros(1, np.int32)
        k = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        starts = self.starts[k]
        sizes = self.starts[k + 1] - starts
        totals = self.pool[self.starts[k + 1] - 1]
        ends = np.cumsum(sizes)
        before = np.cumsum(totals) - totals
        shift = np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1])
        out = np.empty(ends[-1] + 1, np.int32)
        out[0] = 0
        out[1:] = self.pool[shift] + np.repeat(before, sizes)
        # Cut after a whole run of white space, whose last blank belongs to the next word.
        for j in np.flatnonzero(self.blank[k[:-1]] & self.opens_blank[k[1:]]).tolist():
            out[ends[j] + 1] = before[j] + self._total(words[j] + words[j + 1][0])
        if SPECIAL in words:
            self._cut_specials(words, ends, before, out)
        return out

    def _cut_specials(self, words: list[str], ends: np.ndarray, before: np.ndarray, out: np.ndarray) -> None:
        """Inside a special string the text so far is ordinary and joins the words before it."""
        first = 0
        for j, w in enumerate(words):
            if w == SPECIAL:
                head = "".join(words[first:j])
                base = int(before[first])
                for size in range(1, len(SPECIAL)):
                    out[ends[j] - len(SPECIAL) + size] = base + sum(map(self._total, words_of(head + SPECIAL[:size])))
                first = j + 1


class PrefixCounts:
    """The stored counts of one text."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts

    def count(self, k: int) -> int:
        return int(self.counts[k])

    def fit(self, limit: int) -> int:
        """Code points of the longest prefix with at most ``limit`` tokens."""
        return int(np.flatnonzero(self.counts <= limit)[-1])

    def to_bytes(self) -> bytes:
        """Steps from prefix to prefix; nearly all are 0 or 1, so a column of them packs well."""
        return np.diff(self.counts).astype("<i2").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> PrefixCounts:
        return cls(np.concatenate([[0], np.cumsum(np.frombuffer(raw, "<i2"), dtype=np.int64)]))


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def token_counts(
    df: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", store: bool = False,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fit_chars (longest prefix within the limit) and, with
    ``store``, ``prefix_counts`` for ``PrefixCounts.from_bytes``."""
    narrow = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean, fit_chars bigint"
    schema += ", prefix_counts binary" * store
    names = [x.split()[0] for x in schema.split(", ")]

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer)
        for b in found:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                texts = part.column(1).to_pylist()
                sizes, totals, fits, stored = [], [], [], []
                for text, words in zip(texts, own.prepare(texts)):
                    one = PrefixCounts(own.prefixes(words))
                    sizes.append(len(text.encode("utf-8", "surrogatepass")))
                    totals.append(int(one.counts[-1]))
                    fits.append(one.fit(limit))
                    if store:
                        stored.append(one.to_bytes())
                columns = [
                    part.column(0), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()),
                    pa.array([n > limit for n in totals], pa.bool_()), pa.array(fits, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(stored, pa.binary())] * store, names)

    return narrow.mapInArrow(run, schema)
