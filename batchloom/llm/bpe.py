"""Byte-level BPE ids of whole texts: the tokenizers library behind a cache of words.

The tokenizer splits a text at its special strings, then into words by a fixed pattern,
and merges inside a word only. So the ids of a text are those of its words in order, and
each distinct word needs the library once.

Texts of the first 256 code points are split and looked up as bytes, many texts at once: a word of
at most 16 bytes is its two halves as numbers, which a hash table of numpy arrays compares whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import regex

SPECIAL = "<|endoftext|>"
# The word pattern of the tokenizer's byte-level splitter (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ANY = regex.compile(PATTERN).findall
# The same with the classes of the first 256 code points spelt out, for the standard module.
_LETTER, _NUMBER, _SPACE = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_LATIN = re.compile(
    f"'(?:[sdmt]|re|ve|ll)| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
).findall
# Beyond them, or with separators that some tables class as space, the full tables decide.
_OTHER = re.compile("[^\x00-\x1b\x20-\xff]").search
# Texts that go the way of bytes: as above, without control characters, of which one parts the texts.
_NOT_BYTES = re.compile("[^\t-\r\x20-\xff]").search
_EDGE = "\x1c"
_KINDS = np.full(256, 4, np.uint8)  # 0: edge, 1: letter, 2: number, 3: space, 4: other
for _kind, _class in (1, _LETTER), (2, _NUMBER), (3, _SPACE), (0, _EDGE):
    _KINDS[[k for k in range(256) if re.match(f"[{_class}]", chr(k))]] = _kind
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_PLAIN = re.compile(f" [{_LETTER}]+").fullmatch


def cut_words(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The texts as bytes, their words' starts and lengths there, and the number of words of each text.

    The pattern over classes: a word starts where the class changes; a last blank before something else
    goes with it, other last white space stands alone; an apostrophe that no sign or blank precedes
    takes s, t, d, m, re, ve or ll.
    """
    raw = f"{_EDGE}{_EDGE.join(texts)}{_EDGE * 17}".encode("latin-1")  # so that 16 bytes of any word can be read
    data = np.frombuffer(raw, np.uint8)
    kind = _KINDS[data]
    start = kind == 0
    start[1:] |= kind[1:] != kind[:-1]
    after = np.flatnonzero((kind[:-1] == 3) & (kind[1:] != 3) & (kind[1:] != 0))  # last white space
    start[after] = True
    start[after[data[after] == 32] + 1] = False
    marks = np.flatnonzero((data[:-16] == 39) & start[:-16])
    if len(marks):
        one, two = data[marks + 1], data[marks + 2]
        short = np.isin(one, np.frombuffer(b"sdmt", np.uint8))
        long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
        start[marks[short | long] + 1] = False
        start[marks[short] + 2] = True
        start[marks[long] + 3] = True
    at = np.flatnonzero(start)
    edges = np.flatnonzero(kind[at] == 0)[: len(texts) + 1]
    at = at[: edges[-1] + 1]
    words = np.ones(len(at), bool)
    words[edges] = False
    return raw, at[words], np.diff(at, append=len(raw))[words], np.diff(edges) - 1


def words_of(text: str) -> list[str]:
    """The words of a text; a special string is a word of its own."""
    if SPECIAL in text:
        out: list[str] = []
        for k, part in enumerate(text.split(SPECIAL)):
            if k:
                out.append(SPECIAL)
            out += words_of(part)
        return out
    return _ANY(text) if _OTHER(text) else _LATIN(text)


class WordEncoder:
    """Ids of texts. At most ``max_words`` words are remembered; then it starts anew."""

    def __init__(self, path: str, max_words: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.max_words = max_words
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.pool = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)  # of each word in the pool, and the end of the last
        self.used = self.known = 0

    def split(self, text: str) -> list[str]:
        return words_of(text)

    def ids_of(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The words in an order of its own, their ids in a row, and the number of ids of each."""
        found = [e.ids for e in self.library.encode_batch_fast(words, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return words, np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths

    def _learn(self, words: list[str]) -> tuple[list[str], range]:
        """The words in an order of its own, and their numbers."""
        words, flat, lengths = self.ids_of(words)
        first = self.known
        while first + len(words) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        self.starts[first + 1 : first + 1 + len(words)] = self.used + np.cumsum(lengths)
        self.used += len(flat)
        self.known += len(words)
        return words, range(first, self.known)

    def numbers(self, words: list[str], new: set[str]) -> np.ndarray:
        """The number of each word; the new ones are learnt."""
        if new:
            self.index.update(zip(*self._learn(list(new))))
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def _room(self, new: int) -> bool:
        """Whether so many words more may be remembered; if not, all are forgotten. One call's words always are."""
        if not self.known or self.known + new <= self.max_words:
            return True
        self._clear()
        return False

    def ids_at(self, k: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words by their numbers, and the places where texts of so many words start and the last ends."""
        starts = self.starts[k]
        lengths = self.starts[k + 1] - starts
        stops = np.cumsum(lengths)
        ids = self.pool[np.repeat(starts - (stops - lengths), lengths) + np.arange(stops[-1] if len(k) else 0)]
        ends = np.zeros(len(counts) + 1, np.int64)
        ends[1:] = np.concatenate([[0], stops])[np.cumsum(counts)]
        return ids, ends

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and the place where each text starts and the last ends."""
        split = [self.split(t) for t in texts]
        words = list(chain.from_iterable(split))
        index = self.index
        new = {w for w in words if w not in index}
        if not self._room(len(new)):
            new = set(words)
        return self.ids_at(self.numbers(words, new), np.array([len(x) for x in split], np.int64))


class ByteEncoder(WordEncoder):
    """The same for the byte-level tokenizer: texts of the first 256 code points go as bytes."""

    def __init__(self, path: str, max_words: int = 1_000_000):
        super().__init__(path, max_words)
        vocabulary = self.library.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that begin with a blank
        self.opens[[k for token, k in vocabulary.items() if token[0] == "\u0120"]] = True

    def _clear(self) -> None:
        super()._clear()
        self.keys = np.zeros((1 << 14, 2), np.uint64)  # 16 bytes of a word; its first half is never 0
        self.values = np.zeros(1 << 14, np.int32)
        self.held = 0

    def ids_of(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        # Words of a blank and letters are split again where they were joined, and their first tokens alone begin with a blank.
        plain, rest = [], []
        for w in words:
            (plain if _PLAIN(w) else rest).append(w)
        _, ids, lengths = super().ids_of(rest)
        joined = ["".join(plain[k : k + 100]) for k in range(0, len(plain), 100)]
        found = [e.ids for e in self.library.encode_batch_fast(joined, add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(found), np.uint32, sum(map(len, found)))
        own = np.diff(np.flatnonzero(self.opens[flat]), append=len(flat))
        return plain + rest, np.concatenate([flat, ids]), np.concatenate([own, lengths])

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = (keys[:, 0] ^ keys[:, 1] * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
        mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        return (mixed >> np.uint64(64 - (len(self.keys) - 1).bit_length())).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where it is new."""
        slots = self._slots(keys)
        there = self.keys[slots]
        same = (there[:, 0] == keys[:, 0]) & (there[:, 1] == keys[:, 1])
        out = np.where(same, self.values[slots], np.int32(-1))
        left = np.flatnonzero(~same & (there[:, 0] != 0))
        while len(left):
            slots[left] = slots[left] + 1 & len(self.keys) - 1
            there = self.keys[slots[left]]
            same = (there == keys[left]).all(axis=1)
            out[left[same]] = self.values[slots[left[same]]]
            left = left[~same & (there[:, 0] != 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct new keys and their numbers."""
        if 2 * (self.held + len(keys)) > len(self.keys):
            old = self.keys[:, 0] != 0
            keys, values = np.concatenate([self.keys[old], keys]), np.concatenate([self.values[old], values])
            size = 1 << (4 * len(keys) - 1).bit_length()
            self.keys, self.values, self.held = np.zeros((size, 2), np.uint64), np.zeros(size, np.int32), 0
        self.held += len(keys)
        slots = self._slots(keys)
        while len(keys):
            free = self.keys[slots, 0] == 0
            self.keys[slots[free]] = keys[free]
            set_ = free & (self.keys[slots] == keys).all(axis=1)
            self.values[slots[set_]] = values[set_]
            keys, values, slots = keys[~set_], values[~set_], slots[~set_] + 1 & len(self.keys) - 1

    def _byte_numbers(self, raw: bytes, at: np.ndarray, size: np.ndarray) -> np.ndarray | None:
        """The number of each word; None if there was no room for the new ones, and all were forgotten."""
        view = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))  # the 8 bytes from each place on
        keys = np.empty((len(at), 2), np.uint64)
        keys[:, 0] = view[at] & _MASKS[np.minimum(size, 8)]
        keys[:, 1] = view[at + 8] & _MASKS[np.clip(size - 8, 0, 8)]
        out = self.find(keys)
        long = np.flatnonzero(size > 16)
        texts = [raw[s : s + n].decode("latin-1") for s, n in zip(at[long].tolist(), size[long].tolist())]
        out[long] = 0
        new = np.flatnonzero(out < 0)
        names = [raw[s : s + n].decode("latin-1") for s, n in zip(at[new].tolist(), size[new].tolist())]
        places = dict(zip(names, new.tolist()))  # of each name one
        unknown = {w for w in texts if w not in self.index}
        if not self._room(len(places) + len(unknown)):
            return None
        if places:
            words, own = self._learn(list(places))
            self.put(keys[[places[w] for w in words]], np.arange(own.start, own.stop, dtype=np.int32))
            out[new] = self.find(keys[new])
        out[long] = self.numbers(texts, unknown)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if any(SPECIAL in t or _NOT_BYTES(t) for t in texts):
            odd = [SPECIAL in t or _NOT_BYTES(t) is not None for t in texts]
            parts = [super(ByteEncoder, self).encode(own) if k else self.encode(own) for k, own in _groups(texts, odd)]
            places = np.cumsum([0, *(len(ids) for ids, _ in parts)])
            return np.concatenate([ids for ids, _ in parts]), np.concatenate([[0], *(ends[1:] + s for s, (_, ends) in zip(places, parts))])
        raw, at, size, counts = cut_words(texts)
        k = self._byte_numbers(raw, at, size)
        return self.ids_at(self._byte_numbers(raw, at, size) if k is None else k, counts)


def _groups(texts: list[str], odd: list[bool]) -> Iterator[tuple[bool, list[str]]]:
    """Neighbours of one kind together."""
    for k, pairs in groupby(zip(odd, texts), key=itemgetter(0)):
        yield k, [t for _, t in pairs]


_ENCODERS: dict[tuple[str, int], ByteEncoder] = {}


def encoder(path: str, max_words: int = 1_000_000) -> ByteEncoder:
    """One encoder for each file, size and worker process."""
    if (path, max_words) not in _ENCODERS:
        _ENCODERS[path, max_words] = ByteEncoder(path, max_words)
    return _ENCODERS[path, max_words]
