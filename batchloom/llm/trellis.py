"""Viterbi over prefixes of words, all words of one length together.

At each end position substring hashes probe the sorted keys of all pieces, and a hit is
verified by comparing the symbols. The value of a transition is the best value of the prefix
before it plus the piece's score; a vectorised maximum keeps the best one and its backpointer, and
of equal ones the one with the longest piece.

With scores that is the path of the greatest sum (a Unigram vocabulary). For merge-based (BPE)
vocabularies scores are 0, and a transition counts minus infinity unless its piece agrees with
the last one of the prefix: the merges of a word end in one sequence of pieces, and a sequence is
that one if and only if each two neighbours in it are what their own joined text ends in: no
merge ever crosses the border between them, and what happens on one side doesn't depend on
the other. So for each prefix exactly one piece can come last, and a prefix is done
when it has a value.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(4096, _BASE, np.uint64), dtype=np.uint64)
_POWERS = np.concatenate([np.ones(1, np.uint64), _POWERS])
_FILTER_BITS = 22


def _mix(x: np.ndarray) -> np.ndarray:
    """A random-looking 64-bit number for each symbol."""
    z = (x.astype(np.uint64) + np.uint64(1)) * _BASE
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _hash_one(symbols: np.ndarray) -> int:
    h = 0
    for m in _mix(symbols).tolist():
        h = (h * int(_BASE) + m) & 0xFFFFFFFFFFFFFFFF
    return h


_FEW = 64  # words of a batch that are solved by end positions alone
_PAD = 0xFFFFFFFF  # behind the end of a word in a batch of longer ones


class Trellis:
    """``pieces``: the symbols of each piece, ``ids``: its id; ``agrees(a, b)`` tells for arrays
    of ids which may stand beside each other (merges), or ``scores`` gives each piece's (sums).
    ``unknown(symbols)`` gives ids for symbols that are no piece (they agree with everything and
    score ``unknown_score``), or is None where each symbol is one."""

    def __init__(
        self, pieces: list[np.ndarray], ids: np.ndarray, agrees: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
        unknown: Callable[[np.ndarray], np.ndarray] | None = None, scores: np.ndarray | None = None, unknown_score: float = 0.0,
    ):
        keys = np.array([_hash_one(p) for p in pieces], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.asarray(ids, np.int64)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one key")
        self.longest = max(map(len, pieces))
        self.sizes = np.array([len(p) for p in pieces])[order]
        self.symbols = np.full((len(pieces), self.longest), _PAD, np.uint32)
        for row, k in enumerate(order.tolist()):
            self.symbols[row, : len(pieces[k])] = pieces[k]
        self.scores = None if scores is None else np.asarray(scores, np.float32)[order]
        self.unknown_score = np.float32(unknown_score)
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[keys >> np.uint64(64 - _FILTER_BITS)] = True
        self.agrees, self.unknown = agrees, unknown

    def _probe(self, h: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the parts (a row of symbols each, with hash h) are pieces, and their places among the keys."""
        at = np.flatnonzero(self.maybe[h >> np.uint64(64 - _FILTER_BITS)])
        k = np.searchsorted(self.keys, h[at])
        k[k == len(self.keys)] = 0
        hit = self.keys[k] == h[at]
        at, k = at[hit], k[hit]
        size = parts.shape[1]
        same = (self.sizes[k] == size) & (self.symbols[k, :size] == parts[at]).all(axis=1)
        return (at, k) if same.all() else (at[same], k[same])

    def solve(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For words of one length (n x L symbols): after each prefix, from 0 to L symbols, the count
        of pieces, the last piece's id, and the place where it starts."""
        n, size = words.shape
        prefix = np.zeros((size + 1, n), np.uint64)
        mixed = _mix(words)
        for j in range(size):
            prefix[j + 1] = prefix[j] * _BASE + mixed[:, j]
        count = np.zeros((size + 1, n), np.int32)
        last = np.full((size + 1, n), -1, np.int64)
        back = np.zeros((size + 1, n), np.int32)
        best = np.full((size + 1, n), -np.inf, np.float32)
        best[0] = 0
        if n <= _FEW:
            for j in range(1, size + 1):
                self._step(j, words, prefix, count, last, back, best)
            return count.T, last.T, back.T
        for j in range(1, size + 1):
            for i in range(max(0, j - self.longest), j):
                at, k = self._probe(prefix[j] - prefix[i] * _POWERS[j - i], words[:, i:j])
                ids = self.ids[k]
                gain = np.zeros(len(at), np.float32) if self.scores is None else self.scores[k]
                if self.unknown is not None and i == j - 1:
                    odd = np.ones(n, bool)
                    odd[at] = False
                    odd = np.flatnonzero(odd)
                    at, ids = np.concatenate([at, odd]), np.concatenate([ids, self.unknown(words[odd, i])])
                    gain = np.concatenate([gain, np.full(len(odd), self.unknown_score)])
                value = best[i, at] + gain
                better = value > best[j, at]
                if self.agrees is not None and i and better.any():
                    k = np.flatnonzero(better)
                    better[k] = self.agrees(last[i, at[k]], ids[k])
                at, ids = at[better], ids[better]
                best[j, at] = value[better]
                count[j, at] = count[i, at] + 1
                last[j, at], back[j, at] = ids, i
                if self.scores is None and (best[j] == 0).all():
                    break
        return count.T, last.T, back.T

    def _step(
        self, j: int, words: np.ndarray, prefix: np.ndarray, count: np.ndarray, last: np.ndarray, back: np.ndarray, best: np.ndarray,
    ) -> None:
        """End position j of few words: all starts of the last piece at once."""
        low, n = max(0, j - self.longest), len(words)
        sizes = np.arange(j - low, 0, -1)
        h = (prefix[j] - prefix[low:j] * _POWERS[sizes][:, None]).ravel()
        cell = np.flatnonzero(self.maybe[h >> np.uint64(64 - _FILTER_BITS)])
        k = np.minimum(np.searchsorted(self.keys, h[cell]), len(self.keys) - 1)
        hit = self.keys[k] == h[cell]
        cell, k = cell[hit], k[hit]
        start, at = low + cell // n, cell % n
        inside = np.arange(min(j, self.longest))
        places = np.minimum(start[:, None] + inside, j - 1)
        same = (self.sizes[k] == j - start) & ((words[at[:, None], places] == self.symbols[k, : len(inside)]) | (places - start[:, None] < inside)).all(axis=1)
        if not same.all():
            start, at, k = start[same], at[same], k[same]
        ids = self.ids[k]
        gain = np.zeros(len(at), np.float32) if self.scores is None else self.scores[k]
        if self.unknown is not None:
            odd = np.ones(n, bool)
            odd[at[start == j - 1]] = False
            odd = np.flatnonzero(odd)
            start, at = np.concatenate([start, np.full(len(odd), j - 1)]), np.concatenate([at, odd])
            ids, gain = np.concatenate([ids, self.unknown(words[odd, j - 1])]), np.concatenate([gain, np.full(len(odd), self.unknown_score)])
        value = best[start, at] + gain
        if self.agrees is not None:
            good = start == 0
            ask = np.flatnonzero(~good)
            good[ask] = self.agrees(last[start[ask], at[ask]], ids[ask])
            start, at, ids, value = start[good][::-1], at[good][::-1], ids[good][::-1], value[good][::-1]  # one a word
        else:
            order = np.lexsort((-start, value, at))  # the last one of a word is written last: the greatest, of the least start
            start, at, ids, value = start[order], at[order], ids[order], value[order]
        best[j, at], last[j, at], back[j, at], count[j, at] = value, ids, start, count[start, at] + 1


def batches(words: list[np.ndarray], most: int = 1_000_000) -> list[tuple[list[int], np.ndarray, np.ndarray]]:
    """Words of like length together: places in the list, a matrix, and their lengths.

    Up to 48 symbols a length has a batch of its own; longer ones are padded to the next eighth of a
    power of two, as nothing before a word's end depends on what follows. A batch has ``most`` symbols.
    """
    by: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        n = len(w)
        step = max(1, (1 << n.bit_length()) >> 4) if n > 48 else 1
        by.setdefault(-(-n // step) * step, []).append(k)
    out = []
    for size, places in by.items():
        step = max(1, most // max(size, 1))
        for at in range(0, len(places), step):
            part = places[at : at + step]
            matrix = np.full((len(part), size), _PAD, np.uint32)
            for row, k in enumerate(part):
                matrix[row, : len(words[k])] = words[k]
            out.append((part, matrix, np.array([len(words[k]) for k in part])))
    return out
