"""SentencePiece encoding and decoding by a batched Viterbi over words, in numpy.

A text gets a blank in front, blanks become the mark U+2581, and it is split where no piece
goes on: before runs of marks, and (where the pieces allow it) around line feeds and between a
letter and what is none. Distinct words of like length advance together: at each end
position substring hashes probe the sorted keys of the pieces, and vectorised maxima store
the best transition into each prefix as a backpointer (see ``trellis``).

Unigram models take the path of the greatest sum of scores, in single precision as in the
library, an unknown character ten below the least score; sums run over a word, not the text, so
that paths whose sums differ by rounding only may be told apart otherwise. Merge models (BPE) don't: there a
transition from piece a to piece b counts 0 if merging their joined text ends in just a and b, and
minus infinity if not; then one path is left, and it is the merge order's own. Which pairs agree
is worked out once a pair and worker, by merging the joined text.

Characters that are no piece become bytes. Decoding gathers the bytes of all pieces at once.

Null texts count as empty (no ids). Byte runs that are no UTF-8 decode to U+FFFD, and the
mark U+2581 itself to a blank, so such texts are the ones that don't round-trip. Of paths of
equal score the one with the longest last piece counts. Very long words are solved as others. An
empty table gives no rows, repeated rows repeated ones; extra columns are dropped.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.llm.bpe import WordEncoder
from batchloom.llm.trellis import Trellis, batches

MARK = "▁"


class PieceEncoder(WordEncoder):
    def __init__(self, path: str, max_words: int = 1_000_000):
        from sentencepiece import sentencepiece_model_pb2 as model_pb2

        model = model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        normal = model.normalizer_spec
        merges, sums = (model.trainer_spec.model_type == k for k in (model.trainer_spec.BPE, model.trainer_spec.UNIGRAM))
        if not (merges or sums) or not model.trainer_spec.byte_fallback:
            raise ValueError("only Unigram and merge models with byte fallback are supported")
        if normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.add_dummy_prefix or not normal.escape_whitespaces:
            raise ValueError("only the identity normalisation with a blank in front is supported")
        if any(p.type == p.USER_DEFINED for p in model.pieces):
            raise ValueError("user-defined pieces are not supported")
        plain = [(k, p) for k, p in enumerate(model.pieces) if p.type == p.NORMAL]
        if any(MARK in p.piece.lstrip(MARK) for _, p in plain):
            raise ValueError("pieces that go on across blanks are not supported")
        self.score = {p.piece: p.score for _, p in plain}
        self.pieces = [p.piece for p in model.pieces]
        self.byte_ids = np.array(
            [k for _, k in sorted((int(p.piece[3:5], 16), k) for k, p in enumerate(model.pieces) if p.type == p.BYTE)], np.int64,
        )
        # Whether pairs agree: sorted arrays, and the latest ones.
        self.pairs, self.values = np.full(1, -1, np.int64), np.zeros(1, bool)
        self.recent: dict[int, bool] = {}
        self.n = len(self.pieces)
        known = [(k, p) for k, p in plain if sums or self._merge(p.piece) == [p.piece]]
        symbols, ids = [_symbols(p.piece) for _, p in known], np.array([k for k, _ in known])
        unknown = lambda s: s.astype(np.int64) + self.n
        if merges:
            self.trellis = Trellis(symbols, ids, self._agree, unknown)
        else:
            scores = np.array([p.score for _, p in known], np.float32)
            self.trellis = Trellis(symbols, ids, None, unknown, scores, float(scores.min()) - 10.0)
        inside = {(x, y) for _, p in plain for x, y in zip(p.piece, p.piece[1:])}  # neighbours within pieces
        letter = re.compile(r"[^\W\d_]").match
        # Characters that a piece has before one that is no letter aren't letters here.
        odd = re.escape("".join(sorted({x for x, y in inside if letter(x) and not letter(y)})))
        if sums or any("\n" in pair for pair in inside):
            pattern = f"{MARK}+[^{MARK}]*|[^{MARK}]+"
        else:
            pattern = rf"{MARK}*[^\W\d_{odd}]+|{MARK}*(?:(?![{MARK}\n])[\W\d_{odd}])+[^\W\d_{odd}]*|{MARK}+|\n+"
        self._words = re.compile(pattern).findall
        raw = [
            bytes([int(p.piece[3:5], 16)]) if p.type == p.BYTE else b"" if p.type == p.CONTROL else b" \xe2\x81\x87 " if p.type == p.UNKNOWN else p.piece.replace(MARK, " ").encode()
            for p in model.pieces
        ]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_ends = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        self.max_words = max_words
        self._clear()

    def split(self, text: str) -> list[str]:
        return self._words(MARK + text.replace(" ", MARK)) if text else []

    def _merge(self, text: str) -> list[str]:
        """Merge the best pair, the first of equal ones, until none is left."""
        own, score = list(text), self.score
        while len(own) > 1:
            best, at = -np.inf, -1
            for k in range(len(own) - 1):
                s = score.get(own[k] + own[k + 1])
                if s is not None and s > best:
                    best, at = s, k
            if at < 0:
                break
            own[at : at + 2] = [own[at] + own[at + 1]]
        return own

    def _agree(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        good = np.ones(len(a), bool)
        plain = np.flatnonzero((a < self.n) & (b < self.n))  # an unknown character merges with nothing
        pairs, back = np.unique(a[plain] * self.n + b[plain], return_inverse=True)
        k = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        out, new = self.values[k], self.pairs[k] != pairs
        recent, pieces = self.recent, self.pieces
        for j, p in zip(np.flatnonzero(new).tolist(), pairs[new].tolist()):
            v = recent.get(p)
            if v is None:
                x, y = pieces[p // self.n], pieces[p % self.n]
                v = recent[p] = self._merge(x + y) == [x, y]
            out[j] = v
        if len(recent) > 20_000:
            if len(self.pairs) > 2_000_000:
                self.pairs, self.values = self.pairs[:1], self.values[:1]
            every = np.concatenate([self.pairs, np.fromiter(recent, np.int64, len(recent))])
            order = np.argsort(every)
            self.pairs, self.values = every[order], np.concatenate([self.values, np.fromiter(recent.values(), bool, len(recent))])[order]
            recent.clear()
        good[plain] = out[back]
        return good

    def ids_of(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        order: list[str] = []
        flat, lengths = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for places, matrix, size in batches([_symbols(w) for w in words]):
            _, last, back = self.trellis.solve(matrix)
            rows = np.arange(len(places))
            at = size.copy()
            steps = []
            while at.any():  # all words back to their starts, a piece at a time
                steps.append(np.where(at > 0, last[rows, at], -1))
                at = np.where(at > 0, back[rows, at], 0)
            path = np.stack(steps[::-1], axis=1)
            ids = path[path >= 0]
            sizes = (path >= 0).sum(axis=1)
            odd = np.flatnonzero(ids >= self.n)  # characters that are no piece become bytes
            if len(odd):
                spelt = [self.byte_ids[list(chr(c).encode("utf-8", "surrogatepass"))] for c in (ids[odd] - self.n).tolist()]
                more = np.ones(len(ids), np.int64)
                more[odd] = [len(x) for x in spelt]
                sizes = np.add.reduceat(more, np.cumsum(sizes) - sizes)
                starts = np.cumsum(more) - more
                ids = np.repeat(ids, more)
                for k, x in zip(starts[odd].tolist(), spelt):
                    ids[k : k + len(x)] = x
            order += [words[k] for k in places]
            flat.append(ids)
            lengths.append(sizes)
        return order, np.concatenate(flat).astype(np.uint32), np.concatenate(lengths)

    def decode(self, ids: np.ndarray) -> str:
        starts = self.raw_ends[ids]
        sizes = self.raw_ends[ids + 1] - starts
        ends = np.cumsum(sizes)
        if not len(ids):
            return ""
        text = self.raw[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1])].tobytes().decode("utf-8", "replace")
        return text.removeprefix(" ")


def _symbols(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


_ENCODERS: dict[str, PieceEncoder] = {}


def piece_encoder(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def encode_and_decode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of little-endian 32-bit ids), round_trip (the ids decode to the
    text) and, with ``with_ids``, ids."""
    narrow = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_crc32 bigint, round_trip boolean"
    schema += ", ids array<int>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = piece_encoder(model)
        for b in found:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = part.column(1).to_pylist()
                flat, ends = own.encode(texts)
                ids = [flat[s:e] for s, e in zip(ends[:-1].tolist(), ends[1:].tolist())]
                columns = [
                    part.column(0),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                    pa.array([own.decode(x.astype(np.int64)) == t for x, t in zip(ids, texts)], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(
                    columns + [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))] * with_ids, names,
                )

    return narrow.mapInArrow(run, schema)
