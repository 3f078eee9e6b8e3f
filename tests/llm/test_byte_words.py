"""The words of texts as bytes: the split, the table of words, what the library is asked."""

import random

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from batchloom.llm import bpe  # noqa: E402

BPE = P.path("byte_bpe_50k.json")
EDGES = ["", "", " ", "\n", "'s", "s'", "'", "''s", " 's", "a's's'", "'ll've'd", "'l'lx", "a \n", " \n a", "\xff" * 40, "x" * 15, "x" * 16, "x" * 17, " " + "x" * 16]


def random_texts(seed, n):
    rng = random.Random(seed)
    signs = list("ab  ''\n\t\r sdmtrevl09½²é×÷\xa0\x85.,!<|>") + ["'re", "'ll", "  ", " '", "''"]
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_bytes_are_split_as_the_pattern_says():
    texts = random_texts(1, 3000) + EDGES
    raw, at, size, counts = bpe.cut_words(texts)
    words = [raw[s : s + n].decode("latin-1") for s, n in zip(at.tolist(), size.tolist())]
    places = np.cumsum([0, *counts.tolist()]).tolist()
    assert [words[a:b] for a, b in zip(places, places[1:])] == [bpe.words_of(t) for t in texts] and places[-1] == len(words)


@pytest.mark.parametrize("limit", [1_000_000, 300, 5])
def test_byte_words_have_the_ids_of_the_library(limit):
    texts, rng = random_texts(2, 900) + EDGES, random.Random(3)
    texts += [t + rng.choice(["日本", bpe.SPECIAL, "\x00a", "\x1c b", "🙂"]) for t in random_texts(4, 100)]
    rng.shuffle(texts)
    own = bpe.ByteEncoder(BPE, limit)
    want = [e.ids for e in own.library.encode_batch(texts, add_special_tokens=False)]
    for k in range(0, len(texts), 100):  # few words are remembered, or all
        ids, ends = own.encode(texts[k : k + 100])
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == want[k : k + 100]
    assert own.encode([])[0].size == 0 and own.encode(["", ""])[1].tolist() == [0, 0, 0]


def test_crowded_slots_and_growth(monkeypatch):
    own, rng = bpe.ByteEncoder(BPE), np.random.default_rng(5)
    monkeypatch.setattr(own, "_slots", lambda keys: np.full(len(keys), len(own.keys) - 2, np.int64))  # all in one place
    keys = np.unique(rng.integers(1, 1 << 40, (300, 2), dtype=np.uint64), axis=0)
    own.put(keys[:200], np.arange(200, dtype=np.int32))
    assert own.find(keys).tolist() == [*range(200), *[-1] * (len(keys) - 200)]
    monkeypatch.undo()
    own = bpe.ByteEncoder(BPE)
    many = np.unique(rng.integers(1, 1 << 60, (40_000, 2), dtype=np.uint64), axis=0)
    for k in range(0, len(many), 7000):
        own.put(many[k : k + 7000], np.arange(k, min(k + 7000, len(many)), dtype=np.int32))
    assert own.find(many).tolist() == list(range(len(many))) and (own.find(many + np.uint64(1 << 61)) == -1).all()


def test_new_words_are_few_strings_for_the_library(monkeypatch):
    own, asked = bpe.ByteEncoder(BPE), []
    words = [f" {a}{b}{c}" for a in "abcdefgh" for b in "aeiou" for c in "lmnrst"]

    class Counting:
        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return library.encode_batch_fast(texts, **options)

    library, own.library = own.library, Counting()
    ids, _ = own.encode(["".join(words) * 5])
    assert ids.tolist() == library.encode("".join(words) * 5, add_special_tokens=False).ids
    assert len(asked) <= 4 and sum(map(len, asked)) == sum(map(len, words))  # each word once, a hundred at a time
