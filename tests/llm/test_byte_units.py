"""Units of many texts at once are those of each text."""

import random

import pytest

from batchloom.llm import linededup

ODD = ["", " ", "\n", "a", ".", ". .", " a ", "\na\n", "a. ", "a.", "\xff", "a  b", "日本。x", "x\ty", "a.\tb", "a\x85b", "\ud800 a."]


def random_texts(seed, n):
    rng = random.Random(seed)

    def word():
        size = rng.choice([1, 2, 3, 5, 9, 30, 70]) if rng.random() < 0.2 else rng.randint(1, 6)
        return "".join(rng.choice("abcdefgxyz.é!?,Äß") for _ in range(size))

    between = [" "] * 12 + ["\n", "\n ", " \n", "\n\n", ". ", "! ", "? ", " . ", ".\n"]
    return [rng.choice(["", " ", "\n"]) + "".join(word() + rng.choice(between) for _ in range(rng.randint(0, 120))) for _ in range(n)]


@pytest.mark.parametrize("long_words", [25, 7, 3])
def test_units_of_many_texts(long_words, monkeypatch):
    config, texts = linededup.LineConfig(long_words=long_words), random_texts(long_words, 400) + ODD
    want = [linededup.units(t, config) for t in texts]
    monkeypatch.setattr(linededup, "_MOST_BYTES", 3000)  # several groups
    assert linededup.units_of(texts, config) == [[u[:3] for u in own] for own in want]
    groups, rest = linededup.parted(texts)
    assert len(groups) > 10 and {texts[k] for k in rest} >= {"a  b", "日本。x", "x\ty", "a\x85b"}
    for group in groups:
        joined, _, table, sizes = linededup.byte_units([texts[k] for k in group], config)
        assert linededup.byte_keys(joined, table[0], table[1]) == [x for k in group for x in linededup._keys(texts[k], want[k])]
        assert table[2:].T.tolist() == [[int(x) for x in u[2:]] for k in group for u in want[k]]
        assert sizes.tolist() == [len(want[k]) for k in group]


def test_most_texts_are_not_walked(monkeypatch):
    walked = []
    monkeypatch.setattr(linededup, "units", lambda text, config: walked.append(text) or [])
    linededup.units_of(random_texts(1, 50) + ["a  b"], linededup.LineConfig())
    assert walked == [t for t in random_texts(1, 50) if "  " in t] + ["a  b"]
