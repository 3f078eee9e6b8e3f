"""Quality, spelling variants and collocations against brute force, gradients and held-out labels."""

import random
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")

from batchloom.llm import phrases, quality, variants  # noqa: E402

SF = "/root/testdata/sf0.001"


def frame(spark, texts, ids=None, langs=None):
    """Rows with columns whose names clash with those inside."""
    rows = [(k if ids is None else ids[k], t, "en" if langs is None else langs[k], 1, "x", 2.5, 3, "y") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n int, word string, score double, rank int, key string")


# --- op11 ---------------------------------------------------------------------------------------

SMALL = quality.QualityConfig(chunk=32, overlap=8, width=8, stride=4, embed=3, filters=4, hidden=3, epochs=2)


def laid_out(texts, config):
    data, bounds = quality._bytes(pa.array(texts, pa.string()), config.chunk)
    return data, bounds[:-1], bounds[1:]


def test_chunks_cover_every_filter_place():
    for size in (0, 1, 31, 32, 33, 55, 56, 57, 80, 81, 500):
        text = "".join(chr(97 + k % 26) for k in range(size))
        data, s, e = laid_out([text], SMALL)
        n = int(quality._n_chunks(e - s, SMALL)[0])
        own = quality.cut(data, s + np.arange(n) * SMALL.step, np.repeat(e, n), SMALL)
        seen = {bytes(c[a : a + 8].tolist()) for c in own for a in range(0, 25, 4) if (c[a : a + 8] < 256).all()}
        want = {text[a : a + 8].encode() for a in range(0, size - 7, 4)}
        assert want <= seen and (n == 1 or (own[-1] < 256).any())


def test_network_equals_plain_loops():
    rng = np.random.default_rng(3)
    net = quality.Network(SMALL)
    net.base = None
    for k, v in net.p.items():
        net.p[k] = rng.normal(0, 0.5, v.shape).astype(np.float32)
    texts = ["", "é" * 20, "plain words " * 9, None, "x"]
    got = net.score(*laid_out(texts, SMALL), slab=2)
    for text, score in zip(texts, got):
        raw = list((text or "").encode())
        n = 1 + max(0, -(-(len(raw) - SMALL.chunk) // SMALL.step))
        features = []
        for c in range(n):
            own = raw[c * SMALL.step : c * SMALL.step + SMALL.chunk]
            own += [256] * (SMALL.chunk - len(own))
            pooled = []
            for f in range(SMALL.filters):
                values = [sum(float(net.p["e"][own[a + i]] @ net.p["w"][i * 3 : i * 3 + 3, f]) for i in range(8)) for a in range(0, SMALL.chunk - 7, 4)]
                pooled.append(max(0.0, max(values) + net.p["wb"][f]))
            features.append(np.maximum(np.array(pooled) @ net.p["a"] + net.p["ab"], 0))
        z = np.mean(features, axis=0) @ net.p["m"] + np.max(features, axis=0) @ net.p["x"] + net.p["b"][0]
        assert abs(score - 1 / (1 + np.exp(-z))) < 1e-4


def test_gradients():
    rng = np.random.default_rng(4)
    net = quality.Network(SMALL)
    for k, v in net.p.items():
        net.p[k] = rng.normal(0, 0.5, v.shape)  # doubles, for differences
    chunks, first, y = rng.integers(0, 257, (5, SMALL.chunk)).astype(np.int16), np.array([0, 2, 3]), np.array([1, 0, 1])
    _, g = net.step(chunks, first, y)
    for name, grad in g.items():
        flat = net.p[name].reshape(-1)
        for k in rng.choice(flat.size, min(6, flat.size), replace=False):
            old, eps = flat[k], 1e-5
            flat[k] = old + eps
            up = net.step(chunks, first, y)[0]
            flat[k] = old - eps
            down = net.step(chunks, first, y)[0]
            flat[k] = old
            assert abs((up - down) / (2 * eps) - grad.reshape(-1)[k]) < 1e-3, name


def test_quality_is_learnt_without_held_out_rows(spark):
    rng = random.Random(1)
    good = lambda: " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 8))) for _ in range(rng.randint(5, 200))) + "."
    bad = lambda: " ".join("".join(rng.choices("etaoinshrdlu", k=4)) + rng.choice(["###", "%%%"]) for _ in range(rng.randint(5, 200)))
    texts = [bad() if k % 4 == 0 else good() for k in range(400)] + [None, "", good() * 300, good(), good()]
    texts[404] = texts[403]
    docs = frame(spark, texts)
    held = {k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 0}
    # Labels of held-out rows are wrong on purpose: they must not be seen.
    labels = spark.createDataFrame([(k, int((k % 4 != 0) != (k in held)), 0) for k in range(400)] + [(None, 1, 0), (9999, 1, 0), (5, None, 1)], "doc_id bigint, quality int, toxic int")
    net = quality.learn(docs, labels, quality.QualityConfig(epochs=6))
    out = quality.scored(docs, net)
    assert out.columns == ["doc_id", "text", "lang", "n", "word", "rank", "key", "score", "predicted"]
    rows = {r.doc_id: r for r in out.withColumn("held", quality.held_out("doc_id")).collect()}
    assert {k for k, r in rows.items() if r.held} == {k for k in rows if zlib.crc32(str(k).encode()) % 5 == 0}
    assert np.mean([rows[k].predicted == (k % 4 != 0) for k in held]) > 0.97
    assert rows[400].score == rows[401].score and rows[402].predicted == 1 and rows[403].score == rows[404].score
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows.values())
    assert quality.scored(docs.limit(0), net).count() == 0
    # Without two labels there is nothing to learn.
    assert quality.learn(docs, labels.limit(0)).base == 1.0
    alone = quality.learn(docs, labels.where("quality = 0"))
    assert alone.base == 0.0 and {r.score for r in quality.scored(docs, alone).collect()} == {0.0}
    null = frame(spark, ["a", "a"], [None, None])
    assert [r.held for r in quality.scored(null, net).withColumn("held", quality.held_out("doc_id")).collect()] == [False, False]


def test_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.1")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.scored(docs, quality.learn(docs, labels)).join(labels, "doc_id").where(quality.held_out("doc_id")).select("quality", "predicted").collect()
    kept = np.mean([r.predicted for r in rows if r.quality == 1])
    dropped = np.mean([1 - r.predicted for r in rows if r.quality == 0])
    assert len(rows) > 500 and kept > 0.99 and dropped > 0.75


# --- op12 ---------------------------------------------------------------------------------------


def plain_words(docs, shortest=7):
    import re

    found = Counter()
    for doc, text in docs:
        if doc is None or text is None:
            continue
        for run in re.findall("[A-Za-zÀ-ÿ]+", text):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= shortest:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 2}


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:k] + a[k + 1 :] == b for k in range(len(a)))


def plain_variants(words):
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def random_words(rng):
    """Few letters, repeated grams, long families: much that is near."""
    base = ["".join(rng.choices("abÀé", k=rng.randint(7, 10))) for _ in range(12)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab", "bababab", "ababababa"]
    out = list(base)
    for _ in range(150):
        w = list(rng.choice(out))
        k, how = rng.randrange(len(w)), rng.randrange(3)
        w[k : k + (how > 0)] = rng.choice("abÀéz") if how < 2 else ""
        out.append("".join(w))
    return out


@pytest.mark.parametrize("q", [1, 2, 3])
def test_variants_equal_brute_force(spark, q):
    rng = random.Random(q)
    some = random_words(rng)
    long = "q" * 4000
    docs = [(k, " ".join(w if rng.random() < 0.8 else w.upper() for w in rng.choices(some, weights=[1 + 300 * (j < 4) for j in range(len(some))], k=120))) for k in range(12)]
    docs += [(50, " ".join(some) * 2), (51, None), (52, ""), (None, "nothing nothing"), (53, "short Wörter 1234 ÷÷÷÷÷÷÷÷ ÷÷÷÷÷÷÷÷")]
    docs += [(60 + k, f"{long}r {long} {long}") for k in range(3)] + [(50, " ".join(some))]
    docs += [(70 + k, "kettelat " * 4 + "kettelot " * 60) for k in range(10)] + [(80 + k, "kettelad") for k in range(3)]  # a chain of forms
    want = plain_variants(plain_words(docs))
    assert any(f for f, *_ in want.values()) and any(r != f for f, r, *_ in want.values() if f)
    for config in (variants.VariantConfig(q=q), variants.VariantConfig(q=q, crowded=3, block=50, held=5)):
        rows = variants.variants(frame(spark, [t for _, t in docs], [d for d, _ in docs]), config).collect()
        assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows} == want and len(rows) == len(want)
    assert variants.variants(frame(spark, [])).count() == 0 and variants.variants(frame(spark, ["abc abc"])).count() == 0


def test_long_lists_go_through_in_steps(spark, monkeypatch):
    """A list of more rows than a step holds: those at home wait for all visitors."""
    rng = random.Random(9)
    words = {"zzz" + "".join(rng.choices("abcdefgh", k=4)) for _ in range(500)}
    words |= {"zzz" + "".join(rng.choices("abcdefgh", k=5)) for _ in range(500)}
    table = spark.createDataFrame([(w, 2) for w in sorted(words)], "word string, n bigint")
    # All grams equally rare: every word stands in the list of its first ones.
    monkeypatch.setattr(variants, "gram_ranks", lambda words, config: np.zeros(90**3, np.int32))
    found = variants.near_pairs(table, variants.VariantConfig()).collect()
    own = sorted((bytes(r.word).decode("latin-1"), bytes(r.near).decode("latin-1")) for r in found)
    dele = {}
    for w in words:
        for k in range(len(w)):
            dele.setdefault((k, w[:k] + w[k + 1 :]), set()).add(w)
    want = {(a, b) for s in dele.values() for a in s for b in s if a != b and len(a) == len(b)}
    want |= {x for (_, d), s in dele.items() if d in words for w in s for x in ((d, w), (w, d))}
    assert own == sorted(want)


# --- op13 ---------------------------------------------------------------------------------------


def plain_collocations(docs, config):
    import re

    grams, totals = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            own = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(own)
            for size in range(1, config.longest + 1):
                for k in range(len(own) - size + 1):
                    grams[lang, tuple(own[k : k + size])] += 1
    wanted = {k: n for k, n in grams.items() if len(k[1]) > 1 and n >= config.least}
    inside = lambda a, b: any(b[k : k + len(a)] == a for k in range(len(b) - len(a) + 1))
    out = []
    for (lang, w), a in wanted.items():
        if any(x == lang and len(v) > len(w) and n >= a and inside(w, v) for (x, v), n in wanted.items()):
            continue
        cuts = []
        for k in range(1, len(w)):
            left, right = grams[lang, w[:k]], grams[lang, w[k:]]
            cuts.append((int(Fraction(1000 * a * totals[lang], left * right)), k, left, right))
        score, _, left, right = min(cuts)
        out.append((lang, " ".join(w), a, left, right, totals[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(x[0], k, *x[1:]) for k, x in enumerate(own[: config.top], 1)]
    return sorted(ranked)


def test_collocations_equal_brute_force(spark):
    rng = random.Random(2)
    vocabulary = ["a", "b", "The", "été", "日本", "x\xa0y", "\x1cq", "w" * 3000, "rare1"]
    docs = []
    for k in range(120):
        own = [rng.choice(vocabulary[: 3 + k % 6]) for _ in range(rng.randint(0, 60))]
        docs.append(("".join(w + rng.choice([" ", "  ", "\t", ". ", ",", "\n", "\x0b", " ", " "]) for w in own), rng.choice(["en", "en", None, "de", "und"])))
    docs += [(None, "en"), ("", "en"), ("only once here", "fr"), ("a a a a a a a a a a a", "en"), ("a a a a a a a a a a a", "en")]
    data = frame(spark, [t for t, _ in docs], langs=[x for _, x in docs])
    for config in (
        phrases.PhraseConfig(least=4, top=40), phrases.PhraseConfig(least=4, top=40, broadcast_words=0, bitmap=1 << 15, held=50, shares=3),
        phrases.PhraseConfig(least=3, longest=2, top=1000), phrases.PhraseConfig(least=3, longest=4, held=200),
    ):
        got = sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in phrases.collocations(data, config).collect())
        assert got == plain_collocations(docs, config) and got
    assert phrases.collocations(frame(spark, [])).count() == 0 and phrases.collocations(frame(spark, ["a b c"])).count() == 0


def test_long_texts_by_blocks(spark):
    """A text of many blocks is put together again where its words are joined."""
    text = " ".join(f"w{k % 700}" for k in range(30_000))
    data = frame(spark, [text, text])
    a = phrases.collocations(data, phrases.PhraseConfig(least=20)).collect()
    b = phrases.collocations(data, phrases.PhraseConfig(least=20, broadcast_words=0)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) > 600


def test_keys_keep_order():
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 1 << 31, (200, 5))
    keys = phrases.pack(ids, 3).astype(">u8").view("V24").reshape(-1)
    order = sorted(range(200), key=lambda k: bytes(keys[k]))
    assert order == sorted(range(200), key=lambda k: tuple(ids[k]))
    cells, n = phrases._runs(phrases.pack(np.repeat(ids[:3], [1, 4, 2], axis=0)[::-1].copy(), 3), None)
    assert sorted(n.tolist()) == [1, 2, 4] and len(cells) == 3


@pytest.mark.parametrize("name", ["op12_variants", "op13_phrases"])
def test_equals_sql(spark, name):
    import __spark_entry__ as e

    c = duckdb.connect()
    sf = SF.replace("0.001", "0.01")
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    found = c.execute(e.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(map(str, (tuple(r) for r in e.queries()[name](spark, sf).select(names).collect()))) == sorted(map(str, found.fetchall()))
