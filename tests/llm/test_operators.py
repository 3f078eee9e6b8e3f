"""The training-data operators against brute force, libraries and exact round trips, on small tables."""

import hashlib
import json
import math
import random
import re
import time
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from batchloom.llm import editprint, linededup, packing, pii, simhash, tokencounts, tokenfile, topk, toxicity  # noqa: E402
from batchloom.llm.bpe import encoder  # noqa: E402
from batchloom.llm.components import components  # noqa: E402
from batchloom.llm.pieces import encode_and_decode, piece_encoder  # noqa: E402

BPE = P.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
LONG = "A long sentence of words that goes on. " * 4000
ODD = [None, "", " ", "a", "  \n\n x", "don't they're <|endoftext|> <|endof", "日本語 テスト 🙂 é́", "½ ²³\xa0\x85y", "x" * 3000, LONG, "a", "a"]


def frame(spark, texts, ids=None):
    """Rows with a null id, repeated rows and columns whose names clash with those inside."""
    rows = [(k if ids is None else ids[k], t, "en", 1, "x", 2) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, fp int, spans string, score int")


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


def test_word_cache_equals_the_library():
    rng = random.Random(5)
    texts = [t or "" for t in ODD] + ["".join(rng.choice("ab  '\nré½\xa0\x85\x1c.,1<|>s") for _ in range(50)) for _ in range(400)]
    ids, ends = encoder(BPE).encode(texts)
    want = [e.ids for e in library().encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == want


# --- op1 ----------------------------------------------------------------------------------------


def brute_cost(pos, penalty, length):
    best = [0] + [None] * (len(pos) - 1)
    for j in range(1, len(pos)):
        best[j] = min(best[i] + penalty[j] + length - (pos[j] - pos[i]) for i in range(j) if pos[j] - pos[i] <= length)
    return best[-1]


def test_cuts_are_cheapest():
    rng = random.Random(2)
    for _ in range(60):
        pos = [0]
        for _ in range(rng.randint(1, 40)):
            pos.append(pos[-1] + rng.randint(1, 16))
        penalty = [rng.choice((0, 3, 9)) for _ in pos]
        cuts = packing.best_cuts(pos, penalty, 16)
        at = {p: k for k, p in enumerate(pos)}
        cost = sum(penalty[at[b]] + 16 - (b - a) for a, b in zip(cuts, cuts[1:]))
        assert cost == brute_cost(pos, penalty, 16) and all(0 < b - a <= 16 for a, b in zip(cuts, cuts[1:]))


def check_pack(rows, texts, length):
    want = [e.ids + [0] for e in library().encode_batch([t or "" for t in texts], add_special_tokens=False)]
    pieces = {}
    for r in rows:
        pieces.setdefault(r.sequence_id, []).append(r)
    left = sorted(map(tuple, want))
    whole = {}
    for own in pieces.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= length
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        whole.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, ids.tolist()))
    total = sorted(i for p in whole.values() for _, ids in p for i in ids)
    assert total == sorted(i for w in left for i in w)
    return pieces


def test_pack_odd_texts(spark):
    config = packing.PackConfig(BPE, length=256, block=1500, with_ids=True)
    rows = packing.pack(frame(spark, ODD).coalesce(1), config).collect()
    pieces = check_pack(rows, ODD, 256)
    for k, t in enumerate(ODD):
        own = sorted((r for r in rows if r.doc_id == k), key=lambda r: r.start)
        ids = library().encode(t or "", add_special_tokens=False).ids + [0]
        assert [i for r in own for i in np.frombuffer(r.ids, "<u4")] == ids and all(r.doc_tokens == len(ids) for r in own)
        assert [r.start for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
    sizes = [sum(r.length for r in own) for own in pieces.values()]
    padding = sum(0 if n & (n - 1) == 0 else 256 - n for n in sizes)
    assert padding < 0.1 * sum(sizes)
    assert packing.pack(frame(spark, []), config).count() == 0
    nulls = packing.pack(frame(spark, ["a", "b"], [None, 1]), config).collect()
    assert {r.doc_id for r in nulls} == {None, 1}


# --- op2 ----------------------------------------------------------------------------------------


def test_pieces_equal_sentencepiece(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    rows = encode_and_decode(frame(spark, ODD), P.path("piece_bpe_32k.model"), with_ids=True).collect()
    for r in rows:
        text = ODD[r.doc_id] or ""
        assert r.ids == sp.encode(text) and r.n_tokens == len(r.ids) and r.round_trip
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    own, rng = piece_encoder(P.path("piece_bpe_32k.model")), random.Random(3)
    texts = ["".join(rng.choice("ab  the'\nréin1.,日🙂▁") for _ in range(40)) for _ in range(200)]
    flat, ends = own.encode(texts)
    got = [flat[a:b].astype(np.int64) for a, b in zip(ends, ends[1:])]
    assert [g.tolist() for g in got] == sp.encode(texts) and [own.decode(g) for g in got] == [sp.decode(g.tolist()) for g in got]
    assert encode_and_decode(frame(spark, []), P.path("piece_bpe_32k.model")).count() == 0


def test_unigram_models(tmp_path):
    """A hand-made vocabulary whose scores matter, against the library."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    rng = random.Random(2)
    kept = [p for p in model.pieces if p.type != p.NORMAL]
    kept += [p for p in model.pieces if p.type == p.NORMAL and set(p.piece) <= set("▁abcdehlnorst") and len(p.piece) < 6][:900]
    for p in kept:
        if p.type == p.NORMAL:
            p.score = -rng.uniform(1, 12) * (1 + len(p.piece)) / 3  # sums don't tie
    new = pb.ModelProto()
    new.CopyFrom(model)
    del new.pieces[:]
    new.pieces.extend(kept)
    path = tmp_path / "unigram.model"
    path.write_bytes(new.SerializeToString())
    sp, own = sentencepiece.SentencePieceProcessor(model_proto=new.SerializeToString()), piece_encoder(str(path))
    texts = ["", " ", "the other one", "  two  blanks ", "x" * 300, "hatred" * 90] + [
        "".join(rng.choice("abcdehlnorst  ,é\n") for _ in range(rng.randint(1, 90))) for _ in range(300)
    ]
    flat, ends = own.encode(texts)
    assert [flat[a:b].tolist() for a, b in zip(ends, ends[1:])] == sp.encode(texts)


def test_key_hits_are_verified():
    from batchloom.llm.trellis import Trellis

    pieces = [np.array([k], np.uint32) for k in (1, 2, 3)] + [np.array([1, 2], np.uint32)]
    t = Trellis(pieces, np.arange(4), None, None, np.array([-1.0, -1.0, -1.0, -1.5]))
    assert t.solve(np.array([[1, 2, 3]], np.uint32))[0].tolist() == [[0, 1, 1, 2]]
    t.symbols[t.ids == 3, 1] = 9  # as if the key of (1, 2) were that of another piece
    assert t.solve(np.array([[1, 2, 3]], np.uint32))[0].tolist() == [[0, 1, 2, 3]]
    with pytest.raises(ValueError):
        Trellis([pieces[0], pieces[0]], np.arange(2))


# --- op3 ----------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), text.encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_follow_the_rule():
    for t in ODD + ["ÀB c\x0bD", "one", "one two", "ONE two Three four five"]:
        assert simhash.fingerprint(t or "") == plain_fingerprint(t or "")


def brute_classes(prints):
    root = {f: f for f in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    every = sorted(prints)
    for k, a in enumerate(every):
        for b in every[k + 1 :]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in prints}


@pytest.mark.parametrize("hot, rows", [(2000, 1000), (3, 2), (12, 3)])
def test_links_join_what_brute_force_joins(spark, hot, rows):
    rng = random.Random(4)
    prints = set()
    for _ in range(25):
        f = rng.getrandbits(64)
        for _ in range(8):
            prints.add(f)
            for _ in range(rng.randint(1, 4)):
                f ^= 1 << rng.randrange(64)
    signed = [f - (1 << 64) if f >> 63 else f for f in prints]
    df = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    found = {f: f for f in signed}
    found.update({r.a: r.root for r in components(simhash.link(df, hot=hot, tile=rows)).collect()})
    want = brute_classes(signed)
    group = lambda m: {frozenset(f for f in m if m[f] == v) for v in set(m.values())}
    assert group(found) == group(want)


def test_a_crowded_template_is_dealt_out(spark):
    """Fingerprints that agree in one half and one byte of the other: a chain and a crowd in one cell group."""
    rng = random.Random(9)
    half = rng.getrandbits(32) << 32
    crowd = {half | 0xAB000000 | rng.getrandbits(24) for _ in range(1500)}
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in crowd], "fp bigint")
    found = {f: f for f in crowd}
    found.update({r.a % (1 << 64): r.root % (1 << 64) for r in components(simhash.link(df, hot=100, tile=64)).collect()})
    want = brute_classes(list(crowd))
    group = lambda m: {frozenset(f for f in m if m[f] == v) for v in set(m.values())}
    assert group(found) == group(want) and len(group(want)) < 1500


def test_near_duplicates_on_odd_rows(spark):
    rows = simhash.near_duplicates(frame(spark, ODD)).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(ODD) and by[0].fingerprint == by[1].fingerprint == "0" * 16 and by[2].component_id == 0
    assert by[3].component_id == by[10].component_id == by[11].component_id == 3
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    twice = simhash.near_duplicates(frame(spark, ["q w e", "q w e", "q w e"], [7, 7, None])).collect()
    assert [r.component_id for r in twice] == [7, 7, 7]


# --- op4 ----------------------------------------------------------------------------------------

PASSAGE = "One fine day the river rose above its banks and all of the people went up to the old mill. They stayed there for a week and told each other tales."


def test_line_dedup(spark):
    texts = [
        f"My own beginning here.\n{PASSAGE}\nThe end of the first.",
        f"Another opening that nobody has.\n{PASSAGE}\nA different ending.",
        f"Set into a longer line of prose by me. {PASSAGE} And it goes on after that.",
        "Short line.\nYes.\nShort line.",
        "Short line.\nNo.",
        None,
        "",
        PASSAGE,
        PASSAGE,
        "x" * 5000,
    ]
    rows = {r.doc_id: r for r in linededup.without_copies(frame(spark, texts), report="cut__").collect()}
    assert rows[0].text == texts[0] and rows[1].text == "Another opening that nobody has.\nA different ending."
    assert PASSAGE[:60] not in rows[2].text and rows[2].text.startswith("Set into") and rows[2].text.endswith("after that.")
    assert [rows[k].text for k in (3, 4, 5, 6, 9)] == [texts[k] for k in (3, 4, 5, 6, 9)] and rows[7].text == rows[8].text == ""
    s, e = map(int, rows[1]["cut__"].split(":"))
    assert texts[1][s:e] == PASSAGE
    assert linededup.without_copies(frame(spark, [])).count() == 0
    assert rows[1].spans == "x" and rows[1].fp == 1
    same = linededup.without_copies(frame(spark, [PASSAGE, PASSAGE], [3, 3])).collect()
    assert [r.text for r in same] == [PASSAGE, PASSAGE]  # one document


def test_line_dedup_finds_passages_held_whole(spark):
    one, two, three = "The first part has seven words here.", "Then the second part has seven words.", "And so the third one also does."
    whole = f"{one} {two} {three}"
    texts = [f"Alone {k} it stands: {s}\n{s} Nothing more {k}." for k, s in enumerate((one, two, three))]  # each sentence, singly
    texts += [
        f"{one} It repeats {one} It goes on.", f"Held whole now. {whole} End.", f"The later one says: so. {whole} Own end here.",
        f"{two} {one} {three}",
    ]
    rows = [r.text for r in linededup.without_copies(frame(spark, texts)).orderBy("doc_id").collect()]
    assert rows[:5] == texts[:5] and rows[5] == "The later one says: so. Own end here." and rows[6] == texts[6]
    # The first holder has the first sentence twice, the passage at the second place.
    texts = [f"{one} Another thing. {whole} Bye.", f"Hello you. {whole} See you."]
    assert [r.text for r in linededup.without_copies(frame(spark, texts)).orderBy("doc_id").collect()] == [texts[0], "Hello you. See you."]


def plain_runs(own, config):
    """first, last, may be deleted: the shortest runs of ``min_passage`` words from and up to each unit, and shorter ones."""
    out = {}
    for i in range(len(own)):
        n = 0
        for j in range(i, len(own)):
            n += own[j][2]
            if n >= config.min_passage:
                out[i, j] = True
                break
            if n >= config.min_words:
                out[i, j] = own[i][3] and own[j][4]
    for j in range(len(own)):
        n = 0
        for i in range(j, -1, -1):
            n += own[i][2]
            if n >= config.min_passage:
                out[i, j] = True
                break
    return out


def plain_chain(pairs):
    """A longest rising chain by dynamic programming over all pairs, with the ties that ``patience`` takes."""
    chain = linededup.patience(pairs)
    best = [1] * len(pairs)
    for k, (_, e) in enumerate(pairs):
        best[k] = 1 + max((best[m] for m in range(k) if pairs[m][1] < e and pairs[m][0] < pairs[k][0]), default=0)
    assert len(chain) == max(best, default=0) and all(p in pairs for p in chain)
    assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(chain, chain[1:]))
    return chain


def plain_gone(texts, config, align=True):
    """For each text the units that pairwise diffs with earlier texts delete: aligned ones, and long shared blocks."""
    holders, out = {}, []
    for d, text in enumerate(texts):
        own = linededup.units(text, config) if text else []
        said = [text[u[0] : u[1]] for u in own]
        runs, rows = plain_runs(own, config), {}
        for (i, j), told in runs.items():
            if told and tuple(said[i : j + 1]) in holders:
                partner, held = holders[tuple(said[i : j + 1])]
                rows.setdefault(partner, []).append((i, -held, j))
        aligned, every = set(), set()
        for own_rows in rows.values():
            pairs = list(dict.fromkeys((i, -h) for i, h, _ in sorted(own_rows)))
            chain = plain_chain(pairs) if align else []
            for i, h, j in own_rows:
                every.update(range(i, j + 1))
                if any(i == p or -h == q for p, q in chain):
                    aligned.update(range(i, j + 1))
        gone, k = set(aligned), 0
        while k < len(own):
            e = k
            while e in every:
                e += 1
            if sum(u[2] for u in own[k:e]) >= config.moved > 0:
                gone.update(range(k, e))
            k = max(e, k + 1)
        for i, j in sorted(runs):
            holders.setdefault(tuple(said[i : j + 1]), (d, i))
        out.append((own, gone))
    return out


def test_line_dedup_equals_brute_force_diffs(spark):
    rng, kept = random.Random(8), []
    known = [" ".join(f"{chr(97 + k)}{j}" for j in range(rng.choice([1, 2, 3, 5, 6, 8, 13]))) + "." for k in range(9)]
    texts = ["".join(rng.choice(known) + rng.choice([" ", "\n"]) for _ in range(rng.randint(1, 14))) for _ in range(60)]
    for config in (linededup.LineConfig(), linededup.LineConfig(moved=0), linededup.LineConfig(moved=1), linededup.LineConfig(moved=20)):
        rows = {r.doc_id: r for r in linededup.without_copies(frame(spark, texts), config, report="cut__").collect()}
        for d, (own, gone) in enumerate(plain_gone(texts, config)):
            spans = [tuple(map(int, x.split(":"))) for x in rows[d]["cut__"].split(",") if x]
            assert {k for k, u in enumerate(own) if any(s <= u[0] and u[1] <= e for s, e in spans)} == gone
        kept.append(sum(len(g) for _, g in plain_gone(texts, config)))
        if config.moved != 1:  # the alignment decides
            assert sum(len(g) for _, g in plain_gone(texts, config, align=False)) < kept[-1]
    assert kept[1] <= kept[0] <= kept[3] <= kept[2] and kept[1] < kept[2]


def test_no_alignment_no_deletion(spark, monkeypatch):
    one, two = "A first passage of twelve or more words stands here in both of them.", "Then another passage that has more than twelve words follows the first one."
    texts = [f"Start.\n{one}\nMiddle.\n{two}", f"Own words.\n{one}\nOther own words.\n{two}\nx y z."]
    own = [linededup.units(t, linededup.LineConfig()) for t in texts]
    place = [next(k for k, u in enumerate(own[1]) if texts[1][u[0] : u[1]] == t) for t in (one, two)]
    there = [next(k for k, u in enumerate(own[0]) if texts[0][u[0] : u[1]] == t) for t in (one, two)]
    span = np.array([(linededup.text_tag(texts[1]) << linededup._PLACE_BITS | p) << linededup._WORD_BITS + 2 for p in place])
    cut = lambda: linededup.cut(texts[1], own[1], np.zeros(2, np.int64), np.array([there[0], there[1] + 5]), span, linededup.LineConfig())[0]
    assert cut() == "Own words.\nOther own words.\nx y z."
    monkeypatch.setattr(linededup, "align", lambda partner, own, held: np.zeros(len(own), bool))
    assert cut() == texts[1]


def test_line_dedup_counts_words_by_white_space(spark):
    rng, config = random.Random(3), linededup.LineConfig()
    for blank in ("\t", "\u00a0", "\u3000", "   ", " \t "):
        line = blank.join(["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)])
        found = linededup.units(f"{line}\nTwo{blank * 10}words", config)
        assert sum(u[2] for u in found) == 62 and found[-1][2] == 2 and max(u[2] for u in found[:-1]) < 60
    row, padded = "\t".join(f"cell{k}" for k in range(8)), "Two" + " " * 12 + "words"
    wide = "\u3000".join(f"wort{k}" for k in range(7))
    texts = [f"Begins so.\n{row}\n{padded}\nEnds.\n{wide}", f"Other begin.\n{row}\nMiddle.\n{padded}\nNew.\n{wide}\nLast."]
    rows = linededup.without_copies(frame(spark, texts)).orderBy("doc_id").collect()
    assert [r.text for r in rows] == [texts[0], f"Other begin.\nMiddle.\n{padded}\nNew.\nLast."]


def test_patience_is_a_longest_rising_chain():
    rng = random.Random(6)
    for _ in range(50):
        pairs = [(k, rng.randrange(8)) for k in range(rng.randint(1, 9))]
        chain = linededup.patience(pairs)
        best = 0
        for m in range(1 << len(pairs)):
            own = [p for k, p in enumerate(pairs) if m >> k & 1]
            if all(a[1] < b[1] for a, b in zip(own, own[1:])):
                best = max(best, len(own))
        assert len(chain) == best and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(chain, chain[1:]))


def test_units_too_short_for_any_run():
    config = linededup.LineConfig()
    for n in (0, 1, 3):
        at = np.arange(n) << linededup._WORD_BITS + 2 | 2
        found = linededup.runs(np.full(n, 7), at, np.arange(n), config)
        assert [len(x) for x in found] == [0 if n < 3 else 1] * 3


def test_alignment_marks_the_chain():
    pairs = np.array(
        [(3, 0, 5), (3, 1, 6), (3, 2, 0), (3, 3, 1), (3, 4, 9), (7, 0, 0), (7, 0, 0), (7, 5, 5), (9, 2, 4), (9, 2, 1), (9, 3, 2)]
    )
    on = linededup.align(*(np.ascontiguousarray(x) for x in pairs.T))
    assert on[:5].tolist() in ([True, True, False, False, True], [False, False, True, True, True]) and on[5:].all()
    assert linededup.align(np.array([1, 1, 2]), np.array([0, 1, 0]), np.array([4, 5, 4])).all()


def test_moved_blocks(spark):
    one, two, three = (
        f"{w} of this passage is long enough to be told apart from any other one here."
        for w in ("The first part", "A second piece", "Some third bit")
    )
    texts = [
        f"Start.\n{one}\nBetween them.\n{two}\n{three}\nDone.", f"Other start.\n{two}\n{three}\nA middle of my own.\n{one}\nOther end.",
    ]
    row = linededup.without_copies(frame(spark, texts), linededup.LineConfig(moved=1), report="cut__").where("doc_id = 1").first()
    assert row.text == "Other start.\nA middle of my own.\nOther end." and len(row.cut__.split(",")) == 2
    s, e = map(int, row.cut___moved.split(":"))
    assert texts[1][s:e] == one
    kept = linededup.without_copies(frame(spark, texts), linededup.LineConfig(moved=0)).where("doc_id = 1").first()
    assert kept.text == f"Other start.\nA middle of my own.\n{one}\nOther end."
    # By default a moved block goes only as a passage of 50 words.
    assert linededup.without_copies(frame(spark, texts)).where("doc_id = 1").first().text == kept.text
    passage = " ".join(f"w{k}" for k in range(60)) + "."
    texts = [f"{passage}\n{one}\n{two}\n{three}", f"Mine.\n{one}\n{two}\n{three}\n{passage}"]
    assert linededup.without_copies(frame(spark, texts)).where("doc_id = 1").first().text == "Mine."


def test_many_repeats_of_one_line(spark):
    line = "This line is said again and again and again."
    texts = [
        f"Begin.\n{line}\n{line}\nStop here.", "\n".join([line] * 100_000) + "\nThe end is mine.",
        "Mine.\n" + "\n".join([line, "Not yet."] * 20_000),
    ]
    began = time.monotonic()
    rows = [r.text for r in linededup.without_copies(frame(spark, texts)).orderBy("doc_id").collect()]
    assert rows[:2] == [texts[0], "The end is mine."] and rows[2] == "Mine.\n" + "\n".join(["Not yet."] * 20_000) and time.monotonic() - began < 60


def test_writing_without_blanks(spark):
    said = "今日は天気がとても良いので、公園まで散歩に行ってきました。そのあと友達と一緒に昼食を食べて、図書館で本を読みました。夜は家で映画を見て、早く寝ることにしています。"
    code = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz0123456789+/", k=400))
    texts = [f"こんにちは。\n{said}\n{code}", f"前書き。{said}それだけです。\n{code}\nEnd."]
    rows = [r.text for r in linededup.without_copies(frame(spark, texts)).orderBy("doc_id").collect()]
    assert rows[0] == texts[0] and rows[1] == "前書き。それだけです。\nEnd."


# --- op5 ----------------------------------------------------------------------------------------


def test_elias_fano():
    rng = np.random.default_rng(0)
    for values in ([], [0], [5, 5, 5], np.cumsum(rng.integers(0, 3, 700)), np.cumsum(rng.integers(0, 10**6, 900)), [0, 1 << 62], [1] * 600):
        v = np.array(values, np.int64)
        e = tokenfile.EliasFano.from_bytes(tokenfile.EliasFano.of(v).to_bytes())
        assert e.all().tolist() == v.tolist() and [e.select(k) for k in range(len(v))] == v.tolist()
        for _ in range(5):
            k = np.sort(rng.integers(0, max(len(v), 1), 9)) if len(v) else np.zeros(0, np.int64)
            assert e.select_many(k).tolist() == v[k].tolist()
    with pytest.raises(IndexError):
        e.select(600)
    v = np.cumsum(rng.integers(200, 800, 10_000))
    assert len(tokenfile.EliasFano.of(v).to_bytes()) * 8 < 14 * len(v)


def test_token_files_round_trip(spark, tmp_path):
    docs = frame(spark, ODD)
    folder = f"file://{tmp_path}/t"
    files = tokenfile.write_tokens(docs, folder, tokenfile.TokenFileConfig(BPE, ids_per_file=1000))
    rows = sorted(tokenfile.read_tokens(spark, folder, files).collect(), key=lambda r: r.doc_id)
    at = 0
    for r, t in zip(rows, ODD):
        ids = library().encode(t or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    found = sorted(files.collect())
    assert len(rows) == len(ODD) and len(found) > 1 and sum(f.docs for f in found) == len(ODD) and sum(f.ids for f in found) == at
    one = tokenfile.TokenFile((tmp_path / "t" / found[0].name).read_bytes())
    assert one.document(0).tolist() == [2] and one.bounds(one.n_docs - 1)[1] == one.n_ids
    assert tokenfile.token_file_digest(frame(spark, []), tokenfile.TokenFileConfig(BPE)).count() == 0
    # Documents without doc_id come first; the order of equal ids is that of their texts' hashes.
    ids, texts = [None, 5, None, 5, 5, -3], ["a", "b c", None, "d", "d", "e f g"]
    odd = tokenfile.token_file_digest(frame(spark, texts, ids), tokenfile.TokenFileConfig(BPE, ids_per_file=3)).orderBy("start").collect()
    assert [r.doc_id for r in odd] == [None, None, -3, 5, 5, 5] and [r.start for r in odd] == np.cumsum([0] + [r.n_tokens for r in odd[:-1]]).tolist()
    sums = Counter(zlib.crc32(np.array(library().encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for t in texts)
    assert Counter(r.ids_crc32 for r in odd) == sums
    wide = tokenfile.TokenFile(tokenfile.file_bytes(np.array([-5, 1 << 60]), np.array([1, 3]), np.array([70_000, 1, 2], np.uint32)))
    assert wide.doc_ids().tolist() == [-5, 1 << 60] and wide.document(1).tolist() == [1, 2] and wide.width == 4


# --- op6 ----------------------------------------------------------------------------------------


def test_edited_texts(spark):
    texts = ODD + ["abcdef" * 50, "uvwxyz" * 30]
    rows = {r.doc_id: r for r in editprint.with_edits(frame(spark, texts)).collect()}
    order = sorted(range(len(texts)), reverse=True)
    for k, i in enumerate(order):
        own, following = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        n = len(own)
        edited = own[: n - n // 3] + following[: n // 3]
        r = rows[i]
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == editprint.written(editprint.walks([own])[0]) and r.edited_fingerprint == editprint.written(editprint.walks([edited])[0])
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert rows[9].near_edited > 0.5 > rows[9].near_next and rows[3].fingerprint == rows[11].fingerprint
    assert editprint.with_edits(frame(spark, [])).count() == 0
    assert len(editprint.with_edits(frame(spark, ["one", "two", "three"], [1, 1, None])).collect()) == 3
    single = editprint.with_edits(frame(spark, ["only one here"])).collect()
    assert single[0].near_next == 1.0


def plain_walk(text):
    """The walk, a step at a time: level and samples."""
    level, n = editprint.level_of(len(text)), len(text)
    wanted, out, at = set(editprint.steps_of(level).tolist()), [], 0
    classes = editprint.char_classes(text).tolist()
    for j in range(3 * n):
        if at == n:
            break
        c = classes[at]
        if j in wanted:
            out.append(c)
        at += int(editprint._BITS[j % editprint.PERIOD, c])
    return bytes([level, *out])


def test_walks_equal_the_plain_walk():
    rng = random.Random(12)
    texts = ["", "a", "ab" * 40] + [
        "".join(rng.choice("abc déß日🙂\n") for _ in range(rng.choice([2, 30, 63, 64, 65, 127, 128, 200, 700, 3000]))) for _ in range(60)
    ]
    assert editprint.walks(texts) == [plain_walk(t) for t in texts]
    # Sampled steps, from their definition: hashes below a bound that halves from level to level.
    for level in (7, 8, 10):
        bound = 1 << 64 - (level - editprint.LEAST_LEVEL)
        mix = [int(x) for x in editprint._mix(np.arange(3 << level))]
        assert editprint.steps_of(level).tolist() == [j for j, h in enumerate(mix) if h < bound]


def test_recall_of_bands_over_edited_texts(spark):
    """Pairs of likeness 0.8 or more that share a class, against all pairs."""
    rng = random.Random(21)
    texts = []
    for _ in range(60):
        text = "".join(rng.choice("abcdefghij klmnop.") for _ in range(rng.choice([60, 200, 500, 1500])))
        texts.append(text)
        for _ in range(3):
            own = list(text)
            for _ in range(max(1, len(own) // rng.choice([20, 40, 100]))):
                k = rng.randrange(len(own))
                own[k : k + rng.choice([0, 1, 2])] = rng.choice(["", "x", "yz"])
            texts.append("".join(own))
    prints = editprint.walks(texts)
    rows = {r.doc_id: r.class_id for r in editprint.near_documents(frame(spark, texts)).collect()}
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if editprint.likeness(prints[i], prints[j]) >= 0.8]
    found = sum(rows[i] == rows[j] for i, j in pairs)
    assert len(pairs) > 40 and found >= 0.95 * len(pairs)


def test_small_edits_stay_near():
    rng = random.Random(8)
    base = "".join(rng.choice("abcdefghij klmnop") for _ in range(3000))
    other = "".join(rng.choice("abcdefghij klmnop") for _ in range(3000))
    changed = base[:700] + "X" + base[700:1500] + base[1504:2200] + "yz" + base[2200:]
    a, b, c = editprint.walks([base, changed, other])
    assert editprint.likeness(a, b) > 0.7 and editprint.likeness(a, c) < 0.3 and editprint.likeness(a, a) == 1.0
    assert set(editprint.bands(a)) & set(editprint.bands(b))
    for low, high in ((8, 9), (9, 12)):
        assert set(editprint.steps_of(high)[editprint.steps_of(high) < 3 << low]) <= set(editprint.steps_of(low))


def test_near_documents(spark):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdefghij klmnop") for _ in range(900)) for _ in range(3)]
    texts = [*base, base[0][:899] + "!", base[1], "", None]
    rows = {r.doc_id: r.class_id for r in editprint.near_documents(frame(spark, texts)).collect()}
    assert rows == {0: 0, 1: 1, 2: 2, 3: 0, 4: 1, 5: 5, 6: 5}


def test_near_documents_lose_no_link(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(3):  # chains, each text near its neighbours only
        text = "".join(rng.choice("abcdefghij klmnop") for _ in range(900))
        for _ in range(14):
            texts.append(text)
            at = rng.randrange(800)
            text = text[:at] + "".join(rng.choice("qrstuvwxyz") for _ in range(90)) + text[at + 90 :]
    prints = editprint.walks(texts)
    keys = [set(editprint.bands(x)) for x in prints]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if keys[i] & keys[j] and editprint.likeness(prints[i], prints[j]) >= 0.8 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    for slice_rows in (4096, 3):
        rows = {r.doc_id: r.class_id for r in editprint.near_documents(frame(spark, texts), slice_rows=slice_rows).collect()}
        assert [rows[k] for k in range(len(texts))] == root


def test_bands_lie_over_the_whole_text():
    rng = random.Random(4)
    near = shared = 0
    for _ in range(200):
        text = "".join(rng.choice("abcdefghij klmnop") for _ in range(rng.randint(1000, 1020)))
        part = "".join(rng.choice("qrstuvwxyz") for _ in range(180))
        a, b = editprint.walks([text, part + text[180:]])
        if editprint.likeness(a, b) >= 0.8:
            near += 1
            shared += bool(set(editprint.bands(a)) & set(editprint.bands(b)))
    assert near >= 50 and shared >= 0.95 * near


# --- op7 ----------------------------------------------------------------------------------------


def test_every_prefix_is_exact():
    own, lib = tokencounts.counter(BPE), library()
    for text in [t for t in ODD if t and len(t) < 400] + [
        "I'll 'rea ''s", "a \t\n  z", "x<|endoftext|>  <|endoftext|>y", "aaaa" * 20, "ÃÂ" * 12,
    ]:
        counts = tokencounts.PrefixCounts(own.prefixes(own.prepare([text])[0]))
        want = [len(lib.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        assert counts.counts.tolist() == want
        again = tokencounts.PrefixCounts.from_bytes(counts.to_bytes())
        assert again.counts.tolist() == want and again.count(len(text)) == want[-1]
        assert counts.fit(2) == max(k for k, n in enumerate(want) if n <= 2)


def test_token_counts(spark):
    rows = {r.doc_id: r for r in tokencounts.token_counts(frame(spark, ODD), BPE, limit=10, store=True).collect()}
    for k, t in enumerate(ODD):
        n = len(library().encode(t or "", add_special_tokens=False).ids)
        assert (rows[k].n_bytes, rows[k].n_tokens, rows[k].over_limit) == (len((t or "").encode()), n, n > 10)
        assert len(library().encode((t or "")[: rows[k].fit_chars], add_special_tokens=False).ids) <= 10
    assert tokencounts.token_counts(frame(spark, []), BPE).count() == 0


# --- op8 ----------------------------------------------------------------------------------------


def test_toxicity(spark):
    rng = random.Random(1)
    bad, plain = ("scum", "moron", "trash"), [f"w{''.join(rng.choice('abcdefg') for _ in range(4))}" for _ in range(300)]
    texts, labels = [], []
    for k in range(600):
        toxic = k % 6 == 0
        own = rng.choices(plain, k=30) + (rng.sample(bad, 2) if toxic else [])
        rng.shuffle(own)
        texts.append(" ".join(own))
        labels.append((k, 1, int(toxic)))
    docs = frame(spark, texts + [None, ""])
    index = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    rows = {
        r.doc_id: r for r in toxicity.scored(docs.select("doc_id", "text"), index).withColumn("held", toxicity.held_out("doc_id")).collect()
    }
    held = [k for k in range(600) if rows[k].held]
    assert all(rows[k].held == (zlib.crc32(str(k).encode()) % 5 == 0) for k in range(600)) and 80 < len(held) < 160
    assert all(rows[k].predicted == labels[k][2] for k in held)
    assert 0 <= rows[600].score == rows[601].score < 0.5 and rows[0].evidence
    assert set(index.names.tolist()) <= {k for k in range(600) if not rows[k].held}
    # The pruned search over lists gives what plain vectors of all words give.
    counts = {n: Counter(toxicity.words(texts[n].lower())) for n in index.names.tolist()}
    plain_df = Counter(w for c in counts.values() for w in c)

    def vector(c):
        w = {}
        for word, tf in c.items():
            toxic_df = sum(labels[n][2] for n, own in counts.items() if word in own)
            n1, n0, b, a = sum(labels[n][2] for n in counts), sum(1 - labels[n][2] for n in counts), toxic_df, plain_df[word] - toxic_df
            h = lambda k, n: 0 if k in (0, n) else k * math.log(k / n) + (n - k) * math.log(1 - k / n)
            g = max(0.0, 2 * (h(a, n0) + h(b, n1) - h(a + b, n0 + n1)))
            w[word] = (1 + math.log(tf)) * (math.log((1 + len(counts)) / (1 + plain_df[word])) + 1) * (0.02 + 0.98 * (g / (g + 50)) ** 2)
        size = math.sqrt(sum(x * x for x in w.values()))
        return {k: x / size for k, x in w.items()}

    small = toxicity.Index(toxicity.ToxicityConfig(block=64), [(n, labels[n][2], c) for n, c in counts.items()])
    vectors = {n: vector(c) for n, c in counts.items()}
    for k in held[:25]:
        own = vector(Counter(texts[k].split() + ["unheard"]))
        every = sorted(((round(sum(x * v.get(w, 0.0) for w, x in own.items()), 10), -n) for n, v in vectors.items()), reverse=True)[:15]
        for one in (index, small):
            _, places, cosines = one.asked(texts[k] + " unheard")
            assert np.allclose(cosines, [c for c, _ in every]) and [-n for _, n in every] == one.names[places].tolist()
    kept = toxicity.clean(docs, index)
    assert kept.columns == docs.columns and kept.where("doc_id >= 600").count() == 2 and kept.count() < 602
    none = toxicity.learn(docs, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    assert {r.score for r in toxicity.scored(docs.select("text"), none).collect()} == {0.0}
    # Clashing columns give way; an empty table stays empty; a long text is read whole.
    clash = toxicity.scored(docs.limit(3).withColumn("Score", F.lit("x")).withColumn("evidence", F.lit(1)), index)
    assert clash.columns == ["doc_id", "text", "lang", "fp", "spans", "score", "predicted", "evidence"] and clash.collect()
    assert toxicity.scored(docs.limit(0), index).count() == 0 == toxicity.clean(docs.limit(0), index).count()
    assert index.score("w " * 200_000 + "scum moron trash")[1]
    # Without a word in common with any example there is no neighbour.
    assert index.score("zzz yyy")[1] == [] and index.score("zzz")[0] == index.score("")[0]


def test_evidence_and_calibration():
    e = toxicity.evidence(np.array([90, 10, 1, 0]), np.array([0, 90, 0, 0]), 100, 900, 50.0)
    assert e[0] > 0.7 and e[1:].max() < 0.01
    index = toxicity.Index(toxicity.ToxicityConfig(), [(1, 0, {"a": 1}), (2, 1, {"b": 1})])
    index.calibrate(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0, 1, 0, 1]))
    x, y = index.curve
    assert np.allclose(x, [0.1, 0.25, 0.4]) and np.allclose(y, [0, 0.5, 1])


# --- op9 ----------------------------------------------------------------------------------------


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(k, [float(np.float32(x)) for x in rng.normal(0, 0.2, 5)]) for k in range(120)]
    rows += [
        (200, rows[3][1]), (201, rows[3][1]), (300, None), (301, []), (302, [1.0, None, 1.0, 1.0, 1.0]), (303, [float("nan")] * 5),
        (304, [float("inf")] * 5), (400, [1.0, 2.0]), (401, [3.0, 1.0]), (None, [0.0] * 5),
    ]
    df = spark.createDataFrame([(k, v, 0) for k, v in rows], "vec_id bigint, embedding array<float>, score int")
    found = topk.top_k(df.where("vec_id % 100 = 0"), df, topk.TopKConfig(block=16, cells=4, query_rows=2, chunk_bytes=100))
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    fine = [
        (k, [int(np.floor(1024 * x)) for x in v])
        for k, v in rows if k is not None and v and all(x is not None and np.isfinite(x) for x in v)
    ]
    for q, v in fine:
        if q % 100 == 0:
            every = sorted(((-sum(a * b for a, b in zip(v, w)), k) for k, w in fine if k != q and len(w) == len(v)))[:10]
            assert sorted(got[q]) == [(i, k, -s) for i, (s, k) in enumerate(every, 1)]
    assert set(got) == {0, 100, 200, 400}
    assert topk.top_k(df.where("false"), df).count() == 0


def test_top_k_with_large_components(spark):
    rng = random.Random(4)
    rows = [
        (
            k,
            [
                rng.choice(
                    [rng.uniform(-1, 1), rng.uniform(-1, 1), rng.uniform(-3e4, 3e4), rng.choice([1e9, -1e12, 1e30, -1e300])]
                ) if k % 3 == 0 else rng.uniform(-1, 1)
                for _ in range(3)
            ],
        )
        for k in range(90)
    ]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    whole = {k: [math.floor(1024 * Fraction(x)) for x in v] for k, v in rows}
    got = {}
    for r in topk.top_k(df.where("vec_id % 10 = 0"), df, topk.TopKConfig(block=16, cells=4)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in range(0, 90, 10):
        score = lambda k: min(max(sum(a * b for a, b in zip(whole[q], whole[k])), -(1 << 63)), (1 << 63) - 1)  # noqa: B023, E731
        every = sorted((-score(k), k) for k in whole if k != q)[:10]
        assert sorted(got[q]) == [(i, k, -s) for i, (s, k) in enumerate(every, 1)]


def test_cell_bounds_hold():
    rng = np.random.default_rng(5)
    for d, spread in ((3, 5), (64, 300), (200, 16_000_000)):
        exact = rng.integers(-spread, spread + 1, (200, d))
        q = rng.integers(-spread, spread + 1, (20, d))
        low, high = topk.Approximation(np.arange(200), exact, 64).bounds(q.astype(np.float64))
        true = q @ exact.T
        assert (low <= true).all() and (true <= high).all()


# --- op10 ---------------------------------------------------------------------------------------

RULES = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def plain_spans(text):
    out = []
    for k, rule in enumerate(RULES):
        for m in re.finditer(rule, text):
            d = re.findall("[0-9]", m.group())
            if (k == 0) or (
                k == 1 and all(int(p) <= 255 for p in m.group().split("."))
            ) or (k == 2 and 13 <= len(d) <= 19 and pii.luhn(d)) or (k == 3 and 9 <= len(d) <= 15):
                out.append((k, m.start(), m.end()))
    return out


SMALL = pii.TaggerConfig(window=48, hidden=12, embed=8, train=1000, epochs=4, batch=16)


def test_base_rules():
    rng = random.Random(7)
    for _ in range(4000):
        text = "".join(rng.choice("aB1290.@-+ ()%\n") for _ in range(rng.randint(0, 100)))
        assert pii.base_spans(text) == plain_spans(text)
    assert pii.base_spans("4539 1488 0343 6467")[0][0] == 2
    for hard in ("1" * 50_000, "a" * 50_000 + "@b", "1." * 20_000, "+1" + " (" * 20_000):
        pii.base_spans(hard)


def test_gradients():
    t = pii.Tagger(pii.TaggerConfig(window=10, hidden=3, embed=4))
    chars, tags = pii.examples(3, 10, 1)
    _, grads = t._step(chars, tags)
    rng = np.random.default_rng(0)
    for name, p in t.p.items():
        for _ in range(4):
            at = tuple(rng.integers(s) for s in p.shape)
            old, eps = p[at], 1e-5
            p[at] = old + eps
            up = t._step(chars, tags)[0]
            p[at] = old - eps
            down = t._step(chars, tags)[0]
            p[at] = old
            assert abs((up - down) / 2 / eps - grads[name][at]) < 1e-4


def test_viterbi_is_the_best_path():
    import itertools

    t = pii.Tagger(pii.TaggerConfig(window=10, hidden=3, embed=4))
    t.p["t"] = np.random.default_rng(3).normal(0, 1, t.p["t"].shape)
    u = np.random.default_rng(4).normal(0, 2, (4, 9))
    path = t.decode([u, u[:2]])[0]
    trans = t.p["t"] + pii._ALLOWED
    start = np.where((np.arange(9) % 2 == 0) & (np.arange(9) > 0), pii._NEVER, 0)
    score = lambda p: start[p[0]] + sum(u[k, x] for k, x in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:]))
    assert score(list(path)) == pytest.approx(max(score(p) for p in itertools.product(range(9), repeat=4)))


def test_pii_rows(spark):
    texts = ["mail a.b@c.de, 10.0.0.1 and +1 (980) 555-6268", "card 4539148803436467 end", None, "", "nothing 2024-01-02", LONG]
    rows = {r.doc_id: r for r in pii.find(frame(spark, texts), SMALL).collect()}
    for k, t in enumerate(texts):
        base = plain_spans(t or "")
        assert [rows[k].n_email, rows[k].n_ip, rows[k].n_card, rows[k].n_phone] == [sum(s[0] == i for s in base) for i in range(4)]
        assert rows[k].base_sha256 == hashlib.sha256(pii.spell(base).encode()).hexdigest()
        assert set(pii.spell(base).split(",")) - {""} <= set(rows[k].spans.split(","))
    masked = {r.doc_id: r for r in pii.redact(frame(spark, texts), SMALL).collect()}
    assert masked[0].text == "mail [EMAIL], [IP] and [PHONE]" and masked[1].text == "card [CARD] end" and masked[2].text is None and masked[5].text == LONG
    assert masked[0].spans == "x" and pii.find(frame(spark, []), SMALL).count() == 0
    assert pii.mask("ab", [(0, 0, 2), (1, 1, 2)]) == "[EMAIL]"


def test_tagger_learns():
    t = pii.Tagger(SMALL)
    losses = t.fit()
    chars, tags = pii.examples(150, SMALL.window, 77)
    found = np.stack(t.decode(list(t.scores(chars))))
    assert losses[-1] < losses[0] / 2 and (found == tags)[tags > 0].mean() > 0.4


def test_stored_weights_find_held_out_spans():
    """Exact spans in text that the training never saw, also across window borders."""
    tagger, rng = pii.trained(), np.random.default_rng(4242)
    assert json.loads(pii.WEIGHTS.read_text())["config"]["train"] == pii.TaggerConfig().train
    texts, gold = zip(*(pii.sentence(rng, 400) for _ in range(150)))
    base, found = pii.all_spans(tagger, list(texts))
    hit = sum(len(set(f) & set(g)) for f, g in zip(found, gold))
    asked, said = sum(map(len, gold)), sum(map(len, found))
    by_rule = sum(len(set(f) & set(g)) for f, g in zip(base, gold))
    assert hit / asked >= 0.9 and hit / said >= 0.9 and by_rule / asked < 0.5
    # Every labelled span lies around a place where windows are.
    assert all(any(s <= m.start() < e for m in pii._TRIGGER(t)) for t, g in zip(texts, gold) for _, s, e in g)
    for text in ("write to john.doe (AT) mail (DOT) com today", "call 0171 2345678 now", "john_12 at host dot org is me"):
        assert len(pii.all_spans(tagger, [text])[1][0]) == 1


def test_clean_prose_has_no_spans():
    import pandas as pd

    texts = pd.read_parquet(f"{SF}/benchmark.parquet").text.tolist() + [
        "The dot at the end, at night. Version 1.2 of 2024-05-06 costs 12.50 EUR at 10:20:30."
    ]
    assert not any(pii.all_spans(pii.trained(), texts)[1])


# --- pipeline -----------------------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(11)
    edges = [(k, k + 1) for k in range(60)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(25)] + [(500, 500)]
    found = {r.a: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert found == {x: r for x, r in root.items() if x != r}


def test_pipeline(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    kept = docs
    from batchloom.llm.common import settle

    seen = []
    for name, stage in C.STAGES:
        kept = settle(stage(spark, kept, SF), name)
        seen.append((name, kept.columns, kept.count()))
    assert [s[0] for s in seen] == ["toxicity", "line_dedup", "near_dedup", "pii", "packing"]
    assert all(s[1] == names for s in seen[:-1]) and seen[1][2] == seen[0][2] <= docs.count() and seen[3][2] == seen[2][2] <= seen[1][2]
    assert {"doc_id", "sequence_id", "offset", "ids"} <= set(seen[-1][1])
    for name, stage in C.STAGES[1:4]:
        assert stage(spark, docs.limit(0), SF).count() == 0


def plain_toxic(text, examples, index):
    """Predicted label by comparing with every example over all words."""
    config = index.config
    labels = {n: y for n, y, _ in examples}
    n1, n0 = sum(labels.values()), len(labels) - sum(labels.values())
    toxic, clean = Counter(), Counter()
    for _, y, c in examples:
        (toxic if y else clean).update(c.keys())
    h = lambda k, n: 0 if k in (0, n) else k * math.log(k / n) + (n - k) * math.log(1 - k / n)

    def vector(c):
        w = {}
        for word, tf in c.items():
            a, b = clean[word], toxic[word]
            g = max(0.0, 2 * (h(a, n0) + h(b, n1) - h(a + b, n0 + n1)))
            w[word] = (1 + math.log(tf)) * (math.log((1 + n0 + n1) / (1 + a + b)) + 1) * (
                config.floor + (1 - config.floor) * (g / (g + config.half)) ** 2
            )
        size = math.sqrt(sum(x * x for x in w.values())) or 1.0
        return {k: x / size for k, x in w.items()}

    vectors = plain_toxic.__dict__.setdefault(id(index), {n: vector(c) for n, _, c in examples})
    own = vector(Counter(toxicity.words((text or "").lower())))
    every = sorted(
        ((round(sum(x * v.get(w, 0.0) for w, x in own.items()), 10), -n) for n, v in vectors.items()), reverse=True,
    )[: config.neighbours]
    votes = [(1 / (0.05 + 1 - min(c, 1.0)), labels[-n]) for c, n in every if c > 0]
    base = n1 / (n0 + n1)
    vote = (sum(w * y for w, y in votes) + config.prior_weight * base) / (sum(w for w, _ in votes) + config.prior_weight)
    return float(np.interp(vote, *index.curve)) >= 0.5


def plain_line_dedup(texts):
    """Cut what pairwise diffs with earlier texts delete."""
    out = []
    for text, (own, gone) in zip(texts, plain_gone(texts, linededup.LineConfig())):
        kept, at = [], 0
        for k in sorted(gone):
            kept.append(text[at : own[k][0]] if at <= own[k][0] else "")
            at = own[k + 1][0] if k + 1 < len(own) else len(text)
        rest = "".join(kept) + text[at:] if text else text
        out.append(rest.rstrip("\n") if gone and at == len(text) else rest)
    return out


def test_pipeline_equals_plain_python(spark):
    """Each stage on all that its predecessor kept, against plain Python over small tables."""
    import corpus_pipeline as C

    sf = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 900")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    extra = [
        (10_001, None, "x", "y", 0), (10_002, "", "x", "y", 0), (10_003, rows[min(rows)], "x", "y", 0),
        (10_004, f"Own start here.\n{rows[min(rows)]}\nOwn end here.", "x", "y", 0),
        (10_005, "Mail me: jane.doe (at) mail (dot) org or 10.1.2.3", "x", "y", 0),
    ]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    state = {r.doc_id: r.text for r in docs.orderBy("doc_id").collect()}
    as_frame = lambda: docs.drop("text").join(spark.createDataFrame(sorted(state.items()), "doc_id bigint, text string"), "doc_id").select(docs.columns)
    got = lambda name: {r.doc_id: r.text for r in dict(C.STAGES)[name](spark, as_frame(), sf).collect()}

    index = toxicity.learn(docs, labels)
    asked = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 and r.doc_id in state}
    first = {}
    for n in sorted(asked):
        first.setdefault(state[n], []).append(n)
    examples = [(own[0], int(np.mean([asked[n] for n in own]) >= 0.5), Counter(toxicity.words(t.lower()))) for t, own in first.items()]
    assert sorted(n for n, _, _ in examples) == sorted(index.names.tolist()) and {y for _, y, _ in examples} == {0, 1}
    want = {n: t for n, t in state.items() if not plain_toxic(t, examples, index)}
    assert got("toxicity") == want and len(want) < len(state)
    state = want
    want = dict(zip(sorted(state), plain_line_dedup([state[n] for n in sorted(state)])))
    assert got("line_dedup") == want and want != state and want[10_003] == ""
    state = want
    prints = {n: plain_fingerprint(t or "") for n, t in state.items()}
    classes = brute_classes(set(prints.values()))
    least = {}
    for n in sorted(state):
        least.setdefault(classes[prints[n]], n)
    want = {n: state[n] for n in least.values()}
    assert got("near_dedup") == want and len(want) < len(state)
    state = want | {10_005: "Mail me: jane.doe (at) mail (dot) org or 10.1.2.3"}
    tagger = pii.trained()
    want = {n: t if t is None else pii.mask(t, pii.all_spans(tagger, [t])[1][0]) for n, t in state.items()}
    assert got("pii") == want and want[10_005] == "Mail me: [EMAIL] or [IP]"
    assert all(set(plain_spans(t or "")) <= set(pii.all_spans(tagger, [t or ""])[1][0]) for t in state.values())
    state = want
    packed = C.packing(spark, as_frame(), sf).collect()
    pieces, sequences = {}, {}
    for r in packed:
        pieces.setdefault(r.doc_id, []).append((r.start, r.ids))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for n, t in state.items():
        ids = library().encode(t or "", add_special_tokens=False).ids + [0]
        assert b"".join(raw for _, raw in sorted(pieces[n])) == np.array(ids, "<u4").tobytes()
    for own in sequences.values():
        ends = np.cumsum([size for _, size in sorted(own)])
        assert [at for at, _ in sorted(own)] == [0, *ends[:-1].tolist()] and ends[-1] <= 1024


def test_registered_names():
    import __spark_entry__ as e

    assert [sum(n.startswith(f"op{k}_") for n in e.queries()) for k in range(1, 14)] == [1] * 13 and "pipeline" in e.queries()


def test_top_k_sql(spark):
    import duckdb

    import __spark_entry__ as e

    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = sorted(c.execute(e.oracle_sql()["op9_top_k"]).fetchall())
    assert sorted(map(tuple, e.queries()["op9_top_k"](spark, SF).select("query_id", "rank", "vec_id", "score").collect())) == want
