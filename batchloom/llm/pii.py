"""Personal data: base patterns, and a character-level bidirectional LSTM with a CRF on top.

Base spans (email, ip, card, phone) are found by fixed rules, leftmost and non-overlapping
for each kind. The tagger adds spans that the rules miss, such as ``name (at) host (dot)
com`` or a phone number without its plus sign; base spans always stay. An added span may
not overlap a base span and must hold what its kind means (four parts up to 255, Luhn's check,
9 to 15 digits, an at and a dot).

Every span of the four kinds holds a digit, an at sign or a spelt ``at`` or ``dot`` by what the kinds
are, so windows lie around those places; all of a text is searched for them. Windows of
``window`` characters overlap by half. Scores of overlapping windows are averaged, weighted by
the distance from the window's edge, and one Viterbi pass over each whole region decodes
them: spans across window borders come out whole.

The tagger is trained here, in numpy, from labelled spans: ``examples`` writes sentences
with spans of the four kinds in many spellings, and look-alikes (hexadecimal strings,
failed checks, dates, versions, prices) without labels. Training is seeded and doesn't
depend on the input. ``python -m batchloom.llm.pii`` trains the standard configuration and writes
its weights beside this module; any other configuration is trained once a process.

Null texts count as empty and have no spans. Very long texts are tagged whole, some regions at a
time. Offsets are code points, the end exclusive. Of tags of equal score the first kind
counts. Equal rows give equal results; an empty table gives no rows. Extra columns are dropped by
``find`` and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # kind, start, end

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}").finditer
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+").finditer
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer
_TRIGGER = re.compile(
    r"[0-9@]|[\[({<] ?(?:at|dot) ?[\])}>]| dot | at (?=[a-z0-9-]{1,63}(?:\.[a-z]| ?[\[({<]? ?dot))", re.IGNORECASE,
).finditer
_DIGITS = re.compile(r"[0-9]").findall


def luhn(digits: list[str]) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) << (k & 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _small(part: str) -> bool:
    return len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """By kind, then start."""
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        s = at
        while s > free and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN(text, at + 1) if s < at else None
        free = m.end() if m else at + 1
        if m:
            out.append((0, s, free))
        at = text.find("@", free)
    for m in _IP(text):
        if all(map(_small, m.group().split("."))):
            out.append((1, m.start(), m.end()))
    for m in _CARD(text):
        d = _DIGITS(m.group()) if m.end() - m.start() <= 40 else ()
        if 13 <= len(d) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    for m in _PHONE(text):
        if 9 <= len(_DIGITS(m.group())) <= 15:
            out.append((3, m.start(), m.end()))
    return out


# --- labelled spans for training ---------------------------------------------------------


def _word(rng: np.random.Generator) -> str:
    parts = (
        "an", "er", "the", "ou", "re", "le", "de", "st", "ing", "ar", "os", "ich", "ung", "ti", "on", "é", "ma", "ko", "at", "dot", "ü",
        "x", "j", "w",
    )
    if rng.random() < 0.5:
        return "".join("abcdefghijklmnopqrstuvwxyz"[k] for k in rng.integers(26, size=rng.integers(2, 10)))
    return "".join(parts[k] for k in rng.integers(len(parts), size=rng.integers(1, 4)))


def _plain_word(rng: np.random.Generator) -> str:
    return _word(rng).translate(str.maketrans("éü", "eu"))


def _number(rng: np.random.Generator, n: int) -> str:
    return "".join(map(str, rng.integers(10, size=n)))


def _card_digits(rng: np.random.Generator, n: int) -> str:
    body = _number(rng, n - 1)
    return next(body + str(k) for k in range(10) if luhn(list(body + str(k))))


def _personal(rng: np.random.Generator, kind: int) -> str:
    pick = lambda *x: x[rng.integers(len(x))]
    if kind == 0:
        word = pick("at", "at", "AT", "At")
        at = pick("@", "@", f" ({word}) ", f"({word})", f"[{word}]", f" [{word}] ", f" {{{word}}} ", f" {word} ")
        stop = pick("dot", "dot", "DOT", "Dot")
        dot = pick(
            ".", ".", f" ({stop}) ", f"[{stop}]", f" {stop} ", f" [{stop}] ",
        ) if at != "@" else pick(".", f" ({stop}) ", f"[{stop}]", f" [{stop}] ")
        name = pick(
            _plain_word(rng), f"{_plain_word(rng)}.{_plain_word(rng)}", f"{_plain_word(rng)}_{_number(rng, 2)}",
            f"{_plain_word(rng)}{_number(rng, 3)}",
        )
        host = pick("", "", f"{_plain_word(rng)}-", f"{_plain_word(rng)}{dot}")
        return f"{name}{at}{host}{_plain_word(rng)}{_number(rng, rng.integers(3))}{dot}{pick('com', 'org', 'net', 'de', 'fr', 'edu', 'io')}"
    if kind == 1:
        dot = pick(".", ".", "[.]", "(.)", " . ", "[dot]", " dot ")
        return dot.join(str(rng.integers(256)) for _ in range(4))
    if kind == 2:
        n = pick(16, 16, 16, 15, 13)
        d, sep = _card_digits(rng, n), pick("", " ", "-", ".", "/", "  ", "_")
        return sep.join(d[k : k + 4] for k in range(0, n, 4))
    a, b, c = _number(rng, 3), _number(rng, 3), _number(rng, 4)
    plus = pick("+1 ", "+1 ", "", "", "1 ", "001 ")
    forms = (
        f"{plus}({a}) {b}-{c}", f"{plus}{a}-{b}-{c}", f"{plus}{a} {b} {c}", f"{plus}({a}){b} {c}", f"{plus}{a}.{b}.{c}", f"+{_number(rng, 2)} {a} {b}{c}",
        f"0{_number(rng, 3)} {_number(rng, 7)}", f"0{_number(rng, 2)}-{_number(rng, 8)}", f"(0{_number(rng, 2)}) {_number(rng, 8)}", f"00{_number(rng, 2)} {a} {b} {c}",
    )
    return pick(*forms)


def _look_alike(rng: np.random.Generator) -> str:
    kind = rng.integers(13)
    if kind == 0:
        return 'token = "' + "".join("0123456789abcdef"[k] for k in rng.integers(16, size=40)) + '"'
    if kind == 1:
        return f"Version {rng.integers(10)}.{rng.integers(20)}"
    if kind == 2:
        return f"{rng.integers(1900, 2100)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}"
    if kind == 3:
        return f"{rng.integers(1, 10**6)}.{rng.integers(100):02d} EUR"
    if kind == 4:
        return _number(rng, rng.integers(5, 13))
    if kind == 5:
        return f"@{_word(rng)}"
    if kind == 6:
        return f"{rng.integers(24)}:{rng.integers(60):02d}:{rng.integers(60):02d}"
    if kind == 7:
        return f"{rng.integers(100)}.{rng.integers(100)}.{rng.integers(100)}"
    if kind == 8:
        return f"{_word(rng)}{rng.integers(1000)}"
    if kind == 9:
        return f"{_word(rng)} at {_word(rng)} {_word(rng)}"
    if kind == 10:
        return f"the dot {_word(rng)}"
    if kind == 11:
        return f"{rng.integers(1, 13)}/{rng.integers(1, 29)}/{rng.integers(1900, 2100)} {rng.integers(100)} {rng.integers(1000)}"
    return f"({rng.integers(100)}) {rng.integers(2000)}"


def sentence(rng: np.random.Generator, least: int) -> tuple[str, list[Span]]:
    """Generated text of ``least`` characters or more, and its spans."""
    text, spans = "", []
    while len(text) < least:
        r = rng.random()
        if r < 0.16:
            kind = int(rng.integers(4))
            piece = _personal(rng, kind)
            spans.append((kind, len(text), len(text) + len(piece)))
        else:
            piece = _look_alike(rng) if r < 0.26 else _word(rng)
            if r > 0.9:
                piece = piece.capitalize()
        text += piece + (" ", " ", " ", " ", ", ", ". ", "\n", " | ", "%%% ", "!! ")[rng.integers(10)]
    return text, spans


def examples(n: int, window: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Character classes and tags of ``n`` windows of generated text."""
    rng = np.random.default_rng(seed)
    texts, tags = [], []
    for _ in range(n):
        text, spans = sentence(rng, window)
        tag = np.zeros(len(text), np.int64)
        for kind, s, e in spans:
            tag[s:e] = 2 + 2 * kind
            tag[s] -= 1
        shift = int(rng.integers(0, len(text) - window + 1))
        texts.append(classes(text[shift : shift + window]))
        tags.append(tag[shift : shift + window])
    return np.stack(texts), np.stack(tags)


# --- the tagger ---------------------------------------------------------------------------

_MARKS = " @.-+()[]{}_%/:,\n#*=\"'|!"
_N_CLASSES = 1 + 26 + 10 + len(_MARKS) + 2
_CLASS = np.full(128, _N_CLASSES - 1, np.int64)
for _k, _c in enumerate("abcdefghijklmnopqrstuvwxyz"):
    _CLASS[ord(_c)] = _CLASS[ord(_c.upper())] = 1 + _k
for _k, _c in enumerate("0123456789" + _MARKS):
    _CLASS[ord(_c)] = 27 + _k


def classes(text: str) -> np.ndarray:
    """1 to 26 letters, then digits, marks, characters beyond ASCII, and others; 0 is padding."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(cp < 128, _CLASS[np.minimum(cp, 127)], _N_CLASSES - 2)


@dataclass(frozen=True)
class TaggerConfig:
    window: int = 96
    hidden: int = 24
    embed: int = 12
    train: int = 24_000
    epochs: int = 5
    batch: int = 100
    rate: float = 0.01
    seed: int = 20


_TAGS = 1 + 2 * len(KINDS)
_NEVER = -1e4
_ALLOWED = np.zeros((_TAGS, _TAGS))
for _k in range(2, _TAGS, 2):  # inside a kind only after its begin or inside
    _ALLOWED[:, _k] = _NEVER
    _ALLOWED[[_k - 1, _k], _k] = 0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Tagger:
    """Embedding, two LSTMs, a linear layer and CRF transitions; all arrays are in ``p``.

    The arrays of the LSTMs hold both directions, forward and backward, which advance together.
    """

    def __init__(self, config: TaggerConfig):
        rng = np.random.default_rng(config.seed)
        d, h = config.embed, config.hidden
        make = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[-2]), shape)
        self.config = config
        gates = np.tile(np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)]), (2, 1, 1))
        self.p = {
            "e": rng.normal(0, 0.5, (_N_CLASSES, d)), "x": make(2, d, 4 * h), "h": make(2, h, 4 * h), "c": gates, "o": make(2 * h, _TAGS),
            "ob": np.zeros(_TAGS), "t": np.zeros((_TAGS, _TAGS)),
        }

    def _lstm(self, x: np.ndarray, keep: bool = False):
        """x: time x rows x embed. Gates stand in the order input, forget, output, candidate.

        Returns the outputs, time x rows x both directions, and what going back needs.
        """
        p, n = self.p, self.config.hidden
        both = np.stack([x, x[::-1]], axis=1)  # time x direction x rows x embed
        pre = both @ p["x"] + p["c"]
        h = np.zeros((2, x.shape[1], n), pre.dtype)
        c = np.zeros_like(h)
        out, saved = np.empty((len(x), 2, x.shape[1], n), pre.dtype), []
        for t in range(len(x)):
            z = pre[t] + h @ p["h"]
            gates, g = _sigmoid(z[..., : 3 * n]), np.tanh(z[..., 3 * n :])
            before, c = c, gates[..., n : 2 * n] * c + gates[..., :n] * g
            tc = np.tanh(c)
            if keep:
                saved.append((h, before, gates, g, tc))
            h = gates[..., 2 * n :] * tc
            out[t] = h
        return np.concatenate([out[:, 0], out[::-1, 1]], axis=2), (both, saved)

    def _lstm_back(self, grad: np.ndarray, kept: tuple, into: dict) -> np.ndarray:
        """Gradients of the parameters, added to ``into``, and of the input."""
        p, n = self.p, self.config.hidden
        both, saved = kept
        grad = np.stack([grad[:, :, :n], grad[::-1, :, n:]], axis=1)
        dz = np.empty((*both.shape[:3], 4 * n), grad.dtype)
        dh = dc = np.zeros((2, both.shape[2], n), grad.dtype)
        back = p["h"].transpose(0, 2, 1)
        for t in range(len(both) - 1, -1, -1):
            h, before, gates, g, tc = saved[t]
            i, f, o = gates[..., :n], gates[..., n : 2 * n], gates[..., 2 * n :]
            dh = dh + grad[t]
            dc = dc + dh * o * (1 - tc * tc)
            dz[t, ..., :n], dz[t, ..., n : 2 * n] = dc * g * i * (1 - i), dc * before * f * (1 - f)
            dz[t, ..., 2 * n : 3 * n], dz[t, ..., 3 * n :] = dh * tc * o * (1 - o), dc * i * (1 - g * g)
            into["h"] += h.transpose(0, 2, 1) @ dz[t]
            dh, dc = dz[t] @ back, dc * f
        for k in range(2):
            into["x"][k] += both[:, k].reshape(-1, both.shape[3]).T @ dz[:, k].reshape(-1, 4 * n)
        into["c"] += dz.sum((0, 2))[:, None]
        dx = dz @ p["x"].transpose(0, 2, 1)
        return dx[:, 0] + dx[::-1, 1]

    def scores(self, chars: np.ndarray) -> np.ndarray:
        """Tag scores, rows x time x tags, for rows of character classes."""
        out, _ = self._lstm(self.p["e"][chars.T])
        return (out @ self.p["o"] + self.p["ob"]).transpose(1, 0, 2)

    def _step(self, chars: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Loss a row, and gradients: the CRF's marginals less the labels, sent back through both LSTMs."""
        p, n = self.p, len(chars)
        both, kept = self._lstm(p["e"][chars.T], True)
        u = both @ p["o"] + p["ob"]  # time x rows x tags
        y, steps = tags.T, len(u)
        top = u.max(axis=2, keepdims=True)
        factor, move = np.exp(u - top), np.exp(p["t"]) * (_ALLOWED == 0)
        ahead, behind = np.empty_like(u), np.ones_like(u)
        log_z = top.sum()
        for t in range(steps):
            a = factor[t] if not t else (ahead[t - 1] @ move) * factor[t]
            total = a.sum(axis=1, keepdims=True)
            log_z += np.log(total).sum()
            ahead[t] = a / total
        for t in range(steps - 2, -1, -1):
            b = (behind[t + 1] * factor[t + 1]) @ move.T
            behind[t] = b / b.sum(axis=1, keepdims=True)
        du = ahead * behind
        du /= du.sum(axis=2, keepdims=True)
        enter = behind[1:] * factor[1:]
        enter /= np.einsum("tbi,ij,tbj->tb", ahead[:-1], move, enter, optimize=True)[:, :, None]
        dt = move * (ahead[:-1].reshape(-1, _TAGS).T @ enter.reshape(-1, _TAGS))
        gold = np.take_along_axis(u, y[:, :, None], 2).sum() + p["t"][y[:-1], y[1:]].sum()
        np.add.at(dt, (y[:-1].ravel(), y[1:].ravel()), -1.0)
        np.put_along_axis(du, y[:, :, None], np.take_along_axis(du, y[:, :, None], 2) - 1, 2)
        grads = {k: np.zeros_like(v) for k, v in p.items()}
        grads["t"] = dt
        grads["o"], grads["ob"] = both.reshape(-1, both.shape[2]).T @ du.reshape(-1, _TAGS), du.sum((0, 1))
        dx = self._lstm_back(du @ p["o"].T, kept, grads)
        np.add.at(grads["e"], chars.T, dx)
        return float((log_z - gold) / n), {k: g / n for k, g in grads.items()}

    def fit(self) -> list[float]:
        """Adam over the generated windows; returns the mean loss of each epoch."""
        c = self.config
        chars, tags = examples(c.train, c.window, c.seed)
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}
        rng = np.random.default_rng(c.seed + 1)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        losses, step = [], 0
        total = c.epochs * -(-len(chars) // c.batch)
        for _ in range(c.epochs):
            order, seen = rng.permutation(len(chars)), []
            for at in range(0, len(order), c.batch):
                k = order[at : at + c.batch]
                loss, grads = self._step(chars[k], tags[k])
                seen.append(loss)
                step += 1
                norm = np.sqrt(sum((g * g).sum() for g in grads.values()))
                rate = c.rate * (1 - step / (total + 1))
                for name, g in grads.items():
                    g = g * min(1.0, 5.0 / (norm + 1e-9))
                    m[name] = 0.9 * m[name] + 0.1 * g
                    v[name] = 0.999 * v[name] + 0.001 * g * g
                    self.p[name] -= np.float32(rate) * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)
            losses.append(float(np.mean(seen)))
        return losses

    def decode(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """The best tags of each region; regions of like lengths advance together."""
        trans = self.p["t"] + _ALLOWED
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(scores)
        order = sorted(range(len(scores)), key=lambda k: len(scores[k]))
        for at in range(0, len(order), 256):
            part = order[at : at + 256]
            steps = len(scores[part[-1]])
            u = np.zeros((steps, len(part), _TAGS))
            for j, k in enumerate(part):
                u[: len(scores[k]), j] = scores[k]
                u[len(scores[k]) :, j, 1:] = _NEVER  # nothing but the outside tag behind the end
            best = u[0] + np.where(np.arange(_TAGS) % 2 == 0, _NEVER, 0) * (np.arange(_TAGS) > 0)
            back = np.empty((steps, len(part), _TAGS), np.int8)
            for t in range(1, steps):
                s = best[:, :, None] + trans
                back[t] = s.argmax(1)
                best = s.max(1) + u[t]
            tag = best.argmax(1)
            path = np.empty((steps, len(part)), np.int64)
            for t in range(steps - 1, -1, -1):
                path[t] = tag
                if t:
                    tag = back[t][np.arange(len(part)), tag]
            for j, k in enumerate(part):
                out[k] = path[: len(scores[k]), j]
        return out

    def added(self, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
        """Spans of each text beside its base spans."""
        w = self.config.window
        half = w // 2
        regions: list[tuple[int, int, int]] = []
        for k, text in enumerate(texts):
            last = -1
            for m in _TRIGGER(text):
                s, e = max(0, m.start() - half), min(len(text), m.end() + half)
                if last >= 0 and s <= regions[last][2]:
                    regions[last] = (k, regions[last][1], e)
                else:
                    last = len(regions)
                    regions.append((k, s, e))
        found: list[list[Span]] = [[] for _ in texts]
        near = np.minimum(np.arange(1, w + 1), np.arange(w, 0, -1)).astype(np.float32)[:, None]
        for at in range(0, len(regions), 256):
            part = regions[at : at + 256]
            rows, where = [], []
            for j, (k, s, e) in enumerate(part):
                own = classes(texts[k][s:e])
                for start in range(0, max(1, len(own) - half), half):
                    row = own[start : start + w]
                    rows.append(np.pad(row, (0, w - len(row))))
                    where.append((j, start, len(row)))
            total = [np.zeros((e - s, _TAGS), np.float32) for _, s, e in part]
            weight = [np.zeros((e - s, 1), np.float32) for _, s, e in part]
            for b in range(0, len(rows), 512):
                for (j, start, n), u in zip(where[b : b + 512], self.scores(np.stack(rows[b : b + 512]))):
                    total[j][start : start + n] += u[:n] * near[:n]
                    weight[j][start : start + n] += near[:n]
            for (k, s, _), tags in zip(part, self.decode([t / x for t, x in zip(total, weight)])):
                begins = np.flatnonzero(tags % 2 == 1)
                for p in begins.tolist():
                    kind, q = (int(tags[p]) - 1) // 2, p + 1
                    while q < len(tags) and tags[q] == tags[p] + 1:
                        q += 1
                    one = _trim(texts[k], kind, s + p, s + q)
                    if one and not any(one[1] < b[2] and b[1] < one[2] for b in base[k]):
                        found[k].append(one)
        return found


_AT = re.compile(
    r"[^\s@]+ ?(?:@|[\[({<] ?at ?[\])}>]|(?<= )at(?= )) ?[a-z0-9-]+(?: ?(?:\.|[\[({<] ?dot ?[\])}>]|(?<= )dot(?= )) ?[a-z0-9-]+)+",
    re.IGNORECASE,
).match


def _trim(text: str, kind: int, start: int, end: int) -> Span | None:
    """The span without blanks and stops at its ends, if it holds what its kind means."""
    while start < end and text[start] in " \n.,;:":
        start += 1
    while start < end and text[end - 1] in " \n.,;:":
        end -= 1
    own = text[start:end]
    if start and text[start - 1].isalnum() and own[:1].isalnum() or end < len(text) and text[end].isalnum() and own[-1:].isalnum():
        return None  # a part of a longer word or number
    digits = _DIGITS(own)
    if kind == 0:
        m = _AT(own)
        good, end = m is not None, start + m.end() if m else end  # words behind the address aren't its own
    elif kind == 1:
        parts = re.findall("[0-9]+", own)
        good = len(parts) == 4 and all(map(_small, parts))
    elif kind == 2:
        good = 13 <= len(digits) <= 19 and luhn(digits)
    else:
        good = 9 <= len(digits) <= 15
    return (kind, start, end) if good else None


WEIGHTS = Path(__file__).with_name("pii_weights.json")


@lru_cache(maxsize=4)
def trained(config: TaggerConfig = TaggerConfig()) -> Tagger:
    """With the stored weights, if they are those of this configuration; else trained here."""
    tagger = Tagger(config)
    stored = json.loads(WEIGHTS.read_text()) if WEIGHTS.exists() else {}
    if stored.get("config") == asdict(config):
        tagger.p = {k: np.array(stored["weights"][k], np.float32).reshape(x.shape) for k, x in tagger.p.items()}
    else:
        tagger.fit()
    return tagger


def store(config: TaggerConfig = TaggerConfig(), path: Path = WEIGHTS) -> list[float]:
    """Train and write the weights, four significant digits each."""
    tagger = Tagger(config)
    losses = tagger.fit()
    weights = {k: [float(f"{v:.4g}") for v in x.ravel().tolist()] for k, x in tagger.p.items()}
    path.write_text(json.dumps({"config": asdict(config), "weights": weights}))
    return losses


def all_spans(tagger: Tagger, texts: list[str]) -> tuple[list[list[Span]], list[list[Span]]]:
    """Base spans and all spans of each text, both by kind, then start."""
    base = [base_spans(t) for t in texts]
    return base, [sorted(b + a) for b, a in zip(base, tagger.added(texts, base))]


def spell(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find(df: DataFrame, config: TaggerConfig = TaggerConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base counts by kind, base_sha256 and all spans."""
    tagger = df.sparkSession.sparkContext.broadcast(trained(config))
    narrow = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                base, spans = all_spans(tagger.value, part.column(1).to_pylist())
                counts = [pa.array([sum(s[0] == k for s in x) for x in base], pa.int64()) for k in range(4)]
                sums = [hashlib.sha256(spell(x).encode()).hexdigest() for x in base]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *counts, pa.array(sums, pa.string()), pa.array([spell(x) for x in spans], pa.string())], names,
                )

    return narrow.mapInArrow(run, schema)


def mask(text: str, spans: list[Span]) -> str:
    """Each span, or run of overlapping spans, as the name of its first kind in brackets."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{KINDS[kind].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, config: TaggerConfig = TaggerConfig(), text_col: str = "text") -> DataFrame:
    """``df`` with its spans masked in ``text_col``; null texts stay null."""
    tagger = df.sparkSession.sparkContext.broadcast(trained(config))
    place = df.columns.index(text_col)
    schema = T.StructType(df.schema.fields)
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                texts = part.column(place).to_pylist()
                _, spans = all_spans(tagger.value, [t or "" for t in texts])
                columns = list(part.columns)
                columns[place] = pa.array([t if t is None else mask(t, s) for t, s in zip(texts, spans)], columns[place].type)
                yield pa.RecordBatch.from_arrays(columns, names)

    return df.mapInArrow(run, schema)


if __name__ == "__main__":
    print(store())
