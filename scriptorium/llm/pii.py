"""Personal data by a character BiLSTM with CRF transitions, trained in numpy.

Base patterns find e-mail addresses, IP addresses, payment cards and international phone
numbers. The tagger adds spans that these miss: national phone numbers, IPv6 addresses, addresses with
blanks about the at-sign, cards with other marks between their digits. It reads characters by class in overlapping windows; each window is decoded by
Viterbi over learned transitions, and windows are reconciled globally: a character takes the
tag of the window in which it stands most central, and spans are read off the joined tags.

Labelled spans come from a seeded generator (:class:`Generator`), so training is
bounded, needs no labels in the corpus and gives the same model everywhere. The weights that the
training gives are kept beside this module (:func:`store`), with the parameters that made them. Every kind has a
digit or an at-sign in it: windows without either can hold no span and are passed over.
"""

from __future__ import annotations

import hashlib
import ipaddress
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.runtime import without_overlaps

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
WINDOW = 96
STRIDE = 48
HIDDEN = 24
DIMS = 12
TRAIN_WINDOWS = 6000
TRAIN_ROUNDS = 9
BATCH = 64
DECODE_WINDOWS = 512  # decoded at once
LEAST_LENGTH = {"email": 6, "ip": 7, "card": 12, "phone": 9}

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")  # possessive: the same matches in linear time
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of the base patterns, in code points."""
    out: list[tuple[int, int, str]] = []
    if "@" in text:
        out += _emails(text)
    if _DIGITS.search(text):
        out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return _ordered(out)


def _emails(text: str) -> list[tuple[int, int, str]]:
    """Matches of the e-mail pattern; only the run before each at-sign is tried, in linear time."""
    out, done = [], 0
    for at in re.finditer("@", text):
        start = at.start()
        while start > done and (c := text[start - 1]) < "\x7f" and (c.isalnum() or c in "._%+-"):
            start -= 1
        if start < at.start() and (m := _EMAIL.match(text, start)):
            out.append((m.start(), m.end(), "email"))
            done = m.end()
    return out


def _ordered(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def digest(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


# Character classes -------------------------------------------------------------------

_MARKS = "@._%+-()/: \n,;\"'=#"
CLASSES = 8 + len(_MARKS)


@lru_cache(maxsize=1)
def _class_table() -> np.ndarray:
    table = np.full(0x110000, 7, np.int8)  # non-ASCII
    table[:128] = 6
    for c in range(128):
        ch = chr(c)
        if ch.isdigit():
            table[c] = 1
        elif "a" <= ch.lower() <= "z":
            table[c] = 2 if ch.islower() else 3
        elif ch in _MARKS:
            table[c] = 8 + _MARKS.index(ch)
    return table


def classes_of(text: str) -> np.ndarray:
    """Class of each code point; 0 is padding."""
    return _class_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]


# Labelled spans ----------------------------------------------------------------------


class Generator:
    """Seeded texts with labelled spans, and look-alikes that are none."""

    def __init__(self, seed: int) -> None:
        self.rng = np.random.default_rng(seed)
        self.letters = np.array(list("etaoinshrdlucmfwypvbgkqjxz"))
        odds = np.arange(len(self.letters), 0, -1.0)
        self.odds = odds / odds.sum()

    def pick(self, *options: str) -> str:
        return options[self.rng.integers(len(options))]

    def digits(self, k: int, first: str = "") -> str:
        return first + "".join(map(str, self.rng.integers(0, 10, max(0, k - len(first)))))

    def word(self, low: int = 1, high: int = 11) -> str:
        return "".join(self.rng.choice(self.letters, self.rng.integers(low, high), p=self.odds))

    def grouped(self, number: str, groups: tuple[int, ...], mark: str) -> str:
        parts, at = [], 0
        for g in groups:
            parts.append(number[at : at + g])
            at += g
        return mark.join(p for p in (*parts, number[at:]) if p)

    def email(self) -> str:
        name = self.pick(self.word(2, 9), self.word(2, 7) + "." + self.word(2, 8), self.word(2, 8) + "." + self.digits(2), self.word(2, 6) + "_" + self.digits(3), self.word(2, 6) + "+" + self.word(2, 5))
        host = self.pick(self.word(3, 9), "mail" + self.digits(1), self.word(2, 6) + "-" + self.word(2, 6)) + self.pick("", ".example") + self.pick(".com", ".org", ".net", ".de", ".fr", ".co.uk")
        return name + self.pick("@", "@", "@", " @ ") + host

    def ip(self) -> str:
        if self.rng.random() < 0.5:
            return ".".join(str(x) for x in self.rng.integers(0, 256, 4))
        group = lambda: f"{self.rng.integers(0, 65536):{self.pick('x', 'x', '04x')}}"
        head = self.pick("2001", "2001", "fe80", "fd00", "2a02", group())
        groups = lambda low, high: ":".join(group() for _ in range(int(self.rng.integers(low, high))))
        return self.pick(f"{head}:{groups(7, 8)}", f"{head}:{groups(1, 3)}::{groups(1, 4)}", f"{head}::{groups(1, 5)}", f"{head}:{groups(1, 4)}::{groups(1, 3)}")

    def card(self) -> str:
        number = self.digits(15, self.pick("4", "5", "37", "6011"))
        number += next(c for c in "0123456789" if luhn(number + c))
        return self.pick(number, *(self.grouped(number, (4, 4, 4, 4), mark) for mark in (" ", "-", " ", "-", ".", "  ", " - ", "/")))

    def phone(self) -> str:
        area, mid, last = self.digits(3, self.pick(*"23456789")), self.digits(3), self.digits(4)
        country, city, own = str(self.rng.integers(1, 99)), self.digits(int(self.rng.integers(3, 6)), "0"), self.digits(int(self.rng.integers(6, 9)))
        pairs = [self.digits(2) for _ in range(4)]
        return self.pick(
            f"+{country} ({area}) {mid}-{last}", f"+{country} {area} {mid} {last}", f"+{country}{area}{mid}{last}", f"({area}) {mid}-{last}", f"({area}) {mid} {last}", f"{area}-{mid}-{last}", f"{area}-{mid}-{last}", f"{area}.{mid}.{last}", f"{area} {mid} {last}", f"{area} {mid} {last}",
            f"1-{area}-{mid}-{last}", f"({city}) {own}", f"{city} {own}", f"{city}/{own}", f"{city}-{own}", f"00{country} {area} {own}", f"{city} {own[:3]} {own[3:]}", " ".join(["0" + self.digits(1), *pairs]), "-".join([self.digits(2), *pairs]), ".".join(["0" + self.digits(1), *pairs]),
        )

    def label(self, kind: str) -> str:
        """What may stand before a span of a kind."""
        names = {"phone": ("tel", "Tel.", "phone", "call", "mobile", "fax", "ph", "Telefon", "contact"), "email": ("mail", "e-mail", "write to", "contact"), "ip": ("host", "ip", "from", "server", "addr"), "card": ("card", "visa", "card no.", "paid with")}
        return self.pick(*names[kind]) + self.pick(" ", ": ", " ", " = ", ":")

    def decoy(self) -> str:
        digits, rng, word = self.digits, self.rng, self.word
        return self.pick(
            digits(int(rng.integers(1, 9))), f"{rng.integers(1, 13)}/{rng.integers(1, 29)}/{rng.integers(1990, 2030)}", f"{rng.integers(1990, 2030)}-{digits(2)}-{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(1)}",
            f"{digits(2)}.{digits(2)}", f"${digits(3)},{digits(3)}", "@" + word(3, 9), word(2, 5) + digits(3), "".join(rng.choice(list("0123456789abcdef"), 40)), f"{digits(2)}:{digits(2)}:{digits(2)}", f"({rng.integers(1, 99)})", f"# {digits(4)}", f"{digits(3)}%",
            "https://" + word(3, 8) + ".com/" + digits(5), f"{digits(1)}, {digits(2)}, {digits(3)}", f"ISBN {digits(3)}-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}",
            f"{digits(3)} {digits(2)}", f"{rng.integers(1990, 2030)} {rng.integers(1990, 2030)}", f"{digits(1)},{digits(3)},{digits(3)}", f"{digits(2)}-{digits(2)}", f"{digits(4)}-{digits(4)}", f"{rng.integers(1, 29)}.{rng.integers(1, 13)}.{rng.integers(1990, 2030)}", ":".join("".join(rng.choice(list("0123456789abcdef"), 2)) for _ in range(6)),
            f"{rng.integers(1990, 2030)}-{digits(2)}-{digits(2)} {digits(2)}:{digits(2)}:{digits(2)}", f"v{digits(1)}.{digits(2)}.{digits(3)}", f"{digits(3)} of {digits(4)}", f"pp. {digits(3)}-{digits(3)}", digits(int(rng.integers(9, 25))), f"{word(2, 5)}@{digits(2)}", f"{digits(2)} {digits(1)} {digits(2)} {digits(1)}",
        )

    def text(self, least: int) -> tuple[str, list[int]]:
        """Words, spans and look-alikes of at least so many characters, with a tag a character."""
        rng, text, tags = self.rng, "", []
        while len(text) < least:
            kind = self.pick(*KINDS, "phone") if rng.random() < 0.16 else None
            if kind:
                if rng.random() < 0.4:
                    before = self.label(kind)
                    text, tags = text + before, tags + [0] * len(before)
                part = getattr(self, kind)()
            else:
                part = self.decoy() if rng.random() < 0.17 else self.word()
                if rng.random() < 0.1:
                    part = part.upper() if rng.random() < 0.4 else part.capitalize()
                if rng.random() < 0.06:
                    part = part[: len(part) // 2] + self.pick("é", "ü", "ñ", "ß") + part[len(part) // 2 :]
            text += part
            tags += [1 + 2 * KINDS.index(kind)] + [2 + 2 * KINDS.index(kind)] * (len(part) - 1) if kind else [0] * len(part)
            gap = self.pick(" ", " ", " ", " ", " ", ", ", ". ", "\n", "### ", "&&& ", " | ", ": ", "; ")
            text += gap
            tags += [0] * len(gap)
        return text, tags


def labelled_windows(n: int = TRAIN_WINDOWS, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Generated windows with character tags; a third of them are whole short texts, as short documents give them."""
    made = Generator(seed)
    x = np.zeros((n, WINDOW), np.int64)
    y = np.zeros((n, WINDOW), np.int64)
    for row in range(n):
        if made.rng.random() < 0.33:
            text, tags = made.text(int(made.rng.integers(1, WINDOW)))
            if made.rng.random() < 0.5:
                text, tags = text.rstrip(), tags[: len(text.rstrip())]
            cut = 0
        else:
            text, tags = made.text(WINDOW + 40)
            cut = int(made.rng.integers(0, len(text) - WINDOW + 1))
            while cut and tags[cut] and tags[cut] % 2 == 0:  # a window begins outside or at a span's start
                cut -= 1
        own = classes_of(text[cut : cut + WINDOW])
        x[row, : len(own)] = own
        y[row, : len(own)] = tags[cut : cut + WINDOW]
    return x, y


def labelled_texts(n: int, seed: int, least: int = 30) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Generated texts with their spans, to measure the tagger on."""
    made, out = Generator(seed), []
    for _ in range(n):
        text, tags = made.text(int(made.rng.integers(least, 4 * WINDOW)))
        starts = [i for i, t in enumerate(tags) if t % 2 == 1]
        ends = [next((j for j in range(i + 1, len(tags)) if tags[j] != tags[i] + 1), len(tags)) for i in starts]
        out.append((text, [(i, j, KINDS[(tags[i] - 1) // 2]) for i, j in zip(starts, ends)]))
    return out


# Network -----------------------------------------------------------------------------


def _sigmoid(a: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-a))


class Tagger:
    """Embedding, forward and backward LSTM, emission layer, CRF transitions."""

    def __init__(self, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.w = {"embed": normal(CLASSES, DIMS, scale=0.5), "out": normal(2 * HIDDEN, len(TAGS), scale=0.2), "out_b": np.zeros(len(TAGS), np.float32), "trans": np.zeros((len(TAGS), len(TAGS)), np.float32)}
        for side in "fb":
            self.w[f"{side}x"] = normal(DIMS, 4 * HIDDEN, scale=0.3)
            self.w[f"{side}h"] = normal(HIDDEN, 4 * HIDDEN, scale=0.2)
            self.w[f"{side}b"] = np.concatenate((np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN))).astype(np.float32)
        allowed = np.zeros((len(TAGS), len(TAGS)), np.float32)
        for j, tag in enumerate(TAGS):
            if tag[0] == "I":
                allowed[:, j] = -1e4
                allowed[j - 1, j] = allowed[j, j] = 0
        self.allowed = allowed

    def _lstm(self, x: np.ndarray, side: str) -> tuple[np.ndarray, list]:
        """x: time by batch by dims, in the side's own direction."""
        h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
        pre = x @ self.w[f"{side}x"] + self.w[f"{side}b"]
        out, kept = np.empty((len(x), x.shape[1], HIDDEN), np.float32), []
        for t in range(len(x)):
            a = pre[t] + h @ self.w[f"{side}h"]
            gates = _sigmoid(a[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(a[:, 3 * HIDDEN :])
            before, was = c, h
            c = f * c + i * g
            s = np.tanh(c)
            h = o * s
            out[t] = h
            kept.append((i, f, o, g, before, s, was))
        return out, kept

    def _lstm_back(self, x: np.ndarray, side: str, kept: list, d_out: np.ndarray, grads: dict) -> np.ndarray:
        d_pre = np.empty((len(x), x.shape[1], 4 * HIDDEN), np.float32)
        d_h = np.zeros((x.shape[1], HIDDEN), np.float32)
        d_c = np.zeros_like(d_h)
        w_h = self.w[f"{side}h"]
        for t in reversed(range(len(x))):
            i, f, o, g, before, s, was = kept[t]
            d_h = d_h + d_out[t]
            d_c = d_c + d_h * o * (1 - s * s)
            d_pre[t] = np.concatenate((d_c * g * i * (1 - i), d_c * before * f * (1 - f), d_h * s * o * (1 - o), d_c * i * (1 - g * g)), axis=1)
            grads[f"{side}h"] += was.T @ d_pre[t]
            d_h = d_pre[t] @ w_h.T
            d_c = d_c * f
        flat = d_pre.reshape(-1, 4 * HIDDEN)
        grads[f"{side}x"] += x.reshape(-1, DIMS).T @ flat
        grads[f"{side}b"] += flat.sum(axis=0)
        return d_pre @ self.w[f"{side}x"].T

    def emissions(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Tag scores (time by batch by tag) of windows (batch by time)."""
        e = self.w["embed"][x.T]
        ahead, kept_f = self._lstm(e, "f")
        back, kept_b = self._lstm(e[::-1], "b")
        both = np.concatenate((ahead, back[::-1]), axis=2)
        return both @ self.w["out"] + self.w["out_b"], (e, kept_f, kept_b, both)

    def _crf(self, scores: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Loss a window, and its gradients for emissions and transitions."""
        trans = self.w["trans"] + self.allowed
        steps, size = scores.shape[:2]
        up = np.empty_like(scores)
        down = np.zeros_like(scores)
        start = np.array([-1e4 if t[0] == "I" else 0 for t in TAGS], np.float32)
        up[0] = scores[0] + start
        for t in range(1, steps):
            a = up[t - 1][:, :, None] + trans
            m = a.max(axis=1)
            up[t] = m + np.log(np.exp(a - m[:, None]).sum(axis=1)) + scores[t]
        for t in range(steps - 2, -1, -1):
            a = trans + (scores[t + 1] + down[t + 1])[:, None, :]
            m = a.max(axis=2)
            down[t] = m + np.log(np.exp(a - m[:, :, None]).sum(axis=2))
        last = up[-1]
        m = last.max(axis=1)
        z = m + np.log(np.exp(last - m[:, None]).sum(axis=1))
        d_scores = np.exp(up + down - z[:, None])
        d_trans = np.zeros_like(trans)
        for t in range(1, steps):
            d_trans += np.exp(up[t - 1][:, :, None] + trans + (scores[t] + down[t])[:, None, :] - z[:, None, None]).sum(axis=0)
        gold, who = y.T, np.arange(size)
        score = scores[np.arange(steps)[:, None], who, gold].sum(axis=0) + trans[gold[:-1], gold[1:]].sum(axis=0)
        d_scores[np.arange(steps)[:, None], who, gold] -= 1
        np.subtract.at(d_trans, (gold[:-1].ravel(), gold[1:].ravel()), 1)
        return float((z - score).mean()), d_scores / size, d_trans / size

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = TRAIN_ROUNDS, rate: float = 0.012, seed: int = 5) -> list[float]:
        """Adam over shuffled batches; returns the mean loss of each round."""
        rng = np.random.default_rng(seed)
        moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.w.items()}
        step, losses = 0, []
        for turn in range(rounds):
            order, total = rng.permutation(len(x)), []
            for at in range(0, len(order), BATCH):
                own = order[at : at + BATCH]
                grads = {k: np.zeros_like(v) for k, v in self.w.items()}
                scores, (e, kept_f, kept_b, both) = self.emissions(x[own])
                loss, d, grads["trans"] = self._crf(scores, y[own])
                total.append(loss)
                grads["out"] = both.reshape(-1, 2 * HIDDEN).T @ d.reshape(-1, len(TAGS))
                grads["out_b"] = d.sum(axis=(0, 1))
                d_both = d @ self.w["out"].T
                d_e = self._lstm_back(e, "f", kept_f, d_both[:, :, :HIDDEN], grads)
                d_e = d_e + self._lstm_back(e[::-1], "b", kept_b, d_both[::-1, :, HIDDEN:], grads)[::-1]
                np.add.at(grads["embed"], x[own].T, d_e)
                step += 1
                pace = rate * (1 - 0.8 * (turn / rounds)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k, g in grads.items():
                    m, v = moment[k]
                    g = np.clip(g, -1, 1).astype(np.float32)
                    m *= 0.9
                    m += 0.1 * g
                    v *= 0.999
                    v += 0.001 * g * g
                    self.w[k] -= (pace * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
            losses.append(float(np.mean(total)))
        return losses

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best tag path of each window (batch by time)."""
        scores, _ = self.emissions(x)
        trans = self.w["trans"] + self.allowed
        steps, size = scores.shape[:2]
        back = np.empty((steps, size, len(TAGS)), np.int8)
        now = scores[0]  # a window may begin inside a span
        for t in range(1, steps):
            a = now[:, :, None] + trans
            back[t] = a.argmax(axis=1)
            now = a.max(axis=1) + scores[t]
        path = np.empty((size, steps), np.int8)
        path[:, -1] = now.argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            path[:, t - 1] = back[t][np.arange(size), path[:, t]]
        return path


STORED = os.path.join(os.path.dirname(os.path.abspath(__file__)), "pii_weights.npz")


def fitted(windows: int = TRAIN_WINDOWS, rounds: int = TRAIN_ROUNDS) -> Tagger:
    """A tagger trained from its seeds; the same seeds give the same weights (to rounding)."""
    tagger = Tagger()
    tagger.fit(*labelled_windows(windows), rounds=rounds)
    return tagger


def store(tagger: Tagger, path: str = STORED) -> None:
    """Keep the weights of :func:`fitted` with its parameters, so that scans need not train."""
    np.savez_compressed(path, made_of=np.array([TRAIN_WINDOWS, TRAIN_ROUNDS, HIDDEN, DIMS, CLASSES]), **tagger.w)


@lru_cache(maxsize=4)
def trained(windows: int = TRAIN_WINDOWS, rounds: int = TRAIN_ROUNDS) -> Tagger:
    """The tagger: the stored weights where they were made with these parameters, else trained once in a process."""
    if os.path.exists(STORED):
        with np.load(STORED) as stored:
            if stored["made_of"].tolist() == [windows, rounds, HIDDEN, DIMS, CLASSES]:
                tagger = Tagger()
                tagger.w = {name: stored[name] for name in tagger.w}
                return tagger
    return fitted(windows, rounds)


# Scan --------------------------------------------------------------------------------


def windows_of(text: str) -> list[int]:
    """Starts of the overlapping windows that have a digit or an at-sign."""
    last = max(0, -(-(len(text) - WINDOW) // STRIDE))
    found: set[int] = set()
    for m in _TRIGGER.finditer(text):
        k = m.start() // STRIDE
        found.update(i for i in (k - 1, k) if 0 <= i <= last)
    return [i * STRIDE for i in sorted(found)]


def reconcile(length: int, starts: list[int], paths: np.ndarray) -> dict[int, tuple[int, np.ndarray]]:
    """Tags of each covered stretch: every character from its most central window."""
    stretches: dict[int, tuple[int, np.ndarray]] = {}
    at = 0
    while at < len(starts):
        stop = at + 1
        while stop < len(starts) and starts[stop] == starts[stop - 1] + STRIDE:
            stop += 1
        begin, end = starts[at], min(length, starts[stop - 1] + WINDOW)
        tags = np.zeros(end - begin, np.int8)
        best = np.full(end - begin, -1)
        central = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1))
        for i in range(at, stop):
            a = starts[i] - begin
            n = min(WINDOW, end - begin - a)
            reach = central[:n].copy()
            if starts[i] == 0:
                reach[: WINDOW // 2] = WINDOW
            if starts[i] + n == length:
                reach[WINDOW // 2 :] = WINDOW
            better = reach > best[a : a + n]
            tags[a : a + n][better] = paths[i][:n][better]
            best[a : a + n][better] = reach[better]
        stretches[begin] = (end, tags)
        at = stop
    return stretches


def tagged_spans(text: str, starts: list[int], paths: np.ndarray) -> list[tuple[int, int, str]]:
    """Plausible spans off the reconciled tags."""
    out = []
    for begin, (_, tags) in reconcile(len(text), starts, paths).items():
        at = 0
        while at < len(tags):
            if not tags[at]:
                at += 1
                continue
            kind = (int(tags[at]) - 1) // 2
            stop = at + 1
            while stop < len(tags) and tags[stop] == 2 + 2 * kind:
                stop += 1
            start, end = begin + at, begin + stop
            if plausible(text, start, end, KINDS[kind]):
                out.append((start, end, KINDS[kind]))
            at = stop
    return out


def plausible(text: str, start: int, end: int, kind: str) -> bool:
    """A tagged span stands free and has its kind's make-up."""
    span = text[start:end]
    digits = "".join(c for c in span if "0" <= c <= "9")
    if len(span) < LEAST_LENGTH[kind] or span[0].isspace() or span[-1].isspace():
        return False
    if (start and text[start - 1].isalnum() and span[0].isalnum()) or (end < len(text) and text[end].isalnum() and span[-1].isalnum()):
        return False
    if kind == "email":
        name, _, host = span.partition("@")
        return span.count("@") == 1 and not any(c.isspace() for c in name.rstrip(" ") + host.lstrip(" ")) and bool(_EMAIL.fullmatch(f"{name.rstrip(' ')}@{host.lstrip(' ')}"))
    if kind == "ip" and ":" in span:
        return _is_ipv6(span)
    if any(c.isalpha() for c in span):
        return False
    if kind == "ip":
        parts = span.split(".")
        return len(parts) == 4 and all(p.isdecimal() and p.isascii() and len(p) < 4 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and not span.isdecimal() and "\n" not in span


def _is_ipv6(span: str) -> bool:
    try:
        return ipaddress.IPv6Address(span).version == 6
    except ValueError:
        return False


def scan_texts(texts: list[str], tagger: Tagger) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text; windows of all texts are decoded together."""
    base = [base_spans(t) for t in texts]
    starts = [windows_of(t) for t in texts]
    owner = [(i, s) for i, own in enumerate(starts) for s in own]
    added: list[list] = [[] for _ in texts]
    pending: dict[int, list[np.ndarray]] = {}
    for at in range(0, len(owner), DECODE_WINDOWS):
        some = owner[at : at + DECODE_WINDOWS]
        x = np.zeros((len(some), WINDOW), np.int64)
        for row, (i, s) in enumerate(some):
            piece = classes_of(texts[i][s : s + WINDOW])
            x[row, : len(piece)] = piece
        for (i, _), path in zip(some, tagger.decode(x)):
            pending.setdefault(i, []).append(path)
    for i, paths in pending.items():
        added[i] = tagged_spans(texts[i], starts[i], np.stack(paths))
    out = []
    for own, more in zip(base, added):
        free = without_overlaps(more, own)
        out.append((own, _ordered(own + free)))
    return out


def scan_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_windows: int = TRAIN_WINDOWS, rounds: int = TRAIN_ROUNDS) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    Counts and ``base_sha256`` are over the base patterns' spans, ``spans`` has the tagger's
    too (``n_added`` of them, under the same kinds). Offsets are
    code points, ends exclusive. Null and empty texts have no spans. Every row gives one
    row, repeats and null ids too; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trained(train_windows, rounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                found = scan_texts(batch.column(1).to_pylist(), shared.value)
                counts = [pa.array([sum(s[2] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
                hashes = pa.array([hashlib.sha256(digest(base).encode()).hexdigest() for base, _ in found])
                yield pa.RecordBatch.from_arrays([batch.column(0), *counts, hashes, pa.array([digest(spans) for _, spans in found]), pa.array([len(spans) - len(base) for base, spans in found], pa.int64())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return source.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
