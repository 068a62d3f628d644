"""Runs of periodic words, by the runs theorem.

A run is a stretch of words with smallest period q that can't be made longer. The theorem: of
every run, a root (one period of it) is the longest Lyndon word at its place, under the order of
the words' codes or under its reverse. So there are at most two candidates a place:

* The longest Lyndon word at a place ends before the next smaller value of the inverse suffix
  array (under the reverse order, the next greater one; the end of a text is a letter
  below all others in one order and above them in the other).
* The candidate [i, j) has period q = j - i. The common prefix of the suffixes at i and j and the
  common suffix of what ends before i and j, both by range minima of an LCP array in a sparse table,
  extend it to its run.

All this is done in numpy for many texts at a time. Places are ranked within their text
from the start, so no time goes into comparing copies with each other. Ranks come from
prefix doubling in which only places that are not told apart yet are sorted again; the LCP array
is read off the doubling's ranks.

Memory is about 60 words of 8 bytes a word of a batch, and a batch has ``BATCH_WORDS`` words or one text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.runtime import release_memory, text_bytes

LEAST_WORDS = 6
LEAST_PERIODS = 4
BATCH_WORDS = 1 << 18


class Suffixes:
    """Suffix array, inverse, and common prefixes of many texts of codes.

    ``codes`` are nonnegative; ``starts`` are the texts' first places. Each text is followed
    by a place of its own with code 0, its end, which is below its words (1 and more).
    """

    def __init__(self, codes: np.ndarray, text: np.ndarray) -> None:
        n = len(codes)
        _, first = np.unique(text * (int(codes.max(initial=0)) + 1) + codes, return_inverse=True)
        self.levels: list[tuple[int, np.ndarray]] = [(1, first.astype(np.int32))]
        rank, step = first, 1
        order = np.argsort(rank, kind="stable")
        rank, open_ = self._ranked(rank, order, np.ones(n, bool))
        while len(open_):
            # places whose rank is shared are sorted again by the rank one step on, within their group
            on = open_ + step
            pairs = rank[open_] * (n + 1) + rank[np.minimum(on, n - 1)] + 1
            local = np.argsort(pairs, kind="stable")
            taken = np.sort(rank[open_])  # first places of the groups, as often as they have members
            base = self._places(taken)
            new = rank.copy()
            at, sorted_pairs = open_[local], pairs[local]
            head = np.concatenate(([True], sorted_pairs[1:] != sorted_pairs[:-1]))
            new[at] = np.maximum.accumulate(np.where(head, base, 0))
            step *= 2
            self.levels.append((step, new.astype(np.int32)))
            alone = head & np.concatenate((head[1:], [True]))
            rank, open_ = new, np.sort(at[~alone])
        self.rank = rank

    @staticmethod
    def _ranked(rank: np.ndarray, order: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A place's rank as the first place of its group in the order; and the places that share one."""
        own = rank[order]
        head = np.concatenate(([True], own[1:] != own[:-1])) if len(own) else np.zeros(0, bool)
        out = np.empty(len(rank), np.int64)
        out[order] = np.maximum.accumulate(np.where(head, np.arange(len(own)), 0)) if len(own) else 0
        alone = head & np.concatenate((head[1:], [True])) if len(own) else head
        return out, np.sort(order[~alone])

    @staticmethod
    def _places(taken: np.ndarray) -> np.ndarray:
        """Places in the order of the members of groups that begin at the given ones."""
        head = np.concatenate(([True], taken[1:] != taken[:-1]))
        index = np.arange(len(taken))
        return taken + index - np.maximum.accumulate(np.where(head, index, 0))

    @cached_property
    def lcp(self) -> np.ndarray:
        """lcp[r]: letters that the suffixes of rank r - 1 and r have in common."""
        order = np.empty(len(self.rank), np.int64)
        order[self.rank] = np.arange(len(order))
        out = np.zeros(len(order), np.int64)
        a, b, at = order[:-1].copy(), order[1:].copy(), np.arange(1, len(order))
        last = len(order) - 1
        for step, ranks in reversed(self.levels):
            same = (ranks[np.minimum(a, last)] == ranks[np.minimum(b, last)]) & (np.maximum(a, b) <= last)
            out[at[same]] += step
            a[same] += step
            b[same] += step
        return out

    @cached_property
    def minima(self) -> list[np.ndarray]:
        """Sparse table: level k has the least of 2**k entries of the LCP array from each one on."""
        table, width = [self.lcp.astype(np.int32)], 1
        while 2 * width <= len(self.lcp):
            table.append(np.minimum(table[-1][:-width], table[-1][width:]))
            width *= 2
        return table

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Letters that the suffixes at i and at j, different places, have in common."""
        low, high = np.minimum(self.rank[i], self.rank[j]) + 1, np.maximum(self.rank[i], self.rank[j]) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            own = level == k
            row = self.minima[k]
            out[own] = np.minimum(row[low[own]], row[high[own] - (1 << int(k))])
        return out


def next_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the next one with a smaller value, len(values) where there is none.

    Pointers jump over what is known to be greater: whatever lies between a place and its
    pointer is greater than its value, and a pointer's own pointer keeps that.
    """
    n = len(values)
    out = np.arange(1, n + 1)
    held = np.append(values, np.iinfo(np.int64).min)
    out = np.append(out, n)
    open_ = np.flatnonzero(held[out[:n]] > values)
    while len(open_):
        out[open_] = out[out[open_]]
        open_ = open_[held[out[open_]] > values[open_]]
    return out[:n]


@dataclass
class Runs:
    """Runs of many texts, by text, start and period."""

    text: np.ndarray
    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def find_runs(codes: np.ndarray, sizes: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> Runs:
    """Runs of at least ``least_words`` words and ``least_periods`` (2 or more) periods.

    ``codes`` are the texts' words one after the other, equal for equal words; ``sizes`` the texts' numbers of words.
    """
    ends = np.cumsum(sizes + 1) - 1  # the place of each text's end
    text = np.repeat(np.arange(len(sizes)), sizes + 1)
    letters = np.zeros(len(text), np.int64)
    letters[np.arange(len(text)) != ends[text]] = codes + 1
    suffixes = Suffixes(letters, text)
    place = np.arange(len(letters))
    up = next_smaller(suffixes.rank)  # an end's rank is below all of its text
    down = next_smaller(-suffixes.rank)
    i = np.concatenate((place, place))
    j = np.concatenate((up, down))
    inside = (j < ends[np.concatenate((text, text))]) & (i < len(letters))
    i, j = i[inside], j[inside]
    # A run of two or more periods has a first root, which is followed by as much again.
    same = letters[i] == letters[j]
    i, j = i[same], j[same]
    ahead = suffixes.common(i, j)
    full = ahead >= (least_periods - 2) * (j - i) + 1
    i, j, ahead = i[full], j[full], ahead[full]
    # Backwards only in the texts that still have candidates: the mirrored texts, each before its end.
    behind = np.zeros(len(i), np.int64)
    if len(i):
        used = np.unique(text[i])
        mirrored = np.concatenate([letters[ends[t] - sizes[t] : ends[t] + 1][::-1] for t in used])
        mirrored = np.concatenate((mirrored[1:], [0]))  # the first end goes last: words, end, words, end
        new_ends = np.cumsum(sizes[used] + 1) - 1
        back = Suffixes(mirrored, np.repeat(np.arange(len(used)), sizes[used] + 1))
        which = np.searchsorted(used, text[i])
        first = ends[text[i]] - sizes[text[i]]
        mirror = lambda x: new_ends[which] - 1 - (x - 1 - first)  # noqa: E731  the place before x, mirrored
        some = i > first  # nothing lies before a text's first word
        behind[some] = back.common(mirror(i)[some], mirror(j)[some])
    start, period = i - behind, j - i
    length = j + ahead - start
    good = length >= np.maximum(least_words, least_periods * period)
    found = np.unique(np.stack((text[i], start - (ends[text[i]] - sizes[text[i]]), period, length), axis=1)[good], axis=0)
    return Runs(found[:, 0], found[:, 1], found[:, 3], found[:, 2])


def repeated_words(size: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which words of a text lie in a run after its first period."""
    marks = np.zeros(size + 1, np.int64)
    np.add.at(marks, start + period, 1)
    np.add.at(marks, start + length, -1)
    return np.cumsum(marks[:-1]) > 0


def _best(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> int:
    """The run of the greatest exact exponent; of equal ones the first start, then the least period."""
    best = 0
    for k in range(1, len(start)):
        more = int(length[k]) * int(period[best]) - int(length[best]) * int(period[k])
        if more > 0:  # runs ascend by start and period
            best = k
    return best


_OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()),
    ("runs", pa.string()), ("collapsed", pa.binary()),
])
_SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs string, collapsed binary"


def _rows(ids: list, texts: list[list[bytes]], least_words: int, least_periods: int) -> pa.RecordBatch:
    codes: dict[bytes, int] = {}
    flat = np.fromiter((codes.setdefault(w, len(codes)) for words in texts for w in words), np.int64)
    sizes = np.array([len(words) for words in texts], np.int64)
    runs = find_runs(flat, sizes, least_words, least_periods)
    edge = np.searchsorted(runs.text, np.arange(len(texts) + 1))
    out = []
    for t, (doc_id, words) in enumerate(zip(ids, texts)):
        a, b = edge[t], edge[t + 1]
        if a == b:
            out.append((doc_id, 0, None, None, None, None, "", b" ".join(words)))
            continue
        start, length, period = runs.start[a:b], runs.length[a:b], runs.period[a:b]
        k = _best(start, length, period)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in zip(start.tolist(), length.tolist(), period.tolist()))
        gone = repeated_words(len(words), start, length, period)
        kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
        out.append((doc_id, b - a, int(start[k]), int(length[k]), int(period[k]), 1000 * int(length[k]) // int(period[k]), listed, kept))
    columns = list(zip(*out))
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _OUT)], schema=_OUT)


def planted(words: list[bytes], mark: int) -> list[bytes]:
    """A text made periodic from some place on, as told by a number; others stay."""
    n, g = len(words), mark // 10
    if mark % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def periodic_runs(docs: DataFrame, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS, plant: bool = False, batch_words: int = BATCH_WORDS) -> DataFrame:
    """Per row: doc_id, n_runs, the strongest run's start, length, period, exponent_milli, and runs, collapsed.

    Words are runs of bytes without ASCII white space, numbered from 0. ``runs`` has a line ``start,length,period``
    for each run of at least ``least_words`` words and ``least_periods`` periods, by start, then period; ``collapsed``
    (UTF-8) the words that no run holds after its first period, joined by one space. The strongest run has the
    greatest exact length over period; ties go to the first start, then the least period. Without a run these
    four are null. Null texts have no words. Rows are taken one by one, whatever their ids; an empty table
    gives an empty result. Texts are read whole; with ``plant``, those whose crc32 of the id in
    decimal is divisible by 10 are made periodic first (null ids are not).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[list[bytes]] = []
        held = 0
        for batch in batches:
            for doc_id, mark, raw in zip(*batch.columns):
                words = raw.as_py().split()
                if plant and mark.is_valid:
                    words = planted(words, mark.as_py())
                if held and held + len(words) > batch_words:
                    yield _rows(ids, texts, least_words, least_periods)
                    ids, texts, held = [], [], 0
                ids.append(doc_id.as_py())
                texts.append(words)
                held += len(words) + 1
        if ids:
            yield _rows(ids, texts, least_words, least_periods)
        release_memory()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("mark"), text_bytes().alias("text"))
    return source.mapInArrow(run, _SCHEMA)


def run_digests(docs: DataFrame, **options) -> DataFrame:
    """:func:`periodic_runs` with its two texts as lowercase-hex sha256, ``runs_sha256`` and ``collapsed_sha256``."""
    found = periodic_runs(docs, **options)
    hashed = [F.sha2(F.col("runs").cast("binary"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")]
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", *hashed)
