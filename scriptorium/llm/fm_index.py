"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of consecutive documents of bounded text size. Its text is the sequence of
all its documents' word ids with a separator after each document, indexed once: a
Burrows-Wheeler transform under a wavelet matrix. All benchmark windows are searched
backward at once by rank queries, and occurrences are located by walking back to the next
sampled suffix position.

The benchmark reaches the tasks in broadcast slices of bounded size. A larger benchmark
has more slices, and each task takes them one at a time, so any size is handled exactly.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.runtime import release_memory, text_bytes

WINDOW_WORDS = 13
SLICE_BYTES = 4 << 20  # of benchmark text in a broadcast slice
SHARD_BYTES = 4 << 20  # of documents in an index
SAMPLE_EVERY = 8  # suffix positions kept
CONTAMINATED_PART = 20  # a document is contaminated from a 20th of its words

# A-Z to lower case; ASCII that is no letter or digit to a blank; other bytes stay.
_FOLD = bytes(b if b >= 128 or chr(b).isalnum() and not 65 <= b <= 90 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` as UTF-8."""
    return text.translate(_FOLD).split()


class Bits:
    """A bit vector with the ones before each of its words: a place costs a bit and a half."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)  # the place past the end has a word too
        packed[: (len(bits) + 7) // 8] = np.packbits(bits, bitorder="little")
        self.words = packed.view("<u8")
        self.counts = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32))).astype(np.int32)

    def before(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word, mask = at >> 6, (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[word] + np.bitwise_count(self.words[word] & mask)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletMatrix:
    """Rank over a sequence of small integers, by one bit vector a level."""

    def __init__(self, values: np.ndarray, bits: int) -> None:
        self.bits, self.zeros, self.levels = bits, [], []
        now = values.astype(np.int32)  # symbols are fewer than words
        for level in reversed(range(bits)):
            bit = (now & (1 << level)) != 0
            self.levels.append(Bits(bit))
            self.zeros.append(len(now) - int(np.count_nonzero(bit)))
            now = np.concatenate((now[~bit], now[bit]))

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each end."""
        lo, hi = np.zeros_like(ends), ends
        for k, level in enumerate(reversed(range(self.bits))):
            ones, up = self.levels[k], (symbols >> level) & 1 == 1
            a, b = ones.before(lo), ones.before(hi)
            lo, hi = np.where(up, self.zeros[k] + a, lo - a), np.where(up, self.zeros[k] + b, hi - b)
        return hi - lo

    def access_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position and its occurrences before that position."""
        symbol, lo, now = np.zeros_like(at), np.zeros_like(at), at
        for k in range(self.bits):
            ones = self.levels[k]
            up, a, b = ones[now], ones.before(now), ones.before(lo)
            symbol = symbol * 2 + up
            now = np.where(up, self.zeros[k] + a, now - a)
            lo = np.where(up, self.zeros[k] + b, lo - b)
        return symbol, now - lo


def suffix_array(text: np.ndarray, bits: int) -> np.ndarray:
    """Suffix positions in order; the text of ``bits``-bit symbols ends with a unique zero.

    Suffixes are sorted by as many symbols as a long holds, then by prefix doubling, which
    sorts only those that are not yet told apart. A rank is the place of a group's first.
    """
    n, width = len(text), max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for k in range(width):
        key <<= bits
        key[: n - k] |= text[k:] if k < n else 0
    order = np.argsort(key)
    ordered = key[order]
    open_ = np.arange(n)  # places in the order not yet certain
    rank = np.empty(n, np.int64)
    while len(open_):
        starts = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        rank[order[open_]] = np.maximum.accumulate(np.where(starts, open_, 0))
        alone = starts & np.concatenate((starts[1:], [True]))
        open_ = open_[~alone]
        own = order[open_]
        key = rank[own] * (n + 1) + np.where(own + width < n, rank[np.minimum(own + width, n - 1)] + 1, 0)
        again = np.argsort(key)
        order[open_], ordered = own[again], key[again]
        width *= 2
    return order


class FMIndex:
    """Backward search and location over a sequence of positive integers."""

    def __init__(self, text: np.ndarray, symbols: int, every: int = SAMPLE_EVERY) -> None:
        body = np.concatenate((np.asarray(text, np.int64), [0]))
        bits = max(1, int(symbols).bit_length())
        order = suffix_array(body, bits)
        self.wave = WaveletMatrix(body[order - 1], bits)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(body, minlength=symbols + 1))))
        self.sampled = order % every == 0
        self.where = np.concatenate(([0], np.cumsum(self.sampled)))
        self.samples = order[self.sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the suffixes that start with each phrase (right-aligned rows)."""
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), self.before[-1])
        width = phrases.shape[1]
        for k in range(width):
            go = np.flatnonzero((lengths > k) & (lo < hi))
            if not len(go):
                break
            symbol = phrases[go, width - 1 - k]
            base = self.before[symbol]
            lo[go], hi[go] = base + self.wave.rank(symbol, lo[go]), base + self.wave.rank(symbol, hi[go])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each suffix row."""
        at, steps, out = rows.copy(), np.zeros_like(rows), np.full_like(rows, -1)
        todo = np.arange(len(rows))
        while len(todo):
            hit = self.sampled[at[todo]]
            done = todo[hit]
            out[done] = self.samples[self.where[at[done]]] + steps[done]
            todo = todo[~hit]
            if len(todo):
                symbol, before = self.wave.access_rank(at[todo])
                at[todo] = self.before[symbol] + before
                steps[todo] += 1
        return out


class Shard:
    """Word ids of a shard's texts, a separator after each, under one index."""

    def __init__(self, texts: list[bytes], every: int = SAMPLE_EVERY) -> None:
        self.vocabulary: defaultdict[bytes, int] = defaultdict()
        self.vocabulary.default_factory = lambda: len(self.vocabulary) + 1
        words = [words_of(t) for t in texts]
        self.sizes = np.array([len(w) for w in words], np.int64)
        ids = [np.fromiter(map(self.vocabulary.__getitem__, w), np.int64, len(w)) for w in words]
        self.ends = np.cumsum(self.sizes + 1)  # past each text's separator
        end = len(self.vocabulary) + 1
        text = np.full(int(self.ends[-1]) if len(texts) else 0, end, np.int64)
        for own, stop in zip(ids, self.ends.tolist()):
            text[stop - 1 - len(own) : stop - 1] = own
        del words, ids  # an object a word
        self.index = FMIndex(text, end, every)


class PhraseSlice:
    """Windows of some benchmark items, ready to be searched for in a shard."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW_WORDS) -> None:
        vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for name, text in items:
            ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)]
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(tuple(ids[at : at + window]), set()).add(name)
        self.words = list(vocabulary)
        self.items = [sorted(names) for names in owners.values()]
        self.lengths = np.array([len(p) for p in owners], np.int64)
        self.phrases = np.zeros((len(owners), window), np.int64)
        for row, p in enumerate(owners):
            self.phrases[row, window - len(p) :] = p

    def hits(self, shard: Shard) -> Iterator[tuple[int, int, int]]:
        """(start, end, window) of all occurrences in a shard; none crosses a separator."""
        get = shard.vocabulary.get
        ids = np.array([0, *(get(w, 0) for w in self.words)], np.int64)
        phrases = ids[self.phrases]
        able = np.flatnonzero((phrases > 0).sum(axis=1) == self.lengths)  # all words are in the shard
        lo, hi = shard.index.search(phrases[able], self.lengths[able])
        found = np.flatnonzero(hi > lo)
        for at in range(0, len(found), 1024):  # blocks of windows bound the rows held at once
            some = found[at : at + 1024]
            counts = hi[some] - lo[some]
            which = np.repeat(able[some], counts)
            first = np.cumsum(counts) - counts
            begin = shard.index.locate(np.repeat(lo[some] - first, counts) + np.arange(len(which)))
            yield from zip(begin.tolist(), (begin + self.lengths[which]).tolist(), which.tolist())


def phrase_slices(benchmark: DataFrame, window: int = WINDOW_WORDS, slice_bytes: int = SLICE_BYTES) -> Iterator[PhraseSlice]:
    """The benchmark's items in slices of bounded text size, read one partition at a time."""
    rows = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), text_bytes().alias("text"))
    items, held = [], 0
    for row in rows.toLocalIterator():
        items.append((row["item_id"], bytes(row["text"])))
        held += len(items[-1][1])
        if held >= slice_bytes:
            yield PhraseSlice(items, window)
            items, held = [], 0
    if items:
        yield PhraseSlice(items, window)


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open intervals, sorted; touching ones are joined."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def scan_shard(texts: list[bytes], slices, every: int = SAMPLE_EVERY) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """(words, merged hit word spans, items found) of each document of a shard.

    The shard is indexed once; all slices are searched in that index.
    """
    shard = Shard(texts, every)
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    names: list[set[str]] = [set() for _ in texts]
    begins = shard.ends - shard.sizes - 1
    for part in slices:
        for start, end, which in part.hits(shard):
            d = int(np.searchsorted(shard.ends, start, side="right"))
            spans[d].append((start - int(begins[d]), end - int(begins[d])))
            names[d].update(part.items[which])
    return [(int(n), merge_spans(s), sorted(m)) for n, s, m in zip(shard.sizes, spans, names)]


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", window: int = WINDOW_WORDS, slice_bytes: int = SLICE_BYTES, shard_bytes: int = SHARD_BYTES, every: int = SAMPLE_EVERY) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    ``spans`` are merged removal spans in words, half-open. A document is contaminated
    where it has a hit and hits make up a 20th of its words. Null texts have no words;
    items without words or without an id are in nobody's text; items of fewer words than
    the window are one window. Items with the same text all count. Every row gives one
    row, repeated or null ids too; empty tables give empty results or no hits.
    """
    def result(rows: list[pa.RecordBatch], found: list) -> Iterator[pa.RecordBatch]:
        yield _result([i for part in rows for i in part.column(0).to_pylist()], found)

    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:int,end:int>>"
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes().alias("text"))
    return source.mapInArrow(_scanner(docs, benchmark, 1, result, window, slice_bytes, shard_bytes, every), schema)


def _scanner(docs: DataFrame, benchmark: DataFrame, text_at: int, done: Callable, window: int = WINDOW_WORDS, slice_bytes: int = SLICE_BYTES, shard_bytes: int = SHARD_BYTES, every: int = SAMPLE_EVERY) -> Callable:
    """A function over batches that gathers shards, searches them and hands (rows, findings) to ``done``."""
    context = docs.sparkSession.sparkContext
    shared = [context.broadcast(pickle.dumps(part, protocol=pickle.HIGHEST_PROTOCOL)) for part in phrase_slices(benchmark, window, slice_bytes)]

    def slices() -> Iterator[PhraseSlice]:  # one is open at a time; the others stay packed
        for b in shared:
            yield _opened(b.value) if len(shared) == 1 else pickle.loads(b.value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()  # what an earlier task of this worker held
        rows, texts, held = [], [], 0
        for batch in batches:
            begun = 0
            for at, text in enumerate(batch.column(text_at)):
                raw = text.as_py()
                texts.append(raw.encode() if isinstance(raw, str) else raw or b"")
                held += len(texts[-1])
                if held >= shard_bytes:
                    yield from done([*rows, batch.slice(begun, at + 1 - begun)], scan_shard(texts, slices(), every))
                    rows, texts, held, begun = [], [], 0, at + 1
            if begun < batch.num_rows:
                rows.append(batch.slice(begun))
        if texts:
            yield from done(rows, scan_shard(texts, slices(), every))
        release_memory()

    return run


@lru_cache(maxsize=1)
def _opened(packed: bytes) -> PhraseSlice:
    return pickle.loads(packed)


def _result(ids: list, found: list) -> pa.RecordBatch:
    hits = [sum(e - s for s, e in spans) for _, spans, _ in found]
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array([n for n, _, _ in found], pa.int64()),
            pa.array(hits, pa.int64()),
            pa.array([len(names) for _, _, names in found], pa.int64()),
            pa.array([hashlib.sha256(",".join(names).encode()).hexdigest() for _, _, names in found], pa.string()),
            pa.array([h > 0 and CONTAMINATED_PART * h >= n for h, (n, _, _) in zip(hits, found)], pa.bool_()),
            pa.array([[{"start": s, "end": e} for s, e in spans] for _, spans, _ in found], span),
        ],
        ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"],
    )


def clean_rows(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns, each judged by its own text.

    Ids play no part: rows under one id, or without one, are judged apart. Null and empty
    texts stay. Nothing is shuffled.
    """

    def keep(rows: list[pa.RecordBatch], found: list) -> Iterator[pa.RecordBatch]:
        stay = np.array([CONTAMINATED_PART * hit < n or not hit for hit, n in ((sum(e - s for s, e in spans), n) for n, spans, _ in found)])
        at = 0
        for part in rows:
            yield part.filter(pa.array(stay[at : at + part.num_rows]))
            at += part.num_rows

    return docs.mapInArrow(_scanner(docs, benchmark, docs.columns.index("text"), keep, **options), docs.schema)
