"""Substring dedup: paragraphs by MinHash banding, and passages inside them.

Paragraphs are a text's lines of at least ``LEAST_WORDS`` words. Each has MinHash values
over its five-word shingles, banded for recall (at similarity 0.8 a pair collides with
probability 1 - (1 - 0.8**ROWS)**BANDS, 0.9997 here). Equal paragraphs are one node.
Colliding ones are joined, their exact Jaccard similarity is computed from all shingles,
and removals are clustered by connected components: one paragraph of a cluster stays.

A passage may repeat inside paragraphs that differ. Runs of ``PASSAGE_WORDS`` words are
therefore sampled by their smallest hash in each window of ``PASSAGE_WINDOW`` starts
(one-row MinHash over a sliding paragraph), so any shared run of
PASSAGE_WORDS + PASSAGE_WINDOW - 1 words (49) has a sampled run in common, wherever it stands.
Sampled runs are anchors: where the words beside one are covered by no other, the run is
extended word by word for as long as they equal those beside its first place, so a span ends
where the common passage does. Between the first and the last anchor of a passage sampled
runs leave no gap, so at most ``REACH`` words are ever to be compared.

Equal paragraphs and runs are found by a columnar exchange: blocks of documents send their
distinct hashes to hash partitions as sorted binary columns with the first place of each,
and get back which are repeated and which place is the first. A line that every document
has costs one entry a block. Extension takes two more exchanges of that kind: blocks get the
words beside the first places of their runs, and first places the longest match found.
Words are hashed to 64 bits, those beside runs to 31.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.components import connected_components
from scriptorium.llm.hashing import BYTE_VALUES, mix, span_hashes, sum_hashes, word_spans
from scriptorium.llm.interpolation_lm import _edges, _expand, _squeeze
from scriptorium.llm.runtime import cut_lineage, release_memory, text_bytes

SHINGLE_WORDS = 5
SIMILARITY = 0.8
LEAST_WORDS = SHINGLE_WORDS  # of a paragraph
BANDS = 8
ROWS = 2
REACH = 24  # words beyond a run that another sampled run may not cover: PASSAGE_WINDOW - 1
SALTS = 32  # parts of a component's places
PASSAGE_WORDS = 25
PASSAGE_WINDOW = 25
CHUNK_BYTES = 1 << 20  # of text hashed together
BLOCK_BYTES = 12 << 20  # of text in a block
KEYS_A_PARTITION = 2_000_000
BROADCAST_LINES = 500_000  # colliding paragraphs whose places (24 bytes each) are broadcast; more are shuffled
BUCKET_ROWS = 4096  # paragraphs of a band bucket compared in one task, twice over at most
BYTES_A_KEY = 60  # about, of text for each paragraph or run; only the number of partitions depends on it
_NO_ID = -(1 << 63)


class Chunk:
    """Words, paragraphs and sampled runs of some texts."""

    def __init__(self, texts: list[bytes]) -> None:
        joined = b"\n".join(texts).lower()
        data = np.frombuffer(joined, np.uint8)
        starts, stops = word_spans(data)
        self.words = sum_hashes(BYTE_VALUES[data], starts, stops)
        ends = np.cumsum([len(t) + 1 for t in texts])  # a text's end, with its line end
        self.doc = np.searchsorted(ends, starts, side="right")  # text of each word
        self.counts = np.bincount(self.doc, minlength=len(texts))
        self.first = np.cumsum(self.counts) - self.counts  # each text's first word
        line = np.cumsum(data == 10)[starts] if len(starts) else np.zeros(0, np.int64)
        cut = np.flatnonzero(np.diff(line)) + 1
        begin, end = np.concatenate(([0], cut)).astype(np.int64), np.concatenate((cut, [len(starts)])).astype(np.int64)
        keep = end - begin >= LEAST_WORDS
        self.begin, self.end = begin[keep], end[keep]

    def paragraphs(self, least: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each paragraph, band keys of those of ``least`` words and more)."""
        units = sum_hashes(self.words, self.begin, self.end)
        long = self.end - self.begin >= least
        if not long.any():
            return units, np.zeros((0, BANDS), np.uint64)
        begin = self.begin[long]
        sizes = self.end[long] - begin - SHINGLE_WORDS + 1
        offsets = np.cumsum(sizes) - sizes
        at = np.repeat(begin - offsets, sizes) + np.arange(int(sizes.sum()))
        return units, band_keys(run_hashes(self.words, at, SHINGLE_WORDS), offsets)

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """(first words, hashes) of the sampled runs; no run crosses texts."""
        at = sampled_runs(self.words, self.first, self.counts)
        return at, run_hashes(self.words, at, PASSAGE_WORDS)


def least_banded(similarity: float) -> int:
    """Words of the shortest paragraph that can be similar to another one without being equal.

    Sets of k and k + 1 shingles have a similarity of k / (k + 1) at most: shorter paragraphs need no bands.
    """
    return max(1, math.ceil(similarity / (1 - similarity) - 1e-9) if similarity < 1 else 1 << 31) + SHINGLE_WORDS - 1


def run_hashes(words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Hash of the run of ``width`` word hashes at each place."""
    return mix(span_hashes(words, at, at + width) + np.uint64(width)) if len(at) else np.zeros(0, np.uint64)


def band_keys(shingles: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A key for each set (from its offset to the next) and band, from MinHash values."""
    out = np.empty((len(offsets), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(offsets), band + 1, np.uint64)
        for row in range(ROWS):
            seed = np.uint64((band * ROWS + row + 1) * 0xD6E8FEB86659FD93 % (1 << 64))
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(mix(shingles ^ seed), offsets))
        out[:, band] = key
    return out


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` over each full window, by doubling."""
    done, now = 1, values
    while done * 2 <= width:
        now = pick(now[:-done], now[done:])
        done *= 2
    rest = width - done
    return pick(now[: len(now) - rest], now[rest:]) if rest else now


def sampled_runs(words: np.ndarray, first: np.ndarray, counts: np.ndarray, width: int = PASSAGE_WORDS, window: int = PASSAGE_WINDOW) -> np.ndarray:
    """Places of the runs that are the smallest of some window of starts within their text.

    A run is one iff the largest of its windows' minima is its own hash; equal runs in a
    window are all taken. Texts with fewer starts than a window are one window.
    """
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    hashes = run_hashes(words, np.arange(n), width)
    doc = np.repeat(np.arange(len(counts)), counts)
    valid = doc[:n] == doc[width - 1 :]
    out = np.zeros(n, bool)
    if n >= window:
        low = _sliding(hashes, window, np.minimum)
        inside = valid[: len(low)] & valid[window - 1 :] & (doc[: len(low)] == doc[window - 1 : n])
        low[~inside] = 0
        padded = np.concatenate((np.zeros(window - 1, np.uint64), low, np.zeros(window - 1, np.uint64)))
        out = (_sliding(padded, window, np.maximum) == hashes) & valid & (hashes > 0)
    short = np.flatnonzero((counts >= width) & (counts < width + window - 1))
    for d in short.tolist():
        own = slice(int(first[d]), int(first[d] + counts[d]) - width + 1)
        out[own] = hashes[own] == hashes[own].min()
    return np.flatnonzero(out)


_PACK = pa.schema([("block", pa.int64()), *((k, pa.binary()) for k in ("doc_ids", "rows", "n_words", "n_lines", "owner", "start", "size", "keys", "bands", "vocabulary", "words"))])
_PACK_DDL = "block long, doc_ids binary, rows binary, n_words binary, n_lines binary, owner binary, start binary, size binary, keys binary, bands binary, vocabulary binary, words binary"


def _packs(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Blocks of documents: per unit its document, first word, words and hash; paragraphs first."""

    def pack(rows: list[tuple[int | None, int]], parts: list[tuple]) -> pa.RecordBatch:
        lines, runs = [p[1] for p in parts], [p[2] for p in parts]
        join = lambda side, k: np.concatenate([x[k] for x in side])
        both = lambda k: np.concatenate((join(lines, k), join(runs, k)))
        vocabulary, words = np.unique(np.concatenate([p[3] for p in parts]), return_inverse=True)
        row = {
            "block": rows[0][1],
            "doc_ids": np.array([_NO_ID if d is None else d for d, _ in rows], np.int64).tobytes(),
            "rows": np.array([r for _, r in rows], np.int64).tobytes(),
            "n_words": np.concatenate([p[0] for p in parts]).astype(np.int32).tobytes(),
            "n_lines": np.bincount(join(lines, 0), minlength=len(rows)).astype(np.int32).tobytes(),
            "owner": _squeeze(both(0).astype(np.uint32)),
            "start": _squeeze(both(1).astype(np.uint32)),
            "size": _squeeze(both(2).astype(np.uint32)),
            "keys": _squeeze(both(3)),
            "bands": _squeeze(join(lines, 4).reshape(-1)),
            "vocabulary": _squeeze(vocabulary),
            "words": _squeeze(words.astype(np.uint32)),
        }
        return pa.RecordBatch.from_pylist([row], _PACK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, texts, parts, held, done = [], [], [], 0, 0

        def hash_texts() -> None:
            nonlocal texts, done
            chunk = Chunk(texts)
            units, bands = chunk.paragraphs(least_banded(similarity))
            at, keys = chunk.runs()
            line_doc, run_doc = chunk.doc[chunk.begin], chunk.doc[at]
            line = (line_doc + done, chunk.begin - chunk.first[line_doc], chunk.end - chunk.begin, units, bands)
            parts.append((chunk.counts, line, (run_doc + done, at - chunk.first[run_doc], np.full(len(at), PASSAGE_WORDS), keys), (chunk.words >> np.uint64(32)).astype(np.uint32) | np.uint32(2)))
            done, texts = done + len(texts), []

        size = 0
        for batch in batches:
            for key, row, text in zip(batch.column(0), batch.column(1), batch.column(2)):
                rows.append((key.as_py(), row.as_py()))
                texts.append(text.as_py())
                size += len(texts[-1])
                if size >= CHUNK_BYTES:
                    held, size = held + size, 0
                    hash_texts()
                    if held >= BLOCK_BYTES:
                        yield pack(rows, parts)
                        rows, parts, held, done = [], [], 0, 0
        if texts:
            hash_texts()
        if rows:
            yield pack(rows, parts)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), text_bytes().alias("text"))
    return source.mapInArrow(run, _PACK_DDL)


class Pack:
    """A block opened."""

    def __init__(self, row: dict) -> None:
        self.doc_ids = np.frombuffer(row["doc_ids"], np.int64)
        self.rows = np.frombuffer(row["rows"], np.int64)
        self.n_words = np.frombuffer(row["n_words"], np.int32)
        self.n_lines = np.frombuffer(row["n_lines"], np.int32)
        self.owner, self.start, self.size = (_expand(row[k], np.uint32).astype(np.int64) for k in ("owner", "start", "size"))
        self.keys = _expand(row["keys"], np.uint64)
        self.lines = int(self.n_lines.sum())

    def order(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct keys, first unit of each by place, each unit's key)."""
        place = np.lexsort((self.start, self.rows[self.owner], self.doc_ids[self.owner]))
        keys, first, which = np.unique(self.keys[place], return_index=True, return_inverse=True)
        back = np.empty(len(place), np.int64)
        back[place] = which
        return keys, place[first], back


_ASK = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("many", pa.binary()), ("ids", pa.binary()), ("rows", pa.binary())])


def _answers(packs: DataFrame, partitions: int) -> DataFrame:
    """Per block and key partition, for the block's keys in order: 0 alone, 1 repeated, 2 repeated and first here."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pack = Pack(row)
                keys, first, which = pack.order()
                many = (np.bincount(which, minlength=len(keys)) > 1).astype(np.uint8)
                ids, places = pack.doc_ids[pack.owner[first]], pack.rows[pack.owner[first]]
                edge = _edges(keys, partitions)
                out = []
                for p in np.flatnonzero(np.diff(edge)).tolist():
                    a, b = int(edge[p]), int(edge[p + 1])
                    gaps = np.diff(keys[a:b], prepend=np.uint64(0))
                    out.append({"part": p, "block": row["block"], "keys": _squeeze(gaps), "many": _squeeze(many[a:b]), "ids": _squeeze(ids[a:b]), "rows": _squeeze(places[a:b])})
                if out:
                    yield pa.RecordBatch.from_pylist(out, _ASK)

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        keys = [np.cumsum(_expand(k, np.uint64), dtype=np.uint64) for k in rows["keys"]]
        flat = np.concatenate(keys)
        many = np.concatenate([_expand(m, np.uint8) for m in rows["many"]]) > 0
        order = np.lexsort((np.concatenate([_expand(r, np.int64) for r in rows["rows"]]), np.concatenate([_expand(i, np.int64) for i in rows["ids"]]), flat))
        ordered = flat[order]
        starts = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        again = np.add.reduceat(np.ones(len(order), np.int64), np.flatnonzero(starts)) > 1
        flag = np.zeros(len(flat), np.uint8)
        group = np.cumsum(starts) - 1
        several = again[group] | (np.maximum.reduceat(many[order], np.flatnonzero(starts)) > 0)[group]
        flag[order] = np.where(several, np.where(starts, 2, 1), 0)
        at, out = 0, []
        for block, k in zip(rows["block"], keys):
            out.append((int(block), int(rows["part"].iloc[0]), _squeeze(flag[at : at + len(k)])))
            at += len(k)
        return pd.DataFrame(out, columns=["block", "part", "flags"])

    asked = packs.mapInArrow(ask, "part long, block long, keys binary, many binary, ids binary, rows binary")
    return asked.repartition(partitions, "part").groupBy("part").applyInPandas(answer, "block long, part long, flags binary")


_FOUND = ("doc_ids", "rows", "n_words", "n_lines", "owner", "start", "end", "goes", "first_keys", "first_spans", "first_beside", "open_keys", "open_spans", "open_beside")


def _found_blocks(packs: DataFrame, answers: DataFrame) -> DataFrame:
    """Per block its equal paragraphs and runs as spans (and which of them go), and the runs to extend.

    ``first_*`` are the runs whose first place is here, ``open_*`` other places of runs with
    words beside them that no span covers: key, span and the words beside (before and after).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pack = Pack(row)
                _, first, which = pack.order()
                flag = _flat(row["answers"], "flags", np.uint8)
                state = flag[which]
                stays = np.zeros(len(which), bool)
                stays[first[flag == 2]] = True
                hit = np.flatnonzero(state > 0)
                hit = hit[np.lexsort((pack.start[hit], pack.owner[hit]))]
                owner, start, end, goes = pack.owner[hit], pack.start[hit], pack.start[hit] + pack.size[hit], ~stays[hit]
                words = _expand(row["vocabulary"], np.uint32)[_expand(row["words"], np.uint32)]
                begins = np.cumsum(pack.n_words.astype(np.int64)) - pack.n_words
                left, right = begins[owner] + start, begins[owner] + end
                open_ = np.zeros(len(hit), bool)
                for some in (np.ones(len(hit), bool), goes):
                    covered = np.zeros(len(words) + 2, np.int32)  # at a word's place plus one
                    np.add.at(covered, left[some] + 1, 1)
                    np.add.at(covered, right[some] + 1, -1)
                    covered = np.cumsum(covered) > 0
                    open_ |= some & (((start > 0) & ~covered[left]) | ((end < pack.n_words[owner]) & ~covered[right + 1]))
                is_run = hit >= pack.lines
                out = {"block": row["block"], **{k: row[k] for k in _FOUND[:4]}}
                for name, value in zip(_FOUND[4:7], (owner, start, end)):
                    out[name] = _squeeze(value.astype(np.uint32))
                out["goes"] = _squeeze(goes.astype(np.uint8))
                for name, own in (("first", np.flatnonzero(is_run & ~goes)), ("open", np.flatnonzero(is_run & goes & open_))):
                    own = own[np.argsort(pack.keys[hit[own]], kind="stable")]
                    beside = np.concatenate((_beside(words, left[own] - 1, -1, begins[owner[own]]), _beside(words, right[own], 1, (begins + pack.n_words)[owner[own]] - 1)), axis=1)
                    out |= {f"{name}_keys": _squeeze(pack.keys[hit[own]]), f"{name}_spans": _squeeze(own.astype(np.uint32)), f"{name}_beside": _squeeze(beside.reshape(-1))}
                yield pa.RecordBatch.from_pylist([out], pa.schema([("block", pa.int64()), *((k, pa.binary()) for k in _FOUND)]))
            release_memory()

    arrays = answers.groupBy("block").agg(F.collect_list(F.struct("part", "flags")).alias("answers"))
    return packs.drop("bands").join(arrays, "block", "left").mapInArrow(run, "block long, " + ", ".join(f"{k} binary" for k in _FOUND))


def _beside(words: np.ndarray, at: np.ndarray, step: int, last: np.ndarray) -> np.ndarray:
    """The ``REACH`` words from each place in a direction; 0 beyond the text's last."""
    places = at[:, None] + step * np.arange(REACH)
    inside = places >= last[:, None] if step < 0 else places <= last[:, None]
    return np.where(inside, words[np.clip(places, 0, max(0, len(words) - 1))] if len(words) else 0, 0).astype(np.uint32)


def _flat(answers: list[dict] | None, name: str, kind) -> np.ndarray:
    """A block's answers in the order of its keys."""
    parts = [_expand(a[name], kind) for a in sorted(answers or (), key=lambda a: a["part"])]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


_SENT = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("value", pa.binary()), ("asks", pa.bool_())])
_SENT_DDL = "part long, block long, keys binary, value binary, asks boolean"


def _by_part(keys: np.ndarray, value: np.ndarray | None, block: int, partitions: int, asks: bool) -> list[dict]:
    """A block's sorted keys (and a value for each) by key partition."""
    edge, out = _edges(keys, partitions), []
    for p in np.flatnonzero(np.diff(edge)).tolist():
        a, b = int(edge[p]), int(edge[p + 1])
        out.append({"part": p, "block": block, "keys": _squeeze(np.diff(keys[a:b], prepend=np.uint64(0))), "value": None if value is None else _squeeze(value[a:b].reshape(-1)), "asks": asks})
    return out


def _told(sent: DataFrame, partitions: int, width: int, kind) -> DataFrame:
    """For each asking block and key partition, its keys' values: the largest told for a key, each column by itself."""

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        told, asking = rows[~rows["asks"]], rows[rows["asks"]]
        opened = lambda k: np.cumsum(_expand(k, np.uint64), dtype=np.uint64)
        flat = np.concatenate([np.zeros(0, np.uint64), *map(opened, told["keys"])])
        values = np.concatenate([np.zeros((0, width), kind), *(_expand(v, kind).reshape(-1, width) for v in told["value"])])
        order = np.argsort(flat, kind="stable")
        begins = np.flatnonzero(np.concatenate(([True], np.diff(flat[order]) > 0))) if len(flat) else np.zeros(0, np.int64)
        known, best = flat[order][begins], np.maximum.reduceat(values[order], begins, axis=0) if len(flat) else values
        out = []
        for block, k in zip(asking["block"], asking["keys"]):
            keys = opened(k)
            at = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
            found = np.where((known[at] == keys)[:, None], best[at], 0) if len(known) else np.zeros((len(keys), width))
            out.append((int(block), int(rows["part"].iloc[0]), _squeeze(found.astype(kind).reshape(-1))))
        release_memory()
        return pd.DataFrame(out, columns=["block", "part", "told"])

    answers = sent.repartition(partitions, "part").groupBy("part").applyInPandas(answer, "block long, part long, told binary")
    return answers.groupBy("block").agg(F.collect_list(F.struct("part", "told")).alias("answers"))


def _matched(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """(words before, words after) for as long as both have the same."""
    same = ((own == other) & (own > 0)).reshape(len(own), 2, REACH)
    return np.cumprod(same, axis=2, dtype=np.uint8).sum(axis=2, dtype=np.uint8)


def _extended_spans(found: DataFrame, partitions: int) -> DataFrame:
    """Per document its equal paragraphs and extended runs: ``spans`` with ``goes``."""

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                beside = _expand(row["first_beside"], np.uint32).reshape(-1, 2 * REACH)
                sent = _by_part(_expand(row["first_keys"], np.uint64), beside, row["block"], partitions, False)
                sent += _by_part(np.unique(_expand(row["open_keys"], np.uint64)), None, row["block"], partitions, True)
                if sent:
                    yield pa.RecordBatch.from_pylist(sent, _SENT)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys = _expand(row["open_keys"], np.uint64)
                distinct, which = np.unique(keys, return_inverse=True)
                told = _flat(row["answers"], "told", np.uint32).reshape(-1, 2 * REACH)
                reach = _matched(_expand(row["open_beside"], np.uint32).reshape(-1, 2 * REACH), told[which])
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]]), pa.array([row["open_keys"]], pa.binary()), pa.array([_squeeze(reach.reshape(-1))], pa.binary())], ["block", "keys", "reach"])

    def ask_reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, reach = _expand(row["open_keys"], np.uint64), _expand(row["reach"], np.uint8).reshape(-1, 2)
                begins = np.flatnonzero(np.concatenate(([True], np.diff(keys) > 0))) if len(keys) else np.zeros(0, np.int64)
                sent = _by_part(keys[begins], np.maximum.reduceat(reach, begins, axis=0) if len(keys) else reach, row["block"], partitions, False)
                sent += _by_part(_expand(row["first_keys"], np.uint64), None, row["block"], partitions, True)
                if sent:
                    yield pa.RecordBatch.from_pylist(sent, _SENT)

    kinds = "row long, doc_id long, n_words int, n_paragraphs int, spans array<struct<start:int,end:int,goes:boolean>>"
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("goes", pa.bool_())]))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                doc_ids, rows = np.frombuffer(row["doc_ids"], np.int64), np.frombuffer(row["rows"], np.int64)
                owner, start, end = (_expand(row[k], np.uint32).astype(np.int64) for k in ("owner", "start", "end"))
                told = _flat(row["answers"], "told", np.uint8).reshape(-1, 2)
                for at, reach in ((_expand(row["open_spans"], np.uint32), _expand(row["reach"], np.uint8).reshape(-1, 2)), (_expand(row["first_spans"], np.uint32), told)):
                    start[at] -= reach[:, 0]
                    end[at] += reach[:, 1]
                offsets = np.searchsorted(owner, np.arange(len(rows) + 1))
                items = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(_expand(row["goes"], np.uint8) > 0)], ["start", "end", "goes"])
                columns = [pa.array(rows), pa.array(doc_ids, mask=doc_ids == _NO_ID), pa.array(np.frombuffer(row["n_words"], np.int32)), pa.array(np.frombuffer(row["n_lines"], np.int32)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), items).cast(span)]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_words", "n_paragraphs", "spans"])

    words = _told(found.select("block", "first_keys", "first_beside", "open_keys").mapInArrow(ask_words, _SENT_DDL), partitions, 2 * REACH, np.uint32)
    reached = found.select("block", "open_keys", "open_beside").join(words, "block", "left").mapInArrow(match, "block long, keys binary, reach binary")
    whole = cut_lineage(found.drop("first_beside", "open_beside").join(reached.drop("keys"), "block"))
    longest = _told(whole.select("block", "first_keys", "open_keys", "reach").mapInArrow(ask_reach, _SENT_DDL), partitions, 2, np.uint8)
    return whole.drop("open_keys", "first_keys").join(longest, "block", "left").mapInArrow(extend, kinds)


def _lines(packs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """A row for each paragraph: its hash, place and band keys (none of those too short to need them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pack = Pack(row)
                n, owner = pack.lines, pack.owner[: pack.lines]
                ids = pack.doc_ids[owner]
                bands = pa.array(_expand(row["bands"], np.uint64).view(np.int64))
                offsets = np.concatenate(([0], np.cumsum(BANDS * (pack.size[:n] >= least_banded(similarity)))))
                keys = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), bands)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pack.keys[:n].view(np.int64)), pa.array(ids, mask=ids == _NO_ID), pa.array(pack.rows[owner]), pa.array(pack.start[:n].astype(np.int32)), pa.array((pack.start[:n] + pack.size[:n]).astype(np.int32)), keys], ["unit", "doc_id", "row", "start", "end", "keys"]
                )

    return packs.mapInArrow(run, "unit long, doc_id long, row long, start int, end int, keys array<long>")


def _similar(members: list[tuple[int, np.ndarray]], similarity: float) -> list[tuple[int, int]]:
    """Links of a band's paragraphs at the similarity, one a paragraph and component.

    Intersections come from an inverted index of shingles, so unlike pairs cost nothing. A component's first
    paragraphs, those that were like none before, are met first; what is like one of them is linked and
    meets no other paragraph of that component. So many variants of one line cost as much as their
    shingles, not as their pairs; the others of a component are met by what is not linked with it, so no link is lost.
    """
    if len(members) < 2:
        return []
    firsts: dict[int, list[int]] = defaultdict(list)  # shingle to components' first paragraphs
    others: dict[int, dict[int, list[int]]] = defaultdict(dict)  # shingle and component to the rest of it
    parent: list[int] = []
    links: list[tuple[int, int]] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def meet(at: int, common: Counter) -> None:
        unit, shingles = members[at]
        for other, n in common.items():
            if n >= similarity * (len(shingles) + len(members[other][1]) - n) and root(other) != root(at):
                parent[root(at)] = root(other)  # a component keeps its name, by which its members are listed
                links.append((unit, members[other][0]))

    for at, (_, shingles) in enumerate(members):
        parent.append(at)
        own = shingles.tolist()
        meet(at, Counter(i for s in own for i in firsts.get(s, ())))
        mine = root(at)
        meet(at, Counter(i for s in own for group, rest in others.get(s, {}).items() if root(group) != mine for i in rest))
        alone = len(parent) == 1 or not links or links[-1][0] != members[at][0]
        for s in own:
            if alone:
                firsts[s].append(at)
            else:
                others[s].setdefault(root(at), []).append(at)
    return links


def _paragraph_links(docs: DataFrame, packs: DataFrame, similarity: float, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links between different paragraphs (by hash) of the similarity or more.

    A bucket of over ``bucket_rows`` paragraphs is cut into blocks by hash, and each pair of
    blocks is compared by itself, so no task holds a whole bucket and no link is lost.
    """
    lines = _lines(packs, similarity)
    distinct = lines.where(F.size("keys") > 0).groupBy("unit").agg(F.min(F.struct("row", "start", "end")).alias("at"), F.first("keys").alias("keys"))
    banded = distinct.select("unit", F.explode("keys").alias("key"))
    several = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    hits = cut_lineage(banded.join(several, "key"))
    wanted = hits.select("unit").distinct().join(lines.groupBy("unit").agg(F.min(F.struct("row", "start", "end")).alias("at")), "unit").select("unit", "at.row", "at.start", "at.end")
    wanted = cut_lineage(wanted)
    if wanted.count() <= BROADCAST_LINES:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.monotonically_increasing_id().alias("row"), text_bytes().alias("text"))

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for unit, text, start, end in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                chunk = Chunk([text.as_py()])
                found = sum_hashes(chunk.words, np.array([start]), np.array([end])).view(np.int64)[0]
                if found != unit:
                    raise RuntimeError("documents changed between the passes over them")
                sets.append(np.unique(run_hashes(chunk.words, np.arange(start, end - SHINGLE_WORDS + 1), SHINGLE_WORDS)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["unit", "shingles"])

    sets = texts.join(wanted, "row").select("unit", "text", "start", "end").mapInArrow(shingles, "unit long, shingles binary")
    blocks = F.ceil(F.col("n") / F.lit(bucket_rows)).cast("int")
    own = F.pmod(F.xxhash64("unit"), blocks).cast("int")
    dealt = hits.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).select("unit", F.xxhash64("key", F.least(own, "other"), F.greatest(own, "other")).alias("key"))
    groups = dealt.join(sets, "unit").repartition("key").sortWithinPartitions("key", "unit").select("key", "unit", "shingles")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members = None, []
        for batch in batches:
            links = []
            for k, unit, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if k != key:
                    links += _similar(members, similarity)
                    key, members = k, []
                members.append((unit, np.frombuffer(raw.as_py(), np.uint64)))
            yield _ends(links)
        yield _ends(_similar(members, similarity))

    return groups.mapInArrow(link, "a long, b long")


def _ends(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"])


def _fuzzy_spans(packs: DataFrame, parts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Per row, paragraphs of clusters of different paragraphs, and whether an earlier one keeps them.

    A component's places are dealt over ``SALTS`` keys, to each of which its first place is sent.
    """
    lines = _lines(packs, similarity).drop("keys")
    salt = F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")
    salted = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    place = F.struct("doc_id", "row", "start")
    placed = lines.withColumn("salt", salt).join(salted(parts.withColumnRenamed("node", "unit")), ["unit", "salt"])
    first = placed.groupBy("component").agg(F.min(place).alias("kept"))
    again = placed.join(salted(first), ["component", "salt"]).select("row", F.struct("start", "end", (place != F.col("kept")).alias("goes")).alias("s"))
    return again.groupBy("row").agg(F.collect_list("s").alias("more"))


def repeated_passages(docs: DataFrame, similarity: float = SIMILARITY, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Per row: doc_id, n_words, n_paragraphs, n_repeated, n_removed, repeated, removed.

    ``repeated`` are merged word spans (``start:end``, comma-joined) that another place also
    has, ``removed`` those that go because an earlier place (by doc_id, then position)
    keeps them; ``n_repeated`` and ``n_removed`` count their words. Words are A-Z-lowered
    runs without white space. Null and empty texts have none. Every row gives one row;
    repeated rows and equal ids are copies of each other. Null ids come first. An empty
    table gives an empty result.
    """
    size = docs.select(F.sum(F.octet_length(F.col("text").cast("string")) + 1)).first()[0] or 0
    partitions = max(1, math.ceil(size / BYTES_A_KEY / KEYS_A_PARTITION))
    packs = cut_lineage(_packs(docs, similarity))
    exact = _extended_spans(cut_lineage(_found_blocks(packs, _answers(packs, partitions))), partitions)
    parts = connected_components(_paragraph_links(docs, packs, similarity, bucket_rows), "a", "b")
    joined = exact.join(_fuzzy_spans(packs, parts, similarity), "row", "left")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list] = [[], [], [], []]
            for one, two in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                spans = [*(one or ()), *(two or ())]
                every = _merged((s["start"], s["end"]) for s in spans)
                gone = _merged((s["start"], s["end"]) for s in spans if s["goes"])
                for column, value in zip(found, (sum(e - s for s, e in every), sum(e - s for s, e in gone), _joined(every), _joined(gone))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.string()), pa.array(found[3], pa.string())], ["doc_id", "n_words", "n_paragraphs", "n_repeated", "n_removed", "repeated", "removed"])

    return joined.select("doc_id", "n_words", "n_paragraphs", "spans", "more").mapInArrow(merge, "doc_id long, n_words int, n_paragraphs int, n_repeated long, n_removed long, repeated string, removed string")


def _merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def _joined(spans: list[tuple[int, int]]) -> str:
    return ",".join(f"{s}:{e}" for s, e in spans)
