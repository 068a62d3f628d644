"""Deleted interpolation: n-gram maximum-likelihood estimates mixed by context frequency.

The text's log probability mixes a smoothed unigram estimate (the base) and the
maximum-likelihood estimates of orders 2 to ``order``. Weights depend on how often the
longest context was seen (a bucket), and are learned by expectation-maximisation on
held-out counts: one fold of the training documents is deleted from the counts while its
tokens are predicted. The final counts have all training documents.

Counting is columnar. Documents are packed into blocks; a block's distinct n-gram keys
(64-bit hashes of words, of which 10**9 have a pair that collides in one corpus of 40; 52 bits of
longer n-grams, of which about one in 4,500 shares its key with another at 10**12 distinct
ones and one in 10**6 at 5 * 10**9) go to key partitions as sorted binary columns, so a word that every document has costs one entry a
block, whatever its frequency. Key partitions sum the counts and send each block the totals
of its keys in the same order, without the keys. No table of the vocabulary is broadcast
or collected, and partitions are even because keys are hashes.

Expectation-maximisation runs on a histogram of (bucket, quantised estimates) of all
held-out tokens, whose size is bounded by its bins and not by the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.runtime import cut_lineage, fold, release_memory, short_lived_shuffles, text_bytes

ORDER = 3
BLOCK_BYTES = 8 << 20
KEYS_A_PARTITION = 2_500_000
HELD_OUT = 1  # remainder of documents that are never learned from
DELETED = 2  # remainder of training documents deleted while weights are learned
BINS_A_DOUBLING = 4
BUCKETS = 24  # context frequencies by powers of two
EM_ROUNDS = 60
_END = 0x9E3779B97F4A7C15
_ODD = np.uint64(0xC2B2AE3D27D4EB4F)
_GRAM_BITS = np.uint64((1 << 64) - (1 << 12))  # bits of a longer n-gram's key; see the module's text

_PACK = "block long, doc_ids binary, flags binary, lengths binary, keys binary, tokens binary, deleted boolean"


def _squeeze(a: np.ndarray) -> bytes:
    """Bytes of an array, each byte position apart, compressed."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(len(a).to_bytes(8, "little") + planes.tobytes())


def _expand(b: bytes, kind) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(b)
    n = int.from_bytes(raw[:8], "little")
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, offset=8).reshape(width, n).T).reshape(-1).view(kind)


def hashed_tokens(text: bytes) -> np.ndarray:
    """64-bit hashes of the A-Z-lowered words, then the end's."""
    words = text.lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(0)), np.uint64, len(words))
    out[-1] = _END
    return out


def _chain(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Key of a longer n-gram from its context's key and its last token's."""
    x = (context * _ODD) ^ (token + np.uint64(0x165667B19E3779F9))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def ngram_keys(tokens: np.ndarray, order: int) -> list[np.ndarray]:
    """For each order from 1, the key of the n-gram that ends at each token.

    Before a text stands the end that closed the last one; of longer contexts the
    missing words are that end again. ``tokens`` are whole texts, each with its end.
    """
    starts = np.concatenate(([True], tokens[:-1] == np.uint64(_END)))
    place = np.arange(len(tokens))
    begun = np.maximum.accumulate(np.where(starts, place, 0))
    keys = [tokens]
    for n in range(2, order + 1):
        key = None
        for back in range(n - 1, -1, -1):
            at = place - back
            t = np.where(at >= begun, tokens[np.maximum(at, 0)], np.uint64(_END))
            key = t * np.uint64(n) if key is None else _chain(key, t)
        keys.append(key & _GRAM_BITS)
    return keys


def _packs(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Blocks of documents; those of the deleted fold are apart.

    They are written to the shared folder, so that all passes are over the same blocks
    whatever becomes of executors, and texts are split into words once. A block is named by the
    whole position of its first row, which no other block has: blocks of equal documents (a
    file that stands twice) stay apart.
    """

    def pack(ids: list, flags: list, texts: list[np.ndarray], block: int) -> pa.RecordBatch:
        flat = np.concatenate(texts)
        keys, tokens = np.unique(flat, return_inverse=True)
        lengths = np.array([len(t) for t in texts], np.int64)
        marks = np.array([-1 if f is None else f for f in flags], np.int8)
        known = np.array([x is not None for x in ids], np.int64)
        both = np.stack((np.array([0 if x is None else x for x in ids], np.int64), known), axis=1)
        row = {
            "doc_ids": both.tobytes(), "flags": marks.tobytes(), "lengths": lengths.tobytes(), "keys": _squeeze(keys), "tokens": _squeeze(tokens.astype(np.uint32)),
        }
        row |= {"block": block, "deleted": flags[0] == DELETED}
        return pa.RecordBatch.from_pylist([row], pa.schema([("block", pa.int64()), *((k, pa.binary()) for k in ("doc_ids", "flags", "lengths", "keys", "tokens")), ("deleted", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[bool, list] = {}
        for batch in batches:
            for key, mark, row, text in zip(*(c for c in batch.columns)):
                kind = mark.as_py() == DELETED
                ids, flags, texts, held, first = open_.get(kind) or ([], [], [], 0, row.as_py())
                ids.append(key.as_py())
                flags.append(mark.as_py())
                raw = text.as_py()
                texts.append(hashed_tokens(raw))
                open_[kind] = [ids, flags, texts, held + len(raw), first]
                if held + len(raw) >= block_bytes:
                    yield pack(ids, flags, texts, first)
                    del open_[kind]
        for ids, flags, texts, _, first in open_.values():
            yield pack(ids, flags, texts, first)
        release_memory()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold("doc_id").cast("int").alias("mark"), F.monotonically_increasing_id().alias("row"), text_bytes().alias("text"))
    return cut_lineage(source.mapInArrow(run, _PACK))


class Block:
    """A pack opened: documents, their tokens, and the distinct keys of each order."""

    def __init__(self, row: dict, order: int) -> None:
        both = np.frombuffer(row["doc_ids"], np.int64).reshape(-1, 2)
        self.ids = [int(x) if known else None for x, known in both]
        self.marks = np.frombuffer(row["flags"], np.int8)
        self.lengths = np.frombuffer(row["lengths"], np.int64)
        tokens = _expand(row["keys"], np.uint64)[_expand(row["tokens"], np.uint32)]
        self.grams = ngram_keys(tokens, order)
        self.mark = np.repeat(self.marks, self.lengths)

    def distinct(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct keys of an order, and each token's place in them."""
        return np.unique(self.grams[n], return_inverse=True)


def _edges(keys: np.ndarray, partitions: int) -> np.ndarray:
    """Where each key partition's range begins in sorted keys."""
    marks = np.array([(p << 64) // partitions for p in range(1, partitions)], np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, marks), [len(keys)]))


_SENT = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("n", pa.int32()), ("keys", pa.binary()), ("rest", pa.binary()), ("cut", pa.binary())])


def _requests(packs: DataFrame, order: int, partitions: int) -> DataFrame:
    """A block's keys with its counts (without and in the deleted fold), by key partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, order)
                learned, deleted = block.mark != HELD_OUT, block.mark == DELETED
                for n in range(order):
                    keys, place = block.distinct(n)
                    cut = np.bincount(place[deleted], minlength=len(keys)).astype(np.uint32)
                    rest = np.bincount(place[learned & ~deleted], minlength=len(keys)).astype(np.uint32)
                    edge = _edges(keys, partitions)
                    gaps = np.diff(keys, prepend=np.uint64(0))
                    rows = []
                    for p in range(partitions):
                        a, b = edge[p], edge[p + 1]
                        if a == b:
                            continue
                        part = gaps[a:b].copy()
                        part[0] = keys[a]
                        rows.append({"part": p, "block": row["block"], "n": n, "keys": _squeeze(part), "rest": _squeeze(rest[a:b]), "cut": _squeeze(cut[a:b])})
                    yield pa.RecordBatch.from_pylist(rows, _SENT)
                release_memory()

    return packs.mapInArrow(run, "part long, block long, n int, keys binary, rest binary, cut binary")


def _totals(requests: DataFrame, partitions: int) -> DataFrame:
    """Each block's answers: totals of its keys in their order; n = -1: sizes of a partition's words."""

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for n, own in rows.groupby("n"):
            keys = [np.cumsum(_expand(k, np.uint64), dtype=np.uint64) for k in own["keys"]]
            distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
            rest = np.bincount(place, np.concatenate([_expand(x, np.uint32) for x in own["rest"]]), len(distinct)).astype(np.uint32)
            cut = np.bincount(place, np.concatenate([_expand(x, np.uint32) for x in own["cut"]]), len(distinct)).astype(np.uint32)
            if n == 0:
                out.append((0, -1, int(rows["part"].iloc[0]), None, None, int((rest + cut > 0).sum()), int((rest > 0).sum()), int(rest.sum()) + int(cut.sum()), int(rest.sum())))
            at = 0
            for block, k in zip(own["block"], keys):
                mine = place[at : at + len(k)]
                at += len(k)
                out.append((int(block), n, int(rows["part"].iloc[0]), _squeeze(rest[mine]), _squeeze(cut[mine]), 0, 0, 0, 0))
        release_memory()
        return pd.DataFrame(out, columns=["block", "n", "part", "rest", "cut", "known", "known_rest", "seen", "seen_rest"])

    schema = "block long, n int, part long, rest binary, cut binary, known long, known_rest long, seen long, seen_rest long"
    with short_lived_shuffles(requests.sparkSession):
        return cut_lineage(requests.repartition(partitions, "part").groupBy("part").applyInPandas(answer, schema))


BYTES_A_TOKEN = 5  # about; only the number of key partitions depends on it


def counts(docs: DataFrame, packs: DataFrame, order: int = ORDER, keys_a_partition: int = KEYS_A_PARTITION) -> tuple[DataFrame, dict]:
    """(answers, statistics): each block's n-gram totals, and the training corpus's sizes."""
    size = docs.select(F.sum(F.octet_length(F.col("text").cast("string")) + 1)).first()[0] or 0
    partitions = max(1, math.ceil(size / BYTES_A_TOKEN * order / keys_a_partition))
    answers = _totals(_requests(packs, order, partitions), partitions)
    sums = answers.where("n < 0").agg(*[F.sum(c) for c in ("known", "known_rest", "seen", "seen_rest")]).first()
    return answers.where("n >= 0"), dict(zip(("words", "rest_words", "tokens", "rest_tokens"), (int(x or 0) for x in sums)))


def answered(packs: DataFrame, answers: DataFrame) -> DataFrame:
    """Packs with the answers to their requests."""
    arrays = answers.groupBy("block").agg(F.collect_list(F.struct("n", "part", "rest", "cut")).alias("answers"))
    return packs.join(arrays, "block", "left")


class Counted(Block):
    """A block with the totals of each token's n-grams and contexts."""

    def __init__(self, row: dict, order: int, deleted: bool) -> None:
        super().__init__(row, order)
        if row["answers"] is None:
            raise RuntimeError("documents changed between the passes over them")
        totals = []
        for n in range(order):
            own = sorted((a for a in row["answers"] if a["n"] == n), key=lambda a: a["part"])
            counts = np.concatenate([_expand(a["rest"], np.uint32) for a in own]).astype(np.int64)
            if not deleted:
                counts += np.concatenate([_expand(a["cut"], np.uint32) for a in own])
            keys, place = self.distinct(n)
            if len(counts) != len(keys) or len({a["part"] for a in own}) != len(own):
                raise RuntimeError(f"block {row['block']} has {len(keys)} keys of order {n + 1} and answers to {len(counts)}")
            totals.append(counts[place])
        self.counts = totals
        first = np.concatenate(([0], np.cumsum(self.lengths)))[:-1]
        ends = totals[0][-1] if len(totals[0]) else 0  # the last token is an end: its count is that of texts
        self.contexts = []
        for n in range(order - 1):  # an n-gram's context is the gram that ends one token before
            before = np.concatenate(([0], totals[n][:-1]))
            before[first] = ends
            self.contexts.append(before)

    def estimates(self, tokens: int, words: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """(base, higher orders' ML estimates, bucket) for each token."""
        base = (self.counts[0] + 0.5) / (tokens + 0.5 * (words + 1))
        higher = [np.divide(c, x, out=np.zeros(len(c)), where=x > 0) for c, x in zip(self.counts[1:], self.contexts)]
        higher = [np.minimum(p, 1.0) for p in higher]
        depth = np.zeros(len(base), np.int64)
        seen = np.zeros(len(base), np.int64)
        for n, x in enumerate(self.contexts):
            depth = np.where(x > 0, n + 1, depth)
            seen = np.where(x > 0, x, seen)
        power = np.minimum(BUCKETS - 1, np.floor(np.log2(np.maximum(seen, 1))).astype(np.int64))
        return base, higher, depth * BUCKETS + power


def _bin(p: np.ndarray) -> np.ndarray:
    """Quarter-doublings of a probability; 0 stays apart."""
    return np.where(p > 0, 1 + np.rint(-np.log2(np.where(p > 0, p, 1)) * BINS_A_DOUBLING).astype(np.int64), 0)


def _unbin(b: np.ndarray) -> np.ndarray:
    return np.where(b > 0, 2.0 ** (-(b - 1) / BINS_A_DOUBLING), 0.0)


def held_out_histogram(blocks: DataFrame, stats: dict, order: int) -> pd.DataFrame:
    """Tokens of the deleted fold by bucket and quantised estimates; bounded by the bins."""
    names = [f"b{n}" for n in range(order)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Counted(row, order, deleted=True)
                base, higher, bucket = block.estimates(stats["rest_tokens"], stats["rest_words"])
                table = np.stack([bucket, _bin(base), *map(_bin, higher)], axis=1)
                kinds, n = np.unique(table, axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in kinds.T] + [pa.array(n)], ["bucket", *names, "n"])

    schema = "bucket long, " + ", ".join(f"{x} long" for x in names) + ", n long"
    with short_lived_shuffles(blocks.sparkSession):
        kinds = blocks.mapInArrow(run, schema).groupBy("bucket", *names).agg(F.sum("n").alias("n"))
        return kinds.orderBy("bucket", *names).toPandas()


def learn_weights(histogram: pd.DataFrame, order: int, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Weights (bucket by order) that raise the held-out likelihood; order 1 is the base.

    Buckets without held-out tokens keep even weights over the base and the orders whose
    context was seen; a higher order whose context was never seen has weight 0.
    """
    weights = np.zeros((order * BUCKETS, order))
    for bucket in range(len(weights)):
        depth = bucket // BUCKETS
        weights[bucket, : depth + 1] = 1 / (depth + 1)
    for bucket, own in histogram.groupby("bucket"):
        p = np.stack([_unbin(own[f"b{n}"].to_numpy()) for n in range(order)], axis=1)
        n = own["n"].to_numpy(np.float64)[:, None]
        w = weights[int(bucket)].copy()
        for _ in range(rounds):
            part = p * w
            part /= part.sum(axis=1, keepdims=True)
            w = (part * n).sum(axis=0) / n.sum()
            w[0] = max(w[0], 1e-4)  # unseen n-grams keep a probability
            w /= w.sum()
        weights[int(bucket)] = w
    return weights


def score_texts(docs: DataFrame, order: int = ORDER, block_bytes: int = BLOCK_BYTES, keys_a_partition: int = KEYS_A_PARTITION) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows whose crc32(doc_id) mod 5 is not 1 (null ids are learned from) and
    scores all rows. Words are A-Z-lowered runs without ASCII white space; each text ends
    with one end token. Null and empty texts are the end alone. Repeated rows count and are
    returned as often as they stand; an empty table gives an empty result.
    """
    packs = _packs(docs, block_bytes)
    answers, stats = counts(docs, packs, order, keys_a_partition)
    held = answered(packs.where("deleted"), answers)
    weights = learn_weights(held_out_histogram(held, stats, order), order)
    total, words = stats["tokens"], stats["words"]
    blocks = answered(packs, answers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Counted(row, order, deleted=False)
                base, higher, bucket = block.estimates(total, words)
                p = weights[bucket, 0] * base
                for n, q in enumerate(higher):
                    p += weights[bucket, n + 1] * q
                at = np.concatenate(([0], np.cumsum(block.lengths)))[:-1]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(block.ids, pa.int64()),
                        pa.array(block.marks == HELD_OUT),
                        pa.array(block.lengths),
                        pa.array(np.add.reduceat((block.counts[0] > 0).astype(np.int64), at)),
                        pa.array(np.full(len(at), total, np.int64)),
                        pa.array(np.add.reduceat(np.log10(base), at)),
                        pa.array(np.add.reduceat(np.log10(p), at)),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return blocks.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
