"""SimHash fingerprints and near-duplicate groups through sharded BK-trees.

Shards. Two fingerprints within ``radius`` bits agree on at least one of ``radius + 1``
bands of their bits, so each band value is a shard key. A shard with more than
``shard_limit`` fingerprints is dealt again: its keys agree on one band, so the remaining
bits are banded once more, which leaves no link out. With radius 2 the four levels fix at
least 21, 35, 44 and 50 bits, so no shard of the last level can hold over 2**14
fingerprints, whatever the data. Each shard's tree meets only its own shard's queries:
trees are never broadcast, as their total size follows the corpus.

Trees. A node's children are keyed by their integer Hamming distance to it; a search
follows only edges within the radius of the query's distance (triangle inequality).
A shard emits one link from each fingerprint to every tree component it touches, never
all pairs, and components over the links are found by ``connected_components``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.components import connected_components
from scriptorium.llm.runtime import MARK, cut_lineage, text_bytes, text_mark

SHINGLE_WORDS = 3
RADIUS = 2
SHARD_LIMIT = 4096
HASH_SEED = 42


def shingle_hashes(text: bytes, width: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of each word shingle of A-Z-lowered text, repeats included."""
    words = text.lower().split()
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), HASH_SEED)] if words else [], np.uint64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(width))))
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(HASH_SEED)), np.uint64, len(words) - width + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set where over half the hashes have it set; no hashes give zero."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # a very long text is counted in blocks
        block = np.ascontiguousarray(hashes[at : at + (1 << 16)], "<u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, mark_a, mark_b, fp)`` for every row, fp as a signed long; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(shingle_hashes(t.as_py(), width)) for t in batch.column(3)], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(prints.view(np.int64))], ["doc_id", *MARK, "fp"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), *text_mark(text_col), text_bytes(text_col).alias("text"))
    return source.mapInArrow(run, f"doc_id long, {MARK[0]} long, {MARK[1]} long, fp long")


class BKTree:
    """Metric tree over unsigned 64-bit integers under Hamming distance."""

    def __init__(self) -> None:
        self.keys: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, key: int) -> int:
        """Insert a key that is not in the tree; returns its position."""
        at, new = 0, len(self.keys)
        self.keys.append(key)
        self.children.append({})
        while new:
            d = (self.keys[at] ^ key).bit_count()
            step = self.children[at].setdefault(d, new)
            if step == new:
                break
            at = step
        return new

    def search(self, key: int, radius: int) -> list[int]:
        """Positions of all keys within the radius."""
        found, stack = [], [0] if self.keys else []
        while stack:
            at = stack.pop()
            d = (self.keys[at] ^ key).bit_count()
            if d <= radius:
                found.append(at)
            kids = self.children[at]
            if len(kids) <= 2 * radius:
                stack.extend([k for e, k in kids.items() if -radius <= e - d <= radius])
            else:
                stack.extend(kids[e] for e in range(d - radius, d + radius + 1) if e in kids)
        return found


def shard_links(keys: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within one shard: at most one link a key and component."""
    tree, parent, links = BKTree(), [], []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for key in keys:
        near = tree.search(key, radius)
        new = tree.add(key)
        parent.append(new)
        for other in near:
            r = root(other)
            if r != root(new):
                parent[r] = root(new)
                links.append((key, tree.keys[other]))
    return links


def _bands(mask: int, parts: int) -> list[int]:
    """Split a mask's set bits into ``parts`` masks of nearly equal size."""
    bits = [i for i in range(64) if mask >> i & 1]
    size, out, at = len(bits), [], 0
    for p in range(parts):
        n = size // parts + (p < size % parts)
        out.append(sum(1 << b for b in bits[at : at + n]))
        at += n
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _deal(prints: DataFrame, radius: int, level: int) -> DataFrame:
    """Next level's shard keys: (fp, mask, value) for each further band of the unfixed bits.

    ``mask`` holds the bits that a shard's fingerprints share, ``value`` these bits.
    """
    full = (1 << 64) - 1
    if level == 0:
        pairs = {0: _bands(full, radius + 1)}
    else:
        masks = {0}
        for _ in range(level):
            masks = {m | b for m in masks for b in _bands(full & ~m, radius + 1)}
        pairs = {m: _bands(full & ~m, radius + 1) for m in masks}
    long = lambda x: F.lit(_signed(x)).cast("long")
    table: Column = F.create_map(*[x for m, bs in pairs.items() for x in (long(m), F.array(*[long(m | b) for b in bs]))])
    dealt = prints.select("fp", F.explode(table[F.col("mask")]).alias("mask"))
    return dealt.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))


def near_links(prints: DataFrame, radius: int = RADIUS, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """Links ``(a, b)`` whose components are those of all pairs within the radius.

    ``prints`` has one distinct ``fp`` long per row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, keys = None, []
        for batch in batches:
            pairs, links = zip(batch.column("mask").to_pylist(), batch.column("value").to_pylist()), []
            for pair, key in zip(pairs, batch.column("fp").to_numpy().view(np.uint64).tolist()):
                if pair != shard:
                    links += shard_links(keys, radius) if len(keys) > 1 else []
                    shard, keys = pair, []
                keys.append(key)
            if links:
                yield _link_batch(links)
        if len(keys) > 1 and (links := shard_links(keys, radius)):
            yield _link_batch(links)

    found, now = None, prints.select("fp", F.lit(0).cast("long").alias("mask"))
    for level in range(4):
        dealt = _deal(now, radius, level)
        counts = dealt.groupBy("mask", "value").count().where("count > 1")
        last = level == 3
        fit = counts if last else counts.where(F.col("count") <= shard_limit)
        shards = dealt.join(fit.select("mask", "value"), ["mask", "value"])
        shards = shards.repartition("mask", "value").sortWithinPartitions("mask", "value", "fp")
        links = shards.select("mask", "value", "fp").mapInArrow(run, "a long, b long")
        found = links if found is None else found.union(links)
        if last:
            break
        over = counts.where(F.col("count") > shard_limit)
        over = cut_lineage(dealt.join(over.select("mask", "value"), ["mask", "value"]).select("fp", "mask").distinct())
        if over.isEmpty():
            break
        now = over
    return found


def _link_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    ends = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])


def first_row() -> Column:
    """A group's first row: the smallest doc_id, none last, then the smallest mark of the text."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *MARK)).alias("first")


def print_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS, radius: int = RADIUS, shard_limit: int = SHARD_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(rows with their node, nodes with their component and first row); a node is a fingerprint."""
    rows = cut_lineage(fingerprints(docs, id_col, text_col, width).withColumnRenamed("fp", "node"))
    nodes = cut_lineage(rows.groupBy("node").agg(first_row()))
    parts = connected_components(near_links(nodes.select(F.col("node").alias("fp")), radius, shard_limit), "a", "b")
    named = nodes.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return rows, named


def with_component_ids(rows: DataFrame, named: DataFrame) -> DataFrame:
    """``rows`` with ``component_id``, the smallest doc_id of their component."""
    least = named.groupBy("component").agg(F.min("first.doc_id").alias("component_id"))
    return rows.join(named.join(least, "component").select("node", "component_id"), "node")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS, radius: int = RADIUS, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row.

    Texts are A-Z-lowered; words are runs without ASCII white space. Null and empty texts
    have fingerprint zero and link like any other. Exact copies share a fingerprint and
    are one node of the link graph, so a group of copies costs one row. ``component_id``
    is the smallest doc_id that links reach, the row's own included; a null doc_id is
    reached but never named unless its whole component has no id. Repeated rows are all
    returned; an empty table gives an empty result; other columns are not looked at.
    """
    rows, named = print_groups(docs, id_col, text_col, width, radius, shard_limit)
    return with_component_ids(rows, named).select("doc_id", F.col("node").alias("fp"), "component_id")


def keep_one(docs: DataFrame, groups: Callable[..., tuple[DataFrame, DataFrame]] = print_groups, **options) -> DataFrame:
    """One row of each group of near duplicates, all columns.

    ``groups`` is ``print_groups`` (by fingerprints) or ``near_copies.copy_groups`` (by Jaccard
    similarity). A group's row with the smallest doc_id stays; a row without an id stays only
    where none of the group has one. Of a group's rows under one id the text with the
    smallest hash stays, and one row of those alike in both. Rows are chosen by id and
    text, so texts under one id that are no near copies of each other all stay.
    """
    rows, named = groups(docs, **options)
    stay = named.groupBy("component").agg(F.min("first").alias("first"))
    stay = stay.select(F.col("first.doc_id").alias("_keep_id"), *[F.col(f"first.{m}").alias(f"_keep_{m}") for m in MARK])
    stay = cut_lineage(stay)
    same = lambda side: (F.col("_keep_id").eqNullSafe(side["doc_id"].cast("long"))) & (F.col("_keep_mark_a") == side[MARK[0]]) & (F.col("_keep_mark_b") == side[MARK[1]])
    alike = rows.groupBy("doc_id", *MARK).count().where("count > 1")
    repeated = not alike.join(stay, same(alike), "left_semi").isEmpty()
    own = docs.select(F.struct("*").alias("_own"), F.col("doc_id"), *text_mark())
    kept = own.join(stay, same(own), "left_semi")
    if repeated:
        kept = kept.dropDuplicates(["doc_id", *MARK])
    return kept.select("_own.*")
