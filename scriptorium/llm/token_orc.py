"""Token ids in ORC: integer run-length encoding, row indexes, Bloom filters on ids.

Documents are range-partitioned on (doc_id, position of the row), so files are in ascending
order and equal ids stay spread; each task encodes its sorted rows and writes one ORC file
whose stripes readers can take in parallel. Statistics and Bloom filters on ``doc_id`` let
a reader of some documents skip stripes and row groups.

Encoding is byte-level BPE through the tokenizers library, once for each distinct word of a
block of texts (see :class:`Encoder`).
"""

from __future__ import annotations

import json
import math
import os
import re
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.hashing import mix
from scriptorium.llm.runtime import cut_lineage, release_memory, shared_folder, small_batches, text_bytes

END_ID = 0
TOKENIZER_FILE = "byte_bpe_50k.json"
STRIPE_BYTES = 16 << 20
ROW_INDEX_STRIDE = 1000
BLOCK_BYTES = 1 << 18  # of text encoded together
RELEASE_BYTES = 1 << 23  # of text after which a worker gives freed memory back
MEMO_UNITS = 2_000_000  # units remembered by a worker, about 45 bytes each with their ids
FLAT_IDS = 1 << 20  # by which the room for their ids grows
RECENT_UNITS = 100_000  # of them, kept in a small table of their own
SHORT_BYTES = 15  # of a unit that two words hold
LONG_BYTES = 256  # longer units are not remembered
LONG_UNITS = 50_000  # of those between, remembered by a worker
PART_BYTES = 128 << 20  # of text in a file
LEAST_PART_BYTES = 8 << 20  # of text in a file where cores would be idle

_MAYBE_SPACE = re.compile(rb"[\xc2\xe1-\xe3]")
_OTHER_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_workers: dict[str, "Encoder"] = {}


class Encoder:
    """Ids of whole texts, equal to the library's own for them.

    Byte-level BPE encodes pre-tokens independently, so a text falls exactly into units at
    its white space: a word with the blank before it, a white-space character before a
    word that is no blank, and the rest of a run of white space. A block's units are found in
    numpy. One of up to ``SHORT_BYTES`` bytes is two 64-bit words, from which it can be told
    exactly (see :func:`unit_words`); a bounded table of the units met so far is searched by a
    hash of the two, and both are compared on every hit. New ones go through the library
    together, one a line. Longer units are looked up by their bytes. Texts with white space
    outside ASCII or with an added token's string, and other kinds of tokenizer, go
    through the library whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        pre = config.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not config.get("normalizer")
        line = self._whole(b"\n")
        self.line = int(line[0]) if plain and len(line) == 1 else None
        self.added = tuple(t["content"].encode() for t in config.get("added_tokens", []))
        self._forget()

    def _whole(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, np.int32)

    def _fits(self, text: bytes) -> bool:
        return not any(a in text for a in self.added) and not (_MAYBE_SPACE.search(text) and _OTHER_SPACE.search(text.decode()))

    def _unit_ids(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, lengths) of distinct units; words in one call, one a line, white space one by one."""
        blank = np.array([u.isspace() for u in units])
        text = b"\n".join([u for u, b in zip(units, blank.tolist()) if not b]).decode()
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
        marks = np.flatnonzero(ids == self.line)
        if blank.any() or len(marks) != len(units) - 1:
            parts = iter(np.split(ids, marks)) if len(marks) == (~blank).sum() - 1 else None
            found = [self._whole(u) if b or parts is None else (p := next(parts))[int(len(p) > 0 and p[0] == self.line) :] for u, b in zip(units, blank.tolist())]
            return np.concatenate(found), np.array([len(f) for f in found], np.int64)
        return np.delete(ids, marks), np.diff(np.concatenate(([-1], marks, [len(ids)]))) - 1

    def _learn(self, keys: np.ndarray, heads: np.ndarray, tails: np.ndarray, units: list[bytes]) -> None:
        """Add new units' ids (sorted keys) to the small table; a full one joins the large one."""
        flat, lengths = self._unit_ids(units)
        self._put(flat)
        _insert(self.recent, (keys, heads, tails, self.used + np.cumsum(lengths) - lengths, lengths))
        self.used += len(flat)
        if len(self.recent[0]) > RECENT_UNITS:
            _insert(self.settled, self.recent)
            self.recent = _no_units()

    def _put(self, ids: np.ndarray) -> None:
        """Write ids behind those in use."""
        if self.used + len(ids) > len(self.flat):
            self.flat.resize(self.used + len(ids) + FLAT_IDS, refcheck=False)  # no view of it is kept
        self.flat[self.used : self.used + len(ids)] = ids

    def _forget(self) -> None:
        self.settled, self.recent, self.flat, self.used = _no_units(), _no_units(), np.empty(FLAT_IDS, np.int32), 0
        self.long: dict[bytes, np.ndarray] = {}

    def _find(self, keys: np.ndarray, heads: np.ndarray, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(places of the ids, numbers of ids, which units are known, which have another's key)."""
        base, lengths = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        known, clash = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        for have, head, tail, places, sizes in (self.settled, self.recent):
            if len(have):
                at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
                hit = have[at] == keys
                same = hit & (head[at] == heads) & (tail[at] == tails)
                base[same], lengths[same] = places[at[same]], sizes[at[same]]
                known |= same
                clash |= hit & ~same
        return base, lengths, known, clash

    def _by_bytes(self, unit: bytes) -> np.ndarray:
        """Ids of a long unit, or of one whose key another has."""
        ids = self.long.get(unit)
        if ids is None:
            ids = self._whole(unit)
            if len(unit) <= LONG_BYTES:
                if len(self.long) >= LONG_UNITS:
                    self.long.clear()
                self.long[unit] = ids
        return ids

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, each text's number of ids); texts are UTF-8."""
        fits = [self.line is not None and self._fits(t) for t in texts]
        if not all(fits):
            done = [self.encode([t])[0] if f and t else self._whole(t) for t, f in zip(texts, fits)]
            return np.concatenate([np.zeros(0, np.int32), *done]), np.array([len(d) for d in done], np.int64)
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        joined = b"".join(texts)
        data = np.frombuffer(joined, np.uint8)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        starts = _unit_starts(data, ends)
        stops = np.append(starts[1:], len(data))
        short = np.flatnonzero(stops - starts <= SHORT_BYTES)
        heads, tails = unit_words(joined, starts[short], stops[short])
        keys = mix(heads + mix(tails))
        distinct, first, which = np.unique(keys, return_index=True, return_inverse=True)
        head, tail = heads[first], tails[first]
        base, lengths, known, clash = self._find(distinct, head, tail)
        new = np.flatnonzero(~known & ~clash)
        if len(self.settled[0]) + len(self.recent[0]) + len(new) > MEMO_UNITS:
            self._forget()
            clash, new = np.zeros(len(distinct), bool), np.arange(len(distinct))
        if len(new):
            places = short[first[new]]
            self._learn(distinct[new], head[new], tail[new], [joined[a:b] for a, b in zip(starts[places].tolist(), stops[places].tolist())])
            base, lengths, _, _ = self._find(distinct, head, tail)
        places, own = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        places[short], own[short] = base[which], lengths[which]
        others = np.ones(len(starts), bool)
        others[short] = clash[which] | (heads != head[which]) | (tails != tail[which])
        others = np.flatnonzero(others)
        if len(others):
            found = [self._by_bytes(joined[a:b]) for a, b in zip(starts[others].tolist(), stops[others].tolist())]
            self._put(np.concatenate(found))
            own[others] = [len(f) for f in found]
            places[others] = self.used + np.cumsum(own[others]) - own[others]
        at = np.cumsum(own) - own
        ids = self.flat[np.repeat(places - at, own) + np.arange(int(own.sum()))]
        text_of = np.searchsorted(ends, starts, side="right")
        return ids, np.bincount(text_of, own, len(texts)).astype(np.int64)


Units = list[np.ndarray]  # sorted keys, heads, tails, places of their ids, numbers of ids (no more than a short unit's bytes)


def _no_units() -> Units:
    return [*(np.zeros(0, np.uint64) for _ in range(3)), np.zeros(0, np.uint32), np.zeros(0, np.uint8)]


_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def unit_words(joined: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit words a unit of up to ``SHORT_BYTES`` bytes, different for different units.

    The first has the unit's first 8 bytes. The second has its size in the lowest byte and,
    of a unit over 8 bytes, its last 7 bytes above it.
    """
    eight = np.ndarray((len(joined) + 1,), "<u8", joined + bytes(8), strides=(1,))  # the 8 bytes from each place
    sizes = stops - starts
    heads = eight[starts] & _FIRST_BYTES[np.minimum(sizes, 8)]
    tails = np.where(sizes > 8, eight[np.maximum(stops - 8, 0)] & np.uint64(0xFFFFFFFFFFFFFF00), np.uint64(0))
    return heads, tails | sizes.astype(np.uint64)


def _insert(units: Units, new: Sequence[np.ndarray]) -> None:
    """Put new units among ``units``, a column after the other, so that no second table stands beside the first."""
    at = np.searchsorted(units[0], new[0])
    for k, more in enumerate(new):
        units[k] = np.insert(units[k], at, more)


def _offsets(column: pa.Array) -> np.ndarray:
    """Byte offsets of a binary column's values."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1]


def _unit_starts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where units begin. White space here is ASCII's: 9 to 13 and the blank."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    before = np.concatenate(([False], space[:-1]))  # the byte before is white space
    after = np.concatenate((space[1:], [False]))
    first = np.zeros(len(data) + 1, bool)
    first[0] = True
    first[ends] = True
    first = first[:-1]  # a text begins here
    last = np.append(first[1:], True)
    begins = first | (space & ~before)  # a run of white space, or a text
    word = ~space & before & (np.concatenate(([0], data[:-1])) != 32)  # a word after other white space
    tail = space & before & ~after & ~last  # the run's last character, before a word
    return np.flatnonzero(begins | word | tail)


def encoder(path: str) -> Encoder:
    """This process's encoder for a tokenizer file."""
    if path not in _workers:
        _workers[path] = Encoder(path)
    return _workers[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER_FILE)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> str:
    """Write ``(doc_id, pos, ids)`` as ORC under ``folder`` in ascending doc_id order; returns ``folder``.

    ``pos`` counts a file's rows. Null texts are empty; every row ends with id 0. Null ids
    come first. ``tokenizer`` is a file's path (default: the public 50k byte-level BPE).
    """
    path = tokenizer or default_tokenizer()
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pos, since = encoder(path).encode, 0, 0
        for batch in batches:
            held = np.cumsum(np.diff(_offsets(batch.column(1))))
            cuts = np.unique(np.concatenate(([0], np.searchsorted(held, np.arange(BLOCK_BYTES, held[-1] if len(held) else 0, BLOCK_BYTES), side="right"), [batch.num_rows])))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                part = batch.slice(a, b - a)
                ids, sizes = encode(part.column(1).to_pylist())
                offsets = np.concatenate(([0], np.cumsum(sizes + 1)))
                flat = np.insert(ids, np.cumsum(sizes), END_ID)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.arange(pos, pos + part.num_rows)), lists], ["doc_id", "pos", "ids"])
                pos += part.num_rows
                since += int(held[b - 1] - (held[a - 1] if a else 0))
                if since >= RELEASE_BYTES:
                    del ids, sizes, offsets, flat, lists
                    since = 0
                    release_memory()
        release_memory()

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    parts = partitions or file_count(docs, text_col)
    ordered = source.repartitionByRange(parts, "doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "text")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("pos", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    with small_batches(spark):
        (
            ordered.mapInArrow(run, schema)
            .write.mode("overwrite")
            .option("compression", "zstd")
            .option("orc.stripe.size", str(STRIPE_BYTES))
            .option("orc.create.index", "true")
            .option("orc.row.index.stride", str(ROW_INDEX_STRIDE))
            .option("orc.bloom.filter.columns", "doc_id")
            .option("orc.bloom.filter.fpp", "0.01")
            .orc(folder)
        )
    return folder


def file_count(docs: DataFrame, text_col: str = "text") -> int:
    """Files of ``PART_BYTES`` of text, or more where cores would be idle; taken from all texts' sizes."""
    size = docs.select(F.sum(F.octet_length(F.col(text_col).cast("string")) + 1)).first()[0] or 0
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return max(1, math.ceil(size / PART_BYTES), min(cores, math.ceil(size / LEAST_PART_BYTES)))


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, pos, ids, file)`` of a folder's files; filters on doc_id reach the files' indexes."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("pos", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return spark.read.schema(schema).orc(folder).select("doc_id", "pos", "ids", F.col("_metadata.file_name").alias("file"))


def token_index(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32.

    ``start`` is the number of ids in earlier documents. File totals are prefix-summed in the
    order of the files' part numbers (a row a file), and only rows of one file are sorted together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            flat = ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            ends = ids.offsets.to_numpy()
            crcs = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            sizes = np.diff(ends).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(sizes), pa.array(crcs, pa.int64())], ["doc_id", "pos", "file", "n_tokens", "ids_crc32"])
        release_memory()

    read = read_tokens(spark, folder).select("doc_id", "pos", "file", "ids")
    with small_batches(spark):
        rows = cut_lineage(read.mapInArrow(run, "doc_id long, pos long, file string, n_tokens long, ids_crc32 long"))
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("held"))
    part = F.regexp_extract("file", r"^part-(\d+)", 1).cast("long")  # as text, part 100000 would come before part 99999
    before = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    within = W.partitionBy("file").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(files, "file")
    return placed.select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def encode_and_index(docs: DataFrame, tokenizer: str | None = None, folder: str | None = None) -> DataFrame:
    """Write ``docs`` under ``folder`` (a new one in the shared folder by default) and index it.

    Repeated rows are repeated documents; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    return token_index(spark, write_tokens(docs, folder, tokenizer))
