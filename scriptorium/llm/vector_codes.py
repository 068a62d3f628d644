"""Vector code compression: product codes with integer codebooks.

Vectors become integers (``floor(scale * x)``) and are cut into equal parts; each part position
has a codebook. A round broadcasts the codebooks (entries times components, whatever the
number of rows), and Arrow batches find each part's nearest entry: squared distances by norm
expansion with exact int64 matrix products, first argmin. A task sums up its parts by entry
and sends one row an entry; a grouped shuffle merges these, and the merged sums (again
entries times components) are the next codebooks. Nothing is sampled, and every number is an
integer, so that the result doesn't depend on how rows are dealt to tasks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.runtime import cut_lineage

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
BATCH_ROWS = 2048  # distances held at a time: rows times entries
BROADCAST_LABELS = 100_000

_ENCODED = "vec_id long, label string, no_label boolean, code string, error long"


def largest_component(width: int) -> int:
    """Components beyond this stop here: twice its square, ``width`` times over, twice, is a long."""
    return math.isqrt((1 << 60) // max(width, 1))


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """``(vec_id, label, v)`` without the rows whose vector is null or holds null or non-finite components."""
    x = F.transform(F.col("embedding"), lambda c: c.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), x.alias("v"))
    return rows.where("v IS NOT NULL AND forall(v, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('Infinity'))")


def integers(column: pa.Array, width: int, scale: int = SCALE, parts: int = PARTS) -> np.ndarray:
    """Rows by parts by components of a batch of vectors, shorter ones filled up with zeros."""
    offsets = np.asarray(column.offsets, np.int64)
    flat = np.asarray(column.values, np.float64)[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    top = largest_component(width)
    out = np.zeros((len(sizes), parts * width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = np.clip(np.floor(flat * scale), -top, top)
    return out.reshape(len(sizes), parts, width)


@dataclass
class Codebooks:
    """Entries by part: ``entries`` is an int64 array of (part, entry, component)."""

    entries: np.ndarray

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(indexes, squared distances), rows by parts; of equal distances the first index."""
        codes = np.empty(vectors.shape[:2], np.int64)
        error = np.empty(vectors.shape[:2], np.int64)
        for p, book in enumerate(self.entries):
            norms = (book * book).sum(axis=1)
            for at in range(0, len(vectors), BATCH_ROWS):
                x = vectors[at : at + BATCH_ROWS, p]
                far = norms - 2 * (x @ book.T)
                best = far.argmin(axis=1)
                codes[at : at + BATCH_ROWS, p] = best
                error[at : at + BATCH_ROWS, p] = (x * x).sum(axis=1) + far[np.arange(len(x)), best]
        return codes, error

    def digest(self) -> str:
        """sha256 of all components in decimal, by part, entry and position, comma-joined."""
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def first_codebooks(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE) -> Codebooks | None:
    """The vectors of the smallest ids, in ascending order; None where no vector is kept."""
    longest = kept.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return None
    width = max(1, -(-longest // parts))
    seeds = kept.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").toArrow()["v"].combine_chunks()
    seeds = seeds.chunk(0) if isinstance(seeds, pa.ChunkedArray) else seeds
    return Codebooks(np.ascontiguousarray(integers(seeds, width, scale, parts).transpose(1, 0, 2)))


def _sums(kept: DataFrame, books: Codebooks, scale: int) -> DataFrame:
    """``(part, entry, n, sums)``: a task's parts summed up by nearest entry, one row an entry."""
    parts, entries, width = books.entries.shape
    shared = kept.sparkSession.sparkContext.broadcast(books.entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Codebooks(shared.value)
        sums, n = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = integers(batch.column(0), width, scale, parts)
            codes, _ = own.nearest(x)
            for p in range(parts):
                order = np.argsort(codes[:, p], kind="stable")
                used, first, times = np.unique(codes[order, p], return_index=True, return_counts=True)
                if len(used):
                    sums[p, used] += np.add.reduceat(x[order, p], first, axis=0)
                n[p, used] += times
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    return kept.select("v").mapInArrow(run, "part int, entry int, n long, sums array<long>")


def refined(kept: DataFrame, books: Codebooks, scale: int = SCALE) -> Codebooks:
    """One round: entries become the floored means of the parts nearest to them; unused ones stay."""
    total = lambda c: F.sum(c.cast("decimal(38,0)"))
    width = books.entries.shape[2]
    merged = _sums(kept, books, scale).groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[total(F.col("sums")[k]) for k in range(width)]).alias("sums"))
    entries = books.entries.copy()
    for row in merged.collect():  # a row an entry at most
        entries[row.part, row.entry] = [int(s) // row.n for s in row.sums]
    return Codebooks(entries)


def learned_codebooks(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks after ``rounds`` rounds over all kept vectors."""
    books = first_codebooks(kept, parts, entries, scale)
    for _ in range(rounds if books else 0):
        books = refined(kept, books, scale)
    return books


def encoded(kept: DataFrame, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """``(vec_id, label, no_label, code, error)``: two hex digits a part, and the squared distance."""
    parts, _, width = books.entries.shape
    shared = kept.sparkSession.sparkContext.broadcast(books.entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Codebooks(shared.value)
        for batch in batches:
            codes, error = own.nearest(integers(batch.column("v"), width, scale, parts))
            hexes = [bytes(c).hex() for c in codes.astype(np.uint8)]
            label = batch.column("label")
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), label, label.is_null(), pa.array(hexes, pa.string()), pa.array(error.sum(axis=1))], ["vec_id", "label", "no_label", "code", "error"])

    return kept.mapInArrow(run, _ENCODED)


def decoded(codes: DataFrame, books: Codebooks, scale: int = SCALE, length: int | None = None) -> DataFrame:
    """``codes`` with ``vector``, the entries' components over ``scale``; the way back from a code."""
    parts, _, width = books.entries.shape
    shared = codes.sparkSession.sparkContext.broadcast(books.entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.array([list(bytes.fromhex(c)) for c in batch.column("code").to_pylist()], np.int64).reshape(-1, parts)
            found = shared.value[np.arange(parts), at].reshape(len(at), parts * width)[:, :length] / scale
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(found), pa.list_(pa.float64()))], [*batch.schema.names, "vector"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in codes.schema.fields)
    return codes.mapInArrow(run, f"{schema}, vector array<double>")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """Per kept row: vec_id, code, error, label_error, codebooks_sha256.

    Rows whose vector is null or holds null or non-finite components take no part. Codebooks start
    from the smallest ids; a repeated id counts as often as it stands, by its vector's components,
    and null ids come last. With fewer rows than entries the codebooks have a row's part each.
    Parts have the longest vector's length over ``parts``, rounded up; shorter vectors, empty
    ones too, are filled up with zeros. Components beyond ``largest_component`` (2**28 for parts of
    16) stop there, so that no distance leaves a long. ``label_error`` is the error of all rows
    of a label, null labels together. At most 256 entries fit a code's two digits. An empty
    table, or one without a kept row, gives an empty result. Other columns are not read.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    kept = kept_vectors(vectors)
    books = learned_codebooks(kept, parts, entries, rounds, scale)
    spark = vectors.sparkSession
    if books is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    rows = cut_lineage(encoded(kept, books, scale))
    labels = rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    if labels.count() <= BROADCAST_LABELS:  # a row a label; beyond this the join is left to skew handling
        labels = F.broadcast(labels)
    joined = rows.join(labels, rows["label"].eqNullSafe(labels["_label"]))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
