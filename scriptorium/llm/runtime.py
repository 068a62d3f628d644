"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
from bisect import bisect_right
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.session import cut_lineage  # noqa: F401  the operators take it from here


def shared_folder(spark: SparkSession) -> str:
    """The shared folder for files an operator writes itself (no trailing slash)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="scriptorium-shared-")
    return folder.rstrip("/")


@contextmanager
def _set(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def small_batches(spark: SparkSession, size: int = 2 << 20) -> AbstractContextManager[None]:
    """Plans run inside hand rows to Python in batches of ``size`` bytes, however many rows that is.

    A batch stands in the executor, on its way and in the worker at once; one of 10,000 texts may have any size.
    """
    return _set(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def short_lived_shuffles(spark: SparkSession) -> AbstractContextManager[None]:
    """Plans made and run inside have their shuffle files removed as soon as they have run.

    For plans that run once and whose result is written or collected: a large exchange is then not
    kept on disk beside what it was turned into. Plans made outside are as the session has it.
    """
    return _set(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def release_memory() -> None:
    """Give freed memory back to the system: a reused worker should not keep a block's peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        return


def free_of(spans: list[tuple[int, int, str]]) -> Callable[[int, int], bool]:
    """Whether a stretch touches none of the spans, by a search in their union."""
    starts, stops = [], []
    for start, stop, _ in sorted(spans):
        if stops and start <= stops[-1]:
            stops[-1] = max(stops[-1], stop)
        else:
            starts.append(start)
            stops.append(stop)

    def free(start: int, stop: int) -> bool:
        at = bisect_right(stops, start)
        return at == len(starts) or starts[at] >= stop

    return free


def without_overlaps(more: list[tuple[int, int, str]], own: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Those of ``more`` that touch no span of ``own``."""
    free = free_of(own)
    return [s for s in more if free(s[0], s[1])]


def fold(column: str, parts: int = 5) -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids give null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(parts)


def text_bytes(column: str = "text") -> Column:
    """Whole text as UTF-8 bytes, null as empty; bytes reach Python without decoding."""
    return F.coalesce(F.col(column).cast("string").cast("binary"), F.lit(b""))


MARK = ("mark_a", "mark_b")


def text_mark(column: str = "text") -> tuple[Column, Column]:
    """128 bits of a text, by which rows under one id are told apart; null has its own."""
    text = F.col(column).cast("string")
    return F.xxhash64(text).alias(MARK[0]), F.xxhash64(F.lit(1), text, text.isNull()).alias(MARK[1])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
