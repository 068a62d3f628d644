"""Sources known by their contents across batches and restarts.

The hashes of all contents seen are a stored table under the hash, with the batch that brought each. A batch
reads the buckets that its own hashes fall into. What another batch brought is known; what this batch
brought itself, in a run before, is new again, so a batch that is run twice gives the same
sources twice and adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scriptorium.session import cut_lineage
from scriptorium.sources.stored import BUCKETS, StoredTable
from scriptorium.streaming.waves import watch_sources

SCHEMA = "sha256 string, path string, batch long"


def seen_table(spark: SparkSession, root: str, buckets: int = BUCKETS) -> StoredTable:
    """The table of contents seen, made where there is none."""
    table = StoredTable(spark, root)
    return table if table.exists() else StoredTable.create(spark, root, spark.createDataFrame([], SCHEMA), "sha256", buckets)


def first_of_contents(batch: DataFrame) -> DataFrame:
    """``(sha256, path)``: of the batch's equal contents the one of the smallest path; contents don't move."""
    hashed = batch.select(F.sha2(F.col("content").cast("binary"), 256).alias("sha256"), "path")
    return hashed.where("sha256 IS NOT NULL").groupBy("sha256").agg(F.min("path").alias("path"))


def absorb(table: StoredTable, batch: DataFrame, number: int) -> DataFrame:
    """``(sha256, path)`` of a batch's sources (``path, content``) that no other batch brought, and the table brought up to date.

    Rows without content are no sources. Batches are told apart by their number; the result is fixed before the table changes.
    """
    own = cut_lineage(first_of_contents(batch))
    known = table.matching(own).where(F.col("batch") != number)
    new = cut_lineage(own.join(known.select("sha256"), "sha256", "left_anti"))
    there = table.matching(new).where(F.col("batch") == number).select("sha256", "path")
    changed = new.join(there, ["sha256", "path"], "left_anti")
    if not changed.isEmpty():
        table.merge(changed.withColumn("batch", F.lit(number)), f"batch {number}")
    return new


def watch_new_sources(spark: SparkSession, folder: str, table: StoredTable, handle: Callable[[DataFrame, int], None], checkpoint: str, glob: str = "*", files_a_batch: int = 100) -> StreamingQuery:
    """A file stream whose batches reach ``handle`` as the sources that are new by content, over all batches and runs."""
    return watch_sources(spark, folder, lambda batch, number: handle(absorb(table, batch, number), number), checkpoint, glob, files_a_batch)
