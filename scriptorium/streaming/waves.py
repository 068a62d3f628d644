"""Batches with memory: waves, status, resume, and file streams of new sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scriptorium.session import cut_lineage

# States of the final pass and those that may follow (fixed values).
TRANSITIONS = {"pending": ("in-progress", "skipped"), "in-progress": ("ok", "failed"), "failed": ("in-progress",), "ok": (), "skipped": ()}

CHECKPOINT_DEFAULTS = {"tier": "paper-only", "pre_batch_paper_ids": None, "final_pass_status": "skipped"}


def waves(items: DataFrame, key: str, size: int, chunk: int = 1 << 16) -> DataFrame:
    """``wave`` from 1 for each item in key order, ``size`` items a wave.

    Positions come from range-partitioned chunks and their prefix sums, not from one sort
    in one task. The chunks are fixed before they are counted.
    """
    ranged = cut_lineage(items.repartitionByRange(key).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    position = F.row_number().over(W.partitionBy("_part").orderBy(key)) + F.col("_base") - 1
    return ranged.join(starts, "_part").withColumn("wave", (F.floor(position / size) + 1).cast("int")).drop("_part", "_base")


def wave_status(statuses: DataFrame) -> DataFrame:
    """Items by wave and status."""
    return statuses.groupBy("wave").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "pending").alias("pending"))


def roll_up(waves_done: DataFrame, counters: list[str]) -> DataFrame:
    return waves_done.agg(*[F.sum(c).alias(c) for c in counters])


def to_run(statuses: DataFrame, retry: bool = False) -> DataFrame:
    """Items still to do; ``retry`` is the one more wave for failed ones, after which they stay failed."""
    if retry:
        return statuses.where("status = 'failed' AND attempts < 2")
    return statuses.where("status = 'pending'")


def updated_statuses(statuses: DataFrame, results: DataFrame) -> DataFrame:
    """Statuses after a wave: results (``key, status, error``) replace, the rest stays."""
    new = results.select("key", F.col("status").alias("_s"), F.col("error").alias("_e"))
    joined = statuses.join(new, "key", "left")
    return joined.select(
        *[c for c in statuses.columns if c not in ("status", "error", "attempts")],
        F.coalesce("_s", "status").alias("status"),
        F.when(F.col("_s").isNotNull(), F.col("_e")).otherwise(F.col("error")).alias("error"),
        (F.col("attempts") + F.col("_s").isNotNull().cast("int")).alias("attempts"),
    )


def demoted(statuses: DataFrame, pages: DataFrame) -> DataFrame:
    """On resume, finished items whose page is gone are pending again."""
    there = pages.select(F.col("stem").alias("key"), F.lit(True).alias("_there")).distinct()
    joined = statuses.join(there, "key", "left")
    return joined.withColumn("status", F.when((F.col("status") == "ok") & F.col("_there").isNull(), "pending").otherwise(F.col("status"))).drop("_there")


def valid_transition(old: Column, new: Column) -> Column:
    out = F.lit(False)
    for state, after in TRANSITIONS.items():
        if after:
            out = out | ((old == state) & new.isin(*after))
    return out


def with_defaults(checkpoint: DataFrame) -> DataFrame:
    """Absent and null checkpoint columns filled."""
    for name, value in CHECKPOINT_DEFAULTS.items():
        default = F.array().cast("array<string>") if value is None else F.lit(value)
        checkpoint = checkpoint.withColumn(name, F.coalesce(F.col(name), default) if name in checkpoint.columns else default)
    return checkpoint


def new_sources(batch: DataFrame, seen: DataFrame) -> DataFrame:
    """Sources of a batch not seen before by content; of equal ones the smallest path stays."""
    hashed = batch.withColumn("sha256", F.sha2(F.col("content").cast("binary"), 256))
    first = hashed.groupBy("sha256").agg(F.min_by(F.struct(*batch.columns), "path").alias("s"))
    return first.join(seen.select("sha256"), "sha256", "left_anti").select("sha256", "s.*")


def watch_sources(spark: SparkSession, folder: str, handle: Callable[[DataFrame, int], None], checkpoint: str, glob: str = "*", files_a_batch: int = 100) -> StreamingQuery:
    """A file stream that hands each micro-batch of new files to ``handle`` and ends when all are read."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_a_batch).load(folder)
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
