"""Mixing sources to target weights by weighted sampling without replacement.

DataFrame functions only. Each document draws an exponential key divided by its quality
weight (Efraimidis-Spirakis): keys in ascending order are a weighted sample order within
the source. A source's budget is spent on complete epochs first; the rest goes to the
documents at the front of the order, by a prefix sum of sizes.

No source is sorted in one task: keys are cut into slots of about ``slot_rows`` documents
by their distribution in the source (see :func:`_slots`), slot totals are prefix-summed per
source (a row a slot), and only rows of one slot are sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.llm.runtime import cut_lineage

SOURCE_WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
MAX_REPEATS = 2.0
SLOT_ROWS = 2048
LEAST_QUALITY = 0.05
BROADCAST_SOURCES = 100_000
QUALITY_BINS = 32  # of a source's rows, by which its keys are cut into even slots
ORDER = ("key", "id", "size", "row")


def word_count(text: Column) -> Column:
    """Number of runs without ASCII white space; null texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """Quality in [LEAST_QUALITY, 1]: one less twice the share of junk marks among characters."""
    marks = F.length(text) - F.length(F.translate(text, "#$%&*|!<>{}~^", ""))
    share = F.coalesce(marks / F.greatest(F.length(text), F.lit(1)), F.lit(0.0))
    return F.greatest(F.lit(LEAST_QUALITY), F.lit(1.0) - F.lit(2.0) * share)


def uniform(name: Column) -> Column:
    """A reproducible number in (0, 1) from 48 bits of a name's md5."""
    digits = F.substring(F.md5(name.cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def source_targets(sources: DataFrame, weights: tuple[int, ...] = SOURCE_WEIGHTS, share: float = TOTAL_SHARE, repeats: float = MAX_REPEATS) -> DataFrame:
    """Adds ``target`` to ``(source, source_size)`` rows (one a source).

    Sources by code point, null last, take the weights in turn. Where level * weight
    passes the cap of ``repeats`` sizes, the source stops there and the level of the others
    rises. With sources ordered by cap per weight, the level left when a first few of them
    are capped rises until the right number is and falls after, so it is the largest one.
    The unpartitioned windows see a row a source.
    """
    cycle = F.array(*[F.lit(float(x)) for x in weights])
    by_name = W.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sources.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(repeats)))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    whole = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    up = order.rowsBetween(W.unboundedPreceding, -1)
    down = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    level = (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(up), F.lit(0.0))) / F.sum("weight").over(down)
    leveled = ranked.withColumn("level", level)
    leveled = leveled.withColumn("level", F.max("level").over(whole))
    target = F.least("cap", F.col("level") * F.col("weight"))
    return leveled.select("source", "source_size", "n_rows", target.alias("target"))


def _drawn(docs: DataFrame) -> list[Column]:
    """What places a row in its source's order: size, key, and what divides ties.

    The number drawn is of the id and the text, so that rows under one id, or under none,
    have places of their own; only rows alike in both tie, and their positions divide them.
    """
    text = F.col("text").cast("string")
    quality = quality_weight(text)
    drawn = uniform(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))
    return [
        F.col("source"), word_count(text).alias("size"), quality.alias("quality"), (-F.log(drawn) / quality).alias("key"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.monotonically_increasing_id().alias("row"),
    ]


def _slots(drawn: DataFrame, targets: DataFrame, slot_rows: int) -> DataFrame:
    """``targets`` with ``n_slots`` and ``spread``, from which a key's slot is told.

    Keys of a row of quality q are exponential with rate q, so the share of a source's keys
    below k is a mean of 1 - exp(-kq) over its rows. It is taken over ``QUALITY_BINS`` bins of
    quality (with the bin's mean as q): slots that cut this share evenly hold about
    ``slot_rows`` rows each, whatever the qualities are.
    """
    bins = drawn.groupBy("source", F.ceil(F.col("quality") * QUALITY_BINS).alias("bin")).agg(F.avg("quality").alias("q"), F.count("*").alias("n"))
    spread = bins.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("q", "n"))).alias("spread"))  # QUALITY_BINS entries at most
    joined = targets.join(spread.withColumnRenamed("source", "s"), targets["source"].eqNullSafe(F.col("s"))).drop("s")
    return joined.withColumn("n_slots", F.greatest(F.ceil(F.col("n_rows") / F.lit(slot_rows)), F.lit(1)).cast("long"))


def _slot(key: Column) -> Column:
    below = F.aggregate("spread", F.lit(0.0), lambda held, x: held + x["n"] * (F.lit(1.0) - F.exp(-key * x["q"])))
    return F.least(F.floor(below / F.col("n_rows") * F.col("n_slots")).cast("long"), F.col("n_slots") - 1)


def _with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` with their source's row of ``sources``, which is broadcast while its counted size allows."""
    small = sources.withColumnRenamed("source", "_mix_source")
    if sources.count() <= BROADCAST_SOURCES:  # a row a source; beyond this the join is left to skew handling
        small = F.broadcast(small)
    return rows.join(small, rows["source"].eqNullSafe(small["_mix_source"])).drop("_mix_source")


def _placed(docs: DataFrame, slot_rows: int, weights: tuple[int, ...], share: float, repeats: float) -> tuple[DataFrame, DataFrame]:
    """(rows with their source's figures and ``first``, the words before them; sources)."""
    drawn = cut_lineage(docs.select("doc_id", *_drawn(docs)))
    sources = drawn.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    targets = source_targets(sources, weights, share, repeats)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(1)).cast("long")
    targets = targets.withColumn("epochs", epochs).withColumn("rest", F.greatest(F.col("target") - F.col("epochs") * F.col("source_size"), F.lit(0.0)))
    targets = cut_lineage(_slots(drawn, targets, slot_rows))
    placed = _with_source(drawn, targets).withColumn("slot", _slot(F.col("key"))).drop("spread")
    totals = placed.groupBy("source", "slot").agg(F.sum("size").alias("slot_size"))
    before = W.partitionBy("source").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(F.col("source").alias("s"), F.col("slot").alias("t"), F.coalesce(F.sum("slot_size").over(before), F.lit(0)).alias("base"))
    joined = placed.join(totals, placed["source"].eqNullSafe(totals["s"]) & (placed["slot"] == totals["t"]))
    within = W.partitionBy("source", "slot").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, -1)
    first = F.col("base") + F.coalesce(F.sum("size").over(within), F.lit(0))
    return joined.withColumn("first", first), targets


def _chosen() -> Column:
    """A row is taken once more than its source's epochs if half of it fits in what is left.

    The middles of rows ascend along the order, so those chosen are its beginning.
    """
    return (F.col("first") * 2 + F.col("size") <= F.col("rest") * 2) & (F.col("rest") > 0)


def mix(docs: DataFrame, slot_rows: int = SLOT_ROWS, weights: tuple[int, ...] = SOURCE_WEIGHTS, share: float = TOTAL_SHARE, repeats: float = MAX_REPEATS) -> DataFrame:
    """Per row: doc_id, size, source, source_size, target, copies, taken.

    ``taken`` is ``copies * size``. Null texts have size 0 and null sources are a source of
    their own. Rows under one id, or without one, are drawn by their texts too; ties go by
    doc_id, size, then the row's position. A source without words has target 0 and nothing is
    taken from it (one copy of its documents stays). An empty table gives an empty result.
    """
    placed, _ = _placed(docs, slot_rows, weights, share, repeats)
    picked = placed.withColumn("copies", (F.col("epochs") + F.when(_chosen(), 1).otherwise(0)).cast("long"))
    return picked.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, slot_rows: int = SLOT_ROWS, weights: tuple[int, ...] = SOURCE_WEIGHTS, share: float = TOTAL_SHARE, repeats: float = MAX_REPEATS) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` takes it, whatever their ids.

    What is chosen beyond the complete epochs is the beginning of a source's order, so each
    source's last chosen place is enough to decide about a row where it is read: texts are
    not shuffled. All columns come back, null texts and sources too; rows alike in id and
    text are told apart by position. An empty table gives an empty result.
    """
    placed, targets = _placed(docs, slot_rows, weights, share, repeats)
    last = placed.where(_chosen()).groupBy(F.col("source").alias("s")).agg(F.max(F.struct(*ORDER)).alias("_mix_last"))
    cuts = targets.join(last, targets["source"].eqNullSafe(last["s"]), "left").select("source", F.col("epochs").alias("_mix_epochs"), "_mix_last")
    own = docs.withColumn("_mix_own", F.struct(*_drawn(docs)[1:]))
    place = F.struct(*[F.col(f"_mix_own.{c}").alias(c) for c in ORDER])
    copies = F.col("_mix_epochs") + F.when(place <= F.col("_mix_last"), 1).otherwise(0)
    repeated = _with_source(own, cut_lineage(cuts)).withColumn("_mix_copies", copies.cast("int")).where("_mix_copies > 0")
    return repeated.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))).select(docs.columns)
