"""Pages brought up to date field by field, without undoing what a user corrected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.functions.text import blank, slug_uncut, venue_name, venue_type
from scriptorium.session import cut_lineage

STRETCH = 1 << 16


def three_way(base: DataFrame, stored: DataFrame, incoming: DataFrame, key: str, fields: list[str], unions: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows, conflicts) of three tables of one row a key: what both sides last had, what is stored, what comes in.

    A field that only one side changed takes that side's value, one that both changed alike takes it
    too. A field that both changed in different ways keeps the stored value and is a conflict
    ``(key, field, base, stored, incoming)`` as text. Array fields of ``unions`` take the stored entries, then the incoming ones that
    are new, without those that a side took out of the base. A key that is not stored comes in as it is, unless the base had
    it (then it was deleted and stays so); a key that does not come in stays as stored. Nulls are values. ``rows`` has ``origin``: new, merged or kept.
    """
    named = lambda df, side: df.select(F.col(key), F.struct(*[F.col(f) for f in fields]).alias(side))
    both = named(stored, "s").join(named(incoming, "i"), key, "full").join(named(base, "b"), key, "left")
    both = both.where(F.col("s").isNotNull() | F.col("b").isNull())
    merged, clashes = [], []
    for f in fields:
        s, i, b = F.col(f"s.{f}"), F.col(f"i.{f}"), F.col(f"b.{f}")
        if f in unions:
            none = F.array().cast(stored.schema[f].dataType)
            was, mine, their = F.coalesce(b, none), F.coalesce(s, none), F.coalesce(i, none)
            gone = F.array_union(F.array_except(was, mine), F.array_except(was, their))
            value = F.array_except(F.array_union(mine, their), gone)
        else:
            clash = ~s.eqNullSafe(i) & ~i.eqNullSafe(b) & ~s.eqNullSafe(b)
            value = F.when(i.eqNullSafe(b), s).when(s.eqNullSafe(b), i).otherwise(s)
            text = lambda c: c.cast("string")
            clashes.append(F.when(clash, F.struct(F.lit(f).alias("field"), text(b).alias("base"), text(s).alias("stored"), text(i).alias("incoming"))))
        merged.append(F.when(F.col("s").isNull(), i).when(F.col("i").isNull(), s).otherwise(value).alias(f))
    origin = F.when(F.col("s").isNull(), "new").when(F.col("i").isNull(), "kept").otherwise("merged")
    rows = both.select(key, *merged, origin.alias("origin"))
    met = both.where(F.col("s").isNotNull() & F.col("i").isNotNull())
    if not clashes:
        clashes = [F.lit(None).cast("struct<field:string,base:string,stored:string,incoming:string>")]
    conflicts = met.select(key, F.explode(F.filter(F.array(*clashes), lambda x: x.isNotNull())).alias("x")).select(key, "x.*")
    return rows, conflicts


def venue_contributions(papers: DataFrame) -> DataFrame:
    """``(slug, name, venue_type, paper_id, seq, tags)`` of papers that name a venue (``paper_id, seq, venue, tags``).

    Names are worked out once for each spelling, and joined back.
    """
    spelled = papers.where(~blank(F.col("venue"))).select("venue").distinct().select("venue", venue_name(F.col("venue")).alias("name"))
    named = cut_lineage(spelled.where("name IS NOT NULL"))
    slugged = cut_lineage(named.select("venue", "name", slug_uncut(F.col("name")).alias("slug"), venue_type(F.col("name")).alias("venue_type")))
    tags = F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: t.startswith("field/"))
    return papers.select("paper_id", "seq", "venue", tags.alias("tags")).join(slugged.where("slug IS NOT NULL"), "venue").drop("venue")


def upsert_venues(pages: DataFrame, members: DataFrame, tags: DataFrame, papers: DataFrame, today: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, members, tags) after a batch of papers.

    ``pages`` has ``slug, name, venue_type, created, updated``; ``members`` (``slug, paper_id, place``) and ``tags`` (``slug, tag, place``) are
    its lists, a row an entry, so a venue of very many papers is no row of its own. A new venue takes its name
    and type from its first paper. A stored page keeps its slug, name, type and date of creation, which the user
    may have corrected; papers and field tags that it lacks are put after those it has, in order of ``seq``; it is updated
    today if its venue had a paper in the batch. Papers without a venue, or with one that has no slug, change nothing.
    """
    news = venue_contributions(papers)
    first = news.groupBy("slug").agg(F.min_by(F.struct("name", "venue_type"), F.struct("seq", "paper_id")).alias("x"), F.lit(True).alias("_new"))
    old = pages.select("slug", F.struct("name", "venue_type", "created", "updated").alias("old"))
    both = old.join(first, "slug", "full")
    day = today.cast("string")
    field = lambda name: F.when(F.col("old").isNotNull(), F.col(f"old.{name}"))
    page = both.select(
        "slug",
        field("name").otherwise(F.col("x.name")).alias("name"),
        field("venue_type").otherwise(F.col("x.venue_type")).alias("venue_type"),
        F.when(F.col("old").isNotNull(), F.col("old.created").cast("string")).otherwise(day).alias("created"),
        F.when(F.col("_new"), day).otherwise(F.col("old.updated").cast("string")).alias("updated"),
    )
    each = news.select("slug", F.posexplode("tags").alias("at", "tag"), "seq")
    return page, _appended(members, news, "paper_id", F.struct("seq", "paper_id")), _appended(tags, each, "tag", F.struct("seq", "at"))


def _appended(entries: DataFrame, new: DataFrame, value: str, order: Column) -> DataFrame:
    """Entries of each page's list with the new ones after them in their order, each value once."""
    fresh = new.groupBy("slug", value).agg(F.min(order).alias("order")).join(entries.select("slug", value), ["slug", value], "left_anti")
    last = entries.groupBy("slug").agg(F.max("place").alias("last"))
    placed = _numbered(fresh).join(last, "slug", "left")
    return entries.select("slug", value, "place").union(placed.select("slug", value, (F.coalesce("last", F.lit(0)) + F.col("nth")).alias("place")))


def _numbered(fresh: DataFrame) -> DataFrame:
    """``nth`` of each row in its page's order, from 1.

    Counted in stretches of ``STRETCH`` numbers of ``seq``: a page with very many new entries is no single task's.
    """
    parts = fresh.withColumn("part", F.floor(F.col("order.seq") / STRETCH))
    sizes = parts.groupBy("slug", "part").agg(F.count("*").alias("n"))
    before = W.partitionBy("slug").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("slug", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = W.partitionBy("slug", "part").orderBy("order")
    return parts.join(starts, ["slug", "part"]).withColumn("nth", F.col("start") + F.row_number().over(within)).drop("part", "start", "order")
