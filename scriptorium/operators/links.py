"""Link and citation graphs as edge tables.

Pages have ``stem``, ``path``, ``body`` and, where needed, ``aliases`` and ``cites``.
Lookups join on the page key; only presence is asked for, so they are semi or anti joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import link_targets

_LINE_ENDS = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"


def page_links(pages: DataFrame) -> DataFrame:
    """``(src, path, line, target)`` for each link, line by line of the body."""
    lines = pages.select(F.col("stem").alias("src"), "path", F.posexplode(F.split("body", _LINE_ENDS)).alias("at", "text"))
    lines = lines.where(F.col("text").contains("[["))
    return lines.select("src", "path", (F.col("at") + 1).alias("line"), F.explode(link_targets(F.col("text"))).alias("target"))


def alias_map(pages: DataFrame) -> DataFrame:
    """``(alias, canonical)``; of several pages with an alias the last path wins."""
    each = pages.select("stem", "path", F.explode("aliases").alias("alias"))
    return each.groupBy("alias").agg(F.max_by("stem", F.struct("path", "stem")).alias("canonical"))


def resolved_links(links: DataFrame, pages: DataFrame, aliases: DataFrame) -> DataFrame:
    """Links with ``resolved`` (page key or null) and ``kind``: page, alias or dead."""
    stems = pages.select(F.col("stem").alias("_stem")).distinct()
    by_alias = aliases.select(F.col("alias").alias("_alias"), "canonical")
    joined = links.join(stems, links["target"] == stems["_stem"], "left").join(by_alias, links["target"] == by_alias["_alias"], "left")
    kind = F.when(F.col("_stem").isNotNull(), "page").when(F.col("canonical").isNotNull(), "alias").otherwise("dead")
    return joined.select(*links.columns, F.coalesce("_stem", "canonical").alias("resolved"), kind.alias("kind"))


def orphans(pages: DataFrame, resolved: DataFrame) -> DataFrame:
    """Pages that no link reaches, be it through an alias."""
    return pages.join(resolved.where("resolved IS NOT NULL").select(F.col("resolved").alias("stem")), "stem", "left_anti")


def invalid_cites(pages: DataFrame, known: DataFrame) -> DataFrame:
    """``(stem, cited)`` where the cited id is no page's key."""
    edges = pages.select("stem", F.explode("cites").alias("cited"))
    return edges.join(known.select(F.col("stem").alias("cited")), "cited", "left_anti").select("stem", "cited")


def cited_by(edges: DataFrame) -> DataFrame:
    """``(cited, n_citing, citing)`` with citing ids sorted; edges are ``(src, dst)``."""
    return edges.groupBy(F.col("dst").alias("cited")).agg(F.countDistinct("src").alias("n_citing"), F.array_sort(F.collect_set("src")).alias("citing"))


def cited_counts(edges: DataFrame) -> DataFrame:
    """In-degree alone, which needs no list of a much-cited page's citers in one row."""
    return edges.groupBy(F.col("dst").alias("cited")).agg(F.countDistinct("src").alias("n_citing"))


def one_hop(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """Keys one link away from the hits, and the hits; ``hits`` has ``key``."""
    out = edges.join(hits.select(F.col("key").alias("src")).distinct(), "src", "left_semi").select(F.col("dst").alias("key"))
    return hits.select("key").union(out).distinct()


def index_drift(pages: DataFrame, index: DataFrame, aliases: DataFrame) -> DataFrame:
    """``(target, kind)``: index links to nothing, and pages that the index lacks.

    ``index`` has the whole ``text`` of the index page: its links may span lines. Without
    an index page there is nothing to drift from.
    """
    linked = index.select(F.explode(link_targets(F.col("text"))).alias("target")).distinct()
    known = pages.select(F.col("stem").alias("target")).union(aliases.select(F.col("alias").alias("target")))
    missing = linked.join(known, "target", "left_anti").withColumn("kind", F.lit("no page"))
    own = pages.where(~F.col("stem").isin("index", "log")).select(F.col("stem").alias("target"))
    absent = own.join(linked, "target", "left_anti").join(index.limit(1).select(F.lit(True).alias("_has"))).drop("_has").withColumn("kind", F.lit("not in index"))
    return missing.unionByName(absent)
