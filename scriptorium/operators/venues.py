"""Venue migration: a plan of renames and merges, and the pages it rewrites."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.arrays import retagged, sorted_union
from scriptorium.functions.dates import created_prefix
from scriptorium.functions.text import blank, slug_uncut, venue_name
from scriptorium.operators.matching import near_duplicate_keys
from scriptorium.operators.merging import majority
from scriptorium.session import cut_lineage, stored


BROADCAST_NAMES = 500_000


@dataclass(frozen=True)
class Plan:
    """``groups`` to rename or merge, ``members`` with their new slug, ``skipped`` pages with a reason."""

    groups: DataFrame
    members: DataFrame
    skipped: DataFrame
    unchanged: DataFrame


def checked_pages(pages: DataFrame) -> DataFrame:
    """Venue pages with ``new_name``, ``new_slug`` and ``skip_reason`` (null for usable ones).

    Names and slugs are worked out once for each spelling and joined back.
    """
    spelled = pages.select(F.col("name").alias("_name")).distinct().withColumn("new_name", venue_name(F.col("_name")))
    spelled = cut_lineage(cut_lineage(spelled).withColumn("new_slug", slug_uncut(F.col("new_name"))))  # fixed, else a later filter works names out again
    if spelled.count() <= BROADCAST_NAMES:  # a row a spelling; beyond this the join shuffles
        spelled = F.broadcast(spelled)
    named = pages.join(spelled, pages["name"].eqNullSafe(spelled["_name"]), "left").drop("_name")
    reason = (
        F.when(F.col("type").isNull() | (F.col("type") != "venue"), "type is not venue")
        .when(blank(F.col("name")), "missing name")
        .when(F.col("new_name").isNull(), "name is empty after normalisation")
        .when(F.col("new_slug").isNull(), "slug is empty")
    )
    return named.withColumn("skip_reason", reason)


def venue_plan(pages: DataFrame) -> Plan:
    """Group pages (``slug, name, type, venue_type, created, papers, tags``) by their new slug.

    A group takes its longest name (first by old slug on ties), its commonest venue type,
    its earliest date, and the sorted unions of papers and tags. A page whose slug is right
    already and that merges with no other is unchanged.
    """
    checked = stored(checked_pages(pages))
    usable = checked.where("skip_reason IS NULL").drop("skip_reason")
    none = F.array().cast("array<string>")
    usable = usable.withColumn("venue_type", F.coalesce("venue_type", F.lit("journal"))).withColumn("n_papers", F.size(F.coalesce("papers", none)))
    types = majority(usable, "new_slug", "venue_type", "n_papers", "slug")
    groups = usable.groupBy("new_slug").agg(
        F.min_by("new_name", F.struct((-F.length("new_name")).alias("l"), F.col("slug"))).alias("name"),
        F.min(created_prefix(F.col("created"))).alias("created"),
        sorted_union(F.collect_list(F.coalesce("papers", none))).alias("papers"),
        sorted_union(F.collect_list(F.coalesce("tags", none))).alias("tags"),
        F.count("*").alias("n_members"),
        F.min("slug").alias("first_slug"),
    )
    groups = stored(groups.join(types, "new_slug").withColumn("created", F.coalesce("created", F.lit(""))))
    same = (F.col("n_members") == 1) & (F.col("first_slug") == F.col("new_slug"))
    changed = groups.where(~same)
    moved = changed.select("new_slug")
    if groups.count() <= BROADCAST_NAMES:  # a row a group; beyond this the join shuffles
        moved = F.broadcast(moved)
    members = usable.join(moved, "new_slug", "left_semi").select("slug", "new_slug", "n_papers")
    return Plan(changed, members, checked.where("skip_reason IS NOT NULL").select("slug", "skip_reason"), groups.where(same))


def paper_rewrites(papers: DataFrame, plan: Plan) -> DataFrame:
    """``(paper_id, old_slug, new_slug)`` of papers that name a venue by an old slug.

    The venue field decides before the tags; of several tags the first one.
    """
    moved = plan.members.where("slug <> new_slug").select(F.col("slug").alias("old_slug"), "new_slug").distinct()
    named = papers.select("paper_id", F.lit(-1).alias("at"), F.col("venue").alias("old_slug"))
    tagged = papers.select("paper_id", F.posexplode("tags").alias("at", "tag")).where("tag LIKE 'venue/%'").select("paper_id", "at", F.substring("tag", 7, 1 << 20).alias("old_slug"))
    hits = named.union(tagged).join(moved, "old_slug")
    return hits.groupBy("paper_id").agg(F.min_by(F.struct("old_slug", "new_slug"), "at").alias("to")).select("paper_id", "to.*")


def rewritten_papers(papers: DataFrame, rewrites: DataFrame, today: Column) -> DataFrame:
    """Papers with venue, venue tag and update date rewritten where the plan says so."""
    joined = papers.join(rewrites, "paper_id", "left")
    hit = F.col("new_slug").isNotNull()
    tags = retagged(F.col("tags"), F.concat(F.lit("venue/"), "old_slug"), F.concat(F.lit("venue/"), "new_slug"))
    return joined.select(
        *[c for c in papers.columns if c not in ("venue", "tags", "updated")],
        F.when(hit, F.col("new_slug")).otherwise(F.col("venue")).alias("venue"),
        F.when(hit, tags).otherwise(F.col("tags")).alias("tags"),
        *([F.when(hit, today.cast("string")).otherwise(F.col("updated").cast("string")).alias("updated")] if "updated" in papers.columns else []),
    )


def migrated_pages(pages: DataFrame, plan: Plan, today: Column) -> DataFrame:
    """All venue pages after the plan: group pages with old slugs as aliases, other pages as they were."""
    old = plan.members.groupBy("new_slug").agg(F.array_sort(F.collect_set("slug")).alias("olds"))
    new = plan.groups.join(old, "new_slug").select(
        F.col("new_slug").alias("slug"), "name", F.lit("venue").alias("type"), "venue_type", "created", "papers", "tags", F.array_remove("olds", F.col("new_slug")).alias("aliases"), today.cast("string").alias("updated")
    )
    kept = pages.join(plan.members.select("slug"), "slug", "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def plan_summary(plan: Plan, rewrites: DataFrame) -> DataFrame:
    """One row of totals for the report."""
    g = plan.groups.agg(
        F.count_if(F.col("n_members") == 1).alias("renamed"), F.count_if(F.col("n_members") > 1).alias("merged_into"), F.coalesce(F.sum(F.when(F.col("n_members") > 1, F.col("n_members"))), F.lit(0)).alias("merged_from"), F.coalesce(F.sum("n_members"), F.lit(0)).alias("in_plan")
    )
    n = lambda df, name: df.agg(F.count("*").alias(name))
    slugs = plan.groups.select(F.col("new_slug").alias("key")).union(plan.members.select(F.col("slug").alias("key")))
    one = g.join(n(plan.skipped, "skipped")).join(n(plan.unchanged, "unchanged")).join(n(rewrites, "rewrites")).join(n(near_duplicate_keys(slugs), "near_duplicates"))
    return one.withColumn("considered", F.col("in_plan") + F.col("skipped") + F.col("unchanged"))
