"""Venue migration over a tree of Markdown files: what to write and remove, and the report."""

from __future__ import annotations

import datetime
import json
import re

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.arrays import retagged
from scriptorium.functions.text import plural
from scriptorium.operators.matching import near_duplicate_keys
from scriptorium.operators.venues import Plan, plan_summary
from scriptorium.session import cut_lineage

_DAY = re.compile(r"\d{4}-\d\d-\d\d")


def _dated(value: object) -> object:
    if isinstance(value, str) and _DAY.fullmatch(value):
        try:
            return datetime.date.fromisoformat(value)
        except ValueError:
            return value
    return value


def header_text(header: str | None, edits: str | None) -> str:
    """YAML of a JSON header with ``edits`` set: keys stay in order, new ones follow; ISO dates are dates."""
    fields = json.loads(header or "{}") | json.loads(edits or "{}")
    return yaml.dump({k: _dated(v) for k, v in fields.items()}, sort_keys=False, allow_unicode=True, default_flow_style=False) if fields else ""


def _header_texts(headers: pd.Series, edits: pd.Series) -> pd.Series:
    return pd.Series([header_text(h, e) for h, e in zip(headers, edits)], dtype="object")


def page_text(header: Column, edits: Column, body: Column) -> Column:
    """A page's file: header between dashes, then its body."""
    return F.concat(F.lit("---\n"), F.pandas_udf(_header_texts, "string")(header, edits), F.lit("---\n"), F.coalesce(body, F.lit("")))


def migrated_files(venue_pages: DataFrame, paper_pages: DataFrame, plan: Plan, rewrites: DataFrame, today: Column) -> DataFrame:
    """``(path, raw)`` to write; ``raw`` is null for files to remove.

    Venue pages have ``path, slug, name, header, body, aliases``, paper pages ``path, paper_id, header,
    body, tags``; paths end in the file's name. A renamed page keeps its other fields and its body. A
    merged one has a new header and the bodies of its members in order of slug. Old slugs become
    aliases. A path that another page moves to is not removed. Pages outside the plan are not returned.
    """
    none, day = F.array().cast("array<string>"), today.cast("string")
    groups = plan.groups.select("new_slug", F.col("name").alias("new_name"), "venue_type", F.col("created").alias("first_created"), F.col("papers").alias("all_papers"), F.col("tags").alias("all_tags"), "n_members")
    own = venue_pages.select("path", "slug", "name", "header", "body", F.coalesce("aliases", none).alias("aliases")).join(plan.members.select("slug", "new_slug"), "slug").join(groups, "new_slug")
    at = F.concat(F.regexp_extract("path", "^(.*?)[^/]*$", 1), "new_slug", F.lit(".md"))
    edits = F.to_json(F.struct(F.col("new_slug").alias("slug"), F.col("new_name").alias("name"), day.alias("updated"), F.array_distinct(F.concat("aliases", F.array("slug"))).alias("aliases")))
    renamed = own.where("n_members = 1").select(at.alias("path"), page_text(F.col("header"), edits, F.col("body")).alias("raw"))
    each = F.struct("slug", "name", "body", "aliases", at.alias("at"))
    merged = own.where("n_members > 1").groupBy("new_slug", "new_name", "venue_type", "first_created", "all_papers", "all_tags").agg(F.array_sort(F.collect_list(each)).alias("m"))
    aliases = F.array_remove(F.array_distinct(F.flatten(F.transform("m", lambda x: F.concat(x["aliases"], F.array(x["slug"]))))), F.col("new_slug"))
    created = F.when(F.col("first_created") != "", F.col("first_created")).otherwise(day)
    fields = F.to_json(F.struct(
        F.lit("venue").alias("type"), F.col("new_name").alias("name"), F.col("new_slug").alias("slug"), F.col("venue_type").alias("venue-type"), created.alias("created"), day.alias("updated"),
        F.col("all_papers").alias("papers"), F.col("all_tags").alias("tags"), aliases.alias("aliases"),
    ))
    section = F.transform("m", lambda x: F.concat(F.lit("### `"), x["slug"], F.lit("` — "), x["name"], F.lit("\n\n"), F.regexp_replace(F.coalesce(x["body"], F.lit("")), r"(?U)\s+$", ""), F.lit("\n")))
    body = F.concat(F.lit("\n# "), "new_name", F.lit("\n\nIts papers are listed in `papers:` above.\n\n## Merged from\n\n"), F.array_join(section, "\n"), F.lit("\n"))
    merged = merged.select(F.get("m", F.lit(0))["at"].alias("path"), page_text(F.lit("{}"), fields, body).alias("raw"))
    moved = paper_pages.join(rewrites, "paper_id")
    tag = lambda c: F.concat(F.lit("venue/"), c)
    tags = retagged(F.coalesce("tags", none), tag(F.col("old_slug")), tag(F.col("new_slug")))
    papers = moved.select("path", page_text(F.col("header"), F.to_json(F.struct(F.col("new_slug").alias("venue"), tags.alias("tags"), day.alias("updated"))), F.col("body")).alias("raw"))
    written = renamed.union(merged)
    removed = own.select("path").join(written.select("path"), "path", "left_anti").select("path", F.lit(None).cast("string").alias("raw"))
    return written.union(papers).union(removed)


def report_parts(plan: Plan, pages: DataFrame, rewrites: DataFrame, today: Column) -> DataFrame:
    """``(part, at, text)`` of the report; by part and place they are its paragraphs.

    Parts: 0 totals, 1 renames, 2 merges, 3 papers, 4 near-equal slugs, 5 skipped pages.
    ``pages`` have ``slug, venue_type``. Empty parts have no heading.
    """
    cut = lambda *c: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in c])
    line = lambda part, df, at, *c: df.select(F.lit(part).alias("part"), at.alias("at"), cut(*c).alias("text"))
    col, text = F.col, lambda name: F.col(name).cast("string")
    t = plan_summary(plan, rewrites)
    when = lambda name, *c: F.when(col(name) > 0, cut(*c)).otherwise("")
    out = line(
        0, t, F.lit(""), "# Venue Migration Plan — ", today.cast("string"), "\n\n## Summary\n- ", text("considered"), " venue pages considered (", text("unchanged"), " no-op, ", text("in_plan"), " in plan, ", text("skipped"), " skipped)\n- ",
        text("renamed"), " renamed (single-page groups)", when("merged_into", "\n- ", text("merged_from"), " pages merge into ", text("merged_into"), " canonical ", plural(col("merged_into"), "page", "pages")),
        "\n- ", text("rewrites"), " paper pages need `venue:` and `venue/*` tag rewrites", when("near_duplicates", "\n- ", text("near_duplicates"), " near-duplicate slug ", plural(col("near_duplicates"), "pair", "pairs"), " flagged for manual review"), "\n",
    )
    sizes = plan.groups.select("new_slug", "n_members", "papers", "tags", "name", col("venue_type").alias("kind"), "created")
    members = plan.members.join(sizes, "new_slug").join(pages.select("slug", F.coalesce("venue_type", F.lit("journal")).alias("own_kind")), "slug")
    out = out.union(line(1, members.where("n_members = 1"), col("slug"), "- `", col("slug"), "` → `", col("new_slug"), "`"))
    source = cut("- `", col("slug"), "` (", text("n_papers"), " ", plural(col("n_papers"), "paper", "papers"), ")")
    merges = members.where("n_members > 1").groupBy("new_slug", "n_members", "papers", "tags", "name", "kind", "created").agg(F.array_sort(F.collect_list(F.struct("slug", source.alias("line")))).alias("m"), F.array_sort(F.collect_set("own_kind")).alias("kinds"))
    listed = lambda name: cut("(union, ", F.size(name).cast("string"), " ", plural(F.size(name), "entry", "entries"), "): ", F.when(F.size(name) > 0, F.array_join(F.transform(name, lambda x: cut("`", x, "`")), ", ")).otherwise("_none_"))
    note = F.when(F.size("kinds") > 1, cut(" (of ", F.array_join("kinds", ", "), ")")).otherwise("")
    out = out.union(line(
        2, merges, col("new_slug"), "### `", col("new_slug"), "` ← merges ", text("n_members"), " pages\n", F.array_join(F.transform("m", lambda x: x["line"]), "\n"), "\nNew `papers:` list ", listed("papers"), "\nNew `tags:` list ", listed("tags"),
        '\nNew `name:` "', col("name"), '"\nNew `venue-type:` ', col("kind"), note, "\nNew `created:` ", col("created"), "\n",
    ))
    out = out.union(line(3, rewrites, col("paper_id"), "- `", col("paper_id"), ".md`: `venue: ", col("old_slug"), "` → `", col("new_slug"), "`"))
    keys = plan.groups.select(col("new_slug").alias("key")).union(plan.members.select(col("slug").alias("key")))
    out = out.union(line(4, near_duplicate_keys(keys), cut(col("a"), " ", col("b")), "- `", col("a"), "` ↔ `", col("b"), "` (similarity ", F.format_string("%.2f", "similarity"), ")"))
    out = out.union(line(5, plan.skipped, F.coalesce("slug", F.lit("")), "- ", F.coalesce("slug", F.lit("?")), ": ", col("skip_reason")))
    out = cut_lineage(out)
    heads = {1: "## Renames", 2: "## Merges", 3: "## Paper-page rewrites", 4: "## Near-duplicates for manual review", 5: "## Skipped"}
    for part, head in heads.items():
        out = out.union(out.where(f"part = {part}").groupBy("part").agg(F.lit("").alias("at"), F.lit(f"\n{head}").alias("text")))
    return out.orderBy("part", F.col("text").startswith("\n##").cast("int").desc(), "at")
