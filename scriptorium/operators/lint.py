"""The catalogue of integrity rules over a page table, one function a rule.

Pages: ``stem, path, body, type, status, updated, tags, aliases, cites, keys`` (header keys
with a non-null value), ``bib_file, paper_id, arxiv_version``. Each rule gives
``(tag, path, line, detail)``; :func:`lint` is their union. ``today`` is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.arrays import any_with_prefix
from scriptorium.functions.dates import age_days, strict_date
from scriptorium.functions.text import bib_incomplete, contradiction_callouts, counter_argument_headings
from scriptorium.operators.links import alias_map, index_drift, invalid_cites, orphans, page_links, resolved_links
from scriptorium.operators.matching import near_duplicate_keys

_ENTITY = ["type", "status", "created", "updated", "sources", "tags"]
# Header keys that each page type needs (fixed values).
REQUIRED = {
    "paper": ["paper-id", "type", "status", "created", "updated", "title", "authors", "year", "identifiers", "bib-file", "extract", "tags"],
    "concept": _ENTITY,
    "method": _ENTITY,
    "open-problem": _ENTITY,
    "claim": _ENTITY,
    "result": _ENTITY,
    "author": ["type", "name", "slug", "created", "updated", "papers", "tags"],
    "venue": ["type", "name", "slug", "venue-type", "created", "updated", "papers", "tags"],
    "query-output": ["type", "question", "status", "created", "updated", "sources", "tags"],
}
FIELD_TAGGED = ("paper", "concept", "method", "open-problem", "claim", "result")


def _issues(rows: DataFrame, tag: str, detail: Column | str = "", line: Column | None = None, path: Column | None = None) -> DataFrame:
    text = detail if isinstance(detail, Column) else F.lit(detail)
    return rows.select(F.lit(tag).alias("tag"), (F.col("path") if path is None else path).alias("path"), (F.lit(None).cast("int") if line is None else line).alias("line"), text.cast("string").alias("detail"))


_ENTRY = "array<struct<tag:string,line:int,detail:string>>"


def _entries(condition: Column, tag: str, detail: Column | str = "") -> Column:
    """An issue of a page where the condition holds, as a list of one or none."""
    text = detail if isinstance(detail, Column) else F.lit(detail)
    one = F.array(F.struct(F.lit(tag).alias("tag"), F.lit(None).cast("int").alias("line"), text.cast("string").alias("detail")))
    return F.when(condition, one).otherwise(F.array().cast(_ENTRY))


def _listed(pages: DataFrame, *rules: Column) -> DataFrame:
    """``(tag, path, line, detail)`` of rules that look at one page at a time, all in one pass."""
    return pages.select("path", F.explode(F.concat(*rules)).alias("x")).select("x.tag", "path", "x.line", "x.detail")


def link_issues(resolved: DataFrame) -> DataFrame:
    found = resolved.where("kind <> 'page'")
    dead = F.col("kind") == "dead"
    return found.select(F.when(dead, "DEAD_LINK").otherwise("ALIAS_LINK").alias("tag"), "path", "line", F.when(dead, F.col("target")).otherwise(F.concat("target", F.lit(" -> "), "resolved")).alias("detail"))


def _missing_fields() -> Column:
    need = F.create_map(*[x for k, v in REQUIRED.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))])
    lacking = F.array_except(F.try_element_at(need, F.col("type")), F.col("keys"))
    return F.coalesce(F.transform(lacking, lambda k: F.struct(F.lit("MISSING_FIELD").alias("tag"), F.lit(None).cast("int").alias("line"), k.alias("detail"))), F.array().cast(_ENTRY))


def _missing_field_tag() -> Column:
    return _entries(F.col("type").isin(*FIELD_TAGGED) & ~any_with_prefix(F.col("tags"), "field/"), "MISSING_FIELD_TAG")


def _stale(today: Column, stale_after: int, untouched_after: int) -> Column:
    age = age_days(strict_date(F.col("updated")), today)
    old = _entries((F.col("status") == "stale") & (age > stale_after), "STALE", F.concat(F.lit("status stale for "), age, F.lit(" days")))
    return F.concat(old, _entries(F.col("type").isin("concept", "method") & (age > untouched_after), "STALE", F.concat(F.lit("untouched for "), age, F.lit(" days"))))


def _missing_section() -> Column:
    return _entries(F.col("type").isin("concept", "method") & (counter_argument_headings(F.col("body")) == 0), "MISSING_SECTION")


def _contradictions() -> Column:
    n = F.coalesce(contradiction_callouts(F.col("body")), F.lit(0))
    return F.flatten(F.array_repeat(_entries(F.lit(True), "CONTRADICTION"), n))


def missing_fields(pages: DataFrame) -> DataFrame:
    return _listed(pages, _missing_fields())


def missing_field_tags(pages: DataFrame) -> DataFrame:
    return _listed(pages, _missing_field_tag())


def stale_pages(pages: DataFrame, today: Column, stale_after: int = 90, untouched_after: int = 180) -> DataFrame:
    return _listed(pages, _stale(today, stale_after, untouched_after))


def missing_sections(pages: DataFrame) -> DataFrame:
    return _listed(pages, _missing_section())


def contradictions(pages: DataFrame) -> DataFrame:
    return _listed(pages, _contradictions())


def page_issues(pages: DataFrame, today: Column, stale_after: int = 90, untouched_after: int = 180) -> DataFrame:
    """The issues that a page shows by itself: fields, field tags, age, sections and contradictions, in one pass."""
    return _listed(pages, _missing_fields(), _missing_field_tag(), _stale(today, stale_after, untouched_after), _missing_section(), _contradictions())


def bibliography_issues(papers: DataFrame, bibs: DataFrame) -> DataFrame:
    """``bibs`` has ``bib_file`` and ``bib``; papers without a bib file key are not looked at."""
    named = papers.where("bib_file IS NOT NULL AND bib_file <> ''").join(bibs, "bib_file", "left")
    reason = F.when(F.col("bib").isNull(), F.concat(F.lit("expected "), F.col("bib_file"))).when(bib_incomplete(F.col("bib")), F.lit("bib-incomplete flag"))
    return _issues(named.withColumn("why", reason).where("why IS NOT NULL"), "MISSING_BIBTEX", F.col("why"))


def extract_issues(papers: DataFrame, extracts: DataFrame) -> DataFrame:
    """``extracts`` has ``paper_id, status, parse_error``."""
    found = extracts.select("paper_id", F.col("status").alias("extract_status"), "parse_error", F.lit(True).alias("present"))
    joined = papers.withColumn("paper_id", F.coalesce("paper_id", "stem")).join(found, "paper_id", "left")
    tag = F.when(F.col("present").isNull(), "EXTRACT_MISSING").when(F.col("parse_error").isNotNull(), "EXTRACT_PARSE_ERROR").when(F.col("extract_status") == "failed", "EXTRACT_FAILED")
    hits = joined.withColumn("issue", tag).where("issue IS NOT NULL")
    return hits.select(F.col("issue").alias("tag"), "path", F.lit(None).cast("int").alias("line"), F.col("paper_id").cast("string").alias("detail"))


def version_drift(papers: DataFrame, versions: DataFrame) -> DataFrame:
    """``versions`` has ``paper_id`` and ``latest``."""
    joined = papers.withColumn("paper_id", F.coalesce("paper_id", "stem")).join(versions, "paper_id")
    drift = joined.where("latest <> '' AND arxiv_version <> '' AND latest <> arxiv_version")
    return _issues(drift, "VERSION_DRIFT", F.concat("arxiv_version", F.lit(" -> "), "latest"))


def venue_near_duplicates(pages: DataFrame) -> DataFrame:
    pairs = near_duplicate_keys(pages.where("type = 'venue'").select(F.col("stem").alias("key")))
    return pairs.select(F.lit("VENUE_NEAR_DUPLICATE").alias("tag"), F.col("a").alias("path"), F.lit(None).cast("int").alias("line"), F.concat("b", F.lit(" "), F.format_string("%.2f", "similarity")).alias("detail"))


def parse_issues(errors: DataFrame) -> DataFrame:
    """``errors`` has ``path`` and ``error`` of the pages that could not be read."""
    return _issues(errors, "PARSE_ERROR", F.col("error"))


def lint(pages: DataFrame, bibs: DataFrame, extracts: DataFrame, versions: DataFrame, index: DataFrame, today: Column, errors: DataFrame | None = None) -> DataFrame:
    """All issues of a corpus, ``(tag, path, line, detail)``. Index and log pages only lend their links.

    ``errors`` are the unreadable pages, which no other rule sees.
    """
    aliases = alias_map(pages)
    resolved = resolved_links(page_links(pages), pages, aliases)
    own = pages.where(~F.col("stem").isin("index", "log"))
    papers = own.where("type = 'paper'")
    drift = index_drift(pages, index, aliases)
    rules = [
        link_issues(resolved),
        page_issues(own, today),
        _issues(orphans(own, resolved), "ORPHAN"),
        _issues(invalid_cites(papers, pages).join(papers.select("stem", "path"), "stem"), "INVALID_CITES", F.col("cited")),
        bibliography_issues(papers, bibs),
        extract_issues(papers, extracts),
        version_drift(papers, versions),
        drift.select(F.lit("INDEX_DRIFT").alias("tag"), F.col("target").alias("path"), F.lit(None).cast("int").alias("line"), F.col("kind").alias("detail")),
        venue_near_duplicates(own),
    ]
    if errors is not None:
        rules.append(parse_issues(errors))
    out = rules[0]
    for rule in rules[1:]:
        out = out.union(rule)
    return out


def lint_totals(issues: DataFrame) -> DataFrame:
    return issues.groupBy("tag").agg(F.count("*").alias("n_issues"))
