"""Bibliography export: select papers, join their entries, render one text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.dates import creation_date, strict_date
from scriptorium.functions.text import bib_incomplete


@dataclass(frozen=True)
class Selectors:
    """What to export; at least one selector is needed. ``query`` is resolved to keys by the caller."""

    project: str | None = None
    field: str | None = None
    tag: str | None = None
    since: str | None = None
    query: str | None = None
    keys: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if not (self.project or self.field or self.tag or self.since or self.query or self.keys):
            raise ValueError("at least one selector is needed")


def selected(tags: Column, created: Column, by: Selectors) -> Column:
    """Papers that meet every given selector; unreadable dates meet no ``since``."""
    terms = [F.array_contains(tags, t) for t in (by.project and f"project/{by.project}", by.field and f"field/{by.field}", by.tag) if t]
    if by.since:
        terms.append(creation_date(created) >= strict_date(F.lit(by.since)))
    out = F.lit(True)
    for t in terms:
        out = out & F.coalesce(t, F.lit(False))
    return out


def export_entries(papers: DataFrame, bibs: DataFrame, by: Selectors) -> DataFrame:
    """``(pos, paper_id, entry, issue)`` in export order: given keys in their order, else by stem.

    ``papers`` has ``stem, paper_id, tags, created``; ``bibs`` has ``paper_id, bib``. Keys without
    a page go silently; papers without an entry have a null one and an issue.
    """
    found = papers.where(selected(F.col("tags"), F.col("created"), by))
    if by.keys:
        wanted = F.array_distinct(F.filter(F.transform(F.array(*[F.lit(k) for k in by.keys]), lambda k: F.trim(k)), lambda k: k != ""))
        order = found.sparkSession.range(1).select(F.posexplode(wanted).alias("pos", "stem"))
        found = found.join(F.broadcast(order), "stem")
        position = F.col("pos").cast("long")
    else:
        position = F.lit(0).cast("long")
    rows = found.select(position.alias("pos"), "stem", F.coalesce(F.when(F.col("paper_id") != "", F.col("paper_id")), F.col("stem")).alias("paper_id"))
    joined = rows.join(bibs, "paper_id", "left")
    text = F.concat(F.lit("% "), "paper_id", F.lit("\n"), F.regexp_replace("bib", r"(?U)^\s+|\s+$", ""), F.lit("\n"))
    issue = F.when(F.col("bib").isNull(), "missing .bib file").when(bib_incomplete(F.col("bib")), "bib-incomplete flag")
    return joined.select("pos", "stem", "paper_id", text.alias("entry"), issue.alias("issue"))


def export_text(entries: DataFrame) -> DataFrame:
    """One row: the joined text, and how many entries and issues there are."""
    ordered = F.array_sort(F.collect_list(F.when(F.col("entry").isNotNull(), F.struct("pos", "stem", "entry"))))
    return entries.agg(
        F.concat(F.array_join(F.transform(ordered, lambda x: x["entry"]), "\n"), F.lit("\n")).alias("text"), F.count("entry").alias("n_entries"), F.count("issue").alias("n_issues")
    )
