"""BibTeX: parse the first entry, rewrite its key, infer its type, build entries."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ENTRY = "struct<type:string,key:string,fields:map<string,string>>"

# How entries and their fields are written (fixed values).
_HEAD = re.compile(r"@(\w+)\s*\{\s*([^,\s]+)\s*,")
_NAME = re.compile(r"[\s,]*(\w+)\s*=\s*")
_BARE = re.compile(r"[^,}\n]*")
_QUOTED = re.compile(r'"((?:\\.|[^"\\])*)"?', re.DOTALL)
_BRACE = re.compile(r"[{}]")


def _braced(text: str, at: int) -> tuple[str, int]:
    """The value whose opening brace is at ``at``, and where reading goes on."""
    depth = 0
    for m in _BRACE.finditer(text, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return text[at + 1 : m.start()], m.end()
    return text[at + 1 :], len(text)


def first_entry(text: str | None) -> dict | None:
    """Type (lower case), key and fields (lower-case names) of the first entry, or None."""
    head = _HEAD.search(text or "")
    if not head:
        return None
    fields, at = {}, head.end()
    while (name := _NAME.match(text, at)) and name.end() < len(text):
        at = name.end()
        if text[at] == "{":
            value, at = _braced(text, at)
        elif text[at] == '"':
            m = _QUOTED.match(text, at)
            value, at = m[1], m.end()
        else:
            m = _BARE.match(text, at)
            value, at = m[0].strip(), m.end()
        fields[name[1].lower()] = value
    return {"type": head[1].lower(), "key": head[2], "fields": fields}


def _entries(texts: pd.Series) -> pd.DataFrame:
    found = [first_entry(t) or {"type": None, "key": None, "fields": None} for t in texts]
    return pd.DataFrame(found, columns=["type", "key", "fields"])


def parse_entry(bib: Column) -> Column:
    """:func:`first_entry` over a column; text without an entry gives null members."""
    return F.pandas_udf(_entries, ENTRY)(bib)


_KEYED = r"(?s)^(.*?@\w+\s*\{\s*)([^,\s]+)(\s*,.*)$"


def with_key(bib: Column, key: Column) -> Column:
    """The first entry's key replaced; null for unsafe keys or text without an entry."""
    safe = key.rlike(r"^[^\s,{}]+$")
    return F.when(safe & bib.rlike(_KEYED), F.concat(F.regexp_extract(bib, _KEYED, 1), key, F.regexp_extract(bib, _KEYED, 3)))


# Entry types and their venue fields by publication type (fixed values).
PUBLICATION_TYPES = {
    "JournalArticle": ("article", "journal"),
    "Conference": ("inproceedings", "booktitle"),
    "Review": ("article", "journal"),
    "Book": ("book", None),
    "BookSection": ("incollection", "booktitle"),
}
# Words of proceedings (fixed values).
_PROCEEDINGS = r"(?i)Proceedings|Conference|Symposium|Workshop|ICCV|CVPR|NeurIPS|ICML"


def entry_type(types: Column, venue: Column) -> Column:
    """``struct(type, venue_field)``: the first known publication type, else by the venue's words."""
    pair = lambda a, b: F.struct(F.lit(a).alias("type"), F.lit(b).cast("string").alias("venue_field"))
    known = F.filter(types, lambda t: t.isin(*PUBLICATION_TYPES))
    first = F.get(known, F.lit(0))
    out = F.when(F.lit(False), pair("misc", None))
    for name, (kind, field) in PUBLICATION_TYPES.items():
        out = out.when(first == name, pair(kind, field))
    named = F.coalesce(venue, F.lit("")) != ""
    return out.when(named & venue.rlike(_PROCEEDINGS), pair("inproceedings", "booktitle")).when(named, pair("article", "journal")).otherwise(pair("misc", None))


def build_entry(pid: Column, title: Column, authors: Column, year: Column, venue: Column, doi: Column, types: Column) -> Column:
    """BibTeX text of metadata; null without a title or a year. Empty fields are left out."""
    kind = entry_type(types, venue)
    line = lambda name, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit("  "), name, F.lit(" = {"), v, F.lit("},")))
    body = F.concat_ws(
        "\n",
        F.concat(F.lit("@"), kind["type"], F.lit("{"), pid, F.lit(",")),
        line(F.lit("title"), title),
        line(F.lit("author"), F.array_join(authors, " and ")),
        line(F.lit("year"), year.cast("string")),
        F.when(kind["venue_field"].isNotNull(), line(kind["venue_field"], venue)),
        line(F.lit("doi"), doi),
        F.lit("}"),
    )
    return F.when((F.coalesce(title, F.lit("")) != "") & year.isNotNull() & (year != 0), body)


def resolved_entry(primary: Column, fallback: Column, pid: Column) -> Column:
    """``struct(bibtex, source, error)`` of a looked-up entry: the resolver's text under our key, else the built one."""
    keyed = with_key(primary, pid)
    text = F.coalesce(keyed, fallback)
    source = F.when(keyed.isNotNull(), "doi.org").when(fallback.isNotNull(), "metadata")
    return F.struct(text.alias("bibtex"), source.alias("source"), F.when(text.isNull(), F.lit("no entry found")).alias("error"))
