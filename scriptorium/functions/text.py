"""String functions over columns: slugs, paper ids, identifiers, venues, labels, renders.

Each takes and returns columns. Input that has no valid result gives null; callers that
report reasons pair the result with :func:`reason_if_null`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.folding import ascii_fold, greek_to_latin, nfkd_strip

# Words that a slug does not begin with (fixed values).
STOP_WORDS = ("a", "an", "the", "on", "of", "for", "with")
SLUG_LIMIT = 60
SPACE = r"(?U)\s"


def trimmed(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank(c: Column) -> Column:
    return c.isNull() | (trimmed(c) == "")


def null_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def reason_if_null(value: Column, reason: str) -> Column:
    return F.when(value.isNull(), F.lit(reason))


# Slugs ---------------------------------------------------------------------------------


def without_leading_stop_word(title: Column) -> Column:
    """Drop a leading stop word where at least two words remain."""
    head = r"(?iU)^\s*(?:" + "|".join(STOP_WORDS) + r")\s+"
    rest = trimmed(F.regexp_replace(title, head, ""))
    return F.when(title.rlike(head) & rest.rlike(r"(?U)\S\s+\S"), rest).otherwise(title)


def kebab(c: Column) -> Column:
    """Runs outside a-z, 0-9 become one hyphen; none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, "[^a-z0-9]+", "-"), "^-|-$", "")


def slug_uncut(title: Column) -> Column:
    """Slug of any length; null for blank titles and titles without a usable letter."""
    plain = greek_to_latin(F.lower(nfkd_strip(without_leading_stop_word(title))))
    return F.when(~blank(title), null_if_empty(kebab(plain)))


def slug(title: Column, limit: int = SLUG_LIMIT) -> Column:
    """Slug of at most ``limit`` characters, cut back to its last hyphen."""
    whole = slug_uncut(title)
    cut = F.left(whole, F.lit(limit))
    back = F.regexp_extract(cut, "^(.+)-[^-]*$", 1)
    return F.when(F.length(whole) <= limit, whole).otherwise(F.regexp_replace(F.when(back != "", back).otherwise(cut), "-+$", ""))


# Paper ids and identifiers -------------------------------------------------------------


def first_meaningful_word(title: Column) -> Column:
    """First word that is neither a stop word nor a number, split on ASCII before folding."""
    words = F.split(F.translate(title, _UPPER, _LOWER), "[^a-z0-9]+")
    kept = F.filter(words, lambda w: (w != "") & ~w.isin(*STOP_WORDS) & ~w.rlike("^[0-9]+$"))
    return F.coalesce(F.get(kept, F.lit(0)), F.lit("untitled"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def paper_id(last_name: Column, year: Column, title: Column) -> Column:
    """Folded last name, year and first meaningful word, joined without a separator."""
    name = F.regexp_replace(ascii_fold(last_name), "[^a-z0-9]", "")
    return F.concat(F.when(name == "", F.lit("unknown")).otherwise(name), year.cast("string"), first_meaningful_word(title))


_NEW_ARXIV = r"^([0-9]{4}\.[0-9]{4,5})(v[0-9]+)?$"


def normalized_identifier(kind: Column, value: Column) -> Column:
    """Form in which identifiers of a kind are compared."""
    v = trimmed(value)
    versionless = F.when(v.rlike(_NEW_ARXIV), F.regexp_extract(v, _NEW_ARXIV, 1)).otherwise(v)
    return F.when(kind == "arxiv", versionless).when(kind == "doi", F.lower(v)).otherwise(v)


def identifier_version(kind: Column, value: Column) -> Column:
    """Version suffix of a new-style arXiv id, or null."""
    return F.when(kind == "arxiv", null_if_empty(F.regexp_extract(trimmed(value), _NEW_ARXIV, 2)))


_DOI = r"^10\.[0-9]{4,9}/\S+$"
_ARXIV = r"(?i)^([0-9]{4}\.[0-9]{4,5}(v[0-9]+)?|[a-z][\w-]*/[0-9]{7})$"
_ARXIV_URL = r"arxiv\.org/(?:abs|html|pdf)/(.+?)(?:/|$)"
_DOI_URL = r"doi\.org/(10\.[0-9]{4,9}/\S+)"


def detected_identifier(text: Column) -> Column:
    """``struct(kind, id)`` of free input; the first rule that fits decides."""
    whole = trimmed(text)
    s = F.regexp_replace(whole, "^(?:arXiv:|arxiv:|doi:)", "")
    pair = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("id"))
    return (
        F.when(s.rlike(_ARXIV_URL), pair("arxiv", F.regexp_extract(s, _ARXIV_URL, 1)))
        .when(s.rlike(_DOI_URL), pair("doi", F.regexp_extract(s, _DOI_URL, 1)))
        .when(s.rlike(_DOI), pair("doi", s))
        .when(s.rlike(_ARXIV), pair("arxiv", s))
        .otherwise(pair("unknown", whole))
    )


def lookup_key(text: Column) -> Column:
    """Key for a metadata service: a prefix by kind, unknown input unchanged."""
    found = detected_identifier(text)
    return F.when(found["kind"] == "doi", F.concat(F.lit("DOI:"), found["id"])).when(found["kind"] == "arxiv", F.concat(F.lit("ARXIV:"), found["id"])).otherwise(text)


def ingest_route(text: Column) -> Column:
    """Kind of an ingest input: the first pattern that fits."""
    s = trimmed(text)
    return (
        F.when(s.rlike(r"(?i)arxiv\.org/"), "arxiv-url")
        .when(s.rlike(r"(?i)doi\.org/10\.") | s.rlike(_DOI) | s.rlike(r"(?i)^doi:10\."), "doi")
        .when(s.rlike(r"(?i)^arxiv:") | s.rlike(_ARXIV), "arxiv-id")
        .when(s.rlike(r"(?i)\.pdf$"), "pdf")
        .when(s.rlike(r"(?i)\.(md|markdown|txt)$"), "markdown")
        .when(s.rlike(r"(?i)^https?://"), "url")
        .otherwise("unknown")
    )


def looks_like_doi(text: Column) -> Column:
    """The looser test of the bibliography lookup."""
    return trimmed(text).rlike(r"^10\.[0-9]+/")


def path_safe_doi(doi: Column) -> Column:
    return F.left(F.regexp_replace(F.replace(F.lower(doi), F.lit("/"), F.lit("_")), "[^a-z0-9._-]", "-"), F.lit(100))


def versionless_arxiv(arxiv: Column) -> Column:
    """Lower case without ``arxiv:`` and any version."""
    return F.regexp_replace(F.regexp_replace(F.lower(arxiv), "^arxiv:", ""), "v[0-9]+$", "")


def _given(c: Column) -> Column:
    return null_if_empty(trimmed(F.coalesce(c, F.lit(""))))


def record_slug(doi: Column, arxiv: Column, record_id: Column, prefixes: tuple[str, str, str] = ("doi-", "arxiv-", "s2-")) -> Column:
    """Stable slug of an external record by its best identifier, null without any."""
    return F.coalesce(
        F.concat(F.lit(prefixes[0]), path_safe_doi(_given(doi))),
        F.concat(F.lit(prefixes[1]), versionless_arxiv(_given(arxiv))),
        F.concat(F.lit(prefixes[2]), F.left(F.sha2(_given(record_id).cast("binary"), 256), F.lit(8))),
    )


def record_url(doi: Column, arxiv: Column, record_id: Column, record_base: str = "https://www.semanticscholar.org/paper/") -> Column:
    """Source address by the same priority."""
    return F.coalesce(
        F.concat(F.lit("https://doi.org/"), _given(doi)),
        F.concat(F.lit("https://arxiv.org/abs/"), versionless_arxiv(_given(arxiv))),
        F.concat(F.lit(record_base), _given(record_id)),
    )


# Venues --------------------------------------------------------------------------------


def venue_name(raw: Column) -> Column:
    """Venue without edition: brackets open, ordinals and years 1900-2099 go."""
    s = F.regexp_replace(raw, r"[()\[\]{}]", " ")
    s = F.regexp_replace(s, r"(?iU)\b\d+(?:st|nd|rd|th)\b", " ")
    s = F.regexp_replace(s, r"(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])", "")
    s = F.regexp_replace(s, r"(?U)\s+", " ")
    s = F.regexp_replace(s, r"(?U)\s+-\s+", " ")
    s = F.regexp_replace(s, r"(?U)^\s*-+\s*|\s*-+\s*$", "")
    return null_if_empty(trimmed(F.regexp_replace(s, "^[, ;]+|[, ;]+$", "")))


def venue_slug(raw: Column) -> Column:
    return slug_uncut(venue_name(raw))


# Key words by venue type, in the order in which they decide (fixed values).
VENUE_WORDS = (
    ("workshop", ("workshop",)),
    ("preprint-server", ("arxiv", "biorxiv", "medrxiv", "chemrxiv", "ssrn", "preprint server")),
    ("conference", ("conference", "symposium", "proceedings", "congress")),
)


def venue_type(raw: Column) -> Column:
    """First type whose key word is in the name; journals are the default, blank gives null."""
    out = F.when(blank(raw), F.lit(None).cast("string"))
    for name, words in VENUE_WORDS:
        out = out.when(raw.rlike(r"(?iU)\b(?:" + "|".join(words) + r")\b"), name)
    return out.otherwise("journal")


# References, labels, renders -----------------------------------------------------------


def reference_text(c: Column) -> Column:
    """Lower case, marks to blanks, single blanks."""
    return trimmed(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def inline_author(authors: Column) -> Column:
    """Last token of the first author, with ``et al.`` for several."""
    last = F.element_at(F.split(trimmed(F.get(authors, F.lit(0))), r"(?U)\s+"), -1)
    return F.when(F.coalesce(F.size(authors), F.lit(0)) <= 0, "").when(F.size(authors) > 1, F.concat(last, F.lit(" et al."))).otherwise(last)


def file_name(c: Column) -> Column:
    """Without nine unsafe characters, blanks to underscores, at most 100 characters."""
    return F.left(F.regexp_replace(F.regexp_replace(c, r'[<>:"/\\|?*]', ""), r"(?U)\s+", "_"), F.lit(100))


def export_label(label: Column, *choices: Column) -> Column:
    """The given label with path separators replaced, else the first choice's slug, else ``export``."""
    given = trimmed(F.regexp_replace(null_if_empty(label), r"[\x00/\\]+", "-"))
    return F.coalesce(given, *[slug(null_if_empty(c)) for c in choices], F.lit("export"))


def plural(n: Column, one: str, many: str) -> Column:
    return F.when(n == 1, one).otherwise(many)


def valid_label(c: Column) -> Column:
    """Snapshot label: blanks become hyphens, unsafe ones give null."""
    s = F.regexp_replace(trimmed(c), r"(?U)\s+", "-")
    return F.when((s != "") & ~s.rlike(r"[~^:?*\[\\]|\.\.|@\{|\.lock$"), s)


def author_name(c: Column) -> Column:
    """Without math markup and affiliation marks."""
    s = F.regexp_replace(c, r"\$[^$]*\$", "")
    return trimmed(F.regexp_replace(F.regexp_replace(s, r"[*†‡§¶∗]|\^\{?[0-9,]+\}?", ""), r"(?U)\s+", " "))


def page_path(kind: Column, key: Column) -> Column:
    return F.concat(F.lit("wiki/"), kind, F.lit("s/"), key, F.lit(".md"))


# Page folders whose pages can take links, and their kinds (fixed values).
PAGE_KINDS = {"papers": "paper", "concepts": "concept", "methods": "method", "open-problems": "open-problem", "venues": "venue"}


def page_kind_and_key(path: Column) -> Column:
    """``struct(kind, key)`` of a page path, null outside the known folders."""
    folder = F.regexp_extract(path, "^wiki/([^/]+)/", 1)
    kinds = F.create_map(*[F.lit(x) for pair in PAGE_KINDS.items() for x in pair])
    kind = F.try_element_at(kinds, folder)
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1).alias("key")))


def abstract_body(abstract: Column, missing: str = "*(no abstract available)*") -> Column:
    return F.concat(F.lit("## Abstract\n\n"), F.coalesce(null_if_empty(trimmed(abstract)), F.lit(missing)), F.lit("\n"))


def candidate_entry(c: Column) -> Column:
    """Report entry of a candidate struct."""
    return F.concat(
        F.lit("### Candidate: "), c["description"], F.lit("\n- **Type:** "), c["type"], F.lit("\n- **Paper A:** [["), c["paper_a"], F.lit(']] — "'), c["quote_a"], F.lit('"\n- **Paper B:** [['),
        c["paper_b"], F.lit(']] — "'), c["quote_b"], F.lit('"\n- **Relationship:** '), c["relationship"], F.lit("\n- **Action:** review — promote or leave as-is\n\n"),
    )


def venue_page(slug_: Column, name: Column, kind: Column, papers: Column, tags: Column, today: Column) -> Column:
    """Markdown of a venue page; empty lists show as ``[]``."""
    block = lambda items: F.when(F.size(items) > 0, F.array_join(F.transform(items, lambda x: F.concat(F.lit("  - "), x)), "\n")).otherwise("  []")
    day = today.cast("string")
    return F.concat(
        F.lit('---\ntype: venue\nname: "'), F.replace(name, F.lit('"'), F.lit('\\"')), F.lit('"\nslug: '), slug_, F.lit("\nvenue-type: "), kind, F.lit("\ncreated: "), day, F.lit("\nupdated: "), day,
        F.lit("\npapers:\n"), block(papers), F.lit("\ntags:\n"), block(tags), F.lit("\n---\n\n# "), name, F.lit("\n\nIts papers are listed in `papers:` above.\n"),
    )


def document_markdown(meta: Column, sections: Column, figures: Column, pid: Column) -> Column:
    """Markdown of a document: header, sections, embedded figures; later figures of an id win."""
    quoted = lambda name, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f'{name}: "'), v, F.lit('"')))
    listed = lambda name, v: F.when(F.size(v) > 0, F.concat(F.lit(f"{name}: ["), F.array_join(v, ", "), F.lit("]")))
    ids = [quoted(f"  {k}", meta[k]) for k in ("doi", "arxiv", "url")]
    header = F.concat_ws(
        "\n", F.lit("---"), F.concat(F.lit('title: "'), F.coalesce(meta["title"], F.lit("")), F.lit('"')), listed("authors", meta["authors"]),
        F.when(F.size(meta["authors"]) > 0, F.concat(F.lit('inline_author: "'), inline_author(meta["authors"]), F.lit('"'))), F.concat(F.lit('paper-id: "'), pid, F.lit('"')),
        F.when(F.coalesce(*ids).isNotNull(), F.lit("identifiers:")), *ids,
        F.when(F.coalesce(meta["date"], F.lit("")) != "", F.concat(F.lit("date: "), meta["date"])), F.concat(F.lit("year: "), meta["year"].cast("string")),
        quoted("venue", meta["venue"]), listed("keywords", meta["keywords"]), F.lit("---"), F.lit(""),
    )
    figure = lambda key: F.element_at(F.filter(figures, lambda f: f["id"] == key), -1)

    def embedded(key: Column) -> Column:
        f = figure(key)
        image = F.when(F.coalesce(f["failed"], F.lit(False)), F.concat(F.lit("![[fig_missing.png]]\n<!-- Image download failed for: "), f["filename"], F.lit(" -->"))).otherwise(F.concat(F.lit("![["), f["filename"], F.lit("]]")))
        caption = F.when(F.coalesce(f["caption"], F.lit("")) != "", F.concat(F.lit("\n*"), f["caption"], F.lit("*"))).otherwise("")
        known = F.exists(figures, lambda g: g["id"] == key)
        return F.when(known, F.concat(image, caption, F.lit("\n")))

    def block(b: Column) -> Column:
        return F.when((b["type"] == "paragraph") & (F.coalesce(b["text"], F.lit("")) != ""), F.concat(b["text"], F.lit("\n"))).when((b["type"] == "figure") & (F.coalesce(b["figure_id"], F.lit("")) != ""), embedded(b["figure_id"]))

    section = lambda s: F.concat_ws("\n", F.concat(F.lit("## "), s["heading"]), F.array_join(F.filter(F.transform(s["content"], block), lambda t: t.isNotNull()), "\n"), F.lit(""))
    nonempty = lambda s: F.when(F.size(F.filter(F.transform(s["content"], block), lambda t: t.isNotNull())) > 0, section(s)).otherwise(F.concat(F.lit("## "), s["heading"], F.lit("\n")))
    return F.concat_ws("\n", header, F.array_join(F.transform(sections, nonempty), "\n"))


# Page text -----------------------------------------------------------------------------

LINK = r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]"


def link_targets(text: Column) -> Column:
    """Targets of all links, labels dropped, trimmed, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(LINK), F.lit(1)), trimmed)


def counter_argument_headings(body: Column) -> Column:
    return F.regexp_count(body, F.lit(r"(?im)^##\s+counter.?arguments"))


def contradiction_callouts(body: Column) -> Column:
    return F.regexp_count(body, F.lit(r"(?i)>\s*\[!WARNING\]\s*Contradiction"))


def blocked_page(html: Column, least: int = 1024) -> Column:
    """Too short to be an article, or a challenge page."""
    return (F.length(html) < least) | html.rlike(r"(?i)captcha|cf-challenge|verify you are (?:a )?human")


def bib_incomplete(bib: Column) -> Column:
    return bib.rlike(r"(?i)bib-incomplete:\s*true")


def read_status(notes: Column, least: int = 200) -> Column:
    return F.when(F.length(F.coalesce(notes, F.lit(""))) > least, "read").otherwise("skimmed")


def linkable(slug_: Column) -> Column:
    """Only slugs of several words are linked without being asked."""
    return slug_.contains("-")


def reference_lines(body: Column) -> Column:
    """Items listed under the first References or Bibliography heading, as written, in order."""
    section = F.regexp_extract(body, r"(?ims)^#{1,6}\s+(?:references|bibliography)\s*$\n(.*?)(?=^#{1,6}\s|\z)", 1)
    return F.transform(F.regexp_extract_all(section, F.lit(r"(?m)^\s*(?:[-*+]|\[?\d+[\].)])\s+(.+?)\s*$"), F.lit(1)), lambda x: x)


def inside(path: Column, root: Column) -> Column:
    """The path is the root or below it, and does not climb out."""
    base = F.regexp_replace(root, "/+$", "")
    return ((path == base) | path.startswith(F.concat(base, F.lit("/")))) & ~path.rlike(r"(?:^|/)\.\.(?:/|$)")
