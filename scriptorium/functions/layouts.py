"""Sections, tables and figures of publishers' pages, by rules for each site.

A site keeps its text in one of two ways. Either it has an element for each section, whose
paragraphs, figures and tables are found below it; or one body element, in which headings,
paragraphs, figures and tables follow each other. A :class:`Layout` says which elements these are;
reading a page is the same for all sites. Tables become rows of cells joined by bars.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import urljoin

from scriptorium.functions.selectors import Tree

UNTITLED = "Untitled Section"


@dataclass(frozen=True)
class Layout:
    """Where a site keeps what; selectors are comma-joined alternatives, tuples are tried in order."""

    sections: str = ""  # an element for each section
    body: tuple[str, ...] = ()  # or the element that holds all of them, one after the other
    skipped_sections: str = ""  # of the section elements, by selector
    skipped_headings: str = ""  # and by a pattern of their heading
    heading: str = "h2, h3"
    heading_of: str = ""  # headings stand in the nearest of these above a section, if not in it
    needs_heading: bool = False
    first_heading: str = "Introduction"  # of what stands in a body before its first heading
    abstract: tuple[str, ...] = ()
    abstract_in_sections: bool = False  # the first section is left out where it is the abstract
    whole_abstract: bool = False  # all elements found, each a paragraph
    paragraphs: str = "p"
    children: bool = False  # a section's children are its blocks
    least: int = 1  # characters of a paragraph
    not_within: str = ""  # elements inside of which nothing counts in a body
    not_paragraph_within: str = ""
    figures: str = ""  # elements that a section refers to as figures; images, or what has one
    tables: str = ""
    least_rows: int = 1
    captions_of_tables: tuple[str, str] = ("", "")  # the nearest of these above a table, and the caption in it
    table_links: str = ""  # stand for a table that is elsewhere on the page
    references: str = ""
    images: tuple[str, ...] = ()  # images of the list of figures
    image_first: bool = True  # only the first image of each element
    source: tuple[str, ...] = ("src",)
    image_needs: str = ""
    ignored_images: str = ""
    image_name: str = ""  # attribute that names an image instead of its address
    distinct: bool = True
    larger: tuple[tuple[str, str], ...] = ()
    frames: tuple[str, ...] = ()  # the nearest of these above an image holds its caption, or with ^ the element around it
    captions: tuple[str, ...] = ("figcaption",)
    next_caption: int = 0  # else the element after it does, if it has fewer characters
    checked_captions: bool = False  # a caption of as many counts only where it says that it is a figure's


_NAMED_ABSTRACT = "abstract"

# Publishers' elements (fixed values).
LAYOUTS: dict[str, Layout] = {
    "arxiv": Layout(
        sections=".ltx_section",
        heading=".ltx_title",
        abstract=(".ltx_abstract .ltx_p",),
        whole_abstract=True,
        paragraphs=".ltx_para .ltx_p",
        figures=".ltx_figure img",
        references=".ltx_bibliography .ltx_bibitem",
        images=(".ltx_figure",),
        captions=("figcaption.ltx_caption, .ltx_caption",),
    ),
    "ieee": Layout(
        sections="div.section, div.section_2, .section--body, .document-ft-section-container .section",
        heading="h2, h3, .section-title, .header-title",
        abstract=(".abstract-text .u-mb-1, .abstract-desktop-div div[xplmathjax]",),
        paragraphs="p, .paragraph, div[xplmathjax]",
        figures="img[src*='mediastore']",
        references=".reference-container .reference-item, ol.references li, .refs .reference",
        images=("img[src*='mediastore']",),
        ignored_images="icon|logo",
        image_name="data-media-id",
        distinct=False,
        larger=(("-small.", "-large."), ("-small-", "-large-")),
        frames=("div",),
        captions=(".figcaption, figcaption, .caption, .fig-caption",),
        next_caption=200,
        checked_captions=True,
    ),
    "springer": Layout(
        sections=".c-article-section",
        skipped_sections="#Abs1, #Abs1-section",
        abstract=("#Abs1-content p",),
        paragraphs=":scope > .c-article-section__content p, :scope > p",
        figures=".c-article-section__figure",
        references="#Bib1 .c-article-references__item",
        images=(".c-article-section__figure",),
        source=("data-src", "src"),
        captions=(".c-article-section__figure-description, figcaption, b.c-article-section__figure-caption",),
    ),
    "sciencedirect": Layout(
        body=("#body, .Body",),
        abstract=("[id*='abspara']", ".abstract div", "#abstracts p"),
        paragraphs="div.u-margin-s-bottom, p",
        least=11,
        figures="figure",
        references=".reference .contribution, .bib-reference, [name='bibliography'] li",
        images=("figure img, .figure img, img.imgLazyJSB",),
        image_first=False,
        source=("data-src", "src"),
        ignored_images=r"clear\.gif|1x1|blank",
        frames=(".figure", "figure"),
        captions=(".captions", "figcaption"),
    ),
    "mdpi": Layout(
        body=(".html-body",),
        heading=".html-h2, .html-h4",
        first_heading=UNTITLED,
        abstract=(".art-abstract p", ".art-abstract .html-p"),
        paragraphs=".html-p",
        figures=".html-fig_img",
        tables=".html-table_show",
        references=".html-bib-entry, .article-bibliography li",
        images=("a.html-img-zoom img", ".html-figpopup img"),
        image_first=False,
        frames=(".html-fig_show", ".html-img ^", ".html-fig_img ^"),
        captions=(".html-fig_description",),
    ),
    "wiley": Layout(
        sections=".article-section__content",
        skipped_headings="references|bibliography|supporting info|acknowledgment",
        heading="h2, h3, .article-section__title",
        heading_of="section",
        abstract=("#abstract .article-section__content p", "[class*='abstract'] .article-section__content p", ".article-section__content p"),
        abstract_in_sections=True,
        least=11,
        figures="figure",
        tables=".article-table-content-wrapper",
        captions_of_tables=(".article-table-content", ".article-table-caption, .table-caption__label"),
        references="#references-section li, .citation__body",
        images=("figure.figure",),
        image_needs="cms/asset",
        captions=("figcaption, .figure__caption",),
    ),
    "tandfonline": Layout(
        body=(".hlFld-Fulltext", ".article__body"),
        abstract=(".abstractSection p, .abstract p, #abstract p", ".hlFld-Abstract p"),
        paragraphs="p, .NLM_p",
        least=11,
        not_within=".abstractSection",
        not_paragraph_within="table, .tableView",
        figures="img[src*='cms/asset']",
        tables="table",
        least_rows=2,
        captions_of_tables=(".NLM_sec, .NLM_sec_level_1", ".tableCaption, .NLM_caption, caption"),
        table_links=".tableView",
        references=".references li, .citedByEntry, #references-section li",
        images=(".figureView img, img[src*='cms/asset']",),
        image_first=False,
        image_needs="cms/asset",
        frames=(".figureView", "div"),
        captions=(".caption, figcaption, .NLM_caption",),
        next_caption=300,
    ),
    "asce": Layout(
        sections="div.core-container section",
        skipped_headings="data availability|acknowledgment|author contribution|supplemental",
        heading="h2",
        needs_heading=True,
        children=True,
        least=11,
        figures="figure",
        tables="table",
        least_rows=2,
        images=("figure img",),
        image_first=False,
        source=("data-src", "src"),
        ignored_images="icon|logo|spinner",
        frames=("figure",),
    ),
}

_TABLE_NUMBER = re.compile(r"table\s*(\d+)", re.IGNORECASE)
_MISSING_TABLE = "(Table content not available)"


class Reader:
    """Sections and figures of one page under one layout."""

    def __init__(self, tree: Tree, layout: Layout, url: str) -> None:
        self.tree, self.rules, self.url = tree, layout, url
        self.figures: list[dict] = []
        self._by_name: dict[str, str] = {}

    def first(self, css: str, root: int | None = None) -> int | None:
        return next(iter(self.tree.select(css, root)), None)

    def caption(self, element: int | None, steps: tuple[str, ...]) -> str:
        for css in steps if element is not None else ():
            if (found := self.first(css, element)) is not None:
                return self.tree.text(found)
        return ""

    def address(self, image: int) -> str:
        attributes = self.tree.attributes[image]
        src = next((attributes[a].strip() for a in self.rules.source if (attributes.get(a) or "").strip()), "")
        if not src or (self.rules.image_needs and self.rules.image_needs not in src):
            return ""
        try:
            at = urljoin(self.url, src)
        except ValueError:  # no address at all
            at = src
        return "" if self.rules.ignored_images and re.search(self.rules.ignored_images, at, re.IGNORECASE) else at

    def image_of(self, element: int) -> int | None:
        return element if self.tree.tags[element] == "img" else self.first("img", element)

    def name_of(self, image: int) -> str:
        return self.tree.attributes[image].get(self.rules.image_name) or self.address(image)

    def frame_of(self, image: int) -> int:
        for css in self.rules.frames:
            if (frame := self.tree.closest(image, css.removesuffix(" ^"))) is not None:
                return self.tree.parents[frame] if css.endswith("^") else frame
        return self.tree.parents[image]

    def figure_caption(self, element: int, image: int) -> str:
        frame = element if element != image else self.frame_of(image)
        if frame < 0:
            return ""
        found, near = self.caption(frame, self.rules.captions), self.rules.next_caption
        if not found and near and (after := self.tree.sibling(frame)) is not None:
            found = self.tree.text(after)
            if len(found) >= near and not self.rules.checked_captions:
                return ""
        return "" if self.rules.checked_captions and len(found) >= near and not found.lower().startswith("fig") else found

    def read_figures(self) -> None:
        """The page's figures, numbered as they come; a selector is tried where those before it found none."""
        for css in self.rules.images:
            for element in self.tree.select(css):
                image = self.image_of(element)
                if image is None or not (at := self.address(image)) or (self.rules.distinct and self.name_of(image) in self._by_name):
                    continue
                self.add_figure(image, at, self.figure_caption(element, image))
            if self.figures:
                return

    def add_figure(self, image: int, at: str, caption: str) -> str:
        key = f"fig{len(self.figures) + 1}"
        for small, large in self.rules.larger:
            at = at.replace(small, large)
        self._by_name.setdefault(self.name_of(image), key)
        self.figures.append({"id": key, "url": at, "filename": f"{key}.png", "caption": caption, "failed": False})
        return key

    def figure_block(self, element: int) -> list[dict]:
        """A reference to the element's image; one that the list of figures lacks is added to it."""
        image = self.image_of(element)
        if image is None or not (at := self.address(image)):
            return []
        key = self._by_name.get(self.name_of(image)) or self.add_figure(image, at, self.figure_caption(element, image))
        return [{"type": "figure", "text": None, "figure_id": key}]

    def paragraph(self, text: str, least: int = 1) -> list[dict]:
        return [{"type": "paragraph", "text": text, "figure_id": None}] if len(text) >= least else []

    def table_text(self, table: int) -> str:
        """Rows of cells joined by bars, without the rows of tables inside it."""
        rows = [r for r in self.tree.select("tr", table) if self.tree.closest(self.tree.parents[r], "table") == table]
        if len(rows) < self.rules.least_rows:
            return ""
        cells = lambda row: [c for c in self.tree.select("th, td", row) if self.tree.closest(c, "tr") == row]
        lines = [" | ".join(self.cell(c) for c in cells(row)) for row in rows]
        return "\n".join(lines) if any(line.strip(" |") for line in lines) else ""

    def cell(self, element: int) -> str:
        """A cell's text; a cell over several columns is followed by empty ones."""
        span = self.tree.attributes[element].get("colspan") or "1"
        return self.tree.text(element) + " | " * (min(int(span), 64) - 1 if span.isdecimal() and int(span) else 0)

    def table_block(self, element: int) -> list[dict]:
        table = element if self.tree.tags[element] == "table" else self.first("table", element)
        text = self.table_text(table) if table is not None else ""
        above, css = self.rules.captions_of_tables
        if text and above and not self.rules.table_links:
            holder = self.tree.closest(element, above)
            caption = self.caption(holder, (css,))
            text = f"{caption}\n{text}" if caption else text
        return self.paragraph(text)

    def linked_table(self, view: int, known: dict[str, tuple[str, str]]) -> list[dict]:
        """A table that stands elsewhere on the page, by the number in the view's caption."""
        caption = self.caption(view, (self.rules.captions_of_tables[1],))
        number = _TABLE_NUMBER.search(caption)
        if number and number[1] in known:
            own, text = known[number[1]]
            return self.paragraph(f"{own}\n{text}" if own else text)
        return self.paragraph(f"{caption}\n{_MISSING_TABLE}") if caption else []

    def numbered_tables(self) -> dict[str, tuple[str, str]]:
        out: dict[str, tuple[str, str]] = {}
        above, css = self.rules.captions_of_tables
        for table in self.tree.select("table"):
            caption = self.caption(self.tree.closest(table, above), (css,))
            if (number := _TABLE_NUMBER.search(caption)) and (text := self.table_text(table)):
                out[number[1]] = (caption, text)
        return out

    def abstract(self) -> tuple[int | None, list[dict]]:
        """(the abstract's first element, its paragraphs)."""
        for css in self.rules.abstract:
            if found := self.tree.select(css):
                own = found if self.rules.whole_abstract else found[:1]
                return found[0], [b for e in own for b in self.paragraph(self.tree.text(e))]
        return None, []

    def section_heading(self, section: int) -> str | None:
        above = self.tree.closest(section, self.rules.heading_of) if self.rules.heading_of else section
        above = self.tree.parents[section] if above is None else above
        found = self.first(self.rules.heading, above) if above >= 0 else None
        return None if found is None else self.tree.text(found) or UNTITLED

    def by_sections(self, abstract: int | None) -> list[dict]:
        out = []
        left_out = set(self.tree.select(self.rules.skipped_sections)) if self.rules.skipped_sections else set()
        for n, section in enumerate(self.tree.select(self.rules.sections)):
            if section in left_out:
                continue
            if self.rules.abstract_in_sections and n == 0:
                named = self.tree.closest(section, f"#{_NAMED_ABSTRACT}, [class*='{_NAMED_ABSTRACT}']") is not None
                if named or (abstract is not None and self.tree.within(abstract, section)):
                    continue
            heading = self.section_heading(section)
            if (heading is None and self.rules.needs_heading) or (self.rules.skipped_headings and re.search(self.rules.skipped_headings, heading or "", re.IGNORECASE)):
                continue
            content = self.child_blocks(section) if self.rules.children else self.grouped_blocks(section)
            if content:
                out.append({"heading": heading or UNTITLED, "content": content})
        return out

    def grouped_blocks(self, section: int) -> list[dict]:
        """Paragraphs, then figures, then tables below a section's element."""
        content = [b for e in self.tree.select(self.rules.paragraphs, section) for b in self.paragraph(self.tree.text(e), self.rules.least)]
        content += [b for e in self.tree.select(self.rules.figures, section) for b in self.figure_block(e)]
        return content + [b for e in (self.tree.select(self.rules.tables, section) if self.rules.tables else ()) for b in self.table_block(e)]

    def child_blocks(self, section: int) -> list[dict]:
        """A section's children: each a figure with its caption, a table or a paragraph."""
        content: list[dict] = []
        for child in self.tree.children(section):
            if self.tree.tags[child] in ("h2", "h3"):
                continue
            figure = child if self.tree.tags[child] == "figure" else self.first("figure", child)
            table = child if self.tree.tags[child] == "table" else self.first("table", child)
            if figure is not None:
                content += self.figure_block(figure) + self.paragraph(self.caption(figure, self.rules.captions))
            elif table is not None:
                content += self.table_block(table)
            else:
                content += self.paragraph(self.tree.text(child), self.rules.least)
        return content

    def by_body(self) -> list[dict]:
        body = next((b for css in self.rules.body if (b := self.first(css)) is not None), None)
        if body is None:
            return []
        out: list[dict] = []
        heading, content = self.rules.first_heading, []
        kinds = [("heading", self.rules.heading), ("link", self.rules.table_links), ("table", self.rules.tables), ("figure", self.rules.figures), ("paragraph", self.rules.paragraphs)]
        kind_of: dict[int, str] = {}
        for kind, css in kinds:
            for element in self.tree.select(css, body) if css else ():
                kind_of.setdefault(element, kind)
        known = self.numbered_tables() if self.rules.table_links else {}
        inside = lambda e, css: bool(css) and self.tree.closest(self.tree.parents[e], css) is not None
        for element in sorted(kind_of):
            kind = kind_of[element]
            if inside(element, self.rules.not_within):
                continue
            if kind == "heading":
                if content:
                    out.append({"heading": heading, "content": content})
                heading, content = self.tree.text(element) or UNTITLED, []
            elif kind == "figure":
                content += self.figure_block(element)
            elif kind == "table":
                content += self.table_block(element)
            elif kind == "link":
                content += self.linked_table(element, known)
            elif not inside(element, self.rules.not_paragraph_within) and not inside(element, self.rules.figures if self.rules.figures == "figure" else ""):
                content += self.paragraph(self.tree.text(element), self.rules.least)
        if content:
            out.append({"heading": heading, "content": content})
        return out

    def read(self) -> list[dict]:
        """Sections, with the abstract before and the references after them; empty where the page has no text of its own."""
        self.read_figures()
        element, paragraphs = self.abstract()
        sections = self.by_sections(element) if self.rules.sections else self.by_body()
        if not sections:
            return []
        if paragraphs:
            sections.insert(0, {"heading": "Abstract", "content": paragraphs})
        entries = [self.tree.text(e) for e in self.tree.select(self.rules.references)] if self.rules.references else []
        if entries:
            sections.append({"heading": "References", "content": [b for i, text in enumerate(entries, 1) for b in self.paragraph(f"{i}. {text}")]})
        return sections
