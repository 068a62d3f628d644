"""Sections, tables and figures of publishers' pages, on pages written for these tests and read by hand."""

import pytest

from scriptorium.functions import html
from scriptorium.functions.layouts import LAYOUTS
from scriptorium.functions.selectors import parse_selector

LONG = "Words enough to be a paragraph"

#: url: (page, [(heading, blocks)], [(address, caption)]); a block is its text or a figure's id
PAGES = {
    "https://arxiv.org/html/1": (
        "<div class='ltx_abstract'><p class='ltx_p'>One.</p><p class='ltx_p'>Two.</p></div>"
        "<section class='ltx_section'><h2 class='ltx_title'>1 Start</h2><div class='ltx_para'><p class='ltx_p'>Trees <i>grow</i>.</p></div><figure class='ltx_figure'><img src='x1.png'><figcaption class='ltx_caption'>Figure 1: A tree</figcaption></figure></section>"
        "<section class='ltx_section'><h2 class='ltx_title'>2 End</h2><p>not a paragraph of theirs</p><div class='ltx_para'><p class='ltx_p'>Trees fall.</p></div></section><section class='ltx_section'><h2 class='ltx_title'>Empty</h2></section>"
        "<section class='ltx_bibliography'><ul><li class='ltx_bibitem'>Bee 2001</li><li class='ltx_bibitem'>Dee 2002</li></ul></section>",
        [("Abstract", ["One.", "Two."]), ("1 Start", ["Trees grow.", "fig1"]), ("2 End", ["Trees fall."]), ("References", ["1. Bee 2001", "2. Dee 2002"])],
        [("https://arxiv.org/html/x1.png", "Figure 1: A tree")],
    ),
    "https://ieeexplore.ieee.org/document/1": (
        "<div class='abstract-text'><div class='u-mb-1'>We join.</div></div>"
        "<div class='section'><h2>I. Joins</h2><p>Sorted.</p><div class='figure'><img src='/mediastore/fig-small.gif' data-media-id='m1'><div class='figcaption'>Fig. 1. A join.</div></div></div>"
        "<div class='section_2'><h3>A. Hashes</h3><p>Hashed.</p><img src='/mediastore/logo.gif'></div><div class='section'><p>Bare.</p></div>"
        "<div class='reference-container'><div class='reference-item'>Bee</div></div>",
        [("Abstract", ["We join."]), ("I. Joins", ["Sorted.", "fig1"]), ("A. Hashes", ["Hashed."]), ("Untitled Section", ["Bare."]), ("References", ["1. Bee"])],
        [("https://ieeexplore.ieee.org/mediastore/fig-large.gif", "Fig. 1. A join.")],
    ),
    "https://link.springer.com/article/1": (
        "<section class='c-article-section' id='Abs1'><h2>Abstract</h2><div class='c-article-section__content' id='Abs1-content'><p>We dig.</p></div></section>"
        "<section class='c-article-section' id='Sec1'><h2>Soil</h2><div class='c-article-section__content'><p>Deep soil.</p><div><p>Inner.</p></div>"
        "<div class='c-article-section__figure'><picture><img data-src='//media.x.org/a.png' src='b.png'></picture><div class='c-article-section__figure-description'>A spade</div></div></div><p>Own.</p></section>"
        "<section class='c-article-section'><h2>Other</h2><div><div class='c-article-section__content'><p>too deep</p></div></div></section><div id='Bib1'><li class='c-article-references__item'>Bee</li></div>",
        [("Abstract", ["We dig."]), ("Soil", ["Deep soil.", "Inner.", "Own.", "fig1"]), ("References", ["1. Bee"])],
        [("https://media.x.org/a.png", "A spade")],
    ),
    "https://www.sciencedirect.com/science/1": (
        "<div id='abspara0010'>We melt ice.</div><div id='body'><p>An introduction here</p><h2>Ice</h2><div class='u-margin-s-bottom'>Ice is quite cold</div><p>short</p>"
        "<figure><img data-src='/ice.jpg'><span class='captions'><p>Fig. 1. Ice cores, of which many</p></span></figure><h3>Snow</h3><p>Snow is quite cold too</p><figure><img src='clear.gif'></figure></div><div class='bib-reference'>Bee</div>",
        [("Abstract", ["We melt ice."]), ("Introduction", ["An introduction here"]), ("Ice", ["Ice is quite cold", "fig1"]), ("Snow", ["Snow is quite cold too"]), ("References", ["1. Bee"])],
        [("https://www.sciencedirect.com/ice.jpg", "Fig. 1. Ice cores, of which many")],
    ),
    "https://www.mdpi.com/1": (
        "<div class='art-abstract'><div class='html-p'>We pour.</div></div><div class='html-body'><section><div class='html-p'>Before.</div><h2 class='html-h2'>1. Rain</h2><div class='html-p'>It rains.</div>"
        "<div class='html-fig_show'><div class='html-fig_img'><a class='html-img-zoom'><img src='/r.png'></a></div><div class='html-fig_description'>Rain.</div></div>"
        "<h4 class='html-h4'>1.1. Much</h4><div class='html-table_show'><table><tr><th>a</th><th colspan='2'>b</th></tr><tr><td>1</td><td>2</td><td>3</td></tr></table></div></section></div><div class='html-bib-entry'>Bee</div>",
        [("Abstract", ["We pour."]), ("Untitled Section", ["Before."]), ("1. Rain", ["It rains.", "fig1"]), ("1.1. Much", ["a | b | \n1 | 2 | 3"]), ("References", ["1. Bee"])],
        [("https://www.mdpi.com/r.png", "Rain.")],
    ),
    "https://onlinelibrary.wiley.com/1": (
        "<section id='abstract'><h2>Abstract</h2><div class='article-section__content'><p>We sift sand here.</p></div></section>"
        f"<section><h2>Sand</h2><div class='article-section__content'><p>{LONG}</p><p>short</p><figure class='figure'><picture><img src='/cms/asset/s.png'></picture><figcaption>Sand</figcaption></figure><figure class='figure'><img src='/pixel.png'></figure>"
        "<div class='article-table-content'><header class='article-table-caption'>Table 1</header><div class='article-table-content-wrapper'><table><tr><td>x</td><td>y</td></tr></table></div></div></div></section>"
        f"<section><h2>Supporting Information</h2><div class='article-section__content'><p>{LONG}</p></div></section><div class='citation__body'>Bee</div>",
        [("Abstract", ["We sift sand here."]), ("Sand", [LONG, "fig1", "Table 1\nx | y"]), ("References", ["1. Bee"])],
        [("https://onlinelibrary.wiley.com/cms/asset/s.png", "Sand")],
    ),
    "https://www.tandfonline.com/1": (
        f"<div class='hlFld-Fulltext'><div class='abstractSection'><p>We wait in fog.</p><p>{LONG}</p></div><p>{LONG}</p><h2>Fog</h2><div class='NLM_p'>Fog is grey and wet</div><table><tr><td><p>{LONG}</p></td></tr></table>"
        "<div class='NLM_sec'><div class='tableCaption'>Table 2. Fogs</div><table><tr><td>1</td></tr><tr><td>2</td></tr></table></div><div class='tableView'><div class='tableCaption'>Table 2. Fogs</div></div><div class='tableView'><div class='tableCaption'>Table 9</div></div>"
        "<div class='figureView'><img src='/cms/asset/f.png'><div class='caption'>A bank</div></div></div><div class='references'><ol><li>Bee</li></ol></div>",
        [("Abstract", ["We wait in fog."]), ("Introduction", [LONG]), ("Fog", ["Fog is grey and wet", "1\n2", "Table 2. Fogs\n1\n2", "Table 9\n(Table content not available)", "fig1"]), ("References", ["1. Bee"])],
        [("https://www.tandfonline.com/cms/asset/f.png", "A bank")],
    ),
    "https://ascelibrary.org/1": (
        f"<div class='core-container'><section><h2>Steel</h2><h3>Kinds</h3><p>{LONG}</p><div><figure><img src='/s.png'><figcaption>Beam</figcaption></figure></div><div><table><tr><td>a</td></tr><tr><td>b</td></tr></table></div><p>no</p></section>"
        f"<section><h2>Data Availability Statement</h2><p>{LONG}</p></section><section><p>{LONG}</p></section></div><figure><img src='/spinner.gif'></figure>",
        [("Steel", [LONG, "fig1", "Beam", "a\nb"])],
        [("https://ascelibrary.org/s.png", "Beam")],
    ),
}


@pytest.mark.parametrize("url", PAGES)
def test_a_sites_sections_and_figures(url):
    page, sections, figures = PAGES[url]
    got = html.extract(url, f"<html><head><title>x</title></head><body>{page}</body></html>")
    assert [(s["heading"], [b["text"] or b["figure_id"] for b in s["content"]]) for s in got["sections"]] == sections
    assert [(f["url"], f["caption"]) for f in got["figures"]] == figures
    assert [f["id"] for f in got["figures"]] == [f"fig{i}" for i in range(1, len(figures) + 1)]


@pytest.mark.parametrize("url", PAGES)
def test_other_markup_is_read_by_its_headings(url):
    got = html.extract(url, f"<h2>Found</h2><p>{LONG}</p>")
    assert [(s["heading"], [b["text"] for b in s["content"]]) for s in got["sections"]] == [("Found", [LONG])]


def test_all_sites_have_a_layout_of_known_selectors():
    assert set(LAYOUTS) == {s.name for s in html.SITES}
    for rules in LAYOUTS.values():
        for css in (rules.sections, *rules.body, rules.heading, *rules.abstract, rules.paragraphs, rules.figures, rules.tables, rules.references, *rules.images, *rules.captions, *(f.removesuffix(" ^") for f in rules.frames)):
            parse_selector(css)


def test_relations_of_elements():
    tree = html.read_page("<div id=a><p>1</p><section><p>2</p></section></div><p id=b>3").tree
    a, section = tree.select("#a")[0], tree.select("section")[0]
    assert [tree.text(e) for e in tree.select(":scope > p", a)] == ["1"] and [tree.text(e) for e in tree.select("p", a)] == ["1", "2"]
    assert [tree.text(e) for e in tree.select(":scope > section p", a)] == ["2"] and tree.select(":scope > p", tree.select("#b")[0]) == []
    assert [tree.tags[e] for e in tree.children(a)] == ["p", "section"] and tree.sibling(a) == tree.select("#b")[0] and tree.sibling(section) is None
    assert tree.closest(tree.select("section p")[0], "div, table") == a and tree.closest(a, "table") is None
    assert tree.within(section, a) and not tree.within(a, section)


def test_a_page_of_many_sections_ends_soon():
    page = "<div class='html-body'>" + "<h2 class='html-h2'>H</h2><div class='html-p'>text</div>" * 3000 + "</div>"
    assert len(html.extract("https://www.mdpi.com/2", page)["sections"]) == 3000


def test_broken_addresses_and_pages():
    assert html.extract("https://www.mdpi.com/3", "<div class='html-body'><div class='html-p'>x<div class='html-fig_img'><img src='http://[oops'><img></div>")["sections"][0]["heading"] == "Untitled Section"
    assert html.extract("https://arxiv.org/abs/2", None)["sections"] == []
