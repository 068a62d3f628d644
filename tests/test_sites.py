"""Fields and selectors of publishers' pages, on pages written for these tests."""

import pytest

from scriptorium.functions import html
from scriptorium.functions.selectors import Tree, parse_selector

PAGES = {
    "https://arxiv.org/abs/1": (
        "<meta name='citation_date' content='2021/03/04'><h1 class='ltx_title ltx_title_document'>Title: On <i>Trees</i></h1><div class='ltx_authors'><span class='ltx_personname'>Ann Bee</span><span class='ltx_personname'>Cy Dee</span></div>"
        "<div class='ltx_abstract'><p class='ltx_p'>First.</p><p class='ltx_p'>Second.</p></div><div class='ltx_classification'><span class='ltx_text'>trees</span></div>",
        ("On Trees", ["Ann Bee", "Cy Dee"], "First. Second.", "", "2021/03/04", "arXiv", ["trees"]),
    ),
    "https://ieeexplore.ieee.org/document/1": (
        "<h1 class='document-title'><span>Fast <b>joins</b></span></h1><div class='authors-info'><span id='author-1'>Ann Bee</span></div><div class='abstract-text'><div class='u-mb-1'>We join.</div></div>"
        "<div class='stats-document-abstract-doi'><a href='https://doi.org/10.1/x'>10.1/x</a></div><div class='doc-abstract-pubdate'>Date of Publication: 4 March 2021</div><div class='stats-document-abstract-publishedIn'><a>Journal J</a></div>"
        "<div class='stats-keywords-section'><span class='stats-keywords'><a>join</a><a>speed</a><a>join</a></span></div>",
        ("Fast joins", ["Ann Bee"], "We join.", "10.1/x", "4 March 2021", "Journal J", ["join", "speed"]),
    ),
    "https://link.springer.com/article/1": (
        "<h1 class='c-article-title'>Soil</h1><a data-test='author-name'>Ann Bee</a><div id='Abs1-content'><p>We dig.</p></div><time datetime='2020-05-06'>May</time><meta name='citation_doi' content='10.2/y'><li class='c-article-subject-list__subject'>soil</li>",
        ("Soil", ["Ann Bee"], "We dig.", "10.2/y", "2020-05-06", "", ["soil"]),
    ),
    "https://www.sciencedirect.com/science/1": (
        "<h1 class='title-text'><span class='title-text'>Ice</span> cores</h1><div class='author'><span class='text'>Ann Bee</span></div><div id='abspara0010'>We melt.</div><a class='publication-title-link'>Cold</a><div class='keyword'><span>ice</span></div>",
        ("Ice", ["Ann Bee"], "We melt.", "", "", "Cold", ["ice"]),
    ),
    "https://www.mdpi.com/1": (
        "<h1 class='title hypothesis_container'>Rain</h1><div class='art-authors'><a class='sciprofiles-link'>Ann Bee</a></div><section class='art-abstract'><div class='html-p'>We pour.</div></section><span class='journal-name'>Wet</span><span class='art-keyword'>rain;</span>",
        ("Rain", ["Ann Bee"], "We pour.", "", "", "Wet", ["rain"]),
    ),
    "https://onlinelibrary.wiley.com/1": (
        "<h1 class='citation__title'>Sand</h1><div class='loa-authors'><div class='author-name'><span>Ann Bee</span></div></div><section id='abstract'><div class='article-section__content'><p>We sift.</p></div></section><div class='kwd-group'><span class='kwd'>sand</span></div>",
        ("Sand", ["Ann Bee"], "We sift.", "", "", "", ["sand"]),
    ),
    "https://www.tandfonline.com/1": (
        "<h1><span class='NLM_article-title'>Fog</span></h1><span class='contrib-author'>Ann Bee</span><div class='hlFld-Abstract'><p>We wait.</p></div><meta name='dc.Date' content='2019-01-02'><div class='hlFld-KeywordText'><a>fog,</a></div>",
        ("Fog", ["Ann Bee"], "We wait.", "", "2019-01-02", "", ["fog"]),
    ),
    "https://ascelibrary.org/1": (
        "<h1 class='citation__title'>Steel</h1><span class='loa__author-name'>Ann Bee</span><section><h2>Abstract</h2><p>We weld.</p></section><div class='abstractKeywords'><a>steel</a></div>",
        ("Steel", ["Ann Bee"], "We weld.", "", "", "", ["steel"]),
    ),
}
FIELDS = ("title", "authors", "abstract", "doi", "date", "venue", "keywords")


@pytest.mark.parametrize("url", PAGES)
def test_fields_of_a_sites_elements(url):
    page, expected = PAGES[url]
    got = html.extract(url, f"<html><head><title>x</title></head><body>{page}</body></html>")
    assert tuple(got[f] for f in FIELDS) == expected


@pytest.mark.parametrize("url", PAGES)
def test_meta_tags_where_the_elements_are_missing(url):
    page = "<meta name='citation_title' content='T'><meta name='citation_author' content='A'><meta name='citation_author' content='B'><meta name='citation_doi' content='10.1/z'><meta name='citation_publication_date' content='2020'><meta name='citation_journal_title' content='V'>"
    assert tuple(html.extract(url, page)[f] for f in FIELDS) == ("T", ["A", "B"], "", "10.1/z", "2020", "V", [])


def test_every_site_has_fields():
    assert set(html.FIELDS) == {s.name for s in html.SITES}


def test_selectors_on_broken_pages():
    tree = html.read_page("</p><div id='a'><p class='x y'>One<p class='x'>Two<br>2</div></span><p class='x'>Three<script>no()</script>").tree
    assert tree.values(".x") == ["One", "Two2", "Three"] and tree.values("div .x.y, #a p") == ["One", "Two2"]
    assert tree.values("p[class^=x]") == ["One", "Two2", "Three"] and tree.values("[class='x']") == ["Two2", "Three"] and tree.values("div@id") == ["a"]
    assert tree.values("span") == [] and Tree().values("p") == []
    with pytest.raises(ValueError):
        parse_selector("p > a")


def test_long_pages_with_unclosed_tags_end_soon():
    assert len(html.read_page("<div>" * 50_000 + "</b>" * 50_000).tree.select("div")) == 50_000


def test_documents_have_iso_dates(spark):
    rows = [(1, "https://ieeexplore.ieee.org/document/1", PAGES["https://ieeexplore.ieee.org/document/1"][0]), (2, None, None)]
    d = spark.createDataFrame(rows, "i int, u string, h string").select("i", html.extract_document("u", "h").alias("d")).orderBy("i").collect()
    assert (d[0]["d"]["date"], d[0]["d"]["year"], d[0]["d"]["title"]) == ("2021-03-04", 2021, "Fast joins") and (d[1]["d"]["date"], d[1]["d"]["year"]) == ("", None)
