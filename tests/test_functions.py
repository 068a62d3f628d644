"""Column functions on the values they have to give."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import arrays, bibtex, dates, html, register, similarity, text


def values(spark, rows, schema, **columns):
    frame = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in frame.select(*[c.alias(n) for n, c in columns.items()]).collect()]


def one(spark, inputs, make):
    return [v[0] for v in values(spark, [(x,) for x in inputs], "x string", y=make(F.col("x")))]


SLUGS = {
    "Rate-Splitting Multiple Access": "rate-splitting-multiple-access", "The Attention Mechanism": "attention-mechanism", "The": "the", "α-divergence": "a-divergence", "García-Luna": "garcia-luna",
    "O(n²) complexity of self-attention": "o-n2-complexity-of-self-attention", "A/B test": "a-b-test", "Σ-algebra": "s-algebra", "123 456": "123-456", "emoji 😀 test": "emoji-test", "--foo-bar--": "foo-bar",
    "A Survey of Transformers": "survey-of-transformers", "abcde-" + "f" * 80: "abcde", "": None, "  ": None, "???": None, "θ and ψ": "th-and-ps", "x" * 70: "x" * 60,
}


def test_slugs(spark):
    assert one(spark, SLUGS, text.slug) == list(SLUGS.values())
    assert one(spark, [None], text.slug) == [None]
    assert one(spark, ["abcde-" + "f" * 80], text.slug_uncut) == ["abcde-" + "f" * 80]


IDS = [
    ("Vaswani", 2017, "Attention Is All You Need", "vaswani2017attention"), ("Smith", 2020, "The Future of AI", "smith2020future"), ("García", 2024, "Survey of RSMA", "garcia2024survey"), ("Chen", 2023, "1000 Genomes Project", "chen2023genomes"),
    ("Chen", 2023, "5G Networks", "chen20235g"), ("Jones", 2022, "A the of Framework for Deep Learning", "jones2022framework"), ("García-Luna", 2024, "Foo Bar", "garcialuna2024foo"), ("---", 2024, "Title Here", "unknown2024title"),
    ("Smith", 2024, "A the of", "smith2024untitled"), ("Øster", 2020, "Über Alles", "oster2020ber"),
]


def test_paper_ids(spark):
    got = values(spark, [i[:3] for i in IDS], "n string, y int, t string", p=text.paper_id(F.col("n"), F.col("y"), F.col("t")))
    assert [g[0] for g in got] == [i[3] for i in IDS]


DETECTED = {
    "arXiv:1706.03762v5": ("arxiv", "1706.03762v5"), "https://arxiv.org/abs/2301.00001": ("arxiv", "2301.00001"), "https://arxiv.org/pdf/hep-th/9901001": ("arxiv", "hep-th"), "doi:10.1000/XYZ": ("doi", "10.1000/XYZ"),
    "https://doi.org/10.1109/5.771073": ("doi", "10.1109/5.771073"), "10.99/x": ("unknown", "10.99/x"), "hep-th/9901001": ("arxiv", "hep-th/9901001"), " some title ": ("unknown", "some title"), "": ("unknown", ""),
}


def test_identifiers(spark):
    assert [tuple(r) for r in one(spark, DETECTED, text.detected_identifier)] == list(DETECTED.values())
    rows = [("arxiv", " 1706.03762v5 "), ("doi", "10.1/ABC"), ("url", "HTTP://X"), ("arxiv", "hep-th/9901001v2")]
    got = values(spark, rows, "k string, v string", n=text.normalized_identifier(F.col("k"), F.col("v")), w=text.identifier_version(F.col("k"), F.col("v")))
    assert got == [("1706.03762", "v5"), ("10.1/abc", None), ("HTTP://X", None), ("hep-th/9901001v2", None)]
    assert one(spark, ["10.1/A b(c)"], text.path_safe_doi) == ["10.1_a-b-c-"]
    assert one(spark, ["arXiv:2301.1v3"], text.versionless_arxiv) == ["2301.1"]
    assert one(spark, ["10.1234/x", "paper.pdf", "https://a.b/c", "notes.md", "arxiv:1", "zzz"], text.ingest_route) == ["doi", "pdf", "url", "markdown", "arxiv-id", "unknown"]


VENUES = {
    "2022 56th Asilomar Conference on Signals, Systems, and Computers": "asilomar-conference-on-signals-systems-and-computers", "2022 IEEE 96th Vehicular Technology Conference (VTC2022-Fall)": "ieee-vehicular-technology-conference-vtc-fall",
    "2024 IEEE Globecom Workshops (GC Wkshps)": "ieee-globecom-workshops-gc-wkshps", "GLOBECOM 1899": "globecom-1899", "ICASSP 2100": "icassp-2100", "CONF 1900": "conf", "CONF 2099": "conf", "802.11 Standards Forum": "802-11-standards-forum",
    "3rd-party tool": "party-tool", "2022": None, "2024 21st": None, " ": None,
}


def test_venues(spark):
    assert one(spark, VENUES, text.venue_slug) == list(VENUES.values())
    kinds = {"NeurIPS Workshop on X": "workshop", "arXiv preprint": "preprint-server", "Symposium on Y": "conference", "IEEE Transactions": "journal", "Anything": "journal", "workshopping": "journal", " ": None, "arXiv Conference": "preprint-server"}
    assert one(spark, kinds, text.venue_type) == list(kinds.values())


def test_small_text_functions(spark):
    assert one(spark, ["Foo: Bar,  BAZ_1é!"], text.reference_text) == ["foo bar baz_1é"]
    assert one(spark, ['a <b>: "c"  d'], text.file_name) == ["a_b_c_d"]
    assert values(spark, [(["Ann Lee", "Bo"],), (["Ann Lee"],), ([],), (None,)], "a array<string>", y=text.inline_author(F.col("a"))) == [("Lee et al.",), ("Lee",), ("",), ("",)]
    assert one(spark, ["a [[x|y]] ![[ z ]] [[p#s]]"], text.link_targets) == [["x", "z", "p#s"]]
    assert [tuple(r) if r else r for r in one(spark, ["wiki/open-problems/a-b.md", "wiki/other/x.md", "x"], text.page_kind_and_key)] == [("open-problem", "a-b"), None, None]
    assert one(spark, ["## Counter-Arguments and Gaps\nx\n## counter arguments"], text.counter_argument_headings) == [2]
    assert one(spark, ["> [!WARNING] Contradiction\n> [!warning]contradiction"], text.contradiction_callouts) == [2]
    assert one(spark, ["my label", "a..b", "x.lock", " "], text.valid_label) == ["my-label", None, None, None]
    assert one(spark, ["A/B\\c", ""], lambda c: text.export_label(c, F.lit("Some Field"))) == ["A-B-c", "some-field"]
    assert one(spark, ["Ann$^1$ Lee*,"], text.author_name) == ["Ann Lee,"]


DATES = {
    "2024-05-06": ("2024-05-06", 2024), "2024/13/06": ("2024-13-06", 2024), "March 5, 2021": ("2021-03-05", 2021), "5 March 2021": ("2021-03-05", 2021), "March 2021": ("2021-01-01", 2021), "2019": ("2019-01-01", 2019),
    "published in 2018!": ("2018-01-01", 2018), "soon": ("", None), None: ("", None), "Foo 5, 2021": ("2021-01-01", 2021),
}


def test_dates(spark):
    assert [tuple(r) for r in one(spark, DATES, dates.publication_date)] == list(DATES.values())
    stamps = ["2024-05-06", "2024-05-06T10:11:12", "2024-05-06T10:11:12Z", "2024-05-06T10:11:12+02:00", "06.05.2024", "2024-13-01", None]
    assert [str(d) for d in one(spark, stamps, dates.creation_date)] == ["2024-05-06"] * 4 + ["None"] * 3
    assert [str(d) for d in one(spark, ["2024-05-06", "2024-05-06T1", "x"], dates.strict_date)] == ["2024-05-06", "None", "None"]
    now = F.to_timestamp(F.lit("2024-01-03 00:00:00"))
    assert one(spark, ["2024-01-02 12:00:00", "2024-01-01 12:00:00", "x"], lambda c: dates.stale_run(c, now)) == [False, True, True]


def test_arrays(spark):
    rows = [(["a", "venue/x", "b", "b", "venue/y", "venue/x"],), (["b"],)]
    got = values(spark, rows, "t array<string>", y=arrays.retagged(F.col("t"), F.lit("venue/x"), F.lit("venue/y")))
    assert got == [(["a", "venue/y", "b", "b"],), (["b", "venue/y"],)]
    assert one(spark, ['["a",1]', "x", None, "", "null"], arrays.text_list) == [["a", "1"], ["x"], [], [], []]
    assert values(spark, rows, "t array<string>", a=arrays.appended(F.col("t"), F.lit("b")), n=arrays.numbered(F.col("t")), p=arrays.any_with_prefix(F.col("t"), "venue/"))[1] == (["b"], ["1. b"], False)


def test_similarity_is_the_standard_library_s(spark):
    from difflib import SequenceMatcher

    pairs = [("asilomar conference", "asilomar conf"), ("abc", "xyz"), ("", ""), ("a" * 250, "a" * 240 + "b"), ("ab cd", "cd ab")]
    got = values(spark, pairs, "a string, b string", r=similarity.sequence_ratio("a", "b"), bound=similarity.letters_bound(similarity.letter_counts(F.col("a")), similarity.letter_counts(F.col("b")), F.length("a"), F.length("b")), t=similarity.token_set_ratio("a", "b"))
    for (a, b), (ratio, bound, token) in zip(pairs, got):
        assert ratio == SequenceMatcher(None, a, b).ratio() and bound >= ratio - 1e-12
    assert got[4][2] == 1.0


BIB = '@Article{ old-Key ,\n title = {A {nested} title}, author="Ann \\"A\\" Lee" , year = 2020,\n note = {open'


def test_bibtex(spark):
    entry = bibtex.first_entry("noise " + BIB)
    assert entry == {"type": "article", "key": "old-Key", "fields": {"title": "A {nested} title", "author": 'Ann \\"A\\" Lee', "year": "2020", "note": "open"}}
    assert bibtex.first_entry("nothing") is None and bibtex.first_entry(None) is None
    keyed = one(spark, [BIB + "}\n@misc{second, }", "none"], lambda c: bibtex.with_key(c, F.lit("new2020")))
    assert keyed[0].startswith("@Article{ new2020 ,") and "second" in keyed[0] and keyed[1] is None
    assert one(spark, [BIB], lambda c: bibtex.with_key(c, F.lit("a b"))) == [None]
    row = [("T", ["A B", "C"], 2020, "Proceedings of X", "10.1/x", ["Unknown", "Book"]), ("T", [], 2020, "Proceedings of X", None, None), (None, [], 2020, "", "", []), ("T", [], None, "", "", []), ("T", ["A"], 2021, "", "", [])]
    build = bibtex.build_entry(F.lit("k"), *[F.col(c) for c in ("t", "a", "y", "v", "d", "p")])
    got = [v[0] for v in values(spark, row, "t string, a array<string>, y int, v string, d string, p array<string>", b=build)]
    assert got[0] == "@book{k,\n  title = {T},\n  author = {A B and C},\n  year = {2020},\n  doi = {10.1/x},\n}"
    assert got[1] == "@inproceedings{k,\n  title = {T},\n  year = {2020},\n  booktitle = {Proceedings of X},\n}"
    assert got[2:4] == [None, None] and got[4].startswith("@misc{k,")
    parsed = one(spark, [BIB, None], lambda c: bibtex.parse_entry(c))
    assert parsed[0]["fields"]["year"] == "2020" and parsed[1]["type"] is None


PAGE = """<html><head><title>Page &amp; title</title><meta name="citation_title" content="Real title"><meta name="citation_author" content="Ann"><meta name="citation_author" content="Bo">
<meta name="citation_doi" content="10.1/x"><meta name="keywords" content="a; b;"></head><body><nav><p>menu</p></nav><h1>Head</h1><h2>Abstract</h2><p>We show.</p><h2>1 Intro</h2><p>Text <b>bold</b> here<p>Second
<img src="//x.org/fig_small.png"><figcaption>Fig 1</figcaption><img src="//x.org/fig_small.png"><img src="/icon.png"><table><tr><th>a</th><td>b</td></tr><tr><td>c<td>d</tr></table>
<h2>References</h2><ul><li>Ref one<li>Ref two</ul></body>"""


def test_html_documents(spark):
    d = html.extract("https://link.springer.com/a", PAGE)
    assert (d["title"], d["authors"], d["doi"], d["abstract"], d["keywords"]) == ("Real title", ["Ann", "Bo"], "10.1/x", "We show.", ["a", "b"])
    assert [s["heading"] for s in d["sections"]] == ["1 Intro", "References"]
    assert [b["text"] or b["figure_id"] for b in d["sections"][0]["content"]] == ["Text bold here", "Second", "fig1", "fig1", "a | b", "c | d"]
    assert [b["text"] for b in d["sections"][1]["content"]] == ["1. Ref one", "2. Ref two"]
    assert [(f["filename"], f["url"], f["caption"]) for f in d["figures"]] == [("fig1.png", "https://x.org/fig_small.png", "Fig 1")]
    assert len(html.extract("https://ieeexplore.ieee.org/x", PAGE)["figures"]) == 2 and html.extract("https://ieeexplore.ieee.org/x", PAGE)["figures"][0]["url"].endswith("fig_large.png")
    assert html.extract(None, None)["sections"] == []
    urls = ["https://arxiv.org/abs/1", "http://sub.mdpi.com/x", "https://notarxiv.org", None, "bad"]
    assert one(spark, urls, html.site_column) == ["arxiv", "mdpi", None, None, None]
    got = values(spark, [("https://link.springer.com/a", PAGE), (None, None)], "u string, h string", d=html.extract_document("u", "h"))
    assert got[0][0]["title"] == "Real title" and got[1][0]["figures"] == []
    assert one(spark, ["x" * 2000, "short", "x" * 2000 + "CAPTCHA"], text.blocked_page) == [False, True, True]


def test_document_markdown(spark):
    schema = "m struct<title:string,authors:array<string>,doi:string,arxiv:string,url:string,date:string,year:int,venue:string,keywords:array<string>>, s array<struct<heading:string,content:array<struct<type:string,text:string,figure_id:string>>>>, f array<struct<id:string,filename:string,caption:string,failed:boolean>>"
    meta = ("T", ["Ann Lee", "Bo"], "10.1/x", None, "", "2020-01-01", 2020, "V", [])
    sections = [("Intro", [("paragraph", "Hello", None), ("figure", None, "fig1"), ("figure", None, "fig2"), ("figure", None, "gone"), ("paragraph", "", None)]), ("Empty", [])]
    figures = [("fig1", "old.png", "", False), ("fig1", "fig1.png", "Cap", False), ("fig2", "fig2.png", None, True)]
    got = values(spark, [(meta, sections, figures)], schema, t=text.document_markdown(F.col("m"), F.col("s"), F.col("f"), F.lit("lee2020t")))[0][0]
    assert got.startswith('---\ntitle: "T"\nauthors: [Ann Lee, Bo]\ninline_author: "Lee et al."\npaper-id: "lee2020t"\nidentifiers:\n  doi: "10.1/x"\ndate: 2020-01-01\nyear: 2020\nvenue: "V"\n---\n')
    assert "## Intro\nHello\n\n![[fig1.png]]\n*Cap*\n\n![[fig_missing.png]]\n<!-- Image download failed for: fig2.png -->\n" in got
    assert "old.png" not in got and "## Empty\n" in got


def test_functions_have_sql_names(spark):
    register(spark)
    row = spark.sql("SELECT nfkd_fold('é') AS a, seq_ratio('ab', 'ab') AS b, token_set_ratio('a b', 'b a') AS c, bib_parse('@a{k,x={1}}').key AS d").first()
    assert tuple(row) == ("e", 1.0, 1.0, "k")


@pytest.mark.parametrize("word,good", [("10.1/x", True), ("11.1/x", False)])
def test_loose_doi(spark, word, good):
    assert one(spark, [word], text.looks_like_doi) == [good]


def test_titles_cut_within_a_reference_keep_it_as_it_stands():
    title = lambda inner: html.read_page(f"<html><TITLE lang='de'>{inner}</TITLE><p>a &amp b</p>").title
    assert title("a &amp;&amp;&amp") == "a &&&amp" and title("x &l") == "x &l" and title("x &lt;&amp;lt; y &gt") == "x <&lt; y &gt"
    assert title("&#228;&#xE4;&auml; & b &ampc; &#12") == "äää & b &ampc; &#12"
    assert html.read_page("<title>t</title><p>a &amp b</p>").blocks == [("p", "a & b", "")]


def test_pages_of_a_batch_are_handed_on_in_pieces():
    import pandas as pd

    pages = pd.Series(["<title>t</title><p>" + "long enough a paragraph " * 5] * 700 + [None, "x" * html.PIECE_CHARS, "<title>last</title>"])
    made = list(html._documents(iter([(pd.Series([None] * len(pages)), pages)])))
    assert [len(m) for m in made] == [256, 256, 190, 1] and made[-1]["title"].tolist() == ["last"]
    assert [len(m) for m in html._parsed(iter([pages]))] == [256, 256, 190, 1]
