"""The pages' paragraphs in eight publishers' markup, and what is read from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import html
from scriptorium.plans.registry import _s, _t, query

_TABLE = "<table><tr><th>a</th><td>b</td></tr><tr><td>c</td><td>d</td></tr></table>"
# site: (address, before the paragraphs, around each, after them, a paragraph's text of the figure and the table)
_MARKUP = {
    "arxiv": ("https://arxiv.org/html/", "<section class='ltx_section'><h2 class='ltx_title'>One</h2>", ("<div class='ltx_para'><p class='ltx_p'>", "</p></div>"), "<figure class='ltx_figure'><img src='f.png'><figcaption class='ltx_caption'>Cap</figcaption></figure></section><ul class='ltx_bibliography'><li class='ltx_bibitem'>Ref</li></ul>", []),
    "ieee": ("https://ieeexplore.ieee.org/document/", "<div class='section'><h2>One</h2>", ("<p>", "</p>"), "<div><img src='/mediastore/f.png'><div class='caption'>Cap</div></div></div><ol class='references'><li>Ref</li></ol>", []),
    "springer": ("https://link.springer.com/article/", "<section class='c-article-section'><h2>One</h2><div class='c-article-section__content'>", ("<p>", "</p>"), "</div><div class='c-article-section__figure'><img src='f.png'><figcaption>Cap</figcaption></div></section><ul id='Bib1'><li class='c-article-references__item'>Ref</li></ul>", []),
    "sciencedirect": ("https://www.sciencedirect.com/science/", "<div id='body'><h2>One</h2>", ("<p>", "</p>"), "<figure><img src='f.png'><figcaption>Cap</figcaption></figure></div><div class='bib-reference'>Ref</div>", []),
    "mdpi": ("https://www.mdpi.com/", "<div class='html-body'><h2 class='html-h2'>One</h2>", ("<div class='html-p'>", "</div>"), f"<div class='html-fig_show'><div class='html-fig_img'><a class='html-img-zoom'><img src='f.png'></a></div><div class='html-fig_description'>Cap</div></div><div class='html-table_show'>{_TABLE}</div></div><div class='html-bib-entry'>Ref</div>", ["a | b\nc | d"]),
    "wiley": ("https://onlinelibrary.wiley.com/doi/", "<section id='abstract'><div class='article-section__content'><p>What the page says</p></div></section><section><h2>One</h2><div class='article-section__content'>", ("<p>", "</p>"), f"<figure class='figure'><img src='/cms/asset/f.png'><figcaption>Cap</figcaption></figure><div class='article-table-content-wrapper'>{_TABLE}</div></div></section><div class='citation__body'>Ref</div>", ["a | b\nc | d"]),
    "tandfonline": ("https://www.tandfonline.com/doi/", "<div class='hlFld-Fulltext'><h2>One</h2>", ("<div class='NLM_p'>", "</div>"), f"<div class='figureView'><img src='/cms/asset/f.png'><div class='caption'>Cap</div></div>{_TABLE}</div><ul class='references'><li>Ref</li></ul>", ["a | b\nc | d"]),
    "asce": ("https://ascelibrary.org/doi/", "<div class='core-container'><section><h2>One</h2>", ("<p>", "</p>"), f"<figure><img src='f.png'><figcaption>Cap</figcaption></figure><div>{_TABLE}</div></section></div>", ["Cap", "a | b\nc | d"]),
}
_HEADINGS = {"wiley": "Abstract|One|References", "asce": "One"}


def _cases(of) -> str:
    return "CASE page_id % 8 " + " ".join(f"WHEN {n} THEN {of(name)}" for n, name in enumerate(_MARKUP)) + " END"


def _sql_tail(name: str) -> str:
    return "'" + "".join("\n" + line for line in _MARKUP[name][4]).replace("\n", "' || chr(10) || '") + "'"


@query(f"""
WITH p AS (
  SELECT page_id, list_prepend('A first paragraph of page ' || page_id, list_filter(list_transform(regexp_extract_all(html, '<p[^>]*>([^<&]+)</p>', 1), lambda t: trim(regexp_replace(t, '\\s+', ' ', 'g'))), lambda t: length(t) > 10)) AS texts FROM pages
)
SELECT page_id, {_cases(lambda n: f"'{n}'")} AS site, {_cases(lambda n: f"'{_HEADINGS.get(n, 'One|References')}'")} AS headings,
       md5(array_to_string(texts, chr(10)) || {_cases(_sql_tail)}) AS paragraphs_md5, 'Cap' AS caption, {_cases(lambda n: f"'{'' if n == 'asce' else '1. Ref'}'")} AS last_reference
FROM p
""")
def site_sections(spark, sf_dir):
    """Each page's paragraphs in a publisher's markup with a figure, a table and a reference: the sections read from it."""
    texts = F.filter(F.transform(F.regexp_extract_all("html", F.lit("<p[^>]*>([^<&]+)</p>"), F.lit(1)), lambda t: F.trim(F.regexp_replace(t, r"\s+", " "))), lambda t: F.length(t) > 10)
    texts = F.concat(F.array(_s("A first paragraph of page ", F.col("page_id"))), texts)
    page, url = F.lit(None).cast("string"), F.lit(None).cast("string")
    for n, (address, before, (start, end), after, _) in enumerate(_MARKUP.values()):
        made = F.concat(F.lit(before + start), F.array_join(texts, end + start), F.lit(end + after))
        page, url = F.when(F.col("page_id") % 8 == n, made).otherwise(page), F.when(F.col("page_id") % 8 == n, _s(address, F.col("page_id"))).otherwise(url)
    rows = _t(spark, sf_dir, "pages").select("page_id", url.alias("url"), F.concat(F.lit("<html><body>"), page, F.lit("</body></html>")).alias("html"))
    read = rows.select("page_id", html.site_column(F.col("url")).alias("site"), html.extract_document("url", "html").alias("d"))
    sections = F.col("d.sections")
    one = F.filter(sections, lambda s: s["heading"] == "One")[0]["content"]
    paragraphs = F.transform(F.filter(one, lambda b: b["type"] == "paragraph"), lambda b: b["text"])
    references = F.filter(sections, lambda s: s["heading"] == "References")
    return read.select(
        "page_id", "site", F.array_join(F.transform(sections, lambda s: s["heading"]), "|").alias("headings"), F.md5(F.array_join(paragraphs, "\n").cast("binary")).alias("paragraphs_md5"),
        F.col("d.figures")[0]["caption"].alias("caption"), F.coalesce(F.get(F.get(references, F.lit(0))["content"], F.lit(0))["text"], F.lit("")).alias("last_reference"),
    )
