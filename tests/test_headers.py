"""Headers as variants, and links by SQL."""

import json

from scriptorium.functions import register
from scriptorium.operators import links
from scriptorium.sources import corpus

FULL = {
    "type": "paper", "title": "T", "year": 2020, "tags": ["a", "b"], "aliases": "one", "cites": [], "sources": None, "papers": " ", "authors": [{"name": "Ann", "slug": "ann"}, "Bo", {"slug": "x"}],
    "identifiers": {"doi": "10.1/x", "arxiv-version": "v2", "n": 3}, "bib-file": "p.bib", "paper-id": "p", "venue": "v", "status": ["odd", 1], "created": "2020-01-01",
}


def pages(spark, *headers):
    return spark.createDataFrame([(f"{i}.md", str(i), "b", h) for i, h in enumerate(headers)], "path string, stem string, body string, header string")


def test_columns_of_a_header(spark):
    rows = {r.stem: r for r in corpus.page_columns(pages(spark, json.dumps(FULL), "{}", None, "[1]", "no json", '{"tags": "null", "authors": "Ann", "year": 1.50, "identifiers": "x", "title": ""}')).collect()}
    r = rows["0"]
    assert (r.type, r.title, r.year, r.tags, r.aliases, r.cites, r.sources, r.papers) == ("paper", "T", "2020", ["a", "b"], ["one"], [], [], [])
    assert r.authors[:2] == ["Ann", "Bo"] and json.loads(r.authors[2]) == {"slug": "x"}
    assert (r.identifiers, r.arxiv_version, r.bib_file, r.paper_id, r.venue, r.status, r.created) == ({"doi": "10.1/x", "arxiv-version": "v2", "n": "3"}, "v2", "p.bib", "p", "v", '["odd",1]', "2020-01-01")
    assert sorted(r["keys"]) == sorted(k for k, v in FULL.items() if v is not None)
    for stem in ("1", "2", "3", "4"):
        assert (rows[stem].type, rows[stem].tags, rows[stem].identifiers, rows[stem].authors) == (None, [], None, None)
    assert (rows["5"].tags, rows["5"].year, rows["5"].identifiers, rows["5"].title) == ([], "1.5", None, "")


def test_a_header_is_parsed_once(spark):
    plan = corpus.page_columns(pages(spark, "{}"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parse_json(header") == 1 or plan.count("parseJson") == 1


def test_a_schema_of_all_headers(spark):
    got = corpus.header_schema(pages(spark, '{"a": 1, "t": ["x"]}', '{"a": 2.5, "b": {"c": true}}', None))
    assert got.startswith("OBJECT<a: DECIMAL") and "b: OBJECT<c: BOOLEAN>" in got and "t: ARRAY<STRING>" in got
    assert corpus.header_schema(pages(spark)) in (None, "VOID")


def test_links_by_sql_equal_page_links(spark):
    register(spark)
    bodies = ["x [[b]] y\n[[c|d]] [[ e ]]\r\n[[f]]", None, "", "none", "[[g]] [[h|i|j]]\x0b[[]] [[k", "a\x85[[l]]"]
    table = spark.createDataFrame([(f"s{i}", f"s{i}.md", b) for i, b in enumerate(bodies)], "stem string, path string, body string")
    table.createOrReplaceTempView("link_pages")
    found = spark.sql("SELECT p.stem AS src, p.path, l.line, l.target FROM (SELECT *, links_of(body) AS links FROM link_pages) AS p, LATERAL inline(p.links) AS l(line, target)")
    want = sorted(map(tuple, links.page_links(table).collect()))
    assert sorted(map(tuple, found.collect())) == want and len(want) >= 6
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Python" not in plan and "Exchange" not in plan
