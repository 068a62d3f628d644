"""Operators on small tables, and every registered query against its SQL."""

from __future__ import annotations

import hashlib
import json
import random
import time
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import backlinks, export, links, matching, merging, venues
from scriptorium.plans.catalogue import ORACLE_SQL, QUERIES
from scriptorium.session import FREED, stored
from scriptorium.sources import corpus, records, sinks
from scriptorium.streaming import waves

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLE_SQL:
        assert len(got.columns)
        return
    want = duck.sql(ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    clean = lambda f: sorted(map(tuple, f[columns].astype(str).replace({"None": "nan", "<NA>": "nan", "NaT": "nan"}).to_numpy().tolist()))
    assert clean(got) == clean(want)


def test_near_duplicate_keys_lose_no_pair(spark):
    keys = ["ieee-vehicular-technology-conference", "ieee-vehicular-technology-conferences", "ieee-vehiculr-technology-conference", "asilomar-conference-on-signals", "asilomar-conf-on-signals", "icc", "icc2", "a", "b", "ab", "", "globecom-workshops", "globecom-workshop", "x-workshops", "neurips-vtc", "neurip-vtc"]
    got = {(r.a, r.b): r.similarity for r in matching.near_duplicate_keys(spark.createDataFrame([(k,) for k in keys + keys], "key string")).collect()}
    tail = lambda k: k.rsplit("-", 1)[-1]
    want = {}
    for a in set(keys):
        for b in set(keys):
            if a < b:
                ratio = SequenceMatcher(None, a.replace("-", " "), b.replace("-", " ")).ratio()
                if ratio >= 0.92 or (tail(a) and tail(a) == tail(b) and ratio >= 0.8):
                    want[a, b] = ratio
    assert got == want


def test_reference_matches(spark):
    refs = spark.createDataFrame([(1, "Vaswani: Attention is all you need, 2017"), (2, "nothing alike"), (3, "")], "ref_id long, text string")
    cands = spark.createDataFrame([("p1", 0, "Attention Is All You Need Vaswani 2017"), ("p2", 1, "attention is all you need vaswani 2017"), ("p3", 2, ""), ("p4", 3, "Other work 1999")], "key string, pos long, text string")
    got = [tuple(r) for r in matching.reference_matches(refs, cands).orderBy("ref_id", "rank").collect()]
    assert [(r, c, k) for r, c, _, k in got] == [(1, "p1", 1), (1, "p2", 2), (1, "p3", 3), (2, "p3", 1), (3, "p1", 1), (3, "p2", 2), (3, "p3", 3), (3, "p4", 4)]
    many = spark.createDataFrame([(f"c{i}", i, "attention is all you need vaswani 2017") for i in range(10)], "key string, pos long, text string")
    assert [r.candidate for r in matching.reference_matches(refs.where("ref_id = 1"), many).orderBy("rank").collect()] == [f"c{i}" for i in range(5)]


def test_neighbour_order(spark):
    schema = "key string, year string, tags array<string>"
    rows = [("me", "2020", ["field/a", "method/b", "year/2020"]), ("two", "2001", ["field/a", "method/b"]), ("new", "2022", ["field/a"]), ("old", "x", ["field/a"]), ("none", "2020", ["year/2020", "venue/v"])]
    papers = spark.createDataFrame(rows, schema)
    got = matching.tag_neighbours(papers.where("key = 'me'"), papers, 20).orderBy("rank").collect()
    assert [(r.neighbour, r.shared, r.year) for r in got] == [("two", 2, 2001), ("new", 1, 2022), ("old", 1, 0)]


def test_tag_neighbours_of_large_groups_are_those_of_all_pairs(spark):
    """Sets of more than k candidates, a key of several years, repeated rows; every pair is counted here."""
    rows = [(i, [f"field/{i % 3}", f"method/{i % 4}", "year/1", f"field/{i % 3}"], 2000 + i % 7) for i in range(120)]
    rows += [(5, ["field/2", "method/1"], 2030), (5, ["field/2"], 2031), (6, ["field/0", "method/2"], 2006), (7, [], 2000), (None, ["field/1"], 2040)]
    papers = spark.createDataFrame(rows, "key long, tags array<string>, year int")
    keep = [(k, [t for t in sorted(set(tags)) if t[:5] != "year/"], y) for k, tags, y in rows]
    want = {}
    for key in {k for k, _, _ in keep if k is not None and k % 5 == 0}:
        counts = {}
        for own, tags, _ in keep:
            for other, others, year in keep if own == key else ():
                if other is not None and other != key and (n := len(set(tags) & set(others))):
                    counts[other, year] = counts.get((other, year), 0) + n
        best = sorted(((n, y, o) for (o, y), n in counts.items()), key=lambda x: (-x[0], -x[1], x[2]))[:4]
        want |= {(key, r + 1): (o, n, y) for r, (n, y, o) in enumerate(best)}
    found = matching.tag_neighbours(papers.where("key % 5 = 0"), papers, 4)
    assert {(r.key, r["rank"]): (r.neighbour, r.shared, r.year) for r in found.collect()} == want


def test_tag_neighbours_of_one_common_tag(spark):
    """3,000 probes of 150,000 candidates under one tag: 450 million pairs share it."""
    papers = spark.range(150_000).select(F.col("id").alias("key"), F.array(F.lit("field/a")).alias("tags"), F.lit(2000).alias("year"))
    began = time.monotonic()
    got = matching.tag_neighbours(papers.where("key % 50 = 0"), papers, 2).collect()
    assert time.monotonic() - began < 25
    assert {(r.key, r["rank"], r.neighbour) for r in got} == {(k, n, n - (k > 0)) for k in range(50, 150_000, 50) for n in (1, 2)} | {(0, 1, 1), (0, 2, 2)}


def test_majority_and_its_ties(spark):
    rows = [("g", "a", 1, "m1"), ("g", "a", 1, "m2"), ("g", "b", 9, "m3"), ("h", "a", 2, "z"), ("h", "b", 3, "y"), ("i", "a", 3, "z"), ("i", "b", 3, "y")]
    got = {r.g: r.v for r in merging.majority(spark.createDataFrame(rows, "g string, v string, n int, k string"), "g", "v", "n", "k").collect()}
    assert got == {"g": "a", "h": "b", "i": "b"}


def test_collisions(spark):
    proposed = spark.createDataFrame([(1, "smith2020neural"), (2, "smith2020neural"), (3, "smith2020neural"), (4, "x"), (5, "y1")], "seq long, base string")
    taken = spark.createDataFrame([("smith2020neural",), ("smith2020neural2",), ("smith2020neural4",), ("y",)], "key string")
    got = {r.seq: r.key for r in merging.collision_free(proposed, taken).collect()}
    assert got == {1: "smith2020neural3", 2: "smith2020neural5", 3: "smith2020neural6", 4: "x", 5: "y1"}


def test_collisions_of_many_proposals_of_one_base(spark):
    """40,000 arrivals of a base; a list of suffixes for each would be 800 million numbers."""
    taken = spark.createDataFrame([("b",), ("b3",), ("b4",), ("b39000",), ("b50000",)], "key string")
    began = time.monotonic()
    got = {r.seq: r.key for r in merging.collision_free(spark.range(40_000).select(F.col("id").alias("seq"), F.lit("b").alias("base")), taken).collect()}
    assert time.monotonic() - began < 20
    free = [n for n in range(2, 40_010) if n not in (3, 4, 39000)]
    assert got == {i: f"b{free[i]}" for i in range(40_000)}


def test_entity_upsert_keeps_what_is_there(spark):
    existing = spark.createDataFrame([("concept", "a", "stale", "2020-01-01", ["p0"], ["t"], "# A\n\nold  \n"), ("method", "m", "active", "2020-01-01", [], [], "body")], "kind string, slug string, status string, created string, sources array<string>, tags array<string>, body string")
    new = spark.createDataFrame([("concept", "a", 1, "p1", "A", ["t", "u"], "more"), ("open-problem", "o", 2, "p2", "O", [], "two"), ("open-problem", "o", 1, "p1", "O1", ["z"], "one")], "kind string, slug string, seq int, paper_id string, title string, tags array<string>, text string")
    got = {r.slug: r for r in merging.upsert_entities(existing, new, F.lit("2026-01-01")).collect()}
    assert (got["a"].status, got["a"].created, got["a"].updated, got["a"].sources, got["a"].tags) == ("stale", "2020-01-01", "2026-01-01", ["p0", "p1"], ["t", "u"])
    assert got["a"].body == "# A\n\nold\n\nFrom [[p1]]: more\n" and got["m"].body == "body" and got["m"].updated is None
    assert got["o"].status == "open" and got["o"].body.startswith("# O1\n\n## Definition\n\none\n") and got["o"].body.endswith("## Counter-Arguments and Gaps\n\nFrom [[p2]]: two\n")


def test_venue_plan_merges_and_skips(spark):
    schema = "slug string, name string, type string, venue_type string, created string, papers array<string>, tags array<string>"
    rows = [
        ("conf-2020", "Conf 2020", "venue", "conference", "2020-05-01T00", ["b"], ["t"]), ("conf-2021", "2021 Conf", "venue", "journal", "", ["a", "b"], None), ("fine", "Fine", "venue", None, None, None, None),
        ("y", "2022", "venue", None, None, None, None), ("z", "Zed", "paper", None, None, None, None), ("w", " ", "venue", None, None, None, None),
    ]
    pages = spark.createDataFrame(rows, schema)
    plan = venues.venue_plan(pages)
    g = plan.groups.collect()
    assert [(r.new_slug, r.venue_type, r.created, r.papers, r.tags, r.n_members) for r in g] == [("conf", "journal", "2020-05-01", ["a", "b"], ["t"], 2)]
    assert {(r.slug, r.skip_reason) for r in plan.skipped.collect()} == {("y", "name is empty after normalisation"), ("z", "type is not venue"), ("w", "missing name")}
    papers = spark.createDataFrame([("p1", "conf-2020", ["venue/conf-2020", "x"]), ("p2", None, ["x", "venue/conf-2021"]), ("p3", "fine", ["venue/fine"]), ("p4", "conf-2020", None)], "paper_id string, venue string, tags array<string>")
    moves = venues.paper_rewrites(papers, plan)
    assert {(r.paper_id, r.old_slug, r.new_slug) for r in moves.collect()} == {("p1", "conf-2020", "conf"), ("p2", "conf-2021", "conf"), ("p4", "conf-2020", "conf")}
    after = {r.paper_id: r for r in venues.rewritten_papers(papers, moves, F.lit("d")).collect()}
    assert after["p1"].tags == ["venue/conf", "x"] and after["p1"].venue == "conf" and after["p3"].venue == "fine"
    pages_after = {r.slug: r for r in venues.migrated_pages(pages, plan, F.lit("d")).collect()}
    assert set(pages_after) == {"conf", "fine", "y", "z", "w"} and pages_after["conf"].aliases == ["conf-2020", "conf-2021"]
    assert venues.plan_summary(plan, moves).first().asDict() == {"renamed": 0, "merged_into": 1, "merged_from": 2, "in_plan": 2, "skipped": 3, "unchanged": 1, "rewrites": 3, "near_duplicates": 0, "considered": 6}


def test_backlinks(spark):
    pages = spark.createDataFrame([("a.md", "Deep learning and DEEP LEARNING of attention maps"), ("b.md", "has [[deep-learning]] and deep learning"), ("c.md", "deeplearning, deep-learning"), ("d.md", "deep\nlearning")], "path string, text string")
    slugs = spark.createDataFrame([("deep-learning",), ("attention-maps",), ("attention",), ("learning-of",)], "slug string")
    got = {r.path: (r.text, r.inserted) for r in backlinks.insert_backlinks(pages, slugs).collect()}
    assert got == {"a.md": ("[[deep-learning]] and DEEP LEARNING of [[attention-maps]]".replace("LEARNING of", "[[learning-of]]"), ["attention-maps", "deep-learning", "learning-of"])}


def test_export(spark):
    papers = spark.createDataFrame([("b", "", ["field/x"], "2024-01-02"), ("a", "pid", ["field/x"], "bad"), ("c", None, ["project/q"], "2020-01-01")], "stem string, paper_id string, tags array<string>, created string")
    bibs = spark.createDataFrame([("b", " @misc{b, }\n% bib-incomplete: TRUE "), ("pid", "@misc{pid, }")], "paper_id string, bib string")
    entries = export.export_entries(papers, bibs, export.Selectors(field="x"))
    text = export.export_text(entries).first()
    assert text.text == "% pid\n@misc{pid, }\n\n% b\n@misc{b, }\n% bib-incomplete: TRUE\n\n" and (text.n_entries, text.n_issues) == (2, 1)
    assert [r.stem for r in export.export_entries(papers, bibs, export.Selectors(field="x", since="2023-01-01")).collect()] == ["b"]
    keyed = export.export_entries(papers, bibs, export.Selectors(keys=("c", " b ", "zz", "c"))).orderBy("pos").collect()
    assert [(r.stem, r.issue) for r in keyed] == [("c", "missing .bib file"), ("b", "bib-incomplete flag")]
    with pytest.raises(ValueError):
        export.Selectors()


def test_markdown_tree(spark, tmp_path):
    root = tmp_path / "corpus"
    files = {
        "wiki/papers/smith2020x.md": "---\ntype: paper\npaper-id: smith2020x\ntitle: A title\nyear: 2020\nauthors:\n- slug: s\n  name: Ann Smith\nidentifiers:\n  arxiv: 2312.10000\n  arxiv-version: v1\ntags: [field/ml, year/2020]\ncites: [gone2019]\nupdated: 2025-01-01\nnothing: null\n---\nsee [[deep-learning|DL]] and [[nowhere]]\n",
        "wiki/concepts/deep-learning.md": "---\r\ntype: concept\r\naliases: [dl]\r\ntags: field/ml\r\n---\r\nbody [[smith2020x]]\r\n",
        "wiki/index.md": "no header [[smith2020x]] [[lost]]",
        "wiki/bad.md": "---\n: : [\n---\nbody",
        "raw/extracts/smith2020x.md": "---\npaper-id: smith2020x\nextract-status: failed\nextracted-at: 2026-01-01T00:00:00Z\n---\nx",
        "raw/extracts/smith2020x.versions.yml": "versions:\n- version: v1\n- version: v2\n",
        "CLAUDE.md": "schema",
    }
    for name, body in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body.encode())
    raw = corpus.parsed_pages(corpus.read_text_tree(spark, str(root / "wiki")))
    assert [r.path for r in corpus.parse_errors(raw).collect()] == ["bad.md"]
    pages = corpus.page_columns(corpus.read_pages(spark, str(root)))
    rows = {r.stem: r for r in pages.collect()}
    assert set(rows) == {"smith2020x", "deep-learning", "index"}
    paper = rows["smith2020x"]
    assert (paper.identifiers["arxiv"], paper.arxiv_version, paper.authors, paper.tags, paper.cites) == ("2312.10000", "v1", ["Ann Smith"], ["field/ml", "year/2020"], ["gone2019"])
    assert "nothing" not in paper.keys and "title" in paper.keys and paper.updated == "2025-01-01"
    assert rows["deep-learning"].tags == ["field/ml"] and rows["deep-learning"].aliases == ["dl"]
    from scriptorium.operators.lint import lint

    extracted = corpus.parsed_pages(corpus.read_text_tree(spark, str(root / "raw"), "*.md"))
    none = extracted.where("false")
    found = corpus.extracts(extracted, none)
    assert [(r.paper_id, r.status) for r in found.collect()] == [("smith2020x", "failed")]
    assert corpus.needs_compile(found, pages).count() == 1 and corpus.unprocessed(found).count() == 1
    versions = corpus.manifests(corpus.read_text_tree(spark, str(root / "raw"), "*.yml"))
    assert [tuple(r) for r in versions.collect()] == [("smith2020x", "v2")]
    status = found.select("paper_id", "status", F.lit(None).cast("string").alias("parse_error"))
    index = pages.where("stem = 'index'").select(F.col("body").alias("text"))
    bibs = spark.createDataFrame([], "bib_file string, bib string")
    issues = {(r.tag, r.path) for r in lint(pages, bibs, status, versions, index, F.to_date(F.lit("2026-01-01"))).collect()}
    assert {("DEAD_LINK", "papers/smith2020x.md"), ("DEAD_LINK", "index.md"), ("INVALID_CITES", "papers/smith2020x.md"), ("EXTRACT_FAILED", "papers/smith2020x.md"), ("VERSION_DRIFT", "papers/smith2020x.md"), ("MISSING_SECTION", "concepts/deep-learning.md"), ("INDEX_DRIFT", "lost"), ("INDEX_DRIFT", "deep-learning")} <= issues
    assert not any(t == "ORPHAN" for t, _ in issues)
    assert corpus.file_hashes(spark, str(root / "raw")).count() == 2
    listing = spark.createDataFrame([("a/x/CLAUDE.md",), ("a/x/wiki/p.md",), ("b/CLAUDE.md",), ("a/x/y/CLAUDE.md",), ("a/x/y/wiki/q.md",)], "path string")
    roots = corpus.corpus_roots(listing)
    assert [r.root for r in roots.collect()] == ["a/x", "a/x/y"]
    near = corpus.enclosing_root(spark.createDataFrame([("a/x/y/z",), ("a/x",), ("c",)], "start string"), roots)
    assert {tuple(r) for r in near.collect()} == {("a/x/y/z", "a/x/y"), ("a/x", "a/x")}


def test_records(spark):
    payload = '{"data":[{"paperId":"1","title":"T","authors":[{"name":"A"}],"externalIds":{"DOI":"10.1/X"},"citationCount":3},{"paperId":"2"},{"title":"none"}]}'
    flat = records.search_results(spark.createDataFrame([(payload,)], "json string"))
    rows = flat.orderBy("pos").collect()
    assert (rows[0].doi, rows[0].authors, rows[1].title, rows[1].citationCount, rows[1].year) == ("10.1/X", ["A"], "", 0, None)
    new, counts = records.stubs(flat, spark.createDataFrame([("doi-10.1_x",)], "slug string"), F.lit("now"))
    assert counts.first().asDict() == {"written": 1, "existing": 1, "no_identifier": 1} and new.count() == 1
    nested = '{"data":[{"citedPaper":{"paperId":"1","citationCount":1}},{"citedPaper":null},{"citedPaper":{"paperId":"9","citationCount":7}}]}'
    refs = records.nested_results(spark.createDataFrame([(nested,)], "json string"), "citedPaper")
    rows, total = records.related(refs, flat.where("paperId <> ''"), flat.where("false"), 2)
    assert [r.paperId for r in rows.collect()] == ["9", "1"] and total.first().total_found == 3
    assert records.by_doi(flat, spark.createDataFrame([("10.1/x",)], "doi string")).count() == 1


def test_records_whose_slugs_collide_all_get_stubs(spark):
    """r50007 and r102831 share the eight digits of their hash (a pair found by trial)."""
    ids = ("r50007", "r102831")
    payload = [('{"data":[' + ",".join(f'{{"paperId":"{i}"}}' for i in (*ids, ids[0], "old")) + "]}",)]
    flat = records.search_results(spark.createDataFrame(payload, "json string"))
    url = "https://www.semanticscholar.org/paper/"
    slug = lambda i: "s2-" + hashlib.sha256(i.encode()).hexdigest()[:8]
    assert slug(ids[0]) == slug(ids[1])
    written = lambda *known: sorted(json.loads(r.header)["s2-paper-id"] for r in records.stubs(flat, spark.createDataFrame([(slug(i), url + i) for i in known], "slug string, url string"), F.lit("now"))[0].collect())
    assert written("old") == sorted(ids) and written(ids[0]) == sorted([ids[1], "old"])


def test_candidate_report(spark):
    schema = "seq int, paper_a string, paper_b string, type string, description string, quote_a string, quote_b string, relationship string"
    entries = spark.createDataFrame([(1, "a", "b", "contra-x", "d", "q", "r", "s"), (2, "a", "b", "contra-x", "again", "q", "r", "s"), (3, "a", "c", "t", "d", "q", "r", "s")], schema)
    none = spark.createDataFrame([], "paper_a string, paper_b string, type string")
    rendered = sinks.candidate_report(entries, none).orderBy("seq").collect()
    assert [r.seq for r in rendered] == [1, 3]
    keys = sinks.report_keys(spark.createDataFrame([("".join(r.entry for r in rendered),)], "text string"))
    assert sinks.candidate_report(entries, keys).count() == 0


def test_waves_and_status(spark):
    items = spark.createDataFrame([(f"k{i:03d}",) for i in range(25)], "key string").repartition(3)
    waved = waves.waves(items, "key", 10).orderBy("key").collect()
    assert [r.wave for r in waved] == [1] * 10 + [2] * 10 + [3] * 5
    old = spark.createDataFrame([("a", "pending", None, 0), ("b", "failed", "e", 1), ("c", "failed", "e", 2), ("d", "ok", None, 1)], "key string, status string, error string, attempts int")
    assert [r.key for r in waves.to_run(old).collect()] == ["a"] and [r.key for r in waves.to_run(old, retry=True).collect()] == ["b"]
    new = {r.key: tuple(r) for r in waves.updated_statuses(old, spark.createDataFrame([("b", "ok", None)], "key string, status string, error string")).collect()}
    assert new["b"][1:] == (2, "ok", None)[:0] or ("ok" in new["b"] and 2 in new["b"])
    states = spark.createDataFrame([("pending", "in-progress"), ("skipped", "ok"), ("ok", "failed"), ("in-progress", "failed")], "a string, b string")
    assert [r[0] for r in states.select(waves.valid_transition(F.col("a"), F.col("b"))).collect()] == [True, False, False, True]


def test_source_stream(spark, tmp_path):
    folder, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    folder.mkdir()
    (folder / "a.md").write_text("one")
    (folder / "b.md").write_text("one")
    seen = lambda: spark.read.parquet(out) if (tmp_path / "out").exists() else spark.createDataFrame([], "sha256 string")
    handle = lambda batch, _: waves.new_sources(batch, seen()).select("sha256", "path").write.mode("append").parquet(out)
    waves.watch_sources(spark, str(folder), handle, check).awaitTermination()
    assert seen().count() == 1
    (folder / "c.md").write_text("one")
    (folder / "d.md").write_text("two")
    waves.watch_sources(spark, str(folder), handle, check).awaitTermination()
    assert sorted(r.path.rsplit("/", 1)[-1] for r in seen().collect()) == ["a.md", "d.md"]


def test_cited_counts(spark):
    edges = spark.createDataFrame([(1, 2), (1, 2), (3, 2)], "src long, dst long")
    assert links.cited_counts(edges).first().n_citing == 2


def test_command_line(spark, tmp_path, capsys):
    from scriptorium.__main__ import main

    root = tmp_path / "c"
    files = {
        "wiki/papers/lee2020t.md": "---\ntype: paper\npaper-id: lee2020t\ntags: [field/x]\nbib-file: raw/bib/lee2020t.bib\nidentifiers: {doi: 10.1/ABC}\n---\n[[gone]]\n",
        "wiki/venues/conf-2020.md": "---\ntype: venue\nname: Conf 2020\n---\n",
        "wiki/venues/bad.md": "---\ntype: venue\n---\n",
        "wiki/concepts/broken.md": "---\na: [\n---\n",
        "wiki/papers/two.md": "---\ntype: paper\n---\n",
        "raw/extracts/two.md": "---\nb: {\n---\n",
        "raw/bib/lee2020t.bib": "@misc{lee2020t, }\n",
    }
    for name, body in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    out = lambda *a: (main(list(a)), capsys.readouterr().out)
    code, text = out("lint", str(root), "--today", "2026-01-01")
    assert code == 0 and "DEAD_LINK: papers/lee2020t.md:1 gone" in text and "MISSING_BIBTEX" not in text and text.endswith("issue(s)\n")
    assert "PARSE_ERROR: concepts/broken.md " in text and "EXTRACT_PARSE_ERROR: papers/two.md two" in text
    assert "EXTRACT_MISSING: papers/lee2020t.md" in text and "EXTRACT_MISSING: papers/two.md" not in text
    assert out("export", str(root), "--field", "x") == (0, "% lee2020t\n@misc{lee2020t, }\n\n")
    assert out("export", str(root), "--field", "y")[0] == 1 and out("export", str(root))[0] == 2
    assert out("plan-venues", str(root)) == (0, "conf-2020 -> conf\nskipped bad: missing name\n")
    assert out("find-paper", str(root), "doi", "10.1/abc") == (0, '{"paper-id": "lee2020t"}\n')
    assert out("paper-id", "García", "2024", "Survey of X") == (0, "garcia2024survey\n")
    assert out("hash", str(root / "raw"))[1].count("\n") == 2


def test_scaffold_and_snapshot(spark, tmp_path):
    made = sinks.scaffold(spark, str(tmp_path / "new"))
    assert len(made) == 10 and spark.read.parquet(made[0]).count() == 0
    sinks.append_log(spark, made[-1], "ingest", "x", "2026-01-01")
    sinks.scaffold(spark, str(tmp_path / "new"))
    assert spark.read.parquet(made[-1]).count() == 1 and sinks.log_line("a", "b", "d") == "## [d] a | b"
    pages = spark.createDataFrame([("wiki/papers/b.md", "papers"), ("wiki/venues/a.md", "venues"), ("wiki/authors/c.md", "authors"), ("wiki/papers/a.md", "papers")], "path string, folder string")
    targets = corpus.backlink_targets(pages)
    assert [r.path for r in targets.collect()] == ["wiki/papers/a.md", "wiki/papers/b.md", "wiki/venues/a.md"]
    sinks.snapshot(targets, str(tmp_path / "snap"))
    assert spark.read.parquet(str(tmp_path / "snap")).count() == 3


def test_references_equal_brute_force(spark):
    import random

    from scriptorium.functions.similarity import token_set
    from scriptorium.operators import matching

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeinorst") for _ in range(rng.randint(2, 8)))
    vocabulary = [word() for _ in range(60)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 14))) for _ in range(90)]
    typo = lambda w: w if len(w) < 5 else w[: (at := rng.randrange(len(w)))] + "z" + w[at + 1 :]
    asked = [" ".join(map(typo, t.split())) for t in texts[:25]] + [t + " " + word() for t in texts[25:45]] + [" ".join(t.split()[:3]) for t in texts[45:60]] + ["singleton", ""]
    texts += ["singletons", "", "the " * 90]
    refs = spark.createDataFrame(list(enumerate(asked)), "ref_id long, text string")
    cands = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "key long, text string, pos long")
    got = sorted((r.ref_id, r["rank"], r.candidate, round(r.score, 9)) for r in matching.reference_matches(refs, cands, 0.8, 5).collect())
    want = []
    for i, a in enumerate(asked):
        found = sorted((-s, j) for j, b in enumerate(texts) if (s := 1.0 if not a or not b else token_set(a, b)) >= 0.8)[:5]
        want += [(i, r, j, round(-s, 9)) for r, (s, j) in enumerate(found, 1)]
    assert got == sorted(want) and len(want) > 30


def test_near_duplicate_keys_equal_brute_force(spark):
    """Keys of one to 40 characters with up to five edits, among keys of one word and of several."""
    rng, keys = random.Random(6), {"workshop", "x-workshop", "workshops", "Zürich-tagung-für-netze", "Zurich-tagung-für-netze", "日本語-学会", "日本-学会"}
    for n in [1, 2, 5, 7, 8, 12, 13, 16, 18, 19, 24, 25, 31, 32, 37, 40] * 3:
        base = "".join(rng.choice("ab01-" if n % 2 else "0123456789abcdef") for _ in range(n))
        keys.add(base)
        for edits in (1, 1, 1, 2, 2, 3, 3, 4, 5):
            key = list(base)
            for _ in range(edits):
                at = rng.randrange(len(key) + 1)
                key[at : at + rng.randrange(2)] = rng.choice(["", "b", "1"])
            keys.add("".join(key))
    got = {(r.a, r.b): r.similarity for r in matching.near_duplicate_keys(spark.createDataFrame([(k,) for k in keys], "key string")).collect()}
    tail = lambda k: k.rsplit("-", 1)[-1]
    ratio = {(a, b): SequenceMatcher(None, a.replace("-", " "), b.replace("-", " ")).ratio() for a in keys for b in keys if a < b}
    assert got == {(a, b): r for (a, b), r in ratio.items() if r >= 0.92 or (tail(a) and tail(a) == tail(b) and r >= 0.8)}


def test_near_duplicate_keys_move_few_rows(spark):
    """Keys of 32 characters: nine places and five segments each, since what is before a segment fixes its place."""
    own = spark.range(500).select(F.md5(F.col("id").cast("string").cast("binary")).alias("key"))
    own = own.select("key", F.col("key").alias("text"), F.length("key").alias("size"), F.col("key").alias("tail"))
    places, segments = matching._segments(own, own.select("size").distinct(), 0.92)
    assert places.count() == 500 * 9 and segments.count() == 500 * 5
    lint_keys = own.select(F.concat(F.lit("p"), F.substring("key", 1, 6)).alias("key")).select("key", F.col("key").alias("text"), F.length("key").alias("size"), F.col("key").alias("tail"))
    assert matching._segments(lint_keys, lint_keys.select("size").distinct(), 0.92)[1].count() == 0  # short keys meet with a character taken out


@pytest.mark.parametrize("rare", [0, 40, 10_000])
def test_near_duplicate_keys_in_rounds_lose_no_pair(spark, monkeypatch, rare):
    """Few rows at a time on the disk, and no, some or all lengths rare, give the pairs of brute force."""
    monkeypatch.setattr(matching, "ROUND_ROWS", 900)
    monkeypatch.setattr(matching, "RARE_KEYS", rare)
    written, store = [], matching.stored
    monkeypatch.setattr(matching, "stored", lambda df: written.append(1) or store(df))
    rng, keys = random.Random(9), set()
    for n in [30] * 14 + [32] * 14 + [35, 39]:
        base = "".join(rng.choice("0123456789abcdef") for _ in range(n))
        keys.add(base)
        for edits in (1, 2, 3):
            key = list(base)
            for _ in range(edits):
                at = rng.randrange(len(key))
                key[at : at + rng.randrange(2)] = rng.choice(["", "b", "1"])
            keys.add("".join(key))
    got = {(r.a, r.b) for r in matching.near_duplicate_keys(spark.createDataFrame([(k,) for k in keys], "key string")).collect()}
    want = {(a, b) for a in keys for b in keys if a < b and SequenceMatcher(None, a, b).ratio() >= 0.92}
    assert got == want and len(want) > 60 and (len(written) > 3) == (rare < 10_000)


def test_stored_rows_leave_no_shuffle_on_the_disk(spark):
    blocks = lambda: {str(b) for b in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ").split() if b.startswith("shuffle_")}
    before, setting = blocks(), spark.conf.get(FREED, None)
    kept = stored(spark.range(5000).groupBy((F.col("id") % 700).alias("k")).agg(F.count("*").alias("n")))
    assert not blocks() - before and spark.conf.get(FREED, None) == setting
    assert kept.count() == 700 and kept.columns == ["k", "n"]
