"""All lint rules over a small corpus against a plain re-statement of them."""

import datetime
import random
import re
from collections import Counter
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from scriptorium.operators import backlinks, lint
from scriptorium.plans.catalogue import QUERIES

TODAY = datetime.date(2026, 1, 1)
PAGE = (
    "path string, stem string, body string, type string, status string, title string, updated string, tags array<string>, aliases array<string>, cites array<string>, "
    "bib_file string, paper_id string, arxiv_version string, keys array<string>"
)


def corpus(seed=1, n=90):
    rng = random.Random(seed)
    kinds = ["paper", "concept", "method", "open-problem", "venue", "claim", "odd", None]
    stems = [f"{rng.choice(['deep', 'graph', 'soil'])}-{rng.choice(['maps', 'nets', 'nots'])}-{i}" for i in range(n)] + ["index", "log", "journal-of-trees", "journal-of-treez"]
    names = stems + ["alias-a", "alias-b", "nowhere", "lost page"]
    pages = []
    for i, stem in enumerate(stems):
        kind = "venue" if stem.startswith("journal") else rng.choice(kinds)
        links = [f"[[{rng.choice(names)}{rng.choice(['', '|label'])}]]" for _ in range(rng.randint(0, 4))]
        lines = [f"text {x}" for x in links] + rng.choice([[], ["## Counter-arguments and gaps"], ["> [!WARNING] Contradiction here", "> [!warning]  contradiction"]])
        rng.shuffle(lines)
        keys = rng.sample(sorted({k for v in lint.REQUIRED.values() for k in v}), 14)
        day = rng.choice([None, "2025-12-01", "2025-9-1", "2025-01-01", "bad", "2024-02-30"])
        pages.append((f"wiki/{kind}/{stem}.md", stem, "\n".join(lines), kind, rng.choice(["stale", "active", None]), stem, day, rng.choice([None, [], ["field/x"], ["method/y"]]), rng.choice([None, ["alias-a"], ["alias-b", "other"]]), rng.choice([None, [rng.choice(names)]]), rng.choice([None, "", f"b{i % 9}"]), rng.choice([None, f"p{i}"]), rng.choice([None, "v1", ""]), keys))
    bibs = [(f"b{i}", "@a{x, }" + ("\n% bib-incomplete: TRUE" if i % 2 else "")) for i in range(6)]
    extracts = [(f"p{i}", rng.choice(["failed", "complete"]), rng.choice([None, None, "bad"])) for i in range(0, n, 2)]
    versions = [(f"p{i}", rng.choice(["v1", "v2", ""])) for i in range(0, n, 3)]
    return pages, bibs, extracts, versions


def plain(pages, bibs, extracts, versions, index, errors):
    out = []
    stems = {p[1] for p in pages}
    alias = {}
    for path, stem, *_, aliases in sorted((p[0], p[1], p[8]) for p in pages):
        for a in aliases or []:
            alias[a] = stem
    linked = set()
    for path, stem, body, *_ in pages:
        for n, line in enumerate(body.split("\n"), 1):
            for target in re.findall(r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]", line):
                if target in stems:
                    linked.add(target)
                elif target in alias:
                    linked.add(alias[target])
                    out.append(("ALIAS_LINK", path, n, f"{target} -> {alias[target]}"))
                else:
                    out.append(("DEAD_LINK", path, n, target))
    own = [p for p in pages if p[1] not in ("index", "log")]
    for path, stem, body, kind, status, _, day, tags, _, cites, bib, paper_id, version, keys in own:
        out += [("MISSING_FIELD", path, None, k) for k in lint.REQUIRED.get(kind, []) if k not in keys]
        if stem not in linked:
            out.append(("ORPHAN", path, None, ""))
        if kind in lint.FIELD_TAGGED and not any(t.startswith("field/") for t in tags or []):
            out.append(("MISSING_FIELD_TAG", path, None, ""))
        try:
            age = (TODAY - datetime.date(*map(int, day.split("-")))).days if day else None
        except ValueError:
            age = None
        if status == "stale" and age is not None and age > 90:
            out.append(("STALE", path, None, f"status stale for {age} days"))
        if kind in ("concept", "method") and age is not None and age > 180:
            out.append(("STALE", path, None, f"untouched for {age} days"))
        if kind in ("concept", "method") and not re.search(r"(?im)^##\s+counter.?arguments", body):
            out.append(("MISSING_SECTION", path, None, ""))
        out += [("CONTRADICTION", path, None, "")] * len(re.findall(r"(?i)>\s*\[!WARNING\]\s*Contradiction", body))
        if kind != "paper":
            continue
        out += [("INVALID_CITES", path, None, c) for c in cites or [] if c not in stems]
        if bib:
            found = dict(bibs).get(bib)
            if found is None or "bib-incomplete" in found:
                out.append(("MISSING_BIBTEX", path, None, f"expected {bib}" if found is None else "bib-incomplete flag"))
        name = paper_id or stem
        extract = {e[0]: e for e in extracts}.get(name)
        tag = "EXTRACT_MISSING" if extract is None else "EXTRACT_PARSE_ERROR" if extract[2] else "EXTRACT_FAILED" if extract[1] == "failed" else None
        if tag:
            out.append((tag, path, None, name))
        latest = dict(versions).get(name)
        if latest and version and latest != version:
            out.append(("VERSION_DRIFT", path, None, f"{version} -> {latest}"))
    listed = set(re.findall(r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]", index))
    out += [("INDEX_DRIFT", t, None, "no page") for t in listed - stems - set(alias)] + [("INDEX_DRIFT", p[1], None, "not in index") for p in own if p[1] not in listed]
    venues = sorted(p[1] for p in own if p[3] == "venue")
    for i, a in enumerate(venues):
        for b in venues[i + 1 :]:
            ratio = SequenceMatcher(None, a.replace("-", " "), b.replace("-", " ")).ratio()
            if ratio >= 0.92 or (a.rsplit("-")[-1] == b.rsplit("-")[-1] and ratio >= 0.8):
                out.append(("VENUE_NEAR_DUPLICATE", a, None, f"{b} {ratio:.2f}"))
    return out + [("PARSE_ERROR", path, None, why) for path, why in errors]


def test_every_rule_equals_its_plain_form(spark):
    pages, bibs, extracts, versions = corpus()
    index = "\n".join(f"- [[{p[1]}]]" for p in pages[::2]) + "\n- [[missing page|x]] [[alias-a]]"
    errors = [("wiki/bad.md", "no mapping")]
    make = spark.createDataFrame
    got = lint.lint(
        make(pages, PAGE), make(bibs, "bib_file string, bib string"), make(extracts, "paper_id string, status string, parse_error string"), make(versions, "paper_id string, latest string"),
        make([(index,)], "text string"), F.lit(TODAY), make(errors, "path string, error string"),
    ).collect()
    want = Counter(plain(pages, bibs, extracts, versions, index, errors))
    assert Counter((r.tag, r.path, r.line, r.detail) for r in got) == want
    assert {t for t, *_ in want} >= {"DEAD_LINK", "ALIAS_LINK", "MISSING_FIELD", "ORPHAN", "MISSING_FIELD_TAG", "STALE", "MISSING_SECTION", "CONTRADICTION", "INVALID_CITES", "MISSING_BIBTEX", "EXTRACT_MISSING", "EXTRACT_PARSE_ERROR", "EXTRACT_FAILED", "INDEX_DRIFT", "VENUE_NEAR_DUPLICATE", "PARSE_ERROR"}


def test_the_backlink_query_equals_a_fold_over_all_slugs(spark):
    parts = spark.read.parquet("/root/testdata/sf0.001/part.parquet").select("p_partkey", "p_name").collect()
    slugs = sorted({re.sub("[^a-z0-9]+", "-", r.p_name.lower()).strip("-") for r in parts})
    want = {}
    for r in parts:
        text = f"A {r.p_name} beside a {r.p_name}"
        made, done = backlinks.linked_text(text, slugs)
        if done:
            want[f"p{r.p_partkey}"] = (made, ",".join(done))
    got = {r.path: (r.text, r.inserted) for r in QUERIES["backlink_insert"](spark, "/root/testdata/sf0.001").collect()}
    assert got == want and len(want) > 50
