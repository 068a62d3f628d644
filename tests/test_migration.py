"""Venue migration over files: a dry run, then its application."""

from __future__ import annotations

from scriptorium.__main__ import main
from scriptorium.operators.migration import header_text


def test_header_keeps_order_and_dates():
    assert header_text('{"b": "2024-01-02", "a": ["x"]}', '{"a": [], "c": "é"}') == "b: 2024-01-02\na: []\nc: é\n"
    assert header_text(None, None) == ""


def test_migration(spark, tmp_path, capsys):
    def put(path, text):
        file = tmp_path / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)

    head = "---\ntype: venue\nname: {}\nslug: {}\nvenue-type: {}\ncreated: {}\npapers: [{}]\ntags: [{}]\naliases: [{}]\n---\n{}"
    put("wiki/venues/2019-icc.md", head.format("2019 Big Conference on Things", "2019-icc", "conference", "2024-02-01", "p1", "field/a", "old-icc", "first body\n\n"))
    put("wiki/venues/2020-icc.md", head.format("2020 Big Conference on Things", "2020-icc", "conference", "2024-01-01", "p2", "field/b", "", "second body\n"))
    put("wiki/venues/wrong.md", head.format("Letters of Science", "wrong", "journal", "2024-01-01", "p3", "", "", "kept body\n"))
    put("wiki/papers/p1.md", "---\ntype: paper\ntitle: T\nvenue: 2019-icc\ntags: [field/a, venue/2019-icc]\n---\ntext\n")
    put("wiki/papers/p9.md", "---\ntype: paper\ntitle: U\n---\nother\n")
    before = {p: p.read_text() for p in tmp_path.rglob("wiki/**/*.md")}
    assert main(["migrate-venues", str(tmp_path), "--today", "2026-01-05"]) == 0
    report = (tmp_path / "outputs/reports/2026-01-05-venue-migration.md").read_text()
    assert "- 3 venue pages considered (0 no-op, 3 in plan, 0 skipped)" in report and "- 2 pages merge into 1 canonical page" in report
    assert "- `wrong` → `letters-of-science`" in report and "## Paper-page rewrites\n- `p1.md`: `venue: 2019-icc`" in report and "## Skipped" not in report
    assert {p: p.read_text() for p in tmp_path.rglob("wiki/**/*.md")} == before
    assert main(["migrate-venues", str(tmp_path), "--today", "2026-01-05", "--apply"]) == 0
    there = sorted(p.name for p in (tmp_path / "wiki/venues").glob("*.md"))
    assert there == ["big-conference-on-things.md", "letters-of-science.md"]
    merged = (tmp_path / "wiki/venues/big-conference-on-things.md").read_text()
    assert "created: 2024-01-01\nupdated: 2026-01-05\npapers:\n- p1\n- p2\ntags:\n- field/a\n- field/b\naliases:\n- old-icc\n- 2019-icc\n- 2020-icc\n" in merged
    assert merged.index("### `2019-icc`") < merged.index("first body") < merged.index("### `2020-icc`") < merged.index("second body")
    renamed = (tmp_path / "wiki/venues/letters-of-science.md").read_text()
    assert renamed.endswith("aliases:\n- wrong\nupdated: 2026-01-05\n---\nkept body\n") and "created: 2024-01-01" in renamed
    paper = (tmp_path / "wiki/papers/p1.md").read_text()
    assert paper == "---\ntype: paper\ntitle: T\nvenue: big-conference-on-things\ntags:\n- field/a\n- venue/big-conference-on-things\nupdated: 2026-01-05\n---\ntext\n"
    assert (tmp_path / "wiki/papers/p9.md").read_text() == before[tmp_path / "wiki/papers/p9.md"]
