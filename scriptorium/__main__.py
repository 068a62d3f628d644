"""Command line: ``python -m scriptorium COMMAND ...`` over a corpus of Markdown files.

lint ROOT [--today DAY]                issues of all rules, then their number
export ROOT --field F | --tag T | ...  a consolidated bibliography on standard output
plan-venues ROOT                       what a venue migration would rename and merge
migrate-venues ROOT [--apply]          write the migration's report and, with --apply, its files
find-paper ROOT KIND VALUE             the page that has an identifier, or null
paper-id LAST_NAME YEAR TITLE          the id of a paper
hash PATH                              content hashes of the files under a folder
"""

from __future__ import annotations

import argparse
import datetime
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.text import paper_id
from scriptorium.operators import export, lint, matching, migration, venues
from scriptorium.session import cut_lineage, session
from scriptorium.sources import corpus, sinks


def _bibs(spark: SparkSession, root: str) -> DataFrame:
    raw = _tree(spark, f"{root}/raw/bib", "*.bib")
    return raw.select(F.regexp_extract("path", r"([^/]+)\.bib$", 1).alias("paper_id"), F.concat(F.lit("raw/bib/"), "path").alias("bib_file"), F.col("raw").alias("bib"))


def _tree(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """A text tree, empty where the folder is missing."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "path string, raw string")
    return corpus.read_text_tree(spark, folder, glob)


def run_lint(spark: SparkSession, root: str, today: str) -> int:
    parsed = corpus.parsed_pages(_tree(spark, f"{root}/wiki", "*.md"))
    pages = corpus.page_columns(corpus.one_page_a_stem(parsed))
    found = corpus.extract_states(corpus.parsed_pages(_tree(spark, f"{root}/raw/extracts", "*.md")))
    versions = corpus.manifests(_tree(spark, f"{root}/raw/extracts", "*.yml"))
    index = pages.where("stem = 'index'").select(F.col("body").alias("text"))
    issues = lint.lint(pages, _bibs(spark, root), found, versions, index, F.to_date(F.lit(today)), corpus.parse_errors(parsed))
    lines = issues.select(F.concat_ws(" ", F.concat("tag", F.lit(":")), F.concat_ws(":", "path", "line"), "detail").alias("text")).orderBy("text")
    n = 0
    for row in lines.toLocalIterator():
        print(row["text"])
        n += 1
    print(f"{n} issue(s)")
    return 0


def run_export(spark: SparkSession, args: argparse.Namespace) -> int:
    try:
        by = export.Selectors(args.project, args.field, args.tag, args.since, None, tuple(k for k in (args.keys or "").split(",") if k.strip()))
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    pages = corpus.page_columns(corpus.read_pages(spark, args.root)).where("type = 'paper'").select("stem", "paper_id", "tags", "created")
    result = export.export_text(export.export_entries(pages, _bibs(spark, args.root).select("paper_id", "bib"), by)).first()
    if not result["n_entries"]:
        print("nothing to export", file=sys.stderr)
        return 1
    print(result["text"], end="")
    return 0


def run_migration(spark: SparkSession, root: str, today: str, apply: bool) -> int:
    """The report goes to ``outputs/reports``; without ``apply`` no page changes."""
    read = corpus.read_pages(spark, root)
    own = read.select("path", "header").join(corpus.page_columns(read), "path").withColumn("slug", F.coalesce("slug", "stem"))
    found, papers = own.where("path LIKE 'venues/%'"), own.where("path LIKE 'papers/%'").withColumn("paper_id", F.col("stem"))
    plan = venues.venue_plan(found.select("slug", "name", "type", "venue_type", "created", "papers", "tags"))
    moves = cut_lineage(venues.paper_rewrites(papers, plan))
    day = F.lit(today)
    report = "\n".join(r["text"] for r in migration.report_parts(plan, found, moves, day).toLocalIterator()) + "\n"
    name = f"outputs/reports/{today}-venue-migration.md"
    sinks.write_files(spark.createDataFrame([(name, report)], "path string, raw string"), root)
    print(f"{root}/{name}")
    if apply:
        n = sinks.write_files(migration.migrated_files(found, papers, plan, moves, day), f"{root}/wiki")
        print(f"{n} file(s) written or removed")
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="scriptorium", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("lint")
    one.add_argument("root")
    one.add_argument("--today", default=datetime.date.today().isoformat())
    one = commands.add_parser("export")
    one.add_argument("root")
    for name in ("project", "field", "tag", "since", "keys"):
        one.add_argument(f"--{name}")
    commands.add_parser("plan-venues").add_argument("root")
    one = commands.add_parser("migrate-venues")
    one.add_argument("root")
    one.add_argument("--apply", action="store_true")
    one.add_argument("--today", default=datetime.date.today().isoformat())
    one = commands.add_parser("find-paper")
    for name in ("root", "kind", "value"):
        one.add_argument(name)
    one = commands.add_parser("paper-id")
    one.add_argument("last_name")
    one.add_argument("year", type=int)
    one.add_argument("title")
    commands.add_parser("hash").add_argument("root")
    args = parser.parse_args(argv)
    spark = SparkSession.getActiveSession() or session()
    if args.command == "lint":
        return run_lint(spark, args.root, args.today)
    if args.command == "export":
        return run_export(spark, args)
    if args.command == "migrate-venues":
        return run_migration(spark, args.root, args.today, args.apply)
    if args.command == "plan-venues":
        pages = corpus.page_columns(corpus.read_pages(spark, args.root)).where("path LIKE 'venues/%'")
        pages = pages.select(F.coalesce("slug", "stem").alias("slug"), "name", "type", "venue_type", "created", "papers", "tags")
        plan = venues.venue_plan(pages)
        for row in plan.members.orderBy("new_slug", "slug").toLocalIterator():
            print(f"{row['slug']} -> {row['new_slug']}")
        for row in plan.skipped.orderBy("slug").toLocalIterator():
            print(f"skipped {row['slug']}: {row['skip_reason']}")
    elif args.command == "find-paper":
        pages = corpus.page_columns(corpus.read_pages(spark, args.root)).where("type = 'paper'")
        existing = pages.select(F.coalesce("paper_id", "stem").alias("key"), "identifiers").where("identifiers IS NOT NULL")
        incoming = spark.range(1).select(F.lit("in").alias("key"), F.create_map(F.lit(args.kind), F.lit(args.value)).alias("identifiers"))
        found = matching.identifier_matches(incoming, existing).first()
        print(json.dumps({"paper-id": found["match"] if found else None}))
    elif args.command == "paper-id":
        row = spark.createDataFrame([(args.last_name, args.year, args.title)], "n string, y int, t string")
        print(row.select(paper_id(F.col("n"), F.col("y"), F.col("t"))).first()[0])
    else:
        for row in corpus.file_hashes(spark, args.root).orderBy("path").toLocalIterator():
            print(row["sha256"], row["path"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
