"""Sinks: tables by atomic commits, and text only where text is the product."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.text import candidate_entry
from scriptorium.session import cut_lineage

CANDIDATE_KEY = ["paper_a", "paper_b", "type"]


def write_table(rows: DataFrame, path: str, mode: str = "overwrite", by: tuple[str, ...] = ()) -> None:
    """Parquet, partitioned by low-cardinality columns such as the page kind."""
    writer = rows.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def append_new(rows: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """Rows to append: one a key, without the keys that are there."""
    return rows.dropDuplicates(key).join(existing.select(*key), key, "left_anti")


def candidate_report(entries: DataFrame, existing: DataFrame) -> DataFrame:
    """New report entries rendered; ``seq`` keeps their order and the first of a key stays."""
    first = entries.groupBy(*CANDIDATE_KEY).agg(F.min_by(F.struct(*[c for c in entries.columns if c not in CANDIDATE_KEY]), "seq").alias("e"))
    new = first.join(existing.select(*CANDIDATE_KEY), CANDIDATE_KEY, "left_anti").select(*CANDIDATE_KEY, "e.*")
    return new.select("seq", *CANDIDATE_KEY, candidate_entry(F.struct(*[F.col(c) for c in new.columns])).alias("entry"))


def report_keys(text: DataFrame) -> DataFrame:
    """Keys of entries in report text (``text`` column)."""
    part = lambda pattern: F.regexp_extract_all("text", F.lit(pattern), F.lit(1))
    types, a, b = part(r"- \*\*Type:\*\* ([\w-]+)"), part(r"- \*\*Paper A:\*\* \[\[([^\]]+)\]\]"), part(r"- \*\*Paper B:\*\* \[\[([^\]]+)\]\]")
    return text.select(F.explode(F.arrays_zip(types.alias("type"), a.alias("paper_a"), b.alias("paper_b"))).alias("k")).select("k.paper_a", "k.paper_b", "k.type")


def index_page(papers: DataFrame) -> DataFrame:
    """``(field, links)``: links of each field tag's papers in order; papers without one are uncategorised."""
    tags = F.filter("tags", lambda t: t.startswith("field/"))
    fields = F.when(F.size(tags) > 0, F.transform(tags, lambda t: F.substring(t, 7, 1 << 20))).otherwise(F.array(F.lit("Uncategorized")))
    each = papers.select(F.explode(F.array_distinct(fields)).alias("field"), "stem")
    return each.groupBy("field").agg(F.array_join(F.transform(F.array_sort(F.collect_set("stem")), lambda s: F.concat(F.lit("- [["), s, F.lit("]]"))), "\n").alias("links"))


def log_line(operation: str, subject: str, today: str) -> str:
    return f"## [{today}] {operation} | {subject}"


def append_log(spark: SparkSession, path: str, operation: str, subject: str, today: str) -> None:
    spark.createDataFrame([(today, operation, subject)], "day string, op string, subject string").write.mode("append").parquet(path)


# Page folders of a corpus (fixed values).
FOLDERS = ("papers", "concepts", "methods", "open-problems", "results", "claims", "authors", "venues", "queries")
PAGE_SCHEMA = "stem string, path string, header string, body string, updated date"
LOG_SCHEMA = "day string, op string, subject string"


def scaffold(spark: SparkSession, root: str) -> list[str]:
    """Empty tables of a new corpus, one a page folder, and its log; tables that are there stay."""
    made = []
    for name, schema in (*((f, PAGE_SCHEMA) for f in FOLDERS), ("log", LOG_SCHEMA)):
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{root}/{name}")
        made.append(f"{root}/{name}")
    return made


def snapshot(pages: DataFrame, path: str) -> None:
    """Keep the paths of the pages that a batch starts from."""
    pages.select("path").write.mode("overwrite").parquet(path)


def papers_by_year(papers: DataFrame) -> DataFrame:
    """Papers, latest year first, then by key."""
    return papers.select("year", "stem", "title").orderBy(F.desc_nulls_last("year"), "stem")


def write_files(rows: DataFrame, root: str) -> int:
    """Write ``(path, raw)`` rows as files under ``root`` and remove those whose ``raw`` is null; how many.

    Rows are fixed first, since they may derive from the files that change, and come to the
    driver one partition at a time. Files are written before any is removed.
    """
    spark = rows.sparkSession
    fixed, n = cut_lineage(rows.select("path", "raw")), 0
    folder = spark._jvm.org.apache.hadoop.fs.Path
    files = folder(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for row in fixed.where("raw IS NOT NULL").toLocalIterator():
        out = files.create(folder(f"{root}/{row['path']}"), True)
        out.write(bytearray(row["raw"].encode()))
        out.close()
        n += 1
    for row in fixed.where("raw IS NULL").toLocalIterator():
        files.delete(folder(f"{root}/{row['path']}"), False)
        n += 1
    return n
