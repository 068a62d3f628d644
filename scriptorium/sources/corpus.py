"""Markdown corpora as tables: whole-text scans, headers, extracts, manifests, hashes.

A header is the YAML between the leading ``---`` lines. It is parsed once, in Arrow batches,
to JSON text in which identifiers stay strings; typed columns come from that natively.
"""

from __future__ import annotations

import datetime
import json
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = r"(?s)^---\s*\n(.*?)\n?---\s*\n?(.*)$"

#: Folders whose pages can take backlinks, in scan order (fixed values).
TARGET_FOLDERS = ("papers", "concepts", "methods", "open-problems", "venues")

_STRINGS = re.compile(r"""^(\s*(?:- )?(?:arxiv|arxiv-version|doi|paper-id|version|source-sha)\s*:\s*)(?!["'\[{|>])(\S[^#\n]*?)\s*(\s#.*)?$""", re.MULTILINE)


def header_json(text: str | None) -> tuple[str | None, str | None]:
    """(JSON, error) of YAML header text; identifiers are kept as written."""
    import yaml

    if text is None or not text.strip():
        return "{}", None
    quoted = _STRINGS.sub(lambda m: m[1] + (m[2] if m[2] in ("null", "~") else json.dumps(m[2], ensure_ascii=False)) + (m[3] or ""), text)
    try:
        found = yaml.safe_load(quoted)
    except yaml.YAMLError as e:
        return None, str(e).split("\n")[0]
    if found is None:
        return "{}", None
    if not isinstance(found, dict):
        return None, "header is no mapping"
    plain = lambda x: x.isoformat() if isinstance(x, (datetime.date, datetime.datetime)) else str(x)
    return json.dumps({str(k): v for k, v in found.items()}, ensure_ascii=False, default=plain), None


def _headers(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([header_json(t) for t in texts], columns=["header", "error"])


def parse_header(yaml: Column) -> Column:
    """``struct(header, error)``: JSON of YAML text, or why there is none."""
    return F.pandas_udf(_headers, "header string, error string")(yaml)


def split_header(raw: Column) -> Column:
    """``struct(yaml, body)``; text without a header is all body. Line ends become ``\\n`` first."""
    text = F.regexp_replace(raw, "\r\n?", "\n")
    has = text.rlike(HEADER)
    return F.when(has, F.struct(F.regexp_extract(text, HEADER, 1).alias("yaml"), F.regexp_extract(text, HEADER, 2).alias("body"))).otherwise(F.struct(F.lit("").alias("yaml"), text.alias("body")))


def parsed_pages(raw: DataFrame) -> DataFrame:
    """``(path, stem, folder, raw, header, error, body)`` from ``(path, raw)`` rows."""
    split = raw.withColumn("_s", split_header(F.col("raw")))
    parsed = split.withColumn("_h", parse_header(F.col("_s.yaml")))
    return parsed.select(
        "path", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("stem"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"), "raw", F.col("_h.header").alias("header"), F.col("_h.error").alias("error"), F.col("_s.body").alias("body")
    )


def read_text_tree(spark: SparkSession, root: str, glob: str = "*.md") -> DataFrame:
    """``(path, raw)`` of all files under ``root``; paths are relative to it."""
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    base = root.rstrip("/").split("://")[-1].split("/")[-1]
    relative = F.regexp_extract(F.col("_metadata.file_path"), "/" + re.escape(base) + "/(.*)$", 1)
    return files.select(F.url_decode(F.replace(relative, F.lit("+"), F.lit("%2B"))).alias("path"), F.col("value").alias("raw"))


def read_pages(spark: SparkSession, root: str) -> DataFrame:
    """Pages of the ``wiki`` folder under ``root``, one a stem: the last path wins."""
    pages = parsed_pages(read_text_tree(spark, f"{root}/wiki"))
    return one_page_a_stem(pages)


def one_page_a_stem(pages: DataFrame) -> DataFrame:
    """Readable pages, the last path of each stem."""
    good = pages.where("error IS NULL")
    rest = [c for c in good.columns if c != "stem"]
    return good.groupBy("stem").agg(F.max_by(F.struct(*rest), "path").alias("page")).select("stem", "page.*")


def parse_errors(pages: DataFrame) -> DataFrame:
    return pages.where("error IS NOT NULL").select("path", "error")


def field(name: str) -> Column:
    """Header value as text (JSON for lists and mappings)."""
    return F.get_json_object("header", f"$['{name}']")


def with_variant(pages: DataFrame) -> DataFrame:
    """Pages with their header as ``_v``, a variant that is parsed once and read field by field."""
    return pages.withColumn("_v", F.try_parse_json("header"))


def typed(name: str, kind: str = "string") -> Column:
    """A value of ``_v``; null where it is missing or of no such type. As text, lists and mappings are JSON."""
    return F.try_variant_get("_v", f"$['{name}']", kind)


def typed_list(name: str) -> Column:
    """A list of texts; a single value is a list of one, a blank or missing one is empty."""
    one, none = F.trim(typed(name)), F.array().cast("array<string>")
    return F.coalesce(typed(name, "array<string>"), F.when(one.isNotNull() & (one != "") & (one != "null"), F.array(one)), none)


def page_columns(pages: DataFrame) -> DataFrame:
    """Typed columns of the header, as :mod:`scriptorium.operators.lint` reads them; ``keys`` are those with a value."""
    names = F.transform(typed("authors", "array<variant>"), lambda a: F.coalesce(F.try_variant_get(a, "$.name", "string"), F.try_variant_get(a, "$", "string")))
    values = F.try_variant_get("_v", "$", "map<string,string>")
    present = F.filter(F.json_object_keys("header"), lambda k: F.try_element_at(values, k).isNotNull())
    return with_variant(pages).select(
        "path", "stem", "body", typed("type").alias("type"), typed("status").alias("status"), typed("title").alias("title"), typed("created").alias("created"), typed("updated").alias("updated"),
        typed("year").alias("year"), names.alias("authors"), typed_list("tags").alias("tags"), typed_list("aliases").alias("aliases"), typed_list("cites").alias("cites"),
        typed_list("sources").alias("sources"), typed_list("papers").alias("papers"), typed("bib-file").alias("bib_file"), typed("paper-id").alias("paper_id"), typed("venue").alias("venue"),
        typed("venue-type").alias("venue_type"), typed("name").alias("name"), typed("slug").alias("slug"), typed("identifiers", "map<string,string>").alias("identifiers"),
        F.try_variant_get("_v", "$.identifiers['arxiv-version']", "string").alias("arxiv_version"), present.alias("keys"),
    )


def header_schema(pages: DataFrame) -> str | None:
    """One schema that all headers fit, as the variant's type text; None without any header."""
    return with_variant(pages).where("_v IS NOT NULL").agg(F.schema_of_variant_agg("_v")).first()[0]


def citation_candidates(pages: DataFrame) -> DataFrame:
    """``(key, text, pos)`` of papers: title, first author and year in one text."""
    own = page_columns(pages).where("type = 'paper'")
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce(F.get("authors", F.lit(0)), F.lit("")), F.coalesce("year", F.lit("")))
    return own.select(F.col("stem").alias("key"), text.alias("text"), F.col("stem").alias("pos"))


def extracts(flat: DataFrame, clipped: DataFrame) -> DataFrame:
    """``(paper_id, path, status, place)`` of both places, ids present in both twice; by id then place.

    Both are parsed pages; unreadable files and rows without an id are left out.
    """
    both = flat.withColumn("place", F.lit(0)).unionByName(clipped.withColumn("place", F.lit(1))).where("error IS NULL")
    rows = both.select(field("paper-id").alias("paper_id"), "path", field("extract-status").alias("status"), field("extracted-at").alias("extracted_at"), "place")
    return rows.where("paper_id IS NOT NULL AND paper_id <> ''").orderBy("paper_id", "place", "path")


def extract_states(parsed: DataFrame) -> DataFrame:
    """``(paper_id, status, parse_error)`` of a folder of extracts, by file name: an unreadable one is there, with its error."""
    return parsed.where(~F.col("path").contains("/")).select(F.col("stem").alias("paper_id"), field("extract-status").alias("status"), F.col("error").alias("parse_error"))


def needs_compile(found: DataFrame, pages: DataFrame) -> DataFrame:
    """Extracts whose page is absent or older than they are."""
    page = pages.select("paper_id", F.col("updated").alias("page_updated"))
    joined = found.join(page, "paper_id", "left")
    newer = F.try_to_timestamp("extracted_at") > F.try_to_timestamp("page_updated")
    return joined.where(F.col("page_updated").isNull() | newer).drop("page_updated")


def unprocessed(found: DataFrame) -> DataFrame:
    return found.where("paper_id IS NULL OR status IS NULL OR status <> 'complete'")


def backlink_targets(pages: DataFrame) -> DataFrame:
    """Paths of the folders that take backlinks, in folder order, then by name."""
    order = F.array_position(F.array(*[F.lit(f) for f in TARGET_FOLDERS]), F.col("folder"))
    return pages.where(order > 0).orderBy(order, "path").select("path")


def manifests(raw: DataFrame) -> DataFrame:
    """``(paper_id, latest)`` from ``<id>.versions.yml`` files: the last list element is newest."""
    parsed = raw.where("path LIKE '%.versions.yml'").withColumn("_h", parse_header(F.col("raw")))
    versions = F.from_json(F.get_json_object("_h.header", "$.versions"), "array<struct<version:string>>")
    return parsed.select(F.regexp_extract("path", r"([^/]+)\.versions\.yml$", 1).alias("paper_id"), F.try_element_at(versions, F.lit(-1))["version"].alias("latest"))


def file_hashes(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """``(path, sha256)`` of files; a file is one row, so it is bounded by what one row can hold."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def lenient_text(content: Column, replace: bool = True) -> Column:
    """Bytes as UTF-8 text; bad sequences become the replacement mark or go."""
    text = F.decode(content, "UTF-8")
    return text if replace else F.replace(text, F.lit("�"), F.lit(""))


def corpus_roots(paths: DataFrame) -> DataFrame:
    """``root`` of each corpus in a listing: a folder with a schema file and a ``wiki`` folder."""
    schema = paths.select(F.regexp_extract("path", r"^(.*)/CLAUDE\.md$", 1).alias("root")).where("root <> ''")
    wiki = paths.select(F.regexp_extract("path", r"^(.*?)/wiki/", 1).alias("root")).where("root <> ''")
    return schema.join(wiki, "root", "left_semi").distinct().orderBy("root")


def enclosing_root(starts: DataFrame, roots: DataFrame) -> DataFrame:
    """``(start, root)``: the nearest corpus at or above each path, by equi join on its prefixes."""
    parts = F.split("start", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    each = starts.select("start", F.explode(prefixes).alias("root"))
    return each.join(roots, "root").groupBy("start").agg(F.max_by("root", F.length("root")).alias("root"))


def default_root(candidates: Iterable[str | None]) -> str | None:
    """The first that is given: the working folder's corpus, then the configured one."""
    return next((c for c in candidates if c), None)
