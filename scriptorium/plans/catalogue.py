"""Registered queries of the library and the SQL that they are held against.

The driver's tables hold no papers, so each operator runs on columns of the same shape:
part rows are papers with field and method tags, orders and line items are citation edges,
documents are page texts. Every query reads whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import arrays, bibtex, dates, html, text
from scriptorium.functions.folding import ascii_fold
from scriptorium.operators import backlinks, export, links, lint, matching, merging, venues
from scriptorium.plans import changes, searches, sites  # noqa: F401  they register queries of their own
from scriptorium.plans.registry import ORACLE_SQL, QUERIES, _s, _t, query  # noqa: F401
from scriptorium.sources import corpus, records, sinks
from scriptorium.streaming import waves

FLAGSHIP = "tag_neighbors_topk"
TODAY = "2026-01-01"


# Ranking and neighbours ------------------------------------------------------------------


def _tagged_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.array(_s("field/", F.col("p_type")), _s("method/", F.col("p_brand")), _s("year/", F.col("p_size"))).alias("tags"), F.col("p_size").alias("year"))


@query("""
WITH t AS (
  SELECT p_partkey AS key, p_size AS year, unnest(list_distinct(['field/' || p_type, 'method/' || p_brand])) AS tag FROM part
), s AS (
  SELECT a.key, b.key AS neighbour, b.year, count(*) AS shared
  FROM t a JOIN t b USING (tag) WHERE a.key <> b.key AND a.key % 50 = 0 GROUP BY ALL
), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY shared DESC, year DESC, neighbour) AS rank FROM s)
SELECT key, neighbour, shared, year, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20
""")
def tag_neighbors_topk(spark, sf_dir):
    """Papers ranked by shared field and method tags; the operator's own top 20 a probe."""
    papers = _tagged_parts(spark, sf_dir)
    return matching.tag_neighbours(papers.where("key % 50 = 0"), papers, 20)


# Strings ---------------------------------------------------------------------------------

_SQL_FOLD = "lower(strip_accents({}))"
_SQL_STOP = r"""CASE WHEN regexp_matches({0}, '(?i)^\s*(a|an|the|on|of|for|with)\s+\S+\s+\S') THEN trim(regexp_replace({0}, '(?i)^\s*(a|an|the|on|of|for|with)\s+', '')) ELSE {0} END"""


def _sql_slug(expr: str) -> str:
    return "nullif(regexp_replace(regexp_replace(" + _SQL_FOLD.format(_SQL_STOP.format(expr)) + ", '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), '')"


@query(f"""
WITH s AS (SELECT doc_id, {_sql_slug("text")} AS whole FROM documents)
SELECT doc_id, whole AS venue_slug, CASE WHEN length(whole) <= 60 THEN whole
  WHEN position('-' IN substr(left(whole, 60), 2)) > 0 THEN regexp_replace(left(whole, 60), '-[^-]*$', '') ELSE left(whole, 60) END AS slug
FROM s
""")
def slugify(spark, sf_dir):
    """Cut and uncut slugs of the documents' whole texts; the cut is the slug's own."""
    title = F.col("text")
    return _t(spark, sf_dir, "documents").select("doc_id", text.slug_uncut(title).alias("venue_slug"), text.slug(title).alias("slug"))


@query("""
SELECT p_partkey AS key, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') || CAST(year(o_orderdate) AS VARCHAR) ||
  coalesce(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda w: w <> '' AND w NOT IN ('a','an','the','on','of','for','with') AND NOT regexp_full_match(w, '[0-9]+'))[1], 'untitled') AS paper_id
FROM part JOIN orders ON o_orderkey = p_partkey JOIN customer ON c_custkey = o_custkey
""")
def paper_id_gen(spark, sf_dir):
    o, c, p = (_t(spark, sf_dir, n) for n in ("orders", "customer", "part"))
    rows = p.join(o, F.col("o_orderkey") == F.col("p_partkey")).join(c, F.col("c_custkey") == F.col("o_custkey"))
    return rows.select(F.col("p_partkey").alias("key"), text.paper_id(F.col("c_name"), F.year("o_orderdate"), F.col("p_name")).alias("paper_id"))


@query("""
SELECT doc_id, translate(replace(replace(replace(strip_accents(text), 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae'), 'øØðÐłŁ', 'oOdDlL').lower() AS folded FROM documents
""")
def ascii_folding(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", ascii_fold(F.col("text")).alias("folded"))


def _identifiers(key: Column) -> Column:
    n = F.lpad(key.cast("string"), 5, "0")
    return (
        F.when(key % 7 == 0, _s("arXiv:2301.", n, "v2"))
        .when(key % 7 == 1, _s("https://arxiv.org/abs/2301.", n))
        .when(key % 7 == 2, _s("doi:10.1234/ABC", n))
        .when(key % 7 == 3, _s("https://doi.org/10.5555/X.", n))
        .when(key % 7 == 4, _s("hep-th/99", n))
        .when(key % 7 == 5, _s("  10.99/", n, " "))
        .otherwise(_s("https://example.org/", n))
    )


_SQL_IDS = r"""
SELECT p_partkey AS key, CASE p_partkey % 7 WHEN 0 THEN 'arXiv:2301.' || n || 'v2' WHEN 1 THEN 'https://arxiv.org/abs/2301.' || n WHEN 2 THEN 'doi:10.1234/ABC' || n
  WHEN 3 THEN 'https://doi.org/10.5555/X.' || n WHEN 4 THEN 'hep-th/99' || n WHEN 5 THEN '  10.99/' || n || ' ' ELSE 'https://example.org/' || n END AS raw
FROM (SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 5, '0') AS n FROM part)
"""


@query(rf"""
WITH i AS ({_SQL_IDS}), s AS (SELECT key, trim(raw) AS whole, regexp_replace(trim(raw), '^(arXiv:|arxiv:|doi:)', '') AS s FROM i),
d AS (SELECT key, CASE
    WHEN regexp_matches(s, 'arxiv\.org/(abs|html|pdf)/(.+?)(/|$)') THEN ['arxiv', regexp_extract(s, 'arxiv\.org/(?:abs|html|pdf)/(.+?)(?:/|$)', 1)]
    WHEN regexp_matches(s, 'doi\.org/(10\.[0-9]{{4,9}}/\S+)') THEN ['doi', regexp_extract(s, 'doi\.org/(10\.[0-9]{{4,9}}/\S+)', 1)]
    WHEN regexp_full_match(s, '10\.[0-9]{{4,9}}/\S+') THEN ['doi', s]
    WHEN regexp_full_match(s, '(?i)([0-9]{{4}}\.[0-9]{{4,5}}(v[0-9]+)?|[a-z][\w-]*/[0-9]{{7}})') THEN ['arxiv', s]
    ELSE ['unknown', whole] END AS f FROM s)
SELECT key, f[1] AS kind, f[2] AS id,
  CASE WHEN f[1] = 'arxiv' AND regexp_full_match(f[2], '[0-9]{{4}}\.[0-9]{{4,5}}(v[0-9]+)?') THEN regexp_extract(f[2], '^([0-9]{{4}}\.[0-9]{{4,5}})', 1) WHEN f[1] = 'doi' THEN lower(f[2]) ELSE f[2] END AS norm,
  CASE f[1] WHEN 'doi' THEN 'DOI:' || f[2] WHEN 'arxiv' THEN 'ARXIV:' || f[2] ELSE (SELECT raw FROM i WHERE i.key = d.key) END AS lookup
FROM d
""")
def identifier_normalize(spark, sf_dir):
    raw = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), _identifiers(F.col("p_partkey")).alias("raw"))
    found = raw.withColumn("f", text.detected_identifier(F.col("raw")))
    return found.select("key", "f.kind", "f.id", text.normalized_identifier(F.col("f.kind"), F.col("f.id")).alias("norm"), text.lookup_key(F.col("raw")).alias("lookup"))


@query(r"""
WITH p AS (SELECT p_partkey AS key, CASE WHEN p_partkey % 3 = 0 THEN '10.1/' || upper(p_brand) || p_partkey END AS doi,
    CASE WHEN p_partkey % 4 = 0 THEN 'arXiv:2301.' || lpad(CAST(p_partkey AS VARCHAR), 5, '0') || 'v3' END AS arxiv, CASE WHEN p_partkey % 5 > 0 THEN 'rec' || p_partkey END AS rid FROM part)
SELECT key, CASE WHEN doi IS NOT NULL THEN 'doi-' || left(regexp_replace(replace(lower(doi), '/', '_'), '[^a-z0-9._-]', '-', 'g'), 100)
    WHEN arxiv IS NOT NULL THEN 'arxiv-' || regexp_replace(regexp_replace(lower(arxiv), '^arxiv:', ''), 'v[0-9]+$', '')
    WHEN rid IS NOT NULL THEN 's2-' || left(sha256(rid), 8) END AS slug,
  CASE WHEN doi IS NOT NULL THEN 'https://doi.org/' || doi WHEN arxiv IS NOT NULL THEN 'https://arxiv.org/abs/' || regexp_replace(regexp_replace(lower(arxiv), '^arxiv:', ''), 'v[0-9]+$', '')
    WHEN rid IS NOT NULL THEN 'https://www.semanticscholar.org/paper/' || rid END AS url
FROM p
""")
def record_slugs(spark, sf_dir):
    key = F.col("p_partkey")
    doi = F.when(key % 3 == 0, _s("10.1/", F.upper("p_brand"), key))
    arxiv = F.when(key % 4 == 0, _s("arXiv:2301.", F.lpad(key.cast("string"), 5, "0"), "v3"))
    rid = F.when(key % 5 > 0, _s("rec", key))
    return _t(spark, sf_dir, "part").select(key.alias("key"), text.record_slug(doi, arxiv, rid).alias("slug"), text.record_url(doi, arxiv, rid).alias("url"))


def _venue_raw() -> Column:
    n = F.col("o_orderkey")
    return F.when(n % 97 == 0, F.lit("2022")).otherwise(_s(F.year("o_orderdate"), F.when(n % 3 == 0, " IEEE ").otherwise(" "), n % 60 + 1, "th Conference on ", F.initcap("o_orderpriority"), " (CONF", F.year("o_orderdate"), "-", F.col("o_orderstatus"), ")"))


_SQL_VENUE_RAW = """CASE WHEN o_orderkey % 97 = 0 THEN '2022' ELSE CAST(year(o_orderdate) AS VARCHAR) || CASE WHEN o_orderkey % 3 = 0 THEN ' IEEE ' ELSE ' ' END || CAST(o_orderkey % 60 + 1 AS VARCHAR) || 'th Conference on ' || {} || ' (CONF' || CAST(year(o_orderdate) AS VARCHAR) || '-' || o_orderstatus || ')' END"""
_SQL_INITCAP = "array_to_string(list_transform(string_split(lower(o_orderpriority), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
_SQL_VENUE = r"""
SELECT o_orderkey AS key, o_custkey, o_orderdate, o_orderstatus, raw, nullif(trim(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(y, '\s+', ' ', 'g'), '\s+-\s+', ' ', 'g'), '^\s*-+\s*|\s*-+\s*$', '', 'g')), '^[, ;]+|[, ;]+$', '', 'g')), '') AS name
FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '[()\[\]{}]', ' ', 'g'), '(?i)\b[0-9]+(st|nd|rd|th)\b', ' ', 'g'), '(^|[^0-9])(19|20)[0-9]{2}($|[^0-9])', '\1\3', 'g'), '(^|[^0-9])(19|20)[0-9]{2}($|[^0-9])', '\1\3', 'g') AS y
      FROM (SELECT *, RAW AS raw FROM orders))
""".replace("RAW AS raw", _SQL_VENUE_RAW.format(_SQL_INITCAP) + " AS raw")


@query(f"WITH v AS ({_SQL_VENUE}) SELECT key, name, {_sql_slug('name')} AS slug, CASE WHEN name IS NULL THEN 'empty' END AS error FROM v")
def venue_normalize(spark, sf_dir):
    v = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), text.venue_name(_venue_raw()).alias("name"))
    return v.select("key", "name", text.slug_uncut(F.col("name")).alias("slug"), text.reason_if_null(F.col("name"), "empty").alias("error"))


@query(f"""
WITH v AS ({_SQL_VENUE}), p AS (
  SELECT key, {_sql_slug('name')} AS new_slug, name, 'old-' || CAST(key % 500 AS VARCHAR) || '-' || CAST(key AS VARCHAR) AS slug, CASE o_orderstatus WHEN 'O' THEN 'journal' WHEN 'F' THEN 'conference' ELSE 'workshop' END AS venue_type,
    strftime(o_orderdate, '%Y-%m-%d') AS created, list_transform(range(1, CAST(key % 4 AS BIGINT) + 1), lambda x: 'p' || CAST(o_custkey + x AS VARCHAR)) AS papers, ['field/' || o_orderstatus] AS tags FROM v WHERE name IS NOT NULL
), votes AS (SELECT new_slug, venue_type, count(*) AS n, min(-len(papers)) AS w FROM p GROUP BY ALL),
first AS (SELECT new_slug, venue_type, min(slug) AS k FROM p JOIN votes USING (new_slug, venue_type) WHERE -len(papers) = w GROUP BY ALL),
win AS (SELECT new_slug, venue_type FROM (SELECT *, row_number() OVER (PARTITION BY new_slug ORDER BY n DESC, w, k) AS r FROM votes JOIN first USING (new_slug, venue_type)) WHERE r = 1),
g AS (SELECT new_slug, min(created) AS created, list_sort(list_distinct(flatten(list(papers)))) AS papers, list_sort(list_distinct(flatten(list(tags)))) AS tags, count(*) AS n_members, arg_min(name, [lpad(CAST(1000 - length(name) AS VARCHAR), 5, '0'), slug]) AS name FROM p GROUP BY new_slug)
SELECT new_slug, name, created, array_to_string(papers, ',') AS papers, array_to_string(tags, ',') AS tags, n_members, venue_type FROM g JOIN win USING (new_slug)
""")
def venue_plan(spark, sf_dir):
    """Groups of venue pages that one migration renames or merges."""
    plan = venues.venue_plan(_venue_pages(spark, sf_dir))
    return plan.groups.select("new_slug", "name", "created", F.array_join("papers", ",").alias("papers"), F.array_join("tags", ",").alias("tags"), "n_members", "venue_type")


def _venue_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    papers = F.transform(F.when(key % 4 > 0, F.sequence(F.lit(1), (key % 4).cast("int"))).otherwise(F.array().cast("array<int>")), lambda x: _s("p", F.col("o_custkey") + x))
    kind = F.when(F.col("o_orderstatus") == "O", "journal").when(F.col("o_orderstatus") == "F", "conference").otherwise("workshop")
    return _t(spark, sf_dir, "orders").select(
        _s("old-", key % 500, "-", key).alias("slug"), _venue_raw().alias("name"), F.lit("venue").alias("type"), kind.alias("venue_type"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created"), papers.alias("papers"), F.array(_s("field/", F.col("o_orderstatus"))).alias("tags")
    )


@query(r"""
WITH n AS (SELECT p_partkey AS key, p_name || CASE p_partkey % 6 WHEN 0 THEN ' Workshop' WHEN 1 THEN ' arXiv conference' WHEN 2 THEN ' Symposium on X' WHEN 3 THEN ' Letters' WHEN 4 THEN ' workshopping' ELSE ' Proceedings Journal' END AS name FROM part)
SELECT key, CASE WHEN regexp_matches(name, '(?i)\bworkshop\b') THEN 'workshop' WHEN regexp_matches(name, '(?i)\b(arxiv|biorxiv|medrxiv|chemrxiv|ssrn|preprint server)\b') THEN 'preprint-server'
  WHEN regexp_matches(name, '(?i)\b(conference|symposium|proceedings|congress)\b') THEN 'conference' ELSE 'journal' END AS venue_type FROM n
""")
def venue_type(spark, sf_dir):
    k = F.col("p_partkey") % 6
    name = _s(F.col("p_name"), F.when(k == 0, " Workshop").when(k == 1, " arXiv conference").when(k == 2, " Symposium on X").when(k == 3, " Letters").when(k == 4, " workshopping").otherwise(" Proceedings Journal"))
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), text.venue_type(name).alias("venue_type"))


@query(r"""
WITH d AS (SELECT o_orderkey AS key, o_orderdate AS t, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 2 THEN strftime(o_orderdate, '%B %-d, %Y') WHEN 3 THEN strftime(o_orderdate, '%-d %B %Y') WHEN 4 THEN strftime(o_orderdate, '%B %Y') ELSE 'n.d.' END AS raw FROM orders)
SELECT key, CASE WHEN key % 6 < 4 THEN strftime(t, '%Y-%m-%d') WHEN key % 6 = 4 THEN strftime(t, '%Y') || '-01-01' ELSE '' END AS date, CASE WHEN key % 6 < 5 THEN CAST(year(t) AS VARCHAR) END AS year,
  CASE WHEN key % 6 = 0 THEN strftime(t, '%Y-%m-%d') END AS created FROM d
""")
def date_normalize(spark, sf_dir):
    k, t = F.col("o_orderkey") % 6, F.col("o_orderdate")
    raw = F.when(k == 0, F.date_format(t, "yyyy-MM-dd")).when(k == 1, F.date_format(t, "yyyy/MM/dd")).when(k == 2, F.date_format(t, "MMMM d, yyyy")).when(k == 3, F.date_format(t, "d MMMM yyyy")).when(k == 4, F.date_format(t, "MMMM yyyy")).otherwise("n.d.")
    rows = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), raw.alias("raw")).withColumn("d", dates.publication_date(F.col("raw")))
    return rows.select("key", "d.date", F.col("d.year").cast("string").alias("year"), dates.creation_date(F.col("raw")).cast("string").alias("created"))


@query(r"SELECT item_id, trim(regexp_replace(regexp_replace(lower(text), '[^\w\s\x{80}-\x{10FFFF}]', ' ', 'g'), '\s+', ' ', 'g')) AS norm FROM benchmark")
def reference_normalize(spark, sf_dir):
    return _t(spark, sf_dir, "benchmark").select("item_id", text.reference_text(F.col("text")).alias("norm"))


@query(r"""
SELECT p_partkey AS key, left(regexp_replace(regexp_replace(p_name || ': a <' || p_type || '>', '[<>:"/\\|?*]', '', 'g'), '\s+', '_', 'g'), 100) AS file_name,
  CASE WHEN p_size % 2 = 0 THEN string_split(p_name, ' ')[-1] || ' et al.' ELSE string_split(p_name, ' ')[-1] END AS inline_author, CASE WHEN p_size = 1 THEN 'paper' ELSE 'papers' END AS noun,
  CASE WHEN length(p_type) > 12 THEN 'read' ELSE 'skimmed' END AS status, 'wiki/concepts/' || p_partkey || '.md' AS path, 'year/' || (1900 + p_size) AS year_tag FROM part
""")
def labels_and_paths(spark, sf_dir):
    authors = F.when(F.col("p_size") % 2 == 0, F.array("p_name", F.lit("B"))).otherwise(F.array("p_name"))
    return _t(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("key"), text.file_name(_s(F.col("p_name"), ": a <", F.col("p_type"), ">")).alias("file_name"), text.inline_author(authors).alias("inline_author"), text.plural(F.col("p_size"), "paper", "papers").alias("noun"),
        text.read_status(F.col("p_type"), 12).alias("status"), text.page_path(F.lit("concept"), F.col("p_partkey").cast("string")).alias("path"), dates.year_tag(_s("in ", F.col("p_size") + 1900)).alias("year_tag"),
    )


@query("""
WITH b AS (SELECT p_partkey AS k, 'field/' || p_type AS f, 'venue/' || p_brand AS v, 'x' AS x FROM part), t AS (SELECT k, [f, v, x, v] || CASE WHEN k % 2 = 0 THEN ['venue/new'] ELSE [] END AS tags, v FROM b WHERE true)
SELECT k AS key, CASE WHEN k % 2 = 0 THEN array_to_string([tags[1], 'venue/new', 'x'], ',') ELSE array_to_string([tags[1], 'venue/new', 'x'], ',') END AS retagged,
  array_to_string(CASE WHEN k % 2 = 0 THEN [tags[1], v, 'x', 'venue/new'] ELSE [tags[1], v, 'x', 'more'] END, ',') AS appended, array_to_string([tags[1]], ',') AS fields FROM t
""")
def tag_lists(spark, sf_dir):
    """Append, rewrite and prefix rules on tag arrays."""
    v, even = _s("venue/", F.col("p_brand")), F.col("p_partkey") % 2 == 0
    tags = F.concat(F.array(_s("field/", F.col("p_type")), v, F.lit("x"), v), F.when(even, F.array(F.lit("venue/new"))).otherwise(F.array().cast("array<string>")))
    rows = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), tags.alias("tags"), v.alias("v"), even.alias("even"))
    more = F.when(F.col("even"), "venue/new").otherwise("more")
    return rows.select("key", F.array_join(arrays.retagged(F.col("tags"), F.col("v"), F.lit("venue/new")), ",").alias("retagged"), F.array_join(arrays.appended(arrays.in_first_order(F.col("tags")), more), ",").alias("appended"), F.array_join(arrays.with_prefix(F.col("tags"), "field/"), ",").alias("fields"))


# Links and graphs ------------------------------------------------------------------------


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))


@query("SELECT l_partkey AS cited, count(DISTINCT l_orderkey) AS n_citing, array_to_string(list_sort(list_distinct(list(l_orderkey))), ',') AS citing FROM lineitem GROUP BY 1")
def cited_by(spark, sf_dir):
    found = links.cited_by(_edges(spark, sf_dir))
    return found.select("cited", "n_citing", F.array_join(F.col("citing").cast("array<string>"), ",").alias("citing"))


@query("SELECT DISTINCT key FROM (SELECT o_orderkey AS key FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'))")
def one_hop(spark, sf_dir):
    hits = _t(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("key"))
    return links.one_hop(hits, _edges(spark, sf_dir))


def _part_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pages: links to the next part by name, an alias and a gap; a stem a part key."""
    key = F.col("p_partkey")
    body = _s("# Page\nsee [[p", key + 1, "|next]] and [[alias-", key % 40, "]]\n\n> [!WARNING] Contradiction\n## Counter-arguments\n[[gone-", key % 9, "]] [[p", key, "]]")
    rows = _t(spark, sf_dir, "part").where("p_partkey % 10 <> 3")
    return rows.select(
        _s("p", key).alias("stem"), _s("wiki/p", key, ".md").alias("path"), body.alias("body"), F.when(key % 100 < 20, F.array(_s("alias-", key % 40))).otherwise(F.array().cast("array<string>")).alias("aliases"),
        F.array(_s("p", key + 2), _s("p", key + 3)).alias("cites"), F.when(key % 4 == 0, "paper").when(key % 4 == 1, "concept").when(key % 4 == 2, "method").otherwise("venue").alias("type"), F.when(key % 5 == 0, "stale").otherwise("active").alias("status"),
        F.date_format(F.date_sub(F.to_date(F.lit(TODAY)), (key % 400).cast("int")), "yyyy-MM-dd").alias("updated"), F.when(key % 3 == 0, F.array(_s("field/", F.col("p_type")))).otherwise(F.array(F.lit("topic/x"))).alias("tags"),
        F.array(*[F.lit(x) for x in ("type", "status", "updated", "tags", "title")]).alias("keys"), F.when(key % 8 == 0, _s("raw/bib/p", key, ".bib")).alias("bib_file"), _s("p", key).alias("paper_id"), F.lit("v1").alias("arxiv_version"),
    )


_SQL_PAGES = """
pages AS (SELECT 'p' || p_partkey AS stem, 'wiki/p' || p_partkey || '.md' AS path, p_partkey AS k, CASE WHEN p_partkey % 100 < 20 THEN 'alias-' || (p_partkey % 40) END AS alias FROM part WHERE p_partkey % 10 <> 3),
l AS (SELECT stem AS src, path, 2 AS line, 'p' || (k + 1) AS target FROM pages UNION ALL SELECT stem, path, 2, 'alias-' || (k % 40) FROM pages UNION ALL SELECT stem, path, 6, 'gone-' || (k % 9) FROM pages UNION ALL SELECT stem, path, 6, 'p' || k FROM pages),
a AS (SELECT alias, arg_max(stem, path) AS canonical FROM pages WHERE alias IS NOT NULL GROUP BY alias),
r AS (SELECT l.*, coalesce(p.stem, a.canonical) AS resolved, CASE WHEN p.stem IS NOT NULL THEN 'page' WHEN a.canonical IS NOT NULL THEN 'alias' ELSE 'dead' END AS kind FROM l LEFT JOIN pages p ON p.stem = l.target LEFT JOIN a ON a.alias = l.target)
"""


@query(f"WITH {_SQL_PAGES} SELECT src, line, target, resolved, kind FROM r")
def link_resolution(spark, sf_dir):
    """All links of all pages, each a page's, an alias's or dead."""
    pages = _part_pages(spark, sf_dir)
    return links.resolved_links(links.page_links(pages), pages, links.alias_map(pages)).select("src", "line", "target", "resolved", "kind")


@query(f"WITH {_SQL_PAGES} SELECT stem FROM pages WHERE k % 2 = 0 AND stem NOT IN (SELECT resolved FROM r WHERE resolved IS NOT NULL AND resolved <> src)")
def orphans(spark, sf_dir):
    pages = _part_pages(spark, sf_dir)
    resolved = links.resolved_links(links.page_links(pages), pages, links.alias_map(pages)).where("resolved <> src")
    return links.orphans(pages, resolved).where(F.substring("stem", 2, 20).cast("long") % 2 == 0).select("stem")


@query(f"WITH {_SQL_PAGES}, c AS (SELECT stem, 'p' || (k + 2) AS cited FROM pages UNION ALL SELECT stem, 'p' || (k + 3) FROM pages) SELECT stem, cited FROM c WHERE cited NOT IN (SELECT stem FROM pages)")
def invalid_cites(spark, sf_dir):
    pages = _part_pages(spark, sf_dir)
    return links.invalid_cites(pages, pages)


@query(f"""
WITH {_SQL_PAGES}, i AS (SELECT DISTINCT 'p' || (l_partkey + 7) AS target FROM lineitem)
SELECT target, 'no page' AS kind FROM i WHERE target NOT IN (SELECT stem FROM pages) AND target NOT IN (SELECT alias FROM a)
UNION ALL SELECT stem, 'not in index' FROM pages WHERE stem NOT IN (SELECT target FROM i)
""")
def index_drift(spark, sf_dir):
    pages = _part_pages(spark, sf_dir)
    index = _t(spark, sf_dir, "lineitem").select(_s("- [[p", F.col("l_partkey") + 7, "|x]]\n").alias("text"))
    return links.index_drift(pages, index, links.alias_map(pages))


@query("SELECT p_partkey AS key, p_name AS target FROM part UNION ALL SELECT p_partkey, p_brand FROM part")
def wikilinks(spark, sf_dir):
    body = _s("see [[", F.col("p_name"), "|", F.col("p_brand"), "]] and [[ ", F.col("p_brand"), " ]]")
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.explode(text.link_targets(body)).alias("target"))


_SQL_LINT_PAGES = _SQL_PAGES.replace("6, 'p' || k FROM pages", "6, 'p' || CASE WHEN k % 10 = 4 THEN k + 1 ELSE k END FROM pages")


@query(f"""
WITH {_SQL_LINT_PAGES}, t AS (SELECT *, k % 400 AS age, CASE k % 4 WHEN 0 THEN 'paper' WHEN 1 THEN 'concept' WHEN 2 THEN 'method' ELSE 'venue' END AS type FROM pages),
need AS (SELECT * FROM (VALUES ('paper', ['paper-id','created','authors','year','identifiers','bib-file','extract']), ('concept', ['created','sources']), ('method', ['created','sources']), ('venue', ['name','slug','venue-type','created','papers'])) AS v(type, keys)),
issues AS (
  SELECT 'DEAD_LINK' AS tag FROM r WHERE kind = 'dead' UNION ALL SELECT 'ALIAS_LINK' FROM r WHERE kind = 'alias'
  UNION ALL SELECT 'MISSING_FIELD' FROM (SELECT unnest(keys) FROM t JOIN need USING (type))
  UNION ALL SELECT 'MISSING_FIELD_TAG' FROM t WHERE type <> 'venue' AND k % 3 <> 0
  UNION ALL SELECT 'STALE' FROM t WHERE k % 5 = 0 AND age > 90 UNION ALL SELECT 'STALE' FROM t WHERE type IN ('concept', 'method') AND age > 180
  UNION ALL SELECT 'CONTRADICTION' FROM t
  UNION ALL SELECT 'INVALID_CITES' FROM (SELECT 'p' || (k + 2) AS c FROM t WHERE type = 'paper' UNION ALL SELECT 'p' || (k + 3) FROM t WHERE type = 'paper') WHERE c NOT IN (SELECT stem FROM pages)
  UNION ALL SELECT 'MISSING_BIBTEX' FROM t WHERE type = 'paper' AND k % 8 = 0 AND k % 24 <> 16
  UNION ALL SELECT CASE k % 12 WHEN 0 THEN 'EXTRACT_MISSING' WHEN 4 THEN 'EXTRACT_FAILED' ELSE 'EXTRACT_PARSE_ERROR' END FROM t WHERE type = 'paper'
  UNION ALL SELECT 'ORPHAN' FROM pages WHERE stem NOT IN (SELECT resolved FROM r WHERE resolved IS NOT NULL)
  UNION ALL SELECT 'MISSING_SECTION' FROM t WHERE type IN ('concept', 'method') AND k % 5 = 1
  UNION ALL SELECT 'INDEX_DRIFT' FROM pages WHERE k % 6 = 0 UNION ALL SELECT 'INDEX_DRIFT'
  UNION ALL SELECT 'PARSE_ERROR' FROM part WHERE p_partkey % 10 = 3
  UNION ALL SELECT 'VERSION_DRIFT' FROM t WHERE type = 'paper' AND k % 16 = 0
)
SELECT tag, count(*) AS n_issues FROM issues GROUP BY tag
""")
def lint_totals(spark, sf_dir):
    """Issues by rule over the part pages (the near-duplicate rule has its own query: no such ratio in SQL)."""
    return lint.lint_totals(_lint(spark, sf_dir).where("tag <> 'VENUE_NEAR_DUPLICATE'"))


def _lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules over the part pages, some of them without a section or a link to themselves; each rule finds something."""
    k = F.substring("stem", 2, 20).cast("long")
    body = F.when(k % 5 == 1, F.replace("body", F.lit("## Counter-arguments"), F.lit("## Other"))).otherwise(F.col("body"))
    body = F.when(k % 10 == 4, F.replace(body, _s("[[", F.col("stem"), "]]"), _s("[[p", k + 1, "]]"))).otherwise(body)
    pages = _part_pages(spark, sf_dir).withColumn("body", body)
    bibs = pages.where(k % 24 != 0).where(k % 8 == 0).select("bib_file", F.when(k % 24 == 8, "@a{k, }\n% bib-incomplete: TRUE").otherwise("@a{k, }").alias("bib"))
    extracts = pages.where(k % 12 != 0).select("paper_id", F.when(k % 12 == 4, "failed").otherwise("complete").alias("status"), F.when(k % 12 == 8, "bad header").alias("parse_error"))
    versions = pages.select("paper_id", F.when(k % 16 == 0, "v2").otherwise("v1").alias("latest"))
    index = pages.where(k % 6 != 0).select(_s("- [[", F.col("stem"), "]]\n").alias("text")).union(spark.range(1).select(F.lit("[[nowhere]]").alias("text")))
    errors = _t(spark, sf_dir, "part").where("p_partkey % 10 = 3").select(_s("wiki/p", F.col("p_partkey"), ".md").alias("path"), F.lit("bad header").alias("error"))
    return lint.lint(pages, bibs, extracts, versions, index, F.to_date(F.lit(TODAY)), errors)


@query()
def lint_issues(spark, sf_dir):
    """Every issue of every rule, near-duplicate venue keys among them."""
    return _lint(spark, sf_dir)


@query("""
WITH n AS (SELECT CAST(o_orderkey AS VARCHAR) AS path, CASE WHEN o_orderkey % 2 = 0 THEN 'concept' ELSE 'paper' END AS type, o_orderstatus, date_diff('day', CAST(o_orderdate AS DATE), DATE '2026-01-01') AS age FROM orders)
SELECT path, 'status stale for ' || age || ' days' AS detail FROM n WHERE o_orderstatus = 'O' AND age > 90 UNION ALL SELECT path, 'untouched for ' || age || ' days' FROM n WHERE type = 'concept' AND age > 180
""")
def stale_pages(spark, sf_dir):
    """Orders as pages: open ones are stale, even keys are concepts."""
    key = F.col("o_orderkey")
    pages = _t(spark, sf_dir, "orders").select(key.cast("string").alias("path"), F.when(key % 2 == 0, "concept").otherwise("paper").alias("type"), F.when(F.col("o_orderstatus") == "O", "stale").otherwise("active").alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("updated"))
    return lint.stale_pages(pages, F.to_date(F.lit(TODAY))).select("path", "detail")


@query("""
WITH need AS (SELECT * FROM (VALUES (0, ['type','name','slug','created','updated','papers','tags']), (1, ['type','name','slug','venue-type','created','updated','papers','tags']), (2, ['type','status','created','updated','sources','tags'])) AS v(kind, wanted)),
d AS (SELECT doc_id, doc_id % 3 AS kind, ['type', 'slug', lang] || CASE WHEN doc_id % 2 = 0 THEN ['papers', 'tags'] ELSE [] END AS has FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS path, detail FROM (SELECT doc_id, unnest(list_filter(wanted, lambda x: NOT list_contains(has, x))) AS detail FROM d JOIN need USING (kind))
""")
def missing_fields(spark, sf_dir):
    """Documents as pages of three types with some header keys."""
    key = F.col("doc_id")
    has = F.concat(F.array(F.lit("type"), F.lit("slug"), F.col("lang")), F.when(key % 2 == 0, F.array(F.lit("papers"), F.lit("tags"))).otherwise(F.array().cast("array<string>")))
    pages = _t(spark, sf_dir, "documents").select(key.cast("string").alias("path"), F.when(key % 3 == 0, "author").when(key % 3 == 1, "venue").otherwise("claim").alias("type"), has.alias("keys"))
    return lint.missing_fields(pages).select("path", "detail")


# Matching --------------------------------------------------------------------------------


@query("""
WITH i AS (SELECT doc_id AS key, 'doi' AS kind, lower('10.1/' || upper(source) || n_chars % 40) AS norm FROM documents UNION ALL SELECT doc_id, 'url', 'u' || (n_chars * 7 % 300) || source FROM documents),
e AS (SELECT kind, norm, min(key) AS match FROM i WHERE key % 2 = 0 GROUP BY ALL)
SELECT key, min(match) AS match FROM i JOIN e USING (kind, norm) WHERE key % 2 = 1 GROUP BY key
""")
def identifier_dedup(spark, sf_dir):
    """Odd documents against even ones by any shared identifier."""
    ids = F.create_map(F.lit("doi"), _s("10.1/", F.upper("source"), F.col("n_chars") % 40), F.lit("url"), _s("u", F.col("n_chars") * 7 % 300, F.col("source")))
    rows = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), ids.alias("identifiers"))
    return matching.identifier_matches(rows.where("key % 2 = 1"), rows.where("key % 2 = 0"))


@query("""
WITH h AS (SELECT doc_id, sha256(text) AS sha256 FROM documents)
SELECT doc_id, sha256, min(doc_id) OVER (PARTITION BY sha256) AS first_key, count(*) OVER (PARTITION BY sha256) AS n_copies FROM h
""")
def byte_dedup(spark, sf_dir):
    return matching.content_duplicates(_t(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def near_dup_pairs(spark, sf_dir):
    """Near-equal slugs among all distinct part names."""
    return matching.near_duplicate_keys(_t(spark, sf_dir, "part").select(text.slug_uncut(F.col("p_name")).alias("key")))


@query()
def fuzzy_refs_topk(spark, sf_dir):
    """Benchmark items as references, the documents' whole texts as candidates; no pair at the threshold is lost."""
    refs = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ref_id"), "text")
    return matching.reference_matches(refs, _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("doc_id").alias("pos"), "text"))


@query("SELECT doc_id AS key FROM documents WHERE contains(lower(text), 'tion and') OR source IN ('src3', 'src13')")
def search_hits(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("body"), F.col("source").alias("title"))
    index = docs.select("key", F.when(F.col("title").isin("src3", "src13"), "about tion and").otherwise("other").alias("title"))
    return matching.search_hits(docs, index, "tion and")


# Merging ---------------------------------------------------------------------------------


@query("""
WITH v AS (SELECT user_id, event_type, count(*) AS n, min(-value) AS w FROM events GROUP BY ALL), k AS (SELECT e.user_id, e.event_type, n, w, min(event_id) AS k FROM events e JOIN v USING (user_id, event_type) WHERE -value = w GROUP BY ALL)
SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, w, k) AS r FROM k) WHERE r = 1
""")
def majority_vote(spark, sf_dir):
    return merging.majority(_t(spark, sf_dir, "events"), "user_id", "event_type", "value", "event_id")


@query("""
WITH u AS (
  SELECT o_custkey AS key, o_totalprice AS citations, 0 AS s, o_orderkey AS pos FROM orders WHERE o_orderstatus = 'O' UNION ALL
  SELECT o_custkey, o_totalprice, 1, o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, o_totalprice, 2, o_orderkey FROM orders WHERE o_orderstatus = 'P'
), f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY s, pos) AS r FROM u)
SELECT key, citations, CAST(s AS INTEGER) AS source_no, pos, (SELECT count(DISTINCT key) FROM u) AS total_found FROM f WHERE r = 1 ORDER BY citations DESC, s, pos LIMIT 50
""")
def discover_merge(spark, sf_dir):
    """Three lists merged by id, first list first; the operator's own limit of 50, and the total before it."""
    o = _t(spark, sf_dir, "orders")
    frames = [o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("citations"), F.col("o_orderkey").alias("pos")) for s in ("O", "F", "P")]
    rows, total = merging.first_of_union(frames, "key", [F.desc("citations")], 50)
    return rows.join(F.broadcast(total)).select("key", "citations", "source_no", "pos", "total_found")


@query("""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations), g AS (SELECT conv_id, list(role ORDER BY turn) AS roles, list('p' || turn ORDER BY turn) AS ids, list(text ORDER BY turn) AS texts, min(turn) AS t0 FROM c GROUP BY conv_id)
SELECT 'conv-' || conv_id AS slug, array_to_string(ids, ',') AS sources, '# T' || t0 || chr(10) || chr(10) || '## Definition' || chr(10) || chr(10) || texts[1] || chr(10) || chr(10) || '## Details' || chr(10) || chr(10) || '## See Also' || chr(10) || chr(10) || '## Counter-Arguments and Gaps'
  || CASE WHEN len(ids) = 1 THEN chr(10) ELSE array_to_string(list_transform(range(2, len(ids) + 1), lambda i: chr(10) || chr(10) || 'From [[' || ids[i] || ']]: ' || rtrim(texts[i], chr(10) || ' ')), '') || regexp_extract(texts[-1], '\\s*$') || chr(10) END AS body
FROM g
""".replace("\\\\s", r"\s"))
def entity_upsert(spark, sf_dir):
    """Turns of a conversation as contributions to one page, in order."""
    c = _t(spark, sf_dir, "conversations")
    rows = c.select(F.lit("concept").alias("kind"), _s("conv-", F.col("conv_id")).alias("slug"), F.col("turn").alias("seq"), _s("p", F.col("turn")).alias("paper_id"), _s("T", F.col("turn")).alias("title"), F.array("role").alias("tags"), "text")
    existing = spark.createDataFrame([], "kind string, slug string, status string, created string, sources array<string>, tags array<string>, body string")
    return merging.upsert_entities(existing, rows, F.lit(TODAY)).select("slug", F.array_join("sources", ",").alias("sources"), "body")


@query("""
WITH p AS (SELECT o_orderkey AS seq, 'smith' || year(o_orderdate) || lower(left(o_orderpriority, 1)) || 'x' AS base FROM orders)
SELECT seq, base, base || CASE WHEN n = 1 THEN '' ELSE CAST(n AS VARCHAR) END AS key FROM (SELECT *, CAST(row_number() OVER (PARTITION BY base ORDER BY seq) AS BIGINT) + 1 + CASE WHEN row_number() OVER (PARTITION BY base ORDER BY seq) > 1 THEN 1 ELSE 0 END AS n FROM p)
""")
def collision_ids(spark, sf_dir):
    """Proposed paper ids against taken ones (the base and its suffix 3 are in use)."""
    base = _s("smith", F.year("o_orderdate"), F.lower(F.left("o_orderpriority", F.lit(1))), "x")
    proposed = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), base.alias("base"))
    bases = proposed.select("base").distinct()
    return merging.collision_free(proposed, bases.select(F.col("base").alias("key")).union(bases.select(_s(F.col("base"), "3"))))


@query("SELECT l_orderkey AS key, array_to_string(list_sort(list_distinct(list('field/' || p_type))), ',') AS tags FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def source_tags(spark, sf_dir):
    entities = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.array(F.col("l_partkey").cast("string")).alias("sources"))
    papers = _t(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("paper_id"), F.array(_s("field/", F.col("p_type")), _s("year/", F.col("p_size"))).alias("tags"))
    found = merging.source_tags(entities, papers)
    return found.select("key", F.array_join("tags", ",").alias("tags"))


@query("SELECT l_orderkey AS paper_id, arg_max(strftime(l_shipdate, '%Y-%m-%d'), [CAST(l_linenumber AS VARCHAR), strftime(l_shipdate, '%Y-%m-%d')]) AS version, count(*) AS n_versions FROM lineitem GROUP BY 1")
def latest_versions(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("version"), F.struct("l_linenumber", F.date_format("l_shipdate", "yyyy-MM-dd")).alias("ordinal"))
    return merging.latest_version(rows)


@query("""
WITH p AS (SELECT p_partkey AS key, coalesce(CASE WHEN p_partkey % 3 = 0 THEN 'v-' || p_brand END, '') AS doi, p_type FROM part)
SELECT key, CASE WHEN doi <> '' THEN doi WHEN key % 2 = 0 THEN 'new-' || key END AS doi FROM p
""")
def identifier_fill(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    existing = p.select(F.col("p_partkey").alias("key"), F.coalesce(F.when(F.col("p_partkey") % 3 == 0, _s("v-", F.col("p_brand"))), F.lit("")).alias("doi"))
    incoming = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("key"), _s("new-", F.col("p_partkey")).alias("doi"))
    return merging.identifier_fill(existing, incoming, "key", ["doi"])


@query()
def venue_summary(spark, sf_dir):
    hashed = lambda c: F.md5(c.cast("binary"))  # noqa: E731  old slugs that are no spelling variants of each other
    plan = venues.venue_plan(_venue_pages(spark, sf_dir).withColumn("slug", hashed(F.col("slug"))))
    old = hashed(_s("old-", F.col("c_custkey") % 500, "-", F.col("c_custkey")))
    papers = _t(spark, sf_dir, "customer").select(_s("p", F.col("c_custkey")).alias("paper_id"), old.alias("venue"), F.array(F.lit("x")).alias("tags"))
    return venues.plan_summary(plan, venues.paper_rewrites(papers, plan))


@query(f"""
WITH v AS ({_SQL_VENUE}), m AS (SELECT 'old-' || CAST(key % 500 AS VARCHAR) || '-' || CAST(key AS VARCHAR) AS old_slug, {_sql_slug('name')} AS new_slug FROM v WHERE name IS NOT NULL),
p AS (SELECT 'p' || c_custkey AS paper_id, 'old-' || (c_custkey % 500) || '-' || c_custkey AS old_slug, c_custkey % 2 AS odd FROM customer)
SELECT paper_id, old_slug, new_slug, CASE WHEN odd = 1 THEN 'venue/' || new_slug || ',x' ELSE 'a,venue/' || new_slug END AS tags FROM p JOIN m USING (old_slug)
""")
def paper_rewrites(spark, sf_dir):
    """Papers whose venue field or tag names an old slug, and their tags after the rewrite."""
    plan = venues.venue_plan(_venue_pages(spark, sf_dir))
    old, odd = _s("old-", F.col("c_custkey") % 500, "-", F.col("c_custkey")), F.col("c_custkey") % 2 == 1
    papers = _t(spark, sf_dir, "customer").select(_s("p", F.col("c_custkey")).alias("paper_id"), F.when(odd, old).otherwise("none").alias("venue"), F.when(odd, F.array(_s("venue/", old), F.lit("x"))).otherwise(F.array(F.lit("a"), _s("venue/", old))).alias("tags"))
    moves = venues.paper_rewrites(papers, plan)
    after = venues.rewritten_papers(papers, moves, F.lit(TODAY)).select("paper_id", F.array_join("tags", ",").alias("tags"))
    return moves.join(after, "paper_id").select("paper_id", "old_slug", "new_slug", "tags")


@query()
def backlink_insert(spark, sf_dir):
    """Part names as slugs, linked in a page for each part; mentions in whole documents are `slug_mentions`."""
    slugs = _t(spark, sf_dir, "part").select(text.slug_uncut(F.col("p_name")).alias("slug")).distinct()
    pages = _t(spark, sf_dir, "part").select(_s("p", F.col("p_partkey")).alias("path"), _s("A ", F.col("p_name"), " beside a ", F.col("p_name")).alias("text"))
    return backlinks.insert_backlinks(pages, slugs).select("path", "text", F.array_join("inserted", ",").alias("inserted"))


# Bibliography ----------------------------------------------------------------------------

_KINDS = "CASE o_orderkey % 4 WHEN 0 THEN 'article' WHEN 1 THEN 'inproceedings' WHEN 2 THEN 'book' ELSE CASE WHEN o_orderpriority LIKE '%HIGH' THEN 'inproceedings' ELSE 'article' END END"


def _bib_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer")
    k = F.col("o_orderkey") % 4
    none = F.array().cast("array<string>")
    types = F.when(k == 0, F.array(F.lit("Other"), F.lit("JournalArticle"))).when(k == 1, F.array(F.lit("Conference"))).when(k == 2, F.array(F.lit("Book"))).otherwise(none)
    venue = F.when(F.col("o_orderpriority").endswith("HIGH"), _s("Workshop ", F.col("o_orderpriority"))).otherwise(F.col("o_orderpriority"))
    doi = F.when(F.col("o_orderkey") % 5 == 0, _s("10.1/", F.col("o_orderkey"))).otherwise("")
    joined = o.join(c, F.col("c_custkey") == F.col("o_custkey"))
    return joined.select(F.col("o_orderkey").alias("key"), bibtex.build_entry(_s("p", F.col("o_orderkey")), _s("Order ", F.col("o_orderkey")), F.array("c_name", F.lit("B, C")), F.year("o_orderdate"), venue, doi, types).alias("bibtex"))


@query(f"""
WITH r AS (SELECT *, {_KINDS} AS kind, CASE WHEN o_orderpriority LIKE '%HIGH' THEN 'Workshop ' || o_orderpriority ELSE o_orderpriority END AS venue FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT o_orderkey AS key, '@' || kind || '{{p' || o_orderkey || ',' || chr(10) || '  title = {{Order ' || o_orderkey || '}},' || chr(10) || '  author = {{' || c_name || ' and B, C}},' || chr(10) || '  year = {{' || year(o_orderdate) || '}},' || chr(10)
  || CASE kind WHEN 'article' THEN '  journal = {{' || venue || '}},' || chr(10) WHEN 'inproceedings' THEN '  booktitle = {{' || venue || '}},' || chr(10) ELSE '' END
  || CASE WHEN o_orderkey % 5 = 0 THEN '  doi = {{10.1/' || o_orderkey || '}},' || chr(10) ELSE '' END || '}}' AS bibtex
FROM r
""")
def bibtex_build(spark, sf_dir):
    return _bib_rows(spark, sf_dir)


@query(f"""
SELECT o_orderkey AS key, {_KINDS} AS type, 'q' || o_orderkey AS bib_key, 'Order ' || o_orderkey AS title, c_name || ' and B, C' AS author, CASE WHEN o_orderkey % 5 = 0 THEN '10.1/' || o_orderkey END AS doi
FROM orders JOIN customer ON c_custkey = o_custkey
""")
def bibtex_parse(spark, sf_dir):
    """Entries built, given another key, and parsed."""
    rows = _bib_rows(spark, sf_dir).withColumn("e", bibtex.parse_entry(bibtex.with_key(F.col("bibtex"), _s("q", F.col("key")))))
    return rows.select("key", "e.type", F.col("e.key").alias("bib_key"), *[F.try_element_at("e.fields", F.lit(f)).alias(f) for f in ("title", "author", "doi")])


@query("""
WITH s AS (SELECT p_partkey, 'p' || p_partkey AS pid, p_brand FROM part WHERE p_type LIKE '%STEEL' OR p_type = (SELECT min(p_type) FROM part)), p AS (SELECT p_partkey, 'p' || p_partkey AS pid FROM part WHERE p_size >= 25)
SELECT '% ' || pid || chr(10) || '@misc{' || pid || ',}' || chr(10) AS entry, pid AS paper_id, CASE WHEN p_partkey % 6 = 0 THEN NULL END AS issue FROM p WHERE p_partkey % 6 <> 0
UNION ALL SELECT NULL, pid, 'missing .bib file' FROM p WHERE p_partkey % 6 = 0
""")
def export_select(spark, sf_dir):
    """Papers of a field since a date, with their entries or what is wrong with them."""
    rows = _t(spark, sf_dir, "part")
    papers = rows.select(_s("p", F.col("p_partkey")).alias("stem"), F.lit("").alias("paper_id"), F.array(F.when(F.col("p_size") >= 25, "field/large").otherwise("field/small")).alias("tags"), F.lit("2025-03-04T00:00:00Z").alias("created"))
    bibs = rows.where("p_partkey % 6 <> 0").select(_s("p", F.col("p_partkey")).alias("paper_id"), _s("\n@misc{p", F.col("p_partkey"), ",}\n ").alias("bib"))
    return export.export_entries(papers, bibs, export.Selectors(field="large", since="2025-01-01")).select("entry", "paper_id", "issue")


# Pages -----------------------------------------------------------------------------------


@query(r"""SELECT page_id, replace(replace(replace(replace(trim(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '\s+', ' ', 'g')), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS title, length(html) < 1024 OR regexp_matches(html, '(?i)captcha|cf-challenge|verify you are (a )?human') AS blocked FROM pages""")
def html_meta(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", html.parse_page("html")["title"].alias("title"), text.blocked_page(F.col("html")).alias("blocked"))


@query()
def html_blocks(spark, sf_dir):
    """Sections and figures of every page under its site's rules."""
    pages = _t(spark, sf_dir, "pages").withColumn("d", html.extract_document("url", "html"))
    return pages.select("page_id", "d.title", F.size("d.sections").alias("n_sections"), F.size("d.figures").alias("n_figures"), F.to_json("d.sections").alias("sections"))


@query(r"""
WITH u AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://arxiv.org/abs/' || page_id WHEN 1 THEN 'https://www.mdpi.com/' || page_id WHEN 2 THEN 'http://link.springer.com/a?b=' || page_id WHEN 3 THEN 'https://notarxiv.org/x' ELSE url END AS url FROM pages)
SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'arxiv' WHEN 1 THEN 'mdpi' WHEN 2 THEN 'springer' END AS site FROM u
""")
def site_route(spark, sf_dir):
    k = F.col("page_id") % 5
    url = F.when(k == 0, _s("https://arxiv.org/abs/", F.col("page_id"))).when(k == 1, _s("https://www.mdpi.com/", F.col("page_id"))).when(k == 2, _s("http://link.springer.com/a?b=", F.col("page_id"))).when(k == 3, "https://notarxiv.org/x").otherwise(F.col("url"))
    return _t(spark, sf_dir, "pages").select("page_id", html.site_column(url).alias("site"))


@query("SELECT doc_id, '---' AS first, n_chars AS n FROM documents")
def header_parse(spark, sf_dir):
    """Documents under a YAML header, parsed back."""
    raw = _s("---\ntype: paper\npaper-id: 1706.03762\nn: ", F.col("n_chars"), "\ntags: [a, b]\n---\n", F.lit("body"))
    pages = corpus.parsed_pages(_t(spark, sf_dir, "documents").select(_s("wiki/papers/", F.col("doc_id"), ".md").alias("path"), raw.alias("raw")))
    return pages.where("error IS NULL AND body = 'body'").select(F.col("stem").cast("long").alias("doc_id"), F.left("raw", F.lit(3)).alias("first"), corpus.field("n").cast("long").alias("n"))


@query(r"""
SELECT p_partkey AS key, CASE WHEN p_partkey % 3 = 0 THEN 'doi-10.1_' || p_partkey WHEN p_partkey % 3 = 1 THEN 's2-' || left(sha256('r' || p_partkey), 8) END AS slug FROM part WHERE p_partkey % 3 < 2 AND p_partkey % 5 <> 0
""")
def record_stubs(spark, sf_dir):
    """Stub rows for payloads that are new and have an identifier."""
    k = F.col("p_partkey")
    payload = F.to_json(F.struct(F.array(F.struct(F.when(k % 3 < 2, _s("r", k)).alias("paperId"), F.col("p_name").alias("title"), F.struct(F.when(k % 3 == 0, _s("10.1/", k)).alias("DOI")).alias("externalIds"), k.cast("int").alias("citationCount"))).alias("data")))
    flat = records.search_results(_t(spark, sf_dir, "part").select(payload.alias("json")))
    slugs = _t(spark, sf_dir, "part").where("p_partkey % 5 = 0").select(F.when(k % 3 == 0, _s("doi-10.1_", k)).otherwise(_s("s2-", F.left(F.sha2(_s("r", k).cast("binary"), 256), F.lit(8)))).alias("slug"), F.when(k % 3 == 0, _s("https://doi.org/10.1/", k)).otherwise(_s("https://www.semanticscholar.org/paper/r", k)).alias("url"))
    new, _ = records.stubs(flat, slugs, F.lit("2026-01-01T00:00:00Z"))
    return new.select(F.get_json_object("header", "$['citation-count']").cast("long").alias("key"), "slug")


@query("""
WITH e AS (SELECT p_partkey AS seq, 'a' || (p_partkey % 50) AS paper_a, 'b' || p_size AS paper_b, 'contra-' || (p_partkey % 2) AS type FROM part), f AS (SELECT paper_a, paper_b, type, min(seq) AS seq FROM e GROUP BY ALL)
SELECT paper_a, paper_b, type, seq FROM f WHERE NOT (paper_a IN ('a1', 'a2') AND type = 'contra-1')
""")
def candidate_append(spark, sf_dir):
    """Report entries whose key is not in the report, first of each key."""
    k = F.col("p_partkey")
    entries = _t(spark, sf_dir, "part").select(k.alias("seq"), _s("a", k % 50).alias("paper_a"), _s("b", F.col("p_size")).alias("paper_b"), _s("contra-", k % 2).alias("type"), F.col("p_name").alias("description"), F.lit("q").alias("quote_a"), F.lit("r").alias("quote_b"), F.lit("x").alias("relationship"))
    there = entries.where("paper_a IN ('a1', 'a2') AND type = 'contra-1'")
    return sinks.candidate_report(entries, there).select("paper_a", "paper_b", "type", "seq")


@query("""
SELECT p_type AS field, array_to_string(list_transform(list_sort(list_distinct(list('p' || p_partkey))), lambda s: '- [[' || s || ']]'), chr(10)) AS links FROM part GROUP BY 1
""")
def index_page(spark, sf_dir):
    papers = _t(spark, sf_dir, "part").select(_s("p", F.col("p_partkey")).alias("stem"), F.array(_s("field/", F.col("p_type"))).alias("tags"))
    return sinks.index_page(papers)


# Incremental -----------------------------------------------------------------------------


@query("""
WITH w AS (SELECT CAST((row_number() OVER (ORDER BY event_id) - 1) // 300 + 1 AS INTEGER) AS wave, CASE WHEN event_type = 'error' OR event_id % 7 = 0 THEN 'failed' WHEN event_id % 11 = 0 THEN 'pending' ELSE 'ok' END AS status FROM events)
SELECT wave, count(*) AS n, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'pending') AS pending FROM w GROUP BY wave
""")
def wave_status(spark, sf_dir):
    k = F.col("event_id")
    status = F.when((F.col("event_type") == "error") | (k % 7 == 0), "failed").when(k % 11 == 0, "pending").otherwise("ok")
    return waves.wave_status(waves.waves(_t(spark, sf_dir, "events").select("event_id", status.alias("status")), "event_id", 300))


@query("""
SELECT o_orderkey AS key, CASE WHEN o_orderkey % 4 = 0 THEN 'failed' WHEN o_orderkey % 4 = 1 THEN 'ok' WHEN o_orderkey % 3 = 0 THEN 'pending' ELSE 'ok' END AS status FROM orders
""")
def status_update(spark, sf_dir):
    """A wave's results applied, then finished items without a page demoted."""
    o = _t(spark, sf_dir, "orders")
    old = o.select(F.col("o_orderkey").alias("key"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error"), F.lit(0).alias("attempts"))
    done = o.where("o_orderkey % 4 < 2").select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 4 == 0, "failed").otherwise("ok").alias("status"), F.lit("e").alias("error"))
    pages = o.where("o_orderkey % 3 <> 0 OR o_orderkey % 4 = 1").select(F.col("o_orderkey").alias("stem"))
    return waves.demoted(waves.updated_statuses(old, done), pages).select("key", "status")


# Renders ---------------------------------------------------------------------------------


@query("""
SELECT p_partkey AS key, '---' || chr(10) || 'type: venue' || chr(10) || 'name: "' || p_name || ' \\"X\\""' || chr(10) || 'slug: s' || p_partkey || chr(10) || 'venue-type: journal' || chr(10) || 'created: 2026-01-01' || chr(10) || 'updated: 2026-01-01' || chr(10)
  || 'papers:' || chr(10) || CASE WHEN p_size % 2 = 0 THEN '  - a' || chr(10) || '  - b' ELSE '  []' END || chr(10) || 'tags:' || chr(10) || '  - field/' || p_type || chr(10) || '---' || chr(10) || chr(10) || '# ' || p_name || ' "X"' || chr(10) || chr(10) || 'Its papers are listed in `papers:` above.' || chr(10) AS page
FROM part
""")
def venue_pages(spark, sf_dir):
    papers = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    page = text.venue_page(_s("s", F.col("p_partkey")), _s(F.col("p_name"), ' "X"'), F.lit("journal"), papers, F.array(_s("field/", F.col("p_type"))), F.lit(TODAY))
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), page.alias("page"))


@query("""
SELECT doc_id, '---' || chr(10) || 'title: "D' || doc_id || '"' || chr(10) || 'authors: [Ann Lee, ' || lang || ']' || chr(10) || 'inline_author: "Lee et al."' || chr(10) || 'paper-id: "d' || doc_id || '"' || chr(10) || 'identifiers:' || chr(10) || '  url: "' || source || '"' || chr(10)
  || 'year: 2020' || chr(10) || '---' || chr(10) || chr(10) || '## Body' || chr(10) || CASE WHEN text <> '' THEN text || chr(10) || chr(10) ELSE '' END || '![[fig1.png]]' || chr(10) || '*' || lang || '*' || chr(10) || chr(10) AS page
FROM documents
""")
def document_pages(spark, sf_dir):
    """Whole documents rendered as Markdown with a header and a figure."""
    none = F.lit(None).cast("string")
    meta = F.struct(_s("D", F.col("doc_id")).alias("title"), F.array(F.lit("Ann Lee"), F.col("lang")).alias("authors"), none.alias("doi"), none.alias("arxiv"), F.col("source").alias("url"), none.alias("date"), F.lit(2020).alias("year"), none.alias("venue"), F.array().cast("array<string>").alias("keywords"))
    block = lambda kind, t, f: F.struct(F.lit(kind).alias("type"), t.alias("text"), f.alias("figure_id"))
    sections = F.array(F.struct(F.lit("Body").alias("heading"), F.array(block("paragraph", F.col("text"), none), block("figure", none, F.lit("f"))).alias("content")))
    figures = F.array(F.struct(F.lit("f").alias("id"), F.lit("fig1.png").alias("filename"), F.col("lang").alias("caption"), F.lit(False).alias("failed")))
    return _t(spark, sf_dir, "documents").select("doc_id", text.document_markdown(meta, sections, figures, _s("d", F.col("doc_id"))).alias("page"))


@query("SELECT p_partkey AS key, CAST(unnest(range(1, 4)) AS INTEGER) AS no, p_name || '. Ref ' || unnest(range(1, 4)) AS reference FROM part")
def reference_extract(spark, sf_dir):
    """References listed in an extract's body."""
    name = F.col("p_name")
    body = _s("# T\n- not this\n\n## References\n\n1. ", name, ". Ref 1\n[2] ", name, ". Ref 2\n- ", name, ". Ref 3\n\n## Notes\n- nor this\n")
    found = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.posexplode(text.reference_lines(body)).alias("no", "reference"))
    return found.select("key", (F.col("no") + 1).alias("no"), "reference")


@query("SELECT o_orderkey AS stem, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus AS title FROM orders")
def papers_by_year(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_orderkey").alias("stem"), F.col("o_orderstatus").alias("title"))
    return sinks.papers_by_year(rows)


@query(r"""
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'wiki/papers/p' || page_id || '.md' WHEN 1 THEN 'wiki/../x' WHEN 2 THEN 'wikis/x' ELSE 'wiki' END AS path, page_id % 4 IN (0, 3) AS contained,
  CASE WHEN page_id % 4 = 0 THEN 'paper' END AS kind, CASE WHEN page_id % 4 = 0 THEN 'p' || page_id END AS key FROM pages
""")
def page_paths(spark, sf_dir):
    k = F.col("page_id") % 4
    path = F.when(k == 0, _s("wiki/papers/p", F.col("page_id"), ".md")).when(k == 1, "wiki/../x").when(k == 2, "wikis/x").otherwise("wiki")
    rows = _t(spark, sf_dir, "pages").select("page_id", path.alias("path")).withColumn("k", text.page_kind_and_key(F.col("path")))
    return rows.select("page_id", "path", text.inside(F.col("path"), F.lit("wiki/")).alias("contained"), "k.kind", "k.key")
