"""Queries of search: by text, by vector and by both."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.operators import backlinks, search
from scriptorium.plans.registry import _t, query

_SQL_TERMS = r"list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\p{{L}}\p{{Nd}}]+'), lambda t: t <> '')"
_SQL_POSTINGS = f"""
own AS (SELECT doc_id AS key, unnest({_SQL_TERMS.format("text")}) AS term FROM documents WHERE doc_id IS NOT NULL),
lengths AS (SELECT d.key, count(o.term) AS length FROM (SELECT DISTINCT doc_id AS key FROM documents WHERE doc_id IS NOT NULL) d LEFT JOIN own o USING (key) GROUP BY d.key),
sizes AS (SELECT count(*)::DOUBLE AS n, sum(length)::DOUBLE / count(*) AS mean FROM lengths),
counted AS (SELECT key, term, count(*)::DOUBLE AS tf FROM own GROUP BY key, term),
frequency AS (SELECT term, count(*)::DOUBLE AS df FROM counted GROUP BY term),
postings AS (
  SELECT term, key, floor(ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length::DOUBLE / mean)) * 65536::DOUBLE)::BIGINT AS impact
  FROM counted JOIN lengths USING (key) JOIN frequency USING (term), sizes
)"""


def _index(spark, sf_dir):
    return search.build_index(_t(spark, sf_dir, "documents"), "doc_id", "text").kept()


@query(f"""
WITH {_SQL_POSTINGS}, asked AS (
  SELECT query, term, count(*) AS weight FROM (SELECT item_id AS query, unnest({_SQL_TERMS.format("text")}) AS term FROM benchmark WHERE item_id IS NOT NULL) GROUP BY ALL
), scored AS (SELECT query, key, sum(weight * impact)::BIGINT AS score FROM asked JOIN postings USING (term) GROUP BY ALL)
SELECT query, key, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key)::INTEGER AS rank FROM scored) WHERE rank <= 10
""")
def search_bm25_topk(spark, sf_dir):
    """The ten best documents for each benchmark item by BM25, without scoring blocks that can't hold one."""
    return search.lexical(_t(spark, sf_dir, "benchmark"), "item_id", "text", _index(spark, sf_dir), 10)


@query(f"""
WITH {_SQL_POSTINGS}, v AS (
  SELECT vec_id AS key, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), asked AS (
  SELECT query, term, count(*) AS weight FROM (SELECT doc_id AS query, unnest({_SQL_TERMS.format("text")}) AS term FROM documents WHERE doc_id % 50 = 0) GROUP BY ALL
), words AS (
  SELECT query, key, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS rank FROM (SELECT query, key, sum(weight * impact) AS score FROM asked JOIN postings USING (term) WHERE query <> key GROUP BY ALL)
), near AS (
  SELECT query, key, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS rank FROM (
    SELECT a.key AS query, b.key, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS score FROM v a JOIN v b ON a.key <> b.key AND len(a.v) = len(b.v) WHERE a.key % 50 = 0)
), lists AS (
  SELECT query, key, max(rank) FILTER (l = 0) AS text_rank, max(rank) FILTER (l = 1) AS vector_rank
  FROM (SELECT query, key, rank, 0 AS l FROM words WHERE rank <= 50 UNION ALL SELECT query, key, rank, 1 FROM near WHERE rank <= 50) GROUP BY ALL
), fused AS (SELECT *, coalesce(1.0::DOUBLE / (60 + text_rank), 0) + coalesce(1.0::DOUBLE / (60 + vector_rank), 0) AS fused FROM lists)
SELECT query, key, rank, coalesce(text_rank, 0)::INTEGER AS text_rank, coalesce(vector_rank, 0)::INTEGER AS vector_rank
FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY fused DESC, key)::INTEGER AS rank FROM fused) WHERE rank <= 10
""")
def search_hybrid_topk(spark, sf_dir):
    """The ten best documents by text and embedding together, for each one whose id is divisible by 50; rank 0: not in a list."""
    docs, vectors = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    found = search.hybrid(docs.where("doc_id % 50 = 0"), vectors.where("doc_id % 50 = 0"), docs, vectors, "doc_id", "text", "embedding", index=_index(spark, sf_dir))
    return found.select("query", "key", "rank", *[F.coalesce(F.col("ranks")[n], F.lit(0)).alias(name) for n, name in enumerate(("text_rank", "vector_rank"))])




@query(f"""
WITH slugs AS (
  SELECT DISTINCT lower(regexp_extract(text, '^([A-Za-z]+) ([A-Za-z]+)(?:[^A-Za-z]|$)', 1)) || '-' || lower(regexp_extract(text, '^([A-Za-z]+) ([A-Za-z]+)(?:[^A-Za-z]|$)', 2)) AS slug
  FROM documents WHERE regexp_matches(text, '^[A-Za-z]+ [A-Za-z]+(?:[^A-Za-z]|$)')
), pages AS (SELECT 'd' || doc_id AS path, lower(text) AS text FROM documents WHERE text IS NOT NULL),
near AS (SELECT path, slug, text FROM pages JOIN slugs ON contains(text, replace(slug, '-', ' ')))
SELECT path, slug FROM near
WHERE regexp_matches(text, '(^|[^\\p{{L}}\\p{{N}}_])' || replace(slug, '-', ' ') || '($|[^\\p{{L}}\\p{{N}}_])')
""".replace("\\\\p", "\\p"))
def slug_mentions(spark, sf_dir):
    """The first two words of each document as a slug, wherever a document mentions it."""
    docs = _t(spark, sf_dir, "documents")
    first = r"^([A-Za-z]+) ([A-Za-z]+)(?:[^A-Za-z]|$)"
    word = lambda n: F.lower(F.regexp_extract("text", first, n))
    slugs = docs.where(F.col("text").rlike(first)).select(F.concat_ws("-", word(1), word(2)).alias("slug"))
    return backlinks.mentions(docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), "text"), slugs)
