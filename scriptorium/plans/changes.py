"""Queries of what changes over time: stored versions, checkpoints, streams of states, merges by field."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from scriptorium.operators import upserts
from scriptorium.plans.registry import _s, _t, query
from scriptorium.session import shared_folder
from scriptorium.sources.stored import StoredTable
from scriptorium.streaming import paper_states, seen
from scriptorium.streaming.checkpoints import Checkpoint


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("""
WITH v0 AS (SELECT o_orderkey AS key, o_orderstatus AS status FROM orders),
v1 AS (
  SELECT key, CASE WHEN key % 5 = 0 THEN 'X' ELSE status END AS status FROM v0
  UNION ALL SELECT -1 - o_orderkey, 'N' FROM orders WHERE o_orderkey % 7 = 0
), v2 AS (SELECT * FROM v1 WHERE abs(key) % 11 <> 0)
SELECT coalesce(v0.key, v2.key) AS key, v0.status AS before, v2.status AS after FROM v0 FULL JOIN v2 ON v0.key = v2.key
""")
def stored_versions(spark, sf_dir):
    """A table changed by a batch of updates and new rows, then by deletions: its first version beside its last."""
    orders = _t(spark, sf_dir, "orders")
    table = StoredTable.create(spark, _folder(spark, "orders"), orders.select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status")), "key", 16)
    news = orders.where("o_orderkey % 7 = 0").select((-1 - F.col("o_orderkey")).alias("key"), F.lit("N").alias("status"))
    table.merge(orders.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("key"), F.lit("X").alias("status")).union(news))
    table.delete(table.read().where("abs(key) % 11 = 0"))
    return table.read(0).withColumnRenamed("status", "before").join(table.read().withColumnRenamed("status", "after"), "key", "full")


@query("""
SELECT 'c' || c_custkey AS paper_id,
  CASE WHEN c_custkey % 3 = 0 THEN 'pending' WHEN c_custkey % 7 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'ok' ELSE 'failed' END ELSE 'ok' END AS status,
  CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 7 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'first' ELSE 'again' END END AS error,
  CASE WHEN c_custkey % 3 = 0 THEN -1 WHEN c_custkey % 7 = 0 THEN 2 ELSE c_custkey % 3 - 1 END::INTEGER AS wave,
  2::INTEGER AS last_wave, 'ok' AS final_pass
FROM customer
""")
def checkpoint_lifecycle(spark, sf_dir):
    """A full batch of two waves and a retry: each paper's status, its error and the last wave that named it (-1: none)."""
    papers = _t(spark, sf_dir, "customer").select(_s("c", F.col("c_custkey")).alias("paper_id"), F.col("c_custkey").alias("n"))
    batch = Checkpoint.create(spark, _folder(spark, "checkpoint"), papers, 60, tier="full")
    failed = F.when(F.col("n") % 7 == 0, "failed").otherwise("ok")
    for wave in (1, 2):
        done = papers.where(F.col("n") % 3 == wave).select("paper_id", failed.alias("status"), F.when(F.col("n") % 7 == 0, "first").alias("error"))
        batch.update(done, f"commit {wave}")
    retried = batch.papers().where("status = 'failed'").select("paper_id").join(papers, "paper_id")
    even = F.col("n") % 2 == 0
    batch.update(retried.select("paper_id", F.when(even, "ok").otherwise("failed").alias("status"), F.when(~even, "again").alias("error")), "commit 3")
    batch.final_pass("ok")
    run = batch.run()
    return batch.papers().select("paper_id", "status", "error", F.coalesce("wave", F.lit(-1)).alias("wave"), F.lit(run["last_completed_wave"]).alias("last_wave"), F.lit(run["final_pass_status"]).alias("final_pass"))


_STATUS = {"view": "in-progress", "purchase": "in-progress", "click": "ok", "error": "failed", "signup": "skipped"}


@query("""
WITH RECURSIVE e AS (
  SELECT user_id || '-' || (day(ts) - 1) // 7 AS key, row_number() OVER (PARTITION BY user_id, (day(ts) - 1) // 7 ORDER BY epoch_ms(ts), event_id) AS n, epoch_ms(ts) AS t,
         CASE event_type WHEN 'view' THEN 'in-progress' WHEN 'purchase' THEN 'in-progress' WHEN 'click' THEN 'ok' WHEN 'error' THEN 'failed' ELSE 'skipped' END AS new
  FROM events
), walk AS (
  SELECT key, 0::BIGINT AS n, 'pending' AS state, 0 AS attempts, NULL::BIGINT AS since, 0 AS n_changes, 0 AS n_refused FROM (SELECT DISTINCT key FROM e)
  UNION ALL
  SELECT key, n, CASE WHEN taken THEN new ELSE state END, CASE WHEN taken AND new = 'in-progress' THEN attempts + 1 ELSE attempts END,
         CASE WHEN NOT taken THEN since WHEN new = 'in-progress' THEN t END, n_changes + taken::INTEGER, n_refused + (NOT taken)::INTEGER
  FROM (
    SELECT *, CASE WHEN new = 'in-progress' THEN state IN ('pending', 'failed') AND attempts < 2 WHEN new = 'skipped' THEN state = 'pending' ELSE state = 'in-progress' END AS taken
    FROM (
      SELECT w.key, e.n, e.new, e.t, CASE WHEN stale THEN 'pending' ELSE state END AS state, attempts - stale::INTEGER AS attempts, CASE WHEN NOT stale THEN since END AS since, n_changes + stale::INTEGER AS n_changes, n_refused
      FROM (SELECT *, coalesce(state = 'in-progress' AND (SELECT t FROM e WHERE e.key = walk.key AND e.n = walk.n + 1) > since + 86400000, false) AS stale FROM walk) w JOIN e ON e.key = w.key AND e.n = w.n + 1
    )
  )
), last AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC) = 1),
ended AS (SELECT *, coalesce(state = 'in-progress' AND since + 86400000 < (SELECT max(t) FROM e), false) AS stale FROM last)
SELECT key, CASE WHEN stale THEN 'pending' ELSE state END AS status, attempts - stale::INTEGER AS attempts, (n_changes + stale::INTEGER)::BIGINT AS n_changes, n_refused::BIGINT AS n_refused FROM ended
""")
def paper_state_stream(spark, sf_dir):
    """Events as status changes of papers (a user's week each), through a stream that keeps each paper's state."""
    schema = _t(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    status = F.create_map(*[F.lit(x) for pair in _STATUS.items() for x in pair])[F.col("event_type")]
    key = F.concat_ws("-", F.col("user_id").cast("string"), F.floor((F.dayofmonth("ts") - 1) / 7).cast("string"))
    changes = events.select(key.alias("key"), status.alias("status"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"))
    folder = _folder(spark, "states")
    paper_states.run_states(changes, f"{folder}/changes", f"{folder}/checkpoint").awaitTermination()
    made = spark.read.schema(paper_states.CHANGES).parquet(f"{folder}/changes/*")
    now = _t(spark, sf_dir, "events").agg(F.max(F.unix_millis(F.col("ts").cast("timestamp")))).first()[0]
    return paper_states.last_states(made, F.lit(now))


@query("""
WITH d AS (SELECT doc_id, doc_id % 4 AS batch, 'd' || doc_id AS path, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL),
first AS (SELECT sha256, min(batch) AS batch FROM d GROUP BY sha256)
SELECT sha256, d.batch, min(path) AS path FROM d JOIN first USING (sha256, batch) GROUP BY ALL
""")
def seen_sources(spark, sf_dir):
    """Documents in four batches, the second of which comes twice: what each batch brought that no other had."""
    docs = _t(spark, sf_dir, "documents").select(_s("d", F.col("doc_id")).alias("path"), F.col("text").alias("content"), (F.col("doc_id") % 4).alias("batch"))
    table = seen.seen_table(spark, _folder(spark, "seen"), 16)
    for number in (0, 1, 1, 2, 3):
        seen.absorb(table, docs.where(F.col("batch") == number), number)
    return table.read()


_SIDES = """
WITH p AS (SELECT p_partkey AS key, p_name AS name, p_brand AS brand, p_size AS size, p_partkey % 12 AS k FROM part),
b AS (SELECT key, name, brand, size, ['a', 'b'] AS tags FROM p WHERE k <> 7),
s AS (SELECT key, CASE WHEN k % 3 = 0 THEN 'user ' || name ELSE name END AS name, brand, CASE WHEN k = 5 THEN NULL ELSE size END AS size, CASE WHEN k = 4 THEN ['b', 'mine'] ELSE ['a', 'b'] END AS tags FROM p WHERE k NOT IN (7, 8)),
i AS (SELECT key, CASE WHEN k % 2 = 0 THEN 'new ' || name ELSE name END AS name, lower(brand) AS brand, size, CASE WHEN k % 4 = 0 THEN ['a', 'b', 'their'] ELSE ['a', 'b'] END AS tags FROM p WHERE k <> 9)
"""


def _sides(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), (F.col("p_partkey") % 12).alias("k"))
    tags = lambda *x: F.array(*map(F.lit, x))
    two, k = tags("a", "b"), F.col("k")
    base = p.where("k <> 7").select("key", "name", "brand", "size", two.alias("tags"))
    stored = p.where("k NOT IN (7, 8)").select("key", F.when(k % 3 == 0, _s("user ", F.col("name"))).otherwise(F.col("name")).alias("name"), "brand", F.when(k != 5, F.col("size")).alias("size"), F.when(k == 4, tags("b", "mine")).otherwise(two).alias("tags"))
    incoming = p.where("k <> 9").select("key", F.when(k % 2 == 0, _s("new ", F.col("name"))).otherwise(F.col("name")).alias("name"), F.lower("brand").alias("brand"), "size", F.when(k % 4 == 0, tags("a", "b", "their")).otherwise(two).alias("tags"))
    return upserts.three_way(base, stored, incoming, "key", ["name", "brand", "size", "tags"], unions=("tags",))


@query(f"""{_SIDES}
SELECT s.key, CASE WHEN i.key IS NULL THEN s.name WHEN i.name = b.name THEN s.name WHEN s.name = b.name THEN i.name ELSE s.name END AS name, coalesce(i.brand, s.brand) AS brand, coalesce(s.size, -1) AS size,
  array_to_string(CASE WHEN i.key IS NULL THEN s.tags ELSE list_filter(s.tags || list_filter(i.tags, lambda t: NOT list_contains(s.tags, t)), lambda t: NOT (list_contains(b.tags, t) AND NOT (list_contains(s.tags, t) AND list_contains(i.tags, t)))) END, ',') AS tags,
  CASE WHEN i.key IS NULL THEN 'kept' ELSE 'merged' END AS origin
FROM s LEFT JOIN i USING (key) LEFT JOIN b USING (key)
UNION ALL SELECT i.key, i.name, i.brand, i.size, array_to_string(i.tags, ','), 'new' FROM i WHERE key NOT IN (SELECT key FROM s) AND key NOT IN (SELECT key FROM b)
""")
def field_merge(spark, sf_dir):
    """Three tables merged field by field: what a user corrected stays, what only came in is taken."""
    return _sides(spark, sf_dir)[0].withColumn("tags", F.array_join("tags", ",")).withColumn("size", F.coalesce("size", F.lit(-1)))


@query(f"{_SIDES} SELECT s.key, 'name' AS field, b.name AS base, s.name AS stored, i.name AS incoming FROM s JOIN i USING (key) JOIN b USING (key) WHERE s.name <> i.name AND i.name <> b.name AND s.name <> b.name")
def field_conflicts(spark, sf_dir):
    """Fields that the user and the incoming records changed in different ways."""
    return _sides(spark, sf_dir)[1]


_SQL_PAPERS = "SELECT 'p' || o_orderkey AS paper_id, o_orderkey AS seq, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 'Journal of ' || o_orderpriority END AS venue, 'field/' || o_orderstatus AS field FROM orders"
_SQL_SLUG = "trim(regexp_replace(lower(replace(venue, 'Journal of ', 'journal-of-')), '[^a-z0-9]+', '-', 'g'), '-')"
_SQL_STORED = f"stored AS (SELECT DISTINCT {_SQL_SLUG} AS slug, 'Their ' || venue AS name, 'conference' AS venue_type, '2020-01-01' AS created, '2020-01-02' AS updated FROM news WHERE venue LIKE '%1%' OR venue LIKE '%2%')"


@query(f"""
WITH news AS ({_SQL_PAPERS}), {_SQL_STORED},
old AS (SELECT slug, paper_id, place FROM stored, (VALUES ('p1', 1), ('mine', 2)) AS x(paper_id, place)),
fresh AS (SELECT slug, paper_id, row_number() OVER (PARTITION BY slug ORDER BY seq) AS nth FROM (SELECT {_SQL_SLUG} AS slug, paper_id, seq FROM news WHERE venue IS NOT NULL) n ANTI JOIN old USING (slug, paper_id))
SELECT slug, coalesce(s.name, f.venue) AS name, coalesce(s.venue_type, 'journal') AS venue_type, coalesce(s.created, '2026-01-01') AS created, '2026-01-01' AS updated, paper_id, place
FROM (SELECT slug, paper_id, place FROM old UNION ALL SELECT slug, paper_id, nth + (SELECT count(*) FROM old WHERE old.slug = fresh.slug) FROM fresh) m
LEFT JOIN stored s USING (slug) LEFT JOIN (SELECT {_SQL_SLUG} AS slug, min(venue) AS venue FROM news WHERE venue IS NOT NULL GROUP BY ALL) f USING (slug)
""")
def venue_upsert(spark, sf_dir):
    """Venues after a batch of papers: pages that a user had corrected keep their fields, members go after those there."""
    orders = _t(spark, sf_dir, "orders")
    venue = F.when(F.col("o_orderkey") % 13 != 0, _s("Journal of ", F.col("o_orderpriority")))
    papers = orders.select(_s("p", F.col("o_orderkey")).alias("paper_id"), F.col("o_orderkey").alias("seq"), venue.alias("venue"), F.array(_s("field/", F.col("o_orderstatus")), F.lit("method/x")).alias("tags"))
    own = upserts.venue_contributions(papers.where("venue LIKE '%1%' OR venue LIKE '%2%'")).select("slug", "name").distinct()
    pages = own.select("slug", _s("Their ", F.col("name")).alias("name"), F.lit("conference").alias("venue_type"), F.lit("2020-01-01").alias("created"), F.lit("2020-01-02").alias("updated"))
    members = pages.select("slug", F.explode(F.array(F.struct(F.lit("p1").alias("paper_id"), F.lit(1).cast("long").alias("place")), F.struct(F.lit("mine").alias("paper_id"), F.lit(2).cast("long").alias("place")))).alias("x")).select("slug", "x.*")
    tags = pages.select("slug", F.lit("field/F").alias("tag"), F.lit(1).cast("long").alias("place"))
    after, listed, _ = upserts.upsert_venues(pages, members, tags, papers, F.lit("2026-01-01"))
    return listed.join(after, "slug").select("slug", "name", "venue_type", "created", "updated", "paper_id", "place")
