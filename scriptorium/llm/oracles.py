"""SQL of the operators whose steps repeat: the text is put together step by step."""

from __future__ import annotations


def product_codes(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """DuckDB SQL of :func:`scriptorium.llm.vector_codes.compress` for vectors of one length that ``parts`` divides."""
    nearest = """
  SELECT row_no, part, min_by(entry, (d, entry)) AS entry, min(d) AS d FROM (
    SELECT x.row_no, x.part, b.entry,
           list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM cut x JOIN {book} b ON x.part = b.part
  ) GROUP BY row_no, part"""
    steps = [f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row_no, vec_id, label,
         list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cut AS MATERIALIZED (
  SELECT row_no, part, v[part * len(v) // {parts} + 1 : (part + 1) * len(v) // {parts}] AS v
  FROM kept, (SELECT unnest(range({parts})) AS part)
), book0 AS MATERIALIZED (SELECT part, row_no - 1 AS entry, v FROM cut WHERE row_no <= {entries})"""]
    for n in range(rounds):
        steps.append(f""", near{n} AS MATERIALIZED ({nearest.format(book=f"book{n}")}
), mean{n} AS (
  SELECT part, entry, list(m ORDER BY pos) AS v FROM (
    SELECT x.part, a.entry, pos, (sum(x.v[pos + 1]) - ((sum(x.v[pos + 1]) % count(*)) + count(*)) % count(*))::BIGINT // count(*) AS m
    FROM cut x JOIN near{n} a USING (row_no, part), (SELECT unnest(range((SELECT max(len(v)) FROM cut))) AS pos)
    GROUP BY x.part, a.entry, pos
  ) GROUP BY part, entry
), book{n + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM book{n} b LEFT JOIN mean{n} m USING (part, entry)
)""")
    steps.append(f""", last AS MATERIALIZED ({nearest.format(book=f"book{rounds}")}
), digest AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{rounds}
), coded AS (
  SELECT k.vec_id, k.label, string_agg(lower(lpad(to_hex(entry), 2, '0')), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
  FROM last JOIN kept k USING (row_no) GROUP BY row_no, k.vec_id, k.label
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, digest
""")
    return "".join(steps)


def kd_tree(shards: int = 24) -> str:
    """DuckDB SQL of :func:`scriptorium.llm.kd_sharding.kd_shards`; a text's crc32 goes byte by byte."""
    dims = ("at_source", "at_lang", "size", "at_doc_id")
    prefix = "('0x' || rpad(substr(hex(encode(coalesce({0}, ''))), 1, 14), 14, '0'))::BIGINT"
    extents = ", ".join(f"max({d})::DOUBLE - min({d})::DOUBLE AS w_{d}" for d in dims)
    shares = [f"w_{d} / greatest((SELECT max({d})::DOUBLE - min({d})::DOUBLE FROM l0), 1)" for d in dims]
    widest = "greatest(" + ", ".join(shares) + ")"
    steps = [f"""
WITH RECURSIVE bits AS (
  SELECT i, i AS c, 0 AS k FROM (SELECT unnest(range(256)) AS i)
  UNION ALL SELECT i, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), k + 1 FROM bits WHERE k < 8
), steps AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8
), raw AS (
  SELECT row_number() OVER () AS r, doc_id, source, lang, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents
), l0 AS MATERIALIZED (
  SELECT r, doc_id, strlen(text)::BIGINT + 8 AS size, coalesce(doc_id, 0)::BIGINT AS at_doc_id,
         {prefix.format("source")} AS at_source, {prefix.format("lang")} AS at_lang,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || text), 1, 12))::BIGINT AS tie,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)),
             lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295::BIGINT)::BIGINT AS text_crc32,
         0::BIGINT AS node, {shards}::BIGINT AS k
  FROM raw, steps
)"""]
    depth = max(1, (shards - 1).bit_length())
    for n in range(depth):
        choice = " ".join(f"WHEN {share} = {widest} THEN {d}" for d, share in enumerate(shares))
        steps.append(f""", s{n} AS (
  SELECT node AS node_, sum(size)::HUGEINT AS bytes, {extents} FROM l{n} GROUP BY node
), c{n} AS (
  SELECT l.*, bytes, CASE CASE {choice} END {" ".join(f"WHEN {d} THEN l.{name}" for d, name in enumerate(dims))} END AS c
  FROM l{n} l JOIN s{n} ON node = node_
), f{n} AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY node ORDER BY c, tie, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS first FROM c{n}
), l{n + 1} AS MATERIALIZED (
  SELECT r, doc_id, size, at_doc_id, at_source, at_lang, tie, text_crc32,
         CASE WHEN k = 1 OR 2 * first + size <= 2 * bytes * (k // 2) // k THEN node ELSE node + k // 2 END AS node,
         CASE WHEN k = 1 THEN 1 WHEN 2 * first + size <= 2 * bytes * (k // 2) // k THEN k // 2 ELSE k - k // 2 END AS k
  FROM f{n}
)""")
    steps.append(f"""
SELECT doc_id, size, text_crc32, 'bytes' AS law, node::INTEGER AS shard, row_number() OVER (PARTITION BY node ORDER BY r) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM l{depth}
""")
    return "".join(steps)
