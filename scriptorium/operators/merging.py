"""Grouped merges: upserts, votes, unions with precedence, collision suffixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def majority(rows: DataFrame, group: str, value: str, weight: str, key: str) -> DataFrame:
    """``(group, value)``: the commonest value; ties to the member of most weight, then smallest key.

    Votes are counted per value first, so a large group is never sorted in one task.
    """
    votes = rows.groupBy(group, value).agg(F.count("*").alias("n"), F.min(F.struct((-F.col(weight)).alias("w"), F.col(key).alias("k"))).alias("best"))
    order = F.struct((-F.col("n")).alias("n"), F.col("best"))
    return votes.groupBy(group).agg(F.min_by(value, order).alias(value))


def first_of_union(frames: list[DataFrame], key: str, order: list[Column], limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, total): the union deduplicated by key, first frame first, ordered and cut.

    ``total`` has the number of rows before the limit. Frames carry ``pos``, the order of
    arrival within each, which breaks ties in both steps.
    """
    every = None
    for i, frame in enumerate(frames):
        part = frame.withColumn("source_no", F.lit(i))
        every = part if every is None else every.unionByName(part)
    best = every.groupBy(key).agg(F.min_by(F.struct(*[c for c in every.columns if c != key]), F.struct("source_no", "pos")).alias("row")).select(key, "row.*")
    total = best.agg(F.count("*").alias("total_found"))
    ranked = best.orderBy(*order, "source_no", "pos")
    return (ranked.limit(limit) if limit is not None else ranked), total


def identifier_fill(existing: DataFrame, incoming: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Existing records with absent fields filled from the incoming ones."""
    new = incoming.select(key, *[F.col(f).alias(f"_new_{f}") for f in fields])
    kept = [c for c in existing.columns if c not in fields]
    return existing.join(new, key, "left").select(*kept, *[F.coalesce(F.when(F.col(f) != "", F.col(f)), F.col(f"_new_{f}")).alias(f) for f in fields])


def upsert_entities(existing: DataFrame, contributions: DataFrame, today: Column) -> DataFrame:
    """Entity pages after all contributions of a batch, one row a (kind, slug).

    Contributions have ``kind, slug, seq, paper_id, title, tags, text``; existing pages
    ``kind, slug, status, created, sources, tags, body``. The first contribution to an absent
    page makes it; later ones add their source and tags once and an attributed paragraph, in
    ``seq`` order. Grouping all of a key's contributions replaces locks.
    """
    item = F.struct("seq", "paper_id", "title", "tags", "text")
    grouped = contributions.groupBy("kind", "slug").agg(F.array_sort(F.collect_list(item)).alias("items"))
    old = existing.select("kind", "slug", F.col("status").alias("_status"), F.col("created").alias("_created"), F.col("sources").alias("_sources"), F.col("tags").alias("_tags"), F.col("body").alias("_body"))
    both = grouped.join(old, ["kind", "slug"], "full")
    none = F.array().cast("array<string>")
    items, fresh = F.coalesce("items", F.array().cast(grouped.schema["items"].dataType)), F.col("_body").isNull()
    first = F.get(items, F.lit(0))
    start = F.concat(F.lit("# "), first["title"], F.lit("\n\n## Definition\n\n"), first["text"], F.lit("\n\n## Details\n\n## See Also\n\n## Counter-Arguments and Gaps\n"))
    later = F.when(fresh, F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0)))).otherwise(items)
    body = F.aggregate(later, F.when(fresh, start).otherwise(F.col("_body")), lambda acc, i: F.concat(F.regexp_replace(acc, r"(?U)\s+$", ""), F.lit("\n\nFrom [["), i["paper_id"], F.lit("]]: "), i["text"], F.lit("\n")))
    changed = F.size(items) > 0
    return both.select(
        "kind",
        "slug",
        F.coalesce("_status", F.when(F.col("kind") == "open-problem", "open").otherwise("active")).alias("status"),
        F.coalesce("_created", today.cast("string")).alias("created"),
        F.when(changed, today.cast("string")).alias("updated"),
        F.array_distinct(F.concat(F.coalesce("_sources", none), F.transform(items, lambda i: i["paper_id"]))).alias("sources"),
        F.array_distinct(F.concat(F.coalesce("_tags", none), F.flatten(F.transform(items, lambda i: i["tags"])))).alias("tags"),
        body.alias("body"),
        fresh.alias("is_new"),
    )


def collision_free(proposed: DataFrame, taken: DataFrame) -> DataFrame:
    """``(seq, base, key)``: each proposed id with the first free suffix "", 2, 3, ...

    Proposals have ``seq`` (arrival) and ``base``; ``taken`` has ``key``. Within a base the nth
    arrival takes the nth free suffix: that is n plus the numbers in use below it. The jth
    number in use has (itself - j) free ones below, so it counts where that is under n, and one
    running count in that order serves all arrivals of a base. A proposal may equal a taken id of
    another base with a digit at its end; that is in use too.
    """
    bases = proposed.select("base").distinct()
    stem = taken.select("key").distinct().select(
        F.explode(F.array(F.struct(F.col("key").alias("base"), F.lit(1).alias("n")), *[F.struct(F.expr(f"left(key, length(key) - {d})").alias("base"), F.expr(f"try_cast(right(key, {d}) AS int)").alias("n")) for d in range(1, 7)])).alias("x")
    ).select("x.*")
    used = stem.where("n IS NOT NULL AND base <> ''").where("n >= 1").join(bases, "base", "left_semi").distinct()
    nth = lambda by: F.row_number().over(W.partitionBy("base").orderBy(by))
    in_use = used.select(F.lit(None).alias("seq"), "base", (F.col("n") - nth("n")).alias("place"), F.lit(1).alias("used"))
    arrivals = proposed.select("seq", "base", nth("seq").alias("place"), F.lit(0).alias("used"))
    below = W.partitionBy("base").orderBy("place", "used").rowsBetween(W.unboundedPreceding, W.currentRow)  # an arrival is before the numbers of its own place
    numbered = arrivals.union(in_use).withColumn("number", F.col("place") + F.sum("used").over(below)).where("used = 0")
    return numbered.select("seq", "base", F.when(F.col("number") == 1, F.col("base")).otherwise(F.concat("base", F.col("number").cast("string"))).alias("key"))


def source_tags(entities: DataFrame, papers: DataFrame) -> DataFrame:
    """``(key, tags)``: field and subfield tags of an entity's sources, sorted."""
    edges = entities.select("key", F.explode("sources").alias("paper_id"))
    tags = papers.select("paper_id", F.explode("tags").alias("tag")).where("tag LIKE 'field/%' OR tag LIKE 'subfield/%'")
    return edges.join(tags, "paper_id").groupBy("key").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def latest_version(versions: DataFrame, key: str = "paper_id") -> DataFrame:
    """The last version of each record: ``max_by`` needs no sort."""
    return versions.groupBy(key).agg(F.max_by("version", "ordinal").alias("version"), F.count("*").alias("n_versions"))
