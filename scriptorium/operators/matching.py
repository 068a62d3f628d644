"""Matching records: identifiers, content hashes, tags, references, near-equal keys."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.functions.arrays import with_prefix
from scriptorium.functions.similarity import letter_counts, letters_bound, sequence_ratio
from scriptorium.functions.text import normalized_identifier
from scriptorium.operators.references import reference_matches  # noqa: F401  it has a module of its own
from scriptorium.session import stored

ROUND_ROWS = 50_000_000  # places and segments of texts on the disk at a time
RARE_KEYS = 20_000  # keys of all rare lengths together: their side of a join is broadcast
BROADCAST_TAILS = 500_000


def identifier_matches(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """``(key, match)``: for each incoming record the smallest existing id that shares an identifier.

    Both have ``key`` and ``identifiers`` (kind to value). An OR over kinds becomes one equi
    join on (kind, normal form).
    """

    def exploded(df: DataFrame, name: str) -> DataFrame:
        each = df.select(F.col("key").alias(name), F.explode("identifiers").alias("kind", "value")).where("value <> ''")
        return each.select(name, "kind", normalized_identifier(F.col("kind"), F.col("value")).alias("norm"))

    known = exploded(existing, "match").groupBy("kind", "norm").agg(F.min("match").alias("match"))
    return exploded(incoming, "key").join(known, ["kind", "norm"]).groupBy("key").agg(F.min("match").alias("match"))


def content_duplicates(rows: DataFrame, key: str, content: str) -> DataFrame:
    """``(key, sha256, first_key, n_copies)`` by content hash; contents do not move."""
    hashed = rows.select(key, F.sha2(F.col(content).cast("binary"), 256).alias("sha256"))
    groups = hashed.groupBy("sha256").agg(F.min(key).alias("first_key"), F.count("*").alias("n_copies"))
    return hashed.join(groups, "sha256").select(key, "sha256", "first_key", "n_copies")


def tag_neighbours(probes: DataFrame, candidates: DataFrame, k: int = 20) -> DataFrame:
    """``(key, neighbour, shared, year, rank)``: the k candidates that share most tags.

    Both have ``key``, ``tags`` and ``year``; only field and method tags count, once each. Ties
    go to the later year, then the smaller key. Candidates of the same tags share as many with any
    probe, so only the first k + 1 keys of each set of tags (a probe may be one itself) meet the sets of
    the probes, and a set's first k + 1 meet its probes. A set that shares fewer tags than one of k + 1 keys
    isn't met at all.
    """
    tags = F.array_sort(F.array_distinct(with_prefix(F.col("tags"), "field/", "method/")))
    rows = lambda df: df.where("key IS NOT NULL").select("key", F.coalesce(F.col("year").try_cast("int"), F.lit(0)).alias("year"), F.explode(tags).alias("tag"))
    sets = lambda df, *by: df.groupBy(*by).agg(F.array_sort(F.collect_list("tag")).alias("tags"))  # noqa: E731  a repeated row's tags count again

    def first_keys(df: DataFrame, by: str, *order: Column) -> DataFrame:
        """Rows of the first k + 1 keys in each group; a key has a row a year."""
        new = (F.row_number().over(W.partitionBy(by, "neighbour").orderBy(*order)) == 1).cast("int")
        at = F.sum("new").over(W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
        return df.withColumn("new", new).withColumn("at", at).where(F.col("at") <= k + 1).drop("new")

    asked = sets(rows(probes), "key")
    own = first_keys(sets(rows(candidates), F.col("key").alias("neighbour"), "year"), "tags", F.desc("year"), F.col("neighbour"))
    wanted = asked.select(F.col("tags").alias("wanted")).distinct()
    held = own.groupBy(F.col("tags").alias("held")).agg(F.max("at").alias("keys"))
    meet = wanted.select("wanted", F.explode("wanted").alias("tag")).join(held.select("held", "keys", F.explode("held").alias("tag")), "tag")
    shared = meet.groupBy("wanted", "held", "keys").agg(F.count("*").alias("shared"))
    enough = F.max(F.when(F.col("keys") > k, F.col("shared"))).over(W.partitionBy("wanted"))
    shared = shared.withColumn("enough", enough).where(F.col("shared") >= F.coalesce("enough", F.lit(0))).drop("enough", "keys")
    order = F.desc("shared"), F.desc("year"), F.col("neighbour")
    best = first_keys(shared.join(own.select(F.col("tags").alias("held"), "neighbour", "year"), "held"), "wanted", *order).drop("at", "held")
    near = asked.join(best.withColumnRenamed("wanted", "tags"), "tags").where(F.col("key") != F.col("neighbour"))
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("key").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("key", "neighbour", "shared", "year", "rank")


def near_duplicate_keys(keys: DataFrame, threshold: float = 0.92, same_tail: float = 0.80) -> DataFrame:
    """``(a, b, similarity)`` with a < b: ratio at the threshold, or at ``same_tail`` with equal last words.

    Keys are hyphenated. Pairs meet by equi joins that lose none: a ratio of t leaves at most
    (1 - t) * (both lengths) unmatched characters. Where that is one, or one of each of two equal
    lengths, texts meet with a character taken out; else on segments, of which one stands whole in the other
    text at a place that the unmatched ones before it fix (:func:`_segment_pairs`). Pairs at the lower threshold
    meet on their last word and a length in reach. An edit distance within the unmatched characters is asked for
    where pairs meet, so that only pairs near the threshold move on. Segments of many keys meet in rounds, each
    with its share of the segments' hashes, so that the disk holds one round at a time. Sides with a row a place
    or a segment are broadcast for rare lengths only: files say how large the keys are, not how many rows are made of them.
    """
    own = stored(keys.where("key IS NOT NULL").select("key").distinct())
    own = own.select("key", _spaced("key").alias("text"), F.length("key").alias("size"), F.element_at(F.split("key", "-"), -1).alias("tail"))
    sizes = F.broadcast(own.select("size").distinct())  # a row a length
    by_shape = _shortened_pairs(own, threshold).union(_segment_pairs(own, threshold))
    longer = own.where("tail <> key").select("tail").distinct()  # two keys of one word never share their tail
    longer = F.broadcast(longer) if longer.count() <= BROADCAST_TAILS else longer
    tailed = own.where("tail <> ''").select("key", "size", "tail")
    by_tail = _tail_pairs(tailed.join(longer, "tail", "left_semi"), sizes, same_tail)
    pairs = by_shape.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(by_tail).distinct()
    side = lambda n: [_spaced(n).alias(f"{n}_text"), F.length(n).alias(f"{n}_size"), F.element_at(F.split(n, "-"), -1).alias(f"{n}_tail")]
    both = pairs.select("a", "b", *side("a"), *side("b"))
    tails = (F.col("a_tail") == F.col("b_tail")) & (F.col("a_tail") != "")
    need = F.when(tails, F.lit(same_tail)).otherwise(F.lit(threshold))
    likely = both.where(letters_bound(letter_counts(F.col("a_text")), letter_counts(F.col("b_text")), F.col("a_size"), F.col("b_size")) >= need)
    scored = likely.withColumn("similarity", sequence_ratio("a_text", "b_text")).where(F.col("similarity") >= need)
    return scored.select("a", "b", "similarity")


def _spaced(key: str) -> Column:
    return F.replace(F.col(key), F.lit("-"), F.lit(" "))


def _longest(size: Column, threshold: float) -> Column:
    """The longest text that one of this length can have a ratio at the threshold with."""
    return F.floor(size * (2 - threshold) / threshold + 1e-9).cast("int")


def _shortest(size: Column, threshold: float) -> Column:
    return F.ceil(size * threshold / (2 - threshold) - 1e-9).cast("int")


def _unmatched(a: Column, b: Column, threshold: float) -> Column:
    """Most unmatched characters of two texts of these lengths; matched ones come in twos."""
    most = F.floor((1 - threshold) * (a + b) + 1e-9).cast("int")
    return most - F.pmod(most + a + b, F.lit(2))


def _close(threshold: float) -> Column:
    """Whether as many edits as unmatched characters make ``b`` of ``a``: each is one edit at most."""
    return F.call_function("levenshtein", _spaced("a"), _spaced("b"), _unmatched(F.length("a"), F.length("b"), threshold)) >= 0


def _tail_pairs(own: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    a = own.select(F.col("key").alias("a"), "tail", F.explode(F.sequence(_shortest(F.col("size"), threshold), _longest(F.col("size"), threshold))).alias("size"))
    met = a.join(sizes, "size", "left_semi").join(own.select(F.col("key").alias("b"), "tail", "size"), ["tail", "size"])
    return met.where("a < b").where(_close(threshold)).select("a", "b")


def _shortened_pairs(own: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose lengths allow one unmatched character, or two of equal lengths: they meet with one taken out."""
    size = F.col("size")
    alone, twice = _unmatched(size - 1, size, threshold) == 1, _unmatched(size, size, threshold) == 2
    cut = lambda i: F.concat(F.substring(F.col("text"), F.lit(1), i - 1), F.substring(F.col("text"), i + 1, size))
    short = own.where((size > 0) & (alone | twice)).select("key", alone.alias("alone"), twice.alias("twice"), F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), size), cut))).alias("text"))
    one = own.select(F.col("key").alias("a"), "text").join(short.where("alone").select(F.col("key").alias("b"), "text").hint("merge"), "text")
    half = short.where("twice").select("key", "text")
    two = half.select(F.col("key").alias("a"), "text").join(half.select(F.col("key").alias("b"), "text").hint("merge"), "text").where("a < b")
    return one.where("a <> b").select("a", "b").union(two.select("a", "b"))


def _segment_pairs(own: DataFrame, threshold: float) -> DataFrame:
    """Pairs of which the longer text has a segment that stands whole in the shorter one."""
    lengths = own.groupBy("size").agg(F.count("*").alias("n"))  # a row a length
    rare = F.sum("n").over(W.orderBy("n", "size").rowsBetween(W.unboundedPreceding, W.currentRow)) <= RARE_KEYS
    sizes = F.broadcast(stored(lengths.select("size", rare.alias("rare"))))
    probes, pieces = _segments(own.join(sizes, "size"), sizes, threshold)

    def meet(probes: DataFrame, pieces: DataFrame) -> DataFrame:
        return probes.join(pieces, "met").where((F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))).where(_close(threshold)).select("a", "b")

    few = meet(F.broadcast(probes.where("a_rare")), pieces.where("a_rare")).union(meet(probes.where("b_rare AND NOT a_rare"), F.broadcast(pieces.where("b_rare AND NOT a_rare"))))
    probes, pieces = probes.where("NOT a_rare AND NOT b_rare"), pieces.where("NOT a_rare AND NOT b_rare")
    rounds = math.ceil((probes.count() + pieces.count()) / ROUND_ROWS)
    if rounds <= 1:
        return few.union(meet(probes, pieces.hint("merge")))
    for nth in range(rounds):  # a segment meets its like in one round
        mine = F.pmod("met", F.lit(rounds)) == nth
        few = few.union(stored(meet(probes.where(mine), pieces.where(mine).hint("merge"))))
    return few


def _segments(own: DataFrame, sizes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Places of the shorter texts (``a, met``) and segments of the longer ones (``b, met``) that may be the same.

    Both tell if the shorter texts' or the longer ones' length is ``rare`` (``a_rare, b_rare``; none is where that isn't given).

    Of d unmatched characters each belongs to the segment of the longer text where it is or where it
    would go. Of d + 1 segments there is an ith (from 0) without any and with just i before it: the first
    after which the unmatched so far are fewer than the segments. So it stands off its place by x - (i - x)
    where x of them are of the shorter text. Segments meet by a hash.
    """
    size, d, i, x = F.col("size"), F.col("d"), F.col("i"), F.col("x")
    own, sizes = (df if "rare" in df.columns else df.withColumn("rare", F.lit(False)) for df in (own, sizes))

    def spans(name: str, other: str, first: Column, last: Column, a: str, b: str) -> DataFrame:
        each = own.where(size > 0).select(F.col("key").alias(name), "text", F.col("size").alias("own"), F.col("rare").alias(f"{name}_rare"), F.explode(F.sequence(first, last)).alias("size"))
        each = each.join(sizes.withColumnRenamed("rare", f"{other}_rare"), "size")
        each = each.select(name, "text", "a_rare", "b_rare", F.col(a).alias("a_size"), F.col(b).alias("b_size"), _unmatched(F.col(a), F.col(b), threshold).alias("d"))
        slow = (d > 2) | ((d == 2) & (F.col("a_size") < F.col("b_size")))  # the others meet with a character taken out
        return each.where(slow & (d >= F.col("b_size") - F.col("a_size"))).select("*", F.explode(F.sequence(F.lit(0), d)).alias("i"))

    start = F.floor(i * F.col("b_size") / (d + 1)).cast("int")
    stop = F.floor((i + 1) * F.col("b_size") / (d + 1)).cast("int")
    met = lambda at: F.xxhash64("a_size", "b_size", "i", F.substring(F.col("text"), at + 1, stop - start)).alias("met")
    pieces = spans("b", "a", _shortest(size, threshold), size, "size", "own").select("b", met(start), "a_rare", "b_rare")
    of_a, of_b = ((d + F.col("a_size") - F.col("b_size")) / 2).cast("int"), ((d + F.col("b_size") - F.col("a_size")) / 2).cast("int")
    probes = spans("a", "b", size, _longest(size, threshold), "own", "size").where(F.greatest(F.lit(0), i - of_b) <= F.least(i, of_a))
    probes = probes.select("*", F.explode(F.sequence(F.greatest(F.lit(0), i - of_b), F.least(i, of_a))).alias("x")).withColumn("at", start + 2 * x - i)
    return probes.where((F.col("at") >= 0) & (F.col("at") + stop - start <= F.col("a_size"))).select("a", met(F.col("at")), "a_rare", "b_rare"), pieces


def text_hits(pages: DataFrame, *nouns: str) -> DataFrame:
    """Pages whose body has any of the nouns, case aside."""
    low = F.lower("body")
    found = F.lit(False)
    for noun in nouns:
        found = found | low.contains(noun.lower())
    return pages.where(found)


def search_hits(pages: DataFrame, index: DataFrame, *nouns: str) -> DataFrame:
    """Keys hit in the text or listed by the index (``key`` and ``title``), once each."""
    listed = index.where(F.exists(F.array(*[F.lit(n.lower()) for n in nouns]), lambda n: F.contains(F.lower("title"), n))).select("key")
    return text_hits(pages, *nouns).select("key").union(listed).distinct()
