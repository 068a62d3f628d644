"""References matched to papers: an exact similarity join on the token-set ratio.

The ratio is the best of three: common tokens against each side, and the two sides (their tokens
sorted and joined). A pair at the threshold is found by one of two joins, and none is lost.

* Common tokens against a side of weight W (its tokens' lengths with their spaces): the
  tokens that are not common weigh (1 - f) * (W - 1) at most, f = t / (2 - t). So of a side's rarest
  tokens that weigh more, its prefix, one is common. Each side's prefix meets the other side's
  tokens; rarity is that on the other side, so a prefix of tokens that it doesn't have meets nothing.
* Side against side: typos may leave no token in common. Their lengths are within a factor f, so
  texts meet in classes of length, in groups of a bounded number of both sides' texts.
  Bounds from common letters, pairs and fours of letters (:class:`Letters`) are worked out for a group's
  pairs as a whole. Of what they leave, the longest common subsequence bounds a pair's matched letters, by
  bits and some fifty times as fast as the matcher, which runs on the rest.
"""

from __future__ import annotations

import math
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.functions.similarity import common_letters, letter_places, token_set, token_set_ratio
from scriptorium.functions.text import reference_text
from scriptorium.session import cut_lineage

GROUP_TEXTS = 256  # candidates of one group; references are a quarter
GROUP_CHARS = 1 << 22
BROADCAST_TOKENS = 500_000
MOST_PARTITIONS = 20_000


class Letters:
    """Occurrences of letters, pairs and fours in texts, in hashed buckets (which only raise bounds)."""

    SIZES = {1: 64, 2: 512, 4: 2048}
    #: Texts of this length and more have their frequent letters left out by the matcher (fixed value of the standard library).
    LONG = 200

    def __init__(self, texts: list[str]) -> None:
        self.texts = texts
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.counts = {q: np.zeros((len(texts), n), np.int32) for q, n in self.SIZES.items()}
        self.rare = np.zeros((len(texts), self.SIZES[1]), np.int32)
        for k, text in enumerate(texts):
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            for q, n in self.SIZES.items():
                if len(points) >= q:
                    gram = np.zeros(len(points) - q + 1, np.uint64)
                    for i in range(q):
                        gram = gram * np.uint64(0x9E3779B97F4A7C15) + points[i : len(points) - q + 1 + i] if q > 1 else points
                    bucket = (gram >> np.uint64(40)) % np.uint64(n) if q > 1 else gram % np.uint64(n)
                    self.counts[q][k] = np.bincount(bucket.astype(np.int64), minlength=n)
            letter, times = np.unique(points, return_counts=True)
            few = times <= len(points) // 100 + 1
            np.add.at(self.rare[k], (letter[few] % np.uint64(self.SIZES[1])).astype(np.int64), times[few])

    def reachable(self, text: int, other: Letters, threshold: float) -> np.ndarray:
        """Texts of ``other`` that can have a ratio at the threshold with one text (``other``'s as the matcher's second).

        With matched blocks k in number and M letters long, common letters are M at least and common
        q-grams M - (q - 1) * k at least. Blocks are parted by unmatched letters, of which both
        have S - 2M: k <= S - 2M + 1. Where the second text is long, each block but one holds a letter
        that is rare in it: k <= R + 1.
        """
        size = self.sizes[text]
        both = size + other.sizes
        need = threshold * both / 2 - 1e-6
        common = lambda q, at: np.minimum(self.counts[q][text], other.counts[q][at]).sum(axis=1)
        at = np.flatnonzero(np.minimum(size, other.sizes) >= need)
        at = at[common(1, at) >= need[at]]
        long = other.sizes[at] >= self.LONG
        short, at = at[~long], at[long]
        short = short[(common(2, short) + both[short] + 1) / 3 >= need[short]]
        blocks = np.minimum(self.counts[1][text], other.rare[at]).sum(axis=1) + 1
        at = at[common(2, at) + blocks >= need[at]]
        blocks = np.minimum(self.counts[1][text], other.rare[at]).sum(axis=1) + 1
        at = at[common(4, at) + 3 * blocks >= need[at]]
        return np.concatenate((short, at))


def alike(left: list[str], right: list[str], threshold: float) -> list[tuple[int, int]]:
    """Places of the pairs of two groups whose ratio is at the threshold."""
    if not left or not right:
        return []
    own, their = Letters(left), Letters(right)
    hits: dict[int, list[int]] = {}
    for i in range(len(left)):
        for j in own.reachable(i, their, threshold):
            hits.setdefault(int(j), []).append(i)
    found = []
    for j, asked in hits.items():
        text = right[j]
        places, matcher = letter_places(text), None
        for i in asked:
            if 2.0 * common_letters(places, len(text), left[i]) / (len(text) + len(left[i])) < threshold:
                continue
            matcher = matcher or SequenceMatcher(None, "", text)
            matcher.set_seq1(left[i])
            if matcher.ratio() >= threshold:
                found.append((i, j))
    return found


def _prepared(rows: DataFrame, key: str, *more: str) -> DataFrame:
    """``(key, more, text, size, text_no)``: distinct tokens, sorted and joined; rows without a key are none."""
    words = F.array_sort(F.filter(F.array_distinct(F.split(reference_text(F.col("text")), " ")), lambda w: w != ""))
    joined = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), *more, F.coalesce(F.array_join(words, " "), F.lit("")).alias("text"))
    return joined.withColumn("size", F.length("text")).withColumn("text_no", F.md5(F.col("text").cast("binary")))


def _weight(words: Column) -> Column:
    """Length of the words joined, and one more; 0 for none."""
    return F.aggregate(words, F.lit(0), lambda held, w: held + F.length(w) + 1)


def _prefixes(tokens: DataFrame, frequency: DataFrame, factor: float) -> DataFrame:
    """``(text_no, token)``: a text's rarest tokens of more than the weight that need not be common.

    ``tokens`` are the side's exploded tokens with the text's whole weight, ``frequency`` has the other side's
    tokens with ``n``. Tokens that the other side doesn't have come first and meet nothing; a text that
    has enough of them is gone.
    """
    known = tokens.join(frequency, "token", "left")
    lacking = known.groupBy("text_no", "weight").agg(F.sum(F.when(F.col("n").isNull(), F.length("token") + 1).otherwise(0)).alias("before"), F.array_sort(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("n", "token")))).alias("rest"))
    spare = F.col("weight") - (F.lit(factor) * (F.col("weight") - 1) + 1) + 1e-6
    # The known tokens, rarest first, until their weight passes what can be spared.
    kept = F.aggregate(
        "rest",
        F.struct(F.col("before").cast("double").alias("held"), F.array().cast("array<string>").alias("tokens")),
        lambda acc, x: F.when(acc["held"] > spare, acc).otherwise(F.struct((acc["held"] + F.length(x["token"]) + 1).alias("held"), F.array_append(acc["tokens"], x["token"]).alias("tokens"))),
        lambda acc: acc["tokens"],
    )
    return lacking.where(F.col("before") <= spare).select("text_no", F.explode(kept).alias("token"))


def _by_tokens(refs: DataFrame, cands: DataFrame, threshold: float) -> DataFrame:
    """``(ref_no, cand_no, score)`` of pairs whose common tokens are enough of one side."""
    factor = threshold / (2 - threshold)
    words = F.split("text", " ")
    exploded = lambda df: df.select("text_no", (F.col("size") + 1).alias("weight"), F.explode(words).alias("token"))
    left, right = exploded(refs), exploded(cands)
    asked = left.groupBy("token").agg(F.count("*").alias("n"))
    longest, rows = left.agg(F.max("weight"), F.count_distinct("token")).first()
    sized = F.broadcast if rows <= BROADCAST_TOKENS else lambda df: df  # a row a token of the references; beyond this the joins shuffle
    near = right.where(F.lit(factor) * (F.col("weight") - 1) - 1e-6 <= (longest or 0) - 1)  # a longer text can't have enough of it in common
    met = right.join(sized(asked.select("token")), "token", "left_semi")
    own = _prefixes(left, sized(met.groupBy("token").agg(F.count("*").alias("n"))), factor)
    their = _prefixes(near, sized(asked), factor)
    pairs = own.select(F.col("text_no").alias("ref_no"), "token").join(met.select(F.col("text_no").alias("cand_no"), "token"), "token")
    pairs = pairs.union(their.select(F.col("text_no").alias("cand_no"), "token").join(left.select(F.col("text_no").alias("ref_no"), "token"), "token").select(*pairs.columns))
    named = lambda df, name: df.select(F.col("text_no").alias(f"{name}_no"), F.col("size").alias(f"{name}_size"), F.col("text").alias(f"{name}_text"))
    both = pairs.select("ref_no", "cand_no").distinct().join(named(refs, "ref"), "ref_no").join(named(cands, "cand"), "cand_no")
    shared = _weight(F.array_intersect(F.split("ref_text", " "), F.split("cand_text", " "))) - 1
    enough = shared >= F.lit(factor) * F.least("ref_size", "cand_size") - 1e-6
    return both.where(enough).withColumn("score", token_set_ratio("ref_text", "cand_text", threshold)).where(F.col("score") >= threshold).select("ref_no", "cand_no", "score")


def _class_salts(df: DataFrame, texts: int) -> dict[int, int]:
    """Groups that each class of lengths is dealt over; classes are few, as they are logarithms."""
    found = df.groupBy("class").agg(F.count("*").alias("n"), F.sum("size").alias("chars")).collect()
    return {r["class"]: max(1, math.ceil(r["n"] / texts), math.ceil(r["chars"] / GROUP_CHARS)) for r in found}


def _lookup(found: dict[int, int]) -> Column:
    if not found:
        return F.lit(1)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in found.items() for x in pair]), F.col("class")), F.lit(1))


def _by_letters(refs: DataFrame, cands: DataFrame, threshold: float, group_texts: int) -> DataFrame:
    """``(ref_no, cand_no, score)`` of pairs whose sides are alike as a whole.

    A class of lengths is dealt over groups by hash on both sides; each group of candidates
    meets each group of references of its class in one cogroup, so a task holds two bounded groups
    whatever a class has.
    """
    factor = threshold / (2 - threshold)
    of = lambda size: F.floor(F.log(size.cast("double")) / F.lit(-math.log(factor))).cast("int")
    own = refs.where("size > 0").select("text_no", "text", "size", F.explode(F.sequence(of(F.col("size")) - 1, of(F.col("size")) + 1)).alias("class"))
    their = cands.where("size > 0").select("text_no", "text", "size", of(F.col("size")).alias("class"))
    ref_salts = _class_salts(own, max(1, group_texts // 4))
    their = their.where(F.col("class").isin(list(ref_salts)))
    cand_salts = _class_salts(their, group_texts)
    own = own.where(F.col("class").isin(list(cand_salts)))
    r, c = _lookup(ref_salts), _lookup(cand_salts)
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = own.withColumn("r", F.pmod(F.xxhash64("text_no"), r).cast("int")).withColumn("c", every(c))
    their = their.withColumn("c", F.pmod(F.xxhash64("text_no"), c).cast("int")).withColumn("r", every(r))

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        left, right = list(a["text"]), list(b["text"])
        found = [(a["text_no"].iat[i], b["text_no"].iat[j], token_set(left[i], right[j])) for i, j in alike(left, right, threshold)]
        return pd.DataFrame(found, columns=["ref_no", "cand_no", "score"])

    keys = ("class", "r", "c")
    groups = sum(ref_salts.get(x, 0) * n for x, n in cand_salts.items())
    dealt = lambda df: df.repartition(min(max(groups, 1), MOST_PARTITIONS), *keys)  # noqa: E731  small in bytes, but each group is much work
    grouped = dealt(own).groupBy(*keys).cogroup(dealt(their).groupBy(*keys))
    return grouped.applyInPandas(compare, "ref_no string, cand_no string, score double")


def reference_matches(references: DataFrame, candidates: DataFrame, threshold: float = 0.80, k: int = 5, group_texts: int = GROUP_TEXTS) -> DataFrame:
    """``(ref_id, candidate, score, rank)`` of the k best candidates at the threshold (over a half).

    ``references`` has ``ref_id`` and ``text``; ``candidates`` has ``key``, ``text`` and ``pos`` (arrival
    order, which decides ties). No pair at the threshold is lost, whether or not it has a token in
    common. Rows whose tokens are the same set are compared once. Texts without any token (null ones too) score
    1 against everything, as the ratio has it; only the first k candidates can count then. Rows without
    an id are passed over, repeated rows count once, and an id with several texts has the best of their
    scores. Empty tables give an empty result.
    """
    refs = cut_lineage(_prepared(references, "ref_id"))
    cands = cut_lineage(_prepared(candidates, "key", "pos"))
    texts = lambda df: df.where("size > 0").groupBy("text_no").agg(F.first(F.struct("text", "size")).alias("x")).select("text_no", "x.*")
    ref_texts, cand_texts = texts(refs), texts(cands)
    scored = _by_tokens(ref_texts, cand_texts, threshold).union(_by_letters(ref_texts, cand_texts, threshold, group_texts))
    scored = scored.groupBy("ref_no", "cand_no").agg(F.max("score").alias("score"))
    # A candidate text stands for all rows that have it; of each only the first k by position can count.
    by_text = W.partitionBy("text_no").orderBy("pos")
    standing = cands.where("size > 0").select("key", "pos", "text_no").distinct().withColumn("nth", F.row_number().over(by_text)).where(F.col("nth") <= k)
    found = scored.join(refs.select(F.col("key").alias("ref_id"), F.col("text_no").alias("ref_no")).distinct(), "ref_no")
    found = found.join(standing.select(F.col("key").alias("candidate"), "pos", F.col("text_no").alias("cand_no")), "cand_no").select("ref_id", "candidate", "pos", "score")
    one = F.lit(1).alias("_one")
    first_of = lambda df: df.select(F.col("key").alias("candidate"), "pos", one).distinct().orderBy("pos").limit(k)
    empty, first = first_of(cands.where("size = 0")), first_of(cands)
    for few, asked in ((empty, refs.where("size > 0")), (first, refs.where("size = 0"))):
        found = found.union(asked.select(F.col("key").alias("ref_id"), one).join(F.broadcast(few), "_one").select("ref_id", "candidate", "pos", F.lit(1.0).alias("score")))
    best = found.groupBy("ref_id", "candidate", "pos").agg(F.max("score").alias("score"))
    order = W.partitionBy("ref_id").orderBy(F.desc("score"), "pos")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("ref_id", "candidate", "score", "rank")
