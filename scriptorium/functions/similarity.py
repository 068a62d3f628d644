"""String similarity by matching blocks, with exact upper bounds that run natively."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def block_ratio(a: str, b: str) -> float:
    """Twice the matched characters over all, with the library's own junk rule."""
    return SequenceMatcher(None, a, b).ratio()


def letter_places(text: str) -> dict[str, int]:
    """Of each letter, a number with a bit for each place it has."""
    places: dict[str, int] = {}
    for k, letter in enumerate(text):
        places[letter] = places.get(letter, 0) | 1 << k
    return places


def common_letters(places: dict[str, int], size: int, text: str) -> int:
    """Letters of the longest common subsequence of ``text`` and the one of ``size`` letters that ``places`` are of.

    Matching blocks have their order in both texts, so no ratio matches more letters.
    """
    every = free = (1 << size) - 1
    get = places.get
    for letter in text:
        met = free & get(letter, 0)
        free = (free + met | free - met) & every
    return size - free.bit_count()


def token_set(a: str, b: str, least: float = 0.0) -> float:
    """Best block ratio between the common tokens and each side's completed by its own; 0 if that is below ``least``.

    A ratio that by the texts' lengths or their common letters is no better than one that is known is not worked out.
    """
    ta, tb = set(a.split()), set(b.split())
    common = ta & tb
    joined = [" ".join(sorted(s)) for s in (common, ta, tb)]
    best = 0.0
    for i, j in ((0, 1), (0, 2), (1, 2)):
        one, other = joined[i], joined[j]
        both = len(one) + len(other)
        most = 2.0 * min(len(one), len(other)) / both if both else 1.0
        if most < least or most <= best:
            continue
        if i:  # common tokens are a subsequence of a side's: only the sides can have fewer letters in common
            most = 2.0 * common_letters(letter_places(one), len(one), other) / both if both else 1.0
            if most < least or most <= best:
                continue
        best = max(best, block_ratio(one, other))
    return best if best >= least else 0.0


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else block_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def sequence_ratio(a: Column | str, b: Column | str) -> Column:
    return F.pandas_udf(_ratios, "double")(a, b)


def _token_sets(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else token_set(x, y) for x, y in zip(a, b)], dtype="float64")


def token_set_ratio(a: Column | str, b: Column | str, least: float = 0.0) -> Column:
    """:func:`token_set` of two columns."""

    def ratios(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else token_set(x, y, least) for x, y in zip(a, b)], dtype="float64")

    return F.pandas_udf(ratios, "double")(a, b)


def length_bound(la: Column, lb: Column) -> Column:
    """No ratio of texts of these lengths is above this."""
    return F.when(la + lb > 0, F.lit(2.0) * F.least(la, lb) / (la + lb)).otherwise(F.lit(1.0))


def letter_counts(text: Column, alphabet: str = "abcdefghijklmnopqrstuvwxyz0123456789 -") -> Column:
    """Occurrences of each character of the alphabet, then of all others."""
    own = F.transform(F.split(F.lit(alphabet), ""), lambda c: F.when(c != "", F.length(text) - F.length(F.replace(text, c, F.lit("")))).otherwise(0))
    return F.array_append(own, F.length(F.translate(text, alphabet, "")))


def letters_bound(counts_a: Column, counts_b: Column, la: Column, lb: Column) -> Column:
    """Bound from common letters: matched blocks are common letters, whatever their order."""
    common = F.aggregate(F.zip_with(counts_a, counts_b, lambda x, y: F.least(x, y)), F.lit(0), lambda acc, x: acc + x)
    return F.when(la + lb > 0, F.lit(2.0) * common / (la + lb)).otherwise(F.lit(1.0))
