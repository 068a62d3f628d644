"""Unicode folding. Spark has no normalisation form, so one Arrow function does it."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters without a decomposition, and what stands for them (fixed values).
MANUAL_FOLD = {"ø": "o", "Ø": "o", "æ": "ae", "Æ": "ae", "œ": "oe", "Œ": "oe", "ß": "ss", "ð": "d", "Ð": "d", "þ": "th", "Þ": "th", "ł": "l", "Ł": "l"}

# Lower-case Greek letters and their Latin forms (fixed values).
GREEK = {
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n",
    "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "u", "φ": "f", "χ": "ch", "ψ": "ps", "ω": "o",
}


def strip_marks(text: str) -> str:
    """NFKD without combining marks."""
    return text if text.isascii() else "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def _strip(texts: pd.Series) -> pd.Series:
    return texts.map(strip_marks, na_action="ignore")


def nfkd_strip(text: Column) -> Column:
    """:func:`strip_marks` over a column; null stays null. Only text that is not ASCII goes to Python."""
    return F.coalesce(F.pandas_udf(_strip, "string")(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def _replaced(c: Column, table: dict[str, str]) -> Column:
    """One ``translate`` for single letters, one ``replace`` for each longer form."""
    single = {k: v for k, v in table.items() if len(v) == 1}
    for k, v in table.items():
        if len(v) > 1:
            c = F.replace(c, F.lit(k), F.lit(v))
    return F.translate(c, "".join(single), "".join(single.values()))


def greek_to_latin(c: Column) -> Column:
    return _replaced(c, GREEK)


def ascii_fold(c: Column) -> Column:
    """Manual letters first, then NFKD without marks, then lower case."""
    return F.lower(nfkd_strip(_replaced(c, MANUAL_FOLD)))
