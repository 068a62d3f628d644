"""Turning mentions of page slugs into links.

All slugs are looked for at once: an Aho-Corasick automaton of a slice of the slugs' phrases reads each page
once, whatever their number and however common their words are. Slices are of a bounded size and read the pages one
after the other; a slice's phrases are what is broadcast.
"""

from __future__ import annotations

import math
import pickle
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import linkable

SLICE_PHRASES = 200_000  # of one automaton
SLICE_BYTES = 16 << 20
PIECE_HITS = 20_000  # mentions handed on at once


class Phrases:
    """Phrases to be found as whole words, case aside; the automaton is made once in each process."""

    def __init__(self, slugs: list[str]) -> None:
        self.slugs = sorted(slugs)

    def __getstate__(self) -> dict:
        return {"slugs": self.slugs}

    @property
    def automaton(self) -> ahocorasick.Automaton:
        if "_automaton" not in self.__dict__:
            made = ahocorasick.Automaton()
            for n, slug in enumerate(self.slugs):
                phrase = slug.lower().replace("-", " ")
                made.add_word(phrase, (len(phrase), (*made.get(phrase, (0, ()))[1], n)))  # slugs that differ in case share a phrase
            made.make_automaton()
            self._automaton = made
        return self._automaton

    def within(self, text: str) -> list[str]:
        """The slugs whose phrase stands in the text between other characters than letters, digits and underscores."""
        if not self.slugs:
            return []
        low = text.lower()
        word = lambda at: 0 <= at < len(low) and (low[at].isalnum() or low[at] == "_")
        found: set[int] = set()
        for end, (size, numbers) in self.automaton.iter(low):
            start = end - size + 1
            if not (word(start - 1) and word(start)) and not (word(end) and word(end + 1)):
                found.update(numbers)
        return [self.slugs[n] for n in sorted(found)]


def _slices(slugs: DataFrame) -> list[DataFrame]:
    """The linkable slugs in slices by hash, each of a bounded number of phrases and bytes."""
    own = slugs.where(linkable(F.col("slug"))).select("slug").distinct()
    n, size = own.agg(F.count("*"), F.sum(F.octet_length("slug"))).first()
    parts = max(1, math.ceil(n / SLICE_PHRASES), math.ceil((size or 0) / SLICE_BYTES))
    return [own.where(F.pmod(F.xxhash64("slug"), F.lit(parts)) == at) for at in range(parts)]


def _taken(part: DataFrame) -> bytes:
    return pickle.dumps(Phrases([r.slug for r in part.toLocalIterator()]), protocol=pickle.HIGHEST_PROTOCOL)


@lru_cache(maxsize=1)
def _opened(packed: bytes) -> Phrases:
    """One slice is open at a time in each process; the others stay packed."""
    return pickle.loads(packed)


def mentions(pages: DataFrame, slugs: DataFrame) -> DataFrame:
    """``(path, slug)`` where the words of a slug of several words stand in the page in order, as whole words, case aside.

    Null texts mention nothing; a path with several rows has the slugs of all of them, once each.
    """
    found = None
    for part in _slices(slugs):
        shared = pages.sparkSession.sparkContext.broadcast(_taken(part))

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            phrases, hits = _opened(shared.value), []
            for batch in batches:
                for path, text in zip(batch["path"], batch["text"]):
                    if text is not None:
                        hits += [(path, s) for s in phrases.within(text)]
                    if len(hits) >= PIECE_HITS:
                        yield pd.DataFrame(hits, columns=["path", "slug"], dtype="object")
                        hits = []
            yield pd.DataFrame(hits, columns=["path", "slug"], dtype="object")

        one = pages.select("path", "text").mapInPandas(search, "path string, slug string")
        found = one if found is None else found.union(one)
    return found.distinct()


@lru_cache(maxsize=4096)
def _phrase(slug: str) -> re.Pattern:
    return re.compile(r"\b" + re.escape(slug.replace("-", " ")) + r"\b", re.IGNORECASE)


def linked_text(text: str, slugs: list[str]) -> tuple[str, list[str]]:
    """Text with the first mention of each slug linked in turn, and the slugs that were.

    A slug whose link stands anywhere already is left; each link changes what the next sees.
    """
    done = []
    for slug in slugs:
        link = f"[[{slug}]]"
        if "-" not in slug or link in text:
            continue
        found = _phrase(slug).search(text)
        if found:
            text = text[: found.start()] + link + text[found.end() :]
            done.append(slug)
    return text, done


_LINKED = "path string, text string, inserted array<string>"


def insert_backlinks(pages: DataFrame, slugs: DataFrame) -> DataFrame:
    """``(path, text, inserted)`` of the pages that change; ``pages`` has ``path`` and whole ``text``.

    A page's slugs are linked in order. With one slice of slugs a page is searched and linked where it is read;
    with several, the slugs found are brought together by path first (paths are one row each then).
    """
    parts = _slices(slugs)
    if len(parts) == 1:
        shared = pages.sparkSession.sparkContext.broadcast(_taken(parts[0]))

        def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            phrases = _opened(shared.value)
            for batch in batches:
                out = [(p, *linked_text(t, phrases.within(t))) for p, t in zip(batch["path"], batch["text"]) if t is not None]
                yield pd.DataFrame([r for r in out if r[2]], columns=["path", "text", "inserted"], dtype="object")

        return pages.select("path", "text").mapInPandas(link, _LINKED)
    wanted = mentions(pages, slugs).groupBy("path").agg(F.array_sort(F.collect_set("slug")).alias("slugs"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [linked_text(t, list(s)) for t, s in zip(batch["text"], batch["slugs"])]
            yield pd.DataFrame({"path": batch["path"], "text": [t for t, _ in out], "inserted": [d for _, d in out]})

    joined = pages.select("path", "text").join(wanted, "path")
    return joined.mapInPandas(fold, _LINKED).where(F.size("inserted") > 0)
