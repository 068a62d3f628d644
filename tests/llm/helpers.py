"""Small tables with the awkward cases that every operator has to take."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, unit long, row long, block long"
WORDS = re.compile("[^\x20\x09-\x0d]+")


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text: str | None) -> list[str]:
    return WORDS.findall(lower(text))


def awkward_texts(seed: int = 1) -> list[tuple[int | None, str | None]]:
    """Nulls, empties, white space, a very long text, copies, near copies, repeated rows."""
    rng = random.Random(seed)
    vocabulary = ["the", "of", "Über", "naïve", "data", "model", "Tree", "river", "é", "x1", "stone", "cloud"] + [f"w{i}" for i in range(60)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = [prose(rng.randint(1, 120)) for _ in range(24)]
    rows = list(enumerate(base))
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, "one"), (104, "one two"), (105, base[0]), (106, base[0]), (107, base[1] + " tail"), (108, base[2].upper())]
    rows += [(109, "\n".join(base[3:6])), (110, prose(9000)), (3, base[3]), (3, base[3]), (None, base[4]), (None, None), (111, "a" * 3000), (112, "É " * 40)]
    rng.shuffle(rows)
    return rows


def documents(spark, rows=None):
    """A documents table with extra columns whose names the operators use themselves."""
    rows = awkward_texts() if rows is None else rows
    sources = ["b", "a", None, "hot"]
    full = [(i, t, "en", sources[min(k % 7, 3)], len(t or ""), 1, 2, 3) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)
