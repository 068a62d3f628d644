"""Mentions of many phrases at once against looking for each."""

import random
import re

import pytest

from scriptorium.operators import backlinks


def plain_mentions(pages, slugs):
    return {(p, s) for p, t in pages for s in slugs if t is not None and "-" in s and re.search(r"\b" + re.escape(s.replace("-", " ")) + r"\b", t.lower())}


def make(spark, pages, slugs):
    return spark.createDataFrame(pages, "path string, text string"), spark.createDataFrame([(s,) for s in slugs], "slug string")


def some_pages(seed=4):
    rng = random.Random(seed)
    words = ["learning", "deep", "maps", "Learning", "of", "x1", "naïve", "graph", "graphs", "neural", "über", "a_b"]
    mark = lambda: rng.choice([" ", " ", " ", ", ", "-", "\n", "  ", "_"])
    pages = [(f"p{i}", "".join(rng.choice(words) + mark() for _ in range(rng.randint(0, 60)))) for i in range(60)]
    pages += [("null", None), ("empty", ""), ("long", "filler " * 20000 + "deep learning"), ("p0", "graph maps")]
    slugs = sorted({"-".join(rng.choice(words).lower() for _ in range(rng.randint(1, 4))) for _ in range(150)}) + ["deep-learning", "graph-maps"]
    return pages, slugs


@pytest.mark.parametrize("phrases", [200_000, 40])
def test_mentions_equal_a_search_for_each_phrase(spark, monkeypatch, phrases):
    monkeypatch.setattr(backlinks, "SLICE_PHRASES", phrases)
    pages, slugs = some_pages()
    got = {(r.path, r.slug) for r in backlinks.mentions(*make(spark, pages, slugs)).collect()}
    assert got == plain_mentions(pages, slugs) and len(got) > 50


@pytest.mark.parametrize("phrases", [200_000, 40])
def test_links_equal_a_fold_over_all_slugs(spark, monkeypatch, phrases):
    monkeypatch.setattr(backlinks, "SLICE_PHRASES", phrases)
    pages, slugs = some_pages(5)
    pages = pages[:-1]  # a row a path
    want = {}
    for path, text in pages:
        if text is not None and (made := backlinks.linked_text(text, sorted(set(slugs))))[1]:
            want[path] = made
    got = {r.path: (r.text, r.inserted) for r in backlinks.insert_backlinks(*make(spark, pages, slugs)).collect()}
    assert got == want and len(want) > 20


def test_overlapping_and_nested_phrases():
    phrases = backlinks.Phrases(["deep-learning", "learning-of", "deep-learning-of", "single", "Deep-Learning"])
    assert phrases.within("DEEP learning of maps") == ["Deep-Learning", "deep-learning", "deep-learning-of", "learning-of"]
    assert phrases.within("xdeep learning") == phrases.within("deep learnings") == phrases.within("") == [] == backlinks.Phrases([]).within("a b")
    assert phrases.within("(deep learning)") == ["Deep-Learning", "deep-learning"]


def test_no_pages_and_no_slugs(spark):
    pages, slugs = make(spark, [], ["a-b"])
    assert backlinks.mentions(pages, slugs).count() == 0 and backlinks.insert_backlinks(pages, slugs).count() == 0
    pages, slugs = make(spark, [("p", "a b")], [])
    assert backlinks.mentions(pages, slugs).count() == 0 and backlinks.insert_backlinks(pages, slugs).count() == 0


def test_a_process_holds_one_slice_of_phrases():
    import pickle

    for slugs in (["a-b"], ["c-d"], ["e-f"]):
        assert backlinks._opened(pickle.dumps(backlinks.Phrases(slugs))).within("A b, c d and e f") == slugs
    assert backlinks._opened.cache_info().currsize == 1
