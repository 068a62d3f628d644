"""References matched to papers against all pairs."""

import random
from difflib import SequenceMatcher

import pytest

from scriptorium.functions.similarity import block_ratio, common_letters, letter_places, token_set
from scriptorium.operators import references

REFS, CANDS = "ref_id long, text string, key int", "key long, text string, pos long, ref_id int"


def plain(asked, texts, threshold=0.8, k=5):
    out = []
    for i, a in asked:
        found = sorted((-s, pos, j) for j, b, pos in texts if (s := 1.0 if not a or not b else token_set(" ".join(sorted(set(a.split()))), " ".join(sorted(set(b.split()))))) >= threshold)[:k]
        out += [(i, r, j, round(-s, 9)) for r, (s, _, j) in enumerate(found, 1)]
    return sorted(out)


def matched(spark, asked, texts, **options):
    refs = spark.createDataFrame([(i, a, 1) for i, a in asked], REFS)
    cands = spark.createDataFrame([(j, b, pos, 1) for j, b, pos in texts], CANDS)
    return sorted((r.ref_id, r["rank"], r.candidate, round(r.score, 9)) for r in references.reference_matches(refs, cands, **options).collect())


def with_typo(rng, word):
    at = rng.randrange(len(word))
    kind = rng.randrange(3)
    letter = rng.choice("abcdefghijklmnopqrstuvwxyz")
    return word[:at] + letter + word[at + 1 :] if kind == 0 else word[:at] + letter + word[at:] if kind == 1 else word[:at] + word[at + 1 :] or letter


@pytest.mark.parametrize("group_texts", [2048, 8])
def test_a_typo_in_each_token_loses_no_pair(spark, group_texts):
    rng = random.Random(15)
    vocabulary = ["".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(4, 11))) for _ in range(80)]
    texts = [(j, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(2, 30))), j) for j in range(120)]
    asked = [(j, " ".join(with_typo(rng, w) for w in t.split())) for j, t, _ in texts[:60]] + [(j, t) for j, t, _ in texts[60:80]]
    want = plain(asked, texts)
    apart = [(i, j) for i, _, j, _ in want for a in [dict(asked)[i]] if not set(a.split()) & set(texts[j][1].split())]
    assert matched(spark, asked, texts, group_texts=group_texts) == want and len(apart) > 20


def test_long_texts_and_the_matchers_frequent_letters(spark):
    rng = random.Random(16)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(3, 9))) for _ in range(300)] + [f"q{i}z" for i in range(40)]
    texts = [(j, " ".join(rng.sample(words, rng.randint(25, 120))), j) for j in range(30)]
    asked = [(j, " ".join(w if rng.random() < 0.97 else with_typo(rng, w) for w in t.split())) for j, t, _ in texts] + [(100 + j, " ".join(t.split()[:6])) for j, t, _ in texts[:10]]
    want = plain(asked, texts)
    assert matched(spark, asked, texts) == want and len({i for i, *_ in want if i < 100}) > 15


def test_bounds_leave_every_pair_at_the_threshold():
    rng, kept, near = random.Random(3), 0, 0
    for _ in range(120):
        letters = rng.choice(["abc", "abcdefghij ", "abcdefghijklmnopqrstuvwxyz 0123456789é", "ab"])
        base = "".join(rng.choice(letters) for _ in range(rng.choice([3, 10, 50, 150, 220, 400])))
        others = [base]
        for share in (0.05, 0.1, 0.15, 0.2, 0.3):
            text = list(base)
            for _ in range(int(len(base) * share)):
                text[rng.randrange(len(text))] = rng.choice([rng.choice(letters), "", "xy"])
            others.append("".join(text))
        others.append("".join(rng.choice(letters) for _ in base))
        got = set(references.Letters([base]).reachable(0, references.Letters(others), 0.8).tolist())
        real = {j for j, t in enumerate(others) if SequenceMatcher(None, base, t).ratio() >= 0.8}
        assert real <= got
        kept, near = kept + len(got), near + len(real)
    assert near > 250 and kept < 120 * 7


def test_common_letters_are_those_of_the_longest_common_subsequence():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rng.choice("abé中 ") for _ in range(rng.randint(0, 90))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            before = row[:]
            for j, y in enumerate(b):
                row[j + 1] = before[j] + 1 if x == y else max(row[j], before[j + 1])
        assert common_letters(letter_places(a), len(a), b) == row[-1]


def test_the_matcher_runs_on_few_pairs_of_unlike_texts(monkeypatch):
    rng, runs = random.Random(17), []
    parts = ["the", "ing", "on", "re", "nd", "er", "in", "at", "es", "tion", "th", "ha", "or", "st"]
    text = lambda: " ".join(sorted({"".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(24)}))
    left, right = [text() for _ in range(30)], [text() for _ in range(60)]
    right += [t[:40] + "x" + t[45:] for t in left]
    want = [(i, j) for i, a in enumerate(left) for j, b in enumerate(right) if len(a) + len(b) and SequenceMatcher(None, a, b).ratio() >= 0.8]

    class Counted(SequenceMatcher):
        def ratio(self):
            runs.append(1)
            return super().ratio()

    monkeypatch.setattr(references, "SequenceMatcher", Counted)
    assert sorted(references.alike(left, right, 0.8)) == want and len(want) >= 30
    assert len(runs) <= len(want) + 60


def test_token_sets_with_a_least_score_keep_their_score():
    rng = random.Random(18)
    words = ["a", "ab", "abc", "bcd", "eée", "the", "then", "zz", "y1", "y2"]
    for _ in range(400):
        a, b = (" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(2))
        ta, tb = set(a.split()), set(b.split())
        joined = [" ".join(sorted(s)) for s in (ta & tb, ta, tb)]
        want = max(block_ratio(joined[i], joined[j]) for i, j in ((0, 1), (0, 2), (1, 2)))
        assert token_set(a, b) == want and token_set(a, b, 0.8) == (want if want >= 0.8 else 0.0)


def test_awkward_references(spark):
    rows = [(1, None), (2, ""), (3, "..."), (4, "Same Text"), (4, "same text"), (None, "same text"), (5, "ß ﬀ 中文"), (6, "x" * 5000)]
    texts = [(10, "same text", 3), (11, "SAME, TEXT!", 1), (None, "same text", 0), (12, None, 2), (10, "same text", 3), (13, "x" * 5000, 4), (14, "中文 ß ﬀ", 5)]
    got = matched(spark, rows, texts)
    by_ref = {}
    for i, _, j, s in got:
        by_ref.setdefault(i, []).append((j, s))
    assert by_ref[4] == [(11, 1.0), (12, 1.0), (10, 1.0)] and by_ref[6] == [(12, 1.0), (13, 1.0)] and by_ref[5] == [(12, 1.0), (14, 1.0)]
    assert by_ref[1] == by_ref[2] == by_ref[3] == [(11, 1.0), (12, 1.0), (10, 1.0), (13, 1.0), (14, 1.0)] and None not in by_ref
    assert matched(spark, [], texts) == [] and matched(spark, rows, []) == []


def test_equal_texts_in_great_number_are_compared_once(spark):
    texts = [(j, "a common title of many papers", j) for j in range(3000)] + [(9000, "another title", 9000)]
    asked = [(i, "a common title of many paperz") for i in range(200)]
    got = matched(spark, asked, texts)
    assert [(r, j) for _, r, j, _ in got[:5]] == [(r + 1, r) for r in range(5)] and len(got) == 1000


def test_prefixes_leave_out_what_cannot_match(spark):
    refs = spark.createDataFrame([("r", "common words of all texts and one zebra", 40)], "text_no string, text string, size int")
    from pyspark.sql import functions as F

    tokens = refs.select("text_no", (F.col("size") + 1).alias("weight"), F.explode(F.split("text", " ")).alias("token"))
    frequency = spark.createDataFrame([("common", 900), ("words", 800), ("of", 9999), ("all", 950), ("texts", 700), ("and", 9999), ("one", 500), ("zebra", 1)], "token string, n long")
    got = {r.token for r in references._prefixes(tokens, frequency, 2 / 3).collect()}
    assert "zebra" in got and "of" not in got and "and" not in got
    rare = frequency.where("n < 2")
    assert references._prefixes(tokens, rare, 2 / 3).count() == 0  # what the other side lacks is more than can be spared
