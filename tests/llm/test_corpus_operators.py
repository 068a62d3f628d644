"""Corpus-wide operators against brute force."""

from __future__ import annotations

import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from scriptorium.llm import cover_tree, fm_index, interpolation_lm, mixing, near_copies, paragraph_minhash, simhash
from scriptorium.llm.components import connected_components
from scriptorium.llm.near_copies import copy_groups
from tests.llm.helpers import WORDS, awkward_texts, documents, lower, words


def plain_components(nodes, edges):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {n: root(n) for n in nodes}


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(200, 260)] + [(0, i) for i in range(1, 90)] + [(300, 300), (5, None)] + [(rng.randint(400, 480), rng.randint(400, 480)) for _ in range(60)]
    frame = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in connected_components(frame, "a", "b").collect()}
    real = [(a, b) for a, b in edges if b is not None and a != b]
    assert got == plain_components({n for e in real for n in e}, real)
    assert connected_components(frame.where("false"), "a", "b").count() == 0


# SimHash -----------------------------------------------------------------------------


def plain_fingerprint(text):
    w = words(text)
    runs = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("limit", [4096, 2])
def test_simhash_groups(spark, limit):
    rows = awkward_texts() + [(700 + i, f"{' '.join(['same'] * 40)} {i % 3}") for i in range(12)]
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    edges = [(x, y) for x, (_, p) in enumerate(prints) for y, (_, q) in enumerate(prints) if (p ^ q).bit_count() <= 2]
    part = plain_components(range(len(rows)), edges)
    least = defaultdict(list)
    for n, r in part.items():
        least[r] += [rows[n][0]] if rows[n][0] is not None else []
    want = Counter((i, p, min(least[part[n]], default=None)) for n, (i, p) in enumerate(prints))
    got = simhash.near_duplicates(documents(spark, rows), shard_limit=limit).collect()
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want


def test_links_survive_resharding(spark):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    keys = {centre} | {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(120)} | {rng.getrandbits(64) for _ in range(40)}
    near = [(a, b) for a in keys for b in keys if a < b and (a ^ b).bit_count() <= 2]
    signed = [(k - (1 << 64) if k >> 63 else k,) for k in keys]
    for limit in (4096, 8):
        found = simhash.near_links(spark.createDataFrame(signed, "fp long"), shard_limit=limit).collect()
        links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in found]
        assert all((a ^ b).bit_count() <= 2 for a, b in links)
        assert plain_components(keys, links) == plain_components(keys, near)


def test_bk_tree_searches_exactly():
    rng = random.Random(5)
    tree, keys = simhash.BKTree(), list({rng.getrandbits(12) for _ in range(300)})
    for k in keys:
        tree.add(k)
    for _ in range(50):
        q = rng.getrandbits(12)
        assert sorted(tree.keys[i] for i in tree.search(q, 2)) == sorted(k for k in keys if (k ^ q).bit_count() <= 2)


def test_keep_one_of_each_group(spark):
    docs = documents(spark)
    groups = {r.component_id for r in simhash.near_duplicates(docs).collect() if r.doc_id is not None}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(groups)
    assert None not in ids  # the rows without an id are copies of others
    assert simhash.keep_one(documents(spark, [])).count() == 0


@pytest.mark.parametrize("groups", [simhash.print_groups, copy_groups])
def test_keep_one_goes_by_text_and_not_by_id_alone(spark, groups):
    long = lambda k: " ".join(f"t{k}w{i}" for i in range(40))
    rows = [(0, long("a")), (1, long("a")), (1, long("b")), (1, long("b")), (2, long("c")), (2, long("d")), (None, long("e")), (None, long("e")), (None, long("f")), (None, long("b")), (5, None), (6, None)]
    kept = Counter((r.doc_id, r.text) for r in simhash.keep_one(documents(spark, rows), groups).collect())
    assert kept == Counter([(0, long("a")), (1, long("b")), (2, long("c")), (2, long("d")), (None, long("e")), (None, long("f")), (5, None)])


def plain_similarity(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (words(a), words(b))]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


@pytest.mark.parametrize("block_texts", [4096, 2])
def test_near_dedup_equals_brute_force_on_near_copies(spark, block_texts):
    rng = random.Random(12)
    rows = []
    for _ in range(20):
        base = [f"k{rng.randrange(3000)}" for _ in range(rng.randint(60, 400))]
        rows.append(" ".join(base))
        for share in (0.005, 0.01, 0.02, 0.03, 0.06):  # of the words changed
            rows.append(" ".join(f"n{rng.random()}" if rng.random() < share else w for w in base))
    rows += ["", "one", "one two", "One", "a b c d e"]
    rng.shuffle(rows)
    near = [(a, b) for a in range(len(rows)) for b in range(a) if plain_similarity(rows[a], rows[b]) >= 0.8]
    far = sum(0.8 <= plain_similarity(rows[a], rows[b]) < 0.95 for a, b in near)
    assert far >= 60
    want = set(plain_components(range(len(rows)), near).values())
    docs = documents(spark, list(enumerate(rows)))
    kept = simhash.keep_one(docs, copy_groups, block_texts=block_texts).collect()
    assert sorted(r.doc_id for r in kept) == sorted(want)
    if block_texts == 4096:
        assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == sorted(want)


# Top-k -------------------------------------------------------------------------------


def vectors():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + rng.normal(size=8) * 0.2).tolist()) for i in range(300)]
    rows += [(1000 + i, [0.5] * 8) for i in range(120)]  # a common vector
    rows += [(50, [0.5, 1.0] * 4), (50, [0.5, 1.0] * 4), (7, rows[7][1])]  # repeated ids
    rows += [(None, [1.0] * 8), (2000, None), (2050, [1.0, None] + [0.0] * 6), (2100, [float("nan")] + [0.0] * 7), (2150, [float("inf")] * 8), (2200, [1.0, 2.0]), (2250, [2.0, -1.0]), (0, rows[0][1]), (3000, [])]
    return rows


def test_cover_tree_top_k_equals_brute_force(spark):
    rows = vectors()
    frame = spark.createDataFrame([(i, v, 7, 7) for i, v in rows], "vec_id long, embedding array<float>, label int, shard int")
    own = [(i, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = Counter()
    for row, (q, asked) in enumerate(own):
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(asked, v)), i) for other, (i, v) in enumerate(own) if other != row and len(v) == len(asked))[:5]
            want.update((q, r, i, -s) for r, (s, i) in enumerate(best, 1))
    for shard_rows, block in ((4096, 1024), (64, 3)):
        got = cover_tree.top_k(frame, shard_rows=shard_rows, block_queries=block).collect()
        assert Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == want
    assert cover_tree.top_k(frame.where("false")).count() == 0


def test_cover_tree_broadcasts_no_trees(spark):
    frame = spark.createDataFrame([(i, v) for i, v in vectors()], "vec_id long, embedding array<float>")
    found = cover_tree.top_k(frame, shard_rows=64, block_queries=3)
    assert found.collect()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_scores_beyond_doubles_are_exact(spark):
    for high in (2.0**22, 2.0**18, 2.0**23):
        rows = [(0, [high, 1 / 256])] + [(k, [high, k / 256]) for k in (1, 2, 3)]
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = sorted((r["rank"], r.vec_id, r.score) for r in cover_tree.top_k(frame).collect())
        square = int(256 * high) ** 2
        want = [(1, 3, square + 3), (2, 2, square + 2), (3, 1, square + 1)]
        assert got == want if square + 3 < 1 << 63 else True, high


def test_cover_tree_covers_and_prunes():
    rng = np.random.default_rng(8)
    points = (rng.normal(size=(2000, 6)) * 100).astype(np.int64)
    tree = cover_tree.CoverTree(np.arange(2000), points, leaf_rows=16)
    assert sorted(tree.ids.tolist()) == list(range(2000))
    for node in range(len(tree.radius)):
        inside = tree.points[tree.first[node] : tree.last[node]]
        assert np.sqrt(((inside - tree.centers[node]) ** 2).sum(axis=1)).max() <= tree.radius[node] + 1e-6


# Language model ----------------------------------------------------------------------


@pytest.mark.parametrize("options", [{}, {"block_bytes": 600, "keys_a_partition": 40, "order": 3}])
def test_interpolation_scores(spark, options):
    rows = awkward_texts() + [(800 + i, f"the data model {i % 4} of the river") for i in range(30)]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    tokens = [words(t) + [None] for _, t in rows]
    c = Counter(w for (i, _), ts in zip(rows, tokens) if not held(i) for w in ts)
    n, v = sum(c.values()), len(c)
    want = Counter((i, held(i), len(ts), sum(c[w] > 0 for w in ts), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ts), 6)) for (i, _), ts in zip(rows, tokens))
    got = interpolation_lm.score_texts(documents(spark, rows), **options).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    unseen = [r for r in got if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def plain_interpolation(rows, order):
    """Scores from counts of word tuples, with weights learned on exact (not binned) estimates."""
    mark = lambda i: None if i is None else zlib.crc32(str(i).encode()) % 5
    grams = lambda ts, n: [tuple(([None] * n + ts)[i + 1 : i + 1 + n]) for i in range(len(ts))]  # noqa: E731  n-gram that ends at i
    tokens = [(mark(i), words(t) + [None]) for i, t in rows]

    def counted(learn):
        c = [Counter(g for m, ts in tokens if learn(m) for g in grams([*ts], n)) for n in range(1, order + 1)]
        return c, sum(c[0].values()), len(c[0])

    def estimates(ts, c, total, kinds):
        out = []
        for i in range(len(ts)):
            at = lambda n, j: tuple(([None] * n + ts)[j + 1 : j + 1 + n])
            p, bucket = [(c[0][at(1, i)] + 0.5) / (total + 0.5 * (kinds + 1))], 0
            for n in range(2, order + 1):
                seen = c[n - 2][at(n - 1, i - 1)] if i else c[0][(None,)]
                p.append(min(1, c[n - 1][at(n, i)] / seen) if seen else 0.0)
                if seen:
                    bucket = (n - 1) * interpolation_lm.BUCKETS + min(interpolation_lm.BUCKETS - 1, int(math.log2(seen)))
            out.append((bucket, p))
        return out

    c, total, kinds = counted(lambda m: m not in (1, 2))
    held = defaultdict(list)
    for m, ts in tokens:
        if m == 2:
            for bucket, p in estimates(ts, c, total, kinds):
                held[bucket].append(p)
    weights = {}
    for bucket in range(order * interpolation_lm.BUCKETS):
        depth = bucket // interpolation_lm.BUCKETS
        w = np.array([1 / (depth + 1)] * (depth + 1) + [0] * (order - depth - 1))
        for _ in range(interpolation_lm.EM_ROUNDS if held[bucket] else 0):
            p = np.array(held[bucket]) * w
            w = (p / p.sum(axis=1, keepdims=True)).mean(axis=0)
            w[0] = max(w[0], 1e-4)
            w /= w.sum()
        weights[bucket] = w
    c, total, kinds = counted(lambda m: m != 1)
    return [sum(math.log10(float(weights[b] @ np.array(p))) for b, p in estimates(ts, c, total, kinds)) for _, ts in tokens]


@pytest.mark.parametrize("order", [2, 3])
def test_interpolated_scores_equal_brute_force(spark, order):
    rng = random.Random(31)
    rows = [(i, " ".join(rng.choice(["the", "data", "model", "river", "of", "stone"]) for _ in range(rng.randint(1, 30)))) for i in range(150)]
    want = dict(zip([i for i, _ in rows], plain_interpolation(rows, order)))
    got = {r.doc_id: r for r in interpolation_lm.score_texts(documents(spark, rows), order=order, block_bytes=900, keys_a_partition=60).collect()}
    assert max(abs(got[i].score - w) / got[i].n_tokens for i, w in want.items()) < 0.03  # bins are a quarter of a doubling


def test_interpolation_of_a_table_that_stands_twice(spark):
    rng = random.Random(32)
    rows = [(i, " ".join(rng.choice(["the", "data", "model", "river", "of", "stone"]) + str(rng.randrange(9)) for _ in range(rng.randint(1, 30)))) for i in range(120)]
    docs = documents(spark, rows).coalesce(1)
    doubled = [row for row in rows for _ in range(2)]
    tokens = [(i, words(t) + [None]) for i, t in doubled]
    c = Counter(w for i, ts in tokens if zlib.crc32(str(i).encode()) % 5 != 1 for w in ts)
    n, v = sum(c.values()), len(c)
    base = Counter((i, sum(c[w] > 0 for w in ts), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ts), 6)) for i, ts in tokens)
    got = interpolation_lm.score_texts(docs.union(docs), order=3, block_bytes=900, keys_a_partition=60).collect()
    assert Counter((r.doc_id, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == base
    want = dict(zip([i for i, _ in doubled], plain_interpolation(doubled, 3)))
    assert max(abs(r.score - want[r.doc_id]) / r.n_tokens for r in got) < 0.03


def test_answers_that_do_not_fit_a_block_are_an_error(spark):
    docs = documents(spark, [(i, f"some words {i}") for i in range(9)])
    packs = interpolation_lm._packs(docs, 1 << 20)
    answers, _ = interpolation_lm.counts(docs, packs, 2, 4)
    row = interpolation_lm.answered(packs, answers.union(answers)).first().asDict(recursive=True)
    with pytest.raises(RuntimeError, match="keys of order"):
        interpolation_lm.Counted(row, 2, deleted=False)


def test_interpolation_is_a_distribution():
    rng = np.random.default_rng(1)
    weights = interpolation_lm.learn_weights(__import__("pandas").DataFrame({"bucket": [24, 24, 0], "b0": rng.integers(1, 40, 3), "b1": [0, 9, 0], "n": [10, 5, 3]}), 2)
    assert np.allclose(weights.sum(axis=1), 1) and (weights[:, 0] > 0).all() and (weights[:24, 1] == 0).all()


def test_interpolation_of_an_empty_table(spark):
    assert interpolation_lm.score_texts(documents(spark, [])).count() == 0


# Passages ----------------------------------------------------------------------------


@pytest.mark.parametrize("bucket_rows", [4096, 1])
def test_passages_and_paragraphs(spark, bucket_rows):
    rng = random.Random(9)
    text = lambda n: " ".join(f"v{rng.randrange(4000)}" for _ in range(n))
    shared, line = text(51), text(14)
    near = text(60).split()
    rows = [(i, f"{text(70)} {shared} {text(i)}\n{text(20)}") for i in range(5)]
    rows += [(50 + i, f"{text(30)}\n{line}\n{text(9)}") for i in range(4)]
    rows += [(80 + i, "\n".join((text(12), " ".join([*near[:50], f"n{i}", *near[51:]]), text(12)))) for i in range(3)]
    rows += [(90 + i, f"{text(40)}\n{text(40)}") for i in range(3)]  # clean
    rows += [(None, None), (200, ""), (201, "a b c"), (202, shared.upper())]
    got = {r.doc_id: r for r in paragraph_minhash.repeated_passages(documents(spark, rows), bucket_rows=bucket_rows).collect()}
    spans = lambda s: [tuple(map(int, p.split(":"))) for p in s.split(",") if p]
    assert len(got) == len(rows)
    for i in range(5):
        assert spans(got[i].repeated) == [(70, 121)], i
        assert spans(got[i].removed) == ([(70, 121)] if i else [])
    assert [spans(got[50 + i].removed) for i in range(4)] == [[]] + [[(30, 44)]] * 3
    assert all(spans(got[80 + i].repeated) == [(12, 72)] for i in range(3)) and not spans(got[80].removed) and spans(got[82].removed) == [(12, 72)]
    assert all(got[90 + i].n_repeated == 0 for i in range(3))
    assert (got[None].n_words, got[200].n_words, got[201].n_words) == (0, 0, 3) and got[202].n_removed == 51


def plain_repeats(texts: list[list[str]], width: int) -> list[set[int]]:
    """Words of each text in a run of ``width`` words that stands in two places."""
    places = defaultdict(list)
    for d, w in enumerate(texts):
        for i in range(len(w) - width + 1):
            places[tuple(w[i : i + width])].append((d, i))
    out = [set() for _ in texts]
    for own in places.values():
        for d, i in own if len(own) > 1 else ():
            out[d] |= set(range(i, i + width))
    return out


@pytest.mark.parametrize("options", [{}, {"block_bytes": 3000, "keys_a_partition": 60}])
def test_passages_end_where_they_do_in_brute_force(spark, monkeypatch, options):
    if options:
        monkeypatch.setattr(paragraph_minhash, "BLOCK_BYTES", options["block_bytes"])
        monkeypatch.setattr(paragraph_minhash, "CHUNK_BYTES", options["block_bytes"])
        monkeypatch.setattr(paragraph_minhash, "KEYS_A_PARTITION", options["keys_a_partition"])
    rng = random.Random(21)
    text = lambda n: [f"v{rng.randrange(9000)}" for _ in range(n)]
    shared = [text(rng.randint(49, 130)) for _ in range(12)]
    rows = []
    for i in range(70):
        parts = [text(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(shared), text(rng.randint(1, 60))]
        rows.append((i, " ".join(w for p in parts for w in p)))
    want = plain_repeats([words(t) for _, t in rows], 49)
    got = {r.doc_id: r for r in paragraph_minhash.repeated_passages(documents(spark, rows)).collect()}
    kept = Counter()
    for i, t in rows:
        marked, gone = ({k for p in s.split(",") if p for k in range(*map(int, p.split(":")))} for s in (got[i].repeated, got[i].removed))
        assert marked == want[i], i
        assert gone <= marked
        kept.update(w for k, w in enumerate(words(t)) if k not in gone)
    for passage in shared:  # one copy of each stays
        if sum(" ".join(passage) in t for _, t in rows):
            assert all(kept[w] for w in passage)
    assert sum(r.n_removed for r in got.values()) > 0.5 * sum(map(len, want))


def test_paragraph_recall_against_brute_force(spark):
    rng = random.Random(22)
    rows, lines = [], []
    for _ in range(150):
        base = [f"p{rng.randrange(5000)}" for _ in range(rng.randint(20, 90))]
        lines.append(base)
        lines.append([f"x{rng.random()}" if rng.random() < rng.choice((0.01, 0.02, 0.03)) else w for w in base])
    rows = [(i, " ".join(w)) for i, w in enumerate(lines)]
    near = [(a, b) for a in range(len(rows)) for b in range(a) if plain_similarity(rows[a][1], rows[b][1]) >= 0.8]
    found = {r.doc_id for r in paragraph_minhash.repeated_passages(documents(spark, rows)).collect() if r.n_repeated == r.n_words}
    pairs = {x for p in near for x in p}
    assert len(pairs) > 150 and len(pairs & found) >= 0.99 * len(pairs)


def test_short_lines_equal_brute_force(spark):
    assert paragraph_minhash.least_banded(0.8) == 8 and paragraph_minhash.least_banded(0.5) == 5 and paragraph_minhash.least_banded(0.9) == 13
    rng = random.Random(23)
    line = lambda n: [f"s{rng.randrange(9000)}" for _ in range(n)]
    lines = []
    for n in range(4, 13):
        for _ in range(14):
            own = line(n)
            lines += [own, rng.choice([own, own[:-1], own[1:], [*own[:-1], "x"], [*own, "y"]])]
    rng.shuffle(lines)
    rows = [(i, "\n".join([" ".join(line(14)), " ".join(w), " ".join(line(13))])) for i, w in enumerate(lines)]
    near = {a for a in range(len(lines)) for b in range(len(lines)) if a != b and min(len(lines[a]), len(lines[b])) >= 5 and plain_similarity(" ".join(lines[a]), " ".join(lines[b])) >= 0.8}
    short = {a for a in near if len(lines[a]) < 10}
    got = {r.doc_id: r.repeated for r in paragraph_minhash.repeated_passages(documents(spark, rows)).collect()}
    assert {i for i, s in got.items() if s} == near and all(got[i] == f"14:{14 + len(lines[i])}" for i in near)
    assert len(short) > 20 and {len(lines[a]) for a in short} >= {5, 6, 7, 8, 9}


def variants(n, size=60, changed=2, seed=1):
    """Shingle sets of so many variants of one line or text."""
    rng = np.random.default_rng(seed)
    base, out = rng.integers(1, 1 << 60, size).astype(np.uint64), []
    for _ in range(n):
        own = base.copy()
        own[rng.integers(0, size, changed)] = rng.integers(1, 1 << 60, changed).astype(np.uint64)
        out.append(np.unique(own))
    return out


def test_variants_of_one_line_cost_their_number_and_not_their_pairs(monkeypatch):
    met = []
    counter = paragraph_minhash.Counter

    def counted(values):
        own = list(values)
        met.append(len(own))
        return counter(own)

    monkeypatch.setattr(paragraph_minhash, "Counter", counted)
    cost = {}
    for n in (1000, 2000):
        met.clear()
        assert len(paragraph_minhash._similar(list(enumerate(variants(n))), 0.8)) == n - 1
        cost[n] = sum(met)
    assert cost[2000] < 2.2 * cost[1000]


def test_variants_of_one_text_cost_their_number_and_not_their_pairs(monkeypatch):
    met = []
    alike = near_copies._alike
    monkeypatch.setattr(near_copies, "_alike", lambda *a: met.append(1) or alike(*a))
    cost = {}
    for n in (1000, 2000):
        met.clear()
        members = [(i, simhash.fingerprint(x), x) for i, x in enumerate(variants(n, 300, 8))]
        assert len(near_copies.similar_links(members, 0.8)) == n - 1
        cost[n] = len(met)
    assert cost[2000] < 2.2 * cost[1000]


def test_links_of_a_block_have_the_components_of_all_pairs(monkeypatch):
    rng = random.Random(3)
    pool = np.random.default_rng(3).integers(1, 1 << 63, 400).astype(np.uint64)
    size = lambda a, b: len(np.intersect1d(a, b))
    for trial in range(60):
        monkeypatch.setattr(near_copies, "FEW_MEMBERS", rng.choice([0, 2, 16]))
        bases, members = [rng.sample(range(400), 120) for _ in range(3)], []
        for i in range(rng.randint(2, 25)):
            own = list(rng.choice(bases))
            for at in rng.sample(range(120), rng.randint(0, 18)):
                own[at] = rng.randrange(400)
            found = np.unique(pool[own])
            members.append((i, simhash.fingerprint(found), found))
        n = len(members)
        like = [(a, b) for a in range(n) for b in range(a) if (k := size(members[a][2], members[b][2])) >= 0.8 * (len(members[a][2]) + len(members[b][2]) - k)]
        close = [(a, b) for a, b in like if (members[a][1] ^ members[b][1]).bit_count() <= near_copies.RADIUS]
        assert plain_components(range(n), near_copies.similar_links(members, 0.8)) == plain_components(range(n), close)
        assert plain_components(range(n), paragraph_minhash._similar([(i, x) for i, _, x in members], 0.8)) == plain_components(range(n), like)


def test_regular_words_and_paragraphs_have_their_own_hash():
    turn = str.maketrans("ab", "ba")
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + a.translate(turn), b + b.translate(turn)
    chunk = paragraph_minhash.Chunk([a.encode(), b.encode(), " ".join(a).encode(), " ".join(b).encode()])
    units, _ = chunk.paragraphs()
    assert chunk.words[0] != chunk.words[1] and len(set(units.tolist())) == 2


def test_equal_rows_are_copies(spark):
    text = " ".join(f"q{i}" for i in range(80))
    got = paragraph_minhash.repeated_passages(documents(spark, [(7, text), (7, text), (8, text)])).collect()
    assert sorted(r.n_removed for r in got) == [0, 80, 80] and all(r.n_repeated == 80 for r in got)
    assert paragraph_minhash.repeated_passages(documents(spark, [])).count() == 0


def test_every_long_shared_run_is_sampled():
    rng = random.Random(10)
    shared = [f"s{i}" for i in range(49)]
    for _ in range(40):
        texts = [" ".join([f"a{rng.random()}" for _ in range(rng.randrange(60))] + shared + [f"b{rng.random()}" for _ in range(rng.randrange(60))]).encode() for _ in range(2)]
        chunk = paragraph_minhash.Chunk(texts)
        at, keys = chunk.runs()
        owner = chunk.doc[at]
        assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist())


# Mixing ------------------------------------------------------------------------------


def plain_targets(sizes: dict) -> dict:
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    open_, target, left = set(names), {}, 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        open_ -= over
    return target


@pytest.mark.parametrize("slot_rows", [2048, 3])
def test_mix_meets_its_targets(spark, slot_rows):
    rng = random.Random(11)
    docs = documents(spark, awkward_texts() + [(1000 + i, " ".join(["w"] * rng.randint(1, 30))) for i in range(300)])
    rows = docs.collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len(WORDS.findall(r.text or ""))
    got = mixing.mix(docs, slot_rows=slot_rows).collect()
    target = plain_targets(dict(sizes))
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source], rel_tol=1e-12)
        assert r.taken == r.copies * r.size and r.taken <= 2 * r.size
        taken[r.source] += r.taken
    largest = max(len(WORDS.findall(r.text or "")) for r in rows)
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= largest for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(3), slot_rows=slot_rows).collect()))
    mixed = mixing.mixed_rows(docs, slot_rows=slot_rows)
    assert mixed.columns == docs.columns
    again = Counter()
    for r in mixed.collect():
        again[r.source, r.doc_id, len(WORDS.findall(r.text or ""))] += 1
    once = Counter()
    for r in got:
        once[r.source, r.doc_id, r.size] += r.copies
    assert again == +once


def test_mixed_rows_of_one_id_stay_within_the_target(spark):
    rng = random.Random(13)
    for name in (7, None):
        rows = [(name, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randint(5, 60)))) for _ in range(120)]
        rows += [(name, rows[0][1])] * 20
        docs = documents(spark, rows)
        target = {r.source: r.target for r in mixing.mix(docs).collect()}
        taken = Counter()
        for r in mixing.mixed_rows(docs).collect():
            taken[r.source] += len(r.text.split())
        assert all(abs(taken[s] - t) <= 60 for s, t in target.items())


def test_slots_are_even_whatever_the_quality(spark):
    import pyspark.sql.functions as F

    junk = F.when(F.col("id") % 10 < 6, "#### ").when(F.col("id") % 10 < 8, "aaaaaaaaaaa#### ").otherwise("word ")
    docs = spark.range(60000).select(F.col("id").alias("doc_id"), F.repeat(junk, 4).alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    placed, _ = mixing._placed(docs, 500, mixing.SOURCE_WEIGHTS, mixing.TOTAL_SHARE, mixing.MAX_REPEATS)
    held = [r["count"] for r in placed.groupBy("source", "slot").count().collect()]
    assert max(held) <= 1000 and len(held) >= 100
    plan = mixing.mixed_rows(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_mix_prefers_quality(spark):
    text = "word " * 20
    rows = [(i, text if i % 2 else "#$% &*| " * 10) for i in range(2000)]
    docs = spark.createDataFrame([(i, t, "en", "a" if i < 1000 else "b", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.mix(docs, share=1.2).where("source = 'b'").collect()
    assert {r.copies for r in got} <= {0, 1}
    share = lambda odd: np.mean([r.copies for r in got if r.doc_id % 2 == odd])
    assert share(1) > share(0) + 0.1
    assert mixing.mix(docs.where("false")).count() == 0


# Decontamination ---------------------------------------------------------------------


def plain_contamination(docs, items):
    import re

    split = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    owners = defaultdict(set)
    for name, text in items:
        w = split.findall(lower(text))
        for i in range(max(1, len(w) - 12) if w and name is not None else 0):
            owners[tuple(w[i : i + 13])].add(str(name))
    out = []
    for doc, text in docs:
        w = split.findall(lower(text))
        hit, found = set(), set()
        for n in {len(o) for o in owners}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in owners:
                    hit |= set(range(i, i + n))
                    found |= owners[k]
        out.append((doc, len(w), len(hit), len(found), ",".join(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("options", [{}, {"slice_bytes": 40, "shard_bytes": 300, "every": 3}])
def test_decontamination_equals_brute_force(spark, options):
    import hashlib

    rows = awkward_texts()
    texts = [t for _, t in rows if t and len(t.split()) > 30]
    items = [(k, " ".join(t.split()[2:22])) for k, t in enumerate(texts[:6])] + [(10, texts[0]), (11, "one"), (12, None), (13, "?!"), (14, "one Two"), (None, texts[1]), (15, texts[0].upper()), (16, "É é é")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows += [(600, "-".join(texts[2].split()[:25])), (601, "é É é one")]
    got = fm_index.decontaminate(documents(spark, rows), benchmark, **options).collect()
    want = Counter((a, b, c, d, hashlib.sha256(e.encode()).hexdigest(), f) for a, b, c, d, e, f in plain_contamination(rows, items))
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
    assert all(sum(s.end - s.start for s in r.spans) == r.n_hit for r in got)


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert fm_index.decontaminate(documents(spark, []), none).count() == 0
    assert all(r.n_hit == 0 for r in fm_index.decontaminate(documents(spark), none).collect())
    assert fm_index.clean_rows(documents(spark), none).count() == documents(spark).count()


@pytest.mark.parametrize("shard_bytes", [4 << 20, 300])
def test_clean_rows_are_judged_one_by_one(spark, shard_bytes):
    rows = awkward_texts()
    texts = [t for _, t in rows if t and len(t.split()) > 30]
    rows += [(3, texts[1]), (None, texts[1]), (None, "clean words"), (3, "clean words")]
    items = [(1, texts[1]), (2, texts[2])]
    bad = [c[-1] for c in plain_contamination(rows, items)]
    docs = documents(spark, rows)
    kept = fm_index.clean_rows(docs, spark.createDataFrame(items, "item_id long, text string"), shard_bytes=shard_bytes)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(row for row, b in zip(rows, bad) if not b)


def test_fm_index_searches_and_locates():
    rng = np.random.default_rng(12)
    for symbols in (1, 3, 9):
        text = rng.integers(1, symbols + 1, 200)
        index = fm_index.FMIndex(text, symbols, every=5)
        for length in (1, 2, 4):
            at = rng.integers(0, 196, 20)
            phrases = np.zeros((20, 5), np.int64)
            for i, a in enumerate(at):
                phrases[i, 5 - length :] = text[a : a + length]
            lo, hi = index.search(phrases, np.full(20, length))
            for i in range(20):
                want = [k for k in range(200 - length + 1) if (text[k : k + length] == phrases[i, 5 - length :]).all()]
                assert sorted(index.locate(np.arange(lo[i], hi[i])).tolist()) == want


def test_scan_of_a_shard_holds_little_beside_its_suffixes():
    """A rank of every place in each of 17 levels took as much again as the suffix sort."""
    rng = random.Random(5)
    texts = [" ".join(f"w{int(rng.paretovariate(0.6)) % 60_000}" for _ in range(4000)).encode() for _ in range(150)]
    part = fm_index.PhraseSlice([("i", b" ".join(texts[7].split()[100:120]))])
    tracemalloc.start()
    try:
        found = fm_index.scan_shard(texts, [part])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert (100, 120) in found[7][1] and found[7][2] == ["i"] and peak < 75e6
