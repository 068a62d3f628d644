"""Vector codes, periodic runs and k-d shards against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from scriptorium.llm import kd_sharding, vector_codes
from scriptorium.llm.periodic_runs import find_runs, next_smaller, periodic_runs, run_digests
from tests.llm.helpers import awkward_texts, documents

# Vector codes ------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, code string, error long, v int"


def vectors(n=400, width=8, seed=4):
    rng = np.random.default_rng(seed)
    rows = [(int(i), rng.normal(size=width).astype(np.float32).tolist(), int(i) % 3 if i % 5 else None) for i in rng.permutation(n)]
    rows += [(9000 + i, [0.25] * width, 7) for i in range(150)]  # a common vector
    rows += [(3, [0.5] * width, 1), (3, [0.5] * width, 1), (None, [0.1] * width, None)]
    rows += [(9500, None, 1), (9501, [None] + [1.0] * (width - 1), 1), (9502, [math.nan] * width, 2), (9503, [math.inf] * width, 2)]
    return rows


def plain_codes(rows, parts, entries, rounds, scale=1024):
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max((len(v) for _, v, _ in kept), default=0) // parts))
    cut = [[[math.floor(scale * x) for x in (list(v) + [0.0] * (parts * width - len(v)))[p * width : (p + 1) * width]] for p in range(parts)] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[cut[k][p] for k in order] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min((far(x[p], e), n) for n, e in enumerate(books[p])) for p in range(parts)] for x in cut]
    for _ in range(rounds):
        found, groups = assign(), defaultdict(list)
        for x, near in zip(cut, found):
            for p, (_, n) in enumerate(near):
                groups[p, n].append(x[p])
        for (p, n), own in groups.items():
            books[p][n] = [sum(c) // len(own) for c in zip(*own)]
    last = assign()
    by_label = Counter()
    for (_, _, label), near in zip(kept, last):
        by_label[label] += sum(d for d, _ in near)
    digest = hashlib.sha256(",".join(str(c) for p in books for e in p for c in e).encode()).hexdigest()
    return Counter((i, "".join(f"{n:02x}" for _, n in near), sum(d for d, _ in near), by_label[label], digest) for (i, _, label), near in zip(kept, last))


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1, 2) for i, v, label in rows], VECTORS)


@pytest.mark.parametrize("options", [{"entries": 16}, {"entries": 256, "rounds": 1}, {"entries": 5, "parts": 3, "rounds": 2}, {"entries": 2, "parts": 1}])
def test_codes_equal_brute_force(spark, monkeypatch, options):
    monkeypatch.setattr(vector_codes, "BATCH_ROWS", 7)
    rows = vectors()
    got = vector_codes.compress(frame(spark, rows).repartition(5), **options).collect()
    wanted = plain_codes(rows, **({"parts": 4, "rounds": 4} | options))
    assert Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == wanted


def test_codes_of_few_uneven_and_no_vectors(spark):
    rows = [(1, [1.0, 2.0, 3.0], 1), (2, [], None), (3, [-4.0], None), (3, [-4.0], None), (None, [2.5] * 9, 5)]
    got = vector_codes.compress(frame(spark, rows)).collect()
    assert Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == plain_codes(rows, 4, 256, 4)
    assert vector_codes.compress(frame(spark, [])).count() == 0
    assert vector_codes.compress(frame(spark, [(1, None, 1), (2, [math.nan], 2)])).count() == 0
    only = vector_codes.compress(frame(spark, [(1, [], 1)])).collect()
    assert [(r.code, r.error) for r in only] == [("00000000", 0)]


def test_large_components_do_not_overflow(spark):
    got = vector_codes.compress(frame(spark, [(1, [3e38, -3e38] * 4, 1), (2, [1.0] * 8, 1)]), entries=1).collect()
    assert all(r.error > 0 for r in got) and len(got) == 2


def test_codes_decode_to_their_entries(spark):
    rows = vectors(60)
    kept = vector_codes.kept_vectors(frame(spark, rows))
    books = vector_codes.learned_codebooks(kept, entries=16)
    codes = vector_codes.encoded(kept, books)
    back = {(r.vec_id, r.code): r.vector for r in vector_codes.decoded(codes, books, length=8).collect()}
    for r in codes.join(kept, "vec_id").collect():
        if r.vec_id is None or r.vec_id == 3:
            continue
        entry = np.array(back[r.vec_id, r.code]) * 1024
        assert int(((np.floor(np.array(r.v) * 1024) - entry) ** 2).sum()) == r.error


# Periodic runs -----------------------------------------------------------------------


def plain_runs(w, least_words=6, least_periods=4):
    out = []
    for q in range(1, len(w) // least_periods + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i + q - start
            own = w[start : start + n]
            if n >= max(least_words, least_periods * q) and not any(all(own[k] == own[k + d] for k in range(n - d)) for d in range(1, q)):
                out.append((start, n, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = random.Random(11)
    for _ in range(300):
        texts = []
        for _ in range(rng.randint(1, 8)):
            letters = rng.randint(1, 4)
            base = [rng.randrange(letters) for _ in range(rng.randint(1, 7))]
            edge = lambda: [rng.randrange(3) for _ in range(rng.randint(0, 5))]
            texts.append(rng.choice([edge() + (base * 9)[: rng.randint(0, 60)] + edge(), [rng.randrange(letters) for _ in range(rng.randint(0, 50))]]))
        least_words, least_periods = rng.choice([1, 2, 6]), rng.choice([2, 3, 4])
        got = find_runs(np.array([c for t in texts for c in t], np.int64), np.array([len(t) for t in texts], np.int64), least_words, least_periods)
        found = [[] for _ in texts]
        for t, s, n, q in zip(got.text.tolist(), got.start.tolist(), got.length.tolist(), got.period.tolist()):
            found[t].append((s, n, q))
        assert found == [plain_runs(t, least_words, least_periods) for t in texts]


def test_next_smaller():
    rng = random.Random(5)
    for _ in range(100):
        x = rng.sample(range(200), rng.randint(1, 90))
        want = [next((j for j in range(i + 1, len(x)) if x[j] < x[i]), len(x)) for i in range(len(x))]
        assert next_smaller(np.array(x)).tolist() == want


def test_a_long_period_in_a_long_text():
    rng = random.Random(8)
    base = [rng.randrange(50) for _ in range(9001)]
    text = [60, 61] + base * 5 + base[:17] + [62]
    got = find_runs(np.array(text, np.int64), np.array([len(text)]))
    assert (2, 5 * 9001 + 17, 9001) in set(zip(got.start.tolist(), got.length.tolist(), got.period.tolist()))


def plain_digests(doc_id, text, plant=True):
    words = [w.encode() for w in __import__("re").findall("[^\x20\x09-\x0d]+", text or "")]
    if plant and doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    best = max(runs, key=lambda r: (r[1] * 10**9 // r[2], -r[0], -r[2]), default=None)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    digest = lambda b: hashlib.sha256(b).hexdigest()
    listed, kept = "".join(f"{s},{n},{q}\n" for s, n, q in runs), b" ".join(w for k, w in enumerate(words) if k not in gone)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest(listed.encode()), digest(kept))


@pytest.mark.parametrize("batch_words", [1 << 18, 20])
def test_run_digests_over_a_table(spark, batch_words):
    rows = [(i, t) for i, t in awkward_texts() if len(t or "") < 4000]
    rows += [(200, "a " * 9), (201, "x y " * 5 + "x"), (202, "é ü  " * 4), (203, "a a a a a b b b b b b a a a a a a"), (204, "p q r " * 4 + "q q q q q q q"), (205, "A a " * 6)]
    rows += [(i, " ".join(f"w{i % 7}{k}" for k in range(30))) for i in range(300, 400)]  # a tenth are made periodic
    got = run_digests(documents(spark, rows), plant=True, batch_words=batch_words).collect()
    assert Counter(tuple(r) for r in got) == Counter(plain_digests(i, t) for i, t in rows)
    assert sum(r.n_runs > 0 for r in got) > 10
    assert run_digests(documents(spark, []), plant=True).count() == 0


def test_runs_and_collapsed_texts(spark):
    got = periodic_runs(documents(spark, [(1, "say  no no no no no no\nmore"), (2, None)])).collect()
    by_id = {r.doc_id: r for r in got}
    assert (by_id[1].runs, bytes(by_id[1].collapsed)) == ("1,6,1\n", b"say no more")
    assert (by_id[2].n_runs, by_id[2].runs, bytes(by_id[2].collapsed)) == (0, "", b"")


# K-d shards --------------------------------------------------------------------------


def plain_shards(rows, shards):
    """(doc_id, size, shard) by sorting each node whole; ``rows`` are (doc_id, text, lang, source)."""
    number = lambda s: int.from_bytes((s or "").encode()[:7].ljust(7, b"\0"), "big")
    points = []
    for place, (i, t, lang, source) in enumerate(rows):
        raw = (t or "").encode()
        tie = int(hashlib.md5(("" if i is None else str(i)).encode() + b":" + raw).hexdigest()[:12], 16)
        points.append(((number(source), number(lang), len(raw) + 8, i or 0), tie, place, i, len(raw) + 8))
    extent = lambda own, d: max(p[0][d] for p in own) - min(p[0][d] for p in own)
    out = []

    def cut(own, first, k):
        if k == 1 or not own:
            out.extend((p[3], p[4], first) for p in own)
            return
        d = max(range(4), key=lambda d: (extent(own, d) / max(extent(points, d), 1), -d))
        own = sorted(own, key=lambda p: (p[0][d], p[1], p[2]))
        goal, before, left = 2 * sum(p[4] for p in own) * (k // 2) // k, 0, []
        for p in own:
            if 2 * before + p[4] <= goal:
                left.append(p)
            before += p[4]
        cut(left, first, k // 2)
        cut(own[len(left) :], first + k // 2, k - k // 2)

    cut(points, 0, shards)
    return Counter(out)


def sharded(spark, rows, parts=1):
    full = [(i, t, lang, source, len(t or ""), 1, 2, 3) for i, t, lang, source in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, size long, node long, shard long, slot long").coalesce(parts)


def shard_rows(seed=1):
    rng = random.Random(seed)
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["hot"] * 5 + ["b", "ab", "abcdefghi", "abcdefgxx", None, ""])) for i, t in awkward_texts()]
    rows += [(i, "same text " * 9, "en", "hot") for i in range(1000, 1200)]  # copies
    rows += [(77, "the very same row", "en", "hot")] * 150  # one row, many times
    rows += [(rng.randrange(10**12), "w " * rng.randint(0, 400), "fr", f"s{rng.randrange(9)}") for _ in range(300)]
    return rows


@pytest.mark.parametrize("options", [{}, {"bins": 4, "cut_rows": 3}, {"shards": 7, "bins": 2, "cut_rows": 1}])
def test_shards_equal_sorting_each_node(spark, options):
    rows = shard_rows()
    got = kd_sharding.kd_shards(sharded(spark, rows), **options).collect()
    assert Counter((r.doc_id, r["size"], r.shard) for r in got) == plain_shards(rows, options.get("shards", 24))
    assert Counter((r.doc_id, r.text_crc32) for r in got) == Counter((i, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    slots = defaultdict(list)
    for r in got:
        assert (r.law, r.grown_shard) == ("bytes", None)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_are_near_equal_and_reruns_agree(spark):
    rng = random.Random(2)
    rows = [(i, "x" * rng.randint(0, 300), "en", "hot" if rng.random() < 0.4 else f"s{i % 11}") for i in range(6000)]
    docs = sharded(spark, rows).repartition(8, "doc_id")
    got = kd_sharding.kd_shards(docs).collect()
    bytes_ = Counter()
    for r in got:
        bytes_[r.shard] += r["size"]
    assert len(bytes_) == 24 and max(bytes_.values()) - min(bytes_.values()) <= 2 * 308
    again = kd_sharding.kd_shards(docs).collect()
    assert sorted((r.doc_id, r.shard) for r in again) == sorted((r.doc_id, r.shard) for r in got)


def test_target_bytes_and_tables_without_rows(spark):
    docs = sharded(spark, [(i, "y" * 92, "en", "a") for i in range(100)])
    got = kd_sharding.kd_shards(docs, target_bytes=1000).collect()
    assert Counter(Counter(r.shard for r in got).values()) == {10: 10}
    assert kd_sharding.kd_shards(sharded(spark, [])).count() == 0
    few = kd_sharding.kd_shards(sharded(spark, [(None, None, None, None), (1, "", "", "")])).collect()
    assert sorted((r.doc_id or 0, r["size"]) for r in few) == [(0, 8), (1, 8)] and all(0 <= r.shard < 24 for r in few)


def test_written_shards_hold_every_row(spark, tmp_path):
    rows = shard_rows(3)
    docs = sharded(spark, rows)
    spark.read.parquet(kd_sharding.write_shards(docs, str(tmp_path / "out"), shards=5)).createOrReplaceTempView("written")
    assert spark.table("written").columns == [*docs.columns, "shard_"]  # docs has a column of that name
    assert spark.table("written").select(docs.columns).exceptAll(docs).count() == 0 and spark.table("written").count() == len(rows)
    want = Counter((r.doc_id, r.shard) for r in kd_sharding.kd_shards(docs, shards=5).collect())
    assert Counter((r.doc_id, r.shard_) for r in spark.table("written").select("doc_id", "shard_").collect()) == want


def test_placing_runs_no_python(spark):
    plan = kd_sharding.kd_shards(sharded(spark, shard_rows()))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
