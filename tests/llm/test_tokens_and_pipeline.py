"""Token files and the pipeline."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from scriptorium.llm import fm_index, token_orc
from scriptorium.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.helpers import awkward_texts, documents

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_orc.default_tokenizer())


def test_encoder_equals_the_library(library):
    rng = random.Random(1)
    parts = [" ", " ", "\n", "\t", "a", "B", "é", "1", "²", ".", ",", "'s", "'", "<|endoftext|>", "\0", " ", "中", "\r", "__", "\x1c", "\x85", "　", "”", "word", "\x0b"]
    encoder = token_orc.Encoder(token_orc.default_tokenizer())
    for _ in range(150):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(40)]
        ids, sizes = encoder.encode([t.encode() for t in texts])
        assert ids.tolist() == [x for t in texts for x in library.encode(t, add_special_tokens=False).ids]
        assert sizes.tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_words_alike_under_a_polynomial_hash_keep_their_ids(library):
    encoder = token_orc.Encoder(token_orc.default_tokenizer())
    rng = random.Random(2)
    turn = str.maketrans("ab", "ba")
    words = ["a", "b"]
    for _ in range(12):
        words = [w + w.translate(turn) for w in words]
        words_now = [*words, "".join(rng.choice("abé") for _ in range(len(words[0])))]
        for text in (*words_now, *(f"x {w} y" for w in words_now), *words_now):
            assert encoder.encode([text.encode()])[0].tolist() == library.encode(text, add_special_tokens=False).ids
    texts = ["".join(rng.choice("ab\0 ") for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    ids, _ = encoder.encode([t.encode() for t in texts])
    assert ids.tolist() == [x for t in texts for x in library.encode(t, add_special_tokens=False).ids]


def test_a_key_that_two_units_share_gives_each_its_ids(library, monkeypatch):
    monkeypatch.setattr(token_orc, "mix", lambda x: x & np.uint64(3))
    encoder = token_orc.Encoder(token_orc.default_tokenizer())
    for text in ("one two three four five six", "six five seven one", "eight nine ten one two"):
        assert encoder.encode([text.encode()])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_learning_units_holds_one_table_of_them(monkeypatch):
    import tracemalloc

    encoder = token_orc.Encoder(token_orc.default_tokenizer())
    rng, n = np.random.default_rng(3), 60_000
    monkeypatch.setattr(encoder, "_unit_ids", lambda units: (np.zeros(4 * n, np.int32), np.full(n, 4)))
    tracemalloc.start()
    try:
        for _ in range(20):
            keys = np.sort(rng.integers(0, 1 << 63, n).astype(np.uint64))
            encoder._learn(keys, keys, keys, [])
        held = len(encoder.settled[0]) + len(encoder.recent[0])
        assert held == 20 * n and tracemalloc.get_traced_memory()[1] < 64 * held  # 29 bytes and 4 ids each, and a column that is being copied
    finally:
        tracemalloc.stop()


def test_batches_that_workers_get_are_of_bounded_bytes(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen = spark.conf.get(name), []
    plan = type(spark.range(0)).mapInArrow
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda *a, **b: seen.append(spark.conf.get(name)) or plan(*a, **b))
    docs = spark.range(0, 60, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 100).alias("text"))
    assert token_orc.encode_and_index(docs, folder=str(tmp_path / "ids")).count() == 60
    assert seen and all(int(x) <= 1 << 22 for x in seen) and spark.conf.get(name) == before


def test_files_are_ordered_by_part_number(spark, tmp_path):
    folder = tmp_path / "ids"
    token_orc.write_tokens(documents(spark), str(folder), partitions=3)
    files = sorted(p for p in folder.iterdir() if p.suffix == ".orc")
    for k, path in enumerate(files):  # as if there were over 100,000 files
        path.rename(folder / path.name.replace(f"part-{k:05d}", f"part-{99999 + k}"))
        crc = folder / f".{path.name}.crc"
        crc.unlink(missing_ok=True)
    rows = sorted(token_orc.token_index(spark, str(folder)).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in rows if r.doc_id is not None]
    assert ids == sorted(ids) and all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:]))


def test_other_tokenizers_go_through_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    ids, _ = token_orc.Encoder(path).encode([b"Some words, here", b""])
    assert ids.tolist() == Tokenizer.from_file(path).encode("Some words, here", add_special_tokens=False).ids


def test_files_hold_every_document_in_order(spark, library, tmp_path):
    rows = awkward_texts()
    got = token_orc.encode_and_index(documents(spark, rows), folder=str(tmp_path / "ids")).collect()
    encoded = [(i, np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")) for i, t in rows]
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted((i is not None, i or 0, len(x), zlib.crc32(x.tobytes())) for i, x in encoded)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ordered = [r.doc_id for r in sorted(got, key=lambda r: r.start) if r.doc_id is not None]
    assert ordered == sorted(ordered)
    one = token_orc.read_tokens(spark, str(tmp_path / "ids")).where("doc_id = 110")
    assert "doc_id" in one._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1][:80]
    assert one.count() == 1
    assert token_orc.encode_and_index(documents(spark, []), folder=str(tmp_path / "none")).count() == 0


def test_orc_files_have_bloom_filters(spark, tmp_path):
    from pyarrow import orc

    folder = token_orc.write_tokens(documents(spark), str(tmp_path / "ids"))
    path = next(p for p in (tmp_path / "ids").iterdir() if p.suffix == ".orc")
    assert orc.ORCFile(str(path)).row_index_stride == token_orc.ROW_INDEX_STRIDE
    assert "BLOOM" in _footer(spark, f"{folder}/{path.name}")


def _footer(spark, path: str) -> str:
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.orc.OrcFile.readerOptions(conf))
    rows = reader.rows()
    stripe = reader.getStripes().get(0)
    return str(rows.readStripeFooter(stripe).toString()).upper()


def test_every_query_runs_and_agrees_with_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name, sql in ORACLE_SQL.items():
        frame = QUERIES[name](spark, SF)
        own, other = frame.toPandas(), con.sql(sql).df()
        columns = sorted(own.columns)
        assert columns == sorted(other.columns), name
        key = lambda f: sorted(map(tuple, f[columns].astype(str).replace({"None": "nan", "<NA>": "nan"}).to_numpy().tolist()))  # noqa: E731  nulls
        assert key(own) == key(other), name


def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, seen[-1], SF).write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
        assert seen[-1].columns == columns
    counts = [d.count() for d in seen]
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    assert all(b <= a for a, b in zip(ids, ids[1:]))
    assert seen[2].select("text").distinct().count() == counts[2]
    assert not fm_index.decontaminate(seen[3], spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").count()
    last = corpus_pipeline.STAGES[-1][1](spark, seen[-1], SF)
    assert last.count() == counts[-1]
    assert len({r.start for r in last.collect()}) == counts[-1]


def test_run_applies_all_stages(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() > 0
