"""Stored versions, checkpoints, streams of states, seen sources and merges by field."""

import threading
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import upserts
from scriptorium.sources.stored import StoredTable, VersionTaken
from scriptorium.streaming import paper_states, seen
from scriptorium.streaming.checkpoints import Checkpoint


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


# Stored tables -----------------------------------------------------------------------


@pytest.fixture
def table(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"v{i}") for i in range(50)], "k long, v string")
    return StoredTable.create(spark, str(tmp_path / "t"), rows, "k", buckets=8)


def test_versions_can_be_read_after_changes(spark, table):
    first = rows_of(table.read())
    assert table.merge(spark.createDataFrame([(3, "new", False), (4, None, True), (99, "more", False)], "k long, v string, _deleted boolean"), "batch 1") == 1
    now = dict(rows_of(table.read()))
    assert (now[3], 4 in now, now[99], len(now)) == ("new", False, "more", 50)
    assert rows_of(table.read(0)) == first
    assert table.delete(spark.createDataFrame([(99, "x"), (99, "y"), (1234, "z")], "k long, other string")) == 2
    assert 99 not in dict(rows_of(table.read())) and dict(rows_of(table.read(1)))[99] == "more"
    assert rows_of(table.changes(0, 1)) == sorted([(3, "new", "new"), (3, "v3", "gone"), (4, "v4", "gone"), (99, "more", "new")], key=str)
    history = rows_of(table.history())
    assert [(v, o) for v, o, _ in history] == [(0, "create"), (1, "batch 1"), (2, "delete")] and history[0][2] == 8 and 1 <= history[1][2] <= 3
    assert table.restore(0) == 3 and rows_of(table.read()) == first
    assert table.replace(spark.createDataFrame([(1, "one")], "k long, v string")) == 4 and rows_of(table.read()) == [(1, "one")]
    with pytest.raises(FileNotFoundError):
        table.read(17)


def test_only_touched_buckets_are_written_and_read(spark, table):
    before = table.at().places
    table.merge(spark.createDataFrame([(7, "x")], "k long, v string"))
    after = table.at().places
    assert sum(before[b] != after[b] for b in before) == 1
    found = table.matching(spark.createDataFrame([(7,), (8,), (5000,)], "k long"))
    assert rows_of(found) == [(7, "x"), (8, "v8")]
    assert len(table.matching(spark.createDataFrame([(7,)], "k long")).inputFiles()) < len(table.read().inputFiles())


def test_awkward_keys_and_columns(spark, tmp_path):
    rows = spark.createDataFrame([(None, "n", 1, "b"), ("", "e", 2, "b"), ("é", None, None, None)], "k string, v string, _k0 int, bucket string")
    table = StoredTable.create(spark, str(tmp_path / "t"), rows, ["k"], buckets=4)
    assert rows_of(table.read()) == rows_of(rows)
    table.merge(spark.createDataFrame([(None, "changed", "extra")], "k string, v string, other string"))
    assert {r.k: r.v for r in table.read().collect()} == {None: "changed", "": "e", "é": None}
    with pytest.raises(ValueError, match="2 rows"):
        table.merge(spark.createDataFrame([("a", "1"), ("a", "2")], "k string, v string"))
    with pytest.raises(ValueError, match="no column"):
        StoredTable.create(spark, str(tmp_path / "u"), rows, "absent")
    with pytest.raises(VersionTaken):
        StoredTable.create(spark, str(tmp_path / "t"), rows, "k")
    none = StoredTable.create(spark, str(tmp_path / "none"), rows.where("false"), "k")
    assert none.read().count() == 0 and none.merge(rows.where("false")) == 1 and none.exists()
    assert not StoredTable(spark, str(tmp_path / "nothing")).exists()


def test_writers_at_one_time_lose_nothing(spark, table):
    errors = []

    def write(n):
        try:
            for i in range(3):
                table.merge(spark.createDataFrame([(1000 + 10 * n + i, f"w{n}"), (i, f"w{n}")], "k long, v string"), f"writer {n}")
        except Exception as error:  # noqa: BLE001  reported below
            errors.append(error)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    now = dict(rows_of(table.read()))
    assert {1000 + 10 * n + i for n in range(4) for i in range(3)} <= set(now) and len(now) == 62
    assert table.versions() == list(range(13)) and all(now[i].startswith("w") for i in range(3))


def test_a_writer_that_expects_another_version_fails(spark, table):
    one = spark.createDataFrame([(1, "x")], "k long, v string")
    table.merge(one)
    with pytest.raises(VersionTaken):
        table.merge(one, expect=0)
    assert table.merge(one, expect=1) == 2


def test_a_lost_race_is_worked_out_again_where_buckets_meet(spark, table, monkeypatch):
    other = StoredTable(spark, table.root)
    real, raced = StoredTable._commit, []

    def commit(self, version):
        if not raced and version.operation == "slow":
            raced.append(1)
            other.merge(spark.createDataFrame([(1, "theirs"), (2, "theirs")], "k long, v string"), "fast")
        return real(self, version)

    monkeypatch.setattr(StoredTable, "_commit", commit)
    assert table.merge(spark.createDataFrame([(1, "mine")], "k long, v string"), "slow") == 2
    now = dict(rows_of(table.read()))
    assert (now[1], now[2], len(now)) == ("mine", "theirs", 50)


def test_old_versions_are_given_up_with_their_files(spark, table):
    for i in range(3):
        table.merge(spark.createDataFrame([(i, "x")], "k long, v string"))
    places = [set(table.at(n).places.values()) for n in range(4)]
    assert table.forget(3) == len((places[0] | places[1] | places[2]) - places[3]) > 0
    assert table.versions() == [3] and table.read().count() == 50
    with pytest.raises(FileNotFoundError):
        table.read(0)


# Checkpoints -------------------------------------------------------------------------


def results(spark, *rows):
    return spark.createDataFrame(list(rows), "paper_id string, status string, error string")


def test_a_checkpoint_from_creation_to_deletion(spark, tmp_path):
    papers = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "paper_id string")
    root = str(tmp_path / "cp")
    none = Checkpoint(spark, root)
    assert none.run() is None and none.pending().count() == 0 and not none.is_stale()
    none.delete()
    with pytest.raises(FileNotFoundError):
        none.update(results(spark, ("a", "ok", None)), "x")
    with pytest.raises(FileNotFoundError):
        none.final_pass("ok")
    with pytest.raises(ValueError, match="tier"):
        Checkpoint.create(spark, root, papers, 2, tier="half")
    cp = Checkpoint.create(spark, root, papers, 2, "base", "full", spark.createDataFrame([("old",)], "paper_id string"))
    run = cp.run()
    assert (run["status"], run["total"], run["wave_size"], run["last_completed_wave"], run["squash_base"], run["wave_commits"], run["tier"], run["final_pass_status"]) == ("in-progress", 3, 2, -1, "base", [], "full", "pending")
    assert rows_of(cp.before()) == [("old",)] and {r.status for r in cp.papers().collect()} == {"pending"}
    assert cp.update(results(spark, ("a", "ok", None), ("b", "failed", "boom")), "c0") == 0
    assert cp.update(results(spark, ("b", "ok", ""), ("new", "failed", "late")), "c1") == 1
    assert rows_of(cp.papers()) == sorted([("a", "ok", None, 0), ("b", "ok", "boom", 1), ("c", "pending", None, None), ("new", "failed", "late", 1)], key=str)
    assert rows_of(cp.pending()) == [("c",), ("new",)]
    assert rows_of(cp.papers(1)) == sorted([("a", "ok", None, 0), ("b", "failed", "boom", 0), ("c", "pending", None, None)], key=str)
    assert (cp.run()["last_completed_wave"], cp.run()["wave_commits"]) == (1, ["c0", "c1"])
    for status in ("in-progress", "failed", "ok"):
        cp.final_pass(status)
        assert cp.run()["final_pass_status"] == status
    for status in ("skipped", "nonsense"):
        with pytest.raises(ValueError):
            cp.final_pass(status)
    cp.delete()
    assert cp.run() is None and Checkpoint(spark, root).run() is None and cp.run(0)["total"] == 3
    again = Checkpoint.create(spark, root, papers, 5)
    assert (again.run()["final_pass_status"], again.pending().count(), again.before().count()) == ("skipped", 3, 0)
    with pytest.raises(ValueError, match="full"):
        again.final_pass("ok")


def test_stale_checkpoints(spark, tmp_path):
    papers = spark.createDataFrame([("a",)], "paper_id string")
    began = datetime(2026, 4, 1, 12, tzinfo=timezone.utc)
    cp = Checkpoint.create(spark, str(tmp_path / "cp"), papers, 2, run_id="2026-04-01T12:00:00Z", buckets=1)
    assert not cp.is_stale(began + timedelta(hours=24)) and cp.is_stale(began + timedelta(hours=24, seconds=1))
    odd = Checkpoint.create(spark, str(tmp_path / "cp"), papers, 2, run_id="yesterday")
    assert odd.is_stale()


# Streams -----------------------------------------------------------------------------

HOUR = 3_600_000


def test_transitions_of_a_paper():
    step = paper_states.step
    begun, why = step(("pending", 0, None), "in-progress", 5)
    assert (begun, why) == (("in-progress", 1, 5), "")
    failed, _ = step(begun, "failed", 6)
    again, _ = step(failed, "in-progress", 7)
    failed, _ = step(again, "failed", 8)
    assert step(failed, "in-progress", 9) == (failed, "no third attempt")
    assert step(("ok", 1, None), "failed", 9)[1] == step(("pending", 0, None), "ok", 1)[1] == step(("pending", 0, None), None, 1)[1] == "no such transition"


def plain_states(events):
    """Changes of each paper by the rules, event after event."""
    state, out = {}, []
    for key, status, at, seq in sorted(events, key=lambda e: (e[2], e[3])):
        now = state.get(key, ("pending", 0, None))
        if (limit := paper_states.stale_at(now)) is not None and at > limit:
            now = ("pending", now[1] - 1, None)
            out.append((key, None, limit, "in-progress", "pending", True, now[1], "stale"))
        after, why = paper_states.step(now, status, at)
        out.append((key, seq, at, now[0], status, not why, after[1], why))
        state[key] = after
    return state, out


def test_a_stream_that_is_stopped_goes_on_where_it_was(spark, tmp_path):
    import random

    rng = random.Random(9)
    t0 = 1_700_000_000_000
    events = [(rng.choice("abcdef"), rng.choice(["in-progress", "in-progress", "ok", "failed", "failed", "nonsense", None]), t0 + i * 3 * HOUR + rng.randrange(HOUR), i) for i in range(120)]
    schema = "key string, status string, at timestamp, seq long"
    folder = tmp_path / "in"

    def put(n, some):
        df = spark.createDataFrame([(k, s, at, q) for k, s, at, q in some], "key string, status string, ms long, seq long")
        df.select("key", "status", F.timestamp_millis("ms").alias("at"), "seq").coalesce(1).write.parquet(str(folder / f"part{n}"))

    def run(name):
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(folder))
        paper_states.run_states(stream, str(tmp_path / name / "out"), str(tmp_path / name / "cp")).awaitTermination()

    for n in range(3):  # a wave, and the stream is started anew for the next one
        put(n, events[40 * n : 40 * n + 40])
        run("stopped")
    run("unbroken")
    state, changes = plain_states(events)
    key = lambda rows: sorted(rows, key=str)
    last = max(at for _, _, at, _ in events)
    want = {}
    for k, (status, attempts, since) in state.items():
        stale = status == "in-progress" and since + paper_states.STALE_MS < last
        want[k] = ("pending", attempts - 1) if stale else (status, attempts)
    for name in ("stopped", "unbroken"):
        made = spark.read.schema(paper_states.CHANGES).parquet(str(tmp_path / name / "out" / "*"))
        got = [tuple(r) for r in made.collect()]
        assert key(r for r in got if r[1] is not None) == key(r for r in changes if r[1] is not None), name
        assert {r for r in changes if r[1] is None} <= set(got)  # timers may give up papers that no later change names
        assert {r.key: (r.status, r.attempts) for r in paper_states.last_states(made, F.lit(last)).collect()} == want, name
    assert any(r[-1] == "stale" for r in changes) and any(r[-1] == "no third attempt" for r in changes)


def test_a_papers_changes_come_and_go_as_rows_with_one_call_for_its_state():
    from pyspark.sql import Row

    class State:
        held, calls = None, 0

        def get(self):
            self.calls += 1
            return self.held

        def exists(self):
            self.calls += 1
            return self.held is not None

        def update(self, value):
            self.held = value

    class Handle:
        def __init__(self):
            self.state, self.timers = State(), set()

        def getValueState(self, *_):  # noqa: N802
            return self.state

        def registerTimer(self, at):  # noqa: N802
            self.timers.add(at)

        def deleteTimer(self, at):  # noqa: N802
            self.timers.remove(at)

    handle, papers = Handle(), paper_states.PaperStates()
    papers.init(handle)
    events = [("a", "failed", 9 * HOUR, 4), ("a", "in-progress", HOUR, 1), ("a", "failed", 9 * HOUR, 3), ("a", "in-progress", 90 * HOUR, 5), ("a", None, 2 * HOUR, 2)]
    rows = [Row(key=k, status=s, at_ms=at, seq=q) for k, s, at, q in events]
    got = [tuple(r) for r in papers.handleInputRows(("a",), iter(rows), None)]
    state, want = plain_states(events)
    assert got == want and handle.state.held == state["a"] and handle.state.calls == 1 and handle.timers == {114 * HOUR}
    later = [Row(key="a", status="ok", at_ms=91 * HOUR, seq=None), Row(key="a", status="failed", at_ms=91 * HOUR, seq=6)]
    got = [(r.seq, r.accepted) for r in papers.handleInputRows(("a",), iter(later), None)]
    assert got == [(6, True), (None, False)] and handle.state.calls == 2 and not handle.timers


def test_seen_sources_over_batches_and_reruns(spark, tmp_path):
    table = seen.seen_table(spark, str(tmp_path / "seen"), 4)
    batch = lambda *rows: spark.createDataFrame(list(rows), "path string, content string")
    names = lambda df: sorted(r.path for r in df.collect())
    one = batch(("a", "x"), ("b", "x"), ("c", "y"), ("d", None))
    assert names(seen.absorb(table, one, 0)) == ["a", "c"]
    versions = table.versions()
    assert names(seen.absorb(table, one, 0)) == ["a", "c"] and table.versions() == versions  # a batch run twice
    assert names(seen.absorb(table, batch(("e", "x"), ("f", "z"), ("g", "y")), 1)) == ["f"]
    assert names(seen.absorb(seen.seen_table(spark, str(tmp_path / "seen")), batch(("h", "z"), ("i", "w")), 2)) == ["i"]
    assert names(seen.absorb(table, batch(), 3)) == [] and table.read().count() == 4


def test_a_watched_folder_knows_contents_of_earlier_runs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    table, got = seen.seen_table(spark, str(tmp_path / "seen"), 2), []
    take = lambda new, n: got.extend(r.path.rsplit("/", 1)[1] for r in new.orderBy("path").collect())
    run = lambda: seen.watch_new_sources(spark, str(tmp_path / "in"), table, take, str(tmp_path / "cp")).awaitTermination()
    (tmp_path / "in" / "a.txt").write_text("one")
    (tmp_path / "in" / "b.txt").write_text("two")
    run()
    (tmp_path / "in" / "c.txt").write_text("one")
    (tmp_path / "in" / "d.txt").write_text("three")
    run()
    assert got == ["a.txt", "b.txt", "d.txt"]


# Merges by field ---------------------------------------------------------------------

PAGE = "slug string, name string, year int, tags array<string>"


def merged(spark, base, stored_rows, incoming):
    make = lambda rows: spark.createDataFrame(rows, PAGE)
    rows, conflicts = upserts.three_way(make(base), make(stored_rows), make(incoming), "slug", ["name", "year", "tags"], unions=("tags",))
    return {r.slug: (r.name, r.year, r.tags, r.origin) for r in rows.collect()}, rows_of(conflicts)


def test_a_corrected_field_stays_and_others_follow(spark):
    base = [("a", "A", 2000, ["x"]), ("b", "B", 2000, ["x", "y"]), ("c", "C", None, None), ("gone", "G", 1, [])]
    own = [("a", "A, corrected", 2000, ["x", "mine"]), ("b", "B mine", 2000, ["x"]), ("c", "C", None, None), ("only", "O", 1, None)]
    new = [("a", "A", 2001, ["x", "their"]), ("b", "B theirs", 2000, ["x", "y", "z"]), ("c", None, 1999, ["t"]), ("gone", "G", 1, []), ("fresh", "F", 3, ["n"])]
    rows, conflicts = merged(spark, base, own, new)
    assert rows == {
        "a": ("A, corrected", 2001, ["x", "mine", "their"], "merged"),
        "b": ("B mine", 2000, ["x", "z"], "merged"),
        "c": (None, 1999, ["t"], "merged"),
        "only": ("O", 1, None, "kept"),
        "fresh": ("F", 3, ["n"], "new"),
    }
    assert conflicts == [("b", "name", "B", "B mine", "B theirs")]


def test_merges_of_empty_tables(spark):
    assert merged(spark, [], [], []) == ({}, [])
    rows, conflicts = merged(spark, [], [("a", "A", 1, ["x"])], [("a", "B", 1, ["x"])])
    assert rows == {"a": ("A", 1, ["x"], "merged")} and conflicts == [("a", "name", None, "A", "B")]


def test_venue_pages_keep_what_a_user_corrected(spark, monkeypatch):
    monkeypatch.setattr(upserts, "STRETCH", 2)
    pages = spark.createDataFrame([("ieee-trans-x", "IEEE Trans. on X (ours)", "conference", "2020-01-01", "2020-02-02"), ("quiet", "Quiet", "journal", "2019-01-01", "2019-01-01")], "slug string, name string, venue_type string, created string, updated string")
    members = spark.createDataFrame([("ieee-trans-x", "p9", 1), ("ieee-trans-x", "p1", 2)], "slug string, paper_id string, place long")
    tags = spark.createDataFrame([("ieee-trans-x", "field/a", 1)], "slug string, tag string, place long")
    papers = [(f"p{i}", i, "IEEE Trans X 2021" if i % 2 else "IEEE Trans X 2022", ["field/b", "method/m", "field/a"]) for i in range(8)] + [("q", 50, "New Workshop (3rd)", None), ("r", 51, "  ", ["field/z"]), ("s", 52, None, None), ("t", 53, "2022", None)]
    after, listed, tagged = upserts.upsert_venues(pages, members, tags, spark.createDataFrame(papers, "paper_id string, seq long, venue string, tags array<string>"), F.lit("2026-01-01"))
    assert rows_of(after) == [("ieee-trans-x", "IEEE Trans. on X (ours)", "conference", "2020-01-01", "2026-01-01"), ("new-workshop", "New Workshop", "workshop", "2026-01-01", "2026-01-01"), ("quiet", "Quiet", "journal", "2019-01-01", "2019-01-01")]
    order = [r.paper_id for r in listed.where("slug = 'ieee-trans-x'").orderBy("place").collect()]
    assert order == ["p9", "p1", "p0", "p2", "p3", "p4", "p5", "p6", "p7"]
    assert sorted(r.place for r in listed.where("slug = 'ieee-trans-x'").collect()) == list(range(1, 10))
    assert [r.tag for r in tagged.where("slug = 'ieee-trans-x'").orderBy("place").collect()] == ["field/a", "field/b"]
