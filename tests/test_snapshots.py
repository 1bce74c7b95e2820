import pytest
from pyspark.sql import functions as F

from qcloom.operators import state as ST
from qcloom.sources import readers, sinks, snapshots, state_log
from qcloom.streaming import streams

KV = "k string, v int"


def frame(spark, pairs):
    return spark.createDataFrame(list(pairs), KV)


def pairs(df):
    return sorted((r.k, r.v) for r in df.collect())


def test_upsert_writes_only_touched_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    old = [(f"k{i}", i) for i in range(300)]
    assert pairs(snapshots.replace(frame(spark, old), path, ["k"], 16)) == sorted(old)
    before = snapshots.head(spark, path)["folders"]
    out = snapshots.upsert(frame(spark, [("k7", -7), ("new", 1)]), path, ["k"])
    assert pairs(out) == sorted([p for p in old if p[0] != "k7"] + [("k7", -7), ("new", 1)])
    after = snapshots.head(spark, path)["folders"]
    changed = [b for b in after if after[b] != before.get(b)]
    assert 1 <= len(changed) <= 2 and len(before) == 16
    new = {after[b] for b in changed}
    assert len(new) == 1 and len(snapshots.names(spark, f"{path}/data/{new.pop()}")) == len(changed) + 1  # and _SUCCESS
    assert pairs(snapshots.read(spark, path, 1)) == sorted(old)
    for v in range(3):
        out = snapshots.upsert(frame(spark, [("k7", v)]), path, ["k"])
    assert snapshots.vacuum(spark, path, 1) > 0 and pairs(snapshots.read(spark, path)) == pairs(out) and snapshots.versions(spark, path) == [5]
    assert pairs(snapshots.upsert(frame(spark, []), path, ["k"])) == pairs(out)


def test_upsert_begins_a_table_and_merges(spark, tmp_path):
    path = str(tmp_path / "t")
    add = lambda old, new: old.unionByName(new).groupBy("k").agg(F.sum("v").cast("int").alias("v"))
    snapshots.upsert(frame(spark, [("a", 1), ("b", 2)]), path, ["k"], add)
    assert pairs(snapshots.upsert(frame(spark, [("b", 5), ("c", 3)]), path, ["k"], add)) == [("a", 1), ("b", 7), ("c", 3)]
    gone = lambda old, new: old.limit(0)
    assert pairs(snapshots.upsert(frame(spark, [("b", 0)]), path, ["k"], gone).where("k = 'b'")) == []
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, str(tmp_path / "none"))


def test_a_writer_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    snapshots.replace(frame(spark, [("a", 1)]), path, ["k"])
    whole = snapshots.commit

    def broken(*a):
        raise KeyboardInterrupt

    monkeypatch.setattr(snapshots, "commit", broken)
    with pytest.raises(KeyboardInterrupt):
        snapshots.upsert(frame(spark, [("a", 2)]), path, ["k"])
    assert pairs(snapshots.read(spark, path)) == [("a", 1)]
    monkeypatch.setattr(snapshots, "commit", whole)
    assert pairs(snapshots.upsert(frame(spark, [("a", 3)]), path, ["k"])) == [("a", 3)]


def test_of_two_writers_none_is_lost(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    snapshots.replace(frame(spark, [("a", 1)]), path, ["k"], 1)
    whole, calls = snapshots.commit, []

    def second_first(*a):
        calls.append(1)
        if len(calls) == 1:  # another writer commits between this one's reading and its commit
            snapshots.upsert(frame(spark, [("b", 2)]), path, ["k"])
        whole(*a)

    monkeypatch.setattr(snapshots, "commit", second_first)
    assert pairs(snapshots.upsert(frame(spark, [("c", 3)]), path, ["k"])) == [("a", 1), ("b", 2), ("c", 3)]
    with pytest.raises(snapshots.Taken):
        whole(spark, path, snapshots.head(spark, path))


@pytest.mark.parametrize("breaks_at,left", [(1, "old"), (2, "new")])
def test_files_survive_a_break_between_renames(spark, tmp_path, monkeypatch, breaks_at, left):
    path = str(tmp_path / "out")
    write = lambda v: sinks._swap(frame(spark, [("a", v)]), path, sinks._csv)
    write(1)
    whole, calls = sinks._rename, []

    def broken(*a):
        calls.append(1)
        if len(calls) == breaks_at:
            raise KeyboardInterrupt
        whole(*a)

    monkeypatch.setattr(sinks, "_rename", broken)
    with pytest.raises(KeyboardInterrupt):
        write(2)
    assert [r.v for r in readers.read_csv(spark, path).collect()] == [{"old": "1", "new": "2"}[left]]
    monkeypatch.setattr(sinks, "_rename", whole)
    write(3)
    assert [r.v for r in readers.read_csv(spark, path).collect()] == ["3"] and not list(tmp_path.glob("*.old"))


def test_manifest_can_be_read(spark, tmp_path):
    row = lambda run, at, items: (run, "f", 2, "p", at, at, items)
    path = str(tmp_path / "m")
    sinks.write_manifest(spark.createDataFrame([row("r1", 1.0, [("x", "video")]), row("r2", 1.0, None)], ST.MANIFEST), path)
    out = sinks.write_manifest(spark.createDataFrame([row("r1", 5.0, None), row("r3", 5.0, None)], ST.MANIFEST), path)
    got = {r.run_id: (r.created_at, r.updated_at, len(r["items"] or [])) for r in out.collect()}
    assert got == {"r1": (1.0, 5.0, 1), "r2": (1.0, 1.0, 0), "r3": (5.0, 5.0, 0)}


def rows(spark, run, stage, seq, ids, error=None):
    return spark.createDataFrame([(run, i, stage, 1.0, seq, error) for i in ids], ST.STATE)


def test_state_log(spark, tmp_path):
    root = str(tmp_path)
    for run in ("r 1", "other=2"):
        state_log.append(rows(spark, run, "EXTRACTED", 1, "abcd"), root)
    state_log.append(rows(spark, "r 1", "SUNK", 2, "ab"), root)
    last = lambda d: {r.item_id: r.stage for r in ST.latest_stage(d).collect()}
    want = {"a": "SUNK", "b": "SUNK", "c": "EXTRACTED", "d": "EXTRACTED"}
    assert last(state_log.current(spark, root, "r 1")) == want
    plan = readers.read_state_log(spark, f"{root}/state").where("run_id = 'other=2'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan
    assert last(state_log.fold(spark, root, "r 1")) == want
    folder, files = state_log._run(spark, root, "r 1")[0], lambda: state_log._files(spark, state_log._run(spark, root, "r 1")[0])
    once = files()
    state_log.append(rows(spark, "r 1", "SUNK", 3, "c", "broken"), root)
    (tmp_path / folder[len(root) + 1 :] / "torn.json").write_text('{"item_id": "d", "sta')
    want["c"] = "SUNK"
    assert last(state_log.current(spark, root, "r 1")) == want and state_log.current(spark, root, "r 1").count() == 5
    state_log.fold(spark, root, "r 1")
    assert not set(once) & set(files())  # what the snapshot before had folded is gone
    assert last(state_log.current(spark, root, "r 1")) == want and state_log.current(spark, root, "r 1").count() == 4
    left = lambda again: {r.id for r in ST.pending_items(spark.createDataFrame([(x,) for x in "abcd"], "id string"), state_log.current(spark, root, "r 1"), retry_errors=again).collect()}
    assert left(False) == {"d"} and left(True) == {"c", "d"}
    assert {(r.run_id, r.done) for r in ST.done_count(state_log.states(spark, root), "run_id").collect()} == {("r 1", 3), ("other=2", 0)}
    assert state_log.current(spark, root, "none").count() == 0 and state_log.states(spark, root, []).count() == 0


def test_upsert_stream(spark, tmp_path):
    src, table, ck = (str(tmp_path / x) for x in ("in", "t", "ck"))
    go = lambda check: streams.upsert_stream(streams.read_landing(spark, src, "k string, v int"), lambda b: b, table, "k", check, "v").awaitTermination()
    frame(spark, [("a", 5), ("b", 1), ("a", 9)]).coalesce(1).write.parquet(src)
    go(ck)
    frame(spark, [("b", 4), ("a", 2), ("c", 0)]).coalesce(1).write.mode("append").parquet(src)
    for _ in range(2):
        go(ck)
    assert pairs(snapshots.read(spark, table)) == [("a", 9), ("b", 4), ("c", 0)] and len(snapshots.versions(spark, table)) == 2


def test_lookup_reads_and_shuffles_what_is_asked_for(spark, tmp_path):
    path = str(tmp_path / "t")
    snapshots.replace(frame(spark, [(f"k{i}", i) for i in range(400)]), path, ["k"], 16)
    asked = spark.createDataFrame([("k3", 1), ("k77", 2), ("none", 3), (None, 4), ("k3", 5)], "k string, n int")
    got = snapshots.lookup(asked, path)
    assert pairs(got) == [("k3", 3), ("k77", 77)]
    assert len({f.split("bucket=")[1].split("/")[0] for f in got.inputFiles()}) <= 3  # of 16 buckets
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan
    side = plan[plan.index("LeftSemi") :].split("BroadcastExchange")[0]
    assert "Exchange hashpartitioning" not in side  # the table's side isn't shuffled before it is filtered
    assert pairs(snapshots.lookup(asked, path, 0)) == [("k3", 3), ("k77", 77)]
    assert snapshots.lookup(asked.limit(0), path).count() == 0
