import datetime as dt

import pytest

from stratalode.core.manifest import Conflict, ManifestStore, pending

T = dt.datetime


def frames(spark, files, meta, runs):
    f = spark.createDataFrame(files, "path string, sha256 string, updated_at timestamp_ntz, key string, version int")
    m = spark.createDataFrame(meta, "path string, sha256 string, indexed_at timestamp_ntz, run_id bigint, status string")
    r = spark.createDataFrame(runs, "run_id bigint, status string, path string")
    return f, m, r


def states(spark, files, meta, runs):
    return {r["path"]: r["state"] for r in pending(*frames(spark, files, meta, runs)).collect()}


def test_new_changed_unchanged_with_dirt(spark):
    a, b, c = T(2024, 1, 1), T(2024, 1, 2), T(2024, 1, 3)
    files = [("x", "1", a, "k", 1), ("x", "2", b, "k", 2), ("x", "2", b, "k", 2), ("y", "1", a, "k", 1), ("z", None, a, "k", 1), ("w", "1", None, "k", 1),
             (None, "1", a, "k", 1), ("v", "9", a, "k", 1), ("u", None, a, None, None)]
    meta = [("x", "2", a, 1, "s"), ("y", "1", a, 1, "s"), ("y", "0", c, 2, "s"), ("y", None, b, None, "s"), ("z", "1", a, 1, "s"), ("w", "1", None, 1, "s"),
            ("v", "9", a, 9, "s"), ("u", None, a, 1, None), ("gone", "1", a, 1, "s")]
    runs = [(1, "succeeded", "p"), (2, "failed", "p"), (None, "succeeded", "p")]
    # extra columns of clashing names (status, path, key, version) are neither read nor carried
    assert states(spark, files, meta, runs) == {"z": "changed", "v": "new"}


def test_latest_entry_and_ties(spark):
    a, b = T(2024, 1, 1), T(2024, 1, 2)
    files = [("x", "1", a, "k", 1)]
    assert states(spark, files, [("x", "1", a, 1, "s"), ("x", "2", b, 1, "s")], [(1, "succeeded", "p")]) == {"x": "changed"}
    # equal times: the greatest run counts
    assert states(spark, files, [("x", "2", a, 1, "s"), ("x", "1", a, 2, "s")], [(1, "succeeded", "p"), (2, "succeeded", "p")]) == {}


def test_empty_tables(spark):
    assert states(spark, [], [], []) == {}
    assert states(spark, [("x", "1", T(2024, 1, 1), "k", 1)], [], []) == {"x": "new"}


def listing(spark, rows):
    return spark.createDataFrame(rows, "path string, bytes bigint, checksum string")


def test_store_processes_each_state_once(spark, tmp_path):
    s = ManifestStore(spark, f"file://{tmp_path}/store")
    one = listing(spark, [("a", 1, "x"), ("b", 2, "y"), (None, 3, "z")])
    assert s.run(one, lambda d: d) is not None
    assert s.run(one, lambda d: d) is None
    two = listing(spark, [("a", 1, "x"), ("b", 2, "changed"), ("c", 3, "z")])
    assert {r["path"] for r in s.plan(two).collect()} == {"b", "c"}
    s.run(two, lambda d: d)
    assert {r["path"]: r["checksum"] for r in s.manifest().collect()} == {"a": "x", "b": "changed", "c": "z"}
    assert s.plan(two).isEmpty()


def outputs(s):
    return sorted((r["path"], r["checksum"]) for r in s.output().collect())


def test_output_after_a_change_holds_each_path_once(spark, tmp_path):
    s = ManifestStore(spark, f"file://{tmp_path}/store")
    s.run(listing(spark, [("a", 1, "x"), ("b", 2, "y")]), lambda d: d)
    s.run(listing(spark, [("a", 1, "x"), ("b", 2, "y2")]), lambda d: d)
    assert outputs(s) == [("a", "x"), ("b", "y2")]
    s.run(listing(spark, [("a", 1, "x"), ("b", 2, "y")]), lambda d: d)  # back to an earlier state: a batch of its own
    assert outputs(s) == [("a", "x"), ("b", "y")]
    s.compact()
    assert outputs(s) == [("a", "x"), ("b", "y")] and s.version() == 4


def test_size_alone_is_a_change_and_unknown_sizes_are_not(spark, tmp_path):
    s = ManifestStore(spark, f"file://{tmp_path}/store")
    s.run(listing(spark, [("a", 1, "x"), ("b", None, "y")]), None)
    assert {r["path"] for r in s.plan(listing(spark, [("a", 2, "x"), ("b", 5, "y"), ("a", 1, "w")])).collect()} == {"a"}


def test_arrival_during_a_run_is_left_to_the_next(spark, tmp_path):
    s = ManifestStore(spark, f"file://{tmp_path}/store")
    source = f"{tmp_path}/listing"
    listing(spark, [("a", 1, "x")]).write.parquet(source)

    def process(d):
        listing(spark, [("late", 1, "z")]).write.mode("append").parquet(source)
        return d

    s.run(spark.read.parquet(source), process)
    assert outputs(s) == [("a", "x")]
    s.run(spark.read.parquet(source), lambda d: d)
    assert outputs(s) == [("a", "x"), ("late", "z")]


def test_of_two_writers_one_commits(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    one, two = ManifestStore(spark, root), ManifestStore(spark, root)
    rows = listing(spark, [("a", 1, "x"), ("b", 2, "y")])

    def while_the_other_runs(d):
        two.run(rows, lambda e: e)
        return d

    with pytest.raises(Conflict):
        one.run(rows, while_the_other_runs)
    assert outputs(one) == [("a", "x"), ("b", "y")] and one.version() == 1
    assert one.run(rows, lambda d: d) is None


@pytest.mark.parametrize("step", ["process", "rows", "claim"])
def test_failure_at_each_step_repeats_the_same_batch(spark, tmp_path, monkeypatch, step):
    s = ManifestStore(spark, f"file://{tmp_path}/store")
    rows = listing(spark, [("a", 1, "x"), ("b", 2, None)])
    want = s.batch_id(s.plan(rows))

    def lost(*a):
        raise RuntimeError("lost")

    if step == "process":
        with pytest.raises(RuntimeError):
            s.run(rows, lost)
    else:
        with monkeypatch.context() as m:
            m.setattr(s, "_claim", lost)
            with pytest.raises(RuntimeError):
                s.run(rows, lambda d: d)
        if step == "claim":  # its writer died between creating the file and writing it
            (tmp_path / "store/commits").mkdir()
            (tmp_path / "store/commits/000000000001.json").touch()
            with pytest.raises(Conflict):
                s.run(rows, lambda d: d)
            monkeypatch.setattr(ManifestStore, "LEASE", -1.0)
    assert s.plan(rows).count() == 2
    assert s.run(rows, lambda d: d) == want
    assert s.output().count() == 2 and s.plan(rows).isEmpty()


def test_snapshots(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ManifestStore, "COMPACT", 3)
    s = ManifestStore(spark, f"file://{tmp_path}/store")
    for i in range(4):
        s.run(listing(spark, [("a", i, str(i)), (f"p{i}", 1, "x")]), lambda d: d)
    assert len(s._log()[0]) == 2 and s.version() == 5
    assert outputs(s) == [("a", "3"), *((f"p{i}", "x") for i in range(4))]
