"""Streams of changes: versions once each, edits and deletions of files, and bursts that become one change."""

import os
import time

import pytest

from quillon.sources import sinks
from quillon.streaming import watch


def put(root, name, text):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    # Times of files may be coarse; an edit in a test must show.
    stamp = time.time_ns() + put.count * 10_000_000
    put.count += 1
    os.utime(path, ns=(stamp, stamp))


put.count = 0


def changes(spark, log, number):
    path = f"{log}/changes/tick={number}"
    return {(r.path, r.change) for r in spark.read.schema(watch.CHANGE).parquet(path).collect()} if os.path.exists(path) else set()


def test_ticks_find_edits_and_deletions(spark, tmp_path):
    root, log = tmp_path / "store", str(tmp_path / "log")
    put(root, "a.md", "one")
    put(root, "sub dir/b.md", "two")
    put(root, "c.txt", "no")
    watch.ticked(spark, str(root), log, 0)
    assert changes(spark, log, 0) == {("a.md", "added"), ("sub%20dir/b.md", "added")} or changes(spark, log, 0) == {("a.md", "added"), ("sub dir/b.md", "added")}
    watch.ticked(spark, str(root), log, 1)
    assert changes(spark, log, 1) == set()
    put(root, "a.md", "six")
    put(root, "d.md", "four")
    (root / "sub dir/b.md").unlink()
    watch.ticked(spark, str(root), log, 2)
    assert {c for _, c in changes(spark, log, 2)} == {"modified", "added", "deleted"} and len(changes(spark, log, 2)) == 3
    # The same tick again, as after a failure behind its work: nothing is written twice, and later edits wait.
    put(root, "a.md", "seven")
    before = sorted(os.listdir(f"{log}/changes/tick=2"))
    watch.ticked(spark, str(root), log, 2)
    assert sorted(os.listdir(f"{log}/changes/tick=2")) == before
    watch.ticked(spark, str(root), log, 5)
    assert changes(spark, log, 5) == {("a.md", "modified")}
    watch.ticked(spark, str(root), log, 6)
    assert len(os.listdir(f"{log}/listings")) == 2


def test_net_changes():
    story = lambda *x: __import__("functools").reduce(watch.net, x, None)
    assert story("added", "modified", "modified") == "added" and story("added", "deleted") is None and story("deleted", "added") == "modified"
    assert story("modified", "deleted") == "deleted" and story("modified", "deleted", "added", "modified") == "modified"
    assert story("added", "deleted", "added") == "added"


def items(spark, rows):
    return spark.createDataFrame(rows, "path string, body string")


def test_versions_come_once(spark, tmp_path):
    """Published while the stream is stopped or fails: each version once, in order, with its difference."""
    root, state, seen = str(tmp_path / "p"), str(tmp_path / "s"), []

    def keep(df, number):
        seen.append((number, sorted((r.path, r.change) for r in df.collect())))

    def run(f=keep, **options):
        watch.following(spark, root, f, state, ["body"], once=True, **options).awaitTermination()

    sinks.publish(items(spark, [("a", "1"), ("b", "2")]), root)
    run()
    sinks.publish(items(spark, [("a", "1"), ("b", "3"), ("c", None)]), root)
    sinks.publish(items(spark, [("c", None)]), root)
    failures = []

    def fails(df, number):
        failures.append(number)
        raise RuntimeError("no")

    with pytest.raises(Exception, match="no"):
        run(fails, attempts=2, wait=0.01)
    assert failures == [2, 2]

    def at_first(df, number):
        if number == 3 and len(failures) < 3:
            failures.append(number)
            raise RuntimeError("once")
        keep(df, number)

    run(at_first, wait=0.01)
    run()
    assert seen == [(1, [("a", "added"), ("b", "added")]), (2, [("b", "modified"), ("c", "added")]), (3, [("a", "deleted"), ("b", "deleted")])]


def test_bursts_become_one_change(spark, tmp_path):
    """The whole way: files are watched, edited in bursts and deleted; each burst gives a path's change once, also over a restart."""
    root, log, seen = tmp_path / "store", str(tmp_path / "log"), []
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    put(root, "a.md", "one")
    put(root, "b.md", "two")

    def keep(df, _):
        seen.extend((r.path, r.change) for r in df.collect())

    def start():
        ticks = watch.watching(spark, str(root), log, every="300 milliseconds")
        quiet = watch.debounced(watch.logged(spark, log), quiet=1500)
        return ticks, quiet.writeStream.foreachBatch(keep).option("checkpointLocation", f"{log}/quiet").outputMode("append").trigger(processingTime="300 milliseconds").start()

    def until(n, seconds=90):
        end = time.time() + seconds
        while len(seen) < n and time.time() < end:
            time.sleep(0.2)
        assert all(q.isActive for q in running), [q.exception() for q in running]

    running = start()
    try:
        until(2)
        assert sorted(seen) == [("a.md", "added"), ("b.md", "added")]
        for k in range(4):
            put(root, "a.md", f"again {k}")
            time.sleep(0.4)
        put(root, "gone.md", "x")
        (root / "gone.md").unlink()
        until(3)
        assert seen[2:] == [("a.md", "modified")]
        for q in running:
            q.stop()
        (root / "b.md").unlink()
        running = start()
        until(4)
        assert seen[3:] == [("b.md", "deleted")]
    finally:
        for q in running:
            q.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
