"""Live watching: state on success, quiet times, timers. Events come from files, a micro-batch for each."""

import os
import time

import pytest
from pyspark.sql import functions as F

from darkroom.sources import listing
from darkroom.streaming import state, timers, watch

T0 = 1_700_000_000


def add(spark, folder, rows, n):
    """A file with (path, seconds) events."""
    frame = spark.createDataFrame(rows, "path string, t double").select("path", F.timestamp_micros((F.col("t") * 1_000_000).cast("long") + T0 * 1_000_000).alias("mtime"))
    frame.coalesce(1).write.parquet(f"{folder}/{n}")


def stream(spark, folder):
    os.makedirs(folder, exist_ok=True)
    return spark.readStream.schema("path string, mtime timestamp").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(folder)


def results(batch, fails, in_place=True):
    out = F.col("path") if in_place else F.concat("path", F.lit(".webp"))
    return batch.select("path", "mtime", out.alias("output"), (F.col("mtime") + F.expr("INTERVAL 10 SECONDS")).alias("output_mtime"), F.when(F.col("path").isin(fails), "broken").alias("error"))


def test_only_what_failed_comes_again(spark, tmp_path):
    folder, seen = str(tmp_path / "in"), []

    def handle(batch, number):
        seen.append(sorted(r["path"] for r in batch.collect()))
        return results(batch, ["/v/b.png"] if number < 2 else [])

    query = state.start(stream(spark, folder), lambda e: watch.routed(e, [("/v", "image", "optimise")]), handle, str(tmp_path / "state"), str(tmp_path / "cp"))
    three = [("/v/a.png", 1.0), ("/v/b.png", 1.0), ("/v/c.png", 1.0), ("/w/no.png", 1.0), ("/v/.c.png", 1.0)]
    steps = [three, three, three, [("/v/a.png", 11.0), ("/v/c.png", 12.0), ("/v/c.png", 11.5)], three]  # in place: written ten seconds later
    for i, rows in enumerate(steps):
        add(spark, folder, rows, i)
        query.processAllAvailable()
    query.stop()
    assert seen == [["/v/a.png", "/v/b.png", "/v/c.png"], ["/v/b.png"], ["/v/b.png"], ["/v/c.png"], []]
    known = {r["path"]: r["s"] - T0 for r in state.DoneFiles(spark, str(tmp_path / "state")).known().select("path", F.unix_seconds("mtime").alias("s")).collect()}
    assert known == {"/v/a.png": 11, "/v/b.png": 11, "/v/c.png": 22}


@pytest.mark.parametrize("written", [False, True])
def test_a_crash_repeats_a_batch_safely(spark, tmp_path, monkeypatch, written):
    """Once before the results are written, once after that and before the stream's own commit."""
    folder, seen, crash = str(tmp_path / "in"), [], [True]

    def handle(batch, number):
        seen.append((number, sorted(r["path"] for r in batch.collect())))
        return results(batch, ["/v/b.png"])

    own = state.DoneFiles.add

    def broken(self, rows, number):
        if crash and not written:
            crash.clear()
            raise RuntimeError("crash")
        own(self, rows, number)
        if crash:
            crash.clear()
            raise RuntimeError("crash")

    monkeypatch.setattr(state.DoneFiles, "add", broken)
    add(spark, folder, [("/v/a.png", 1.0), ("/v/b.png", 1.0)], 0)
    for _ in range(2):
        query = state.start(stream(spark, folder), lambda e: e, handle, str(tmp_path / "state"), str(tmp_path / "cp"))
        try:
            query.processAllAvailable()
        except Exception as e:
            assert "crash" in str(e)
        query.stop()
    assert seen == [(0, ["/v/a.png", "/v/b.png"]), (0, ["/v/b.png"] if written else ["/v/a.png", "/v/b.png"])]
    done = state.DoneFiles(spark, str(tmp_path / "state"))
    assert [r["path"] for r in done.known().collect()] == ["/v/a.png"]
    assert done.results().where("error IS NULL").count() == 1


def test_results_are_merged_and_broken_folders_dont_count(spark, tmp_path):
    done = state.DoneFiles(spark, str(tmp_path / "s"), merge_after=2)
    for batch in range(9):
        rows = spark.createDataFrame([("/v/all.png", batch), (f"/v/{batch}.png", batch)], "path string, t int").select("path", F.timestamp_seconds(F.col("t") + T0).alias("mtime"))
        assert done.due(rows).count() == 2
        done.add(results(rows, ["/v/4.png"], in_place=False), batch)
        if batch == 5:
            done.add(results(rows.limit(0), []), batch)  # comes again, with nothing left to do
            late = spark.createDataFrame([("/v/late.png", 5)], "path string, t int").select("path", F.timestamp_seconds(F.col("t") + T0).alias("mtime"))
            done.add(results(late, [], in_place=False), batch)  # and once more, with a file that had failed
        os.makedirs(tmp_path / "s" / f"done-{batch:012d}-0009")  # broken off
    known = {r["path"]: r["s"] - T0 for r in done.known().select("path", F.unix_seconds("mtime").alias("s")).collect()}
    assert known == {f"/v/{b}.png": b for b in range(9) if b != 4} | {"/v/all.png": 8, "/v/late.png": 5}
    kinds = [k for k, *_ in done.folders.all()]
    assert 1 <= kinds.count("known") <= 2 and kinds.count("done") < 9


def test_quiet_batches_equal_those_of_the_whole_table(spark, tmp_path):
    t = [i * 0.3 for i in range(40)] + [30, 30.2, 30.6, 31.3, 50, 50.49, 50.99, 70, 90.1, 90.2]
    rows = [(f"/v/{i % 5}.png", float(x)) for i, x in enumerate(t)] + [(None, 30.1)]
    events = spark.createDataFrame(rows, "path string, t double").withColumn("event_time", F.timestamp_micros((F.col("t") * 1_000_000).cast("long") + T0 * 1_000_000))
    whole = sorted((r["start"], r["end"], r["path"] or "", r["n_events"]) for r in watch.debounced(events).collect())
    quiet, got = state.QuietBatches(spark, str(tmp_path / "q")), []
    cuts = [0, 5, 9, 30.3, 30.5, 31.35, 60, 90.15, 95]
    for n, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        part = events.where(f"t >= {lo} AND t < {hi}").select("path", "event_time")
        first = sorted(map(tuple, quiet.step(part, n).collect()), key=str)
        again = sorted(map(tuple, quiet.step(part, n).collect()), key=str)  # as after a crash
        assert first == again
        got += first
    last = quiet.step(events.limit(0).select("path", "event_time"), 99, F.timestamp_seconds(F.lit(T0 + 1000)))
    got += list(map(tuple, last.collect()))
    assert sorted((s, e, p or "", n) for s, e, p, n in got) == whole


def test_quiet_stream_ends_by_the_clock(spark, tmp_path):
    folder, got = str(tmp_path / "in"), []
    events = stream(spark, folder).withColumnRenamed("mtime", "event_time")
    query = state.start_quiet(events, lambda b, n: got.extend((r["path"], r["n_events"]) for r in b.collect()), str(tmp_path / "q"), str(tmp_path / "cp"), beat="500 milliseconds")
    add(spark, folder, [("/v/a.png", 0.0), ("/v/b.png", 0.2), ("/v/a.png", 0.4), ("/v/c.png", 9.0)], 0)
    until = time.time() + 60
    while len(got) < 3 and time.time() < until:
        time.sleep(0.2)
    query.stop()
    assert sorted(got) == [("/v/a.png", 2), ("/v/b.png", 1), ("/v/c.png", 1)]  # no later event was needed


@pytest.fixture()
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, timers.STORE)
    yield
    spark.conf.set(name, old)


def test_files_settle_by_timers(spark, tmp_path, rocks):
    folder = str(tmp_path / "in")
    events = stream(spark, folder).withColumnRenamed("mtime", "event_time").withWatermark("event_time", "0 seconds")
    query = timers.settled(events, 500, by_event_time=True, buckets=3).writeStream.format("memory").queryName("settled").option("checkpointLocation", str(tmp_path / "cp")).start()
    for i, rows in enumerate([[("/v/a.png", 0.0), ("/v/b.png", 0.1), (None, 0.1)], [("/v/a.png", 0.4)], [("/v/z.png", 0.7)], [("/v/z.png", 5.0), ("/v/a.png", 5.0)]]):
        add(spark, folder, rows, i)
        query.processAllAvailable()
    query.stop()
    got = sorted((r["path"], round(r["last_time"].timestamp() - T0, 1), r["n_events"]) for r in spark.sql("SELECT * FROM settled").collect())
    assert got == [("/v/a.png", 0.4, 2), ("/v/b.png", 0.1, 1), ("/v/z.png", 0.7, 1)]


def test_adjacent_repeats_on_a_stream(spark, tmp_path, rocks):
    folder = str(tmp_path / "in")
    events = stream(spark, folder).select(F.col("mtime").alias("event_time"), F.substring("path", 1, 1).alias("board"), F.substring("path", 2, 9).alias("picture"))
    query = timers.changed_live(events, F.col("picture"), "board").writeStream.format("memory").queryName("pictures").option("checkpointLocation", str(tmp_path / "cp")).start()
    until = time.time() + 60
    for i, (rows, n) in enumerate([([("1x", 0.0), ("1x", 1.0), ("2x", 1.0)], 2), ([("1x", 2.0), ("1y", 3.0)], 3), ([("1x", 4.0), ("2x", 4.0)], 4)]):
        add(spark, folder, rows, i)
        while spark.table("pictures").count() < n and time.time() < until:  # such a stream never says that all is done
            time.sleep(0.2)
    query.stop()
    got = sorted((r["board"], r["picture"], int(r["event_time"].timestamp()) - T0) for r in spark.sql("SELECT * FROM pictures").collect())
    assert got == [("1", "x", 0), ("1", "x", 4), ("1", "y", 3), ("2", "x", 1)]


def test_listing_finds_old_times_and_changes(spark, tmp_path):
    root, roots = tmp_path / "in", spark.createDataFrame([(str(tmp_path / "in") + "/",), (str(tmp_path / "in" / "sub"),), (str(tmp_path / "gone"),)], "path string")
    (root / "sub" / "deep" / "er").mkdir(parents=True)
    for name in ("a.png", ".a.png.orig", "sub/b.png", "sub/deep/er/c.png"):
        (root / name).write_bytes(b"x" * 9)
    os.symlink(root, root / "sub" / "loop")
    names = lambda rows: sorted((os.path.relpath(r["path"], root), r["event"]) for r in rows.collect())
    snapshots = listing.Snapshots(spark, str(tmp_path / "s"))
    first = [(n, "create") for n in (".a.png.orig", "a.png", "sub/b.png", "sub/deep/er/c.png")]
    assert names(snapshots.step(roots, 0)) == first and names(snapshots.step(roots, 0)) == first  # the second as after a crash
    assert names(snapshots.step(roots, 1)) == []
    (root / "old.png").write_bytes(b"y")
    os.utime(root / "old.png", (1000, 1000))
    (root / "a.png").write_bytes(b"longer than before")
    os.rename(root / "sub" / "b.png", root / "sub" / "deep" / "b.png")
    second = [("a.png", "modify"), ("old.png", "create"), ("sub/deep/b.png", "create")]
    assert names(snapshots.step(roots, 2)) == second and names(snapshots.step(roots, 2)) == second
    assert names(snapshots.step(roots, 5)) == []
    flat = listing.tree(roots.limit(1), recursive=False)
    assert sorted(os.path.basename(r["path"]) for r in flat.collect()) == [".a.png.orig", "a.png", "old.png"]
    assert sorted(os.path.basename(r["path"]) for r in listing.removed(flat.limit(0), flat).collect()) == [".a.png.orig", "a.png", "old.png"]
    assert listing.tree(roots.limit(0)).count() == 0
    (row,) = listing.tree(roots.limit(1)).where("path LIKE '%old.png'").select("length", F.unix_seconds("mtime")).collect()
    assert tuple(row) == (1, 1000)


def test_a_large_folder_is_looked_at_by_many_tasks(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"{i}.png").write_bytes(b"x")
    files = listing.tree(spark.createDataFrame([(str(tmp_path),)], "path string"), parts=6)
    parts = files.select(F.spark_partition_id().alias("part")).groupBy("part").count().collect()
    assert len(parts) == 6 and sum(r["count"] for r in parts) == 300 and max(r["count"] for r in parts) < 100


def test_live_watch_of_a_folder(spark, tmp_path):
    root, seen = tmp_path / "in", []
    root.mkdir()
    (root / "a.png").write_bytes(b"1")
    (root / "b.txt").write_bytes(b"1")

    def handle(batch, number):
        seen.extend((os.path.basename(p), pipeline) for p, pipeline in batch.select("path", "pipeline").collect())
        return results(batch, [], in_place=False)

    query = listing.watch(spark, [str(root)], lambda e: watch.routed(e, [(str(root), "image", "optimise")]), handle, str(tmp_path / "state"), str(tmp_path / "cp"), every="200 milliseconds")

    def wait(n):
        until = time.time() + 60
        while len(seen) < n and time.time() < until and query.isActive:
            time.sleep(0.2)

    wait(1)
    (root / "c.png").write_bytes(b"2")
    os.utime(root / "c.png", (1000, 1000))  # moved in with an old time
    wait(2)
    (root / "a.png").write_bytes(b"22")
    wait(3)
    query.stop()
    assert seen == [("a.png", "optimise"), ("c.png", "optimise"), ("a.png", "optimise")]
