"""The two-phase sink with tasks that fail, progress while a run goes on, and headers of files."""

import os
import subprocess
import sys
import threading
import time

import pytest
from pyspark.sql import functions as F

from darkroom.functions.headers import picture_header
from darkroom.operators import images, report
from darkroom.sources import listing, sink

RETRY = """
import os, sys
from pyspark.sql import SparkSession, functions as F
from darkroom.sources.sink import FileSink
root, times = sys.argv[1], int(sys.argv[2])
spark = SparkSession.builder.master("local[2,2]").config("spark.ui.enabled", "false").getOrCreate()
spark.dataSource.register(FileSink)
@F.udf("binary")
def content(i):  # the task fails after it has written others, once or always
    seen = len(os.listdir(root + "/seen"))
    if i == 7 and seen < times:
        open(f"{root}/seen/{seen}", "w").close()
        raise RuntimeError("lost")
    return b"%d" % i
rows = spark.range(0, 10, 1, 2).select(F.lit("write").alias("action"), F.lit(None).cast("string").alias("source"), F.concat(F.lit(root + "/out/"), "id").alias("dest"), content("id").alias("content"))
try:
    rows.write.format("darkroom_sink").mode("append").option("staging", root + "/staging").save()
    print("committed")
except Exception as e:
    print("aborted", "lost" in str(e))
"""


@pytest.mark.parametrize("times,says", [(1, "committed"), (9, "aborted True")])
def test_a_task_that_fails_once_or_always(tmp_path, times, says):
    for name in ("seen", "out"):
        (tmp_path / name).mkdir()
    (tmp_path / "out" / "3").write_bytes(b"before")
    run = subprocess.run([sys.executable, "-c", RETRY, str(tmp_path), str(times)], capture_output=True, text=True, timeout=120, env=os.environ | {"PYTHONPATH": os.getcwd(), "SPARK_LOCAL_IP": "127.0.0.1"})
    assert says in run.stdout, run.stderr[-2000:]
    files = {n: (tmp_path / "out" / n).read_bytes() for n in os.listdir(tmp_path / "out")}
    assert files == ({str(i): b"%d" % i for i in range(10)} if times == 1 else {"3": b"before"})  # no parts are left
    assert not os.path.exists(tmp_path / "staging") or os.listdir(tmp_path / "staging") == []
    assert len(os.listdir(tmp_path / "seen")) == min(times, 2)


def test_actions_of_the_sink(spark, tmp_path):
    spark.dataSource.register(sink.FileSink)
    a, b, old = tmp_path / "a.png", tmp_path / ".a.png.orig", tmp_path / "old"
    a.write_bytes(b"first")
    old.write_bytes(b"x")
    os.utime(a, (1000, 1000))

    def run(*rows):
        frame = spark.createDataFrame([tuple(None if x is None else str(x) for x in r[:3]) + (r[3],) for r in rows], sink.SCHEMA)
        frame.write.format("darkroom_sink").mode("append").option("staging", str(tmp_path / "staging")).save()

    run(("backup", a, b, None), ("clean", old, None, None))
    run(("write", a, a, b"second"))
    assert (a.read_bytes(), b.read_bytes(), os.stat(a).st_mtime) == (b"second", b"first", 1000) and not old.exists()
    run(("backup", a, b, None), ("clean", old, None, None))  # again: the first original stays, what is gone is gone
    assert b.read_bytes() == b"first"
    run(("restore", b, a, None))
    run(("restore", b, a, None))
    assert a.read_bytes() == b"first" and sorted(os.listdir(tmp_path)) == ["a.png", "staging"]
    with pytest.raises(Exception, match="unknown action"):
        run(("write", None, tmp_path / "new", b"x"), ("burn", a, None, None))
    assert sorted(os.listdir(tmp_path)) == ["a.png", "staging"] and os.listdir(tmp_path / "staging") == []


def test_a_commit_that_was_broken_off_is_finished(tmp_path):
    writer = sink.Writer(str(tmp_path))
    row = type("Row", (), {"action": "write", "source": None, "content": b"x"})
    rows = []
    for i in range(3):
        r = row()
        r.dest = str(tmp_path / f"f{i}")
        rows.append(r)
    message, lost = writer.write(rows), writer.write(rows[:1])  # the second: of a task that another one replaced
    (_, _, dest, part), *_ = sink._lines(message.name)
    os.replace(part, dest)  # broken off after the first
    for _ in range(2):
        sink.finish(writer.folder, {message.name})
    assert sorted(os.listdir(tmp_path)) == ["f0", "f1", "f2"] and lost.rows == 1


def test_progress_grows_while_a_run_goes_on(spark):
    progress, seen = report.Progress(spark), []
    slow = F.udf(lambda i: time.sleep(0.04) or (None if i % 10 else "failed"), "string")
    rows = progress.watched(spark.range(0, 240, 1, 12).select("id", slow("id").alias("error")))
    run = threading.Thread(target=lambda: rows.write.format("noop").mode("overwrite").save())
    run.start()
    while run.is_alive():
        seen.append(progress.snapshot()["done"])
        time.sleep(0.02)
    run.join()
    assert progress.snapshot() == {"parts": 12, "done": 240, "failed": 24}
    assert seen == sorted(seen) and len({n for n in seen if 0 < n < 240}) >= 2
    rows.count()  # a partition that is computed again counts once
    assert progress.snapshot() == {"parts": 12, "done": 240, "failed": 24}


def test_headers_of_files(spark, tmp_path):
    import numpy as np

    picture = np.zeros((5, 7, 4), np.uint8)
    (tmp_path / "a.png").write_bytes(images.encode(picture))
    (tmp_path / "b.bmp").write_bytes(images.encode_bmp(picture[:, :, :3]))
    exif = b"\xff\xe1" + (60_000).to_bytes(2, "big") + b"\xff\xc0" * 29_999  # bytes like markers inside a segment
    (tmp_path / "c.jpg").write_bytes(b"\xff\xd8" + exif + b"\xff\xff\xff\xc2\x00\x11\x08\x00\x09\x00\x0b\x03" + b"x" * 100_000)
    (tmp_path / "d.jpg").write_bytes(b"\xff\xd8" + exif * 2 + b"\xff\xc0\x00\x11\x08\x00\x09\x00\x0b\x03")  # its size lies beyond the head
    (tmp_path / "e.txt").write_bytes(b"no picture")
    (tmp_path / "f.png").write_bytes(b"\x89PNG\r\n\x1a\n\0\0")
    (tmp_path / "g.jpg").write_bytes(b"\xff\xd8\xff\xda\x00\x02\xff\xc0\x00\x11\x08\x00\x09\x00\x0b\x03")  # pixels begin before a size
    (tmp_path / "h").write_bytes(b"")
    files = listing.tree(spark.createDataFrame([(str(tmp_path),)], "path string")).unionByName(spark.createDataFrame([(str(tmp_path / "gone"), 1, None), (None, None, None)], listing.FILES))
    rows = listing.heads(files, 1 << 16).withColumn("p", picture_header(F.col("head"))).select("path", F.octet_length("head").alias("n"), "p.*").collect()
    got = {os.path.basename(r["path"] or "null"): (r["format"], r["width"], r["height"], r["has_alpha"]) for r in rows}
    none = (None,) * 4
    assert got == {
        "a.png": ("png", 7, 5, True), "b.bmp": ("bmp", 7, 5, False), "c.jpg": ("jpeg", 11, 9, False), "d.jpg": ("jpeg", None, None, False), "e.txt": none, "f.png": ("png", None, None, False), "g.jpg": ("jpeg", None, None, False), "h": none, "gone": none, "null": none,
    }
    assert max(r["n"] or 0 for r in rows) == 1 << 16
