import pytest
from pyspark.sql import functions as F

from darkroom.functions import dial, geometry, paths, text
from darkroom.operators import placement, report, selection
from darkroom.sources.catalog import collect, png_header, scan
from darkroom.streaming import watch


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


# factor, jpeg, secondary, png, gif lossy, gif colours, conversion, crf, av1, vp9, hardware
GOLDEN = [
    (0, 95, 97, 100, 0, None, 75, 18, 24, 24, 70),
    (5, 95, 97, 100, 0, None, 73, 18, 24, 24, 70),
    (30, 85, 90, 100, 30, None, 60, 21, 31, 30, 58),
    (50, 69, 73, 79, 59, 256, 50, 24, 36, 35, 49),
    (64, 58, 61, 64, 80, 202, 43, 25, 40, 39, 42),
    (80, 46, 47, 46, 104, 141, 35, 27, 45, 43, 34),
    (90, 38, 39, 36, 118, 102, 30, 29, 47, 45, 30),
    (100, 30, 30, 25, 133, 64, 25, 30, 50, 48, 25),
]


def test_dial_golden_values(spark):
    f = F.col("factor")
    df = spark.createDataFrame([(g[0],) for g in GOLDEN], "factor int").orderBy("factor")
    got = df.select("factor", dial.jpeg_quality(f), dial.jpeg_secondary_quality(f), dial.png_max(f), dial.gif_lossy(f), dial.gif_colors(f), dial.conversion_quality(f), dial.h264_crf(f), dial.av1_crf(f), dial.vp9_crf(f), dial.hardware_quality(f)).collect()
    assert [tuple(r) for r in got] == GOLDEN


@pytest.mark.parametrize("a, b, newer", [("0.5.0", "0.4.0", True), ("1.0.0", "0.9.9", True), ("0.4.1", "0.4.0", True), ("0.4.0", "0.4.0", False), ("0.3.9", "0.4.0", False), ("v0.5.0", "v0.4.0", True), ("0.4.0-rc1", "0.4.0", False)])
def test_versions(spark, a, b, newer):
    assert one(spark, text.is_newer(F.lit(a), F.lit(b))) is newer


def test_templates(spark):
    now = F.lit("2024-01-02 03:04:05").cast("timestamp")

    def expand(template, counter=1):
        return one(spark, text.expand_template(template, F.lit("/a/photo.png"), F.lit(counter), now, home="/h"))

    assert expand("%f-thumb.%e") == "photo-thumb.png"
    assert expand("n%i", 5) == "n5" and expand("n%i-%i", 5) == "n5-6"
    assert expand("100%%") == "100%" and expand("%z%") == "%z%"
    assert expand("~/%P") == "/h//a" and expand("") == ""
    assert len(expand("%r")) == 6 and expand("%r") == expand("%r")


def test_paths(spark):
    rows = [("/a/.hidden", "", None), ("/a/n.", "", None), ("/a/x.tar.GZ", "gz", None), ("/a/b.JPG", "jpg", "image"), ("c.oga", "oga", "audio"), ("/v.m4v", "m4v", "video"), ("/a/d.pdf/", "pdf", "pdf"), (None, None, None)]
    df = spark.createDataFrame(rows, "path string, ext string, kind string")
    got = [tuple(r) for r in df.select("path", paths.extension(F.col("path")), paths.kind(F.col("path"))).collect()]
    assert got == rows
    assert one(spark, paths.backup_name(F.lit("/a/b.png"))) == "/a/.b.png.orig"
    assert one(spark, paths.original_of_backup(F.lit("/a/.b.png.orig"))) == "/a/b.png"
    assert one(spark, paths.original_of_backup(F.lit("/a/.orig"))) is None
    assert one(spark, paths.in_folder(F.lit("/ab/c"), F.lit("/a"))) is False and one(spark, paths.in_folder(F.lit("/a/c"), F.lit("/a/"))) is True


def test_rectangles_and_guards(spark):
    i = F.lit
    assert one(spark, geometry.rect_pixels(i(100), i(50), i(0.995), i(0.0), i(0.5), i(0.5))) is None
    assert tuple(one(spark, geometry.crop_plan(i(4000), i(3000), i(None), i(None), i(1920), i(None), i(None)))) == ("resize", 1920, 1440)
    assert one(spark, geometry.even(i(1))) == 2 and one(spark, geometry.even(i(0))) == 0
    assert one(spark, selection.guarded_size(i(10), i(0), i(False))) == 10 and one(spark, selection.guarded_size(i(10), i(12), i(True))) == 12
    assert one(spark, text.human_size(i(1536))) == "1.5 KB" and one(spark, text.human_size(i(1023))) == "1023 B"


def test_empty_tables(spark):
    files = spark.createDataFrame([], "path string, length long")
    done = selection.with_optimised(collect(files))
    assert tuple(report.summary(done).first()) == (0, 0, 0, 0, 0, 0.0)
    assert placement.restore_pairs(files).count() == 0
    assert placement.numbered(files).count() == 0


def test_numbering_is_gapless_in_path_order(spark):
    files = spark.createDataFrame([(f"/a/{i:04d}.png",) for i in range(500)], "path string").repartition(7)
    got = [tuple(r) for r in placement.numbered(files).orderBy("path").select("path", "ordinal").collect()]
    assert got == [(f"/a/{i:04d}.png", i + 1) for i in range(500)]
    with pytest.raises(ValueError):
        placement.resolved_output(files, "/one.png", False, F.current_timestamp())


def test_scan_and_png_header(spark, tmp_path):
    import struct
    import zlib

    def png(w, h, color):
        def chunk(kind, data):
            return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

        bpp = {2: 3, 6: 4}[color]
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, 0)) + chunk(b"IDAT", zlib.compress((b"\0" + b"\1" * w * bpp) * h)) + chunk(b"IEND", b"")

    (tmp_path / "sub").mkdir()
    (tmp_path / "a.png").write_bytes(png(7, 5, 6))
    (tmp_path / "sub" / "b.PNG").write_bytes(png(9, 3, 2))
    (tmp_path / "c.txt").write_bytes(b"no")
    assert scan(spark, str(tmp_path)).count() == 2 and scan(spark, str(tmp_path), recursive=False).count() == 1
    assert "content" not in scan(spark, str(tmp_path)).columns
    rows = scan(spark, str(tmp_path), content=True).withColumns(png_header(F.col("content"))).select("width", "height", "has_alpha").collect()
    assert sorted(map(tuple, rows)) == [(7, 5, True), (9, 3, False)]


def test_watch_rules(spark):
    rows = [(1, "/in/a.png", 0.0, 1), (2, "/in/b.png", 0.4, 1), (3, "/in/.c.png", 0.5, 1), (4, "/in/a.png", 2.0, 1), (5, "/in/a.png", 3.0, 5)]
    events = spark.createDataFrame(rows, "event_id int, path string, t double, mtime int").withColumn("event_time", F.col("t").cast("timestamp"))
    assert sorted((r["path"], r["n_events"]) for r in watch.debounced(events).collect()) == [("/in/.c.png", 1), ("/in/a.png", 1), ("/in/a.png", 1), ("/in/a.png", 1), ("/in/b.png", 1)]
    assert sorted(r["event_id"] for r in watch.unseen(events).collect()) == [1, 2, 3, 5]
    routed = watch.routed(events, [("/inn", "all", "x"), ("/in", "video", "y"), ("/in", "image", "z")])
    assert {r["pipeline"] for r in routed.collect()} == {"z"} and routed.count() == 4


def test_debounce_deals_a_run_over_tasks(spark):
    t = [i * 0.4 for i in range(200)] + [80.0] * 3 + [80.5, 80.99, 99.0, 99.499, 200.0]
    rows = [(f"/in/{i % 7}.png" if i % 11 else None, x) for i, x in enumerate(t)] + [("/in/x.png", None)]
    events = spark.createDataFrame(rows, "path string, t double").withColumn("event_time", (F.col("t") * 1000).cast("long") * F.expr("INTERVAL 1 MILLISECOND") + F.lit("2024-01-01").cast("timestamp"))
    runs, last = [], None
    for (path, x) in sorted(((p, round(x * 1000)) for p, x in rows if x is not None), key=lambda r: r[1]):
        if last is None or x >= last + 500:
            runs.append([])
        runs[-1].append(path)
        last = x
    want = sorted((len(r), sorted(set(r) - {None})) for r in runs)
    got = watch.debounced(events).collect()
    of = {s: [r for r in got if r["start"] == s] for s in {r["start"] for r in got}}
    assert sorted((sum(r["n_events"] for r in own), sorted({r["path"] for r in own} - {None})) for own in of.values()) == want
    counts = watch.debounced_counts(events)
    assert sorted((r["n_events"], r["n_paths"], r["first_path"] or "") for r in counts.collect()) == sorted((n, len(p), min(p, default="")) for n, p in want)
    assert {(r["start"], r["end"]) for r in counts.collect()} == {(r["start"], r["end"]) for r in got}
    dealt = watch.by_session_and_path(events, "500 milliseconds", "event_time")
    assert dealt.where("n > 0").count() == sum(len(set(r)) for r in runs)
    assert watch.debounced_counts(events.limit(0)).count() == 0
