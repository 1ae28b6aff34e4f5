import os
import stat
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from darkroom.operators import external, images
from darkroom.plans import commands, dsl, options


def gradient(w=96, h=96, n=3):
    y, x = np.mgrid[0:h, 0:w]
    return np.stack([2 * x, 2 * y, x + y, 255 - x][:n], 2).astype(np.uint8)


def test_png_round_trips():
    for n in (1, 2, 3, 4):
        image = gradient(31, 17, n)
        assert (images.decode(images.encode(image)) == image).all()
    few = np.repeat(np.arange(8, dtype=np.uint8) * 30, 12).reshape(8, 4, 3)
    assert (images.decode(images.encode_palette(few)) == few).all()
    image = gradient(20, 10)
    raw = b"".join(bytes([4]) + _paeth(image, y) for y in range(10))
    data = images.SIGNATURE + images._chunk(b"IHDR", struct.pack(">IIBBBBB", 20, 10, 8, 2, 0, 0, 0)) + images._chunk(b"tEXt", b"a\0b") + images._chunk(b"IDAT", zlib.compress(raw)) + images._chunk(b"IEND", b"")
    assert (images.decode(data) == image).all()
    assert b"tEXt" not in images.stripped(data) and (images.decode(images.stripped(data)) == image).all()


def test_colours_are_sorted_and_cut_without_a_pass_for_each_box(monkeypatch):
    """As they were before, and few boxes are cut as arrays: most are small."""
    image, passes, spans = gradient(90, 70), [], np.ptp
    flat = image.reshape(-1, 3)
    colours, place, count = np.unique(flat, axis=0, return_inverse=True, return_counts=True)
    got = images._distinct(image)
    assert (got[0] == colours).all() and (got[1] == place.reshape(-1)).all() and (got[2] == count).all()
    monkeypatch.setattr(np, "ptp", lambda *a, **k: passes.append(1) or spans(*a, **k))
    means = images.median_cut(colours[::16], count[::16], 256)
    assert len(means) == 256 and len(passes) < 30 and len(np.unique(means, axis=0)) > 200


def _paeth(image, y):
    h, w, n = image.shape
    out = bytearray()
    for x in range(w):
        for c in range(n):
            a = int(image[y, x - 1, c]) if x else 0
            b = int(image[y - 1, x, c]) if y else 0
            d = int(image[y - 1, x - 1, c]) if x and y else 0
            p = a + b - d
            near = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - d) else b if abs(p - b) <= abs(p - d) else d
            out.append((int(image[y, x, c]) - near) & 255)
    return bytes(out)


def test_run_steps(spark):
    data = images.encode(gradient())
    files = spark.createDataFrame([("a.png", data), ("b.png", b"no"), ("c.png", None)], "path string, content binary")

    def run(text):
        return {r["path"]: r for r in images.run_steps(files, dsl.parse(text)).collect()}

    got = run("crop(width: 32, height: 16) -> optimise")
    assert images.decode(bytes(got["a.png"]["content"])).shape == (16, 32, 3) and got["a.png"]["error"] is None
    assert got["b.png"]["error"] and got["c.png"]["error"]
    assert images.decode(bytes(run("downscale(factor: 50%)")["a.png"]["content"])).shape == (48, 48, 3)
    assert images.decode(bytes(run("crop(ratio: 16:9) -> crop(longEdge: 20)")["a.png"]["content"])).shape[:2] == (10, 20)
    assert run("optimise")["a.png"]["new_size"] <= len(data)
    assert "external encoder" in run("convert(to: webp)")["a.png"]["error"]


def test_tools(spark, tmp_path):
    tool = tmp_path / "ffmpeg"
    tool.write_text('#!/bin/sh\nfor last; do :; done\necho "$@" > "$last"\n')
    tool.chmod(tool.stat().st_mode | stat.S_IXUSR)
    slow = tmp_path / "gs"
    slow.write_text("#!/bin/sh\nexec sleep 30\n")
    slow.chmod(slow.stat().st_mode | stat.S_IXUSR)
    df = spark.createDataFrame([("/in/a.mov", str(tmp_path / "a.mp4"))], "source string, dest string")
    none = F.lit(None).cast("string")
    plan = df.withColumn("args", commands.encode_video(F.col("source"), F.col("dest"), F.lit("custom"), F.lit(30), F.lit(False), none, True))
    row = external.run_commands(plan, "ffmpeg", folder=str(tmp_path)).first()
    assert row["error"] is None and row["new_size"] > 0 and "-preset fast -crf 21" in (tmp_path / "a.mp4").read_text()
    began = time.time()
    assert "more than 1 s" in external.run_tool("gs", [], timeout=1, folder=str(tmp_path)) and time.time() - began < 10
    assert external.run_commands(plan, "no-such-tool").first()["error"] == "no-such-tool was not found"
    assert {r["tool"]: r["path"] for r in external.doctor(spark, str(tmp_path)).collect()}["ffmpeg"] == str(tool)
    args = spark.range(1).select(commands.normalize_audio(F.lit("a"), F.lit("b"), F.lit(-16.0)).alias("n"), commands.change_speed(F.lit("a"), F.lit("b"), F.lit(2.0), F.lit("custom"), F.lit(30), F.lit(False)).alias("s"), commands.extract_pages(F.lit("a"), F.lit("o"), F.lit("JPG"), F.lit(9999)).alias("p")).first()
    assert "loudnorm=I=-16.0:TP=-1.5:LRA=11" in args["n"] and "setpts=0.50000*PTS" in args["s"] and "-r600" in args["p"] and "-sDEVICE=jpeg" in args["p"]


def test_the_next_try_runs_when_one_fails(spark, tmp_path):
    tool = tmp_path / "ffmpeg"
    tool.write_text('#!/bin/sh\nfor last; do :; done\necho "$@" >> "$(dirname "$0")/log"\ncase "$*" in *"-c:a copy"*) exit 1;; esac\necho "$@" > "$last"\n')
    tool.chmod(tool.stat().st_mode | stat.S_IXUSR)
    none = F.lit(None).cast("string")
    df = spark.createDataFrame([("/in/a.mov", str(tmp_path / "a.mp4"))], "source string, dest string")
    plan = df.withColumn("args", commands.tries_of_video(F.col("source"), F.col("dest"), F.lit("custom"), F.lit(30), F.lit(False), none))
    row = external.run_commands(plan, "ffmpeg", folder=str(tmp_path)).first()
    assert row["error"] is None and row["new_size"] > 0 and "-c:a copy" not in (tmp_path / "a.mp4").read_text()
    assert ["-c:a copy" in line for line in (tmp_path / "log").read_text().splitlines()] == [True, False]
    failing = df.withColumn("args", F.array(F.array(F.lit("-c:a"), F.lit("copy")), F.array(F.lit("-c:a"), F.lit("copy"), F.lit("x"))))
    assert "ended with 1" in external.run_commands(failing, "ffmpeg", folder=str(tmp_path)).first()["error"]
    assert external.capped(spark.range(0, 100, 1, 7), 2).rdd.getNumPartitions() == 2


def test_gifs_by_two_tools_or_one(spark, tmp_path):
    def tool(name, text):
        (tmp_path / name).write_text("#!/bin/sh\nfor last; do :; done\n" + text)
        (tmp_path / name).chmod(0o755)

    tool("ffmpeg", 'case "$last" in *%05d*) d=$(dirname "$last"); echo 2 > "$d/f00002.png"; echo 1 > "$d/f00001.png";; *) echo one > "$last";; esac\n')
    df = spark.createDataFrame([("/in/a.mov", str(tmp_path / "a.gif"))], "source string, dest string")
    fps, none, frames = F.lit(0), F.lit(None).cast("int"), F.array().cast("array<string>")
    plan = df.select("*", commands.gif_frames(F.col("source"), F.lit(f"{tmp_path}/work-{{}}/f%05d.png"), fps, none).alias("frames"), commands.gif_of_frames(F.col("dest"), fps, none, F.lit(True), frames).alias("assemble"), commands.video_to_gif(F.col("source"), F.col("dest"), F.lit(12), none).alias("one_pass"))
    assert external.run_gifs(plan, folder=str(tmp_path)).first()["error"] is None and (tmp_path / "a.gif").read_text() == "one\n"
    tool("gifski", 'shift; out="$1"; shift; echo "$@" | sed "s#/[^ ]*/##g" > "$out"\n')
    assert external.run_gifs(plan, folder=str(tmp_path)).first()["error"] is None
    assert (tmp_path / "a.gif").read_text() == "--fps 1 --quality 60 f00001.png f00002.png\n"
    tool("ffmpeg", "exit 0\n")
    assert "no frames" in external.run_gifs(plan, folder=str(tmp_path)).first()["error"]
    assert not [n for n in os.listdir(tmp_path) if n.startswith("work-")]


def test_bmp_round_trips():
    for n in (3, 4):
        image = gradient(31, 17, n)
        assert (images.decode_bmp(images.encode_bmp(image)) == image).all()
        assert images.optimised(images.encode_bmp(image)) == images.encode_bmp(image)
    with pytest.raises(images.Unsupported):
        images.decode_bmp(b"BM" + bytes(60))


def test_palettes_are_dithered():
    image = gradient(64, 64)
    back = images.decode(images.encode_palette(image, 16))
    assert len(np.unique(back.reshape(-1, 3), axis=0)) <= 16
    blocks = [x.reshape(8, 8, 8, 8, 3).mean((1, 3)) for x in (image.astype(float), back.astype(float))]
    assert np.abs(blocks[0] - blocks[1]).mean() < 8  # the mean of a block stays about what it was
    clear = images.decode(images.encode_palette(gradient(40, 40, 4), 32))
    assert clear.shape == (40, 40, 4) and len(np.unique(clear.reshape(-1, 4), axis=0)) <= 32


def test_the_smallest_format_wins():
    png = images.encode(gradient(40, 30))
    small = {"jpeg": lambda image, factor: b"j" * 7}
    assert images.adapted(png, encoders=small) == ("jpeg", b"j" * 7)
    assert images.adapted(images.encode(gradient(40, 30, 4)), encoders=small)[0] == "png"
    assert images.adapted(images.encode_bmp(gradient(40, 30)))[0] == "png"
    assert images.adapted(png, encoders={"jpeg": lambda image, factor: b""})[0] == "png"
    least = images.adapted(png)[1]
    assert images.adapted(least) == ("png", least)  # nothing smaller: the source


def test_dct_pictures_and_pruning():
    from darkroom.operators import pdf

    assert pdf.is_dct_image(b"<< /Subtype /Image /Filter /DCTDecode >>") and pdf.is_dct_image(b"<< /Filter [ /FlateDecode /DCTDecode ] /Subtype/Image >>")
    assert not pdf.is_dct_image(b"<< /Subtype /Form /Filter /DCTDecode >>") and not pdf.is_dct_image(b"<< /Subtype /Image /Filter /FlateDecode >>")
    picture = b"\xff\xd8" + b"j" * 300
    data = b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [3 0 R] >>\nendobj\n3 0 obj\n<< /Type /Page /Parent 2 0 R /X 4 0 R >>\nendobj\n"
    data += b"4 0 obj\n<< /Subtype /Image /Filter /DCTDecode /Length 302 >>\nstream\n" + picture + b"\nendstream\nendobj\n5 0 obj\n(" + b"lost" * 90 + b")\nendobj\ntrailer\n<< /Root 1 0 R >>\n"
    plain, with_jpeg = pdf.recompressed(data), pdf.recompressed(data, lambda x: x[:50])
    assert picture in plain and b"lost" not in plain and len(plain) < len(data)
    assert picture not in with_jpeg and b"/Length 50" in with_jpeg and picture[:50] in with_jpeg
    assert picture in pdf.recompressed(data, lambda x: x + b"more")  # not smaller: it stays


def test_missing_folders_are_left_out(spark, tmp_path):
    pipelines = spark.createDataFrame([], "name string, dsl string")
    none = spark.createDataFrame([], "source string, file_type string, pipeline string")
    with pytest.warns(UserWarning, match="not there"):
        found = options.targets(none, pipelines, [str(tmp_path), str(tmp_path / "gone")], "optimise", os.path.isdir)
    assert found == [(str(tmp_path), "all", "optimise")]


def test_options_and_saved_pipelines(spark):
    assert options.load_config(None) == options.load_config("[1") == options.Config()
    saved = options.load_config('{"aggressive": true, "backup": false, "compression": "x"}')
    assert options.resolve(saved, compression=10)["factor"] == 64 and not options.resolve(saved)["backup"]
    assert options.resolve(options.Config(), compression=400)["factor"] == 100
    pipelines = spark.createDataFrame([("web", "optimise")], "name string, dsl string")
    pipelines = options.add_pipeline(options.add_pipeline(pipelines, "web", "adaptive"), "clip", "removeAudio")
    assert dict(map(tuple, pipelines.collect())) == {"web": "adaptive", "clip": "removeAudio"}
    with pytest.raises(dsl.DslError):
        options.add_pipeline(pipelines, "bad", "blur")
    automations = options.attach(spark.createDataFrame([], "source string, file_type string, pipeline string"), "/in", "web", "image")
    assert options.targets(automations, pipelines) == [("/in", "image", "adaptive")]
    assert options.targets(automations, pipelines, ["/x"], "clip") == [("/x", "all", "removeAudio")]
    assert options.detach(automations, "/in").count() == 0 and options.delete_pipeline(pipelines, "web").count() == 1


def test_video_commands(spark):
    rows = spark.range(2).select(F.when(F.col("id") == 0, "vp9").otherwise("av1").alias("codec"), F.when(F.col("id") == 1, 640).alias("w"))
    s, d, no, t = F.lit("in"), F.lit("out"), F.lit(False), F.lit("custom")
    got = {r["codec"]: r for r in rows.select("codec", F.array_join(commands.convert_video(s, d, F.col("codec"), t, F.lit(100), no, no, True), " ").alias("c"), F.array_join(commands.video_to_gif(s, d, F.lit(12), F.col("w")), " ").alias("g"), F.array_join(commands.cap_fps(s, d, F.lit(0), t, F.lit(0), no), " ").alias("f"), F.array_join(commands.remove_audio(s, d), " ").alias("r"), F.array_join(commands.encode_audio(s, d, F.lit("mp3"), F.lit(128), no), " ").alias("a")).collect()}
    assert got["vp9"]["c"] == "-y -i in -vcodec libvpx-vp9 -crf 48 -b:v 0 -c:a libopus -b:a 128k -map 0:v -map 0:a? -hide_banner -nostats out"
    assert got["av1"]["c"] == "-y -i in -vcodec libsvtav1 -crf 50 -preset 6 -c:a copy -map 0:v -map 0:a? -movflags +faststart -hide_banner -nostats out"
    assert "-vf fps=12 " in got["vp9"]["g"] and "-vf fps=12,scale=640:-1:flags=lanczos " in got["av1"]["g"]
    assert "-vf fps=fps=1 " in got["vp9"]["f"] and "-preset slower " in got["vp9"]["f"]
    assert got["vp9"]["r"] == "-y -i in -c copy -an -hide_banner -nostats out" and got["vp9"]["a"] == "-y -i in -c:a libmp3lame -q:a 5 out"


def test_watermark_budget_and_scripts(spark):
    data, mark = images.encode(gradient()), images.encode(np.full((4, 8, 4), 255, np.uint8))
    files = spark.createDataFrame([("a.png", data)], "path string, content binary")

    def run(text, **more):
        return images.run_steps(files, dsl.parse(text), **more).first()

    row = run("watermark(image: m, position: topLeft, scale: 0.25)", overlays={"m": mark})
    got = images.decode(bytes(row["content"]))
    assert (got[10:22, 10:34] == 255).all() and (got[40:] == gradient()[40:]).all()
    assert "external" in run("watermark(image: m)")["error"]
    sizes = [run(f"targetSize(bytes: {b})")["new_size"] for b in (10**6, 1)]
    assert sizes[1] <= sizes[0] <= len(data)
    assert run("runScript(code: look) -> adaptive", scripts={"look": len})["error"] is None and "no function" in run("runScript(code: other)")["error"]


def test_backup_restore_and_clean(spark, tmp_path):
    from darkroom.functions import paths
    from darkroom.operators import placement

    a = tmp_path / "a.png"
    a.write_bytes(b"first")
    files = spark.createDataFrame([(str(a),)], "path string")
    plan = placement.backups_to_make(files, files.limit(0))
    for content in (b"second", b"third"):
        assert placement.apply_backups(plan).first()["error"] is None
        done = files.select("path", F.col("path").alias("dest"), F.lit(content).alias("content"))
        assert placement.apply_writes(done).first()["error"] is None and a.read_bytes() == content
    listed = files.union(files.select(paths.backup_name(F.col("path"))))
    pairs = placement.restore_pairs(listed)
    for _ in range(2):
        assert placement.apply_restores(pairs).first()["error"] is None and a.read_bytes() == b"first"
    assert placement.apply_backups(plan).first()["error"] is None and placement.apply_cleaning(pairs).first()["error"] is None
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.png"]
    gone = spark.createDataFrame([(str(tmp_path / "x"), str(tmp_path / "y"))], "backup string, original string")
    assert placement.apply_restores(gone).first()["error"]


def test_image_source(spark, tmp_path):
    from darkroom.sources.catalog import decoded

    (tmp_path / "a.png").write_bytes(images.encode(gradient(8, 4)))
    (tmp_path / "b.png").write_bytes(b"no picture")
    (row,) = decoded(spark, str(tmp_path)).collect()
    assert (row["width"], row["height"], row["nChannels"]) == (8, 4, 3)
    assert (np.frombuffer(row["data"], np.uint8).reshape(4, 8, 3)[:, :, ::-1] == gradient(8, 4)).all()
