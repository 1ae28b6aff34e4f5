"""More queries with SQL: columns of the dial, command lines, options, watch state, and pictures that go through operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import dial, dims, geometry, text
from .operators import dispatch, external, report
from .plans import commands, dsl_columns, options
from .queries import _CRF, _PRESET, FX, GRID, IDS, C, _chosen, _events, _factors, _files, _I, _pick, _pick_sql, _query, _results, _spread
from .sources.catalog import fixture
from .streaming import watch


# Parts of the dial and of geometry


@_query(f"""WITH {GRID} SELECT file_id, factor, factor = {dial.NORMAL} AS normal, factor = {dial.AGGRESSIVE} AS aggressive, CASE WHEN factor >= 50 THEN 60 ELSE 90 END AS gif_quality FROM f""")
def dial_presets(spark, sf_dir):
    f = C("factor")
    return _factors(spark, sf_dir).select("file_id", "factor", (f == dial.NORMAL).alias("normal"), (f == dial.AGGRESSIVE).alias("aggressive"), dial.gif_from_video_quality(f >= 50).alias("gif_quality"))


@_query(f"""WITH {IDS}, t(audio, allowed) AS (VALUES ('same', [56, 64, 80, 96, 128, 160, 192, 256, 320]), ('aac', [56, 64, 80, 96, 128, 160, 192, 256]), ('mp3', [56, 64, 80, 96, 128, 160, 192, 256, 320]),
  ('opus', [32, 48, 64, 80, 96, 128])), c AS (SELECT file_id, {_pick_sql(list(dims.AUDIO_ALLOWED_KBPS))} AS audio FROM ids) SELECT file_id, audio, kbps FROM c JOIN t USING (audio), unnest(allowed) AS u(kbps)""")
def audio_allowed_kbps(spark, sf_dir):
    """The bit rates that each file's audio format may have; formats without a loss have none."""
    allowed = F.create_map(*[x for a, k in dims.AUDIO_ALLOWED_KBPS.items() for x in (F.lit(a), F.array(*map(F.lit, k)).cast("array<int>"))])
    return _chosen(spark, sf_dir, "audio", list(dims.AUDIO_ALLOWED_KBPS)).select("file_id", "audio", F.explode(F.try_element_at(allowed, C("audio"))).alias("kbps"))


_RATIOS = ["16:9", " 4 : 3 ", "0:5", "1.91:1", "abc", "1:", "5", "2:1:3", "-1:2"]


@_query(f"""WITH {IDS}, s AS (SELECT file_id, CASE WHEN file_id % 2 = 0 THEN {_pick_sql(_RATIOS, 2)} ELSE file_id % 40 || ':' || file_id % 23 END AS ratio FROM ids), p AS (SELECT file_id, ratio, CASE WHEN contains(ratio, ':') THEN trim(split_part(ratio, ':', 1)) END AS a, CASE WHEN contains(ratio, ':') THEN trim(substr(ratio, strpos(ratio, ':') + 1)) END AS b FROM s),
n AS (SELECT file_id, ratio, CASE WHEN regexp_full_match(a, '\\d+') THEN CAST(a AS INT) END AS wi, CASE WHEN regexp_full_match(b, '\\d+') THEN CAST(b AS INT) END AS hi, TRY_CAST(a AS DOUBLE) AS wd, TRY_CAST(b AS DOUBLE) AS hd FROM p)
SELECT file_id, ratio, CASE WHEN hi IS NOT NULL THEN wi END AS w, CASE WHEN wi IS NOT NULL THEN hi END AS h, CASE WHEN hd >= 0 AND wd >= 0 THEN wd END AS wide, CASE WHEN hd >= 0 AND wd >= 0 THEN hd END AS high FROM n""")
def parse_ratios(spark, sf_dir):
    own = F.concat((C("file_id") % 40).cast("string"), F.lit(":"), (C("file_id") % 23).cast("string"))
    rows = _chosen(spark, sf_dir, "ratio", _RATIOS, 2).withColumn("ratio", F.when(C("file_id") % 2 == 0, C("ratio")).otherwise(own)).withColumns({"i": text.parse_ratio(C("ratio")), "d": text.parse_ratio(C("ratio"), "double")})
    return rows.select("file_id", "ratio", C("i.w").alias("w"), C("i.h").alias("h"), C("d.w").alias("wide"), C("d.h").alias("high"))


@_query(f"""WITH {FX} SELECT file_id, CASE WHEN file_id % 3 = 0 THEN height WHEN file_id % 3 = 1 THEN width ELSE greatest(width, 0) END AS long_edge, (width - least(width, 100)) // 2 AS x, (height - least(height, 90)) // 2 AS y FROM fx""")
def long_edges(spark, sf_dir):
    spec = geometry.as_long_edge(F.when(C("file_id") % 3 != 0, C("width")), F.when(C("file_id") % 3 != 1, C("height")))
    at = geometry.crop_offsets(C("width"), C("height"), F.least(C("width"), F.lit(100)), F.least(C("height"), F.lit(90)))
    return fixture(spark, sf_dir).select("file_id", spec["long_edge"].alias("long_edge"), at["x"].alias("x"), at["y"].alias("y"))


_SPEEDS = [0.1, 0.25, 0.5, 1.0, 1.25, 2.0, 3.2, 8.0, 20.0]


@_query(f"""WITH {IDS}, s AS (SELECT file_id, {_pick_sql(_SPEEDS)} AS factor FROM ids), c AS (SELECT *, greatest(0.25e0, least(8e0, factor)) AS f FROM s)
SELECT file_id, factor, printf('setpts=%.5f*PTS', 1e0 / f) AS video, printf('atempo=%.5f', f) AS audio FROM c""")
def speed_texts(spark, sf_dir):
    return _chosen(spark, sf_dir, "factor", _SPEEDS).withColumn("s", geometry.speed_filters(C("factor"))).select("file_id", "factor", "s.video", "s.audio")


_SUFFIX = " || ".join(f"substr('abcdefghijklmnopqrstuvwxyz0123456789', CAST('0x' || substr(md5({{0}}), {4 * k + 1}, 4) AS INT) % 36 + 1, 1)" for k in range(6))


@_query(f"""WITH {FX} SELECT file_id, {_SUFFIX.format("path")} AS suffix, {_SUFFIX.format("path || '!'")} AS other, '/out/' || stem || '-' || {_SUFFIX.format("path")} || '.' || regexp_extract(name, '^.+\\.([^.]*)$', 1) AS output FROM ext""")
def suffix_texts(spark, sf_dir):
    """Suffixes of six of 36 characters, alone and in a template: the same for the same file."""
    from .operators.placement import resolved_output

    named = resolved_output(fixture(spark, sf_dir), "/out/%f-%r.%e", False, F.lit("2024-03-07 09:05:06").cast("timestamp"))
    return named.select("file_id", text.suffix_characters(C("path")).alias("suffix"), text.suffix_characters(F.concat("path", F.lit("!"))).alias("other"), "output")


# The step language: texts, what they are canonically, or what is wrong with them

_CHAINS = [
    ("optimize", "optimise", None), ("downscale(factor: 50%)", "downscale(factor: 0.5)", None), ("crop(width:1600)->convert( to: webp )", "crop(width: 1600) -> convert(to: webp)", None),
    ("crop(long_edge: 1920)", "crop(longEdge: 1920)", None), ("crop(aspect: 16:9)", "crop(ratio: 16:9)", None), ("normalise", "normalize(lufs: -16)", None), ("capFps(fps: 24, fps: 60)", "capFps(fps: 24)", None),
    ("target_size(kb: 500)", "targetSize(bytes: 500)", None), ("targetSize(kb: 1.5mb)", "targetSize(bytes: 1500000)", None), ('watermark(image: "logo.png")', 'watermark(image: "logo.png", position: bottomRight, opacity: 1, scale: 0.15)', None), ("strip_exif -> remove_audio", "stripExif -> removeAudio", None), ("", "", None),
    ("downscale", None, "downscale requires factor:"), ("convert()", None, "convert requires to:"), ("changeSpeed", None, "changeSpeed requires factor:"), ("lowerBitrate(x: 1)", None, "lowerBitrate requires kbps:"), ("targetSize", None, "targetSize requires bytes: or kb:"),
    ("sharpen", None, "unknown step 'sharpen'"), ("crop(width: 5", None, "missing ')' in step 'crop(width: 5'"), ("crop(width)", None, "expected 'key: value' in 'width'"), ("crop(smart: true)", None, "crop requires width:, height:, longEdge: or ratio:"),
]


@_query(f"WITH {IDS} SELECT file_id, {_pick_sql([c for c, *_ in _CHAINS])} AS chain, {_pick_sql([t for _, t, _ in _CHAINS])} AS canonical, {_pick_sql([e for *_, e in _CHAINS])} AS error FROM ids")
def dsl_canonical(spark, sf_dir):
    """Chains of a list, read as columns, and printed."""
    rows = _chosen(spark, sf_dir, "chain", [c for c, *_ in _CHAINS]).withColumn("p", dsl_columns.parsed(C("chain")))
    return rows.select("file_id", "chain", dsl_columns.canonical(C("p.steps")).alias("canonical"), "p.error")


# Chains with numbers of their own: (the chain, its canonical print, its error) as SQL over ``n``, a document's id.
_OWN = [
    ("'crop(width: ' || (100 + n % 900) || ', height:' || (50 + n % 700) || ') -> optimise'", "'crop(width: ' || (100 + n % 900) || ', height: ' || (50 + n % 700) || ') -> optimise'", None),
    ("' downscale( factor : ' || (n % 99 + 1) || '% )'", "'downscale(factor: ' || rtrim(rtrim(printf('%.2f', (n % 99 + 1) / 100e0), '0'), '.') || ')'", None),
    ("'convert(to: \"w' || n || '\")->stripexif'", "'convert(to: w' || n || ') -> stripExif'", None),
    ("'crop(ratio: ' || (1 + n % 16) || ' :' || (1 + n % 9) || ', smart: true, ratio: 1:1)'", "'crop(ratio: ' || (1 + n % 16) || ':' || (1 + n % 9) || ', smart: true)'", None),
    ("'crop(smart: true, x: ' || n || ')'", None, "'crop requires width:, height:, longEdge: or ratio:'"),
    ("'optimise -> blur' || n || '(x: 1)'", None, "'unknown step `blur' || n || '`'"),
    ("'capFps(fps: ' || (n % 60) || ') -> remove_audio -> lowerBitrate(kbps: +' || (64 + n % 200) || ')'", "'capFps(fps: ' || (n % 60) || ') -> removeAudio -> lowerBitrate(kbps: ' || (64 + n % 200) || ')'", None),
    ("'watermark(image: m' || n || '.png, scale: 0.' || (1 + n % 9) || ')'", "'watermark(image: \"m' || n || '.png\", position: bottomRight, opacity: 1, scale: 0.' || (1 + n % 9) || ')'", None),
    ("'targetSize(kb: ' || (n % 500) || 'KB) -> -> adaptive'", "'targetSize(bytes: ' || (n % 500 * 1000) || ') -> adaptive'", None),
    ("'downscale(factor: x' || n || ')'", None, "'bad factor `x' || n || '`'"),
    ("'normalise(lufs: -' || (n % 30) || '.5)'", "'normalize(lufs: -' || (n % 30) || '.5)'", None),
    ("'adaptive -> optimise(a' || n", None, "'missing `)` in step `optimise(a' || n || '`'"),
    ("'crop(width ' || n || ')'", None, "'expected `key: value` in `width ' || n || '`'"),
    ("'runScript(code: `go ' || n || '`)'", "'runScript(code: \"go ' || n || '\")'", None),
]


def _own_sql(k: int) -> str:
    """A grave accent stands for an apostrophe, which the two engines quote differently."""
    cases = " ".join(f"WHEN {i} THEN {c[k]}" for i, c in enumerate(_OWN) if c[k])
    return f"replace(CASE n % {len(_OWN)} {cases} END, chr(96), chr(39))"


@_query(f"WITH i AS (SELECT doc_id AS n FROM documents) SELECT n AS file_id, {_own_sql(1)} AS canonical, {_own_sql(2)} AS error FROM i")
def dsl_parse(spark, sf_dir):
    """Chains with each document's own numbers in them, read and printed."""
    names = spark.read.parquet(f"{sf_dir}/documents.parquet").select(C("doc_id").cast("long").alias("n"))
    rows = names.withColumn("p", dsl_columns.parsed(F.expr(_own_sql(0))))
    return rows.select(C("n").alias("file_id"), dsl_columns.canonical(C("p.steps")).alias("canonical"), "p.error")


# Options

_FLAGS = {"compression": ([None, 10, 180], 1), "aggressive": ([True, False], 3), "saved_aggressive": ([True, False], 6), "saved_compression": ([30, 55], 12), "no_backup": ([True, False], 24), "saved_backup": ([True, False], 48), "strip": ([True, False], 96)}


@_query(f"""WITH {IDS}, o AS (SELECT file_id, {", ".join(f"{_pick_sql(*v)} AS {k}" for k, v in _FLAGS.items())} FROM ids)
SELECT *, CASE WHEN aggressive OR saved_aggressive THEN 64 ELSE least(100, coalesce(compression, saved_compression)) END AS factor,
  saved_backup AND NOT no_backup AS backup, strip OR NOT saved_backup AS strips, saved_backup AND NOT strip AS dates FROM o""")
def option_precedence(spark, sf_dir):
    """Flags and saved options of each file's run, all combinations of them in turn."""
    rows = fixture(spark, sf_dir).select("file_id").withColumns({k: _pick(*v) for k, v in _FLAGS.items()})
    got = options.resolved(
        {"compression": C("saved_compression"), "aggressive": C("saved_aggressive"), "backup": C("saved_backup"), "strip_metadata": ~C("saved_backup"), "preserve_dates": C("saved_backup")},
        {"compression": C("compression"), "aggressive": C("aggressive"), "no_backup": C("no_backup"), "strip_metadata": C("strip"), "no_dates": C("strip")},
    )
    return rows.select("*", got["factor"].alias("factor"), got["backup"].alias("backup"), got["strip_metadata"].alias("strips"), got["preserve_dates"].alias("dates"))


_SPECS = ["small", "optimize", "blur(x: 1)", "gone", "convert(to: webp)", "bad"]


@_query(f"""WITH {IDS}, a AS (SELECT file_id, '/in/' || file_id % 40 AS folder, {_pick_sql(["all", "image", "pdf"])} AS type, {_pick_sql(_SPECS)} AS spec FROM ids)
SELECT file_id, folder, type, CASE spec WHEN 'small' THEN 'crop(width: 9)' WHEN 'optimize' THEN 'optimise' ELSE spec END AS pipeline FROM a WHERE file_id % 40 % 3 <> 0 AND spec IN ('small', 'optimize', 'convert(to: webp)')""")
def watch_targets(spark, sf_dir):
    """A saved automation for each document: those whose folder is there and whose pipeline, saved or a text, can be read."""
    automations = _chosen(spark, sf_dir, "pipeline", _SPECS).select(C("file_id").alias("i"), F.concat(F.lit("/in/"), (C("file_id") % 40).cast("string")).alias("source"), _pick(["all", "image", "pdf"]).alias("file_type"), "pipeline")
    pipelines = spark.createDataFrame([("small", "crop(width:9)"), ("bad", "crop()")], "name string, dsl string")
    there = automations.select(C("source").alias("folder")).distinct().where("CAST(substr(folder, 5) AS INT) % 3 <> 0")
    return options.target_table(automations, pipelines, there).where("error IS NULL").select(C("target").alias("file_id"), "folder", C("file_type").alias("type"), "pipeline")


# Command lines


def _line(words) -> F.Column:
    return F.array_join(words, " ")


_TAIL = "-hide_banner -nostats"
_CODED = f"'-vcodec h264 -tag:v avc1' || CASE WHEN factor <= 0 THEN ' -preset slower' ELSE ' -preset ' || {_PRESET} || ' -crf ' || {_CRF} END"


@_query(f"""WITH {FX}, g AS (SELECT *, CAST(factor AS DOUBLE) AS x, greatest(0.25e0, least(8e0, (1 + file_id % 50) * 0.2e0)) AS speed FROM fx)
SELECT file_id, '-y -i ' || path || ' -c copy -an {_TAIL} /o' AS mute, '-y -i ' || path || ' -vf fps=fps=' || greatest(1, file_id % 60) || ' ' || {_CODED} || ' {_TAIL} /o' AS fps,
  '-y -i ' || path || ' -filter:v ' || printf('setpts=%.5f*PTS', 1e0 / speed) || ' -filter:a ' || printf('atempo=%.5f', speed) || ' ' || {_CODED} || ' {_TAIL} /o' AS speed,
  '-y -i ' || path || ' -vf fps=' || (5 + file_id % 20) || CASE WHEN file_id % 2 = 0 THEN ',scale=' || width || ':-1:flags=lanczos' ELSE '' END || ' {_TAIL} /o' AS gif,
  '-y -i ' || path || CASE WHEN file_id % 2 = 0 THEN ' -vf scale=' || width || ':-2' ELSE '' END || ' ' || {_CODED} || ' -c:a copy -map 0:v -map 0:a? -movflags +faststart {_TAIL} /o' AS first_try,
  '-y -i ' || path || CASE WHEN file_id % 2 = 0 THEN ' -vf scale=' || width || ':-2' ELSE '' END || ' ' || {_CODED} || ' -movflags +faststart {_TAIL} /o' AS second_try FROM g""")
def video_commands(spark, sf_dir):
    rows, no = fixture(spark, sf_dir), F.lit(False)
    src, dst, tier, f, n = C("path"), F.lit("/o"), F.lit("custom"), C("factor"), C("file_id")
    speed = (1 + n % 50) * F.lit(0.2)
    wide = geometry.video_crop_filter(F.when(n % 2 == 0, C("width")), *[F.lit(None).cast("int")] * 4)
    tries = commands.tries_of_video(src, dst, tier, f, no, wide)
    return rows.select(
        "file_id", _line(commands.remove_audio(src, dst)).alias("mute"), _line(commands.cap_fps(src, dst, n % 60, tier, f, no)).alias("fps"), _line(commands.change_speed(src, dst, speed, tier, f, no)).alias("speed"),
        _line(commands.video_to_gif(src, dst, 5 + n % 20, F.when(n % 2 == 0, C("width")))).alias("gif"), _line(tries[0]).alias("first_try"), _line(tries[1]).alias("second_try"),
    )


@_query(f"""WITH {FX} SELECT file_id, '-y -i ' || path || ' -vf fps=' || greatest(file_id % 25, 1) || CASE WHEN file_id % 2 = 0 THEN ',scale=' || width || ':-1:flags=lanczos' ELSE '' END || ' /o/f%05d.png' AS frames,
  '-o /o.gif --fps ' || greatest(file_id % 25, 1) || ' --quality ' || CASE WHEN factor >= 50 THEN 60 ELSE 90 END || CASE WHEN file_id % 2 = 0 THEN ' --width ' || width ELSE '' END || ' /o/f1.png /o/f2.png' AS assemble FROM fx""")
def gif_commands(spark, sf_dir):
    """The two steps from a video to a GIF where the better tool is there."""
    fps, width = (C("file_id") % 25).cast("int"), F.when(C("file_id") % 2 == 0, C("width"))
    frames = F.array(F.lit("/o/f2.png"), F.lit("/o/f1.png"))
    return fixture(spark, sf_dir).select("file_id", _line(commands.gif_frames(C("path"), F.lit("/o/f%05d.png"), fps, width)).alias("frames"), _line(commands.gif_of_frames(F.lit("/o.gif"), fps, width, C("factor") >= 50, frames)).alias("assemble"))


@_query(f"""WITH {FX}, g AS (SELECT *, CAST(factor AS DOUBLE) AS x, ['h264', 'hevc', 'av1', 'vp9'][CAST(file_id % 4 AS INT) + 1] AS codec FROM fx)
SELECT file_id, '-y -i ' || path || ' ' || CASE codec WHEN 'h264' THEN {_CODED} WHEN 'hevc' THEN '-vcodec libx265 -tag:v hvc1 -preset ' || {_PRESET} || ' -crf ' || {_CRF}
    WHEN 'av1' THEN '-vcodec libsvtav1 -crf ' || (24 + {_I("(greatest(x, 5e0) - 5e0) / 95e0 * 26e0")}) || ' -preset 6' ELSE '-vcodec libvpx-vp9 -crf ' || (24 + {_I("(greatest(x, 5e0) - 5e0) / 95e0 * 24e0")}) || ' -b:v 0' END
    || CASE WHEN codec = 'vp9' THEN ' -c:a libopus -b:a 128k -map 0:v -map 0:a?' WHEN file_id % 3 = 0 THEN ' -c:a copy -map 0:v -map 0:a? -movflags +faststart' ELSE ' -c:a aac -b:a 192k -movflags +faststart' END || ' {_TAIL} /o' AS codec,
  '-y -i ' || path || ' -af ' || printf('loudnorm=I=%.1f:TP=-1.5:LRA=11', -10 - file_id % 20 + 0e0) || ' {_TAIL} /o' AS loudness,
  '-dNOPAUSE -dBATCH -dSAFER -dQUIET -sDEVICE=' || CASE WHEN file_id % 3 = 0 THEN 'jpeg' ELSE 'png16m' END || ' -r' || greatest(36, least(600, file_id % 900)) || ' -sOutputFile=/o ' || path AS pages,
  '-q ' || least(90, greatest(20, {_I("75e0 - x * 0.5e0")})) || ' -o /o ' || path AS heic, '-q ' || least(95, greatest(20, {_I("75e0 - x * 0.5e0")})) || ' -e ' || CASE WHEN factor >= 70 THEN 9 WHEN factor >= 50 THEN 8 ELSE 7 END || ' ' || path || ' /o' AS jxl FROM g""")
def convert_commands(spark, sf_dir):
    rows, no = fixture(spark, sf_dir), F.lit(False)
    src, dst, tier, f, n = C("path"), F.lit("/o"), F.lit("custom"), C("factor"), C("file_id")
    codec = F.get(F.array(*map(F.lit, ["h264", "hevc", "av1", "vp9"])), (n % 4).cast("int"))
    either = [_line(commands.convert_video(src, dst, codec, tier, f, no, no, copy)) for copy in (True, False)]
    device = F.when(n % 3 == 0, "JPG").otherwise("png")
    return rows.select(
        "file_id", F.when(n % 3 == 0, either[0]).otherwise(either[1]).alias("codec"), _line(commands.normalize_audio(src, dst, (-10 - n % 20).cast("double"))).alias("loudness"),
        _line(commands.extract_pages(src, dst, device, n % 900)).alias("pages"), _line(commands.convert_heic(src, dst, f)).alias("heic"), _line(commands.convert_jxl(src, dst, f)).alias("jxl"),
    )


@_query(f"""WITH {FX}, t AS (SELECT CASE WHEN kind IN ('video', 'audio') THEN 'ffmpeg' WHEN kind = 'pdf' THEN 'gs' WHEN ext = 'gif' THEN 'gifski' WHEN ext IN ('heic', 'heif') THEN 'heif-enc' WHEN ext = 'jxl' THEN 'cjxl' END AS tool FROM able)
SELECT tool, count(*) AS files, true AS known FROM t WHERE tool IS NOT NULL GROUP BY tool""")
def doctor_report(spark, sf_dir):
    """How many files of the catalogue need each external tool, and that an executor has looked for it on a machine it could name."""
    ext, kind = C("ext"), C("kind")
    tool = F.when(kind.isin("video", "audio"), "ffmpeg").when(kind == "pdf", "gs").when(ext == "gif", "gifski").when(ext.isin("heic", "heif"), "heif-enc").when(ext == "jxl", "cjxl")
    needed = _files(spark, sf_dir).select(tool.alias("tool")).where("tool IS NOT NULL").groupBy("tool").agg(F.count(F.lit(1)).alias("files"))
    looked = external.doctor(spark).select("tool", (C("tool").isin(dims.KNOWN_TOOLS) & C("arch").isin("arm64", "x86_64") & (C("cpus") > 0)).alias("known"))
    return needed.join(F.broadcast(looked), "tool").select("tool", "files", "known")


# Reports in the order of the input, and progress


@_query(f"WITH {FX}, n AS (SELECT file_id, path, error, row_number() OVER (ORDER BY file_id) - 1 AS ord FROM done) SELECT ord, file_id, error IS NULL AS ok FROM n ORDER BY ord")
def ordered_results(spark, sf_dir):
    from .operators.placement import numbered

    rows = numbered(_results(spark, sf_dir).drop("ord"), 0, "file_id").withColumnRenamed("ordinal", "ord")
    return dispatch.in_order(rows.select("ord", "file_id", C("error").isNull().alias("ok")))


@_query(f"WITH {FX} SELECT count(*) AS done, count(*) FILTER (error IS NOT NULL) AS failed FROM done")
def progress_counts(spark, sf_dir):
    """What the observation of a run says when the run has ended."""
    results, seen = report.observed(external.capped(_results(spark, sf_dir), 2))
    results.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["done"], seen.get["failed"])], "done long, failed long")


# Watching

_EVENT = "CASE event_id % 5 WHEN 0 THEN 'create' WHEN 1 THEN 'remove' WHEN 2 THEN 'access' ELSE 'modify' END"


@_query(f"SELECT event_id FROM events WHERE {_EVENT} IN ('create', 'modify') AND event_id % 7 <> 0")
def file_events(spark, sf_dir):
    what = F.when(C("event_id") % 5 == 0, "create").when(C("event_id") % 5 == 1, "remove").when(C("event_id") % 5 == 2, "access").otherwise("modify")
    return watch.file_events(_events(spark, sf_dir).withColumns({"event": what, "is_file": C("event_id") % 7 != 0})).select("event_id")


@_query(f"""WITH {FX}, r AS (SELECT file_id, path, CASE WHEN file_id % 5 <> 0 THEN CASE WHEN file_id % 2 = 0 THEN 200 + file_id ELSE 100 + file_id END WHEN file_id % 3 = 0 THEN 50 END AS t FROM fx)
SELECT path, t AS mtime_s, coalesce(100 + file_id > t, true) AS due FROM r""")
def watch_state(spark, sf_dir):
    """What is known of each file after a batch, of which every fifth failed, and whether its last event is still due."""
    files = fixture(spark, sf_dir).select("file_id", "path")
    at = F.timestamp_seconds(100 + C("file_id"))
    state = files.where("file_id % 3 = 0").select("path", F.timestamp_seconds(F.lit(50)).alias("mtime"))
    output = F.when(C("file_id") % 2 == 0, C("path")).otherwise(F.concat(C("path"), F.lit(".webp")))
    results = files.select("path", at.alias("mtime"), output.alias("output"), F.timestamp_seconds(200 + C("file_id")).alias("output_mtime"), F.when(C("file_id") % 5 == 0, "failed").alias("error"))
    after = watch.recorded(state, results)
    left = watch.due(files.select("path", at.alias("mtime")), after).select("path", F.lit(True).alias("due"))
    known = after.select("path", F.unix_seconds("mtime").alias("mtime_s"))
    return files.join(known, "path", "left").join(left, "path", "left").select("path", "mtime_s", F.coalesce("due", F.lit(False)).alias("due"))


@_query("""WITH t AS (SELECT conv_id, turn, CAST(encode(coalesce(text, '')) AS BLOB) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM conversations),
k AS (SELECT conv_id, turn, CAST(n AS VARCHAR) || '|' || coalesce((SELECT string_agg(substr(hex(b), CAST(i * 514 + 1 AS INT), 2), '' ORDER BY i) FROM range(0, least(64, (n + 256) // 257)) AS r(i)), '') AS key FROM t),
l AS (SELECT *, lag(key) OVER (PARTITION BY conv_id ORDER BY turn, key) AS last FROM k) SELECT conv_id, turn, key FROM l WHERE last IS NULL OR key <> last""")
def clipboard_dedup(spark, sf_dir):
    """Adjacent repeats by a sample of the bytes; texts stand for pictures."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    content = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    turns = turns.select("conv_id", "turn", F.substring_index(watch.sample_key(content, F.lit(1), F.lit(1)), "|", -2).alias("key"))
    return watch.changed(turns, C("key"), "conv_id", ["turn", "key"]).select("conv_id", "turn", "key")


# Pictures


def _drawn(spark, sf_dir, kinds):
    """(ord, path, content): small pictures, pages and other bytes that are drawn from the catalogue."""
    import numpy as np
    import pyarrow as pa

    from .operators import images

    page = b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [3 0 R] /Count 1 >>\nendobj\n3 0 obj\n<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] >>\nendobj\n4 0 obj\n<< /Left (" + b"over " * 200 + b") >>\nendobj\ntrailer\n<< /Root 1 0 R >>\n"

    def draw(batches):
        for batch in batches:
            for i, path, ext in zip(*(c.to_pylist() for c in batch.columns)):
                y, x = np.mgrid[0 : 16 + (i * 7) % 50, 0 : 16 + i % 40]
                picture = np.stack([x % 4 * 60, y % 4 * 60, (x + y) % 4 * 60], 2).astype(np.uint8)
                data = images.encode(picture) if ext == "png" else images.encode_bmp(picture) if ext == "bmp" else page if ext == "pdf" else b"x" * 40
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([path]), pa.array([data], pa.binary())], ["ord", "path", "content"])

    return _spread(_files(spark, sf_dir).where(kinds).select("file_id", "path", "ext")).mapInArrow(draw, "ord long, path string, content binary")


@_query(f"""WITH {FX} SELECT file_id AS ord, kind, ext IN ('png', 'bmp', 'pdf') AS done, ext IN ('png', 'bmp', 'pdf') AS never_larger,
  CASE WHEN NOT optimisable THEN 'unsupported file: ' || path WHEN ext NOT IN ('png', 'bmp', 'pdf') THEN path || ': ' || ext || ' needs an external encoder' END AS error FROM able""")
def dispatch_results(spark, sf_dir):
    results = dispatch.optimise_files(_drawn(spark, sf_dir, F.lit(True)))
    return dispatch.in_order(results).select("ord", "kind", C("error").isNull().alias("done"), F.coalesce(C("new_size") <= C("old_size"), F.lit(False)).alias("never_larger"), "error")


def _measured(files):
    """(ord, format, fits, never_larger, exact) of pictures after the search by format and by budget."""
    import pyarrow as pa

    from .operators import images

    def measure(batches):
        for batch in batches:
            for i, data in zip(*(batch.column(c).to_pylist() for c in ("ord", "content"))):
                form, best = images.adapted(data)
                small = images.within(data, 10**9)
                tries = [len(images.optimised(data, f)) for f in dims.BUDGET_FACTORS]
                tight = images.within(data, 1)
                exact = bool((images.pixels(best) == images.pixels(data)).all())
                yield pa.RecordBatch.from_pydict({"ord": pa.array([i], pa.int64()), "format": [form], "first_fits": [len(small) == tries[0]], "least_else": [len(tight) == min(tries)], "never_larger": [len(best) <= len(data)], "exact": [exact]})

    return files.mapInArrow(measure, "ord long, format string, first_fits boolean, least_else boolean, never_larger boolean, exact boolean")


@_query(f"WITH {FX} SELECT file_id AS ord, 'png' AS format, true AS first_fits, true AS least_else, true AS never_larger, true AS exact FROM able WHERE ext IN ('png', 'bmp')")
def encoded_choice(spark, sf_dir):
    """Searches over real encodings: pictures of few colours stay as they are, a BMP becomes a PNG, a budget takes the
    first factor that fits or else the smallest."""
    return _measured(_drawn(spark, sf_dir, "ext IN ('png', 'bmp')"))


@_query(f"""WITH {FX}, p AS (SELECT file_id, CAST(16 + file_id % 40 AS INT) AS w, CAST(16 + (file_id * 7) % 50 AS INT) AS h, (file_id % 11) / 11e0 AS x, (file_id % 7) / 9e0 AS y FROM able WHERE ext = 'png'),
q AS (SELECT *, greatest(0.01e0, least(1 - x, 0.4e0)) AS rw, greatest(0.01e0, least(1 - y, 0.5e0)) AS rh FROM p)
SELECT file_id AS ord, least(greatest({_I("rw * w")}, 1), w - {_I("x * w")}) AS width, least(greatest({_I("rh * h")}, 1), h - {_I("y * h")}) AS height, true AS same_corner FROM q""")
def picture_rectangles(spark, sf_dir):
    """Rectangles cut out of pictures: their sizes, and that the first pixel is the one that the plan names."""
    import pyarrow as pa

    from .operators import images

    def cut(batches):
        for batch in batches:
            for i, data in zip(*(batch.column(c).to_pylist() for c in ("ord", "content"))):
                image, x, y = images.decode(data), i % 11 / 11, i % 7 / 9
                part = images.decode(images.encode(images.rectangle(image, x, y, 0.4, 0.5)))
                corner = image[int(y * image.shape[0] + 0.5), int(x * image.shape[1] + 0.5)]
                yield pa.RecordBatch.from_pydict({"ord": pa.array([i], pa.int64()), "width": pa.array([part.shape[1]], pa.int32()), "height": pa.array([part.shape[0]], pa.int32()), "same_corner": [bool((part[0, 0] == corner).all())]})

    return _drawn(spark, sf_dir, "ext = 'png'").mapInArrow(cut, "ord long, width int, height int, same_corner boolean")


@_query(f"WITH {FX} SELECT file_id AS ord, 3 AS objects, true AS boxed FROM able WHERE ext = 'pdf'")
def pdf_objects(spark, sf_dir):
    """What is left of a file whose fourth object nothing leads to, and that its page takes its own box."""
    from .operators import pdf

    files = _drawn(spark, sf_dir, "ext = 'pdf'")
    done = pdf.edited(files.select(C("ord").cast("string").alias("path"), "content"), pdf.recompressed)
    boxes = pdf.pages(done.select("path", "content")).select("path", (C("box") == F.array(*map(F.lit, [0.0, 0.0, 612.0, 792.0]))).alias("boxed"))
    counted = F.regexp_count(F.decode("content", "ISO-8859-1"), F.lit(r"\d+ \d+ obj")).alias("objects")
    return done.select("path", counted).join(boxes, "path").select(C("path").cast("long").alias("ord"), "objects", "boxed")
