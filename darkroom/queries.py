"""Queries over the derived catalogue, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dial, dims, geometry, paths, text
from .operators import placement, report, selection
from .plans import dsl
from .sources.catalog import FIXTURE_EXTENSIONS, collect, described, fixture
from .streaming import watch

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _sql_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


C = F.col
FX = f"""docs AS (SELECT *, list_extract([{_sql_list(FIXTURE_EXTENSIONS)}], CAST(doc_id % 36 AS INT) + 1) AS e FROM documents),
fx AS (SELECT doc_id AS file_id,
  '/vault/' || source || '/' || CASE WHEN doc_id % 17 = 0 THEN '.' ELSE '' END || 'doc' || doc_id || CASE WHEN e = '' THEN '' ELSE '.' || e END AS path,
  n_chars AS length, CAST(16 + (doc_id * 37) % 4000 AS INT) AS width, CAST(16 + (doc_id * 91) % 3000 AS INT) AS height,
  lower(e) = 'png' AND (doc_id // 36) % 2 = 0 AS has_alpha, CAST(doc_id % 101 AS INT) AS factor FROM docs),
named AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS name FROM fx),
ext AS (SELECT *, lower(regexp_extract(name, '^.+\\.([^.]*)$', 1)) AS ext, regexp_replace(name, '^(.+)\\.[^.]*$', '\\1') AS stem FROM named),
files AS (SELECT *, CASE {" ".join(f"WHEN ext IN ({_sql_list(v)}) THEN '{k}'" for k, v in dims.KIND_EXTENSIONS.items())} END AS kind FROM ext),
able AS (SELECT *, coalesce(kind <> 'image' OR ext IN ({_sql_list(dims.OPTIMISABLE_IMAGES)}), false) AS optimisable FROM files),
done AS (SELECT *, CASE WHEN NOT optimisable THEN NULL WHEN least(length, length // 2 + 1) = 0 OR least(length, length // 2 + 1) >= length THEN length ELSE least(length, length // 2 + 1) END AS new_size,
  CASE WHEN NOT optimisable THEN 'unsupported file: ' || path END AS error FROM able)"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(fixture(spark, sf_dir))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.with_optimised(_files(spark, sf_dir))


# Catalogue


@_query(f"WITH {FX} SELECT file_id, path, name, stem, ext, kind, optimisable FROM able")
def classify_files(spark, sf_dir):
    return _files(spark, sf_dir).select("file_id", "path", paths.file_name(C("path")).alias("name"), paths.stem(C("path")).alias("stem"), "ext", "kind", "optimisable")


@_query(f"WITH {FX} SELECT DISTINCT path, kind FROM able WHERE kind IN ('image', 'video')")
def collect_files(spark, sf_dir):
    files = fixture(spark, sf_dir)
    return collect(files.union(files.where("file_id % 3 = 0")), ["image", "video"]).select("path", "kind")


@_query(f"WITH {FX} SELECT kind, count(*) AS n, CAST(sum(length) AS BIGINT) AS bytes FROM able WHERE kind IS NOT NULL GROUP BY kind")
def kind_counts(spark, sf_dir):
    return _files(spark, sf_dir).where("kind IS NOT NULL").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"))


@_query(f"WITH {FX} SELECT file_id, ext FROM able WHERE kind = 'image' AND optimisable")
def optimisable_images(spark, sf_dir):
    return _files(spark, sf_dir).where("kind = 'image' AND optimisable").select("file_id", "ext")


@_query("""SELECT page_id, lower(regexp_extract(regexp_extract(url, '([^/]*)/*$', 1), '^.+\\.([^.]*)$', 1)) AS ext FROM pages""")
def url_extensions(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", paths.extension(C("url")).alias("ext"))


# The dial, over the factors 0 to 100


def _factors(spark, sf_dir) -> DataFrame:
    """(file_id, factor) of every file of the catalogue; factors run over 0 .. 100."""
    return fixture(spark, sf_dir).select("file_id", "factor")


def _chosen(spark, sf_dir, name: str, values: list, by: int = 1) -> DataFrame:
    """(file_id, ``name``): a value of the list for each document, by its id divided by ``by``."""
    ids = spark.read.parquet(f"{sf_dir}/documents.parquet").select(C("doc_id").cast("long").alias("file_id"))
    return ids.withColumn(name, _pick(values, by))


def _pick(values: list, by: int = 1) -> F.Column:
    return F.get(F.array(*map(F.lit, values)), (F.floor(C("file_id") / by) % len(values)).cast("int"))


def _pick_sql(values: list, by: int = 1) -> str:
    return f"list_extract([{', '.join(_value(v) for v in values)}], CAST(file_id // {by} % {len(values)} AS INT) + 1)"


def _value(v) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"{v}e0" if isinstance(v, float) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


IDS = "ids AS (SELECT doc_id AS file_id FROM documents)"
GRID = "f AS (SELECT doc_id AS file_id, CAST(doc_id % 101 AS INT) AS factor, CAST(doc_id % 101 AS DOUBLE) AS x FROM documents)"


def _fall(at, slope, low, high):
    return f"least({high}, greatest({low}, CAST(round({at}e0 - (x - 30e0) * ({slope})) AS INT)))"


_SPAN = "(greatest(x, 5e0) - 5e0) / 95e0"
_CRF = f"least(32, greatest(17, 18 + CAST(round({_SPAN} * 12e0) AS INT)))"
_PRESET = "CASE WHEN factor < 20 THEN 'veryfast' WHEN factor < 40 THEN 'fast' WHEN factor < 60 THEN 'medium' WHEN factor < 85 THEN 'slow' ELSE 'slower' END"
_PNG = _fall(100, "75e0 / 70e0", 25, 100)


@_query(f"""WITH {GRID} SELECT file_id, factor, factor >= 50 AS aggressive, {_fall(85, "55e0 / 70e0", 25, 95)} AS jpeg, {_fall(90, "60e0 / 70e0", 25, 97)} AS jpeg_secondary,
  '0-' || {_PNG} AS png, greatest({_PNG} - 30, 0) AS png_min, CASE WHEN factor < 40 THEN 4 WHEN factor < 60 THEN 3 WHEN factor < 85 THEN 2 ELSE 1 END AS png_speed,
  '-O' || CASE WHEN factor >= 50 THEN 3 WHEN factor >= 20 THEN 2 ELSE 1 END || ' --lossy=' || least(200, greatest(0, CAST(round(30e0 + (x - 30e0) * (50e0 / 34e0)) AS INT)))
    || CASE WHEN factor >= 50 THEN ' --colors=' || least(256, greatest(32, CAST(round(256e0 - (x - 50e0) * (192e0 / 50e0)) AS INT))) ELSE '' END AS gif,
  least(90, greatest(20, CAST(round(75e0 - x * 0.5e0) AS INT))) AS conversion, least(95, greatest(20, CAST(round(75e0 - x * 0.5e0) AS INT))) AS jxl,
  CASE WHEN factor >= 70 THEN 9 WHEN factor >= 50 THEN 8 ELSE 7 END AS jxl_effort FROM f""")
def dial_image(spark, sf_dir):
    f = dial.clamped_factor(C("factor"))
    return _factors(spark, sf_dir).select(
        "file_id", "factor", dial.is_aggressive(F.lit("custom"), f).alias("aggressive"), dial.jpeg_quality(f).alias("jpeg"), dial.jpeg_secondary_quality(f).alias("jpeg_secondary"), dial.png_quality(f).alias("png"),
        dial.png_min(f).alias("png_min"), dial.png_speed(f).alias("png_speed"), F.array_join(dial.gif_args(f), " ").alias("gif"), dial.conversion_quality(f).alias("conversion"), dial.jxl_quality(f).alias("jxl"), dial.jxl_effort(f).alias("jxl_effort"),
    )


@_query(f"""WITH {GRID} SELECT file_id, factor, {_CRF} AS crf, factor <= 0 AS auto, {_PRESET} AS preset, least(75, greatest(25, CAST(round(70e0 - {_SPAN} * 45e0) AS INT))) AS hardware,
  24 + CAST(round({_SPAN} * 26e0) AS INT) AS av1, 24 + CAST(round({_SPAN} * 24e0) AS INT) AS vp9 FROM f""")
def dial_video(spark, sf_dir):
    f = C("factor")
    return _factors(spark, sf_dir).select("file_id", "factor", dial.h264_crf(f).alias("crf"), dial.uses_auto_crf(f).alias("auto"), dial.x264_preset(f).alias("preset"), dial.hardware_quality(f).alias("hardware"), dial.av1_crf(f).alias("av1"), dial.vp9_crf(f).alias("vp9"))


_AUDIO = ", ".join(f"('{k}', '{dims.AUDIO_CODEC[k]}', {dims.AUDIO_DEFAULT_KBPS[k]}, {dims.AUDIO_RANGE_KBPS.get(k, ('NULL', 'NULL'))[0]}, {dims.AUDIO_RANGE_KBPS.get(k, ('NULL', 'NULL'))[1]})" for k in dims.AUDIO_CODEC)


def _audio_sql(extra: str) -> str:
    return f"""WITH {GRID}, a(audio, codec, def, lo, hi) AS (VALUES {_AUDIO}),
g AS (SELECT *, {_pick_sql(list(dims.AUDIO_CODEC))} AS audio FROM f),
k AS (SELECT *, CAST(CASE WHEN lo IS NOT NULL THEN least(hi, greatest(lo, greatest(8, CAST(round((hi - (least(100e0, greatest(5e0, x)) - 5e0) / 95e0 * (hi - lo)) / 16e0) AS INT) * 16))) END AS INT) AS kbps FROM g JOIN a USING (audio)),
e AS (SELECT *, coalesce(kbps, greatest(def, 0)) AS rate FROM k) {extra}"""


def _audio_grid(spark, sf_dir) -> DataFrame:
    grid = _factors(spark, sf_dir).withColumn("audio", _pick(list(dims.AUDIO_CODEC)))
    return grid.withColumns({"kbps": dial.audio_kbps(C("audio"), C("factor")), "effective": dial.effective_kbps(F.lit(None).cast("int"), C("audio"), C("factor"))})


@_query(_audio_sql("SELECT file_id, factor, audio, kbps, rate AS effective, CASE WHEN rate <= 64 THEN 9 WHEN rate <= 80 THEN 8 WHEN rate <= 96 THEN 7 WHEN rate <= 128 THEN 5 WHEN rate <= 160 THEN 4 WHEN rate <= 192 THEN 2 ELSE 0 END AS lame FROM e"))
def dial_audio(spark, sf_dir):
    return _audio_grid(spark, sf_dir).select("file_id", "factor", "audio", "kbps", "effective", dial.lame_quality(C("effective")).alias("lame"))


@_query(_audio_sql("""SELECT file_id, factor, audio, CASE audio WHEN 'aac' THEN '-c:a ' || codec || ' -b:a ' || rate || 'k -aac_at_mode cvbr'
  WHEN 'mp3' THEN '-c:a ' || codec || ' -q:a ' || CASE WHEN rate <= 64 THEN 9 WHEN rate <= 80 THEN 8 WHEN rate <= 96 THEN 7 WHEN rate <= 128 THEN 5 WHEN rate <= 160 THEN 4 WHEN rate <= 192 THEN 2 ELSE 0 END
  WHEN 'opus' THEN '-c:a ' || codec || ' -b:a ' || rate || 'k -vbr on' WHEN 'flac' THEN '-c:a ' || codec || ' -compression_level ' || CASE WHEN factor >= 50 THEN '12' ELSE '8' END
  WHEN 'wav' THEN CASE WHEN factor >= 50 THEN '-c:a adpcm_ima_wav' WHEN factor % 2 = 0 THEN '-c:a ' || codec || ' -ar 48000' ELSE '-c:a ' || codec END
  WHEN 'aiff' THEN '-c:a ' || codec || CASE WHEN factor % 2 = 0 THEN ' -ar 48000' ELSE '' END ELSE '-c:a ' || codec END AS args FROM e"""))
def audio_args(spark, sf_dir):
    rate = F.when(C("factor") % 2 == 0, 96000.0).otherwise(44100.0)
    return _audio_grid(spark, sf_dir).select("file_id", "factor", "audio", F.array_join(dial.audio_args(C("audio"), C("effective"), C("factor") >= 50, rate), " ").alias("args"))


_H264 = f"""CASE WHEN tier = 'lossless' THEN '-vcodec h264 -tag:v avc1 -crf 17'
  WHEN tier = 'fast' AND arm THEN '-vcodec h264_videotoolbox -q:v ' || least(75, greatest(25, CAST(round(70e0 - {_SPAN} * 45e0) AS INT))) || ' -tag:v avc1'
  ELSE '-vcodec h264 -tag:v avc1 -preset ' || CASE WHEN tier = 'fast' THEN 'veryfast' WHEN factor <= 0 THEN 'slower' ELSE {_PRESET} END || CASE WHEN factor <= 0 THEN '' ELSE ' -crf ' || {_CRF} END END"""


_TIERS, _CODECS = ["lossless", "adaptive", "fast", "smaller", "custom"], list(dims.VIDEO_CONTAINERS)


@_query(f"""WITH {GRID}, g AS (SELECT *, {_pick_sql(_TIERS)} AS tier, {_pick_sql([True, False], 5)} AS arm, {_pick_sql(_CODECS, 10)} AS codec FROM f) SELECT file_id, factor, tier, arm, codec, CASE codec WHEN 'h264' THEN {_H264}
  WHEN 'hevc' THEN CASE WHEN arm THEN '-vcodec hevc_videotoolbox -tag:v hvc1' ELSE '-vcodec libx265 -tag:v hvc1 -preset ' || {_PRESET} || ' -crf ' || {_CRF} END
  WHEN 'av1' THEN '-vcodec libsvtav1 -crf ' || (24 + CAST(round({_SPAN} * 26e0) AS INT)) || ' -preset 6' ELSE '-vcodec libvpx-vp9 -crf ' || (24 + CAST(round({_SPAN} * 24e0) AS INT)) || ' -b:v 0' END AS args
  FROM g""")
def video_args(spark, sf_dir):
    grid = _factors(spark, sf_dir).withColumns({"tier": _pick(_TIERS), "arm": _pick([True, False], 5), "codec": _pick(_CODECS, 10)})
    return grid.withColumn("args", F.array_join(dial.video_args(C("codec"), C("tier"), C("factor"), C("arm"), F.lit(True)), " "))


_TARGETS = ["WebP", "avif", "HEIC", "heif", "jxl", "png", "JPG", "mp4", "x265", "av1", "webm", "vp9", "m4a", "ogg", "flac", "aif", "gif", "doc"]


@_query(f"""WITH {IDS} SELECT file_id, name, {" , ".join(f"CASE {' '.join(f"WHEN lower(name) = '{k}' THEN '{v}'" for k, v in t.items())} END AS {n}" for n, t in (("image", dims.IMAGE_TARGETS), ("video", dims.VIDEO_TARGETS), ("audio", dims.AUDIO_TARGETS)))},
  CASE WHEN lower(name) = 'gif' THEN 'gif' WHEN lower(name) IN ({_sql_list(dims.VIDEO_TARGETS)}) THEN 'video' WHEN lower(name) IN ({_sql_list(dims.IMAGE_TARGETS)}) THEN 'image' WHEN lower(name) IN ({_sql_list(dims.AUDIO_TARGETS)}) THEN 'audio' END AS family
  FROM (SELECT file_id, {_pick_sql(_TARGETS)} AS name FROM ids)""")
def convert_targets(spark, sf_dir):
    return _chosen(spark, sf_dir, "name", _TARGETS).select("file_id", "name", dial.image_target(C("name")).alias("image"), dial.video_target(C("name")).alias("video"), dial.audio_target(C("name")).alias("audio"), dial.convert_family(C("name"), F.lit(True)).alias("family"))


_PLACES = ["topLeft", "top-right", "BOTTOM_LEFT", "centre", "center", "elsewhere", ""]


_MARKS = [-0.5, 0.005, 0.15, 1.5]


@_query(f"""WITH {IDS} SELECT file_id, position, CASE replace(replace(lower(position), '-', ''), '_', '') WHEN 'topleft' THEN '10:10' WHEN 'topright' THEN 'W-w-10:10' WHEN 'bottomleft' THEN '10:H-h-10'
  WHEN 'center' THEN '(W-w)/2:(H-h)/2' WHEN 'centre' THEN '(W-w)/2:(H-h)/2' ELSE 'W-w-10:H-h-10' END AS xy, least(1e0, greatest(0e0, v)) AS opacity, least(1e0, greatest(0.01e0, v)) AS scale
  FROM (SELECT file_id, {_pick_sql(_PLACES)} AS position, {_pick_sql(_MARKS, 7)} AS v FROM ids)""")
def watermark_params(spark, sf_dir):
    rows = _chosen(spark, sf_dir, "position", _PLACES).withColumn("v", _pick(_MARKS, 7))
    return rows.select("file_id", "position", dial.watermark_xy(C("position")).alias("xy"), dial.watermark_opacity(C("v")).alias("opacity"), dial.watermark_scale(C("v")).alias("scale"))


# Geometry


def _even(x):
    return f"CASE WHEN ({x}) % 2 = 0 THEN ({x}) ELSE greatest(({x}) - 1, 2) END"


_I = "CAST(round({}) AS INT)".format


@_query(f"""WITH {FX}, p AS (SELECT *, CAST(200 + file_id % 1800 AS INT) AS n, file_id % 5 AS m FROM fx) SELECT file_id,
  CASE m WHEN 0 THEN 'resize' WHEN 1 THEN 'crop' WHEN 2 THEN 'cover' ELSE 'resize' END AS mode,
  CAST(CASE m WHEN 0 THEN CASE WHEN width >= height THEN n ELSE {_even(_I("n * 1e0 * width / height"))} END
    WHEN 1 THEN greatest(2, least(width, CASE WHEN width * 1e0 / height > 16e0 / 9e0 THEN {_I("height * (16e0 / 9e0)")} ELSE width END))
    WHEN 2 THEN n WHEN 3 THEN n ELSE {_even(_I("n * 1e0 * width / height"))} END AS INT) AS w,
  CAST(CASE m WHEN 0 THEN CASE WHEN width >= height THEN {_even(_I("n * 1e0 * height / width"))} ELSE n END
    WHEN 1 THEN greatest(2, least(height, CASE WHEN width * 1e0 / height > 16e0 / 9e0 THEN height ELSE {_I("width / (16e0 / 9e0)")} END))
    WHEN 2 THEN n // 2 + 1 WHEN 3 THEN {_even(_I("n * 1e0 * height / width"))} ELSE n END AS INT) AS h FROM p""")
def crop_plans(spark, sf_dir):
    n, m = (200 + C("file_id") % 1800).cast("int"), C("file_id") % 5
    plan = geometry.crop_plan(C("width"), C("height"), F.when(m.isin(2, 3), n), F.when(m == 2, F.floor(n / 2).cast("int") + 1).when(m == 4, n), F.when(m == 0, n), F.when(m == 1, 16), F.when(m == 1, 9))
    return fixture(spark, sf_dir).select("file_id", plan.alias("p")).select("file_id", "p.mode", "p.w", "p.h")


@_query(f"""WITH {FX}, p AS (SELECT file_id, width, height, CAST(300 + file_id % 700 AS INT) AS w, CAST(200 + file_id % 500 AS INT) AS h FROM fx),
s AS (SELECT *, greatest(w * 1e0 / width, h * 1e0 / height) AS k FROM p), t AS (SELECT *, greatest(CAST(ceil(width * k) AS INT), w) AS sw, greatest(CAST(ceil(height * k) AS INT), h) AS sh FROM s)
SELECT file_id, sw, sh, (sw - w) // 2 AS x, (sh - h) // 2 AS y FROM t""")
def cover_offsets(spark, sf_dir):
    w, h = (300 + C("file_id") % 700).cast("int"), (200 + C("file_id") % 500).cast("int")
    return fixture(spark, sf_dir).select("file_id", geometry.cover_plan(C("width"), C("height"), w, h).alias("p")).select("file_id", "p.*")


@_query(f"""WITH {FX}, p AS (SELECT file_id, width, height, (file_id % 120 - 10) / 100e0 AS x0, (file_id % 97) / 100e0 AS y0, (file_id % 53) / 50e0 AS w0, (file_id % 71) / 60e0 AS h0 FROM fx),
c AS (SELECT *, greatest(0e0, least(1e0, x0)) AS x, greatest(0e0, least(1e0, y0)) AS y FROM p), d AS (SELECT *, greatest(0.01e0, least(1e0 - x, w0)) AS w, greatest(0.01e0, least(1e0 - y, h0)) AS h FROM c),
r AS (SELECT *, {_I("x * width")} AS px, {_I("y * height")} AS py FROM d)
SELECT file_id, CASE WHEN x <= 0.99e0 AND y <= 0.99e0 THEN px END AS px, CASE WHEN x <= 0.99e0 AND y <= 0.99e0 THEN py END AS py,
  CASE WHEN x <= 0.99e0 AND y <= 0.99e0 THEN least(greatest({_I("w * width")}, 1), width - px) END AS pw, CASE WHEN x <= 0.99e0 AND y <= 0.99e0 THEN least(greatest({_I("h * height")}, 1), height - py) END AS ph FROM r""")
def crop_rect_px(spark, sf_dir):
    i = C("file_id")
    rect = geometry.rect_pixels(C("width"), C("height"), (i % 120 - 10) / F.lit(100.0), (i % 97) / F.lit(100.0), (i % 53) / F.lit(50.0), (i % 71) / F.lit(60.0))
    return fixture(spark, sf_dir).select("file_id", rect.alias("r")).select("file_id", C("r.x").alias("px"), C("r.y").alias("py"), C("r.w").alias("pw"), C("r.h").alias("ph"))


@_query(f"WITH {FX} SELECT file_id, greatest(1, {_I('width * least(1e0, greatest(0.05e0, factor / 80e0))')}) AS w, greatest(1, {_I('height * least(1e0, greatest(0.05e0, factor / 80e0))')}) AS h FROM fx")
def scale_dims(spark, sf_dir):
    f = C("factor") / F.lit(80.0)
    return fixture(spark, sf_dir).select("file_id", geometry.scaled(C("width"), f).alias("w"), geometry.scaled(C("height"), f).alias("h"))


@_query(f"""WITH {FX}, p AS (SELECT file_id, width * 1e0 AS w, height * 1e0 AS h, (1 + file_id % 7) / (1e0 + file_id % 5) AS r FROM fx)
SELECT file_id, CASE WHEN w / h > r THEN (w - h * r) / 2e0 ELSE 0e0 END AS x0, CASE WHEN w / h > r THEN 0e0 ELSE (h - w / r) / 2e0 END AS y0,
  CASE WHEN w / h > r THEN (w - h * r) / 2e0 + h * r ELSE w END AS x1, CASE WHEN w / h > r THEN h ELSE (h - w / r) / 2e0 + w / r END AS y1 FROM p""")
def pdf_crop_box(spark, sf_dir):
    box = geometry.pdf_crop_box(F.array(F.lit(0.0), F.lit(0.0), C("width").cast("double"), C("height").cast("double")), (1 + C("file_id") % 7) / (F.lit(1.0) + C("file_id") % 5))
    return fixture(spark, sf_dir).select("file_id", box.alias("b")).select("file_id", *[F.get("b", F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


@_query(f"""WITH {FX} SELECT file_id, CASE file_id % 5 WHEN 0 THEN 'scale=''if(gt(iw,ih),' || width || ',-2)'':''if(gt(iw,ih),-2,' || width || ')'''
  WHEN 1 THEN 'crop=''min(iw,ih*16/9)'':''min(ih,iw*9/16)''' WHEN 2 THEN 'scale=' || width || ':' || height || ':force_original_aspect_ratio=increase,crop=' || width || ':' || height
  WHEN 3 THEN 'scale=' || width || ':-2' ELSE 'scale=-2:' || height END AS crop, greatest(factor - 50, 1) AS fps, least(600, greatest(36, width)) AS dpi FROM fx""")
def video_filters(spark, sf_dir):
    m = C("file_id") % 5
    crop = geometry.video_crop_filter(F.when(m.isin(2, 3), C("width")), F.when(m.isin(2, 4), C("height")), F.when(m == 0, C("width")), F.when(m == 1, 16), F.when(m == 1, 9))
    return fixture(spark, sf_dir).select("file_id", crop.alias("crop"), geometry.capped_fps(C("factor") - 50).alias("fps"), geometry.page_dpi(C("width")).alias("dpi"))


@_query("""SELECT file_id, CAST(range AS INT) AS n, 'scale=trunc(iw*' || printf('%.4f', least(1e0, range / 64e0)) || '/2)*2:trunc(ih*' || printf('%.4f', least(1e0, range / 64e0)) || '/2)*2' AS scale FROM (SELECT doc_id AS file_id, 4 + doc_id % 76 AS range FROM documents)""")
def video_scale_filters(spark, sf_dir):
    n = 4 + C("file_id") % 76
    return fixture(spark, sf_dir).select("file_id", n.cast("int").alias("n"), geometry.video_scale_filter(n / F.lit(64.0)).alias("scale"))


# Strings

# Texts that are read: those of a list, and for most documents one with a number of its own.
_SIZES = ["500000", "500kb", "1.5mb", " 2 MB ", "10b", "-3kb", "x", "", "1e3", "kb", "0.4"]
_UNITS = ["kb", " MB", ".5b", "", " gb"]


@_query(f"""WITH {IDS}, s AS (SELECT file_id, CASE WHEN file_id % 3 = 0 THEN {_pick_sql(_SIZES, 3)} ELSE file_id || {_pick_sql(_UNITS)} END AS size FROM ids), t AS (SELECT file_id, size, lower(trim(size)) AS l FROM s),
u AS (SELECT file_id, size, regexp_extract(l, '(mb|kb|b)$', 1) AS unit, TRY_CAST(trim(regexp_replace(l, '(mb|kb|b)$', '')) AS DOUBLE) AS v FROM t)
SELECT file_id, size, CASE WHEN v IS NOT NULL THEN greatest(0, CAST(trunc(v * CASE unit WHEN 'mb' THEN 1e6 WHEN 'kb' THEN 1e3 ELSE 1e0 END) AS BIGINT)) END AS bytes FROM u""")
def parse_sizes(spark, sf_dir):
    own = F.concat(C("file_id").cast("string"), _pick(_UNITS))
    sizes = _chosen(spark, sf_dir, "size", _SIZES, 3).withColumn("size", F.when(C("file_id") % 3 == 0, C("size")).otherwise(own))
    return sizes.select("file_id", "size", text.parse_size(C("size")).alias("bytes"))


@_query(f"""WITH {FX}, s AS (SELECT file_id, length * (1 + file_id % 900000) AS size FROM fx),
u AS (SELECT *, CASE WHEN size >= 1024 ** 4 THEN 4 WHEN size >= 1024 ** 3 THEN 3 WHEN size >= 1024 ** 2 THEN 2 WHEN size >= 1024 THEN 1 ELSE 0 END AS p FROM s)
SELECT file_id, size, CASE WHEN p = 0 THEN size || ' B' ELSE printf('%.1f', round_even(size / (1024e0 ** p), 1)) || ' ' || list_extract(['KB', 'MB', 'GB', 'TB'], p) END AS human FROM u""")
def human_sizes(spark, sf_dir):
    size = C("length") * (1 + C("file_id") % 900000)
    return fixture(spark, sf_dir).select("file_id", size.alias("size")).withColumn("human", text.human_size(C("size")))


_VERSIONS = ["0.4.0", "0.5.0", "1.0.0", "0.9.9", "0.4.1", "v0.5.0", "v0.4.0", "0.4.0-rc1", "0.3.9", "2", "1.x.3", "1.2.3+build.4"]


def _v(c):
    parts = f"string_split(regexp_extract(regexp_replace({c}, '^v', ''), '^([^+-]*)', 1), '.')"
    return [f"coalesce(TRY_CAST(list_extract({parts}, {i}) AS BIGINT), 0)" for i in (1, 2, 3)]


@_query(f"""WITH {IDS}, v AS (SELECT file_id, CASE WHEN file_id % 2 = 0 THEN {_pick_sql(_VERSIONS, 2)} ELSE '0.' || file_id % 7 || '.' || file_id % 5 END AS a, {_pick_sql(_VERSIONS, 24)} AS b FROM ids)
SELECT file_id, a AS candidate, b AS current, ({", ".join(_v("a"))}) > ({", ".join(_v("b"))}) AS newer FROM v""")
def semver_compare(spark, sf_dir):
    own = F.concat(F.lit("0."), (C("file_id") % 7).cast("string"), F.lit("."), (C("file_id") % 5).cast("string"))
    rows = _chosen(spark, sf_dir, "candidate", _VERSIONS, 2).withColumn("candidate", F.when(C("file_id") % 2 == 0, C("candidate")).otherwise(own))
    return rows.withColumn("current", _pick(_VERSIONS, 24)).withColumn("newer", text.is_newer(C("candidate"), C("current")))


@_query(f"""WITH {FX}, n AS (SELECT *, row_number() OVER (ORDER BY path) AS rn FROM ext)
SELECT file_id, '/home/u/out/' || stem || '-' || (2 * rn - 1) || '_' || (2 * rn) || '-2024-03-07_09.05.06 100% %z' || CASE WHEN ext = '' THEN '.' ELSE '.' || regexp_extract(name, '^.+\\.([^.]*)$', 1) END || regexp_extract(path, '^(.*)/[^/]+$', 1) || '%' AS output FROM n""")
def template_expand(spark, sf_dir):
    now = F.lit("2024-03-07 09:05:06").cast("timestamp")
    return placement.resolved_output(fixture(spark, sf_dir), "~/out/%f-%i_%i-%y-%m-%d_%H.%M.%S 100%% %z.%e%P%", False, now, home="/home/u").select("file_id", "output")


@_query(f"""WITH {FX} SELECT file_id, regexp_extract(path, '^(.*/)[^/]+$', 1) || '.' || name || '.orig' AS backup,
  CASE WHEN regexp_full_match(name, '\\..+\\.orig') THEN regexp_extract(path, '^(.*/)[^/]+$', 1) || regexp_extract(name, '^\\.(.+)\\.orig$', 1) END AS original FROM ext""")
def backup_names(spark, sf_dir):
    return fixture(spark, sf_dir).select("file_id", paths.backup_name(C("path")).alias("backup"), paths.original_of_backup(C("path")).alias("original"))


_CROPS = ["1200x630", "1200x0", "0x720", "16:9", "1920", " 4 : 3 ", "0:9", "abc", "12x", "", "0x0"]


_SEPARATORS = ["x", ":", " : "]


@_query(f"""WITH {IDS}, s AS (SELECT file_id, CASE WHEN file_id % 2 = 0 THEN {_pick_sql(_CROPS, 2)} ELSE file_id % 3000 || {_pick_sql(_SEPARATORS)} || file_id % 700 END AS size FROM ids), t AS (SELECT file_id, size, trim(size) AS b FROM s),
p AS (SELECT *, regexp_extract(b, '^(\\d+)\\s*([:x])\\s*(\\d+)$', 2) AS sep, TRY_CAST(regexp_extract(b, '^(\\d+)\\s*[:x]\\s*(\\d+)$', 1) AS INT) AS a, TRY_CAST(regexp_extract(b, '^(\\d+)\\s*[:x]\\s*(\\d+)$', 2) AS INT) AS c, TRY_CAST(regexp_extract(b, '^(\\d+)$', 1) AS INT) AS n FROM t)
SELECT file_id, size, CASE WHEN sep = 'x' THEN nullif(a, 0) ELSE n END AS width, CASE WHEN sep = 'x' THEN nullif(c, 0) ELSE n END AS height, CASE WHEN sep = ':' AND a > 0 AND c > 0 THEN a END AS aw, CASE WHEN sep = ':' AND a > 0 AND c > 0 THEN c END AS ah FROM p""")
def parse_crop_sizes(spark, sf_dir):
    own = F.concat((C("file_id") % 3000).cast("string"), _pick(_SEPARATORS), (C("file_id") % 700).cast("string"))
    rows = _chosen(spark, sf_dir, "size", _CROPS, 2).withColumn("size", F.when(C("file_id") % 2 == 0, C("size")).otherwise(own)).withColumn("p", text.parse_crop_size(C("size")))
    return rows.select("file_id", "size", "p.width", "p.height", "p.aw", "p.ah")


_FACTORS = ["50%", "0.5", " 12.5 %", "x%", "1", "abc"]


@_query(f"""WITH {IDS} SELECT file_id, factor, CASE WHEN ends_with(factor, '%') THEN TRY_CAST(trim(regexp_replace(factor, '%$', '')) AS DOUBLE) / 100e0 ELSE TRY_CAST(factor AS DOUBLE) END AS value FROM (SELECT file_id, CASE WHEN file_id % 2 = 0 THEN {_pick_sql(_FACTORS, 2)} ELSE file_id % 200 || '%' END AS factor FROM ids)""")
def parse_factors(spark, sf_dir):
    own = F.concat((C("file_id") % 200).cast("string"), F.lit("%"))
    rows = _chosen(spark, sf_dir, "factor", _FACTORS, 2).withColumn("factor", F.when(C("file_id") % 2 == 0, C("factor")).otherwise(own))
    return rows.select("file_id", "factor", text.parse_factor(C("factor")).alias("value"))


# Pipelines

_PIPELINES = [
    ("web", "crop(width: 1600) -> convert(to: webp)"),
    ("clip", "removeAudio -> changeSpeed(factor: 2) -> capFps(fps: 30)"),
    ("pack", "optimise -> downscale(factor: 50%)"),
    ("sound", "normalise(lufs: -14) -> convert(to: m4a) -> lower_bitrate(kbps: 96)"),
    ("any", "convert(to: gif)"),
    ("none", ""),
]
_PIPELINE_SQL = "p(name, dsl) AS (VALUES " + ", ".join(f"('{n}', '{d}')" for n, d in _PIPELINES) + ")"


def _pipelines(spark) -> DataFrame:
    return spark.createDataFrame(_PIPELINES, "name string, dsl string")


_OPS = " ".join(f"WHEN '{n}' THEN '{op}'" for n, op in dsl.OP_OF_NAME.items())
_STEPS_SQL = f"""{_PIPELINE_SQL}, q AS (SELECT name, list_filter(list_transform(string_split(dsl, '->'), lambda s: trim(s)), lambda s: s <> '') AS steps FROM p),
s AS (SELECT name, i - 1 AS n, steps[i] AS step FROM q, unnest(range(1, len(steps) + 1)) AS t(i)),
o AS (SELECT name, n, CASE trim(regexp_extract(step, '^([^(]*)', 1)) {_OPS} END AS op, lower(regexp_extract(step, 'to\\s*:\\s*([A-Za-z0-9]+)', 1)) AS target FROM s)"""


@_query(f"WITH {IDS}, {_STEPS_SQL} SELECT file_id, name, n, op, target FROM (SELECT file_id, {_pick_sql([n for n, _ in _PIPELINES])} AS name FROM ids) JOIN o USING (name)")
def dsl_steps(spark, sf_dir):
    rows = _chosen(spark, sf_dir, "name", [n for n, _ in _PIPELINES]).withColumn("dsl", _pick([d for _, d in _PIPELINES]))
    return rows.select("file_id", "name", F.posexplode(dsl.step_structs(C("dsl"))).alias("n", "s")).select("file_id", "name", C("n").cast("long").alias("n"), "s.op", "s.target")


def _case(c, table):
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


_VIDEO_LIST = _sql_list(dims.KIND_EXTENSIONS["video"])
_AFTER = f"""CASE WHEN o.op = 'convert' THEN CASE WHEN o.target = 'gif' THEN 'gif' WHEN r.ext IN ({_VIDEO_LIST}) THEN coalesce({_case("o.target", {k: dims.VIDEO_CONTAINERS[v] for k, v in dims.VIDEO_TARGETS.items()})}, r.ext)
  ELSE coalesce({_case("o.target", dims.IMAGE_TARGETS)}, {_case("o.target", {k: dims.AUDIO_EXTENSION[v] for k, v in dims.AUDIO_TARGETS.items()})}, r.ext) END
  WHEN o.op IN ('optimise', 'downscale', 'removeAudio', 'changeSpeed', 'capFps') AND r.ext IN ({_VIDEO_LIST}) THEN 'mp4' ELSE r.ext END"""


@_query(f"""WITH RECURSIVE {FX}, {_STEPS_SQL}, start AS (SELECT DISTINCT ext AS first, CASE WHEN ext = '' THEN 'bin' ELSE ext END AS ext FROM able),
r AS (SELECT name, first, ext, 0 AS n FROM p, start UNION ALL SELECT r.name, r.first, {_AFTER}, r.n + 1 FROM r JOIN o ON o.name = r.name AND o.n = r.n)
SELECT name, first AS ext, arg_max(ext, n) AS final FROM r GROUP BY name, first""")
def dsl_output_ext(spark, sf_dir):
    exts = _files(spark, sf_dir).select("ext").distinct()
    each = exts.withColumn("p", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(d).alias("dsl")) for n, d in _PIPELINES])))
    return each.select(C("p.name").alias("name"), "ext", dsl.output_extension(C("ext"), dsl.step_structs(C("p.dsl"))).alias("final"))


@_query(f"""WITH {FX}, {_PIPELINE_SQL}, q AS (SELECT file_id, CASE file_id % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'optimise' ELSE 'clip' END AS spec FROM fx)
SELECT file_id, spec, coalesce(dsl, spec) AS dsl FROM q LEFT JOIN p ON p.name = spec""")
def pipeline_resolve(spark, sf_dir):
    spec = F.when(C("file_id") % 3 == 0, "web").when(C("file_id") % 3 == 1, "optimise").otherwise("clip")
    return dsl.resolve(fixture(spark, sf_dir).select("file_id", spec.alias("spec")), _pipelines(spark)).select("file_id", "spec", "dsl")


# Selection

_MODEL = "length * (110 - f) // 100"


@_query(f"""WITH {FX}, t AS (SELECT file_id, length, length * (20 + file_id % 80) // 100 AS budget, i, list_extract({dims.BUDGET_FACTORS}, i) AS f FROM fx, range(1, 7) AS r(i)),
s AS (SELECT *, {_MODEL} AS size FROM t), k AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY size > budget, CASE WHEN size > budget THEN size ELSE i END, i) AS rn FROM s)
SELECT file_id, CAST(f AS INT) AS factor, size, size <= budget AS fits FROM k WHERE rn = 1""")
def budget_pick(spark, sf_dir):
    budget = F.floor(C("length") * (20 + C("file_id") % 80) / 100)
    return fixture(spark, sf_dir).select("file_id", selection.budget_choice(C("length"), budget).alias("c")).select("file_id", "c.*")


@_query(f"""WITH {FX}, s AS (SELECT *, length * (40 + file_id % 90) // 100 AS a, length * (30 + file_id % 70) // 100 AS b, CASE WHEN file_id % 11 = 0 THEN NULL ELSE length * (35 + file_id % 77) // 100 END AS c FROM able WHERE kind = 'image'),
t AS (SELECT *, 0 AS i, 'same' AS fmt, a AS size FROM s UNION ALL SELECT *, 1, 'jpeg', b FROM s WHERE NOT has_alpha UNION ALL SELECT *, 2, 'png', c FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY size, i) AS rn FROM t WHERE size > 0), w AS (SELECT s.file_id, s.ext, s.length, k.fmt, k.size FROM s LEFT JOIN k ON k.file_id = s.file_id AND rn = 1)
SELECT file_id, CASE WHEN size < length THEN CASE fmt WHEN 'same' THEN ext WHEN 'jpeg' THEN 'jpg' ELSE 'png' END ELSE ext END AS format, CASE WHEN size < length THEN size ELSE length END AS size FROM w""")
def adaptive_pick(spark, sf_dir):
    def part(low, span):
        return F.floor(C("length") * (low + C("file_id") % span) / 100)

    sizes = {"same": part(40, 90), "jpeg": part(30, 70), "png": F.when(C("file_id") % 11 != 0, part(35, 77))}
    images = _files(spark, sf_dir).where("kind = 'image'")
    return images.select("file_id", selection.adaptive_choice(C("ext"), C("has_alpha"), C("length"), sizes).alias("c")).select("file_id", "c.*")


@_query(f"""WITH {FX}, s AS (SELECT *, CASE WHEN file_id % 9 = 0 THEN 0 ELSE length * (50 + file_id % 100) // 100 END AS new, file_id % 4 = 0 AS larger, CASE kind WHEN 'video' THEN 'mp4' WHEN 'audio' THEN 'mp3' ELSE ext END AS target FROM able WHERE kind IS NOT NULL)
SELECT file_id, CASE WHEN NOT larger AND (new = 0 OR new >= length) THEN length ELSE new END AS guarded,
  CASE kind WHEN 'video' THEN ext = 'mp4' AND NOT larger AND new <> 0 AND new >= length WHEN 'audio' THEN ext = target AND NOT larger AND (new = 0 OR new >= length) ELSE NOT larger AND (new = 0 OR new >= length) END AS kept FROM s""")
def size_guard(spark, sf_dir):
    new = F.when(C("file_id") % 9 == 0, 0).otherwise(F.floor(C("length") * (50 + C("file_id") % 100) / 100))
    target = F.when(C("kind") == "video", "mp4").when(C("kind") == "audio", "mp3").otherwise(C("ext"))
    rows = _files(spark, sf_dir).where("kind IS NOT NULL").withColumns({"new": new, "larger": C("file_id") % 4 == 0, "target": target})
    return rows.select("file_id", selection.guarded_size(C("length"), C("new"), C("larger")).alias("guarded"), selection.kept_original(C("kind"), C("ext"), C("target"), C("length"), C("new"), C("larger")).alias("kept"))


# Placement


@_query(f"""WITH {FX}, s AS (SELECT *, CASE kind WHEN 'video' THEN 'mp4' WHEN 'audio' THEN 'm4a' ELSE ext END AS target, CASE WHEN file_id % 7 = 0 THEN '/out/' || name END AS output, regexp_extract(path, '^(.*/)[^/]+$', 1) AS dir FROM able WHERE kind IS NOT NULL)
SELECT file_id, coalesce(output, CASE WHEN kind IN ('video', 'audio') AND ext <> target THEN dir || stem || '.' || target ELSE path END) AS dest, output IS NULL AS replaces,
  coalesce(output, CASE WHEN ext = 'webp' THEN path ELSE dir || stem || '.webp' END) AS pipeline_dest, CASE WHEN output IS NULL AND ext = 'webp' THEN dir || '.' || name || '.orig' END AS backup,
  CASE WHEN file_id % 2 = 0 THEN dir || stem || '-crop.pdf' ELSE path END AS pdf FROM s""")
def placement_plan(spark, sf_dir):
    target = F.when(C("kind") == "video", "mp4").when(C("kind") == "audio", "m4a").otherwise(C("ext"))
    rows = _files(spark, sf_dir).where("kind IS NOT NULL").withColumns({"target": target, "output": F.when(C("file_id") % 7 == 0, F.concat(F.lit("/out/"), paths.file_name(C("path"))))})
    rows = rows.withColumns({"p": placement.placed(C("path"), C("output"), C("kind"), C("target")), "q": placement.pipeline_placed(C("path"), C("output"), F.lit("webp"))})
    return rows.select("file_id", "p.dest", "p.replaces", C("q.dest").alias("pipeline_dest"), "q.backup", placement.pdf_output(C("path"), F.when(C("file_id") % 2 == 0, "-crop")).alias("pdf"))


@_query(f"WITH {FX} SELECT file_id, '/out/' || name AS output FROM named")
def output_resolve(spark, sf_dir):
    return placement.resolved_output(fixture(spark, sf_dir), "/out/", True, F.lit("2024-01-01").cast("timestamp")).select("file_id", "output")


_BACK = "regexp_extract(path, '^(.*/)[^/]+$', 1) || '.' || name || '.orig'"


@_query(f"""WITH {FX}, listed AS (SELECT path FROM fx UNION ALL SELECT {_BACK} FROM named WHERE file_id % 3 = 0), l AS (SELECT DISTINCT path, regexp_extract(path, '([^/]*)$', 1) AS name FROM listed)
SELECT path AS backup, regexp_extract(path, '^(.*/)[^/]+$', 1) || regexp_extract(name, '^\\.(.+)\\.orig$', 1) AS original FROM l WHERE regexp_full_match(name, '\\..+\\.orig')""")
def restore_pairs(spark, sf_dir):
    files = fixture(spark, sf_dir).select("file_id", "path")
    return placement.restore_pairs(files.select("path").union(files.where("file_id % 3 = 0").select(paths.backup_name(C("path")))))


@_query(f"WITH {FX} SELECT DISTINCT path, {_BACK} AS backup FROM named WHERE file_id % 3 <> 0")
def backups_to_make(spark, sf_dir):
    files = fixture(spark, sf_dir)
    return placement.backups_to_make(files, files.where("file_id % 3 = 0").select(paths.backup_name(C("path")).alias("path")))


@_query(f"WITH {FX} SELECT DISTINCT {_BACK} AS backup, path AS original FROM named WHERE file_id % 6 = 0")
def backups_of_files(spark, sf_dir):
    files = fixture(spark, sf_dir)
    return placement.backups_of(files.where("file_id % 2 = 0"), files.where("file_id % 3 = 0").select(paths.backup_name(C("path")).alias("path")))


# Reports

_TOTALS = "count(*) FILTER (error IS NULL) AS ok, count(*) FILTER (error IS NOT NULL) AS failed, CAST(coalesce(sum(length) FILTER (error IS NULL), 0) AS BIGINT) AS total_old, CAST(coalesce(sum(new_size) FILTER (error IS NULL), 0) AS BIGINT) AS total_new"
_SAVED = "*, greatest(total_old - total_new, 0) AS saved, CASE WHEN total_old > 0 THEN CAST(greatest(total_old - total_new, 0) AS DOUBLE) / total_old * 100 ELSE 0e0 END AS percent"


@_query(f"WITH {FX}, t AS (SELECT {_TOTALS} FROM done WHERE kind IS NOT NULL) SELECT {_SAVED} FROM t")
def batch_summary(spark, sf_dir):
    return report.summary(_results(spark, sf_dir).where("kind IS NOT NULL"))


@_query(f"WITH {FX}, t AS (SELECT kind, {_TOTALS} FROM done GROUP BY kind) SELECT {_SAVED} FROM t")
def summary_by_kind(spark, sf_dir):
    return report.summary_by(_results(spark, sf_dir), "kind")


@_query(f"WITH {FX} SELECT file_id, CASE WHEN error IS NOT NULL THEN 'failed' WHEN new_size > 0 AND new_size < length THEN 'improved' ELSE 'already optimal' END AS status, round(CASE WHEN length > 0 THEN CAST(length - new_size AS DOUBLE) / length * 100 ELSE 0e0 END * 100) / 100 AS percent FROM done")
def row_status(spark, sf_dir):
    return _results(spark, sf_dir).select("file_id", report.status(C("error"), C("length"), C("new_size")).alias("status"), text.printed_percent(text.saved_percent(C("length"), C("new_size"))).alias("percent"))


@_query(f"WITH {FX} SELECT file_id, path, length FROM done WHERE error IS NULL ORDER BY length DESC, path LIMIT 50")
def recent_cards(spark, sf_dir):
    return report.newest(_results(spark, sf_dir).where("error IS NULL").select("file_id", "path", "length"), "length")


@_query(f"WITH {FX} SELECT path, CASE WHEN error IS NULL THEN json_object('source', path, 'output', path, 'kind', kind, 'ok', true, 'old_size', length, 'new_size', new_size, 'saved_bytes', length - new_size, 'aggressive', factor >= 50, 'improved', new_size > 0 AND new_size < length) ELSE json_object('source', path, 'ok', false, 'error', error) END::VARCHAR AS json FROM done")
def result_json(spark, sf_dir):
    rows = _results(spark, sf_dir).withColumns({"output": C("path"), "aggressive": C("factor") >= 50})
    return report.as_json(rows).withColumn("json", F.regexp_replace("json", r'"saved_percent":[0-9.E\-]+,', ""))


@_query(f"WITH {FX} SELECT file_id, CASE WHEN file_id % 4 = 0 THEN 'budget' WHEN file_id % 2 = 1 AND kind = 'image' THEN 'adaptive' ELSE 'plain' END AS mode FROM able")
def optimise_modes(spark, sf_dir):
    return _files(spark, sf_dir).select("file_id", selection.mode_of(F.when(C("file_id") % 4 == 0, 1000), C("file_id") % 2 == 1, C("kind")).alias("mode"))


# Watching

_EVENT_PATH = f"'/vault/u' || user_id || '/' || CASE WHEN user_id % 13 = 0 THEN '.' ELSE '' END || event_type || user_id % 7 || '.' || list_extract([{_sql_list(FIXTURE_EXTENSIONS)}], CAST(user_id % 36 AS INT) + 1)"


def _events(spark, sf_dir) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", C("ts").cast("timestamp").alias("event_time"), "user_id", "event_type", "value")
    ext = F.get(F.array(*map(F.lit, FIXTURE_EXTENSIONS)), (C("user_id") % len(FIXTURE_EXTENSIONS)).cast("int"))
    name = F.concat(F.when(C("user_id") % 13 == 0, ".").otherwise(""), C("event_type"), (C("user_id") % 7).cast("string"), F.lit("."), ext)
    return events.withColumn("path", F.concat(F.lit("/vault/u"), C("user_id").cast("string"), F.lit("/"), name)).withColumn("mtime", F.date_trunc("hour", "event_time"))


@_query(f"""WITH e AS (SELECT ts, {_EVENT_PATH} AS path FROM events), g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (ORDER BY ts) + INTERVAL 300 SECOND THEN 1 ELSE 0 END AS new FROM e),
s AS (SELECT *, sum(new) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT epoch_us(min(ts)) AS start_us, count(*) AS n_events, count(DISTINCT path) AS n_paths, min(path) AS first_path FROM s GROUP BY session""")
def debounce_batches(spark, sf_dir):
    batches = watch.debounced_counts(_events(spark, sf_dir), "300 seconds")
    return batches.select(F.unix_micros("start").alias("start_us"), "n_events", "n_paths", "first_path")


@_query(f"""WITH e AS (SELECT event_id, ts, {_EVENT_PATH} AS path, date_trunc('hour', ts) AS mtime FROM events),
s AS (SELECT *, max(mtime) OVER (PARTITION BY path ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM e) SELECT event_id, path FROM s WHERE seen IS NULL OR mtime > seen""")
def mtime_dedup(spark, sf_dir):
    return watch.unseen(_events(spark, sf_dir)).select("event_id", "path")


_ROUTES = [("/vault/u1", "image", "web"), ("/vault/u2", "all", "pack"), ("/vault", "video", "clip"), ("/vault/", "other", "any")]


@_query(f"""WITH e AS (SELECT event_id, {_EVENT_PATH} AS path FROM events), n AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS name FROM e), x AS (SELECT *, lower(regexp_extract(name, '^.+\\.([^.]*)$', 1)) AS ext FROM n),
k AS (SELECT *, CASE {" ".join(f"WHEN ext IN ({_sql_list(v)}) THEN '{k}'" for k, v in dims.KIND_EXTENSIONS.items())} END AS kind FROM x),
t AS (SELECT event_id, path, CASE WHEN starts_with(path, '/vault/u1/') AND kind = 'image' THEN 0 WHEN starts_with(path, '/vault/u2/') THEN 1 WHEN kind = 'video' THEN 2 ELSE 3 END AS target FROM k WHERE kind IS NOT NULL AND NOT starts_with(name, '.') AND NOT ends_with(name, '.orig') AND NOT ends_with(name, '~'))
SELECT event_id, path, target, list_extract(['web', 'pack', 'clip', 'any'], target + 1) AS pipeline FROM t""")
def route_first_match(spark, sf_dir):
    return watch.routed(_events(spark, sf_dir), _ROUTES).select("event_id", "path", "target", "pipeline")


@_query("""WITH l AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last FROM events) SELECT event_id, user_id, event_type FROM l WHERE last IS NULL OR event_type <> last""")
def adjacent_dedup(spark, sf_dir):
    return watch.changed(_events(spark, sf_dir), C("event_type"), "user_id", ["event_time", "event_id"]).select("event_id", "user_id", "event_type")


# Pictures: small PNG files made from the catalogue go through a pipeline, and their headers are read back


def _spread(files):
    """``files``, dealt over all tasks: a row is small and its picture long work, and few large files of rows would be few tasks."""
    spark = files.sparkSession
    return files.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "file_id")


@_query(f"""WITH {FX}, p AS (SELECT file_id, CAST(16 + file_id % 40 AS INT) AS w, CAST(16 + (file_id * 7) % 50 AS INT) AS h FROM able WHERE kind = 'image'),
c AS (SELECT file_id, greatest(2, least(w, CASE WHEN w * 1e0 / h > 4e0 / 3e0 THEN {_I("h * (4e0 / 3e0)")} ELSE w END)) AS w, greatest(2, least(h, CASE WHEN w * 1e0 / h > 4e0 / 3e0 THEN h ELSE {_I("w / (4e0 / 3e0)")} END)) AS h FROM p)
SELECT file_id, greatest(1, {_I("w * 0.5e0")}) AS width, greatest(1, {_I("h * 0.5e0")}) AS height, false AS has_alpha FROM c""")
def png_pipeline(spark, sf_dir):
    import numpy as np
    import pyarrow as pa

    from .operators import images
    from .sources.catalog import png_header

    def draw(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                y, x = np.mgrid[0 : 16 + (i * 7) % 50, 0 : 16 + i % 40]
                picture = images.encode(np.stack([2 * x, 2 * y, x + y], 2).astype(np.uint8))
                yield pa.RecordBatch.from_arrays([pa.array([str(i)]), pa.array([picture], pa.binary())], ["path", "content"])

    files = _spread(_files(spark, sf_dir).where("kind = 'image'").select("file_id")).mapInArrow(draw, "path string, content binary")
    done = images.run_steps(files, dsl.parse("crop(ratio: 4:3) -> downscale(factor: 50%) -> optimise -> stripExif"))
    return done.withColumns(png_header(C("content"))).select(C("path").cast("long").alias("file_id"), "width", "height", "has_alpha")


_KINDS = ["Image", "images", "VIDEO", "videos", "audio", "audios", "pdf", "other"]


@_query(f"WITH {IDS} SELECT file_id, name, CASE lower(name) WHEN 'image' THEN 'image' WHEN 'images' THEN 'image' WHEN 'video' THEN 'video' WHEN 'videos' THEN 'video' WHEN 'audio' THEN 'audio' WHEN 'pdf' THEN 'pdf' END AS kind FROM (SELECT file_id, {_pick_sql(_KINDS)} AS name FROM ids)")
def parse_kinds(spark, sf_dir):
    return _chosen(spark, sf_dir, "name", _KINDS).select("file_id", "name", paths.parse_kind(C("name")).alias("kind"))


from . import live_queries, media_queries  # noqa: E402, F401  register their queries here
