"""Crop and scale plans, as columns. Widths and heights are ints; ratios are doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(c) -> Column:
    return c.cast("double") if isinstance(c, Column) else F.lit(float(c))


def _round(c: Column) -> Column:
    return F.round(c).cast("int")


def even(n: Column) -> Column:
    """Even numbers stay; odd ones go down by one, to 2 at least."""
    return F.when(n % 2 == 0, n).otherwise(F.greatest(n - 1, F.lit(2)))


def plan(mode, w: Column, h: Column) -> Column:
    return F.struct(F.lit(mode).alias("mode"), w.cast("int").alias("w"), h.cast("int").alias("h"))


def long_edge_plan(sw: Column, sh: Column, n: Column) -> Column:
    return F.when(sw >= sh, plan("resize", n, even(_round(_d(n) * _d(sh) / _d(sw))))).otherwise(plan("resize", even(_round(_d(n) * _d(sw) / _d(sh))), n))


def as_long_edge(width: Column, height: Column) -> Column:
    """struct(width, height, long_edge): the width, or else the height, becomes the long edge, and neither stays."""
    none = F.lit(None).cast("int")
    return F.struct(none.alias("width"), none.alias("height"), F.coalesce(width, height).alias("long_edge"))


def aspect_plan(sw: Column, sh: Column, aw: Column, ah: Column) -> Column:
    """The largest centred rectangle of the ratio."""
    r = _d(aw) / _d(ah)
    wide = _d(sw) / _d(sh) > r
    tw = F.when(wide, _round(_d(sh) * r)).otherwise(sw)
    th = F.when(wide, sh).otherwise(_round(_d(sw) / r))
    return plan("crop", F.greatest(F.least(tw, sw), F.lit(2)), F.greatest(F.least(th, sh), F.lit(2)))


def crop_plan(sw: Column, sh: Column, width: Column, height: Column, long_edge: Column, aw: Column, ah: Column) -> Column:
    """struct(mode, w, h): the long edge goes before the ratio, and that before width and height."""
    return (
        F.when(long_edge.isNotNull(), long_edge_plan(sw, sh, long_edge))
        .when(aw.isNotNull() & ah.isNotNull(), aspect_plan(sw, sh, aw, ah))
        .when(width.isNotNull() & height.isNotNull(), plan("cover", width, height))
        .when(width.isNotNull(), plan("resize", width, even(_round(_d(width) * _d(sh) / _d(sw)))))
        .when(height.isNotNull(), plan("resize", even(_round(_d(height) * _d(sw) / _d(sh))), height))
        .otherwise(plan("resize", sw, sh))
    )


def cover_plan(iw: Column, ih: Column, w: Column, h: Column) -> Column:
    """struct(sw, sh, x, y): the scaled size that covers w x h, and where the centred crop starts."""
    scale = F.greatest(_d(w) / _d(iw), _d(h) / _d(ih))
    sw = F.greatest(F.ceil(_d(iw) * scale).cast("int"), w)
    sh = F.greatest(F.ceil(_d(ih) * scale).cast("int"), h)
    return F.struct(sw.alias("sw"), sh.alias("sh"), F.floor((sw - w) / 2).cast("int").alias("x"), F.floor((sh - h) / 2).cast("int").alias("y"))


def crop_offsets(sw: Column, sh: Column, w: Column, h: Column) -> Column:
    return F.struct(F.floor((sw - w) / 2).cast("int").alias("x"), F.floor((sh - h) / 2).cast("int").alias("y"))


def rect_pixels(sw: Column, sh: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """struct(x, y, w, h) of a rectangle in parts of the image; null if it would start within a hundredth of the far edge."""
    x, y = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), F.greatest(F.lit(0.0), F.least(F.lit(1.0), y))
    w, h = F.greatest(F.lit(0.01), F.least(1 - x, w)), F.greatest(F.lit(0.01), F.least(1 - y, h))
    px, py = _round(x * _d(sw)), _round(y * _d(sh))
    pw = F.least(F.greatest(_round(w * _d(sw)), F.lit(1)), sw - px)
    ph = F.least(F.greatest(_round(h * _d(sh)), F.lit(1)), sh - py)
    return F.when((x <= 0.99) & (y <= 0.99), F.struct(px.alias("x"), py.alias("y"), pw.alias("w"), ph.alias("h")))


def scaled(dim: Column, factor: Column) -> Column:
    return F.greatest(F.lit(1), _round(_d(dim) * F.greatest(F.lit(0.05), F.least(F.lit(1.0), factor))))


def video_crop_filter(width: Column, height: Column, long_edge: Column, aw: Column, ah: Column) -> Column:
    """The encoder's filter text; null without a target."""
    return (
        F.when(long_edge.isNotNull(), F.format_string("scale='if(gt(iw,ih),%d,-2)':'if(gt(iw,ih),-2,%d)'", long_edge, long_edge))
        .when(aw.isNotNull() & ah.isNotNull(), F.format_string("crop='min(iw,ih*%d/%d)':'min(ih,iw*%d/%d)'", aw, ah, ah, aw))
        .when(width.isNotNull() & height.isNotNull(), F.format_string("scale=%d:%d:force_original_aspect_ratio=increase,crop=%d:%d", width, height, width, height))
        .when(width.isNotNull(), F.format_string("scale=%d:-2", width))
        .when(height.isNotNull(), F.format_string("scale=-2:%d", height))
    )


def video_scale_filter(factor: Column) -> Column:
    f = F.format_string("%.4f", F.bround(F.greatest(F.lit(0.05), F.least(F.lit(1.0), factor)), 4))
    return F.concat(F.lit("scale=trunc(iw*"), f, F.lit("/2)*2:trunc(ih*"), f, F.lit("/2)*2"))


def speed_filters(factor: Column) -> Column:
    """struct(video, audio) filter texts for a change of speed, held to 0.25 .. 8."""
    f = F.greatest(F.lit(0.25), F.least(F.lit(8.0), factor))
    return F.struct(F.concat(F.lit("setpts="), F.format_string("%.5f", F.bround(1.0 / f, 5)), F.lit("*PTS")).alias("video"), F.concat(F.lit("atempo="), F.format_string("%.5f", F.bround(f, 5))).alias("audio"))


def capped_fps(fps: Column) -> Column:
    return F.greatest(fps, F.lit(1))


def pdf_crop_box(media: Column, ratio: Column) -> Column:
    """array(x0, y0, x1, y1): the largest centred box of the ratio in a media box; the box itself if it is empty."""
    x0, y0, x1, y1 = (media[i] for i in range(4))
    w, h = x1 - x0, y1 - y0
    nw, nh = h * ratio, w / ratio
    return (
        F.when((w <= 0) | (h <= 0) | (ratio <= 0), media)
        .when(w / h > ratio, F.array(x0 + (w - nw) / 2, y0, x0 + (w - nw) / 2 + nw, y1))
        .otherwise(F.array(x0, y0 + (h - nh) / 2, x1, y0 + (h - nh) / 2 + nh))
    )


def page_device(name: Column) -> Column:
    return F.when(F.lower(name).isin("jpeg", "jpg"), "jpeg").otherwise("png16m")


def page_dpi(dpi: Column) -> Column:
    return F.greatest(F.lit(36), F.least(F.lit(600), dpi))
