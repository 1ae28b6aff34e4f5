"""The compression dial: from one factor, 0 to 100, to every encoder's parameters, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dims

NORMAL, AGGRESSIVE = 30, 64


def clamp(value: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def whole(value: Column) -> Column:
    """Rounded half away from zero; literals are doubles throughout."""
    return F.round(value).cast("int")


def clamped_factor(factor: Column) -> Column:
    return clamp(factor.cast("int"), 0, 100)


def is_aggressive(tier: Column, factor: Column) -> Column:
    return (tier != "adaptive") & (factor >= 50)


def _falling(factor: Column, at_30: float, slope: float, low: int, high: int) -> Column:
    return clamp(whole(F.lit(at_30) - (factor - 30).cast("double") * F.lit(slope)), low, high)


def jpeg_quality(factor: Column) -> Column:
    return _falling(factor, 85.0, 55 / 70, 25, 95)


def jpeg_secondary_quality(factor: Column) -> Column:
    return _falling(factor, 90.0, 60 / 70, 25, 97)


def png_max(factor: Column) -> Column:
    return _falling(factor, 100.0, 75 / 70, 25, 100)


def png_quality(factor: Column) -> Column:
    return F.concat(F.lit("0-"), png_max(factor).cast("string"))


def png_min(factor: Column) -> Column:
    return F.greatest(png_max(factor) - 30, F.lit(0))


def png_speed(factor: Column) -> Column:
    return F.when(factor < 40, 4).when(factor < 60, 3).when(factor < 85, 2).otherwise(1)


def gif_lossy(factor: Column) -> Column:
    return _falling(factor, 30.0, -50 / 34, 0, 200)


def gif_colors(factor: Column) -> Column:
    """Null below 50: the palette is left as it is."""
    return F.when(factor >= 50, clamp(whole(F.lit(256.0) - (factor - 50).cast("double") * F.lit(192 / 50)), 32, 256))


def gif_args(factor: Column) -> Column:
    level = F.when(factor >= 50, 3).when(factor >= 20, 2).otherwise(1)
    args = F.array(F.concat(F.lit("-O"), level.cast("string")), F.concat(F.lit("--lossy="), gif_lossy(factor).cast("string")), F.concat(F.lit("--colors="), gif_colors(factor).cast("string")))
    return F.filter(args, lambda a: a.isNotNull())


def conversion_quality(factor: Column) -> Column:
    return clamp(whole(F.lit(75.0) - factor * F.lit(0.5)), 20, 90)


def jxl_quality(factor: Column) -> Column:
    return clamp(whole(F.lit(75.0) - factor * F.lit(0.5)), 20, 95)


def jxl_effort(factor: Column) -> Column:
    return F.when(factor >= 70, 9).when(factor >= 50, 8).otherwise(7)


def _of_span(factor: Column, span: float) -> Column:
    """How far along 5 .. 100 the factor is, in units of ``span``."""
    return (F.greatest(factor, F.lit(5)) - 5).cast("double") / F.lit(95.0) * F.lit(span)


def h264_crf(factor: Column) -> Column:
    return clamp(F.lit(18) + whole(_of_span(factor, 12.0)), 17, 32)


def uses_auto_crf(factor: Column) -> Column:
    return factor <= 0


def x264_preset(factor: Column) -> Column:
    return F.when(factor < 20, "veryfast").when(factor < 40, "fast").when(factor < 60, "medium").when(factor < 85, "slow").otherwise("slower")


def hardware_quality(factor: Column) -> Column:
    return clamp(whole(F.lit(70.0) - _of_span(factor, 45.0)), 25, 75)


def av1_crf(factor: Column) -> Column:
    return F.lit(24) + whole(_of_span(factor, 26.0))


def vp9_crf(factor: Column) -> Column:
    return F.lit(24) + whole(_of_span(factor, 24.0))


def _args(*parts) -> Column:
    return F.array(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def h264_args(tier: Column, factor: Column, arm: Column) -> Column:
    """Encoder arguments of the default video path, by tier and machine."""
    base = ("-vcodec", "h264", "-tag:v", "avc1")
    auto = uses_auto_crf(factor)
    return (
        F.when(tier == "lossless", _args(*base, "-crf", "17"))
        .when((tier == "fast") & arm, _args("-vcodec", "h264_videotoolbox", "-q:v", hardware_quality(factor), "-tag:v", "avc1"))
        .when((tier == "fast") & auto, _args(*base, "-preset", "veryfast"))
        .when(tier == "fast", _args(*base, "-preset", "veryfast", "-crf", h264_crf(factor)))
        .when(auto, _args(*base, "-preset", "slower"))
        .otherwise(_args(*base, "-preset", x264_preset(factor), "-crf", h264_crf(factor)))
    )


def video_args(codec: Column, tier: Column, factor: Column, arm: Column, hardware: Column) -> Column:
    """Arguments for an explicit codec: h264, hevc, av1 or vp9."""
    return (
        F.when(codec == "h264", h264_args(tier, factor, arm & hardware))
        .when((codec == "hevc") & arm & hardware, _args("-vcodec", "hevc_videotoolbox", "-tag:v", "hvc1"))
        .when(codec == "hevc", _args("-vcodec", "libx265", "-tag:v", "hvc1", "-preset", x264_preset(factor), "-crf", h264_crf(factor)))
        .when(codec == "av1", _args("-vcodec", "libsvtav1", "-crf", av1_crf(factor), "-preset", "6"))
        .when(codec == "vp9", _args("-vcodec", "libvpx-vp9", "-crf", vp9_crf(factor), "-b:v", "0"))
    )


def gif_from_video_quality(aggressive: Column) -> Column:
    return F.when(aggressive, 60).otherwise(90)


def audio_kbps(audio: Column, factor: Column) -> Column:
    """The bit rate that the dial asks for; null for lossless formats."""
    low = dims.looked_up(audio, {k: v[0] for k, v in dims.AUDIO_RANGE_KBPS.items()})
    high = dims.looked_up(audio, {k: v[1] for k, v in dims.AUDIO_RANGE_KBPS.items()})
    t = (clamp(factor, 5, 100) - 5).cast("double") / F.lit(95.0)
    raw = high.cast("double") - t * (high - low).cast("double")
    steps = F.greatest(F.lit(8), whole(raw / F.lit(16.0)) * 16)
    return F.when(low.isNotNull(), F.least(high, F.greatest(low, steps)))


def effective_kbps(override: Column, audio: Column, factor: Column) -> Column:
    return F.coalesce(override, audio_kbps(audio, factor), F.greatest(dims.looked_up(audio, dims.AUDIO_DEFAULT_KBPS), F.lit(0)))


def lame_quality(kbps: Column) -> Column:
    return F.when(kbps <= 64, 9).when(kbps <= 80, 8).when(kbps <= 96, 7).when(kbps <= 128, 5).when(kbps <= 160, 4).when(kbps <= 192, 2).otherwise(0)


def audio_args(audio: Column, kbps: Column, aggressive: Column, sample_rate: Column) -> Column:
    codec, rate = dims.looked_up(audio, dims.AUDIO_CODEC), F.concat(kbps.cast("string"), F.lit("k"))
    resample = F.when(F.coalesce(sample_rate > 48000, F.lit(False)), _args("-ar", "48000")).otherwise(F.array().cast("array<string>"))
    return (
        F.when(audio == "aac", _args("-c:a", codec, "-b:a", rate, "-aac_at_mode", "cvbr"))
        .when(audio == "mp3", _args("-c:a", codec, "-q:a", lame_quality(kbps)))
        .when(audio == "opus", _args("-c:a", codec, "-b:a", rate, "-vbr", "on"))
        .when((audio == "wav") & aggressive, _args("-c:a", "adpcm_ima_wav"))
        .when(audio == "flac", _args("-c:a", codec, "-compression_level", F.when(aggressive, "12").otherwise("8")))
        .when(audio.isin("wav", "aiff"), F.concat(_args("-c:a", codec), resample))
        .otherwise(_args("-c:a", codec))
    )


def resolved_audio(audio: Column, input_ext: Column) -> Column:
    """``same`` becomes the input's format, or aac if the input has none."""
    return F.when(audio != "same", audio).otherwise(dims.looked_up(F.lower(input_ext), dims.AUDIO_TARGETS, "aac"))


def watermark_xy(position: Column) -> Column:
    return dims.looked_up(F.translate(F.lower(position), "-_", ""), dims.POSITIONS, dims.POSITION_ELSE)


def watermark_opacity(opacity: Column) -> Column:
    return clamp(opacity, 0.0, 1.0)


def watermark_scale(scale: Column) -> Column:
    return clamp(scale, 0.01, 1.0)


def image_target(name: Column) -> Column:
    return dims.looked_up(F.lower(name), dims.IMAGE_TARGETS)


def video_target(name: Column) -> Column:
    return dims.looked_up(F.lower(name), dims.VIDEO_TARGETS)


def audio_target(name: Column) -> Column:
    return dims.looked_up(F.lower(name), dims.AUDIO_TARGETS)


def convert_family(to: Column, has_video: Column) -> Column:
    """What a conversion is: gif first, then a video codec if there are videos, an image, an audio format; else null."""
    return (
        F.when(F.lower(to) == "gif", "gif").when(video_target(to).isNotNull() & has_video, "video")
        .when(image_target(to).isNotNull(), "image").when(audio_target(to).isNotNull(), "audio")
    )
