"""Command lines of external encoders, as array columns; ``operators.external`` runs them where the tool is there."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import dial, geometry

# Flags as the encoders know them, here and below.
QUIET = ["-hide_banner", "-nostats"]


def words(*parts) -> Column:
    """One array<string> of texts, columns and array columns given as lists of one."""
    return F.concat(*[p[0] if isinstance(p, list) and isinstance(p[0], Column) else F.array(*[F.lit(x) for x in (p if isinstance(p, list) else [p])]) for p in parts if not (isinstance(p, list) and not p)])


KEEP_AUDIO = ["-c:a", "copy", "-map", "0:v", "-map", "0:a?"]  # tried first; without it the encoder makes its own


def encode_video(src: Column, dst: Column, tier: Column, factor: Column, arm: Column, filter_text: Column, copy_audio: bool) -> Column:
    """The default video path to mp4; a null filter leaves the picture as it is."""
    picture = F.when(filter_text.isNotNull(), F.array(F.lit("-vf"), filter_text)).otherwise(F.array().cast("array<string>"))
    return words(["-y", "-i"], src, [picture], [dial.h264_args(tier, factor, arm)], KEEP_AUDIO if copy_audio else [], ["-movflags", "+faststart"], QUIET, dst)


def convert_video(src: Column, dst: Column, codec: Column, tier: Column, factor: Column, arm: Column, hardware: Column, copy_audio: bool) -> Column:
    """To a named codec; webm always gets opus sound."""
    webm = F.array(*map(F.lit, ["-c:a", "libopus", "-b:a", "128k", "-map", "0:v", "-map", "0:a?"]))
    other = F.array(*map(F.lit, [*(KEEP_AUDIO if copy_audio else ["-c:a", "aac", "-b:a", "192k"]), "-movflags", "+faststart"]))
    return words(["-y", "-i"], src, [dial.video_args(codec, tier, factor, arm, hardware)], [F.when(codec == "vp9", webm).otherwise(other)], QUIET, dst)


def tries_of_video(src: Column, dst: Column, tier: Column, factor: Column, arm: Column, filter_text: Column) -> Column:
    """array<array<string>>: the command that copies the sound, and the one for when that fails."""
    return F.array(encode_video(src, dst, tier, factor, arm, filter_text, True), encode_video(src, dst, tier, factor, arm, filter_text, False))


def convert_heic(src: Column, dst: Column, factor: Column) -> Column:
    return words(["-q"], dial.conversion_quality(factor).cast("string"), ["-o"], dst, src)


def convert_jxl(src: Column, dst: Column, factor: Column) -> Column:
    return words(["-q"], dial.jxl_quality(factor).cast("string"), ["-e"], dial.jxl_effort(factor).cast("string"), src, dst)


def video_to_gif(src: Column, dst: Column, fps: Column, max_width: Column) -> Column:
    """In one pass; a null width leaves the size as it is."""
    size = F.when(max_width.isNotNull(), F.format_string(",scale=%d:-1:flags=lanczos", max_width)).otherwise("")
    return words(["-y", "-i"], src, ["-vf"], F.concat(F.format_string("fps=%d", fps), size), QUIET, dst)


def gif_frames(src: Column, pattern: Column, fps: Column, max_width: Column) -> Column:
    """The first of two steps to a GIF: numbered pictures, at least one a second."""
    size = F.when(max_width.isNotNull(), F.format_string(",scale=%d:-1:flags=lanczos", max_width)).otherwise("")
    return words(["-y", "-i"], src, ["-vf"], F.concat(F.format_string("fps=%d", F.greatest(fps, F.lit(1))), size), pattern)


def gif_of_frames(dst: Column, fps: Column, max_width: Column, aggressive: Column, frames: Column) -> Column:
    """The second step: ``frames`` (array) in the order of their names become a GIF."""
    quality = dial.gif_from_video_quality(aggressive).cast("string")
    width = F.when(max_width.isNotNull(), F.array(F.lit("--width"), max_width.cast("string"))).otherwise(F.array().cast("array<string>"))
    return words(["-o"], dst, ["--fps"], F.greatest(fps, F.lit(1)).cast("string"), ["--quality"], quality, [width], [F.array_sort(frames)])


def remove_audio(src: Column, dst: Column) -> Column:
    return words(["-y", "-i"], src, ["-c", "copy", "-an"], QUIET, dst)


def change_speed(src: Column, dst: Column, factor: Column, tier: Column, dial_factor: Column, arm: Column) -> Column:
    f = geometry.speed_filters(factor)
    return words(["-y", "-i"], src, ["-filter:v"], f["video"], ["-filter:a"], f["audio"], [dial.h264_args(tier, dial_factor, arm)], QUIET, dst)


def cap_fps(src: Column, dst: Column, fps: Column, tier: Column, dial_factor: Column, arm: Column) -> Column:
    return words(["-y", "-i"], src, ["-vf"], F.format_string("fps=fps=%d", geometry.capped_fps(fps)), [dial.h264_args(tier, dial_factor, arm)], QUIET, dst)


def encode_audio(src: Column, dst: Column, audio: Column, kbps: Column, aggressive: Column) -> Column:
    return words(["-y", "-i"], src, [dial.audio_args(audio, kbps, aggressive, F.lit(None).cast("double"))], dst)


def normalize_audio(src: Column, dst: Column, lufs: Column) -> Column:
    return words(["-y", "-i"], src, ["-af"], F.concat(F.lit("loudnorm=I="), F.format_string("%.1f", F.bround(lufs, 1)), F.lit(":TP=-1.5:LRA=11")), QUIET, dst)


def extract_pages(src: Column, pattern: Column, device: Column, dpi: Column) -> Column:
    return words(["-dNOPAUSE", "-dBATCH", "-dSAFER", "-dQUIET"], F.concat(F.lit("-sDEVICE="), geometry.page_device(device)), F.concat(F.lit("-r"), geometry.page_dpi(dpi).cast("string")), F.concat(F.lit("-sOutputFile="), pattern), src)
