"""Formats, extensions and their attributes, as small driver-side tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of each kind, in the order in which a kind is looked for.
KIND_EXTENSIONS = {
    "image": ["webp", "avif", "heic", "heif", "jxl", "bmp", "tiff", "tif", "png", "jpeg", "jpg", "gif"],
    "video": ["mov", "mp4", "webm", "mkv", "m2v", "avi", "m4v", "mpeg", "mpg"],
    "audio": ["wav", "aiff", "aif", "mp3", "flac", "m4a", "ogg", "oga"],
    "pdf": ["pdf"],
}
# Images that can be optimised; the other image extensions are only known by name.
OPTIMISABLE_IMAGES = ["png", "jpg", "jpeg", "gif", "webp", "bmp", "tiff", "tif"]
# Names of target formats and their extensions.
IMAGE_TARGETS = {"webp": "webp", "avif": "avif", "heic": "heic", "heif": "heic", "jxl": "jxl", "png": "png", "jpeg": "jpg", "jpg": "jpg"}
VIDEO_TARGETS = {"mp4": "h264", "h264": "h264", "avc": "h264", "hevc": "hevc", "h265": "hevc", "x265": "hevc", "av1": "av1", "webm": "vp9", "vp9": "vp9"}
VIDEO_CONTAINERS = {"h264": "mp4", "hevc": "mp4", "av1": "mp4", "vp9": "webm"}
# Audio formats, their names, extensions, codecs and bit rates.
AUDIO_TARGETS = {"aac": "aac", "m4a": "aac", "mp3": "mp3", "opus": "opus", "ogg": "opus", "oga": "opus", "wav": "wav", "flac": "flac", "aiff": "aiff", "aif": "aiff"}
AUDIO_EXTENSION = {"same": "", "aac": "m4a", "mp3": "mp3", "opus": "ogg", "wav": "wav", "flac": "flac", "aiff": "aiff"}
AUDIO_CODEC = {"same": "", "aac": "aac_at", "mp3": "libmp3lame", "opus": "libopus", "wav": "pcm_s16le", "flac": "flac", "aiff": "pcm_s16be"}
AUDIO_DEFAULT_KBPS = {"same": -1, "aac": 192, "mp3": 192, "opus": 128, "wav": 0, "flac": 0, "aiff": 0}
AUDIO_RANGE_KBPS = {"mp3": (64, 320), "aac": (48, 256), "opus": (32, 160), "same": (48, 256)}
AUDIO_ALLOWED_KBPS = {
    "same": [56, 64, 80, 96, 128, 160, 192, 256, 320],
    "aac": [56, 64, 80, 96, 128, 160, 192, 256],
    "mp3": [56, 64, 80, 96, 128, 160, 192, 256, 320],
    "opus": [32, 48, 64, 80, 96, 128],
    "wav": [],
    "flac": [],
    "aiff": [],
}
# The factors that a budget search tries, and where watermarks go.
BUDGET_FACTORS = [30, 50, 64, 80, 90, 100]
POSITIONS = {"topleft": "10:10", "topright": "W-w-10:10", "bottomleft": "10:H-h-10", "center": "(W-w)/2:(H-h)/2", "centre": "(W-w)/2:(H-h)/2"}
POSITION_ELSE = "W-w-10:H-h-10"
# External tools that are known by name, and those of them that are run.
KNOWN_TOOLS = ["ffmpeg", "ffprobe", "pngquant", "jpegoptim", "jpegoptim-old", "gifsicle", "gifski", "vips", "vipsthumbnail", "gs", "cwebp", "heif-enc", "cjxl", "exiftool"]
TOOLS = ["ffmpeg", "gs", "gifski", "heif-enc", "cjxl", "exiftool"]


def looked_up(key: Column, table: dict, otherwise=None) -> Column:
    """The value of ``key`` in a literal table, as a chain of conditions that stays inside generated code."""
    out = None
    for value in dict.fromkeys(map(_hashable, table.values())):
        keys = [k for k, v in table.items() if _hashable(v) == value]
        out = F.when(key.isin(keys), F.lit(value)) if out is None else out.when(key.isin(keys), F.lit(value))
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def _hashable(v):
    return tuple(v) if isinstance(v, list) else v
