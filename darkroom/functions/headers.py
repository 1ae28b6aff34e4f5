"""Sizes and transparency of pictures from the first bytes of their files, as columns: PNG, JPEG, GIF, BMP and WebP."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_SEGMENTS = 64  # of a JPEG, before the one that has its size
# JPEG markers whose segment has the size, and those that stand alone.
FRAMES = [m for m in range(0xC0, 0xD0) if m not in (0xC4, 0xC8, 0xCC)]
ALONE = [0x01, *range(0xD0, 0xDA)]


def _hex(head: Column, at, n: int) -> Column:
    return F.hex(F.substring(head, at + 1 if isinstance(at, Column) else F.lit(at + 1), F.lit(n)))


def big(head: Column, at, n: int) -> Column:
    """The number that ``n`` bytes from place ``at`` (from 0) make, the first the highest; null beyond the end."""
    text = _hex(head, at, n)
    return F.when(F.length(text) == 2 * n, F.conv(text, 16, 10).cast("long"))


def little(head: Column, at: int, n: int) -> Column:
    """As ``big``, the first byte the lowest."""
    text = _hex(head, at, n)
    turned = F.concat(*[F.substring(text, 2 * i + 1, 2) for i in reversed(range(n))])
    return F.when(F.length(text) == 2 * n, F.conv(turned, 16, 10).cast("long"))


def _starts(head: Column, text: str, at: int = 0) -> Column:
    return _hex(head, at, len(text) // 2) == text


def _size(width: Column, height: Column, alpha: Column) -> Column:
    whole = width.isNotNull() & height.isNotNull()
    return F.struct(F.when(whole, width.cast("int")).alias("width"), F.when(whole, height.cast("int")).alias("height"), F.coalesce(alpha, F.lit(False)).alias("has_alpha"))


def jpeg_size(head: Column) -> Column:
    """struct(width, height, has_alpha): a walk from segment to segment until one has the size, or the bytes or MOST_SEGMENTS end."""
    start = F.struct(F.lit(2).cast("long").alias("at"), F.lit(None).cast("long").alias("width"), F.lit(None).cast("long").alias("height"), F.lit(False).alias("over"))

    def step(s: Column, _: Column) -> Column:
        at = s["at"]
        lead, marker, length = big(head, at, 1), big(head, at + 1, 1), big(head, at + 2, 2)
        frame = marker.isin(FRAMES)
        on = F.when(marker == 0xFF, at + 1).when(marker.isin(ALONE), at + 2).otherwise(at + 2 + length)  # a lead byte may be repeated
        ended = F.coalesce((lead != 0xFF) | frame | marker.isin(0xDA, 0xD9) | on.isNull(), F.lit(True))
        now = F.struct(F.coalesce(on, at).alias("at"), F.when(frame, big(head, at + 7, 2)).alias("width"), F.when(frame, big(head, at + 5, 2)).alias("height"), ended.alias("over"))
        return F.when(s["over"], s).otherwise(now)

    found = F.aggregate(F.sequence(F.lit(1), F.lit(MOST_SEGMENTS)), start, step)
    return F.transform(F.array(found), lambda s: _size(s["width"], s["height"], F.lit(False)))[0]


def webp_size(head: Column) -> Column:
    """By the kind of the first chunk: lossy, lossless, or extended with flags."""
    lossy = _size(little(head, 26, 2).bitwiseAND(0x3FFF), little(head, 28, 2).bitwiseAND(0x3FFF), F.lit(False))
    bits = little(head, 21, 4)
    lossless = _size(bits.bitwiseAND(0x3FFF) + 1, F.shiftright(bits, 14).bitwiseAND(0x3FFF) + 1, F.shiftright(bits, 28).bitwiseAND(1) == 1)
    extended = _size(little(head, 24, 3) + 1, little(head, 27, 3) + 1, big(head, 20, 1).bitwiseAND(0x10) != 0)
    return F.when(_starts(head, "56503820", 12), lossy).when(_starts(head, "5650384C", 12), lossless).when(_starts(head, "56503858", 12), extended)


def picture_header(head: Column) -> Column:
    """struct(format, width, height, has_alpha) of a file's first bytes; null if they are none of the formats', sizes null if they end too early."""
    bmp = _size(F.when(little(head, 18, 4) < 2**31, little(head, 18, 4)), F.when(little(head, 22, 4) < 2**31, little(head, 22, 4)).otherwise(2**32 - little(head, 22, 4)), F.lit(False))
    kinds = {
        "png": (_starts(head, "89504E470D0A1A0A"), _size(big(head, 16, 4), big(head, 20, 4), big(head, 25, 1).isin(4, 6))),
        "jpeg": (_starts(head, "FFD8FF"), jpeg_size(head)),
        "gif": (_starts(head, "474946383761") | _starts(head, "474946383961"), _size(little(head, 6, 2), little(head, 8, 2), F.lit(False))),
        "bmp": (_starts(head, "424D"), bmp),
        "webp": (_starts(head, "52494646") & _starts(head, "57454250", 8), webp_size(head)),
    }
    none = F.lit(None).cast("struct<format:string,width:int,height:int,has_alpha:boolean>")
    out = none
    for name, (fits, size) in kinds.items():
        out = F.when(fits, F.struct(F.lit(name).alias("format"), size["width"].alias("width"), size["height"].alias("height"), size["has_alpha"].alias("has_alpha"))).otherwise(out)
    return out
