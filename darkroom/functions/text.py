"""Sizes, factors, ratios, versions and file-name templates, as columns."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import parent, raw_extension, stem

# Units of sizes that are read (decimal) and printed (1024).
READ_UNITS = {"mb": 1_000_000, "kb": 1_000, "b": 1, "": 1}
PRINTED_UNITS = ["B", "KB", "MB", "GB", "TB"]


def parse_size(text: Column) -> Column:
    """Bytes of ``500000``, ``500kb`` or ``1.5mb``; cut to whole bytes, 0 if negative, null if it can't be read."""
    low = F.lower(F.trim(text))
    unit = F.regexp_extract(low, "(mb|kb|b)$", 1)
    number = F.trim(F.regexp_replace(low, "(mb|kb|b)$", "")).try_cast("double")
    times = F.when(unit == "mb", 1e6).when(unit == "kb", 1e3).otherwise(1.0)
    return F.when(number.isNotNull(), F.greatest(F.lit(0).cast("long"), (number * times).cast("long")))


def parse_factor(text: Column) -> Column:
    """``50%`` is 0.5; else the number as it is; null if it can't be read."""
    return F.when(text.endswith("%"), F.trim(F.regexp_replace(text, "%$", "")).try_cast("double") / 100).otherwise(text.try_cast("double"))


def parse_ratio(text: Column, kind: str = "int") -> Column:
    """struct(w, h) of ``16:9``; null if a part can't be read. Zeros are let through."""
    parts = F.split(text, ":", 2)
    w, h = (F.trim(F.get(parts, F.lit(i))).try_cast(kind) for i in (0, 1))
    return F.when(w.isNotNull() & h.isNotNull() & (w >= 0) & (h >= 0), F.struct(w.alias("w"), h.alias("h")))


def parse_crop_size(text: Column) -> Column:
    """struct(width, height, aw, ah) of ``W:H`` (a ratio without zeros), ``WxH`` (0: automatic) or ``N`` (both); null if unreadable."""
    bare = F.trim(text)
    pair = F.regexp_extract(bare, r"^\s*\+?(\d+)\s*([:x])\s*\+?(\d+)\s*$", 2)
    a, b = (F.regexp_extract(bare, r"^\s*\+?(\d+)\s*[:x]\s*\+?(\d+)\s*$", i).try_cast("int") for i in (1, 2))
    n = F.regexp_extract(bare, r"^\+?(\d+)$", 1).try_cast("int")
    none = F.lit(None).cast("int")

    def spec(w, h, aw, ah):
        return F.struct(w.alias("width"), h.alias("height"), aw.alias("aw"), ah.alias("ah"))

    return (
        F.when((pair == ":") & (a > 0) & (b > 0), spec(none, none, a, b))
        .when((pair == "x") & a.isNotNull() & b.isNotNull(), spec(F.nullif(a, F.lit(0)), F.nullif(b, F.lit(0)), none, none))
        .when(n.isNotNull(), spec(n, n, none, none))
    )


def human_size(size: Column) -> Column:
    """``1.5 KB``: whole bytes below 1024, else one decimal, rounded half to even."""
    out = None
    for power in range(len(PRINTED_UNITS) - 1, 0, -1):
        text = F.concat(F.format_string("%.1f", F.bround(size / F.lit(float(1024**power)), 1)), F.lit(" " + PRINTED_UNITS[power]))
        out = F.when(size >= 1024**power, text) if out is None else out.when(size >= 1024**power, text)
    return out.otherwise(F.concat(size.cast("string"), F.lit(" B")))


def version(text: Column) -> Column:
    """struct(major, minor, patch): what follows - or + is cut, what isn't a number is 0."""
    parts = F.split(F.regexp_extract(F.regexp_replace(text, "^v", ""), r"^([^+\-]*)", 1), r"\.")
    return F.struct(*[F.coalesce(F.get(parts, F.lit(i)).try_cast("long"), F.lit(0).cast("long")).alias(n) for i, n in enumerate(("major", "minor", "patch"))])


def is_newer(candidate: Column, current: Column) -> Column:
    return version(candidate) > version(current)


def saved_bytes(old: Column, new: Column) -> Column:
    return old - new


def saved_percent(old: Column, new: Column) -> Column:
    return F.when(old > 0, (old - new).cast("double") / old.cast("double") * 100).otherwise(0.0)


def improved(old: Column, new: Column) -> Column:
    return (new > 0) & (new < old)


def printed_percent(percent: Column) -> Column:
    return F.round(percent * 100) / 100


def suffix_characters(seed: Column, n: int = 6) -> Column:
    """``n`` characters of a-z and 0-9 that follow from the seed: the same file always gets the same suffix.

    Each comes from four digits of the seed's md5, modulo 36; eight to a digest, the next ones from that of the seed and a number.
    """
    alphabet = "abcdefghijklmnopqrstuvwxyz0123456789"
    digests = [F.md5(seed if not k else F.concat(seed, F.lit(f"#{k}"))) for k in range(-(-n // 8))]
    value = lambda i: F.conv(F.substring(digests[i // 8], i % 8 * 4 + 1, 4), 16, 10).cast("int") % 36
    return F.concat(*[F.substring(F.lit(alphabet), value(i) + 1, F.lit(1)) for i in range(n)])


def counter_uses(template: str) -> int:
    """How often a template asks for the counter."""
    return sum(token == "%i" for token in re.findall("%.", template, re.S))


def expand_template(template: str, path: Column, counter: Column, now: Column, home: str | None = None) -> Column:
    """A template's text for a path. ``counter`` is the number of the first ``%i``; later ones in it count on.

    %f stem, %e extension, %P folder, %y %m %d %H %M %S of ``now``, %i counter, %r six characters, %% a per cent sign;
    other pairs stay. ``~/`` in front is the home folder.
    """
    values = {
        "f": stem(path), "e": raw_extension(path), "P": parent(path), "r": suffix_characters(path), "%": F.lit("%"),
        **{k: F.date_format(now, p) for k, p in {"y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss"}.items()},
    }
    home = os.environ.get("HOME") if home is None else home
    if template.startswith("~/") and home:
        template, lead = template[1:], [F.lit(home)]
    else:
        lead = []
    parts, used = lead, 0
    for token in re.findall("%.|[^%]+|%$", template, re.S):
        if token == "%i":
            parts.append((counter + used).cast("string"))
            used += 1
        else:
            parts.append(values.get(token[1:], F.lit(token)) if token[0] == "%" and len(token) == 2 else F.lit(token))
    return F.concat(*parts) if parts else F.lit("")
