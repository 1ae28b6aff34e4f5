"""Names, extensions, kinds and backup names of paths, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dims


def file_name(path: Column) -> Column:
    """The last component; ``file`` if there is none."""
    base = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return F.when(base.isin("", "..", "."), "file").otherwise(base)


def parent(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"^(.*)/[^/]+/*$", 1), r"(?<=.)/+$", "")


def stem(path: Column) -> Column:
    """The name before its last dot; a leading dot alone starts no extension."""
    return F.regexp_replace(file_name(path), r"(?s)^(.+)\.[^.]*$", "$1")


def raw_extension(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r"(?s)^.+\.([^.]*)$", 1)


def extension(path: Column) -> Column:
    """Lower-cased, A-Z alone; empty if there is none."""
    return F.translate(raw_extension(path), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def kind_of_extension(ext: Column) -> Column:
    """image, video, audio, pdf or null."""
    kinds = [F.lit(x) for kind, exts in dims.KIND_EXTENSIONS.items() for e in exts for x in (e, kind)]
    return F.try_element_at(F.create_map(*kinds), ext)  # names its argument once, which may be long


def kind(path: Column) -> Column:
    return kind_of_extension(extension(path))


def optimisable(ext: Column) -> Column:
    """Whether there is an optimiser for files of that extension."""
    of = kind_of_extension(ext)
    return F.coalesce((of != "image") | ext.isin(dims.OPTIMISABLE_IMAGES), F.lit(False))


def parse_kind(name: Column) -> Column:
    """A kind's name in any case; image and video also in the plural."""
    low = F.lower(name)
    return F.when(low.isin("image", "images"), "image").when(low.isin("video", "videos"), "video").when(low == "audio", "audio").when(low == "pdf", "pdf")


def with_name(path: Column, name: Column) -> Column:
    folder = F.regexp_extract(path, r"^(.*/)[^/]+/*$", 1)
    return F.concat(folder, name)


def with_extension(path: Column, ext: Column) -> Column:
    return with_name(path, F.concat(stem(path), F.lit("."), ext))


def backup_name(path: Column) -> Column:
    """The hidden sibling that keeps an original: ``.name.orig``."""
    return with_name(path, F.concat(F.lit("."), file_name(path), F.lit(".orig")))


def original_of_backup(path: Column) -> Column:
    """The path that a backup restores; null if the name isn't a backup's."""
    inner = F.regexp_extract(file_name(path), r"(?s)^\.(.+)\.orig$", 1)
    return F.when(inner != "", with_name(path, inner))


def skipped_by_watch(path: Column) -> Column:
    """Hidden files, backups and temporary files."""
    name = file_name(path)
    return name.startswith(".") | name.endswith(".orig") | name.endswith("~")


def in_folder(path: Column, folder: Column) -> Column:
    """Whether a folder is the path or a leading run of its components."""
    bare = F.regexp_replace(folder, r"(?<=.)/+$", "")
    return (path == bare) | path.startswith(F.when(bare == "/", bare).otherwise(F.concat(bare, F.lit("/"))))
