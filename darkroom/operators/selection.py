"""Choosing among encodings of a file: size guards, a byte budget, the smallest format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims


def stub_size(length: Column) -> Column:
    """The size that the test codec gives: half and one byte, never more than before."""
    return F.least(length, F.floor(length / 2) + 1).cast("long")


def model_size(length: Column, factor: Column) -> Column:
    """A made-up size that falls as the factor rises; it stands for no real encoder."""
    return F.floor(length * (110 - factor) / 100).cast("long")


def guarded_size(old: Column, new: Column, allow_larger: Column) -> Column:
    """The new size, or the old one if the result is empty or not smaller and that isn't allowed."""
    return F.when(~allow_larger & ((new == 0) | (new >= old)), old).otherwise(new)


def guard_applies(kind: Column, source_ext: Column, target_ext: Column) -> Column:
    """Whether a kind's size guard is on: for video if the source is mp4, for audio if the format stays."""
    return F.when(kind == "video", source_ext == "mp4").when(kind == "audio", source_ext == target_ext).otherwise(kind.isin("image", "pdf"))


def kept_original(kind: Column, source_ext: Column, target_ext: Column, old: Column, new: Column, allow_larger: Column) -> Column:
    """Whether the source stays. An empty video passes its guard."""
    useless = F.when(kind == "video", (new != 0) & (new >= old)).otherwise((new == 0) | (new >= old))
    return guard_applies(kind, source_ext, target_ext) & ~allow_larger & useless


def budget_choice(length: Column, budget: Column, size_of=model_size) -> Column:
    """struct(factor, size, fits): the first factor whose size is within the budget, else the smallest, the first of equals.

    The few factors are an array in the row: there is no join and no shuffle.
    """
    sizes = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f).alias("factor"), size_of(length, F.lit(f)).alias("size")) for i, f in enumerate(dims.BUDGET_FACTORS)])
    fitting = F.filter(sizes, lambda s: s["size"] <= budget)
    smallest = F.array_min(F.transform(sizes, lambda s: F.struct(s["size"].alias("size"), s["i"].alias("i"), s["factor"].alias("factor"))))
    first = F.get(fitting, F.lit(0))
    return F.struct(F.coalesce(first["factor"], smallest["factor"]).alias("factor"), F.coalesce(first["size"], smallest["size"]).alias("size"), (F.size(fitting) > 0).alias("fits"))


def adaptive_choice(ext: Column, has_alpha: Column, old: Column, sizes: dict[str, Column]) -> Column:
    """struct(format, size): the smallest of the same format, jpeg and png (without jpeg if there is alpha), or the source.

    ``sizes``: columns by "same", "jpeg", "png"; null or 0 is a failed try. The first of equals wins, and a winner that
    isn't smaller than the source leaves the source.
    """
    tries = F.array(*[F.struct(sizes[f].alias("size"), F.lit(i).alias("i"), F.lit(f).alias("format")) for i, f in enumerate(("same", "jpeg", "png"))])
    best = F.array_min(F.filter(tries, lambda t: (t["size"] > 0) & ((t["format"] != "jpeg") | ~has_alpha)))
    won = F.coalesce(best["size"] < old, F.lit(False))
    fmt = F.when(best["format"] == "same", ext).when(best["format"] == "jpeg", "jpg").otherwise("png")
    return F.struct(F.when(won, fmt).otherwise(ext).alias("format"), F.when(won, best["size"]).otherwise(old).alias("size"))


def mode_of(max_size: Column, adaptive: Column, kind: Column) -> Column:
    """A budget goes before the adaptive search, which is for images, and that before the plain one."""
    return F.when(max_size.isNotNull(), "budget").when(adaptive & (kind == "image"), "adaptive").otherwise("plain")


def with_optimised(files: DataFrame) -> DataFrame:
    """``files`` (described, length) with new_size by the test codec and the size guard; null for unsupported files."""
    new = F.when(F.col("optimisable"), guarded_size(F.col("length"), stub_size(F.col("length")), F.lit(False)))
    return files.withColumns({"new_size": new, "error": F.when(~F.col("optimisable"), F.concat(F.lit("unsupported file: "), F.col("path")))})
