"""Catalogues of media files: real ones from a file system, and one derived from the ``documents`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.paths import extension, kind, optimisable

#: Extensions of the derived catalogue: all known ones, then some that test the edges.
FIXTURE_EXTENSIONS = [e for exts in dims.KIND_EXTENSIONS.values() for e in exts] + ["txt", "PNG", "Jpg", "opus", "orig", ""]


def described(files: DataFrame) -> DataFrame:
    """``files`` with ext, kind and optimisable, from the path alone."""
    ext = extension(F.col("path"))
    return files.withColumns({"ext": ext, "kind": kind(F.col("path")), "optimisable": optimisable(ext)})


def collect(files: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Supported files, each path once, in the order of the path; ``kinds`` keeps some kinds only."""
    known = described(files).where("kind IS NOT NULL")
    chosen = known.where(F.col("kind").isin(kinds)) if kinds else known
    return chosen.dropDuplicates(["path"]).orderBy("path")


def scan(spark: SparkSession, folder: str, recursive: bool = True, kinds: list[str] | None = None, content: bool = False) -> DataFrame:
    """(path, modificationTime, length[, content], ext, kind, optimisable) of the files below a folder.

    Spark's file source reads the content only if it is asked for, and pushes down filters on length and time. It
    leaves out names that start with a dot or an underscore; ``sources.listing`` lists those too.
    """
    read = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return collect(read if content else read.drop("content"), kinds)


def decoded(spark: SparkSession, folder: str) -> DataFrame:
    """(path, width, height, nChannels, mode, data) of pictures that Spark's image source reads; others are left out."""
    return spark.read.format("image").option("dropInvalid", True).load(folder).select(F.col("image.origin").alias("path"), "image.width", "image.height", "image.nChannels", "image.mode", "image.data")


def fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A media catalogue in integer arithmetic from ``documents``: file_id, path, length, width, height, has_alpha, factor."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "n_chars")
    ext = F.get(F.array(*map(F.lit, FIXTURE_EXTENSIONS)), (F.col("doc_id") % len(FIXTURE_EXTENSIONS)).cast("int"))
    name = F.concat(F.when(F.col("doc_id") % 17 == 0, ".").otherwise(""), F.lit("doc"), F.col("doc_id").cast("string"), F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext)))
    return docs.select(
        F.col("doc_id").alias("file_id"), F.concat(F.lit("/vault/"), F.col("source"), F.lit("/"), name).alias("path"), F.col("n_chars").alias("length"),
        (16 + (F.col("doc_id") * 37) % 4000).cast("int").alias("width"), (16 + (F.col("doc_id") * 91) % 3000).cast("int").alias("height"),
        ((F.lower(ext) == "png") & (F.floor(F.col("doc_id") / len(FIXTURE_EXTENSIONS)) % 2 == 0)).alias("has_alpha"), (F.col("doc_id") % 101).cast("int").alias("factor"),
    )


def png_header(content) -> dict:
    """Columns width, height and has_alpha of PNG bytes; the width and height are null unless the signature stands."""
    png = F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A"

    def number(at: int):
        return F.when(png & (F.length(content) >= at + 3), F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int"))

    color = F.conv(F.hex(F.substring(content, 26, 1)), 16, 10).cast("int")
    return {"width": number(17), "height": number(21), "has_alpha": F.coalesce((F.length(content) >= 26) & color.isin(4, 6), F.lit(False))}
