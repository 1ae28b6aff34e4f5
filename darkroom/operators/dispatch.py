"""Optimising files of all kinds: each goes to its kind's operator, and the results come back in one log, in input order."""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.catalog import described
from . import images, pdf

RESULT = "ord long, path string, kind string, old_size long, new_size long, content binary, error string"
#: Extensions that are read and written here; the others need external encoders (``operators.external``).
HERE = ["png", "bmp", "pdf"]


def optimise_files(files: DataFrame, factor: int = 30, allow_larger: bool = False) -> DataFrame:
    """(ord, path, kind, old_size, new_size, content, error) of ``files`` (ord, path, content).

    A path without a kind gives the error that it is unsupported, and one that needs an external encoder says so, both as
    columns. A result that is empty or not smaller leaves the source unless ``allow_larger``. ``ord`` is the place in
    the input, which ``in_order`` sorts by; a null content is an error row.
    """
    known = described(files.select("ord", "path", "content"))
    here = F.col("ext").isin(HERE) & F.col("content").isNotNull()
    error = (
        F.when(F.col("kind").isNull() | ~F.col("optimisable"), F.concat(F.lit("unsupported file: "), F.col("path")))
        .when(F.col("content").isNull(), F.concat(F.col("path"), F.lit(": no content"))).otherwise(F.concat(F.col("path"), F.lit(": "), F.col("ext"), F.lit(" needs an external encoder")))
    )
    none = F.lit(None)
    failed = known.where(~here).select("ord", "path", "kind", F.octet_length("content").cast("long").alias("old_size"), none.cast("long").alias("new_size"), none.cast("binary").alias("content"), error.alias("error"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                data, error = row["content"], None
                try:
                    new = pdf.recompressed(data) if row["kind"] == "pdf" else images.optimised(data, factor)
                    new = new if allow_larger or 0 < len(new) < len(data) else data
                except (ValueError, KeyError, zlib.error, struct.error) as e:
                    new, error = None, f"{row['path']}: {e}"
                yield pa.RecordBatch.from_pydict({"ord": pa.array([row["ord"]], pa.int64()), "path": [row["path"]], "kind": [row["kind"]], "old_size": pa.array([len(data)], pa.int64()), "new_size": pa.array([None if new is None else len(new)], pa.int64()), "content": pa.array([new], pa.binary()), "error": pa.array([error], pa.string())})

    done = known.where(here).select(F.col("ord").cast("long").alias("ord"), "path", "kind", "content").mapInArrow(run, RESULT)
    return done.unionByName(failed.withColumn("ord", F.col("ord").cast("long")))


def in_order(results: DataFrame) -> DataFrame:
    """Results as their files stood in the input."""
    return results.orderBy("ord")
