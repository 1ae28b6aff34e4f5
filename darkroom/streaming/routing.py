"""Routing by a table of targets: equal keys instead of a condition for each target, so that there can be any number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import kind
from ..operators.placement import stable
from ..operators.skew import spread_join
from .watch import watchable


def bare_folder(folder: Column) -> Column:
    """A folder without slashes at its end; the root is empty."""
    return F.regexp_replace(folder, "/+$", "")


def ancestors(folder: Column) -> Column:
    """The folder itself and all above it, as ``bare_folder`` writes them; for an absolute one the root too."""
    parts = F.split(folder, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def routed_by_table(events: DataFrame, targets: DataFrame) -> DataFrame:
    """``events`` (path, ..) with ``target`` and ``pipeline`` of the least target that fits; others are dropped.

    ``targets`` is (target, folder, file_type, pipeline), as ``watch.routed`` takes them as a list: a target fits the files of its type (unknown types: all)
    whose path it leads, or is. Of targets with one number, folder and type the pipeline that sorts first counts. Null folders fit nothing.

    What fits depends on a file's folder and kind alone, so that these are matched first, each once: their ancestors meet the
    targets by equal folder. Events then meet their own folder and kind, and a folder with a large share of them is dealt over salts.
    """
    types = F.when(F.col("file_type").isin("image", "video", "audio", "pdf"), F.col("file_type"))
    least = targets.where("folder IS NOT NULL").select(bare_folder(F.col("folder")).alias("_folder"), types.alias("_type"), F.struct("target", "pipeline").alias("_target")).groupBy("_folder", "_type").agg(F.min("_target").alias("_target"))
    path = F.col("path")
    known = watchable(events).withColumn("_kind", kind(path)).withColumn("_key", F.concat_ws("|", "_kind", F.regexp_replace(path, "/[^/]*/*$", "")))
    folders = known.groupBy("_key").agg(F.first("_kind").alias("_kind"), F.count(F.lit(1)).alias("n"))
    folders = stable(folders.withColumn("_own", F.expr("substr(_key, length(_kind) + 2)")))
    above = folders.select("_key", "_kind", F.explode(ancestors(F.col("_own"))).alias("_folder"))
    fits = above.join(least, "_folder").where("_type IS NULL OR _type = _kind").groupBy("_key").agg(F.min("_target").alias("_in"))
    met = spread_join(known, fits, "_key", "path", "left", sizes=folders.select("_key", "n"))
    # a target that is the path itself and no folder: rare, and met by equal paths
    itself = least.select(F.col("_folder").alias("_path"), F.col("_type").alias("_of"), F.col("_target").alias("_is"))
    itself = itself.groupBy("_path").agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce("_of", F.lit("")), "_is"))).alias("_is"))
    met = met.join(itself, path == F.col("_path"), "left")
    found = F.least("_in", F.try_element_at("_is", F.lit("")), F.try_element_at("_is", F.col("_kind")))
    return met.withColumn("_found", found).where("_found IS NOT NULL").select(*events.columns, F.col("_found.target").alias("target"), F.col("_found.pipeline").alias("pipeline"))
