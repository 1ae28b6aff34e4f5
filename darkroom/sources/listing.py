"""Listing trees of folders level by level on executors, and what has changed since the last listing.

The driver walks nothing: the folders of a level are a table, tasks list them, and the folders found are the next level. Names are
listed and files looked at in different tasks, so that one large folder is no single task's work beyond its names.
Folders are paths that every executor can open, such as a mounted share.
"""

from __future__ import annotations

import os
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.placement import stable
from ..streaming.state import Folders

FILES = "path string, length long, mtime timestamp"


def _names(batches):
    """(path, is_folder) of what lies in each folder; a folder that is gone or closed to us has nothing. Links to folders aren't followed."""
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            paths, kinds = [], []
            try:
                with os.scandir(folder) as entries:
                    for e in entries:
                        below = e.is_dir(follow_symlinks=False)
                        if below or e.is_file():
                            paths.append(e.path)
                            kinds.append(below)
                        if len(paths) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(kinds, pa.bool_())], ["path", "is_folder"])
                            paths, kinds = [], []
            except OSError:
                pass
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(kinds, pa.bool_())], ["path", "is_folder"])


def _looked_at(batches):
    for batch in batches:
        rows = []
        for path in batch.column(0).to_pylist():
            try:
                s = os.stat(path)
            except OSError:  # gone meanwhile
                continue
            rows.append((path, s.st_size, datetime.fromtimestamp(s.st_mtime_ns // 1000 / 1e6, timezone.utc)))
        columns = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.timestamp("us", tz="UTC"))], ["path", "length", "mtime"])


def tree(roots: DataFrame, recursive: bool = True, parts: int | None = None) -> DataFrame:
    """FILES of all files below ``roots`` (path), hidden ones too, each once; as many rounds as the tree is deep."""
    spark = roots.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    level, files = roots.select(F.regexp_replace("path", r"(?<=.)/+$", "").alias("path")).distinct(), None
    while True:
        found = stable(level.repartition(parts, "path").mapInArrow(_names, "path string, is_folder boolean"))
        own = found.where("NOT is_folder").select("path")
        files = own if files is None else files.unionByName(own)
        level = found.where("is_folder").select("path")
        if not recursive or level.isEmpty():
            break
    return files.distinct().repartition(parts, "path").mapInArrow(_looked_at, FILES)


def changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """FILES and ``event``: ``create`` for paths that ``before`` hasn't, ``modify`` for those with another time or length there."""
    old = before.select("path", F.col("length").alias("_length"), F.col("mtime").alias("_mtime"))
    met = now.join(old, "path", "left")
    event = F.when(F.col("_length").isNull(), "create").when((F.col("_length") != F.col("length")) | (F.col("_mtime") != F.col("mtime")), "modify")
    return met.withColumn("event", event).where("event IS NOT NULL").select("path", "length", "mtime", "event")


def removed(now: DataFrame, before: DataFrame) -> DataFrame:
    """FILES that ``before`` has and ``now`` hasn't."""
    return before.join(now.select("path"), "path", "left_anti")


class Snapshots:
    """Listings by number in a shared folder. A change is told by comparing a listing with the one before it, so that a
    file that was moved or copied in with an old time is new like others."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folders = spark, Folders(spark, folder)

    def step(self, roots: DataFrame, number: int, recursive: bool = True) -> DataFrame:
        """Lists ``roots`` (path) as snapshot ``number``, and gives the changes since the last one before it.

        A number that comes again, as after a crash, is listed anew and compared with the same one before it, so that no change is lost.
        """
        found = self.folders.all()
        before = [x for x in found if x[1] < number]
        self.folders.remove(before[:-1])
        tree(roots, recursive).write.parquet(self.folders.new("files", number))
        at = [x for x in self.folders.all() if x[1] == number][-1]
        now = self.spark.read.schema(FILES).parquet(self.folders.at(*at))
        old = self.spark.read.schema(FILES).parquet(self.folders.at(*before[-1])) if before else self.spark.createDataFrame([], FILES)
        return changes(now, old)


def start(spark: SparkSession, roots: list[str], handle, folder: str, checkpoint: str, every: str = "1 second", recursive: bool = True):
    """Starts listing ``roots`` again and again; ``handle`` gets each time's changes and its number. stop() ends it."""
    snapshots, table = Snapshots(spark, folder), spark.createDataFrame([(r,) for r in roots], "path string")
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(lambda _, number: handle(snapshots.step(table, number, recursive), number)).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def watch(spark: SparkSession, roots: list[str], route, handle, folder: str, checkpoint: str, every: str = "1 second", recursive: bool = True):
    """Listing, state and routing in one: as ``state.start``, with the changes of folders as events."""
    from ..streaming.state import DoneFiles

    done = DoneFiles(spark, f"{folder}/done")

    def work(found: DataFrame, number: int) -> None:
        done.add(handle(route(done.due(found)), number), number)

    return start(spark, roots, work, f"{folder}/snapshots", checkpoint, every, recursive)


def heads(files: DataFrame, n: int = 1 << 16) -> DataFrame:
    """``files`` (path, ..) with ``head``: the first ``n`` bytes of each; null if a file can't be read. No more than these is read."""
    schema = files.select("*", F.lit(None).cast("binary").alias("head")).schema
    at = files.columns.index("path")

    def read(path: str | None) -> bytes | None:
        try:
            with open(path.removeprefix("file://") if path else "", "rb") as f:
                return f.read(n)
        except OSError:
            return None

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([read(p) for p in part.column(at).to_pylist()], pa.binary())], schema=None, names=[*part.schema.names, "head"])

    return files.mapInArrow(run, schema)
