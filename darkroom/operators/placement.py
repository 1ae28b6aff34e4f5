"""Where results go: output paths, backups and what restores them. Everything is a plan; nothing is moved here."""

from __future__ import annotations

import os
import shutil
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.paths import backup_name, extension, file_name, original_of_backup, stem, with_extension, with_name
from ..functions.text import counter_uses, expand_template


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; a local session without one gets a temporary folder."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder, local = context.getConf().get("spark.checkpoint.dir"), context.master == "local" or context.master.startswith("local[")
        if not folder and not local:
            raise ValueError(f"spark.checkpoint.dir is not set, and {context.master} needs a folder that all executors share")
        context.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="darkroom-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def stable(df: DataFrame) -> DataFrame:
    """``df`` computed once, in the folder of spark.checkpoint.dir: its partitions and order then stay as they are."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def numbered(files: DataFrame, first: int = 1, order: str = "path") -> DataFrame:
    """``files`` with ``ordinal``: consecutive numbers in the order of the path or another column.

    A range partitioning and per-partition counts number any amount of rows; no task sorts them all.
    """
    ordered = stable(files.repartitionByRange(F.col(order)).sortWithinPartitions(order)).withColumn("_seq", F.monotonically_increasing_id())
    part = F.shiftright(F.col("_seq"), 33).alias("_part")
    counts = ordered.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each partition
    return (
        ordered.withColumn("_part", F.shiftright(F.col("_seq"), 33)).join(F.broadcast(before), "_part")
        .withColumn("ordinal", (F.col("_before") + F.col("_seq").bitwiseAND((1 << 33) - 1) + first).cast("long")).drop("_seq", "_part", "_before", "_n")
    )


def resolved_output(files: DataFrame, output: str | None, is_folder: bool, now: Column, home: str | None = None, single: bool = False) -> DataFrame:
    """``files`` with ``output``: an expanded template, a place in an existing folder, the path itself for one file, or null.

    A plain path for several files is an error rather than silently in place.
    """
    if output is None:
        return files.withColumn("output", F.lit(None).cast("string"))
    if "%" in output:
        uses = counter_uses(output)
        rows = numbered(files, 0) if uses else files.withColumn("ordinal", F.lit(0).cast("long"))
        return rows.withColumn("output", expand_template(output, F.col("path"), F.col("ordinal") * uses + 1, now, home)).drop("ordinal")
    if is_folder:
        return files.withColumn("output", F.concat(F.lit(output.rstrip("/") + "/"), file_name(F.col("path"))))
    if single:
        return files.withColumn("output", F.lit(output))
    raise ValueError("one output file was named for several inputs")


def placed(source: Column, output: Column, kind: Column, target_ext: Column) -> Column:
    """struct(dest, replaces): the output, else the source with the target's extension for video and audio.

    ``replaces`` says that the result stands for the source; whether the source then goes is left to the caller.
    """
    moved = kind.isin("video", "audio") & (extension(source) != target_ext)
    dest = F.coalesce(output, F.when(moved, with_extension(source, target_ext)).otherwise(source))
    return F.struct(dest.alias("dest"), output.isNull().alias("replaces"))


def pipeline_placed(source: Column, output: Column, final_ext: Column) -> Column:
    """struct(dest, backup): the output, else in place with a backup if the extension stays, else alongside."""
    stays = extension(source) == final_ext
    dest = F.coalesce(output, F.when(stays, source).otherwise(with_extension(source, final_ext)))
    return F.struct(dest.alias("dest"), F.when(output.isNull() & stays, backup_name(source)).alias("backup"))


def pdf_output(source: Column, suffix: Column) -> Column:
    """``stem + suffix.pdf`` beside the source, or the source itself without a suffix."""
    return F.when(suffix.isNull(), source).otherwise(with_name(source, F.concat(stem(source), suffix, F.lit(".pdf"))))


def backups_to_make(files: DataFrame, existing: DataFrame) -> DataFrame:
    """(path, backup) of ``files`` that have no backup among ``existing`` (path): the first original stays."""
    wanted = files.select("path", backup_name(F.col("path")).alias("backup")).distinct()
    return wanted.join(existing.select(F.col("path").alias("backup")), "backup", "left_anti").select("path", "backup")


def restore_pairs(listed: DataFrame) -> DataFrame:
    """(backup, original) for each backup among ``listed`` (path), and for each listed file whose backup is listed."""
    own = listed.select(F.col("path").alias("backup"), original_of_backup(F.col("path")).alias("original")).where("original IS NOT NULL")
    return own.distinct()


def backups_of(files: DataFrame, listed: DataFrame) -> DataFrame:
    """(backup, original) of given files, for those whose backup exists among ``listed`` (path)."""
    named = files.select(backup_name(F.col("path")).alias("backup"), F.col("path").alias("original")).distinct()
    return named.join(listed.select(F.col("path").alias("backup")), "backup", "left_semi")


def _applied(rows: DataFrame, columns: list[str], act) -> DataFrame:
    """(path, error) of each row after ``act`` on its columns. Each action may run again and then finds its work done."""

    def run(batches):
        for batch in batches:
            paths, errors = [], []
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                paths.append(values[0])
                try:
                    act(*values)
                    errors.append(None)
                except OSError as e:
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(errors, pa.string())], ["path", "error"])

    return rows.select(*columns).mapInArrow(run, "path string, error string")


def apply_backups(plan: DataFrame) -> DataFrame:
    """Copies ``path`` to ``backup`` unless that is there: the first original stays."""

    def act(path, backup):
        if not os.path.exists(backup):
            shutil.copy2(path, backup + ".part")
            os.replace(backup + ".part", backup)

    return _applied(plan, ["path", "backup"], act)


def apply_restores(pairs: DataFrame) -> DataFrame:
    """Moves ``backup`` over ``original``; done already if only the original is left."""

    def act(backup, original):
        if os.path.exists(backup) or not os.path.exists(original):
            os.replace(backup, original)

    return _applied(pairs, ["backup", "original"], act)


def apply_cleaning(pairs: DataFrame) -> DataFrame:
    """Deletes backups."""

    def act(backup):
        if os.path.exists(backup):
            os.remove(backup)

    return _applied(pairs, ["backup"], act)


def apply_writes(results: DataFrame, keep_times: bool = True) -> DataFrame:
    """Writes ``content`` to ``dest`` through a part file, with the time of ``path`` if that is kept."""

    def act(dest, content, path):
        part = f"{dest}.part"
        with open(part, "wb") as f:
            f.write(content)
        if keep_times and os.path.exists(path):
            s = os.stat(path)
            os.utime(part, ns=(s.st_atime_ns, s.st_mtime_ns))
        os.replace(part, dest)

    return _applied(results, ["dest", "content", "path"], act)
