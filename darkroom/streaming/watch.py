"""Watching folders: debounce, skips, loop prevention, routing; over tables and over live streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.paths import in_folder, kind, skipped_by_watch
from ..operators.placement import stable
from ..operators.skew import with_earlier


def file_events(events: DataFrame) -> DataFrame:
    """Of ``events`` (event, is_file, ..) those of files that were made or written."""
    return events.where(F.col("event").isin("create", "modify") & F.col("is_file"))


def watchable(events: DataFrame) -> DataFrame:
    """Events of supported files that aren't hidden, backups or temporary."""
    return events.where(~skipped_by_watch(F.col("path")) & kind(F.col("path")).isNotNull())


def recorded(state: DataFrame, results: DataFrame) -> DataFrame:
    """``state`` (path, mtime) after ``results`` (path, mtime, output, output_mtime, error), one row a path.

    What was written in place is known by the output's time, what was written elsewhere by the source's. A failure
    changes nothing, so that the next event of the file tries it again.
    """
    mtime = F.when(F.col("output") == F.col("path"), F.coalesce("output_mtime", "mtime")).otherwise(F.col("mtime"))
    new = results.where("error IS NULL AND output IS NOT NULL").select("path", mtime.alias("mtime"))
    return state.join(new.select("path"), "path", "left_anti").select("path", "mtime").unionByName(new)


def due(events: DataFrame, state: DataFrame) -> DataFrame:
    """Events (path, mtime, ..) later than what ``state`` (path, mtime) knows of the path."""
    known = state.select("path", F.col("mtime").alias("_known"))
    return events.join(known, "path", "left").where("_known IS NULL OR mtime > _known").drop("_known")


def sample_key(content: Column, width: Column, height: Column) -> Column:
    """A short text that changes if a picture does: its sizes, and every 257th byte, 64 of them at most."""
    n = F.octet_length(content)
    places = F.sequence(F.lit(0), F.least(F.lit(63), F.floor((n - 1) / 257).cast("int")))
    sampled = F.when(n > 0, F.array_join(F.transform(places, lambda i: F.hex(F.substring(content, i * 257 + 1, F.lit(1)))), "")).otherwise("")
    return F.concat_ws("|", width.cast("string"), height.cast("string"), n.cast("string"), sampled)


def debounced(events: DataFrame, gap: str = "500 milliseconds", time: str = "event_time") -> DataFrame:
    """(start, end, path, n_events): the paths of each run of events of any path that no quiet time of ``gap`` breaks.

    The quiet time is global, as one channel has it. A run has a row for each of its paths and no array of them, and no task
    holds a whole run. For streams see ``state.QuietBatches``, which does the same over micro-batches, and ``timers.settled``.
    """
    by_path = by_session_and_path(events, gap, time)
    return by_path.join(by_path.groupBy("start").agg(_end(gap)), "start").select("start", "end", "path", F.col("n").alias("n_events"))


def debounced_counts(events: DataFrame, gap: str = "500 milliseconds", time: str = "event_time") -> DataFrame:
    """(start, end, n_events, n_paths, first_path) of the runs of a table, of any length: no task or array holds a whole run."""
    by_path = by_session_and_path(events, gap, time)
    return by_path.groupBy("start").agg(_end(gap), F.sum("n").alias("n_events"), F.count("path").alias("n_paths"), F.min("path").alias("first_path"))


def _end(gap: str) -> Column:
    return (F.max("last") + F.expr(f"INTERVAL '{gap}'")).alias("end")


def by_session_and_path(events: DataFrame, gap: str, time: str) -> DataFrame:
    """(start, path, n, last): the events of a path in the run that begins at ``start``, and the last one's time.

    Times are dealt by range; a part takes over the last time and the last start of those before it, so that no
    task sorts them all. Events without a time are left out.
    """
    at = F.col(time).alias("at")
    times = events.where(F.col(time).isNotNull()).select(at, "path").groupBy("at", "path").agg(F.count(F.lit(1)).alias("n"))
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stable(times.repartitionByRange(parts, "at", "path").sortWithinPartitions("at", "path")).withColumn("_seq", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_seq", 33))
    own = Window.partitionBy("_part").orderBy("_seq")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each part
    lasts = dealt.groupBy("_part").agg(F.max("at").alias("_last")).select("_part", F.max("_last").over(before).alias("_before"))
    previous = F.coalesce(F.lag("at").over(own), F.col("_before"))
    begun = F.when(previous.isNull() | (F.col("at") >= previous + F.expr(f"INTERVAL '{gap}'")), F.col("at"))
    begun = stable(dealt.join(F.broadcast(lasts), "_part").withColumn("_begun", begun).drop("_before"))
    starts = begun.groupBy("_part").agg(F.max("_begun").alias("_start")).select("_part", F.max("_start").over(before).alias("_open"))
    start = F.coalesce(F.last("_begun", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)), F.col("_open"))
    runs = begun.join(F.broadcast(starts), "_part").select(start.alias("start"), "at", "path", "n")
    return runs.groupBy("start", "path").agg(F.sum("n").alias("n"), F.max("at").alias("last"))


def unseen(events: DataFrame, time: str = "event_time") -> DataFrame:
    """Events whose mtime is later than every earlier one of the same path: what was written itself is not taken up again."""
    seen = with_earlier(events, "path", [time, "event_id"], "mtime", "_seen", largest=True)
    return seen.where("_seen IS NULL OR mtime > _seen").drop("_seen")


def type_matches(file_type: Column, of: Column) -> Column:
    """Unknown and empty types match everything."""
    return F.when(file_type.isin("image", "video", "audio", "pdf"), of == file_type).otherwise(F.lit(True))


def routed(events: DataFrame, targets: list[tuple[str, str, str]]) -> DataFrame:
    """``events`` (path) with ``target`` (its number) and ``pipeline`` of the first target that fits; others are dropped.

    ``targets``: (folder, type, pipeline) in their order, a short list that becomes a chain of conditions. A path is in a
    folder if the folder is a leading run of its components.
    """
    path = F.col("path")
    number = F.lit(None).cast("int")
    for i, (folder, file_type, _) in reversed(list(enumerate(targets))):
        fits = in_folder(path, F.lit(folder))
        fits = fits & (F.col("_kind") == file_type) if file_type in dims.KIND_EXTENSIONS else fits
        number = F.when(fits, i).otherwise(number)
    # the kind is found once for each row and the target from it, not anew for each target
    known = watchable(events).withColumn("_kind", kind(path)).withColumn("target", number).drop("_kind")
    chains = F.array(*[F.lit(dsl) for *_, dsl in targets]) if targets else F.array().cast("array<string>")
    return known.withColumn("pipeline", F.get(chains, F.col("target"))).where("target IS NOT NULL")


def changed(events: DataFrame, value: Column, key: str, order: list[str]) -> DataFrame:
    """Rows whose value differs from the one before them, with the same key: adjacent repeats go."""
    before = with_earlier(events.withColumn("_value", value), key, order, "_value", "_last")
    return before.where("_last IS NULL OR _value != _last").drop("_value", "_last")
