"""State of a watch as versioned tables in a shared folder: what a batch has done is known by the batch's number.

A batch adds folders of its own and never changes another one's. A folder counts once it is whole (``_SUCCESS``), so that
a batch that is broken off and comes again, as it does after a crash, finds either nothing of its own or all of an earlier try.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .watch import by_session_and_path

BUCKETS = 64
RESULTS = "path string, mtime timestamp, output string, output_mtime timestamp, error string"


class Folders:
    """Folders named ``kind-batch-try`` below one folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def all(self, whole: bool = True) -> list[tuple[str, int, int]]:
        """(kind, batch, try), by batch and try; a few dozen, since old ones go."""
        root = self._path(self.folder)
        if not self._fs.exists(root):
            return []
        found = [re.fullmatch(r"([a-z]+)-(\d+)-(\d+)", s.getPath().getName()) for s in self._fs.listStatus(root)]
        named = sorted(((m[1], int(m[2]), int(m[3])) for m in found if m), key=lambda x: (x[1], x[2], x[0]))
        return [x for x in named if not whole or self._fs.exists(self._path(f"{self.at(*x)}/_SUCCESS"))]

    def at(self, kind: str, batch: int, attempt: int) -> str:
        return f"{self.folder}/{kind}-{batch:012d}-{attempt:04d}"

    def new(self, kind: str, batch: int) -> str:
        return self.at(kind, batch, 1 + max([0, *(a for k, b, a in self.all(whole=False) if (k, b) == (kind, batch))]))

    def remove(self, folders) -> None:
        for x in folders:
            self._fs.delete(self._path(self.at(*x)), True)


class DoneFiles:
    """What has been done with each file, over all batches: the live form of ``watch.recorded`` and ``watch.due``.

    ``add`` writes a batch's results beside those of other batches, or of an earlier try of the same one. ``known`` is each path's time
    from its last success: that of the output if it was written in place, else the file's. A failure is kept
    as a row, but is no knowledge, so that the file's next event is due. After ``merge_after`` batches those before the last one, which alone can come
    again, are merged into one table, by path; the tables merged stay until the next time, for readers that still have them open.
    """

    def __init__(self, spark: SparkSession, folder: str, merge_after: int = 20):
        self.folders, self.spark, self.merge_after = Folders(spark, folder), spark, merge_after

    def _rows(self, folders, columns: str) -> DataFrame:
        out = self.spark.createDataFrame([], f"{columns}, bucket int, batch long, try int")
        for x in folders:
            part = self.spark.read.schema(f"{columns}, bucket int").parquet(self.folders.at(*x))
            out = out.unionByName(part.withColumns({"batch": F.lit(x[1]).cast("long"), "try": F.lit(x[2])}))
        return out

    def results(self) -> DataFrame:
        """Results of the batches that aren't merged yet, failures too: RESULTS, batch and try."""
        return self._rows([x for x in self.folders.all() if x[0] == "done"], RESULTS).drop("bucket")

    def known(self, upto: int | None = None) -> DataFrame:
        """(path, mtime, bucket), one row a path; ``upto``: after that batch."""
        found = [x for x in self.folders.all() if upto is None or x[1] <= upto]
        merged = [x for x in found if x[0] == "known"][-1:]
        new = self._rows([x for x in found if x[0] == "done" and (not merged or x[1] > merged[0][1])], RESULTS)
        mtime = F.when(F.col("output") == F.col("path"), F.coalesce("output_mtime", "mtime")).otherwise(F.col("mtime"))
        new = new.where("error IS NULL AND output IS NOT NULL").withColumn("mtime", mtime).select("path", "mtime", "bucket", "batch", "try")
        both = self._rows(merged, "path string, mtime timestamp").select("path", "mtime", "bucket", "batch", "try").unionByName(new)
        last = F.max(F.struct("batch", "try", "mtime")).getField("mtime").alias("mtime")
        return both.groupBy("bucket", "path").agg(last).select("path", "mtime", "bucket")

    def due(self, events: DataFrame) -> DataFrame:
        """Events later than what is known of their path. Both sides are dealt by bucket and path."""
        known = self.known().select(F.col("path").alias("_path"), F.col("mtime").alias("_known"), F.col("bucket").alias("_bucket"))
        rows = events.withColumn("_own", _bucket(F.col("path")))
        met = rows.join(known, (F.col("_own") == F.col("_bucket")) & (F.col("path") == F.col("_path")), "left")
        return met.where("_known IS NULL OR mtime > _known").drop("_path", "_known", "_bucket", "_own")

    def add(self, results: DataFrame, batch: int) -> None:
        """Writes ``results`` (RESULTS, one row a path); that computes them, once."""
        names = [c.split()[0] for c in RESULTS.split(", ")]
        rows = results.select(*names).withColumn("bucket", _bucket(F.col("path")))
        # one task a bucket, else every task would write a file of its own for each
        rows.repartition("bucket").write.partitionBy("bucket").parquet(self.folders.new("done", batch))
        found = [x for x in self.folders.all() if x[1] < batch]
        merged = [x for x in found if x[0] == "known"]
        if len({b for k, b, _ in found if k == "done" and (not merged or b > merged[-1][1])}) > self.merge_after:
            upto = max(b for k, b, _ in found if k == "done")
            self.known(upto).repartition("bucket").write.partitionBy("bucket").parquet(self.folders.new("known", upto))
            self.folders.remove(x for x in found if merged and x[1] <= merged[-1][1])


def _bucket(path: Column) -> Column:
    return F.pmod(F.hash(path), F.lit(BUCKETS))


class QuietBatches:
    """Batches of events between quiet times, over micro-batches: the live form of ``watch.debounced``.

    Events that no quiet time has ended yet are a table, from which with a micro-batch's own events runs are found as on any
    table: dealt by range of time, no key and no array for a whole run. Each micro-batch writes the next version of that table; one that
    comes again starts from the version before it, and gives the same batches again.
    """

    def __init__(self, spark: SparkSession, folder: str, gap: str = "500 milliseconds"):
        self.folders, self.spark, self.gap = Folders(spark, folder), spark, gap

    def step(self, events: DataFrame, batch: int, now: Column | None = None, delay: str = "0 seconds") -> DataFrame:
        """(start, end, path, n_events) of the runs that are over at ``now``, by default the latest event's time less ``delay``.

        ``events`` is (path, event_time); rows without a time say nothing. An event later than a whole ``gap`` after its run was
        given out begins another one.
        """
        found = [x for x in self.folders.all() if x[1] < batch]
        before = [x for x in found if x[0] == "pending"]
        schema = "path string, event_time timestamp"
        pending = self.spark.read.schema(schema).parquet(self.folders.at(*before[-1])) if before else self.spark.createDataFrame([], schema)
        every = pending.unionByName(events.where("event_time IS NOT NULL").select("path", F.col("event_time").cast("timestamp").alias("event_time")))
        kept = self.folders.new("events", batch)
        every.write.parquet(kept)  # read several times, and the source only once
        every = self.spark.read.schema(schema).parquet(kept)
        by_path = by_session_and_path(every, self.gap, "event_time")
        runs = by_path.groupBy("start").agg((F.max("last") + F.expr(f"INTERVAL '{self.gap}'")).alias("end"))
        latest = every.agg(F.unix_micros(F.max("event_time") - F.expr(f"INTERVAL '{delay}'"))) if now is None else self.spark.range(1).select(F.unix_micros(now.cast("timestamp")))
        over = F.unix_micros("end") <= F.lit(latest.first()[0]).cast("long")
        open_from = runs.where(~over).agg(F.min(F.unix_micros("start"))).first()[0]  # what is over is all before what isn't
        left = every.where(F.lit(False) if open_from is None else F.unix_micros("event_time") >= open_from)
        left.write.parquet(self.folders.new("pending", batch))
        self.folders.remove(x for x in found if x not in before[-1:])
        return by_path.join(runs.where(over), "start").select("start", "end", "path", F.col("n").alias("n_events"))


def start(events: DataFrame, route, handle, folder: str, checkpoint: str):
    """Starts the watch: files that changed since they were last done go to ``handle``, batch by batch; stop() ends it.

    ``route`` gives events their targets and drops others, such as ``lambda e: watch.routed(e, targets)`` does. ``handle`` takes (path,
    mtime, target, pipeline, ..) and the batch's number, and returns their results as RESULTS has them; these are computed
    when they are written. Of a path's events in a batch the latest counts. A file that fails comes again with its next
    event, the others don't; what was written in place doesn't come again for that. After a crash the last batch is repeated: files whose results
    were written are not done again, others are.
    """
    done = DoneFiles(events.sparkSession, folder)

    def work(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c not in ("path", "mtime")]
        last = batch.groupBy("path").agg(F.max(F.struct("mtime", *rest)).alias("_last")).select("path", "_last.*")
        done.add(handle(route(done.due(last)), number), number)

    return events.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).start()


def start_quiet(events: DataFrame, handle, folder: str, checkpoint: str, gap: str = "500 milliseconds", beat: str | None = "1 second"):
    """Starts a stream that hands each run of events between two quiet times of ``gap`` to ``handle`` (a table as ``QuietBatches.step`` gives it, number).

    With a ``beat`` a clock's rows keep the stream going while nothing happens, and a run ends by the clock; without
    one it ends when a later event comes. Events have (path, event_time).
    """
    quiet = QuietBatches(events.sparkSession, folder, gap)
    own = events.select("path", F.col("event_time").cast("timestamp").alias("event_time"))
    if beat:
        clock = events.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load()
        own = own.unionByName(clock.select(F.lit(None).cast("string").alias("path"), F.lit(None).cast("timestamp").alias("event_time")))

    def work(batch: DataFrame, number: int) -> None:
        handle(quiet.step(batch, number, F.current_timestamp() if beat else None), number)

    stream = own.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (stream.trigger(processingTime=beat) if beat else stream).start()

