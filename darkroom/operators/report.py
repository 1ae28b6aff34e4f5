"""Result logs: status of rows, totals, the newest results, JSON, and progress."""

from __future__ import annotations

from pyspark import AccumulatorParam, TaskContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import improved, printed_percent, saved_bytes, saved_percent


def status(error: Column, old: Column, new: Column) -> Column:
    """failed, improved, or already optimal, which a file that grew is too."""
    return F.when(error.isNotNull(), "failed").when(improved(old, new), "improved").otherwise("already optimal")


def _totals() -> list[Column]:
    ok = F.col("error").isNull()
    old, new = F.coalesce(F.sum(F.when(ok, F.col("length"))), F.lit(0)), F.coalesce(F.sum(F.when(ok, F.col("new_size"))), F.lit(0))
    return [F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), old.cast("long").alias("total_old"), new.cast("long").alias("total_new")]


def _saved(totals: DataFrame) -> DataFrame:
    saved = F.greatest(F.col("total_old") - F.col("total_new"), F.lit(0).cast("long"))
    return totals.withColumn("saved", saved).withColumn("percent", F.when(F.col("total_old") > 0, F.col("saved").cast("double") / F.col("total_old") * 100).otherwise(0.0))


def summary(results: DataFrame) -> DataFrame:
    """One row of totals over results (length, new_size, error); sizes count successes alone."""
    return _saved(results.agg(*_totals()))


def summary_by(results: DataFrame, *keys: str) -> DataFrame:
    return _saved(results.groupBy(*keys).agg(*_totals()))


def observed(results: DataFrame, name: str = "progress") -> tuple[DataFrame, Observation]:
    """``results`` (error, ..) and a count of rows done and failed, which is there when they have been written."""
    seen = Observation(name)
    return results.observe(seen, F.count(F.lit(1)).alias("done"), F.count_if(F.col("error").isNotNull()).alias("failed")), seen


def newest(results: DataFrame, time: str, n: int = 50, tie: str = "path") -> DataFrame:
    """The ``n`` newest results, newest first."""
    return results.orderBy(F.desc(time), tie).limit(n)


def as_json(results: DataFrame) -> DataFrame:
    """(path, json): an object for each result; failures have source, ok and error alone."""
    old, new = F.col("length"), F.col("new_size")
    good = F.struct(
        F.col("path").alias("source"), F.col("output"), F.col("kind"), F.lit(True).alias("ok"), old.alias("old_size"), new.alias("new_size"), saved_bytes(old, new).alias("saved_bytes"),
        printed_percent(saved_percent(old, new)).alias("saved_percent"), F.col("aggressive"), improved(old, new).alias("improved"),
    )
    bad = F.struct(F.col("path").alias("source"), F.lit(False).alias("ok"), F.col("error"))
    return results.select("path", F.when(F.col("error").isNull(), F.to_json(good)).otherwise(F.to_json(bad)).alias("json"))


class _ByPartition(AccumulatorParam):
    """Counts of each partition; a partition that is computed again replaces its own."""

    def zero(self, value):
        return {}

    def addInPlace(self, a, b):
        a.update(b)
        return a


class Progress:
    """Counts of a run while it goes on: each task that ends adds a snapshot of its partition, which the driver can read at any time.

    ``watched`` passes results through and counts them. A task that is tried again, or whose partition is computed once more for another stage,
    counts once. One object serves one run.
    """

    def __init__(self, spark: SparkSession):
        self._counts = spark.sparkContext.accumulator({}, _ByPartition())

    def watched(self, results: DataFrame) -> DataFrame:
        """``results`` (error, ..) as they are."""
        at, counts = results.columns.index("error"), self._counts

        def run(batches):
            done = failed = 0
            for batch in batches:
                done += batch.num_rows
                failed += batch.num_rows - batch.column(at).null_count
                yield batch
            counts.add({TaskContext.get().partitionId(): (done, failed)})

        return results.mapInArrow(run, results.schema)

    def snapshot(self) -> dict[str, int]:
        """{parts, done, failed} so far."""
        counts = list(self._counts.value.values())
        return {"parts": len(counts), "done": sum(c[0] for c in counts), "failed": sum(c[1] for c in counts)}
