"""Joins on keys of which a few may have a large share of the rows: those are dealt over several tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .placement import stable

#: A key with more than 1 / HOT_KEYS of all rows, and more than HOT_ROWS, is hot, so that there are fewer such keys than HOT_KEYS.
HOT_KEYS, HOT_ROWS = 5_000, 200


def hot_keys(sizes: DataFrame, key: str) -> DataFrame | None:
    """(_hot, _salts): the hot keys of a table whose keys have the ``sizes`` (key, n), and over how many salts each is dealt.

    They come to the driver, fewer than HOT_KEYS whatever the size of the table; None if there are none.
    """
    total, most = sizes.agg(F.sum("n"), F.max("n")).first()
    part = max(HOT_ROWS, (total or 0) // HOT_KEYS)
    if not most or most <= part:
        return None
    rows = sizes.where(F.col("n") > part).select(F.col(key).alias("_hot"), F.ceil(F.col("n") / part).cast("long").alias("_salts"))
    return sizes.sparkSession.createDataFrame(rows.collect(), rows.schema)


def salted(large: DataFrame, key: str, spread: str, sizes: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(``large`` with a column _salt, hot keys): rows of hot keys are dealt over salts by a hash of ``spread``.

    ``sizes`` (key, n) has the rows of each key if they are known; else they are counted.
    """
    hot = hot_keys(large.groupBy(key).agg(F.count(F.lit(1)).alias("n")) if sizes is None else sizes, key)
    if hot is None:
        return large.withColumn("_salt", F.lit(0).cast("long")), None
    out = large.join(F.broadcast(hot), large[key] == hot["_hot"], "left")
    return out.withColumn("_salt", F.pmod(F.xxhash64(spread), F.coalesce("_salts", F.lit(1).cast("long")))).drop("_hot", "_salts"), hot


def per_salt(small: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """``small`` (a few rows a key) with each row once for every _salt of its key; ``hot`` as ``salted`` gave it."""
    if hot is None:
        return small.withColumn("_salt", F.lit(0).cast("long"))
    known = small.join(F.broadcast(hot), small[key] == hot["_hot"], "left")
    return known.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_salts", F.lit(1).cast("long")) - 1))).drop("_hot", "_salts")


def spread_join(large: DataFrame, small: DataFrame, key: str, spread: str, how: str = "inner", sizes: DataFrame | None = None) -> DataFrame:
    """``large`` joined with ``small``, which has a row or a few for each key, with hot keys dealt over several tasks."""
    dealt, hot = salted(large, key, spread, sizes)
    return large.join(small, key, how) if hot is None else dealt.join(per_salt(small, key, hot), [key, "_salt"], how).drop("_salt")


def with_earlier(rows: DataFrame, key: str, order: list[str], value: str, name: str, largest: bool = False) -> DataFrame:
    """``rows`` with ``name``: of the rows with the same ``key`` that come earlier in ``order`` the last one's ``value``, or the largest.

    As a window by key gives it, null keys together, but rows are dealt by range of key and order, so that a key with many rows
    lies in many parts. A part takes over from those before it what the keys at its ends need, a row for each part and key that goes on.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stable(rows.repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order)).withColumn("_seq", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_seq", 33))
    before = Window.partitionBy("_part", key).orderBy("_seq").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.max(value).over(before) if largest else F.last(value).over(before)
    ends = dealt.groupBy(key, "_part").agg((F.max(value) if largest else F.max_by(value, "_seq")).alias("_end"))
    several = ends.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")  # fewer than parts
    going_on = ends.join(F.broadcast(several), F.col(key).eqNullSafe(F.col("_key")))
    over = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = going_on.select("_key", F.col("_part").alias("_of"), (F.max("_end").over(over) if largest else F.last("_end").over(over)).alias("_carried"))
    met = dealt.withColumn("_inside", inside).withColumn("_first", F.row_number().over(Window.partitionBy("_part", key).orderBy("_seq")) == 1)
    met = met.join(F.broadcast(carried), (F.col("_part") == F.col("_of")) & F.col(key).eqNullSafe(F.col("_key")), "left")
    found = F.greatest("_inside", "_carried") if largest else F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_inside"))
    return met.withColumn(name, found).drop("_seq", "_part", "_inside", "_first", "_key", "_of", "_carried")
