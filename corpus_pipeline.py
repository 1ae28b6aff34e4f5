"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and returns a DataFrame.

Every stage but the last returns the rows it keeps with all columns of ``documents``, whatever these are. All judge
rows and not ids: the first two by a row's text, the next two by a number that each row is given, so that a row with a
null id or one that shares its id with others is kept or dropped for its own text. Between stages the rows are
written as Parquet in the shared folder and read again. Empty tables stay empty.
"""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from darkroom.llm.common import scratch, spread_join, work_path, written
from darkroom.llm.queries import tokenizer_path


def _released(spark: SparkSession) -> None:
    """What earlier stages' plans, broadcasts and shuffles hold on the driver goes before the next stage adds its own. Spark asks
    for that by itself only each spark.cleaner.periodicGC.interval, half an hour."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number for each row, written so that it stays the same, and the name of its column."""
    name = "row_number"
    while name in docs.columns:
        name += "_"
    return written(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def _without(docs: DataFrame, number: str, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ``number`` is in ``dropped`` (doc_id), and without that column."""
    gone = written(dropped.select(F.col("doc_id").alias("dropped_number")), "dropped")
    return docs.join(gone, docs[number] == gone["dropped_number"], "left_anti").drop(number)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier takes for good ones: a score of 0.7 or more. Null texts are judged as empty ones, repeated rows alike."""
    from darkroom.llm.quality_classifier import keep_good

    _released(spark)
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.7)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the fixed limits and aren't odd; null and empty texts fail them, repeated rows are judged alike."""
    from darkroom.llm.quality_rules import keep_sound

    _released(spark)
    return keep_sound(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id, null ids last; of equal ids the first written one.

    Texts without words are in no group and stay.
    """
    from darkroom.llm.near_dedup import near_duplicates

    _released(spark)
    docs, number = _numbered(docs)
    groups = near_duplicates(docs, width=5, percent=75, id_col=number).select(F.col("doc_id").alias("member"), F.col("component_id").alias("component"), "kept")
    groups = written(groups, "components")
    several = groups.where("NOT kept").select("component").distinct()
    members = written(spread_join(groups, several, "component", "member", "left_semi"), "members")  # a group may have a large share of the rows
    ids = docs.select(F.col("doc_id").cast("long").alias("id"), F.col(number).alias("member"))
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "member")
    stays = members.join(ids, "member").groupBy("component").agg(F.min(order).alias("first")).select(F.col("first.member").alias("member"))
    return _without(docs, number, members.join(stays, "member", "left_anti").select(F.col("member").alias("doc_id")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no window of ten words of a benchmark item; null and empty texts hold none, of repeated rows all stay or none."""
    from darkroom.llm.decontamination import decontaminate

    _released(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    docs, number = _numbered(docs)
    return _without(docs, number, decontaminate(docs, items, window=10, id_col=number).where("contaminated"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences of 2048 tokens; a null text is its end token alone, a null id stays null."""
    from darkroom.llm.packing import pack

    _released(spark)
    pieces = pack(docs, tokenizer_path("byte_bpe_50k.json"), end_id=1, seq_len=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The classifier, the forest, the signatures and the tokenizer can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = work_path(spark, f"stage-{name}")
        with scratch(spark):  # what the stage wrote for itself goes when its result is there
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
