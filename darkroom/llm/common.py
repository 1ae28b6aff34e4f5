"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import hot_keys, per_salt, salted, spread_join  # noqa: F401  the operators take them from here

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: For bytes.translate: lower-cases A-Z alone.
LOWER_TABLE = bytes.maketrans(UPPER.encode(), LOWER.encode())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets a
    temporary folder; on a cluster that is an error, since executors wouldn't see each other's files."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext._jsc.sc().getCheckpointDir()
    if isinstance(found, str):
        return found.rstrip("/")
    if found is not None and found.isDefined():
        return found.get().rstrip("/")
    master = spark.sparkContext.master or ""
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"spark.checkpoint.dir is not set, and {master} needs a folder that all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="darkroom-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


_SCRATCH = threading.local()


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder for the intermediate tables of what is computed inside; it is removed at the end.

    Results read those tables, so write them inside: ``with scratch(spark): near_duplicates(docs).write.parquet(path)``.
    Without it the tables stay until spark.checkpoint.dir is cleared.
    """
    path, outer = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}", getattr(_SCRATCH, "path", None)
    _SCRATCH.path = path
    try:
        yield path
    finally:
        _SCRATCH.path = outer
        jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)


def work_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder, or in ``scratch``'s, that no other call uses."""
    return f"{getattr(_SCRATCH, 'path', None) or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and lost executors don't lose it."""
    path = work_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def gathered(df: DataFrame) -> DataFrame:
    """``df`` in an eighth as many tasks as a shuffle has, for tables that are small beside the documents: fewer, larger files."""
    return df.coalesce(max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", null_as_empty: bool = True) -> DataFrame:
    """(doc_id, text); other columns, whatever their names, play no part."""
    text = docs[text_col].cast("string")
    return docs.select(docs[id_col].cast("long").alias("doc_id"), (F.coalesce(text, F.lit("")) if null_as_empty else text).alias("text"))


_KEPT: dict = {}


def kept(key: tuple, make):
    """What a worker process keeps from task to task: the last thing that an operator made, and nothing of others."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def ascii_lower(text):
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def cuts(texts, max_bytes: int) -> list[tuple[int, int]]:
    """(first row, rows) of parts of an Arrow array of texts, each of about ``max_bytes`` at most or one row."""
    import pyarrow.compute as pc

    out, lo, total = [], 0, 0
    for i, k in enumerate(pc.binary_length(texts).to_pylist()):
        if i > lo and total + (k or 0) > max_bytes:
            out.append((lo, i - lo))
            lo, total = i, 0
        total += k or 0
    return [*out, (lo, len(texts) - lo)] if lo < len(texts) else out


def slices(batch, max_bytes: int = 8 << 20):
    """(ids, texts) lists of an Arrow batch with columns (doc_id, text), cut as ``cuts`` does."""
    for lo, n in cuts(batch.column(1), max_bytes):
        part = batch.slice(lo, n)
        yield part.column(0).to_pylist(), part.column(1).to_pylist()


#: Schemes by which Spark names a store, and those by which pyarrow does.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def filesystem(uri: str):
    """(pyarrow filesystem, path in it) of a path in the shared folder.

    Local paths, s3 (s3a), gs, abfs(s) and hdfs; the last needs libhdfs where executors run. Other stores raise an error.
    """
    from pyarrow import fs

    scheme, mark, rest = uri.partition("://")
    if not mark:
        return fs.FileSystem.from_uri(uri if uri.startswith("file:") else f"file://{uri}")
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme.lower(), scheme.lower())}://{rest}")


def labelled(labels: DataFrame, where=None, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(doc_id, label) of all ids. Ids and labels that are null are left out; an id with several labels takes the least."""
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).dropna()
    if where is not None:
        rows = rows.where(where)
    return rows.groupBy("doc_id").agg(F.min("label").alias("label"))


def labelled_sample(labels: DataFrame, most: int, where=None, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(doc_id, label, draw) of at most ``most`` ids of ``labelled``, those with the smallest ``draw``, a hash of the id."""
    return labelled(labels, where, id_col, label_col).withColumn("draw", F.xxhash64("doc_id", F.lit(17))).orderBy("draw", "doc_id").limit(most)


def one_row_an_id(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """Of each ``doc_id`` the row whose text has the least hash, so that a bound on ids is a bound on rows."""
    rest = [c for c in rows.columns if c != "doc_id"]
    least = F.min_by(F.struct(*rest), F.struct(F.xxhash64(text_col), F.octet_length(text_col))).alias("row")
    return rows.groupBy("doc_id").agg(least).select("doc_id", "row.*")


def crc_mod(id_col, by: int):
    """crc32 of the id as text, modulo ``by``; 0 for a null id."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(by)), F.lit(0)).cast("int")


def filtered(docs: DataFrame, accept, text_col: str = "text", max_bytes: int = 2 << 20) -> DataFrame:
    """Rows whose texts ``accept`` takes, a function from a list of texts (null: empty) to booleans; all columns stay."""
    at = docs.columns.index(text_col)

    def keep(batches):
        import pyarrow as pa

        for batch in batches:
            for lo, n in cuts(batch.column(at), max_bytes):
                part = batch.slice(lo, n)
                yield part.filter(pa.array(accept([t or "" for t in part.column(at).to_pylist()]), pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
