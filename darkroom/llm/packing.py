"""Packing by concatenating and cutting: prefix sums over partitions give offsets, then windows of a fixed length."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, slices, written
from .tokens import encoder

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def encoded(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, start, doc_id, n_tokens, ids): each document's ids with its offset in its partition, written once.

    Once written, the order is fixed: a partition that is computed again can't move a document.
    """
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches):
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            for ids, texts in slices(batch):
                data = [x + end for x in encoder(tokenizer).encode(texts)]
                sizes = np.array([len(x) // 4 for x in data], np.int64)
                starts = start + np.cumsum(sizes) - sizes
                start += int(sizes.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(data), part, np.int32)), pa.array(starts), pa.array(ids, pa.int64()), pa.array(sizes), pa.array(data, pa.binary())], ["part", "start", "doc_id", "n_tokens", "ids"])

    return written(id_and_text(docs, id_col, text_col).mapInArrow(encode, "part int, start long, doc_id long, n_tokens long, ids binary"), "encoded")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, seq_len: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of a document in a sequence of ``seq_len`` tokens; only the last sequence can be short.

    Null texts are empty and give the end id alone; null ids stay null; rows with the same id are packed one
    by one; an empty table gives no rows. The first pass encodes and sums tokens, the driver adds up one total
    for each partition, and the second pass cuts at every multiple of ``seq_len``: no row is shuffled.
    Very long texts are encoded whole, and cut into as many pieces as they need. Other columns, whatever their names, play no part.
    """
    tokens = encoded(docs, tokenizer, end_id, id_col, text_col)
    bases, total = {}, 0
    for row in tokens.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").toLocalIterator():  # a number for each partition
        bases[row["part"]] = total
        total += row["n"]

    def cut(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                out = [[] for _ in range(7)]
                for part, start, doc_id, n, ids in zip(*(c.to_pylist() for c in batch.slice(lo, 512).columns)):
                    at, place = 0, bases[part] + start
                    while at < n:
                        sequence, offset = divmod(place + at, seq_len)
                        k = min(n - at, seq_len - offset)
                        for column, value in zip(out, (doc_id, at, k, ids[4 * at : 4 * (at + k)], n, sequence, offset)):
                            column.append(value)
                        at += k
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if i == 3 else pa.int64()) for i, x in enumerate(out)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return tokens.mapInArrow(cut, PIECES)
