"""Token-id files: independent zstandard frames with a trailing seek table and a checksum for each frame.

File layout (the public seekable-zstandard layout, so plain zstandard tools can read it too)::

    frame 0 .. frame k-1    little-endian unsigned 32-bit ids of whole documents, one after another
    skippable frame         the document table: ids, validity, token counts and frame numbers
    skippable frame         the seek table: compressed size, size and checksum of every frame above

A reader takes the end of a file first, then only the frames that hold the documents asked for.
"""

from __future__ import annotations

import io
import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import filesystem, id_and_text, slices
from .tokens import encoder

# Fixed values of the public seekable format.
SKIPPABLE_TABLE, SKIPPABLE_DOCS, SEEK_MAGIC, HAS_CHECKSUMS = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1, 0x80

MANIFEST = "shard int, path string, n_docs long, n_tokens long, n_bytes long"


def _checksum(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class FrameWriter:
    """Writes documents to ``out``; memory holds one frame and three numbers for each document."""

    def __init__(self, out, frame_tokens: int, level: int):
        import zstandard

        self.out, self.frame_bytes = out, 4 * frame_tokens
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.held, self.held_bytes, self.seek, self.docs, self.n_tokens, self.n_bytes = [], 0, [], [], 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.held and self.held_bytes + len(ids) > self.frame_bytes:
            self._frame()
        self.docs.append((doc_id or 0, doc_id is not None, len(ids) // 4, len(self.seek)))
        self.held.append(ids)
        self.held_bytes += len(ids)
        self.n_tokens += len(ids) // 4

    def _write(self, data: bytes, plain: bytes) -> None:
        self.out.write(data)
        self.n_bytes += len(data)
        self.seek.append((len(data), len(plain), _checksum(plain)))

    def _frame(self) -> None:
        plain = b"".join(self.held)
        self._write(self.compressor.compress(plain), plain)
        self.held, self.held_bytes = [], 0

    def close(self) -> None:
        if self.held:
            self._frame()
        ids, valid, counts, frames = (np.array(x) for x in zip(*self.docs)) if self.docs else ([np.array([])] * 4)
        table = struct.pack("<Q", len(self.docs)) + ids.astype("<i8").tobytes() + valid.astype("u1").tobytes() + counts.astype("<u4").tobytes() + frames.astype("<u4").tobytes()
        self._write(struct.pack("<II", SKIPPABLE_DOCS, len(table)) + table, table)
        entries = b"".join(struct.pack("<III", *x) for x in self.seek) + struct.pack("<IBI", len(self.seek), HAS_CHECKSUMS, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_TABLE, len(entries)) + entries)
        self.n_bytes += 8 + len(entries)


class FrameReader:
    """Reads documents of one file by their place in it; ``file`` can seek."""

    def __init__(self, file):
        import zstandard

        self.file, self.decompressor = file, zstandard.ZstdDecompressor()
        file.seek(0, io.SEEK_END)
        size = file.tell()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC or not flags & HAS_CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        seek = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3)
        self.sizes, self.sums = seek[:, 0].astype(np.int64), seek[:, 2]
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        table = self._at(int(self.starts[n - 1]) + 8, int(self.sizes[n - 1]) - 8)
        self._verify(n - 1, table)
        (k,) = struct.unpack_from("<Q", table)
        at = 8
        for name, kind in (("ids", "<i8"), ("valid", "u1"), ("counts", "<u4"), ("frames", "<u4")):
            setattr(self, name, np.frombuffer(table, kind, k, at))
            at += k * np.dtype(kind).itemsize
        self.first = np.searchsorted(self.frames, np.arange(n)) if k else np.zeros(n, np.int64)
        self.before = np.concatenate(([0], np.cumsum(self.counts, dtype=np.int64)))
        self.kept: tuple[int, bytes] = (-1, b"")

    def __len__(self) -> int:
        return len(self.ids)

    def _at(self, start: int, size: int) -> bytes:
        self.file.seek(start)
        return self.file.read(size)

    def _verify(self, frame: int, plain: bytes) -> None:
        if _checksum(plain) != self.sums[frame]:
            raise ValueError(f"frame {frame} does not match its checksum")

    def document(self, i: int) -> tuple[int | None, int, bytes]:
        """(id, tokens of the file's documents before it, ids) of the i-th document."""
        frame = int(self.frames[i])
        if self.kept[0] != frame:
            plain = self.decompressor.decompress(self._at(int(self.starts[frame]), int(self.sizes[frame])))
            self._verify(frame, plain)
            self.kept = frame, plain
        start = 4 * int(self.before[i] - self.before[self.first[frame]])
        return int(self.ids[i]) if self.valid[i] else None, int(self.before[i]), self.kept[1][start : start + 4 * int(self.counts[i])]


def write_token_files(docs: DataFrame, out_dir: str, tokenizer: str, end_id: int | None = 0, frame_tokens: int = 1 << 16, level: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes whole texts and writes them to files in ``out_dir`` in ascending order of the id; returns the manifest.

    Null texts are empty; a null id comes first and stays null; rows with the same id are all written, in the
    order of a hash of their text. ``end_id`` ends each document (None: nothing does). Each task writes a file
    of a name of its own, and only files of tasks that ended well are in the manifest, so a task that is lost
    and run again leaves no wrong rows. An empty table gives an empty manifest. Other columns, whatever their names, play no part.
    """
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def write(batches):
        fs, folder = filesystem(out_dir)
        shard, sink, writer, path = TaskContext.get().partitionId(), None, None, ""
        for batch in batches:
            for ids, texts in slices(batch):
                if writer is None:
                    fs.create_dir(folder, recursive=True)
                    path = f"shard-{shard:06d}-{uuid.uuid4().hex}.tok"
                    sink = fs.open_output_stream(f"{folder}/{path}")
                    writer = FrameWriter(sink, frame_tokens, level)
                for doc_id, got in zip(ids, encoder(tokenizer).encode(texts)):
                    writer.add(doc_id, got + end)
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [path], "n_docs": [len(writer.docs)], "n_tokens": [writer.n_tokens], "n_bytes": [writer.n_bytes]})

    rows = id_and_text(docs, id_col, text_col)
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{out_dir}/_manifest")
    return read_manifest(docs.sparkSession, out_dir)


def read_manifest(spark: SparkSession, out_dir: str) -> DataFrame:
    """The manifest, with each file's first token: the tokens of all files before it. It has one row a file."""
    files = spark.read.schema(MANIFEST).parquet(f"{out_dir}/_manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("first_token", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))


def read_token_files(spark: SparkSession, out_dir: str, doc_ids: list[int] | None = None, batch_tokens: int = 1 << 20) -> DataFrame:
    """(doc_id, start, ids): documents with the tokens before them in all files, and their ids as bytes.

    With ``doc_ids``, only frames that hold one of them are read and decompressed; of an id that was written several times all
    documents come, of one that wasn't none, and null ids only without ``doc_ids``. An empty text has its end id alone, or no bytes where none was
    written. A document longer than a frame has one of its own. An empty manifest gives no rows.
    """
    wanted = None if doc_ids is None else np.array(sorted(set(doc_ids)), np.int64)

    def read(batches):
        fs, folder = filesystem(out_dir)
        for batch in batches:
            for path, first in zip(*(c.to_pylist() for c in batch.columns)):
                with fs.open_input_file(f"{folder}/{path}") as file:
                    reader = FrameReader(file)
                    places = range(len(reader)) if wanted is None else np.flatnonzero(np.isin(reader.ids, wanted) & (reader.valid == 1)).tolist()
                    rows, held = [], 0
                    for i in places:
                        doc_id, before, ids = reader.document(i)
                        rows.append((doc_id, first + before, ids))
                        held += len(ids)
                        if held >= 4 * batch_tokens:
                            yield _batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows)

    files = read_manifest(spark, out_dir).select("path", "first_token")
    n = spark.read.schema(MANIFEST).parquet(f"{out_dir}/_manifest").count()
    return files.repartition(max(1, n)).mapInArrow(read, "doc_id long, start long, ids binary")


def _batch(rows):
    ids, starts, data = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(data, pa.binary())], ["doc_id", "start", "ids"])
