"""Token counts of whole texts; huge texts go in overlapping chunks that are spliced where the tokens provably agree."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, kept, slices

SPACE = "▁"  # how the model writes a space


class ChunkedCounter:
    """Counts tokens as the whole text would be encoded.

    A byte-pair model merges only into pieces of its vocabulary. If no piece has a space after another
    character, no token crosses a place where a space follows a character that is none, and the tokens on
    either side of it don't depend on each other: such a place is a stable boundary. Two overlapping chunks
    are spliced at the last stable boundary that both have as a token boundary. If there is none, the overlap
    grows, then the chunk, up to the whole text. For other vocabularies every text is encoded as one.
    """

    def __init__(self, path: str, chunk_chars: int = 32_768, overlap_chars: int = 256):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.stable = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.chunk_chars, self.overlap_chars = chunk_chars, max(2, overlap_chars)

    def counts(self, texts: list[str]) -> list[int]:
        short = [i for i, t in enumerate(texts) if not self.stable or len(t) <= self.chunk_chars]
        out = [0] * len(texts)
        for i, ids in zip(short, self.model.encode([texts[i] for i in short], num_threads=1) if short else []):
            out[i] = len(ids)
        for i in set(range(len(texts))).difference(short):
            out[i] = self._spliced(texts[i])
        return out

    def _ends(self, text: str) -> list[int]:
        """Where each token of ``text`` ends, in characters; the model tells it in bytes."""
        ends = np.array([p.end for p in self.model.encode(text, return_type="proto").pieces], np.int64)
        first = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
        return np.concatenate(([0], np.cumsum(first)))[ends].tolist()

    def _spliced(self, text: str) -> int:
        total, start, size = 0, 0, self.chunk_chars
        ends = self._ends(text[:size])
        skip = 0  # tokens of the chunk at hand that are counted already
        while start + size < len(text):
            overlap, stop = self.overlap_chars, start + size
            found = None
            while found is None and overlap < size:
                lo = stop - overlap
                following = self._ends(text[lo : lo + self.chunk_chars])
                here = {start + e: i + 1 for i, e in enumerate(ends)}  # the last token that ends there
                there = {lo + e: i + 1 for i, e in enumerate(following)}
                for at in range(stop - 1, lo, -1):
                    if text[at] == " " and text[at - 1] not in (" ", SPACE) and at in here and at in there and here[at] > skip:
                        found = at
                        break
                overlap *= 2
            if found is None:  # no boundary in this chunk: a longer one
                size *= 2
                ends = self._ends(text[start : start + size])
                continue
            total += here[found] - skip
            start, skip, ends, size = lo, there[found], following, self.chunk_chars
        return total + len(ends) - skip


def counter(*args) -> ChunkedCounter:
    return kept(("counter", *args), lambda: ChunkedCounter(*args))


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, chunk_chars: int = 32_768, overlap_chars: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; null texts are empty, null and repeated ids stay as they are.

    A text of exactly ``limit`` tokens isn't over it. Texts over ``chunk_chars`` go in overlapping chunks, with the same
    counts. An empty table gives no rows. Other columns, whatever their names, play no part.
    """

    def count(batches):
        for batch in batches:
            for ids, texts in slices(batch):
                n = counter(model, chunk_chars, overlap_chars).counts(texts)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    counted = id_and_text(docs, id_col, text_col).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
