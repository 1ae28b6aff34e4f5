"""A quality classifier: random-indexing word vectors, pooled per text, and a two-layer network on them."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, filtered, id_and_text, kept, labelled_sample, one_row_an_id, slices

WORDS, SHAPES, DIM, BLOCK = 1 << 15, 1 << 12, 64, 1 << 10
AT_ONCE = 1 << 15  # words whose vectors are held at once
REPEATED = 0  # the shape of a word that equals the one before it
RUN = 128  # characters: a longer run without white space is cut into pieces of that length, and each is a word


def in_pieces(words: list[str]) -> list[str]:
    """``words`` with runs of over RUN characters cut into consecutive pieces; nothing is left out."""
    return [w[i : i + RUN] for w in words for i in range(0, len(w), RUN)]


class Terms:
    """A word's two terms: what it says, in lower case and without marks, and its shape: case and marks around it."""

    def __init__(self, most: int = 200_000):
        self.kept, self.most = {}, most  # words have RUN characters at most

    def _code(self, word: str) -> int:
        first, last = 0, len(word)
        while first < last and not (word[first].isalnum() or word[first] == "_"):
            first += 1
        while last > first and not (word[last - 1].isalnum() or word[last - 1] == "_"):
            last -= 1
        core = word[first:last]
        case = "A" if core.isupper() and len(core) > 1 else "a" if core.islower() else "Aa" if core.istitle() else "0" if core.isdigit() else "?" if core else ""
        shape = f"{word[:first]} {case} {word[last:]} {min(len(core), 24) // 6}"
        return zlib.crc32(core.lower().encode("utf-8", "replace")) % WORDS * SHAPES + 1 + zlib.crc32(shape.encode("utf-8", "replace")) % (SHAPES - 1)

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word terms, shape terms, words of each text)."""
        kept, codes, counts = self.kept, [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            words = text.split()
            if len(text) > RUN and max(map(len, words), default=0) > RUN:
                words = in_pieces(words)
            counts[i] = len(words)
            for w in set(words).difference(kept):
                kept[w] = self._code(w)
            codes.append(np.fromiter(map(kept.__getitem__, words), np.int64, len(words)))
            if len(kept) > self.most:
                kept.clear()
        code = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        shape = code % SHAPES
        first = np.zeros(len(code) + 1, bool)
        first[np.cumsum(counts) - counts] = True
        shape[1:][(code[1:] == code[:-1]) & ~first[1:-1]] = REPEATED
        return code // SHAPES, shape, counts


def index_vectors(n: int, seed: int, ones: int = 4) -> np.ndarray:
    """Sparse random vectors of +1 and -1, the same wherever they are made."""
    rng = np.random.default_rng(seed)
    out = np.zeros((n, DIM), np.float32)
    for _ in range(ones):
        out[np.arange(n), rng.integers(0, DIM, n)] += rng.choice(np.array([-1, 1], np.float32), n)
    return out


def _context_sums(word: np.ndarray, shape: np.ndarray, counts: np.ndarray, index: tuple) -> np.ndarray:
    """For each term, the sum of the index vectors of the terms next to it."""
    out = np.zeros((WORDS + SHAPES, DIM), np.float32)
    doc = np.repeat(np.arange(len(counts)), counts)
    inside = np.flatnonzero(doc[1:] == doc[:-1])
    for lo in range(0, len(inside), AT_ONCE):
        near = inside[lo : lo + AT_ONCE]
        for here, there in ((near, near + 1), (near + 1, near)):
            both = index[0][word[there]] + index[1][shape[there]]
            for terms in (word[here], WORDS + shape[here]):
                order = np.argsort(terms, kind="stable")
                ranked = terms[order]
                starts = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
                out[ranked[starts]] += np.add.reduceat(both[order], starts, axis=0)
    return out


def _normed(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-6)


def pooled(word: np.ndarray, shape: np.ndarray, counts: np.ndarray, vectors: tuple) -> np.ndarray:
    """The mean vector of each text's words and of its shapes, side by side; zeros for a text without words."""
    out = np.zeros((len(counts), 2 * DIM), np.float32)
    doc = np.repeat(np.arange(len(counts)), counts)
    for lo in range(0, len(doc), AT_ONCE):  # however long a text is
        own = doc[lo : lo + AT_ONCE]
        starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        for k, (terms, table) in enumerate(((word, vectors[0]), (shape, vectors[1]))):
            out[own[starts], k * DIM : (k + 1) * DIM] += np.add.reduceat(table[terms[lo : lo + AT_ONCE]], starts, axis=0)
    return out / np.maximum(counts, 1)[:, None].astype(np.float32)


class Network:
    """Two layers; probabilities are calibrated by a temperature on rows kept from training."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, batch: int = 256, rate: float = 3e-3, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        held = np.arange(len(x)) % 5 == 4
        z, held_z = self._input(x[~held]), self._input(x[held])
        t = y[~held]
        self.w = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        m, v, step = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(epochs):
            order = rng.permutation(len(z))
            for lo in range(0, len(z), batch):
                at = order[lo : lo + batch]
                h = np.tanh(z[at] @ self.w[0] + self.w[1])
                d = (1 / (1 + np.exp(-np.clip(h @ self.w[2] + self.w[3], -30, 30))) - t[at]) / len(at)
                back = np.outer(d, self.w[2]) * (1 - h * h)
                step += 1
                for k, g in enumerate((z[at].T @ back + 1e-4 * self.w[0], back.sum(0), h.T @ d + 1e-4 * self.w[2], d.sum(keepdims=True))):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.temperature = 1.0
        if held.any():
            logit, sign = self._logit(held_z), np.where(y[held] == 1, -1, 1)
            self.temperature = min(np.geomspace(0.25, 8, 61), key=lambda c: float(np.mean(np.logaddexp(0, sign * logit / c))))

    def _input(self, x):
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def _logit(self, z):
        return np.tanh(z @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._logit(self._input(x)) / self.temperature, -30, 30)))


def _terms() -> Terms:
    return kept(("terms",), Terms)


def fit(docs: DataFrame, labels: DataFrame, where=None, most_rows: int = 20_000, parts: int = 24, id_col: str = "doc_id", text_col: str = "text"):
    """(vectors, network) from at most ``most_rows`` labelled rows, or None if there are none.

    An id with several texts is learnt from by one of them, the one with the least hash. Tasks sum context vectors over the sample's whole texts, blocks of terms are added up in Spark, and the
    driver gets one vector for each term (a fixed number) and one for each sampled text.
    """
    spark = docs.sparkSession
    sample = F.broadcast(labelled_sample(labels, most_rows, where))
    texts = one_row_an_id(id_and_text(docs, id_col, text_col).join(sample, "doc_id")).select("draw", "text", "label").repartition(parts, "draw")
    texts = texts.persist()
    index = index_vectors(WORDS, 1), index_vectors(SHAPES, 2)

    def sums(batches):
        total = np.zeros((WORDS + SHAPES, DIM), np.float32)
        for batch in batches:
            for _, part in slices(batch.select(["draw", "text"]), 2 << 20):
                total += _context_sums(*_terms().of(part), index)
        for lo in range(0, WORDS + SHAPES, BLOCK):
            if total[lo : lo + BLOCK].any():
                yield pa.RecordBatch.from_arrays([pa.array([lo], pa.int32()), pa.array([total[lo : lo + BLOCK].tobytes()], pa.binary())], ["block", "sums"])

    def add(key, table):
        total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in sorted(table.column("sums").to_pylist()))
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["block", "sums"])

    context = np.zeros((WORDS + SHAPES, DIM), np.float32)
    for r in texts.mapInArrow(sums, "block int, sums binary").groupBy("block").applyInArrow(add, "block int, sums binary").collect():  # 36 blocks at most
        context[r["block"] : r["block"] + BLOCK] = np.frombuffer(r["sums"], np.float32).reshape(-1, DIM)
    vectors = tuple(_normed(i) + _normed(c) for i, c in zip(index, (context[:WORDS], context[WORDS:])))
    shared = spark.sparkContext.broadcast(vectors)

    def pool(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.concatenate([pooled(*_terms().of(p), shared.value) for _, p in slices(batch.select(["draw", "text"]), 2 << 20)])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([v.tobytes() for v in x], pa.binary())], ["draw", "label", "v"])

    got = texts.mapInArrow(pool, "draw long, label int, v binary").toArrow()  # most_rows at most, as Arrow and not as Python's rows
    texts.unpersist()
    if not got.num_rows:
        return None
    got = got.sort_by([(c, "ascending") for c in ("draw", "label", "v")])
    x = np.frombuffer(b"".join(got["v"].to_pylist()), np.float32).reshape(got.num_rows, -1).astype(float)
    return shared, Network(x, got["label"].to_numpy().astype(float))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, held_out: tuple[int, int] | None = (4, 2), most_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Labels of rows whose crc32(id as text) mod ``held_out[0]`` is ``held_out[1]`` are not learnt from. Null texts
    are empty, and a text without words gets the score of a zero vector. Without labels every score is one half.
    A null id is never held out, and no label is its; repeated rows each have their score; an id with several labels is
    learnt with the least. A score of exactly ``threshold`` is predicted 1. Very long texts are pooled whole, in blocks of words. An empty
    table gives no rows. Other columns, whatever their names, play no part.
    """
    by, left = held_out or (1, -1)
    model = fit(docs, labels, crc_mod(F.col("doc_id"), by) != left, most_rows, id_col=id_col, text_col=text_col)

    def score(batches):
        for batch in batches:
            for ids, texts in slices(batch, 2 << 20):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(_scores(model, texts))], ["doc_id", "score"])

    scored = id_and_text(docs, id_col, text_col).mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), by) == left).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _scores(model, texts: list[str]) -> np.ndarray:
    return model[1].score(pooled(*_terms().of(texts), model[0].value)) if model else np.full(len(texts), 0.5)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, held_out: tuple[int, int] | None = (4, 2), most_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows that ``classify`` predicts 1 for, with all their columns; all rows if there are no labels to learn from.

    Each row is judged by its text alone, a null text as an empty one, whatever its id, so that repeated rows stay or go together; a score of
    exactly ``threshold`` stays. An empty table stays empty.
    """
    by, left = held_out or (1, -1)
    model = fit(docs, labels, crc_mod(F.col("doc_id"), by) != left, most_rows, id_col=id_col, text_col=text_col)
    return filtered(docs, lambda texts: _scores(model, texts) >= threshold, text_col) if model else docs
