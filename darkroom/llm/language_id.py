"""Language identification: a convolutional network over bytes, with filters of several widths, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, cuts, id_and_text

WINDOW = 256  # bytes whose filters a window pools; it also sees the WIDEST - 1 bytes after them
EMBED = 8
WIDTHS = {2: 8, 3: 12, 4: 12, 5: 8}  # how many filters of each width
WIDEST, FILTERS = max(WIDTHS), sum(WIDTHS.values())
AT_ONCE = 16  # windows that are convolved at once, so that their matrices stay in the cache
UNDETERMINED = "und"  # fixed value, as the contract states it


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, windows of each text): every text begins a new window, and at least WIDEST - 1 zeros follow it.

    All bytes lie in windows, one after the other; the last window of a text is filled up with zeros.
    """
    n = np.array([max(1, -(-len(t) // WINDOW)) for t in texts], np.int64)
    room = n * WINDOW
    room[[len(t) > r - WIDEST + 1 for t, r in zip(texts, room.tolist())]] += WINDOW
    out, at = np.zeros(int(room.sum()) + WIDEST, np.uint8), 0
    for text, r in zip(texts, room.tolist()):
        out[at : at + len(text)] = np.frombuffer(text, np.uint8)
        at += r
    return out, room // WINDOW


class ByteNetwork:
    """Bytes are embedded, filters of WIDTHS run over them, each gives its greatest value in a window, and a softmax follows.

    A filter narrower than WIDEST has weights of zero behind its width, so that all of them are one matrix.
    """

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.mask = np.zeros((WIDEST * EMBED, FILTERS), np.float32)
        widths = np.repeat(list(WIDTHS), list(WIDTHS.values()))
        for f, w in enumerate(widths):
            self.mask[: w * EMBED, f] = 1
        self.filters = (rng.normal(0, 1, self.mask.shape) / np.sqrt(widths * EMBED)).astype(np.float32) * self.mask
        self.shift = np.zeros(FILTERS, np.float32)
        self.out = rng.normal(0, FILTERS**-0.5, (FILTERS, len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def _seen(self, data: np.ndarray) -> np.ndarray:
        """For each place but the last WIDEST - 1 the embedded bytes from there on."""
        own = self.embed[data]
        n = len(data) - WIDEST + 1
        seen = np.empty((n, WIDEST, EMBED), np.float32)
        for j in range(WIDEST):
            seen[:, j] = own[j : j + n]
        return seen.reshape(n, -1)

    def _pooled(self, data: np.ndarray) -> np.ndarray:
        """The greatest value of each filter in each window of ``data``, which is windows and the WIDEST - 1 bytes after them."""
        return (self._seen(data) @ self.filters).reshape(-1, WINDOW, FILTERS).max(axis=1)

    def log_odds(self, data: np.ndarray) -> np.ndarray:
        """The logarithm of each language's probability in each window; WIDEST more bytes than windows."""
        n = len(data) // WINDOW
        peaks = np.empty((n, FILTERS), np.float32)
        for lo in range(0, n, AT_ONCE):
            hi = min(n, lo + AT_ONCE)
            peaks[lo:hi] = self._pooled(data[lo * WINDOW : hi * WINDOW + WIDEST - 1])
        return _log_softmax(np.maximum(peaks + self.shift, 0) @ self.out + self.bias)

    def train(self, windows: np.ndarray, target: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 4e-3, seed: int = 9) -> ByteNetwork:
        """Fits to ``windows`` (n x WINDOW + WIDEST - 1 bytes) by Adam; each language counts alike however many windows it has.

        A third of the windows is cut to a random length each time, so that short texts are known too.
        """
        rng = np.random.default_rng(seed)
        weight = (len(target) / len(self.languages) / np.maximum(np.bincount(target, minlength=len(self.languages)), 1))[target].astype(np.float32)
        params = [self.embed, self.filters, self.shift, self.out, self.bias]
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        steps = epochs * -(-len(target) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(target))
            for lo in range(0, len(order), batch):
                at = order[lo : lo + batch]
                part = windows[at].copy()
                for i in np.flatnonzero(rng.random(len(at)) < 1 / 3):
                    part[i, rng.integers(8, WINDOW) :] = 0
                step += 1
                pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
                for k, g in enumerate(self._gradients(part, target[at], weight[at])):
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    params[k] -= (pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def _gradients(self, part: np.ndarray, target: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        n = len(part)
        seen = np.stack([self.embed[part[:, j : j + WINDOW]] for j in range(WIDEST)], axis=2).reshape(n * WINDOW, -1)
        values = (seen @ self.filters).reshape(n, WINDOW, FILTERS)
        place = values.argmax(axis=1)
        peak = np.take_along_axis(values, place[:, None], axis=1)[:, 0] + self.shift
        hidden = np.maximum(peak, 0)
        back = np.exp(_log_softmax(hidden @ self.out + self.bias))
        back[np.arange(n), target] -= 1
        back *= weight[:, None] / n
        inner = (back @ self.out.T) * (peak > 0)
        rows = seen[(np.arange(n)[:, None] * WINDOW + place).ravel()].reshape(n, FILTERS, -1)
        filters = np.einsum("nf,nfk->kf", inner, rows) * self.mask
        taps = (inner[:, :, None] * self.filters.T[None]).reshape(-1, WIDEST, EMBED)
        bytes_ = part[np.arange(n)[:, None, None], place[:, :, None] + np.arange(WIDEST)].reshape(-1, WIDEST)
        embed = np.zeros_like(self.embed)
        np.add.at(embed, bytes_.ravel(), taps.reshape(-1, EMBED))
        return [embed, filters, inner.sum(axis=0), hidden.T @ back, back.sum(axis=0)]

    def judge(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(language number, probability) of each text: windows count by their bytes, the mean of their log odds decides."""
        data, n = windows_of(texts)
        odds = self.log_odds(data)
        first = np.cumsum(n) - n
        length = np.array([len(t) for t in texts], np.int64)
        inside = np.clip(np.repeat(length, n) - (np.arange(int(n.sum())) - np.repeat(first, n)) * WINDOW, 0, WINDOW)
        mean = np.add.reduceat(odds * inside[:, None], first, axis=0) / np.maximum(length, 1)[:, None]
        share = np.exp(_log_softmax(mean))
        best = share.argmax(axis=1)
        return best, share[np.arange(len(best)), best].astype(float)


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def has_letter(texts) -> np.ndarray:
    """Which texts of an Arrow array have a letter of any alphabet; nulls have none."""
    return pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_numpy(zero_copy_only=False)


def sample(docs: DataFrame, where, most_rows: int, most_windows: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(lang, windows): up to ``most_windows`` windows, dealt evenly over the text, of at most ``most_rows`` texts of each language.

    Texts are drawn by a hash of id and length. A first count of each language gives how much of the hash's range to draw from, so
    that only a few more rows than wanted are ranked, however many a language has.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang IS NOT NULL")
    rows = rows.where(where(F.col("doc_id")))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = (F.least(F.lit(1.0), F.lit(1.5 * most_rows + 50) / F.col("n")) * 2**62).cast("long").alias("_share")
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.octet_length("text"), F.lit(23)), 2)
    drawn = rows.where("text IS NOT NULL").withColumn("draw", draw).join(F.broadcast(counts.select(F.col("lang").alias("_lang"), share)), F.col("lang") == F.col("_lang")).where("draw <= _share")
    one = drawn.groupBy("lang", "draw").agg(F.min("text").alias("text"))  # equal ids and lengths are one draw
    ranked = one.withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy("draw"))).where(F.col("_rank") <= most_rows)

    def cut(batches):
        size = WINDOW + WIDEST - 1
        for batch in batches:
            known = has_letter(batch.column(1))
            langs, parts = [], []
            for lang, text in zip(batch.column(0).filter(pa.array(known)).to_pylist(), batch.column(1).filter(pa.array(known)).to_pylist()):
                data = text.encode()
                n = -(-len(data) // WINDOW)
                for i in range(min(n, most_windows)):
                    at = i * n // min(n, most_windows) * WINDOW
                    langs.append(lang)
                    parts.append(data[at : at + size].ljust(size, b"\0"))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(parts, pa.binary())], ["lang", "window"])

    return ranked.select("lang", "text").mapInArrow(cut, "lang string, window binary")


def fit(docs: DataFrame, where=lambda doc_id: F.lit(True), most_rows: int = 500, most_windows: int = 4, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteNetwork | None:
    """The network, trained on the driver from ``sample``'s windows of rows that ``where`` (of the id) takes; None if there are none."""
    got = sorted((r["lang"], bytes(r["window"])) for r in sample(docs, where, most_rows, most_windows, id_col, text_col, lang_col).collect())
    if not got:
        return None
    languages = sorted({lang for lang, _ in got})
    number = {lang: i for i, lang in enumerate(languages)}
    windows = np.frombuffer(b"".join(w for _, w in got), np.uint8).reshape(len(got), -1)
    return ByteNetwork(languages).train(windows, np.array([number[lang] for lang, _ in got]))


def identify(docs: DataFrame, held_out: tuple[int, int] | None = (4, 2), most_rows: int = 500, most_windows: int = 4, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, from all bytes of its text.

    Learnt from at most ``most_rows`` texts of each language, ``most_windows`` windows of each, of rows with text and
    language whose crc32(id as text) mod ``held_out[0]`` isn't ``held_out[1]``. A null text and one without a letter is ``und``
    with a score of 0; without anything to learn from, so is every text. A null id is never held out; repeated rows each
    have their result, and equal texts the same one. Of equally likely languages the first by name is taken. Very long texts are
    cut into windows like others, none is left out. An empty table gives no rows. Other columns, whatever their names, play no part.
    """
    by, left = held_out or (1, -1)
    model = fit(docs, lambda doc_id: crc_mod(doc_id, by) != left, most_rows, most_windows, id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for lo, n in cuts(batch.column(1), 1 << 20):
                part = batch.slice(lo, n)
                known = has_letter(part.column(1)) & (shared.value is not None)
                names, scores = np.full(n, UNDETERMINED, object), np.zeros(n)
                at = np.flatnonzero(known)
                if len(at):
                    best, scores[at] = shared.value.judge(part.column(1).take(pa.array(at)).cast(pa.binary()).to_pylist())
                    names[at] = np.array(shared.value.languages, object)[best]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names.tolist(), pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    found = id_and_text(docs, id_col, text_col, null_as_empty=False).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", (crc_mod(F.col("doc_id"), by) == left).alias("held_out"), "lang_pred", "score")
