"""Language-model scores by prediction by partial matching over bytes, and a word-count baseline.

The byte contexts of all training texts are counted in Spark: every position gives one string of ``order`` + 1 bytes,
and shorter contexts are sums over its ends. A symbol is coded in the longest context that has been seen; if it
is new there, an escape (method C: as likely as there are distinct symbols) leads to the next shorter context,
where the symbols of the longer one are excluded. Each text ends with the byte 255, which UTF-8 never uses, and
starts after a run of it.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER_TABLE, filesystem, id_and_text, kept, slices, spread_join, written

U = np.uint64
END = b"\xff"


def contexts(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(strings, symbols of each text): at each byte of the texts and their ends, it and the ``order`` bytes before."""
    pad = END * order
    x = np.frombuffer(pad + pad.join([t + END for t in texts]), np.uint8).astype(U)
    counts = np.array([len(t) + 1 for t in texts], np.int64)
    key, width = x, 1
    while 2 * width <= order + 1:
        key, width = key[:-width] << U(8 * width) | key[width:], 2 * width
    rest = order + 1 - width
    if rest:
        key = key[:-rest] << U(8 * rest) | (key[rest:] & U((1 << 8 * rest) - 1))
    starts = np.cumsum(counts + order) - counts - order  # of texts, among the positions that have a whole context
    keep = np.ones(len(key), bool)
    for k in range(order):
        at = starts[1:] - 1 - k
        keep[at] = False
    return key[keep], counts


class Tally:
    """Counts of 64-bit keys in sorted arrays that are merged as they fill."""

    def __init__(self, most: int = 3_000_000):
        self.parts, self.held, self.most = [], 0, most

    def add(self, keys: np.ndarray) -> None:
        self.parts.append(np.unique(keys, return_counts=True))
        self.held += len(self.parts[-1][0])
        if self.held > self.most:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, U), np.zeros(0, np.int64)
        keys, counts = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        self.parts = [(keys[first], np.add.reduceat(counts, first))]
        self.held = len(first)
        return self.parts[0]


def counted(training: DataFrame, order: int) -> DataFrame:
    """(word, gram, n) of (doc_id, text): words and byte strings with their counts; the empty word counts ends of texts."""

    def batch_of(words, grams, counts):
        n = len(counts)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()) if words else pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()) if grams is None else pa.array(grams.view(np.int64)), pa.array(counts, pa.int64())], ["word", "gram", "n"])

    def count(batches):
        kept(("counts",), dict)  # a model that an earlier task left in this worker goes
        words, grams = Counter(), Tally()
        for batch in batches:
            for _, texts in slices(batch, 1 << 20):
                data = [t.encode() for t in texts]
                grams.add(contexts(data, order)[0])
                words.update(b"\n".join(data).translate(LOWER_TABLE).split())
                words[b""] += len(data)
                if len(words) > 200_000:
                    yield batch_of(list(words), None, list(words.values()))
                    words.clear()
                if grams.held > 1_200_000:  # what a task holds is bounded; Spark adds up the rest
                    keys, n = grams.merge()
                    if grams.held > 800_000:
                        yield batch_of(None, keys, n)
                        grams = Tally()
        if words:
            yield batch_of(list(words), None, list(words.values()))
        keys, n = grams.merge()
        for lo in range(0, len(keys), 500_000):
            yield batch_of(None, keys[lo : lo + 500_000], n[lo : lo + 500_000])

    return training.mapInArrow(count, "word binary, gram long, n long")


def _least_count(counts: DataFrame, most: int, floor: int) -> int:
    """The least power of two, ``floor`` at least, so that at most ``most`` rows of ``counts`` (n) reach it."""
    by_size = dict(counts.where(F.col("n") >= floor).groupBy(F.floor(F.log2("n")).alias("k")).count().collect())  # 63 rows at most
    least, total = floor, sum(by_size.values())
    for k in sorted(by_size):
        if total <= most:
            break
        total -= by_size[k]
        least = 2 ** (k + 1)
    return least


class PartialMatching:
    """The trie as sorted arrays, one for each length of string, from (length, gram, n).

    With ``base``, a trie of the shorter strings, its arrays are taken over as they are and only longer ones are sorted.
    """

    def __init__(self, length: np.ndarray, gram: np.ndarray, n: np.ndarray, order: int, base: PartialMatching | None = None):
        lists = ("keys", "counts", "contexts", "start", "escape", "excluded", "totals", "kinds")
        for name in lists:
            setattr(self, name, list(getattr(base, name)) if base else [])
        self.order = order
        for j in range(len(self.keys), order + 1):  # strings of j + 1 bytes, contexts of j
            own = np.flatnonzero(length == j + 1)
            keys = gram[own].view(U)
            by = np.argsort(keys)
            keys, counts = keys[by], n[own][by].astype(float)
            self.keys.append(keys)
            self.counts.append(counts)
            above = keys >> U(8)
            first = np.flatnonzero(np.concatenate(([True], above[1:] != above[:-1]))) if len(keys) else np.zeros(0, np.int64)
            size = np.add.reduceat(counts, first) if len(keys) else np.zeros(0)
            kind = np.diff(np.append(first, len(keys))).astype(float)
            self.contexts.append(above[first])
            self.start.append(np.log10(size + kind))
            self.escape.append(np.log10(kind) - np.log10(size + kind))
            self.totals.append(size)
            self.kinds.append(kind)
            if j and len(keys):  # what is left in the next shorter context without the symbols seen here
                mask = U((1 << 8 * j) - 1)
                lower = self.counts[j - 1][np.searchsorted(self.keys[j - 1], keys & mask)]
                shorter = np.searchsorted(self.contexts[j - 1], self.contexts[j] & U((1 << 8 * (j - 1)) - 1))
                left = self.totals[j - 1][shorter] - np.add.reduceat(lower, first)
                new = self.kinds[j - 1][shorter] - kind
                whole = np.log10(np.maximum(left + new, 1))
                self.excluded.append((whole, np.where(new > 0, np.log10(np.maximum(new, 1)) - whole, 0.0)))
            else:
                self.excluded.append((np.zeros(len(first)), np.zeros(len(first))))
        self.log_counts = [np.log10(c) for c in self.counts]
        self.uniform = -np.log10(max(256 - len(self.keys[0]), 1))

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        """Of each string of ``order`` + 1 bytes that of its last byte after the others, escapes counted in."""
        out, so_far = np.zeros(len(keys)), np.zeros(len(keys))
        longer = np.full(len(keys), -1)  # place of the context that was left, one byte longer
        open_ = np.arange(len(keys))
        for j in range(self.order, -1, -1):
            if not len(self.contexts[j]):
                continue
            key = keys[open_] & U((1 << 8 * (j + 1)) - 1)
            above = key >> U(8)
            at = np.minimum(np.searchsorted(self.contexts[j], above), len(self.contexts[j]) - 1)
            seen = np.flatnonzero(self.contexts[j][at] == above)
            at, here, key = at[seen], open_[seen], key[seen]
            place = np.minimum(np.searchsorted(self.keys[j], key), len(self.keys[j]) - 1)
            found = self.keys[j][place] == key
            before = longer[here]
            fresh = before < 0
            whole, escape = self.start[j][at], self.escape[j][at]
            if j < self.order and len(self.excluded[j + 1][0]):
                whole = np.where(fresh, whole, self.excluded[j + 1][0][before])
                escape = np.where(fresh, escape, self.excluded[j + 1][1][before])
            out[here[found]] = so_far[here[found]] + self.log_counts[j][place[found]] - whole[found]
            so_far[here] += escape
            longer[here] = at
            done = np.zeros(len(open_), bool)
            done[seen[found]] = True
            open_ = open_[~done]
            if not len(open_):
                break
        out[open_] = so_far[open_] + self.uniform
        return out


class Frequent:
    """The log probabilities of the most frequent of the longest strings, by a table by hash; where two meet in it, the
    more frequent one stays, and the other is looked up in the sorted strings."""

    def __init__(self, gram: np.ndarray, n: np.ndarray, log: np.ndarray):
        keys = gram.view(U)
        self.bits = max(4, len(keys).bit_length())
        self.slot_keys = np.zeros(1 << self.bits, U)
        self.slot_keys[0] = 1  # an empty slot holds a string that belongs to another one
        self.slot_values = np.zeros(1 << self.bits)
        order = np.argsort(n, kind="stable").astype(np.int32)
        slots = self._slots(keys)[order]
        self.slot_keys[slots] = keys[order]
        self.slot_values[slots] = log[order]
        del order, slots
        by = np.argsort(keys).astype(np.int32)
        self.keys, self.logs = keys[by], log[by]

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log probabilities, 0 where there is none; places where there is none)."""
        slots = self._slots(keys)
        out = self.slot_values[slots]
        rest = np.flatnonzero(self.slot_keys[slots] != keys)
        out[rest] = 0.0
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys[rest]), len(self.keys) - 1)
            found = self.keys[at] == keys[rest]
            out[rest[found]] = self.logs[at[found]]
            rest = rest[~found]
        return out, rest


def _times(owner: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, key, times) of the distinct pairs, by owner."""
    order = np.lexsort((keys, owner))
    owner, keys = owner[order], keys[order]
    first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])))) if len(keys) else np.zeros(0, np.int64)
    return owner[first], keys[first], np.diff(np.append(first, len(keys)))


def by_escape(asked: DataFrame, strings: DataFrame, order: int) -> DataFrame:
    """``asked`` (gram, texts) with the log probability ``log`` of each string under the whole model ``strings`` (length, gram, n).

    Both are dealt by the last three bytes of the context, which a context shares with all its shorter ones down to three
    bytes; strings of up to three bytes, whose number the alphabet bounds, are read by every worker. The number of
    parts follows that of the strings, so that a part doesn't grow with them.
    """
    rows = asked.count() + strings.where("length > 3").count()
    part = F.pmod(F.xxhash64(F.shiftrightunsigned("gram", 8).bitwiseAND((1 << 24) - 1)), F.lit(max(64, rows // 500_000))).alias("part")
    short = written(strings.where("length <= 3").repartition(4), "short")
    files = short.inputFiles()
    short_dir = files[0].rsplit("/", 1)[0] if files else ""
    columns = ("length", "gram", "n")

    def score(own, wanted):
        if not wanted.num_rows:
            return pa.table({"gram": pa.array([], pa.int64()), "texts": pa.array([], pa.int64()), "log": pa.array([], pa.float64())})
        base = kept(("short", short_dir), lambda: PartialMatching(*(_read(short_dir).column(c).to_numpy() for c in columns), min(order, 2)))
        model = PartialMatching(*(own.column(c).to_numpy() for c in columns), order, base)
        logs = model.log_probabilities(wanted.column("gram").to_numpy().view(U))
        return pa.table({"gram": wanted.column("gram"), "texts": wanted.column("texts"), "log": pa.array(logs)})

    dealt = strings.where("length > 3").select(part, F.col("length").cast("long").alias("length"), "gram", "n").groupBy("part")
    return dealt.cogroup(asked.select(part, "gram", "texts").groupBy("part")).applyInArrow(score, "gram long, texts long, log double")


def _read(uri: str, columns: list[str] | None = None) -> pa.Table:
    import pyarrow.parquet as pq

    fs, path = filesystem(uri)
    return pq.read_table(path, columns=columns, filesystem=fs)


def _loaded(grams: str, words: str) -> tuple[Frequent, dict]:
    """What a worker process looks up, kept from task to task."""

    def load():
        model = Frequent(*(_read(grams, [c]).column(c).to_numpy() for c in ("gram", "n", "log")))  # a column at a time, for memory's sake
        w = _read(words)
        pa.default_memory_pool().release_unused()
        return model, dict(zip(w.column("word").to_pylist(), np.log10(w.column("n").to_numpy() + 1.0).tolist()))

    return kept(("model", grams, words), load)


def score_texts(docs: DataFrame, train_where=None, order: int = 5, most_grams: int = 4_000_000, most_words: int = 200_000, id_col: str = "doc_id", text_col: str = "text", least: int = 1) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row, learning from rows where ``train_where``.

    Null texts are empty: one token, their end. Repeated rows are learnt from and scored each; null ids stay null and
    are rows as others are. Without training texts every byte has the probability 1/256; an empty table gives no
    rows. Very long texts are scored whole. Other columns, whatever their names, play no part. Every byte string counts; with a ``least`` of more than 1, those of over 3 bytes only from so many occurrences on,
    whatever the size of the input. The ``most_grams`` most frequent of the longest strings are looked
    up in workers; all others of a text, known or not, are joined with their probabilities by a shuffle, so that the
    scores don't depend on that number. The same goes for the baseline's ``most_words`` most frequent words.
    """
    rows = id_and_text(docs, id_col, text_col)
    training = rows if train_where is None else rows.where(train_where)
    counts = written(counted(training, order).groupBy("word", "gram").agg(F.sum("n").alias("n")), "counts")
    vocabulary = counts.where("word IS NOT NULL").select("word", "n")
    n_all, v_all, ends = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.max(F.expr("CASE WHEN word = X'' THEN n END")), F.lit(0))).first()

    suffixes = F.inline(F.array(*[F.struct(F.lit(k).alias("length"), (F.col("gram").bitwiseAND((1 << 8 * k) - 1) if k < 8 else F.col("gram")).alias("gram")) for k in range(1, order + 2)]))
    strings = written(counts.where("gram IS NOT NULL").select("n", suffixes).groupBy("length", "gram").agg(F.sum("n").alias("n")).where(F.expr(f"length <= 3 OR n >= {int(least)}")), "strings")
    longest = strings.where(F.col("length") == order + 1)
    frequent = _least_count(longest, most_grams, 1)
    after = Window.partitionBy(F.shiftrightunsigned("gram", 8))  # the symbols after a context, 256 at most
    log = (F.log10("n") - F.log10(F.sum("n").over(after) + F.count("n").over(after))).alias("log")
    grams = written(longest.select("gram", "n", log).where(F.col("n") >= frequent).repartition(8), "grams")
    often = _least_count(vocabulary, most_words, 1)
    head = written(vocabulary.where(F.col("n") >= often).repartition(4), "head")
    grams_at, head_at = grams.inputFiles(), head.inputFiles()
    grams_dir, head_dir = (x[0].rsplit("/", 1)[0] if x else "" for x in (grams_at, head_at))

    def score(batches):
        part, row = TaskContext.get().partitionId(), 0
        model, known = _loaded(grams_dir, head_dir)
        for batch in batches:
            for ids, texts in slices(batch, 2 << 20):
                data = [t.encode() for t in texts]
                keys, sizes = contexts(data, order)
                logs_of, missing = model.find(keys)
                total = np.add.reduceat(logs_of, np.cumsum(sizes) - sizes)
                owner, rest, times = _times(np.repeat(np.arange(len(ids)), sizes)[missing], keys[missing])
                strings_at = np.searchsorted(owner, np.arange(len(ids) + 1)).astype(np.int32)
                others = pa.ListArray.from_arrays(pa.array(strings_at), pa.StructArray.from_arrays([pa.array(rest.view(np.int64)), pa.array(times.astype(np.int32))], ["gram", "times"]))
                n_words, n_known, sums, rare, rare_n, ends_at = [], [], [], [], [], [0]
                for d in data:
                    words = d.translate(LOWER_TABLE).split()
                    logs = [known.get(w) for w in words]
                    tail = Counter([w for w, x in zip(words, logs) if x is None]) if None in logs else ()
                    logs = [x for x in logs if x is not None] if tail else logs
                    n_words.append(len(words))
                    n_known.append(len(logs))
                    sums.append(float(np.sum(logs)) if logs else 0.0)
                    if tail:
                        rare += tail.keys()
                        rare_n += tail.values()
                    ends_at.append(len(rare))
                tails = pa.ListArray.from_arrays(pa.array(ends_at, pa.int32()), pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(rare_n, pa.int32())], ["word", "times"]))
                at = part * 2**33 + row + np.arange(len(ids))
                row += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_known, pa.int64()), pa.array(sums, pa.float64()), pa.array(total), tails, others], ["row", "doc_id", "n_words", "n_known", "logs", "score", "tail", "others"])

    scored = written(rows.mapInArrow(score, "row long, doc_id long, n_words long, n_known long, logs double, score double, tail array<struct<word:binary,times:int>>, others array<struct<gram:long,times:int>>"), "scored")
    rest = scored.select("row", F.inline("tail")).join(vocabulary.where(F.col("n") < often), "word")
    rest = rest.groupBy("row").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_logs"))
    others = scored.select("row", F.inline("others"))
    found = written(by_escape(written(others.groupBy("gram").agg(F.count(F.lit(1)).alias("texts")), "asked"), strings, order), "found")
    # a string that many texts hold is dealt over salts
    met = spread_join(others, found.select("gram", "log"), "gram", "row", sizes=found.select("gram", F.col("texts").alias("n")))
    more = met.groupBy("row").agg(F.sum(F.col("times") * F.col("log")).alias("more_score"))
    out = scored.drop("tail", "others").join(rest, "row", "left").join(more, "row", "left")
    n_tokens = F.col("n_words") + 1
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) + F.log10(F.lit(float(ends + 1)))
    return out.select(
        "doc_id", n_tokens.alias("n_tokens"), (F.col("n_known") + F.coalesce("more_known", F.lit(0)) + F.lit(1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(int(n_all)).cast("long").alias("train_tokens"), (logs - n_tokens * F.log10(F.lit(float(n_all + v_all + 1)))).alias("base_score"), (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
