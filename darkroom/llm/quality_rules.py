"""Quality rules: statistics of whole texts, fixed limits, and an isolation forest for what is odd in other ways."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filtered, gathered, id_and_text, labelled, labelled_sample, slices, written

BLANK, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"  # fixed values, as the contract states them
UPPER = bytes(range(65, 91))
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_bang"]
N_CONTRACT = 5  # how many of them the result carries


def text_stats(texts: list[str | None]) -> np.ndarray:
    """STATS of each text as int64 (texts x statistics); zeros for null and empty texts."""
    out = np.zeros((len(texts), len(STATS)), np.int64)
    hashes, counts = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if not text:
            continue
        data = text.encode()
        words = data.split()
        lines = [line for line in data.split(b"\n") if line.strip()]
        counts[i] = len(words)
        hashes.append(np.fromiter(map(hash, words), np.int64, len(words)))
        bare = len(data) - len(data.translate(None, BLANK))
        out[i] = (len(words), len(text) - bare, len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)), 0, len(lines), len(set(words)), len(data) - len(data.translate(None, UPPER)), data.count(b"!"))
    if hashes:
        out[:, 4] = _repeated(np.concatenate(hashes).view(np.uint64), counts)
    return out


def _repeated(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each text, the words in 3-word windows that occur in it twice or more."""
    doc = np.repeat(np.arange(len(counts)), counts)
    if len(h) < 3:
        return np.zeros(len(counts), np.int64)
    inside = doc[2:] == doc[:-2]
    key = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ (h[1:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[1:-1] * np.uint64(0x94D049BB133111EB) + h[2:] * np.uint64(0xD6E8FEB86659FD93) + doc[2:].astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    at = np.flatnonzero(inside)
    order = at[np.argsort(key[at])]
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = twice.copy()
    covered[1:] |= twice[:-1]
    covered[2:] |= twice[:-2]
    return np.bincount(doc[covered], minlength=len(counts))


LEAST_RATE = 0.005  # rates well below it are alike


def features(stats: np.ndarray) -> np.ndarray:
    """What the forest sees: rates, so that length, which has a limit of its own, decides little, as logarithms of the rate and
    LEAST_RATE. Cuts are drawn evenly over a span, so that on this scale one is as likely between 0 and 1 % as between 10 and 30 %."""
    words, chars, symbols, dup, repeat, lines, distinct, upper, bang = stats.T.astype(float)
    n, c = np.maximum(words, 1), np.maximum(chars, 1)
    return np.log(LEAST_RATE + np.column_stack([chars / n, symbols / c, dup / np.maximum(lines, 1), repeat / n, distinct / n, upper / c, bang / n]))


class IsolationForest:
    """Random splits on random subsamples; few splits to reach a row mean that it is unlike the others.

    A cut is drawn from the whole span that a node can hold, which starts as the span ``low`` .. ``high`` of all rows that
    may come, and not from the span of the rows in it: so rows that lie where none of ``rows`` does are soon alone,
    also by a feature in which ``rows`` don't differ.
    """

    def __init__(self, rows: np.ndarray, trees: int = 100, subsample: int = 256, seed: int = 11, low: np.ndarray | None = None, high: np.ndarray | None = None):
        rng = np.random.default_rng(seed)
        m = min(subsample, len(rows))
        low = rows.min(0) if low is None else np.minimum(low, rows.min(0))
        high = rows.max(0) if high is None else np.maximum(high, rows.max(0))
        self.depth = 2 * max(1, int(np.ceil(np.log2(max(m, 2)))))  # many cuts part no rows
        self.expected = max(self._mean_path(np.array([m]))[0], 1.0)
        self.trees = [self._grow(rows[rng.choice(len(rows), m, replace=False)], low, high, rng) for _ in range(trees)]

    @staticmethod
    def _mean_path(n: np.ndarray) -> np.ndarray:
        """The mean depth of a random search tree over n rows."""
        n = np.asarray(n, float)
        return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))

    def _grow(self, rows, low, high, rng):
        nodes = []  # (feature, cut, left, right, path length at a leaf)

        def grow(part, low, high, level):
            at = len(nodes)
            nodes.append(None)
            wide = np.flatnonzero(high > low)
            if level == self.depth or len(part) <= 1 or not len(wide):
                nodes[at] = (-1, 0.0, at, at, level + float(self._mean_path(np.array([len(part)]))[0]))
                return at
            f = int(rng.choice(wide))
            cut = float(rng.uniform(low[f], high[f]))
            below = part[:, f] < cut
            low_right, high_left = low.copy(), high.copy()
            low_right[f] = high_left[f] = cut
            left = grow(part[below], low, high_left, level + 1)
            right = grow(part[~below], low_right, high, level + 1)
            nodes[at] = (f, cut, left, right, 0.0)
            return at

        grow(rows, low, high, 0)
        f, cut, left, right, length = zip(*nodes)
        return np.array(f), np.array(cut), np.array(left), np.array(right), np.array(length)

    def leaves(self, rows: np.ndarray):
        """For each tree, the node where each row ends."""
        each = np.arange(len(rows))
        for f, cut, left, right, _ in self.trees:
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                node = np.where(rows[each, f[node]] < cut[node], left[node], right[node])
            yield node

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1; higher is odder."""
        total = np.zeros(len(rows))
        for tree, node in zip(self.trees, self.leaves(rows)):
            total += tree[4][node]
        return 2.0 ** (-total / len(self.trees) / self.expected)

    def starts(self) -> np.ndarray:
        """The number of each tree's first node if all trees' nodes are numbered on, and at the end how many there are."""
        return np.cumsum([0, *(len(tree[0]) for tree in self.trees)])

    def weighed(self, mass: np.ndarray, rows: int, subsample: int = 256) -> None:
        """Path lengths by how many of all ``rows`` good rows end in each leaf (``mass``, by number), and no more by those of the tree's draw."""
        m = max(2, min(subsample, rows))
        paths, starts = self._mean_path(np.arange(m + 1)), self.starts()
        for k, (f, cut, left, right, length) in enumerate(self.trees):
            level = np.zeros(len(f))
            for node in np.flatnonzero(f >= 0):  # a node comes before those below it
                level[left[node]] = level[right[node]] = level[node] + 1
            own = np.interp(mass[starts[k] : starts[k + 1]] * (m / rows), np.arange(m + 1), paths)
            self.trees[k] = f, cut, left, right, np.where(f < 0, level + own, 0.0)


def calibrated_threshold(scores: np.ndarray, good: np.ndarray, most_good_lost: float, count: np.ndarray | None = None, step: float = 0.0) -> float:
    """The score above which rows are rejected: of those that lose at most ``most_good_lost`` of the good rows, the one with
    the most bad rows caught per class less good ones lost; between two rows' scores it lies in the middle.

    Without bad rows it is the least that loses no more good rows than that; without good rows nothing is rejected. ``count``: the rows
    that each score stands for, by default one. ``step``: scores are rounded up to multiples of it.
    """
    if not good.any():
        return float("inf")
    count = np.ones(len(scores)) if count is None else count
    levels, at = np.unique(scores, return_inverse=True)
    kept, lost = (np.cumsum(np.bincount(at[own], count[own], len(levels))) for own in (good, ~good))  # good and bad rows up to each level
    least = levels[np.searchsorted(kept, min(kept[-1] - 1, np.ceil(kept[-1] * (1 - most_good_lost))), "right")]
    if good.all():
        return float(least)
    cuts = np.append((levels[:-1] + levels[1:] - step) / 2, levels[-1])
    gain = (lost[-1] - lost) / lost[-1] - (kept[-1] - kept) / kept[-1]
    return float(cuts[np.argmax(np.where(cuts >= least, gain, -np.inf))])


FOLDS = 5
DRAWN = 256 * 100  # good rows that trees part: as many as all trees of a forest take
GRID = 2**20  # scores are told apart to this part where the threshold is set


def fold_forest(x: np.ndarray, good: np.ndarray, fold: np.ndarray, k: int, low: np.ndarray, high: np.ndarray) -> IsolationForest:
    """Of the good rows of the other folds; without such rows, of all."""
    others = good & (fold != k)
    return IsolationForest(x[others if others.any() else good], seed=13 + k, low=low, high=high)


def cross_scores(x: np.ndarray, good: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Each row's score by a forest of the good rows of the other folds; a fold without such rows is scored by a forest of all."""
    fold, scores = np.arange(len(x)) % FOLDS, np.zeros(len(x))
    for k in range(FOLDS):
        own = fold == k
        if own.any():
            scores[own] = fold_forest(x, good, fold, k, low, high).score(x[own])
    return scores


def failed(n_words, n_repeat_words, min_words: int, most_repeated: int):
    """The fixed limits, of columns or arrays."""
    return (n_words < min_words) | (100 * n_repeat_words > most_repeated * n_words)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, stats) of every row."""

    def measure(batches):
        for batch in batches:
            for ids, texts in slices(batch, 4 << 20):
                yield _record(doc_id=(ids, pa.int64()), stats=(text_stats(texts).tolist(), pa.list_(pa.int64())))

    return id_and_text(docs, id_col, text_col).mapInArrow(measure, "doc_id long, stats array<long>")


def _record(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in columns.values()], list(columns))


def _table(column) -> np.ndarray:
    """An Arrow column of STATS as rows of numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(STATS))


def fit(docs: DataFrame, labels: DataFrame, min_words: int, most_repeated: int, most_rows: int | None = None, most_good_lost: float = 0.005, id_col: str = "doc_id", text_col: str = "text"):
    """(forest, threshold) from all labelled rows, or those of at most ``most_rows`` ids if that is given."""
    return fit_measured(written(measured(docs, id_col, text_col), "stats"), labels, min_words, most_repeated, most_rows, most_good_lost)


def fit_measured(stats: DataFrame, labels: DataFrame, min_words: int, most_repeated: int, most_rows: int | None = None, most_good_lost: float = 0.005):
    """``fit``, from the rows of ``measured``.

    Labelled rows that pass the fixed limits count: the forest judges no others. An id with several texts gives one row, that with
    the least statistics. Spans, the mass of each leaf and the threshold come from all these rows; of a draw of DRAWN good ones
    each tree takes 256, as the method has it, and these only say how far its nodes are parted. Trees are weighed by good rows alone, in the
    span of good and bad ones. The threshold is cross-fitted: each of FOLDS parts of the rows is scored by a forest that was grown and
    weighed on the others, and ``calibrated_threshold`` sees how many rows have each score, to a GRID-th, so that every row sets it
    and none is scored by trees that it grew; the forest that then judges is one of all good rows. The driver gets the draw, a number for each
    leaf, and two for each score. Without good labelled rows there is no forest, and only the fixed limits hold.
    """
    chosen = labelled(labels) if most_rows is None else labelled_sample(labels, most_rows).drop("draw")
    rows = stats.join(chosen, "doc_id").groupBy("doc_id").agg(F.min("stats").alias("stats"), F.min("label").alias("label"))
    n_words, n_repeat = F.col("stats")[STATS.index("n_words")], F.col("stats")[STATS.index("n_repeat_words")]
    rows = rows.where(~failed(n_words, n_repeat, min_words, most_repeated)).withColumn("draw", F.xxhash64("doc_id", F.lit(17)))
    rows = rows.select("draw", F.pmod("draw", F.lit(FOLDS)).cast("int").alias("fold"), (F.col("label") == 1).alias("good"), "stats")
    rows = written(gathered(rows), "labelled")
    drawn = rows.where("good").orderBy("draw", "stats").limit(DRAWN).toArrow().combine_chunks()
    if not drawn.num_rows:
        return None, float("inf")

    def span(batches):
        for batch in batches:
            if batch.num_rows:
                x = features(_table(batch.column(0)))
                yield _record(low=([x.min(0).tolist()], pa.list_(pa.float64())), high=([x.max(0).tolist()], pa.list_(pa.float64())))

    spans, n = rows.select("stats").mapInArrow(span, "low array<double>, high array<double>"), range(features(np.zeros((1, len(STATS)))).shape[1])
    ends = spans.agg(*[F.min(F.col("low")[k]) for k in n], *[F.max(F.col("high")[k]) for k in n]).first()
    low, high = np.array(ends[: len(n)]), np.array(ends[len(n) :])
    sizes = {r["fold"]: (r["n"], r["good"]) for r in rows.groupBy("fold").agg(F.count("*").alias("n"), F.count_if("good").alias("good")).collect()}
    n_good = sum(g for _, g in sizes.values())

    draw = drawn.sort_by("draw")
    x, fold = features(_table(draw["stats"].combine_chunks())), draw["fold"].to_numpy()
    forests = {k: fold_forest(x, np.ones(len(x), bool), fold, k, low, high) for k in sizes} | {FOLDS: IsolationForest(x, low=low, high=high)}
    alone = {k for k in sizes if n_good == sizes[k][1]}  # no other fold has good rows
    first = dict(zip(forests, np.cumsum([0, *(f.starts()[-1] for f in forests.values())])))

    def weigh(batches):
        mass = np.zeros(sum(f.starts()[-1] for f in forests.values()), np.int64)
        for batch in batches:
            x, fold = features(_table(batch.column(1))), batch.column(0).to_numpy()
            for k, forest in forests.items():
                part = x if k == FOLDS or k in alone else x[fold != k]
                for start, node in zip(first[k] + forest.starts(), forest.leaves(part)):
                    mass[start : start + node.max(initial=0) + 1] += np.bincount(node, minlength=1)
        at = np.flatnonzero(mass)
        yield _record(leaf=(at, pa.int64()), n=(mass[at], pa.int64()))

    found = rows.where("good").select("fold", "stats").mapInArrow(weigh, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).toArrow()
    mass = np.zeros(sum(f.starts()[-1] for f in forests.values()))
    mass[found["leaf"].to_numpy()] = found["n"].to_numpy()
    for k, forest in forests.items():
        forest.weighed(mass[first[k] : first[k] + forest.starts()[-1]], n_good - (sizes[k][1] if k != FOLDS and k not in alone else 0))

    def cross(batches):
        for batch in batches:
            x, fold, cell = features(_table(batch.column(2))), batch.column(0).to_numpy(), np.zeros(batch.num_rows, np.int64)
            for k in np.unique(fold):
                cell[fold == k] = np.ceil(forests[k].score(x[fold == k]) * GRID)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(cell)], ["good", "cell"])

    scores = rows.select("fold", "good", "stats").mapInArrow(cross, "good boolean, cell long").groupBy("good", "cell").agg(F.count("*").alias("n")).toArrow()
    good = scores["good"].to_numpy(zero_copy_only=False).astype(bool) if scores.num_rows else np.zeros(0, bool)
    return forests[FOLDS], calibrated_threshold(scores["cell"].to_numpy() / GRID, good, most_good_lost, scores["n"].to_numpy(), 1 / GRID)


def judge(docs: DataFrame, labels: DataFrame, most_rows: int | None = None, most_good_lost: float = 0.005, min_words: int = 50, most_repeated: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, oddness) of every row.

    Null and empty texts have no words and fail the fixed limits, which are ``min_words`` and ``most_repeated``
    per cent of words in repeated windows. Null and repeated ids stay as they are, and equal texts are judged alike. A
    row as odd as the threshold is kept. Very long texts are measured whole, a few megabytes of texts or one text at a time. An
    empty table gives no rows.
    """
    stats = written(measured(docs, id_col, text_col), "stats")
    forest, threshold = fit_measured(stats, labels, min_words, most_repeated, most_rows, most_good_lost)

    def score(batches):
        for batch in batches:
            table = _table(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(table[:, k]) for k in range(N_CONTRACT)), pa.array(_oddness(forest, table))], ["doc_id", *STATS[:N_CONTRACT], "oddness"])

    scored = stats.mapInArrow(score, "doc_id long, " + ", ".join(f"{s} long" for s in STATS[:N_CONTRACT]) + ", oddness double")
    judged = scored.withColumn("base_failed", failed(F.col("n_words"), F.col("n_repeat_words"), min_words, most_repeated))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("oddness") <= float(threshold)))


def _oddness(forest: IsolationForest | None, stats: np.ndarray) -> np.ndarray:
    return forest.score(features(stats)) if forest is not None else np.zeros(len(stats))


def keep_sound(docs: DataFrame, labels: DataFrame, most_rows: int | None = None, most_good_lost: float = 0.005, min_words: int = 50, most_repeated: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows that ``judge`` keeps, with all their columns; null texts go as empty ones do, repeated rows are judged alike, each by
    its own text whatever its id, and an empty table stays empty."""
    forest, threshold = fit(docs, labels, min_words, most_repeated, most_rows, most_good_lost, id_col, text_col)

    def accept(texts):
        stats = text_stats(texts)
        return ~failed(stats[:, 0], stats[:, 4], min_words, most_repeated) & (_oddness(forest, stats) <= threshold)

    return filtered(docs, accept, text_col)
