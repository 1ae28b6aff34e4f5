import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from darkroom.llm.lm_scoring import PartialMatching, Tally, contexts, score_texts
from darkroom.operators import skew


def counted(data, order):
    grams = [Counter() for _ in range(order + 2)]
    for d in data:
        x = b"\xff" * order + d + b"\xff"
        for i in range(order, len(x)):
            for n in range(1, order + 2):
                grams[n][x[i - n + 1 : i + 1]] += 1
    return grams


def probability(grams, order, context, symbol):
    excluded, p = set(), 1.0
    for j in range(order, -1, -1):
        above = context[len(context) - j :] if j else b""
        seen = {g[-1]: n for g, n in grams[j + 1].items() if g[:-1] == above}
        live = {s: n for s, n in seen.items() if s not in excluded}
        n, d = sum(live.values()), len(live)
        if symbol in live:
            return p * live[symbol] / (n + d)
        if d:
            p *= d / (n + d)
        excluded |= set(seen)
    return p / (256 - len(excluded))


def brute(grams, order, d):
    x = b"\xff" * order + d + b"\xff"
    return sum(math.log10(probability(grams, order, x[i - order : i], x[i])) for i in range(order, len(x)))


def test_model_against_brute_force():
    train = [t.encode() for t in ("abracadabra", "abracadabrx banana", "cab", "", "zz", "the cat sat on the mat the cat", "été") * 2]
    for order in (1, 3, 5):
        grams = counted(train, order)
        grams[order + 1] = Counter({g: n for g, n in grams[order + 1].items() if n >= 3 or order < 3})
        rows = [(n, int.from_bytes(g, "big"), c) for n in range(1, order + 2) for g, c in grams[n].items()]
        model = PartialMatching(*(np.array(x, np.int64) for x in zip(*rows)), order)
        for d in (b"abracadabra cat", b"xyz", b"", "the maté".encode()):
            keys, _ = contexts([d], order)
            assert abs(model.log_probabilities(keys).sum() - brute(grams, order, d)) < 1e-5
    # a distribution: the probabilities of all symbols after a context add up to one
    total = sum(probability(counted(train, 3), 3, b"abr", s) for s in range(256))
    assert abs(total - 1) < 1e-9


def test_contexts_and_tally():
    data = [b"abc", b"", b"z"]
    for order in range(1, 8):
        keys, counts = contexts(data, order)
        want = [int.from_bytes(x[i - order : i + 1], "big") for d in data for x in [b"\xff" * order + d + b"\xff"] for i in range(order, len(x))]
        assert keys.tolist() == want and counts.tolist() == [4, 1, 2]
    tally = Tally(most=10)
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 50, 40).astype(np.uint64) for _ in range(9)]
    for p in parts:
        tally.add(p)
    assert dict(zip(*(x.tolist() for x in tally.merge()))) == dict(Counter(np.concatenate(parts).tolist()))


def test_scores(spark, odd_docs, no_docs):
    train = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(True))
    docs = odd_docs.where("doc_id IS NULL OR doc_id != 6")
    for most_words in (100_000, 3):  # with few words looked up, the rest are joined
        rows = score_texts(docs, train, most_words=most_words).collect()
        texts = [(r["doc_id"], (r["text"] or "")) for r in docs.select("doc_id", "text").collect()]
        lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
        tokens = [(i, t.encode().translate(lower).split() + [None]) for i, t in texts]
        counts = Counter(w for i, ws in tokens if i is None or i % 2 == 0 for w in ws)
        n, v = sum(counts.values()), len(counts)
        want = sorted((-1 if i is None else i, len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in tokens)
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows) == want
        assert all(r["score"] < 0 for r in rows)
    none = score_texts(docs, F.lit(False)).collect()
    assert all(r["train_tokens"] == r["n_known"] == 0 and r["base_score"] == 0 for r in none)
    assert min(abs(r["score"] + math.log10(256)) for r in none) < 1e-9  # the end alone, at 1/256
    assert score_texts(no_docs, train).count() == 0


def test_scores_against_brute_force_with_rare_strings_kept_out(spark):
    texts = ["the cat sat", "the cat sat on", "a mat", "the mat", "on the mat", "zebra"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    grams = counted([t.encode() for t in texts], 5)
    for n in (4, 5, 6):
        grams[n] = Counter({g: c for g, c in grams[n].items() if c >= 2})
    got = {r["doc_id"]: r["score"] for r in score_texts(docs, least=2).collect()}
    assert all(abs(got[i] - brute(grams, 5, t.encode())) < 1e-4 for i, t in enumerate(texts))


@pytest.mark.parametrize("most_grams, hot_rows", [(8_000_000, 200), (10, 200), (0, 1)])  # with 1, all strings of two texts are dealt over salts
def test_scores_do_not_depend_on_what_workers_look_up(spark, monkeypatch, most_grams, hot_rows):
    monkeypatch.setattr(skew, "HOT_ROWS", hot_rows)
    texts = ["the cat sat", "the cat sat on", "a mat", "the mat", "on the mat", "zebra", "", "été 中文"]
    other = ["the bat sat on a zebra", "xyz", "the cats", "", "中文字"]
    docs = spark.createDataFrame(list(enumerate(texts + other)), "doc_id long, text string")
    for least in (1, 2):
        grams = counted([t.encode() for t in texts], 5)
        for n in (4, 5, 6):
            grams[n] = Counter({g: c for g, c in grams[n].items() if c >= least})
        got = {r["doc_id"]: r["score"] for r in score_texts(docs, F.col("doc_id") < len(texts), most_grams=most_grams, least=least).collect()}
        assert all(abs(got[i] - brute(grams, 5, t.encode())) < 1e-4 for i, t in enumerate(texts + other))
