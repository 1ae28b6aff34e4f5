import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from darkroom.llm import language_id
from darkroom.llm.common import crc_mod

SF = "/root/testdata/sf0.01"


def test_windows_hold_every_byte():
    texts = [b"", b"x", b"y" * 252, b"z" * 253, b"a" * 256, b"b" * 1000, b"c" * 508]
    data, n = language_id.windows_of(texts)
    at = 0
    for text, k in zip(texts, n):
        part = data[at * 256 : (at + k) * 256].tobytes()
        assert part[: len(text)] == text and not any(part[len(text) :]) and len(part) - len(text) >= language_id.WIDEST - 1
        at += k
    assert len(data) == at * 256 + language_id.WIDEST


def test_network_against_plain_loops():
    """Convolution, greatest values, softmax and the mean over windows, place by place."""
    net = language_id.ByteNetwork(["a", "b", "c"])
    net.shift += 0.1
    texts = ["Die schöne Straße. ".encode() * 40, b"x", b"hello there" * 30]
    best, score = net.judge(texts)
    data, n = language_id.windows_of(texts)
    at = 0
    for text, k, b, s in zip(texts, n, best, score):
        odds = np.zeros(3)
        for w in range(k):
            peaks = [max(float(np.concatenate(net.embed[data[(at + w) * 256 + p : (at + w) * 256 + p + 5]]) @ net.filters[:, f]) for p in range(256)) for f in range(language_id.FILTERS)]
            z = np.maximum(np.array(peaks) + net.shift, 0) @ net.out + net.bias
            odds += (z - np.log(np.exp(z).sum())) * max(0, min(256, len(text) - 256 * w)) / len(text)
        share = np.exp(odds) / np.exp(odds).sum()
        assert b == share.argmax() and abs(s - share.max()) < 1e-4
        at += k


def test_gradients_by_differences():
    net = language_id.ByteNetwork(["a", "b"], seed=3)
    for name in ("embed", "filters", "shift", "out", "bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    net.shift += 0.2
    rng = np.random.default_rng(0)
    windows, target, weight = rng.integers(1, 256, (3, 260)).astype(np.uint8), np.array([0, 1, 1]), np.array([1.0, 2.0, 0.5])

    def loss():
        seen = np.stack([net.embed[windows[:, j : j + 256]] for j in range(5)], axis=2).reshape(3, 256, -1)
        hidden = np.maximum((seen @ net.filters).max(axis=1) + net.shift, 0)
        return -(language_id._log_softmax(hidden @ net.out + net.bias)[np.arange(3), target] * weight).mean()

    for p, g in zip((net.embed, net.filters, net.shift, net.out, net.bias), net._gradients(windows, target, weight)):
        where = np.flatnonzero(np.abs(g).ravel() > 1e-3)[:4]
        assert len(where)
        for i in where:
            old, h = p.flat[i], 1e-5
            p.flat[i] = old + h
            up = loss()
            p.flat[i] = old - h
            assert abs((up - loss()) / (2 * h) - g.flat[i]) < 1e-4 * max(1, abs(g.flat[i]))
            p.flat[i] = old


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert len(got) > 200 and np.mean([r["lang"] == r["lang_pred"] for r in got]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = language_id.identify(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    want = sorted((-1 if r[0] is None else r[0], r[1]) for r in odd_docs.select("doc_id", crc_mod(F.col("doc_id"), 4) == 2).collect())
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["held_out"]) for r in rows) == want
    by_id = {r["doc_id"]: r for r in rows}
    assert all((by_id[i]["lang_pred"], by_id[i]["score"]) == ("und", 0.0) for i in (2, 3, 4))
    assert by_id[8]["lang_pred"] in ("en", "fr") and by_id[5]["lang_pred"] in ("en", "fr")
    assert len({(r["lang_pred"], r["score"]) for r in rows if r["doc_id"] == 1}) == 1
    assert language_id.identify(no_docs).collect() == []
    blank = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {(r["lang_pred"], r["score"]) for r in language_id.identify(blank).collect()} == {("und", 0.0)}
    marks = spark.createDataFrame([(1, "12345 !!", "en"), (2, "12345 é", "en")], "doc_id long, text string, lang string")
    assert [r["lang_pred"] for r in language_id.identify(marks, held_out=None).orderBy("doc_id").collect()] == ["und", "en"]


def test_sample_is_bounded(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words "), F.repeat(F.lit("ab "), F.lit(400))).alias("text"), F.when(F.col("id") % 50 == 0, "xx").otherwise("yy").alias("lang"))
    docs = docs.unionByName(spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same").alias("text"), F.lit("yy").alias("lang")))
    got = language_id.sample(docs, lambda i: F.lit(True), 100, 3, "doc_id", "text", "lang").groupBy("lang").count().collect()
    sizes = {r["lang"]: r["count"] for r in got}
    assert sizes["xx"] == 3 * 60 and 290 <= sizes["yy"] <= 300
