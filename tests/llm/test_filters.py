import os
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from darkroom.llm import quality_classifier, quality_rules, queries, url_reputation
from darkroom.llm.common import crc_mod
from darkroom.llm.queries import URL_RULES


def test_rule_statistics():
    texts = ["", None, "a", "a a a a a", "x y z x y z\n\n \nx\nx\n", "É#é <b>\x0b|\x0c a b c\na b c d", "w " * 200 + "# $"] + [" ".join(str(i * j % 7) for i in range(j)) for j in range(60)]
    for text, got in zip(texts, quality_rules.text_stats(texts)):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        seen, dup = set(), 0
        for line in (text or "").split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        assert tuple(got[:5]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered))


def test_forest_finds_what_is_odd():
    rng = np.random.default_rng(0)
    rows = rng.normal(size=(4000, 3))
    odd = rng.normal(7, 0.5, size=(20, 3))
    forest = quality_rules.IsolationForest(np.vstack([rows, odd]))
    assert forest.score(odd).min() > np.quantile(forest.score(rows), 0.99)
    assert len(set(quality_rules.IsolationForest(np.zeros((5, 2))).score(np.zeros((3, 2))))) == 1
    good = np.ones(4000, bool)
    assert (forest.score(rows) > quality_rules.calibrated_threshold(forest.score(rows), good, 0.01)).mean() <= 0.01
    assert quality_rules.calibrated_threshold(np.zeros(0), np.zeros(0, bool), 0.1) == float("inf")


def test_forest_against_brute_force():
    """Path lengths and scores, node by node; leaves know how many rows of a tree's sample end in them."""
    rng = np.random.default_rng(4)
    rows, asked = rng.normal(size=(200, 3)), rng.normal(size=(40, 3)) * 2
    forest = quality_rules.IsolationForest(rows, trees=7, subsample=200, low=np.full(3, -9.0), high=np.full(3, 9.0))

    def walk(tree, row):
        f, cut, left, right, _ = tree
        node, level = 0, 0
        while f[node] >= 0:
            node, level = (left[node] if row[f[node]] < cut[node] else right[node]), level + 1
        return node, level

    def mean_path(n):  # of a search tree over n rows: 2 H(n-1) - 2 (n-1) / n, by the usual estimate of H
        return 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else float(n == 2)

    for row, score in zip(asked, forest.score(asked)):
        total = 0
        for tree in forest.trees:
            inside = Counter(walk(tree, r)[0] for r in rows)
            node, level = walk(tree, row)
            assert abs(tree[4][node] - level - mean_path(inside[node])) < 1e-9 and level <= forest.depth
            total += level + mean_path(inside[node])
        assert abs(score - 2 ** (-total / 7 / mean_path(200))) < 1e-9


def test_forest_sees_a_feature_that_is_constant_among_good_rows():
    rng = np.random.default_rng(2)
    good = np.column_stack([rng.normal(size=2000), np.zeros(2000)])
    bad = np.column_stack([rng.normal(size=150), rng.uniform(0.1, 0.4, 150)])
    both, is_good = np.vstack([good, bad]), np.arange(2150) < 2000
    forest = quality_rules.IsolationForest(good[:1000], low=both.min(0), high=both.max(0))
    scores = forest.score(both)
    threshold = quality_rules.calibrated_threshold(scores, is_good, 0.01)
    assert (scores[~is_good] > threshold).mean() > 0.9 and (scores[is_good] > threshold).mean() <= 0.01


def test_a_bound_on_rows_holds_for_an_id_that_repeats(spark, monkeypatch):
    words = [" ".join(f"v{i * j % 91}" for i in range(60)) for j in range(1, 41)]
    docs = spark.createDataFrame([(1, w) for w in words] + [(2, words[0])], "doc_id long, text string")
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    seen = []
    network, forest = quality_classifier.Network, quality_rules.IsolationForest
    monkeypatch.setattr(quality_classifier, "Network", lambda x, y: seen.append(len(x)) or network(x, y))
    monkeypatch.setattr(quality_rules, "IsolationForest", lambda rows, **k: seen.append(len(rows)) or forest(rows, **k))
    assert quality_classifier.classify(docs, one, held_out=None, most_rows=1).count() == 41
    assert quality_rules.judge(docs, one, most_rows=1, min_words=5).count() == 41
    assert seen == [1, 1, 1]  # the fold's forest and the one that judges


def test_rules_are_set_by_all_labelled_rows(spark, monkeypatch):
    """Also by more than trees draw from: the threshold sees every row, and leaves weigh what all good rows do."""
    docs = spark.range(21_000).select(F.col("id").alias("doc_id"), F.expr("concat('w', id % 97, ' x', id % 31, repeat(' y', cast(id % 7 as int)))").alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    seen, own = [], quality_rules.calibrated_threshold
    monkeypatch.setattr(quality_rules, "calibrated_threshold", lambda scores, *a: seen.append(int(sum(a[2])) if len(a) > 2 else len(scores)) or own(scores, *a))
    quality_rules.fit(docs, labels, 1, 1000)
    assert seen == [21_000]
    monkeypatch.setattr(quality_rules, "DRAWN", 40)
    few = docs.where("doc_id < 300")
    forest, _ = quality_rules.fit(few, labels, 1, 1000)
    x = quality_rules.features(quality_rules.text_stats([r["text"] for r in few.collect()]))
    paths = forest._mean_path(np.arange(257))
    for (f, _, left, right, length), node in zip(forest.trees[:5], forest.leaves(x)):
        mass, level = np.bincount(node, minlength=len(f)), {0: 0}
        for k in np.flatnonzero(f >= 0):
            level[left[k]] = level[right[k]] = level[k] + 1
        assert all(abs(length[k] - level[k] - np.interp(mass[k] * 256 / 300, np.arange(257), paths)) < 1e-9 for k in np.flatnonzero(f < 0))


def test_kept_rows_against_brute_force(spark):
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice([f"w{k}" for k in range(300)], 70)) + ("#" * int(rng.integers(20, 90)) if i % 6 == 0 else "") for i in range(240)] + ["short", "a b c " * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    truth = docs.select("doc_id", (F.col("doc_id") % 6 != 0).cast("int").alias("quality"))
    forest, threshold = quality_rules.fit(docs, truth, 50, 50)
    for r in quality_rules.judge(docs, truth).collect():
        t = texts[r["doc_id"]]
        words, lines = t.split(), [x for x in t.split("\n") if x.split()]
        w, c = max(len(words), 1), max(sum(map(len, words)), 1)
        x = [np.log(0.005 + v) for v in (sum(map(len, words)) / w, len(re.findall(r"[#*$%&|<>]", t)) / c, (len(lines) - len(set(lines))) / max(len(lines), 1), r["n_repeat_words"] / w, len(set(words)) / w, len(re.findall("[A-Z]", t)) / c, t.count("!") / w)]
        length = 0.0
        for f, cut, left, right, leaf in forest.trees:
            node = 0
            while f[node] >= 0:
                node = left[node] if x[f[node]] < cut[node] else right[node]
            length += leaf[node]
        odd = 2 ** (-length / len(forest.trees) / forest.expected)
        assert abs(odd - r["oddness"]) < 1e-9 and r["kept"] == (not r["base_failed"] and r["oddness"] <= threshold)
    bad = quality_rules.judge(docs, truth).where("doc_id % 6 = 0 AND doc_id < 240 AND NOT kept").count()
    assert bad >= 36  # of 40


def test_threshold_is_set_by_forests_that_did_not_see_the_row(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x, good = rng.normal(size=(53, 7)), rng.random(53) < 0.8
    grown = []
    forest = quality_rules.IsolationForest
    monkeypatch.setattr(quality_rules, "IsolationForest", lambda rows, **k: grown.append(rows) or forest(rows, **k))
    scores = quality_rules.cross_scores(x, good, x.min(0), x.max(0))
    for k, rows in enumerate(grown):
        assert {tuple(r) for r in rows} == {tuple(r) for i, r in enumerate(x) if good[i] and i % 5 != k}
        assert np.allclose(scores[k::5], forest(rows, seed=13 + k, low=x.min(0), high=x.max(0)).score(x[k::5]))
    assert len(grown) == 5
    assert len(quality_rules.cross_scores(x[:2], np.array([False, True]), x.min(0), x.max(0))) == 2


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_recall_of_the_query_and_held_out(spark):
    """Labelled bad rows that pass the fixed limits: as the query judges them, and with half of the labels never seen."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").where("quality IS NOT NULL")
    rows = queries.op5_quality_rules(spark, sf).join(labels, "doc_id").where("NOT base_failed").collect()
    bad, good = [r for r in rows if r["quality"] == 0], [r for r in rows if r["quality"] == 1]
    assert len(bad) >= 27 and sum(not r["kept"] for r in bad) >= 0.9 * len(bad)
    assert sum(not r["kept"] for r in good) <= 0.01 * len(good)
    for half in (0, 1):
        judged = quality_rules.judge(docs, labels.where(f"pmod(xxhash64(doc_id), 2) = {half}"))
        rows = judged.join(labels.where(f"pmod(xxhash64(doc_id), 2) <> {half}"), "doc_id").where("NOT base_failed").collect()
        bad, good = [r for r in rows if r["quality"] == 0], [r for r in rows if r["quality"] == 1]
        assert sum(not r["kept"] for r in bad) >= 0.9 * len(bad) and sum(not r["kept"] for r in good) <= 0.02 * len(good)


def test_classifier_against_brute_force(spark):
    """Vectors, pooling and the network's answer by plain loops."""
    texts = ["Red green, blue!!", "green blue RED", "", "one one two (three)", "x" * 300 + " end."] * 4
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    truth = docs.select("doc_id", (F.col("doc_id") % 5 < 2).cast("int").alias("quality"))
    shared, network = quality_classifier.fit(docs, truth)
    index = quality_classifier.index_vectors(quality_classifier.WORDS, 1), quality_classifier.index_vectors(quality_classifier.SHAPES, 2)
    terms = quality_classifier.Terms()
    context = [{}, {}]
    for t in texts:
        w, s, _ = terms.of([t])
        for i in range(len(w)):
            for j in (i - 1, i + 1):
                if 0 <= j < len(w):
                    both = index[0][w[j]] + index[1][s[j]]
                    for k, term in ((0, w[i]), (1, s[i])):
                        context[k][term] = context[k].get(term, 0) + both

    def vector(k, term):
        own, near = index[k][term], context[k].get(term, np.zeros(quality_classifier.DIM))
        return own / max(np.linalg.norm(own), 1e-6) + near / max(np.linalg.norm(near), 1e-6)

    scores = {r["doc_id"]: r["score"] for r in quality_classifier.classify(docs, truth, held_out=None).collect()}
    for i, t in enumerate(texts):
        w, s, n = terms.of([t])
        x = np.concatenate([sum((vector(k, term) for term in own), np.zeros(quality_classifier.DIM)) / max(n[0], 1) for k, own in enumerate((w, s))])
        z = np.clip((x - network.mean) / network.scale, -6, 6)
        hidden = [np.tanh(sum(z[a] * network.w[0][a][b] for a in range(len(z))) + network.w[1][b]) for b in range(32)]
        logit = sum(h * v for h, v in zip(hidden, network.w[2])) + network.w[3][0]
        assert abs(scores[i] - 1 / (1 + np.exp(-logit / network.temperature))) < 1e-3
    assert len(terms.of(["y" * 300])[0]) == 3 and "".join(quality_classifier.in_pieces(["y" * 300 + "z"])) == "y" * 300 + "z"


def test_rules_on_odd_rows(odd_docs, no_docs, labels, no_labels):
    for l in (labels, no_labels):
        rows = quality_rules.judge(odd_docs, l).collect()
        assert len(rows) == odd_docs.count()
        for r in rows:
            assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["kept"] and r["base_failed"])
        kept = quality_rules.keep_sound(odd_docs, l)
        assert kept.columns == odd_docs.columns and kept.count() == sum(r["kept"] for r in rows)
    assert quality_rules.judge(no_docs, labels).count() == quality_rules.keep_sound(no_docs, labels).count() == 0


def test_classifier_on_odd_rows(odd_docs, no_docs, labels, no_labels):
    rows = quality_classifier.classify(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert all(not r["held_out"] for r in rows if r["doc_id"] is None)
    assert quality_classifier.keep_good(odd_docs, labels).count() == sum(r["predicted"] for r in rows)
    assert {r["score"] for r in quality_classifier.classify(odd_docs, no_labels).collect()} == {0.5}
    assert quality_classifier.keep_good(odd_docs, no_labels).count() == odd_docs.count()
    assert quality_classifier.classify(no_docs, labels).count() == 0


def test_classifier_learns_and_never_sees_held_out_labels(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rng = np.random.default_rng(3)
    texts = [" ".join(w.upper() + "!!" if i % 3 == 0 else w for w in rng.choice(words, 40)) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    truth = docs.select("doc_id", (F.col("doc_id") % 3 != 0).cast("int").alias("quality"))
    rows = quality_classifier.classify(docs, truth).where("held_out").collect()
    assert np.mean([r["predicted"] == (r["doc_id"] % 3 != 0) for r in rows]) > 0.97
    held = crc_mod(F.col("doc_id"), 4) == 2
    turned = truth.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r["doc_id"]: r["score"] for r in quality_classifier.classify(docs, turned).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-9 for r in rows)


def test_url_rules_and_reputation(spark):
    urls = [
        "http://a.example.net/en/1?x", "http://example.net/en", "HTTP://A.Example.COM/de/x#f", "http://x.org/fr/", "http://notexample.com/de/", "http://bad.com/1", "http://bad.com/2", None, "no scheme", "http://h", "http://q.co.uk:80/p", "http://good.com/",
    ]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(None, "http://bad.com/3", None), (5, "http://bad.com/1", "y")], "page_id long, url string, verdict string")
    outcomes = spark.createDataFrame([(5, 0)] * 200 + [(11, 1)] * 200 + [(None, 0), (3, None)], "page_id long, good int")
    got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_reputation.judge_urls(pages, outcomes, URL_RULES).collect()]
    by_id = {r[0]: r[1:] for r in got}
    assert len(got) == pages.count()
    assert by_id[0] == ("a.example.net", "/en/1", "example.net/en/", "allow") and by_id[1] == ("example.net", "/en", "net/", "block")
    assert by_id[2] == ("a.example.com", "/de/x", "example.com/de/", "block") and by_id[3][2:] == ("org/fr/", "allow") and by_id[4][2] is None
    assert by_id[5] == ("bad.com", "/1", None, "block") and by_id[6][3] == "block" and by_id[None][3] == "block" and by_id[11][3] == "allow"
    assert by_id[7][:2] == by_id[8][:2] == ("", "") and by_id[9][:2] == ("h", "") and by_id[10][:2] == ("q.co.uk:80", "/p")
    assert url_reputation.judge_urls(pages.limit(0), outcomes, URL_RULES).count() == 0
    assert {r["rate"] for r in url_reputation.judge_urls(pages, outcomes.limit(0), URL_RULES).collect()} == {0.5}


def test_names_domains_and_suffixes(spark):
    cases = {
        "a.b.co.uk:80": ("a.b.co.uk", "b.co.uk", "co.uk"), "shop.com:8080": ("shop.com", "shop.com", "com"), "user:pw@www.shop.com": ("www.shop.com", "shop.com", "com"), "www.evil.com.": ("www.evil.com", "evil.com", "com"),
        "192.168.0.1": ("192.168.0.1", "192.168.0.1", ""), "10.9.0.1:8080": ("10.9.0.1", "10.9.0.1", ""), "[2001:db8::1]:443": ("[2001:db8::1]", "[2001:db8::1]", ""), "localhost": ("localhost", "localhost", ""),
        "": ("", "", ""), "...": ("", "", ""), "x.y.z.org.:80": ("x.y.z.org", "z.org", "org"), "1.2.3.com": ("1.2.3.com", "3.com", "com"),
    }
    frame = spark.createDataFrame([(k,) for k in cases], "host string").withColumn("name", url_reputation.name_of(F.col("host")))
    frame = frame.withColumn("domain", url_reputation.domain_of(F.col("name"))).withColumn("suffix", url_reputation.suffix_of(F.col("domain")))
    assert {r["host"]: (r["name"], r["domain"], r["suffix"]) for r in frame.collect()} == cases


def test_query_where_reputation_blocks(spark, tmp_path):
    """The query and its SQL on pages of good and bad hosts, most of them on one; ids repeat, are null or have no outcome."""
    rng = np.random.default_rng(4)
    hosts = ["bad.com", "bad.com:8080", "me@bad.com.", "www.bad.com", "good.org", "a.good.org", "10.0.0.1", "10.0.0.2", "other.co.uk", "new.co.uk", "", "x.net"]
    rows, labels = [], []
    for i in range(3000):
        host = hosts[0] if i % 3 == 0 else hosts[int(rng.integers(len(hosts)))]
        rows.append((None if i % 17 == 0 else i - i % 5 if i % 11 == 0 else i, None if i % 101 == 0 else f"http://{host}/p{i % 7}", "x"))
        low = "bad" in host or host == "10.0.0.1"
        if i % 2 and host != "new.co.uk":
            labels.append((i, int(rng.random() < (0.1 if low else 0.9)), int(rng.random() < 0.02)))
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels + labels[:9], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op8_url_reputation(spark, str(tmp_path))
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLES['op8_url_reputation']})").fetchall()
    order = lambda rows: sorted([tuple(r) for r in rows], key=str)
    for a, b in zip(order(got.collect()), order(want), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 2e-6 and abs(a[6] - b[6]) < 2e-6
    verdict = {r["host"]: r["verdict"] for r in got.where("rule IS NULL").collect()}
    assert all(verdict[h] == ("block" if "bad" in h or h == "10.0.0.1" else "allow") for h in verdict)
    assert {r["rate"] for r in got.where("host IN ('bad.com', 'bad.com:8080', 'me@bad.com.')").collect()} == {r["rate"] for r in got.where("host = 'bad.com'").collect()}


def test_beta_law(spark):
    cases = [(0.2, 0.3), (1.0, 1.0), (2.5, 7.0), (30.0, 60.5), (200.0, 260.0), (3000.0, 3100.0), (1.0, 999.0), (480.0, 1.5)]
    frame = spark.createDataFrame(cases, "a double, b double")
    for x in (0.5, 0.3):
        for a, b, got in frame.select("a", "b", url_reputation.beta_below(F.col("a"), F.col("b"), x)).collect():
            u = (np.arange(400_000) + 0.5) / 400_000  # t = u^k takes the pole at 0 away, and the other end likewise
            parts = []
            for p, q, end in ((a, b, x), (b, a, 1 - x)):
                k = max(1.0, 1 / p)
                t = end * u**k
                parts.append((p - 1) * np.log(t) + (q - 1) * np.log1p(-t) + np.log(end * k) + (k - 1) * np.log(u))
            top = max(p.max() for p in parts)
            low, high = (np.exp(p - top).sum() for p in parts)
            assert abs(got - low / (low + high)) < (1e-5 if a + b <= 500 else 3e-3), (a, b, x)
