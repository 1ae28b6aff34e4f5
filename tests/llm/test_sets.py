import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from darkroom.llm import common, decontamination, near_dedup, sharding
from darkroom.operators import skew

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_decontamination(docs, items, window):
    out = []
    cut = [(str(i), w, min(window, len(w))) for i, t in items if i is not None and (w := re.findall(WORD, ascii_lower(t)))]
    for doc_id, text in docs:
        words = re.findall(WORD, ascii_lower(text))
        hit, found = set(), set()
        for item, w, n in cut:
            wanted = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
            for k in range(len(words) - n + 1):
                if tuple(words[k : k + n]) in wanted:
                    hit.update(range(k, k + n))
                    found.add(item)
        out.append((doc_id, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("most_broadcast", [100_000, 7])
def test_decontamination(spark, odd_docs, most_broadcast, monkeypatch):
    whole = decontamination.contained_windows
    monkeypatch.setattr(decontamination, "contained_windows", lambda d, w, keep: whole(d, w, keep, most_broadcast))
    monkeypatch.setattr(skew, "HOT_ROWS", 5)
    rng = random.Random(4)
    vocabulary = ["a", "B", "c", "É", "é", "kK", "İ", "x1", "the", "dog"]
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.where("doc_id IS NULL OR doc_id NOT IN (5, 6)").select("doc_id", "text").collect()]
    docs += [(100 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))) + rng.choice(["", ".", "\n"])) for i in range(60)]
    items = [(1, "The QUICK brown fox jumps over the lazy dog"), (2, "a b c"), (2, "dog"), (3, None), (4, ""), (None, "dog"), (5, "x1 the"), (6, " ".join(rng.choice(vocabulary) for _ in range(14))), (7, "é c"), (8, "quick brown fox jumps over the lazy dog and then it sleeps the quick")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("words", F.lit(1))
    b = spark.createDataFrame(items, "item_id long, text string")
    for window in (10, 4):
        got = sorted(map(tuple, decontamination.decontaminate(d, b, window).collect()), key=str)
        assert got == brute_decontamination(docs, items, window)


def test_decontamination_of_nothing(odd_docs, no_docs, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.decontaminate(odd_docs, none).where("contaminated").count() == 0
    assert decontamination.decontaminate(no_docs, none).count() == 0


def shingles(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def test_super_minhash_estimates_similarity():
    rng = np.random.default_rng(5)
    for n in (1, 7, 60, 900):
        a = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
        x, y = np.unique(a[: int(1.5 * n) + 1]), np.unique(a[n // 2 :])
        s = near_dedup.super_minhash([x, y, x], 180)
        true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        assert (s[0] == s[2]).all() and abs((s[0] == s[1]).mean() - true) < 0.15
        assert sorted(s[0] >> 24)[-1] < 180


def near_docs():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(40)]
    docs, i = [], 0
    for family in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([3, 8, 60, 120]))]
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            if family % 2:
                copy = passage + copy
            docs.append((i, " ".join(copy)))
            i += 1
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("leaders, most_broadcast", [(2, 1000), (0, 0)])
def test_near_duplicates(spark, odd_docs, leaders, most_broadcast, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 3)  # so that keys of a few rows are dealt over salts
    docs = near_docs() + [(1000 + (r["doc_id"] or 0), r["text"]) for r in odd_docs.where("doc_id NOT IN (1, 7)").select("doc_id", "text").collect()]
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rep", F.lit("x"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df, leaders=leaders, most_broadcast=most_broadcast).collect()}
    assert got == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


@pytest.mark.parametrize("leaders", [2, 0])
def test_near_duplicates_of_an_id_with_two_texts(spark, leaders):
    one, two = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    docs = [(7, one), (7, two), (20, one + " end"), (21, two + " end"), (30, "another text that is like none of these")]
    df = spark.createDataFrame(docs if leaders else docs[1::-1] + docs[2:], "doc_id long, text string").coalesce(1)  # in either order
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df, leaders=leaders).collect()}
    assert got == {(7, 7, True), (20, 7, False), (21, 7, False), (30, 30, True)}


def test_spread_join(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    large = spark.range(500).select((F.col("id") % 7 * (F.col("id") % 3)).alias("k"), F.col("id").alias("x"))
    small = spark.createDataFrame([(0, "a"), (0, "b"), (2, "c"), (99, "d")], "k long, v string")
    dealt, hot = common.salted(large, "k", "x")
    assert hot is not None and dealt.where("k = 0").select("_salt").distinct().count() > 5
    for how in ("inner", "left"):
        assert sorted(map(tuple, common.spread_join(large, small, "k", "x", how).collect()), key=str) == sorted(map(tuple, large.join(small, "k", how).collect()), key=str)


def test_scratch_is_removed(spark):
    with common.scratch(spark) as path:
        assert common.written(spark.range(3), "three").count() == 3
        assert os.listdir(path.removeprefix("file:")) != []
    assert not os.path.exists(path.removeprefix("file:"))


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    rows = near_dedup.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_id = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in rows)
    assert by_id[(None, None, True)] == 2 and by_id[(1, 1, True)] == 2 and by_id[(6, 5, False)] == 1 and by_id[(7, 7, True)] == 2
    assert near_dedup.near_duplicates(no_docs).count() == 0


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)]
    edges = [(a, b) for a, b in edges if a != b]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert near_dedup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_best_fit_decreasing_against_brute_force():
    rng = random.Random(8)
    for _ in range(200):
        capacity = rng.randint(5, 40)
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(0, 30))]
        rooms, want = [], {}
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            fit = [(r, b) for b, r in enumerate(rooms) if r >= sizes[i]]
            if fit:
                rooms[min(fit)[1]] -= sizes[i]
                want[i] = min(fit)[0]
            else:
                rooms.append(capacity - sizes[i])
                want[i] = capacity
        classes = sorted(Counter(sizes).items(), reverse=True)
        dealt = sharding.best_fit_decreasing(classes, capacity)
        used = Counter()
        for (size, n), runs in zip(classes, dealt):
            assert sum(k for _, k in runs) == n and all(k > 0 for _, k in runs)
            for b, k in runs:
                used[b] += size * k
        assert sorted(used.values()) == sorted(capacity - r for r in rooms)
    assert sharding.best_fit_decreasing([(3, 2)], 4, 1) is None
    assert sharding.smallest_capacity([(5, 4)], 2) == [[(1, 2), (0, 2)]]
    for _ in range(60):  # the least capacity by trying each one
        sizes, bins = sorted(Counter(rng.randint(1, 30) for _ in range(rng.randint(1, 25))).items(), reverse=True), rng.randint(1, 6)
        level = Counter()
        for (size, _), runs in zip(sizes, sharding.smallest_capacity(sizes, bins)):
            for b, k in runs:
                level[b] += size * k
        fits = [c for c in range(1, 800) if sizes[0][0] <= c and sharding.best_fit_decreasing(sizes, c, bins) is not None]
        assert sum(level.values()) == sum(s * n for s, n in sizes) and len(level) <= bins
        assert max(level.values()) <= next(c for c in fits if all(k in fits for k in range(c, min(c + 31, 800))))


def test_shards(spark, odd_docs, no_docs):
    rng = random.Random(9)
    docs = [(i, "x" * rng.randint(0, 400)) for i in range(900)] + [(2000 + i, "copied text") for i in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("unit", F.lit(1))
    rows = sharding.shard(frame, n_shards=6).collect()
    size = Counter()
    for r in rows:
        size[r["shard"]] += r["size"]
    text = dict(docs)
    assert all(r["size"] == len(text[r["doc_id"]]) + 8 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) for r in rows)
    assert max(size.values()) - min(size.values()) <= 0.02 * max(size.values())
    for s in size:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    of_text = {}
    for r in rows:
        of_text.setdefault(text[r["doc_id"]], set()).add(r["shard"])
    assert all(len(x) == 1 for x in of_text.values())
    odd = sharding.shard(odd_docs, n_shards=3).collect()
    assert len(odd) == odd_docs.count()
    few = spark.createDataFrame([(i, "z" * (i % 5)) for i in range(40)], "doc_id long, text string")  # groups of 8 rows, of five sizes
    of_text = {}
    for r in sharding.shard(few, n_shards=4).collect():
        of_text.setdefault(r["size"], set()).add(r["shard"])
    assert all(len(x) == 1 for x in of_text.values())
    hot = spark.createDataFrame([(i, "hot " * 50) for i in range(600)] + [(1000 + i, "y" * i) for i in range(300)], "doc_id long, text string")
    of_shard = Counter()
    for r in sharding.shard(hot, n_shards=5).collect():
        of_shard[r["shard"]] += r["size"]
    assert max(of_shard.values()) <= 1.05 * min(of_shard.values())  # a group larger than a shard is dealt out
    assert sharding.shard(no_docs).count() == 0
