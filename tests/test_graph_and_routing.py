"""Routing by tables, joins with hot keys, and rounds over graphs, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from darkroom.operators import graph, pdf, skew
from darkroom.streaming import watch
from darkroom.streaming.routing import routed_by_table


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(3)
    folders = ["/", "/a", "/a/b", "/a/b/c", "/ab", "/a b", "rel", "rel/x", "/é"]
    paths = [f"{rng.choice(folders).rstrip('/')}/{rng.choice(['x.png', 'y.MP4', 'z.txt', '.h.png', 'w.pdf', 'v.wav', 'b', 'q.png~', 'k.png'])}" for _ in range(300)]
    paths += ["/a/b/c.png", "x.png", "//a//y.png", None, ""] + ["/a/hot/1.png"] * 900
    return spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "n int, path string").withColumn("target_", F.lit("clash"))


TARGETS = [("/a/b/", "image", "one"), ("/a", "video", "two"), ("/a/b", "all", "three"), ("/a/b/c.png", "", "itself"), ("/ab", "other", "four"), ("rel", "pdf", "five"), ("/a/hot", "image", "hot"), ("/", "audio", "root"), ("/a b", "image", "blank")]


def test_table_routes_as_the_list_does(spark, events):
    table = spark.createDataFrame([(i, *t) for i, t in enumerate(TARGETS)] + [(99, None, "all", "never"), (98, "/nowhere", "all", "x")] + [(5000 + i, f"/many/{i}", "all", "m") for i in range(3000)], "target int, folder string, file_type string, pipeline string")
    got, want = routed_by_table(events, table), watch.routed(events, TARGETS)
    assert got.columns == [*events.columns, "target", "pipeline"]
    key = lambda rows: sorted((r["n"], r["path"], r["target"], r["pipeline"]) for r in rows.collect())
    assert key(got) == key(want) and got.count() > 900
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert routed_by_table(events, table.limit(0)).count() == routed_by_table(events.limit(0), table).count() == 0


def test_hot_keys_are_dealt_over_tasks(spark):
    large = spark.range(3000).select(F.when(F.col("id") < 2000, "hot").when(F.col("id") < 2100, None).otherwise(F.col("id").cast("string")).alias("k"), "id")
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("2500", 3), (None, 4)], "k string, v int")
    dealt, hot = skew.salted(large, "k", "id")
    assert [r["_hot"] for r in hot.collect()] == ["hot"] and dealt.where("k = 'hot'").groupBy("_salt").count().agg(F.max("count")).first()[0] < 400
    for how in ("inner", "left"):
        a = skew.spread_join(large, small, "k", "id", how).select("k", "id", "v")
        b = large.join(small, "k", how).select("k", "id", "v")
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_boxes_are_inherited_as_a_walk_does(spark):
    rng = random.Random(5)
    nodes = []
    for file in ("x", "y", None):
        n = 120
        for i in range(n):
            parent = i - 1 if file == "x" else rng.choice([None, rng.randrange(n), rng.randrange(n), n + 5])
            nodes.append((file, i, parent, [float(i)] if (i == 3 if file == "x" else rng.random() < 0.2) else None))
    table = spark.createDataFrame(nodes, "file string, object int, parent int, value array<double>")
    by = {(f, o): (p, v) for f, o, p, v in nodes}

    def walk(file, o):
        for _ in range(32):
            if (file, o) not in by or file is None and o != o:
                return None
            p, v = by[file, o]
            if v is not None:
                return v
            o = p
        return None

    got = {(r["file"], r["object"]): r["value"] for r in graph.inherited(table).collect()}
    assert {k: v for k, v in got.items() if k[0]} == {(f, o): walk(f, o) for f, o, *_ in nodes if f}
    assert got["x", 34] == [3.0] and got["x", 35] is None  # 32 nodes, itself included
    assert all(got[None, o] == by[None, o][1] for o in range(120))  # a null file is nobody's


def test_reachable_against_a_walk(spark):
    rng = random.Random(6)
    edges = [(f, rng.randrange(60), rng.randrange(70)) for f in "abc" for _ in range(70)] + [("a", i, i + 1) for i in range(100, 140)]
    roots = [("a", 1), ("a", 100), ("b", 2), ("d", 9), ("a", 1)]
    want, open_ = set(), list(roots)
    while open_:
        f, o = open_.pop()
        if (f, o) not in want:
            want.add((f, o))
            open_ += [(f, t) for g, s, t in edges if (g, s) == (f, o)]
    got = graph.reachable(spark.createDataFrame(edges, "file string, from int, to int"), spark.createDataFrame(roots, "file string, object int"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_pdf_tables_agree_with_the_files(spark):
    def page(i, parent, box=b""):
        return b"%d 0 obj\n<< /Type /Page /Parent %d 0 R %s >>\nendobj\n" % (i, parent, box)

    data = b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [3 0 R 4 0 R 7 0 R] /MediaBox [0 0 200 100] >>\nendobj\n"
    data += page(3, 2) + page(4, 2, b"/MediaBox [1 2 3 4]") + b"5 0 obj\n(nothing leads here)\nendobj\n6 0 obj\n<< /Type /Pages /Parent 6 0 R >>\nendobj\n" + page(7, 6) + page(8, 99) + b"trailer\n<< /Root 1 0 R >>\n"
    files = spark.createDataFrame([("a.pdf", data), ("b.pdf", data.replace(b"[1 2 3 4]", b"[9 9 10 10]")), ("bad.pdf", b"no"), ("null.pdf", None)], "path string, content binary")
    table = pdf.object_table(files)
    boxes = {(r["file"], r["object"]): tuple(r["box"]) for r in pdf.page_boxes(table).collect()}
    for name in ("a.pdf", "b.pdf"):
        own = pdf.objects(bytes(files.where(F.col("path") == name).first()["content"]))
        assert {o: b for (f, o), b in boxes.items() if f == name} == {n: pdf.media_box(own, n) for n, (_, body) in own.items() if pdf._is_page(body)}
        kept = {r["object"] for r in pdf.kept_objects(table).where(F.col("file") == name).collect()}
        assert kept == set(pdf.pruned(bytes(files.where(F.col("path") == name).first()["content"]), own)) == {1, 2, 3, 4, 6, 7}


def test_earlier_values_of_hot_keys(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.randrange(400), i, rng.choice([None, 1, 2, 3, 4])) for i in range(1500)] + [("one", 1, -1, 5)]
    frame = spark.createDataFrame(rows, "k string, t int, i int, v int")
    for largest in (False, True):
        last, want = {}, {}
        for k, t, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
            want[i] = last.get(k)
            last[k] = v if not largest else max((x for x in (last.get(k), v) if x is not None), default=None)
        got = {r["i"]: r["before"] for r in skew.with_earlier(frame, "k", ["t", "i"], "v", "before", largest).collect()}
        assert got == want
    assert skew.with_earlier(frame.limit(0), "k", ["t"], "v", "before").count() == 0
