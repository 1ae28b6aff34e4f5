import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from darkroom.llm.quality_classifier import classify
from darkroom.llm.quality_rules import judge
from darkroom.llm.queries import tokenizer_path

from .test_sets import brute_decontamination, shingles

SF = "/root/testdata/sf0.001"


def test_stages_on_odd_rows(spark, odd_docs, no_docs, labels, tmp_path):
    folder = str(tmp_path / "sf")
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "goes on for a while and then it stops here for good"), (None, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "near_dedup", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (odd_docs, no_docs):
            out = stage(spark, docs, folder)
            assert out.columns == docs.columns
            assert out.exceptAll(docs).count() == 0, name
    kept = {r["doc_id"]: r["count"] for r in corpus_pipeline.near_dedup(spark, odd_docs, folder).groupBy("doc_id").count().collect()}
    assert kept[1] == 1 and 6 not in kept and kept[5] == 1 and kept[None] == 2 and kept[7] == 2  # both texts of 7


def test_stages_judge_rows_and_not_ids(spark, labels, tmp_path):
    folder = str(tmp_path / "sf")
    labels.write.parquet(f"{folder}/labels.parquet")
    item = "one two three four five six seven eight nine ten eleven"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(None, long), (None, long + " x"), (9, long), (9, "something else that is " + item), (9, "a clean text of the same id"), (None, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row_number", F.lit("clash"))
    left = corpus_pipeline.near_dedup(spark, docs, folder)
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == sorted([rows[2], *rows[3:]], key=str) and left.columns == docs.columns
    clean = corpus_pipeline.decontamination(spark, docs, folder).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in clean), key=str) == sorted([*rows[:3], rows[4]], key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_run_against_brute_force(spark):
    """Every stage, on what its predecessor kept, and the pieces at the end."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}

    def table(ids):
        return spark.createDataFrame([(i, texts[i]) for i in sorted(ids)], "doc_id long, text string")

    ids = {r["doc_id"] for r in classify(docs, labels).where("predicted = 1").collect()}
    ids = {r["doc_id"] for r in judge(table(ids), labels).where("kept").collect()}
    sets, root = {i: shingles(texts[i]) for i in ids}, {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    ids = {i for i in ids if find(i) == i}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    ids = {r[0] for r in brute_decontamination([(i, texts[i]) for i in ids], items, 10) if not r[-1]}

    pieces = sorted(map(tuple, corpus_pipeline.run(spark, SF).select("sequence_id", "offset", "doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()))
    assert {p[2] for p in pieces} == ids and len(ids) > 50
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")).encode
    tokens = {i: np.array(encode(texts[i], add_special_tokens=False).ids + [1], "<u4") for i in ids}
    at = 0
    for sequence, offset, doc_id, start, length, crc, n in pieces:
        assert 2048 * sequence + offset == at and n == len(tokens[doc_id])
        assert crc == zlib.crc32(tokens[doc_id][start : start + length].tobytes())
        at += length
    assert at == sum(map(len, tokens.values())) and len({(p[2], p[3]) for p in pieces}) == len(pieces)


def test_stages_begin_by_releasing_what_earlier_ones_hold(spark, monkeypatch):
    """Each stage asks for it before it reads anything: the driver's memory is bounded for the whole pipeline."""

    class Released(Exception):
        pass

    def released(session):
        raise Released

    monkeypatch.setattr(corpus_pipeline, "_released", released)
    for _, stage in corpus_pipeline.STAGES:
        with pytest.raises(Released):
            stage(spark, None, "/nowhere")
