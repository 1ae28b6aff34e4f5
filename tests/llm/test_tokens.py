import random
import zlib

import numpy as np
import pytest

from darkroom.llm.packing import pack
from darkroom.llm.queries import tokenizer_path
from darkroom.llm.token_counts import ChunkedCounter, count_tokens
from darkroom.llm.token_files import FrameReader, read_manifest, read_token_files, write_token_files
from darkroom.llm.tokens import PieceEncoder

BPE, PIECES = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def bpe():
    return PieceEncoder(BPE, cache_pieces=500)


def plain(bpe, text):
    return bpe.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_pieces_give_the_ids_of_the_whole_text(bpe):
    rng = random.Random(1)
    parts = ["a", "b1", "!", "'s", " ", "  ", "\n", "\t", "\r\n", "\xa0", "\x85", "　", "\x1c", "é", "中", " ", "​", "word", ",", ".", "ª", "Ⅷ", "_", "<|endoftext|>", "\U0001f600"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(4000)] + ["", "\n", " ", "x" * 5000, "a " + "!" * 900 + " b", "\nword" + "?" * 300, "é" * 200 + " " + "中" * 90]
    for lo in range(0, len(texts), 97):
        some = texts[lo : lo + 97]
        assert [np.frombuffer(x, "<u4").tolist() for x in bpe.encode(some)] == [plain(bpe, t) for t in some]


def test_token_files_round_trip(spark, odd_docs, no_docs, tmp_path, bpe):
    out = f"file://{tmp_path}/files"
    write_token_files(odd_docs, out, BPE, end_id=0, frame_tokens=64)
    rows = sorted(map(tuple, read_token_files(spark, out).collect()), key=lambda r: r[1])
    texts = sorted(((-1 if r["doc_id"] is None else r["doc_id"]), np.array(plain(bpe, r["text"]) + [0], "<u4").tobytes()) for r in odd_docs.select("doc_id", "text").collect())
    assert sorted((-1 if i is None else i, bytes(x)) for i, _, x in rows) == texts
    assert [r[0] for r in rows] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    at = 0
    for _, start, ids in rows:
        assert start == at
        at += len(ids) // 4
    some = read_token_files(spark, out, doc_ids=[5, 7, 99]).collect()
    assert sorted(r["doc_id"] for r in some) == [5, 7, 7]
    write_token_files(no_docs, f"{out}-none", BPE)
    assert read_manifest(spark, f"{out}-none").count() == 0 and read_token_files(spark, f"{out}-none").count() == 0


def test_a_changed_byte_is_noticed(spark, odd_docs, tmp_path):
    out = f"file://{tmp_path}/files"
    write_token_files(odd_docs.where("doc_id = 5"), out, BPE)
    (path,) = (tmp_path / "files").glob("*.tok")
    data = bytearray(path.read_bytes())
    data[40] ^= 1
    path.write_bytes(bytes(data))
    with path.open("rb") as f, pytest.raises(Exception):
        FrameReader(f).document(0)


def test_packing(spark, odd_docs, no_docs, bpe):
    pieces = [r.asDict() for r in pack(odd_docs, BPE, end_id=1, seq_len=64).collect()]
    by_place = sorted((p["sequence_id"], p["offset"]) for p in pieces)
    at = {}
    for s, o in by_place:
        assert o == at.get(s, 0)
        at[s] = o + next(p["length"] for p in pieces if (p["sequence_id"], p["offset"]) == (s, o))
    assert sorted(at) == list(range(len(at))) and all(n == 64 for s, n in at.items() if s < len(at) - 1)
    whole = sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"]))
    got, doc = [], b""
    for p in whole:
        assert p["start"] == len(doc) // 4 and len(p["ids"]) == 4 * p["length"]
        doc += bytes(p["ids"])
        if len(doc) == 4 * p["doc_tokens"]:
            got.append((-1 if p["doc_id"] is None else p["doc_id"], zlib.crc32(doc)))
            doc = b""
    want = [(-1 if r["doc_id"] is None else r["doc_id"], zlib.crc32(np.array(plain(bpe, r["text"]) + [1], "<u4").tobytes())) for r in odd_docs.select("doc_id", "text").collect()]
    assert not doc and sorted(got) == sorted(want)
    assert pack(no_docs, BPE).count() == 0


def test_token_counts(spark, odd_docs, no_docs):
    model = ChunkedCounter(PIECES, 100, 8)
    assert model.stable
    rng = random.Random(2)
    parts = ["a", "the ", " ", "  ", "hé", "\n", "▁", "▁ ", " ▁", "☃", "tion", " in", "<s>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 500))) for _ in range(500)] + ["a" * 1000, "a " * 500, " " * 500, ""]
    assert model.counts(texts) == [len(model.model.encode(t)) for t in texts]
    model.stable = False
    assert model.counts(texts[:20]) == [len(model.model.encode(t)) for t in texts[:20]]
    rows = count_tokens(odd_docs, PIECES, limit=100, chunk_chars=1000).collect()
    want = sorted((-1 if r["doc_id"] is None else r["doc_id"], len((r["text"] or "").encode()), len(model.model.encode(r["text"] or ""))) for r in odd_docs.select("doc_id", "text").collect())
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in rows) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in rows)
    assert count_tokens(no_docs, PIECES).count() == 0
